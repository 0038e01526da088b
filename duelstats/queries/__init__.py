"""Queries over the test tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scalars", "analysis", "boards", "store", "incremental", "collect", "corpus")


def _load() -> None:
    for name in MODULES:
        import_module(f"duelstats.queries.{name}")


def all_queries() -> dict:
    _load()
    from duelstats.queries.base import QUERIES

    return dict(QUERIES)


def all_oracles() -> dict:
    _load()
    from duelstats.queries.base import ORACLES

    return dict(ORACLES)
