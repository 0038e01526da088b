"""Player rank: number in the national ranking, and the ordered tier behind the rank scopes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from duelstats.functions.markup import let
from duelstats.functions.text import ascii_digits, strip
from duelstats.params import ALL_PLAYERS, ALL_RANKER, ALL_VERSIONS, RANK_SCOPES, high_rank_scope

RANKING_KEY = "全国主君ランキング"
# Profile keys that may hold the rank label, in order of preference.
LABEL_KEYS = ("段位", "位階", "リーグ", "league", "rank_label", "rank")
CERTIFICATE_KEYS = ("証", "证")
# Label fragments per tier. The order matters, since a later fragment is part of an earlier one.
TIERS = (
    (10, ("風来坊",)),
    (20, ("旅人",)),
    (30, ("食客",)),
    (40, ("従騎士", "從騎士", "从骑士")),
    (50, ("騎士", "骑士")),
    (60, ("万石", "萬石")),
    (70, ("男爵", "子爵", "伯爵", "侯爵", "公爵", "海賊", "海贼", "団長", "团长", "頭領", "头领")),
)


def pocket_text(pocket: Column, key: str) -> Column:
    return F.try_variant_get(pocket, f"$['{key}']", "string")


def first_text(*columns: Column) -> Column:
    """First value that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def ranking(profile: Column) -> Column:
    digits = F.regexp_extract(F.replace(ascii_digits(F.coalesce(pocket_text(profile, RANKING_KEY), F.lit(""))), F.lit(","), F.lit("")), r"\d+", 0)
    return digits.try_cast("int")


def rank_label(profile: Column) -> Column:
    return strip(first_text(*[pocket_text(profile, key) for key in LABEL_KEYS]))


def order_of_label(label: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for order, fragments in TIERS:
        for fragment in fragments:
            out = out.when(label.contains(fragment), order)
    return out


def order_of_certificate(certificate: Column) -> Column:
    n = F.regexp_replace(ascii_digits(F.coalesce(certificate, F.lit(""))), r"\D", "").try_cast("bigint")
    return F.when(n <= 9, 20).when(n < 50, 40).when(n < 100, 50).when(n >= 100, 60)


def rank_order(profile: Column) -> Column:
    """Order of the label, else of the certificate; each text is taken out of the pocket once and not for every fragment."""
    certificate = first_text(*[pocket_text(profile, key) for key in CERTIFICATE_KEYS])
    return F.coalesce(let(rank_label(profile), order_of_label), let(certificate, order_of_certificate))


def order_class(order: Column) -> Column:
    """Disjoint classes of the order; every rank scope is a union of classes."""
    return (
        F.when(order.isNull(), "none").when(order <= 20, "low").when(order < 50, "mid").when(order == 50, "knight").otherwise("high")
    )


def scopes_of_order_class(cls: Column) -> Column:
    member = {
        "all": F.lit(True),
        "traveler_down": cls == "low",
        "knight_down": cls.isin("low", "mid", "knight"),
        "knight_up": cls.isin("knight", "high"),
    }
    return F.array_compact(F.array(*[F.when(member[s], F.lit(s)) for s in RANK_SCOPES]))


def rank_class(rank: Column, limit: int) -> Column:
    return F.when(rank.isNull(), "none").when(rank <= limit, "top").otherwise("ranked")


def scopes_of_rank_class(cls: Column, limit: int) -> Column:
    return (
        F.when(cls == "top", F.array(F.lit(ALL_PLAYERS), F.lit(ALL_RANKER), F.lit(high_rank_scope(limit))))
        .when(cls == "ranked", F.array(F.lit(ALL_PLAYERS), F.lit(ALL_RANKER)))
        .otherwise(F.array(F.lit(ALL_PLAYERS)))
    )


def version_scopes(version: Column) -> Column:
    return F.when(F.coalesce(version, F.lit("")) == "", F.array(F.lit(ALL_VERSIONS))).otherwise(F.array(F.lit(ALL_VERSIONS), version))
