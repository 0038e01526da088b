"""Results, rates and scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from duelstats.functions.text import parse_rate

Z = 1.96
KNOWN = ("win", "loss", "draw")


def normal_result(c: Column) -> Column:
    return F.when(c.isin(*KNOWN), c).otherwise("unknown")


def reversed_result(c: Column) -> Column:
    return F.when(c == "win", "loss").when(c == "loss", "win").when(c == "draw", "draw").otherwise("unknown")


def side_result(match_result: Column, side_index: Column) -> Column:
    """Result of a side as the match tells it: side 2 sees the opposite of side 1."""
    return F.when(side_index == 1, normal_result(match_result)).otherwise(reversed_result(match_result))


def board_result(match_result: Column, side_index: Column, stored: Column) -> Column:
    """Boards fall back on the side's own stored result where the match does not tell."""
    told = side_result(match_result, side_index)
    return F.when(told != "unknown", told).otherwise(normal_result(stored))


def win_rate(wins: Column, losses: Column) -> Column:
    return F.try_divide(wins.cast("double"), wins + losses)


def wilson(wins: Column, losses: Column, z: float = Z) -> Column:
    """Lower bound of the Wilson interval of the win rate; null without decided samples."""
    n = (wins + losses).cast("double")
    p = wins / n
    spread = F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) * z
    return F.when(n > 0, (p + z * z / (2 * n) - spread) / (1 + z * z / n))


def remaining_damage(rate: Column) -> Column:
    return F.when(rate.isNotNull(), F.greatest(F.lit(0.0), 100.0 - rate))


def rate_total(rows: Column, field: str) -> Column:
    """Sum of the parseable texts of one field of an array of structs; null when none parses."""
    rates = F.filter(F.transform(rows, lambda r: parse_rate(r[field])), lambda v: v.isNotNull())
    return F.when(F.size(rates) > 0, F.aggregate(rates, F.lit(0.0), lambda a, v: a + v))


def matchup_tone(rate: Column) -> Column:
    return F.when(rate.isNull(), "empty").when(rate >= 0.55, "advantage").when(rate <= 0.45, "disadvantage").otherwise("even")


def credibility(samples: Column, players: Column, top3_share: Column) -> Column:
    return (
        F.when((samples >= 500) & (players >= 30) & (top3_share < 0.5), "high")
        .when((samples >= 200) & (players >= 15) & (top3_share < 0.7), "medium")
        .otherwise("low")
    )
