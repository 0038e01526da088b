"""Bouts to side samples, and the scopes a sample counts in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duelstats.functions import decks, outcomes, ranks
from duelstats.functions.text import parse_rate, strip
from duelstats.params import JobConfig


def played_date(played_at: Column) -> Column:
    return F.substring(played_at, 1, 10)


def in_window(played_at: Column, cfg: JobConfig) -> Column:
    """Dates compare as text, inclusive; an empty one is outside.

    Said on the column itself, so that it reaches the Parquet scan: the first ten characters are at most ``date_to``
    exactly when the text comes before ``date_to`` with its last character raised by one.
    """
    after = cfg.date_to[:-1] + chr(ord(cfg.date_to[-1]) + 1)
    return (played_at != "") & (played_at >= cfg.date_from) & (played_at < after)


def regular_mode(mode: Column, cfg: JobConfig) -> Column:
    if cfg.include_solo:
        return F.lit(True)
    return ~strip(F.coalesce(mode, F.lit(""))).isin(*cfg.excluded_modes)


def in_scope(bouts: DataFrame, cfg: JobConfig, version_required: bool = False) -> DataFrame:
    """Bouts a job counts: window, mode and, when given or required, version."""
    kept = bouts.where(in_window(F.col("played_at"), cfg) & regular_mode(F.col("mode"), cfg))
    if cfg.version or version_required:
        kept = kept.where(F.col("version") == cfg.version)
    return kept


def side_samples(bouts: DataFrame) -> DataFrame:
    """One row per side that has a deck. Narrow: no shuffle."""
    me, other = F.col("me"), F.col("other")
    first, second = F.get("sides", F.lit(0)), F.get("sides", F.lit(1))
    exploded = bouts.select(
        "match_id", "played_at", "mode", "version", F.col("result").alias("match_result"),
        outcomes.rate_total(F.col("castle_rows"), "player").alias("player_total"),
        outcomes.rate_total(F.col("castle_rows"), "enemy").alias("enemy_total"),
        first.alias("first"), second.alias("second"),
        F.explode("sides").alias("me"),
    ).withColumn("other", F.when(F.col("first.side_index") == F.col("me.side_index"), F.col("second")).otherwise(F.col("first")))
    own, opp = parse_rate(me["castle_rate"]), parse_rate(other["castle_rate"])
    is_first = me["side_index"] == 1
    has_deck = F.coalesce(me["deck_fingerprint"], F.lit("")) != ""
    return (
        exploded.where(me["side_index"].isin(1, 2) & has_deck)
        .select(
            "match_id",
            me["side_index"].alias("side_index"),
            "mode",
            "version",
            "played_at",
            outcomes.side_result(F.col("match_result"), me["side_index"]).alias("result"),
            outcomes.board_result(F.col("match_result"), me["side_index"], me["result"]).alias("board_result"),
            me["player_name"].alias("player_name"),
            me["rank"].alias("rank"),
            me["rank_order"].alias("rank_order"),
            me["deck_fingerprint"].alias("deck_fingerprint"),
            me["cards"].alias("cards"),
            own.alias("own_castle_rate"),
            opp.alias("opponent_castle_rate"),
            F.when(is_first, F.col("enemy_total")).otherwise(F.col("player_total")).alias("dealt"),
            F.when(is_first, F.col("player_total")).otherwise(F.col("enemy_total")).alias("taken"),
            me["kill_count"].alias("kill_count"),
            me["death_count"].alias("death_count"),
            me["weapon"].alias("weapon"),
            me["style"].alias("style"),
            me["souls"].alias("souls"),
        )
        .select(
            "*",
            (F.col("own_castle_rate") - F.col("opponent_castle_rate")).alias("castle_diff"),
            F.coalesce(F.col("opponent_castle_rate") <= 0, F.lit(False)).alias("castle_crash"),
            F.coalesce(F.col("own_castle_rate") <= 0, F.lit(False)).alias("castle_crashed"),
            F.coalesce("dealt", outcomes.remaining_damage(F.col("opponent_castle_rate"))).alias("castle_damage_dealt"),
            F.coalesce("taken", outcomes.remaining_damage(F.col("own_castle_rate"))).alias("castle_damage_taken"),
        )
        .drop("dealt", "taken")
    )


def known_samples(samples: DataFrame) -> DataFrame:
    """Analysis counts only samples with a known result; boards keep the rest in their sample counts."""
    return samples.where(F.col("result") != "unknown")


def analysis_scopes(df: DataFrame, cfg: JobConfig) -> DataFrame:
    """Explode rows into (sample_scope, version_scope); needs ``rank_class`` and ``version``.

    Scopes overlap, so callers first group by the disjoint class and explode the few grouped rows.
    """
    return (
        df.withColumn("sample_scope", F.explode(ranks.scopes_of_rank_class(F.col("rank_class"), cfg.high_rank)))
        .withColumn("version_scope", F.explode(ranks.version_scopes(F.col("version"))))
        .drop("rank_class", "version")
    )


def board_scopes(df: DataFrame) -> DataFrame:
    """Explode rows into the overlapping rank scopes of the boards; needs ``order_class``."""
    return df.withColumn("rank_scope", F.explode(ranks.scopes_of_order_class(F.col("order_class")))).drop("order_class")


def nest(matches: DataFrame, sides: DataFrame, deck_units: DataFrame, castle: DataFrame) -> DataFrame:
    """Bouts out of normalised tables. Every table is grouped by match first, so all joins share one partitioning.

    ``matches`` has one row per match, ``sides`` one per side, ``deck_units`` (match_id, side_index, slot, card)
    and ``castle`` (match_id, ordinal, player, label, enemy).
    """
    units = deck_units.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("side_index", "slot", "card"))).alias("units"))
    rows = castle.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "player", "label", "enemy"))).alias("rows"))
    names = [c for c in sides.columns if c not in ("match_id", "side_index")]
    people = sides.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("side_index", *names))).alias("people"))

    def with_cards(side: Column) -> Column:
        mine = F.filter("units", lambda u: u["side_index"] == side["side_index"])
        return F.struct(
            *[side[n].alias(n) for n in ["side_index", *names]],
            F.transform(mine, lambda u: u["card"]).alias("cards"),
            decks.fingerprint(F.transform(mine, lambda u: u["card"])).alias("deck_fingerprint"),
        )

    joined = matches.join(people, "match_id", "left").join(units, "match_id", "left").join(rows, "match_id", "left")
    castle_rows = F.transform("rows", lambda r: F.struct(r["player"].alias("player"), r["label"].alias("label"), r["enemy"].alias("enemy")))
    return joined.select(
        *matches.columns,
        F.coalesce(castle_rows, F.array().cast("array<struct<player:string,label:string,enemy:string>>")).alias("castle_rows"),
        F.transform("people", with_cards).alias("sides"),
    )
