"""Leaderboards: counts, ranks and behaviour of decks, cards and archetypes per rank scope.

As in ``stats`` the samples are summed once by disjoint class; scopes, cards and archetypes come from the sums.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from duelstats.functions import decks, outcomes, ranks
from duelstats.functions.text import sample_date, strip
from duelstats.operators.ranking import ranked, top
from duelstats.operators.samples import board_scopes
from duelstats.operators.stats import COUNTS, result_counts
from duelstats.params import MIX_FLOOR, MIX_LIMIT, RECENT_LIMIT

OTHER = "其他"


def iso_date(text: str) -> bool:
    try:
        datetime.strptime(text[:10], "%Y-%m-%d")
    except ValueError:
        return False
    return True


def keyed(samples: DataFrame) -> DataFrame:
    """Side samples with the board's result and the disjoint class of their rank."""
    return samples.drop("result").withColumnRenamed("board_result", "result").withColumn("order_class", ranks.order_class(F.col("rank_order")))


def added(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])


def scored(df: DataFrame) -> DataFrame:
    wins, losses = F.col("win_count"), F.col("loss_count")
    return df.select("*", outcomes.win_rate(wins, losses).alias("win_rate"), outcomes.wilson(wins, losses).alias("wilson_lower_bound"))


def deck_counts(samples: DataFrame) -> DataFrame:
    """Counts per (rank_scope, deck); unknown results count as samples."""
    by_class = keyed(samples).groupBy("deck_fingerprint", "order_class").agg(*result_counts(F.col("result")))
    return added(board_scopes(by_class), "rank_scope", "deck_fingerprint")


def card_counts(deck_rows: DataFrame, *keys: str) -> DataFrame:
    """Counts per (rank_scope, card), and further keys, from the deck counts."""
    cards = decks.distinct_cards(decks.cards_of(F.col("deck_fingerprint")))
    return added(deck_rows.withColumn("card_hash", F.explode(cards)), *keys, "rank_scope", "card_hash")


def board_order(key: str) -> list[Column]:
    """Order of every board: score, samples, wins, key, all falling."""
    return [F.coalesce("wilson_lower_bound", F.lit(0.0)).desc(), F.col("sample_count").desc(), F.col("win_count").desc(), F.col(key).desc()]


def ranked_board(counts: DataFrame, key: str) -> DataFrame:
    return ranked(scored(counts), ["rank_scope"], board_order(key))


def scope_totals(samples: DataFrame) -> DataFrame:
    """Samples and distinct matches per rank scope. A match meets a scope at most once per class, so classes are
    reduced per match before they are counted."""
    per_match = keyed(samples).groupBy("match_id").agg(
        F.collect_set("order_class").alias("classes"), F.collect_list("order_class").alias("sides")
    )
    scopes = lambda c: F.flatten(F.transform(c, ranks.scopes_of_order_class))
    matches = per_match.select(F.explode(F.array_distinct(scopes(F.col("classes")))).alias("rank_scope"), F.lit(1).alias("m"), F.lit(0).alias("s"))
    sides = per_match.select(F.explode(scopes(F.col("sides"))).alias("rank_scope"), F.lit(0).alias("m"), F.lit(1).alias("s"))
    both = matches.unionByName(sides).groupBy("rank_scope")
    return both.agg(F.sum("m").alias("match_count"), F.sum("s").alias("side_sample_count"))


# ---- behaviour of a board entity ---------------------------------------------------------------------------------


FACETS = ("player", "weapon", "style", "date", "soul")


def facets(samples: DataFrame, anchor: str = "", kinds: tuple[str, ...] = FACETS) -> DataFrame:
    """Counts per (rank_scope, deck, kind, name) for players, weapons, styles, dates and souls, or for some of these ``kinds``.

    One pass over the samples: every sample explodes into its few facets, which the map side already adds up. Names
    of choices come normalised and distinct out of the loadout (``functions.loadout``). Blank names do not count. With
    a fixed trend ``anchor`` only the fourteen days the trend looks at are kept.
    """
    date = sample_date(F.col("played_at"))
    if iso_date(anchor):
        date = F.when(F.date_diff(F.to_date(F.lit(anchor)), date).between(0, 13), date)
    day = F.date_format(date, "yyyy-MM-dd")
    item = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("name"))
    names = {"player": strip(F.col("player_name")), "weapon": F.col("weapon"), "style": F.col("style"), "date": day}
    parts = F.array(*[item(kind, c) for kind, c in names.items() if kind in kinds])
    if "soul" in kinds:
        souls = F.transform(F.coalesce("souls", F.array().cast("array<string>")), lambda s: item("soul", s))
        parts = F.concat(parts, souls) if len(kinds) > 1 else souls
    exploded = keyed(samples).select("deck_fingerprint", "order_class", "result", F.explode(parts).alias("f"))
    named = exploded.where(F.col("f.name") != "")
    by_class = named.groupBy("deck_fingerprint", "order_class", F.col("f.kind").alias("kind"), F.col("f.name").alias("name")).agg(
        *result_counts(F.col("result"))
    )
    return added(board_scopes(by_class), "rank_scope", "deck_fingerprint", "kind", "name")


def of_kind(facet_rows: DataFrame, kind: str) -> DataFrame:
    return facet_rows.where(F.col("kind") == kind).drop("kind")


def mix_order() -> list[Column]:
    return [F.col("sample_count").desc(), F.col("win_count").desc(), F.col("name").asc()]


def concentration(facet_rows: DataFrame, entity: str) -> DataFrame:
    """Top player, its count, number of players and the samples of the three most frequent ones."""
    players = of_kind(facet_rows, "player")
    keys = ["rank_scope", entity]
    totals = players.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("player_count"),
        F.min_by("name", F.struct(-F.col("sample_count"), "name")).alias("top_player"),
        F.max("sample_count").alias("top_player_count"),
    )
    three = top(players, keys, mix_order(), 3, "n").groupBy(*keys).agg(F.sum("sample_count").alias("top3_count"))
    return totals.join(three, keys)


def usage(df: DataFrame, samples: Column, wins: Column) -> DataFrame:
    rare = F.col("sample_count") < MIX_FLOOR
    return df.select(
        "*",
        F.try_divide(F.col("sample_count").cast("double"), samples).alias("usage_rate"),
        F.try_divide(F.col("win_count").cast("double"), wins).alias("win_usage_rate"),
        F.when(~rare, outcomes.win_rate(F.col("win_count"), F.col("loss_count"))).alias("conditional_win_rate"),
        rare.alias("low_sample"),
    )


MIX = ["place", "name", "sample_count", "win_count", "usage_rate", "win_usage_rate", "conditional_win_rate", "low_sample"]


def category_mix(facet_rows: DataFrame, entity: str, kind: str) -> DataFrame:
    """Three most used names and the rest as one row; rates are shares of the named total.

    The rest is the total minus the visible rows, so no group is ever ranked in full.
    """
    rows = of_kind(facet_rows, kind)
    keys = ["rank_scope", entity]
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("names"), *[F.sum(c).alias(f"all_{c}") for c in COUNTS])
    shown = top(rows, keys, mix_order(), MIX_LIMIT, "place")
    seen = shown.groupBy(*keys).agg(*[F.sum(c).alias(f"seen_{c}") for c in COUNTS])
    rest = (
        totals.where(F.col("names") > MIX_LIMIT)
        .join(seen, keys)
        .select(*keys, F.lit(OTHER).alias("name"), *[(F.col(f"all_{c}") - F.col(f"seen_{c}")).alias(c) for c in COUNTS], F.lit(MIX_LIMIT + 1).alias("place"))
    )
    both = shown.unionByName(rest).join(totals, keys)
    return usage(both, F.col("all_sample_count"), F.col("all_win_count")).select(*keys, *MIX)


def soul_mix(facet_rows: DataFrame, counts: DataFrame, entity: str) -> DataFrame:
    """Three most used souls; rates are shares of the entity's samples and wins."""
    keys = ["rank_scope", entity]
    shown = top(of_kind(facet_rows, "soul"), keys, mix_order(), MIX_LIMIT, "place")
    totals = counts.select(*keys, F.col("sample_count").alias("all_samples"), F.col("win_count").alias("all_wins"))
    return usage(shown.join(totals, keys), F.col("all_samples"), F.col("all_wins")).select(*keys, *MIX)


def trend(facet_rows: DataFrame, counts: DataFrame, entity: str, anchor: str) -> DataFrame:
    """Counts and rates of the seven days up to the anchor and of the seven before.

    ``anchor`` is a date; where it is none, an entity's own latest date stands in. Entities without dated samples
    keep zero counts.
    """
    keys = ["rank_scope", entity]
    days = of_kind(facet_rows, "date").withColumn("day", F.to_date("name"))
    if iso_date(anchor):
        dated = days.withColumn("latest", F.to_date(F.lit(anchor)))
    else:
        dated = days.join(days.groupBy(*keys).agg(F.max("day").alias("latest")), keys)
    dated = dated.withColumn("age", F.date_diff("latest", "day"))
    last, previous = F.col("age").between(0, 6), F.col("age").between(7, 13)
    total = lambda test, c: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0))
    sums = dated.groupBy(*keys).agg(
        total(last, "sample_count").alias("last_7d_sample_count"),
        outcomes.win_rate(total(last, "win_count"), total(last, "loss_count")).alias("last_7d_win_rate"),
        total(previous, "sample_count").alias("previous_7d_sample_count"),
        outcomes.win_rate(total(previous, "win_count"), total(previous, "loss_count")).alias("previous_7d_win_rate"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counts.select(*keys).join(sums, keys, "left").select(
        *keys,
        zero("last_7d_sample_count"),
        "last_7d_win_rate",
        zero("previous_7d_sample_count"),
        "previous_7d_win_rate",
        (F.col("last_7d_win_rate") - F.col("previous_7d_win_rate")).alias("delta_7d"),
    )


RECENT_KEY = ["played_at", "player_name", "weapon", "style", "match_id", "side_index"]


def recent(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Latest samples per key; the task-side limit keeps hot keys small."""
    falling = [F.col(c).desc() for c in RECENT_KEY]
    return top(rows, keys, falling, RECENT_LIMIT, "back").drop("back")


def deck_recent(samples: DataFrame) -> DataFrame:
    """Latest samples per (rank_scope, deck): first per disjoint class, then per scope."""
    lean = keyed(samples).select(
        "deck_fingerprint", "order_class", "result", F.coalesce("played_at", F.lit("")).alias("played_at"),
        strip(F.coalesce("player_name", F.lit(""))).alias("player_name"),
        F.coalesce("weapon", F.lit("")).alias("weapon"), F.coalesce("style", F.lit("")).alias("style"), "match_id", "side_index",
    )
    by_class = recent(lean, ["deck_fingerprint", "order_class"])
    return recent(board_scopes(by_class), ["rank_scope", "deck_fingerprint"])


def recent_points(recent_rows: DataFrame, entity: str) -> DataFrame:
    """Running win rate over the latest samples, oldest first; undated ones drop out."""
    day = sample_date(F.col("played_at"))
    dated = recent_rows.withColumn("date", day).where(F.col("date").isNotNull())
    rising = Window.partitionBy("rank_scope", entity).orderBy("date", *RECENT_KEY)
    running = rising.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = lambda r: F.sum(F.when(F.col("result") == r, 1).otherwise(0)).over(running)
    return dated.select(
        "rank_scope", entity, F.row_number().over(rising).alias("index"), F.date_format("date", "yyyy-MM-dd").alias("date"),
        "played_at", "result", outcomes.win_rate(so_far("win"), so_far("loss")).alias("rolling_win_rate"),
    )


def trust(counts: DataFrame, players: DataFrame, entity: str) -> DataFrame:
    """Credibility label from sample size and concentration on few players."""
    keys = ["rank_scope", entity]
    share = F.coalesce(F.col("top3_count").cast("double"), F.lit(0.0)) / F.col("sample_count")
    count = F.coalesce("player_count", F.lit(0))
    return counts.select(*keys, "sample_count").join(players, keys, "left").select(
        *keys,
        outcomes.credibility(F.col("sample_count"), count, share).alias("label"),
        share.alias("top3_player_share"),
        count.alias("player_count"),
        "sample_count",
    )


def profile(counts: DataFrame, facet_rows: DataFrame, recent_rows: DataFrame, entity: str, anchor: str) -> DataFrame:
    """Everything a board shows beside the counts, one row per entity; all arrays are short by construction."""
    keys = ["rank_scope", entity]

    def packed(df: DataFrame, name: str, order: str) -> DataFrame:
        fields = [c for c in df.columns if c not in (*keys, order)]
        return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias(name))

    def row(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))

    people = concentration(facet_rows, entity)
    parts = [
        people.select(*keys, "top_player", "top_player_count", "player_count"),
        packed(category_mix(facet_rows, entity, "weapon"), "weapons", "place"),
        packed(category_mix(facet_rows, entity, "style"), "styles", "place"),
        packed(soul_mix(facet_rows, counts, entity), "souls", "place"),
        row(trend(facet_rows, counts, entity, anchor), "trend"),
        packed(recent_points(recent_rows, entity), "last_30_points", "index"),
        row(trust(counts, people, entity), "credibility"),
    ]
    out = counts
    for part in parts:
        out = out.join(part, keys, "left")
    return out


def regrouped(rows: DataFrame, members: DataFrame, *keys: str) -> DataFrame:
    """Deck-level counts regrouped by archetype; ``members`` map (rank_scope, deck) to a representative."""
    return added(rows.join(members, ["rank_scope", "deck_fingerprint"]), "rank_scope", "representative", *keys)


def regrouped_recent(rows: DataFrame, members: DataFrame) -> DataFrame:
    """An archetype's latest samples are among the latest of its members."""
    return recent(rows.join(members, ["rank_scope", "deck_fingerprint"]).drop("deck_fingerprint"), ["rank_scope", "representative"])
