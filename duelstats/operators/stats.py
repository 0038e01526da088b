"""Analysis statistics of decks and cards over overlapping scopes.

Samples are summed once per (deck, rank class, version): classes are disjoint, so this is the only shuffle that sees
samples, and it combines on the map side. Scopes are then exploded from the few summed rows, and card statistics
come from the same rows, since a deck's cards follow from its fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from duelstats.functions import decks, outcomes, ranks
from duelstats.operators.samples import analysis_scopes
from duelstats.params import ALL_PLAYERS, ALL_RANKER, ALL_VERSIONS, HIGH_WIN_RATE, JobConfig, high_rank_scope

SCOPE = ["sample_scope", "version_scope"]
COUNTS = ["sample_count", "win_count", "loss_count", "draw_count"]
MEASURES = ["castle_diff", "own_castle_rate", "castle_damage_dealt", "castle_damage_taken", "kill_count", "death_count"]
CRASHES = ["castle_crash_count", "castle_crashed_count"]
COMPARED = ["sample_count", "win_rate", "wilson_lower_bound"]


def result_counts(result: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("sample_count")] + [F.count_if(result == r).alias(f"{r}_count") for r in ("win", "loss", "draw")]


def deck_sums(samples: DataFrame, cfg: JobConfig) -> DataFrame:
    """Additive state per (deck, rank class, version): counts, and sum and number of every measure."""
    state = result_counts(F.col("result"))
    for m in MEASURES:
        state += [F.sum(m).alias(f"sum_{m}"), F.count(m).alias(f"n_{m}")]
    state += [F.count_if("castle_crash").alias(CRASHES[0]), F.count_if("castle_crashed").alias(CRASHES[1])]
    keyed = samples.withColumn("rank_class", ranks.rank_class(F.col("rank"), cfg.high_rank))
    return keyed.groupBy("deck_fingerprint", "rank_class", "version").agg(*state)


def merged(sums: DataFrame, *keys: str) -> DataFrame:
    """Add up states per key."""
    state = [c for c in sums.columns if c in COUNTS + CRASHES or c.startswith(("sum_", "n_"))]
    return sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in state])


def finished(state: DataFrame, *keys: str) -> DataFrame:
    """Rates and means out of summed state."""
    crashes = [c for c in CRASHES if c in state.columns]
    means = [F.try_divide(F.col(f"sum_{m}"), F.col(f"n_{m}")).alias(f"avg_{m}") for m in MEASURES]
    return state.select(
        *keys,
        *COUNTS,
        outcomes.win_rate(F.col("win_count"), F.col("loss_count")).alias("win_rate"),
        outcomes.wilson(F.col("win_count"), F.col("loss_count")).alias("wilson_lower_bound"),
        *means,
        *crashes,
    )


def scoped_deck_stats(samples: DataFrame, cfg: JobConfig) -> DataFrame:
    """Statistics of every deck in every scope pair, before any floor."""
    keys = [*SCOPE, "deck_fingerprint"]
    return finished(merged(analysis_scopes(deck_sums(samples, cfg), cfg), *keys), *keys)


def scoped_card_stats(samples: DataFrame, cfg: JobConfig) -> DataFrame:
    """Statistics of every card in every scope pair; a card counts once per side however many copies."""
    sums = deck_sums(samples, cfg).drop(*CRASHES)
    cards = sums.withColumn("card_hash", F.explode(decks.distinct_cards(decks.cards_of(F.col("deck_fingerprint")))))
    keys = [*SCOPE, "card_hash"]
    by_class = merged(cards, "card_hash", "rank_class", "version")
    return finished(merged(analysis_scopes(by_class, cfg), *keys), *keys)


def high_win_decks(scoped_decks: DataFrame, cfg: JobConfig) -> DataFrame:
    """Cards of the winning decks per scope pair, with the number of such decks holding them."""
    winners = scoped_decks.where((F.col("sample_count") >= cfg.deck_floor) & (F.col("win_rate") >= HIGH_WIN_RATE))
    cards = winners.select(*SCOPE, F.explode(decks.distinct_cards(decks.cards_of(F.col("deck_fingerprint")))).alias("card_hash"))
    return cards.groupBy(*SCOPE, "card_hash").agg(F.count(F.lit(1)).alias("high_win_deck_count"))


def deck_stats(samples: DataFrame, cfg: JobConfig) -> DataFrame:
    return scoped_deck_stats(samples, cfg).where(F.col("sample_count") >= cfg.deck_floor)


def card_stats(samples: DataFrame, cfg: JobConfig) -> DataFrame:
    cards = scoped_card_stats(samples, cfg).where(F.col("sample_count") >= cfg.card_floor)
    winners = high_win_decks(scoped_deck_stats(samples, cfg), cfg)
    joined = cards.join(winners, [*SCOPE, "card_hash"], "left")
    return joined.withColumn("high_win_deck_count", F.coalesce("high_win_deck_count", F.lit(0)))


def base_stats(stats: DataFrame) -> DataFrame:
    return stats.where((F.col("sample_scope") == ALL_PLAYERS) & (F.col("version_scope") == ALL_VERSIONS))


def base_order(key: str) -> list[Column]:
    """Order of the reports; the key breaks ties."""
    return [F.coalesce("wilson_lower_bound", F.lit(0.0)).desc(), F.col("sample_count").desc(), F.col(key).asc()]


def current_version(bouts: DataFrame) -> DataFrame:
    """Version of the latest bout that names one (one row)."""
    latest = F.max_by("version", F.struct("played_at", "match_id"))
    named = bouts.where(F.coalesce("version", F.lit("")) != "")
    return named.agg(F.coalesce(latest, F.lit("")).alias("current_version"))


def counters(bouts: DataFrame, samples: DataFrame, cfg: JobConfig) -> DataFrame:
    """Run counters as (metric, value) rows with dotted names; ``samples`` include the unknown results."""
    known = samples.where(F.col("result") != "unknown")
    name = lambda prefix, c: F.concat(F.lit(prefix + "."), c)
    text = lambda c: c.cast("string")

    def unpivot(df: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), text(F.col(c)).alias("value")) for c in df.columns])
        return df.select(F.explode(pairs).alias("p")).select("p.*")

    def grouped(df: DataFrame, prefix: str, key: Column) -> DataFrame:
        return df.groupBy(name(prefix, key).alias("metric")).agg(text(F.count(F.lit(1))).alias("value"))

    sides = unpivot(
        samples.agg(
            F.count_if(F.col("result") != "unknown").alias("side_samples"),
            F.count(F.lit(1)).alias("raw_side_samples"),
            F.count_if(F.col("result") == "unknown").alias("unknown_result_side_samples"),
        )
    )

    def groups(stats: DataFrame, kind: str, floor: int) -> DataFrame:
        base = (F.col("sample_scope") == ALL_PLAYERS) & (F.col("version_scope") == ALL_VERSIONS)
        return unpivot(
            stats.agg(
                F.count_if(base).alias(f"{kind}_groups"),
                F.count_if(base & (F.col("sample_count") >= floor)).alias(f"{kind}_groups_exported"),
                F.count(F.lit(1)).alias(f"scoped_{kind}_groups"),
            )
        )

    parts = [
        unpivot(bouts.agg(F.count(F.lit(1)).alias("matches"))),
        unpivot(current_version(bouts)),
        sides,
        groups(scoped_deck_stats(known, cfg), "deck", cfg.deck_floor),
        groups(scoped_card_stats(known, cfg), "card", cfg.card_floor),
        grouped(bouts, "mode_counts", F.coalesce("mode", F.lit(""))),
        grouped(bouts.where(F.coalesce("version", F.lit("")) != ""), "version_counts", F.col("version")),
        grouped(known, "result_counts", F.col("result")),
        scope_counts(known, cfg).select(name("sample_scope_counts", F.col("sample_scope")).alias("metric"), text(F.col("sample_count")).alias("value")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scope_counts(samples: DataFrame, cfg: JobConfig) -> DataFrame:
    by_class = samples.groupBy(ranks.rank_class(F.col("rank"), cfg.high_rank).alias("rank_class")).agg(F.count(F.lit(1)).alias("n"))
    scoped = by_class.select(F.explode(ranks.scopes_of_rank_class(F.col("rank_class"), cfg.high_rank)).alias("sample_scope"), "n")
    return scoped.groupBy("sample_scope").agg(F.sum("n").alias("sample_count"))


def with_comparisons(stats: DataFrame, key: str, current: str, cfg: JobConfig) -> DataFrame:
    """Base statistics beside the same entity in three other scopes; null where it stays below the floor there.

    One conditional aggregation stands in for three joins. ``current`` names the current version, '' for none.
    """
    scope, version = F.col("sample_scope"), F.col("version_scope")
    wanted = {
        ALL_RANKER: (scope == ALL_RANKER) & (version == ALL_VERSIONS),
        high_rank_scope(cfg.high_rank): (scope == high_rank_scope(cfg.high_rank)) & (version == ALL_VERSIONS),
        "current_version": (scope == ALL_PLAYERS) & (version == current) & F.lit(current != ""),
    }
    base = (scope == ALL_PLAYERS) & (version == ALL_VERSIONS)
    own = [c for c in stats.columns if c not in (*SCOPE, key)]
    picks = [F.max(F.when(base, F.col(c))).alias(c) for c in own]
    picks += [F.max(F.when(test, F.col(c))).alias(f"{prefix}_{c}") for prefix, test in wanted.items() for c in COMPARED]
    found = stats.groupBy(key).agg(*picks).where(F.col("sample_count").isNotNull())
    return found.withColumn("current_version", F.lit(current))


def version_pivot(stats: DataFrame, key: str, versions: list[str]) -> DataFrame:
    """Base statistics with three columns per version; ``versions`` come from the run counters."""
    scope, version = F.col("sample_scope"), F.col("version_scope")
    base = (scope == ALL_PLAYERS) & (version == ALL_VERSIONS)
    own = [c for c in stats.columns if c not in (*SCOPE, key)]
    picks = [F.max(F.when(base, F.col(c))).alias(c) for c in own]
    picks += [
        F.max(F.when((scope == ALL_PLAYERS) & (version == v), F.col(c))).alias(f"{v}_{c}") for v in versions for c in COMPARED
    ]
    return stats.groupBy(key).agg(*picks).where(F.col("sample_count").isNotNull())
