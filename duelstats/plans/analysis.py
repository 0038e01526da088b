"""Jobs: refresh the analysis, build its report frames, write a run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from duelstats.functions import decks
from duelstats.operators import clustering, samples, stats
from duelstats.params import REPORT_LIMIT, JobConfig


@dataclass(frozen=True)
class AnalysisRun:
    """Lazy frames of one refresh: floor-filtered statistics in all scopes, and the counters."""

    decks: DataFrame
    cards: DataFrame
    counters: DataFrame
    current: DataFrame
    bouts: DataFrame
    config: JobConfig


def refresh(bouts: DataFrame, cfg: JobConfig) -> AnalysisRun:
    scoped = samples.in_scope(bouts, cfg)
    rows = samples.side_samples(scoped)
    known = samples.known_samples(rows)
    return AnalysisRun(
        decks=stats.deck_stats(known, cfg),
        cards=stats.card_stats(known, cfg),
        counters=stats.counters(scoped, rows, cfg),
        current=stats.current_version(scoped),
        bouts=scoped,
        config=cfg,
    )


def versions_of(bouts: DataFrame) -> list[str]:
    """Versions a pivot needs as columns; a handful by nature."""
    named = bouts.where(F.coalesce("version", F.lit("")) != "")
    return [r["version"] for r in named.select("version").distinct().orderBy("version").collect()]


def overview(run_id: int, cfg: JobConfig, counters: DataFrame) -> DataFrame:
    """Run facts and counters as (metric, value) rows."""
    facts = {"run_id": str(run_id), "date_from": cfg.date_from, "date_to": cfg.date_to}
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(v).alias("value")) for k, v in facts.items()])
    one = counters.sparkSession.range(1).select(F.explode(pairs).alias("p")).select("p.*")
    return one.unionByName(counters)


def labelled(rows: DataFrame, card_dim: DataFrame, card: str = "card_hash") -> DataFrame:
    """Add cost and label of a card; unknown cards keep a label made of their hash."""
    column = lambda name: F.col(name) if name in card_dim.columns else F.lit(None).cast("string")
    label = decks.card_label(column("name"), column("card_code"), F.col("card_hash"), column("cost_label"), column("unit_type"))
    dim = card_dim.select(F.col("card_hash").alias("_card"), "cost", label.alias("_label"))
    rows = rows.drop("cost")
    joined = rows.join(dim, F.col(card) == F.col("_card"), "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in rows.columns], F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("_label", decks.unknown_label(F.col(card))).alias("label")
    )


def cards_by_cost(rows: DataFrame, card_dim: DataFrame) -> DataFrame:
    """Cards and labels of each deck, dearest first and otherwise in deck order, joined to ``rows`` by fingerprint."""
    fps = rows.select("deck_fingerprint").distinct()
    slots = fps.select("deck_fingerprint", F.posexplode(decks.cards_of(F.col("deck_fingerprint"))).alias("pos", "card_hash"))
    priced = labelled(slots, card_dim)
    ordered = priced.groupBy("deck_fingerprint").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("cost")).alias("minus"), "pos", "card_hash", "label"))).alias("o")
    )
    return rows.join(
        ordered.select("deck_fingerprint", F.col("o.card_hash").alias("cards_by_cost"), F.array_join("o.label", " / ").alias("deck_name")),
        "deck_fingerprint",
        "left",
    )


def top_decks(base: DataFrame, limit: int = REPORT_LIMIT) -> DataFrame:
    return base.orderBy(*stats.base_order("deck_fingerprint")).limit(limit)


def top_archetypes(summary: DataFrame, limit: int = REPORT_LIMIT) -> DataFrame:
    score = F.coalesce("wilson_lower_bound", F.lit(0.0))
    return summary.orderBy(score.desc(), F.col("sample_count").desc(), F.col("representative").desc()).limit(limit)


def archetype_scopes(members: DataFrame, deck_stats: DataFrame) -> DataFrame:
    """The members' statistics in every scope, rolled up per cluster; absent where no member reaches the floor."""
    scoped = members.select("deck_fingerprint", "leader", "representative").join(deck_stats, "deck_fingerprint")
    return clustering.rollup(scoped, "leader", "representative", *stats.SCOPE)


def reports(run: AnalysisRun, card_dim: DataFrame, run_id: int) -> dict[str, DataFrame]:
    """All report tables of a run by name."""
    versions = versions_of(run.bouts)
    current = run.current.first()["current_version"]
    deck_cards = lambda df: cards_by_cost(df, card_dim)
    score = [F.coalesce("wilson_lower_bound", F.lit(0.0)).desc(), F.col("sample_count").desc()]
    ordered = lambda df, key: df.orderBy(*score, F.col(key).asc())
    return {
        "overview": overview(run_id, run.config, run.counters),
        "deck": ordered(deck_cards(stats.with_comparisons(run.decks, "deck_fingerprint", current, run.config)), "deck_fingerprint"),
        "card": ordered(labelled(stats.with_comparisons(run.cards, "card_hash", current, run.config), card_dim), "card_hash"),
        "deck-version": ordered(deck_cards(stats.version_pivot(run.decks, "deck_fingerprint", versions)), "deck_fingerprint"),
        "card-version": ordered(labelled(stats.version_pivot(run.cards, "card_hash", versions), card_dim), "card_hash"),
        "deck-top": deck_cards(top_decks(stats.base_stats(run.decks))),
    }


def archetype_report(run: AnalysisRun, card_dim: DataFrame) -> DataFrame:
    """Top clusters with title, core cards and their figures in the comparison scopes' tables."""
    members, summary = clustering.analysis_archetypes(stats.base_stats(run.decks), card_dim, run.config.similar_cost)
    core = labelled(clustering.core_cards(members, card_dim, run.config.similar_cost, "board"), card_dim)
    named = core.groupBy("representative").agg(F.sort_array(F.collect_list(F.struct("place", "card_hash", "label"))).alias("core"))
    titled = top_archetypes(summary).join(named, "representative", "left")
    return titled.select(
        "*", decks.archetype_id(F.col("representative")).alias("archetype_id"), decks.archetype_title(F.col("core.label")).alias("title")
    )


def write_run(run: AnalysisRun, root: str, run_id: int) -> None:
    """Write the statistics as partitions of a run; the registry row comes last and marks the run complete.

    Writing the same run again replaces its partitions.
    """
    spark: SparkSession = run.decks.sparkSession
    for name, df in (("deck_stats", run.decks), ("card_stats", run.cards), ("counters", run.counters)):
        out = df.withColumn("run_id", F.lit(run_id).cast("bigint"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/{name}")
    cfg = run.config
    row = [(run_id, "completed", cfg.date_from, cfg.date_to, cfg.version, cfg.deck_floor, cfg.card_floor, cfg.high_rank)]
    schema = "run_id bigint, status string, date_from string, date_to string, version string, deck_floor int, card_floor int, high_rank int"
    done = spark.createDataFrame(row, schema)
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/runs")
