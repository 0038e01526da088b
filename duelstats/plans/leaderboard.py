"""Jobs: build, publish and read the leaderboards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from duelstats.functions import decks
from duelstats.functions.text import strip
from duelstats.operators import boards, clustering, facts, matchups, samples
from duelstats.operators.ranking import page, ranked
from duelstats.params import PAYLOAD_VERSION, SIMILAR_COST, JobConfig, page_limit, rank_scope_name, row_type_name
from duelstats.plans.analysis import cards_by_cost, labelled
from duelstats.session import cut, read_if_there, remove_folder

KEYS = ["rank_scope", "deck_fingerprint"]
CLUSTER = ["rank_scope", "representative"]


@dataclass(frozen=True)
class Boards:
    """Everything one refresh publishes, all four rank scopes side by side."""

    decks: DataFrame
    cards: DataFrame
    archetypes: DataFrame
    members: DataFrame
    axis: DataFrame
    matrix: DataFrame
    totals: DataFrame


def ranked_decks(counts: DataFrame) -> DataFrame:
    return boards.ranked_board(counts, "deck_fingerprint")


def archetype_members(numbered: DataFrame, card_dim: DataFrame, threshold: float = SIMILAR_COST) -> DataFrame:
    """Clusters of all decks of a board (no floor): (rank_scope, deck, representative) with the decks' counts."""
    members = clustering.memberships(numbered, card_dim, threshold)
    return members.join(numbered.drop("deck_fingerprint"), ["rank_scope", "rank"])


def archetype_board(counts: DataFrame) -> DataFrame:
    return ranked(boards.scored(counts), ["rank_scope"], boards.board_order("representative"))


def shown_cards(matches: DataFrame) -> DataFrame:
    """Cards that merged matches show with their names: (played_at, match_id, side_index, slot, card_hash, raw_name)."""
    sides = matches.select("played_at", F.col("public_id").alias("match_id"), F.explode("players").alias("p"))
    told = F.from_json(F.get_json_object("p.selected", "$.generals"), "array<struct<hash_id:string,raw_name:string>>")
    rows = sides.select("played_at", "match_id", "p.side_index", F.posexplode(told).alias("slot", "g"))
    return rows.select("played_at", "match_id", "side_index", "slot", F.col("g.hash_id").alias("card_hash"), "g.raw_name")


def first_names(side_rows: DataFrame) -> DataFrame:
    """First raw name seen per card, for cards missing from the catalog.

    ``side_rows`` carry (played_at, match_id, side_index, slot, card_hash, raw_name).
    """
    named = side_rows.where((F.coalesce("card_hash", F.lit("")) != "") & (strip(F.coalesce("raw_name", F.lit(""))) != ""))
    first = F.min_by(strip(F.col("raw_name")), F.struct(F.coalesce("played_at", F.lit("")), "match_id", "side_index", "slot"))
    return named.groupBy("card_hash").agg(first.alias("seen_name"))


def with_seen_names(card_dim: DataFrame, seen: DataFrame) -> DataFrame:
    """Catalog plus the cards known only by the name players saw. Such cards cost nothing."""
    extra = seen.join(card_dim.select("card_hash"), "card_hash", "left_anti")
    return card_dim.unionByName(
        extra.select("card_hash", F.col("seen_name").alias("name"), F.lit(0.0).alias("cost")), allowMissingColumns=True
    )


def build(bouts: DataFrame, cfg: JobConfig, card_dim: DataFrame) -> Boards:
    """All boards of one version and window, in two passes over the bouts: their facts and the latest samples."""
    scoped = samples.in_scope(bouts, cfg)
    return build_of(facts.daily(scoped, every_day=False), boards.deck_recent(samples.side_samples(scoped)), cfg, card_dim)


def build_of(counted: DataFrame, recent: DataFrame, cfg: JobConfig, card_dim: DataFrame) -> Boards:
    """All boards out of facts (``operators.facts``, of the window already) and latest samples.

    Decks, cards, archetypes, trends, cells and totals are all added up from the facts; the bouts are not needed any more.
    """
    counted, latest = cut(counted), cut(recent)
    counts = cut(facts.deck_counts(counted))
    facets = cut(facts.facets(counted, cfg.trend_anchor))
    numbered = cut(ranked_decks(counts))
    members = cut(archetype_members(numbered, card_dim, cfg.similar_cost))

    deck_rows = boards.profile(numbered, facets, latest, "deck_fingerprint", cfg.trend_anchor)
    card_rows = boards.ranked_board(boards.card_counts(counts), "card_hash")

    link = members.select(*KEYS, "representative")
    cluster_counts = boards.regrouped(counts, link)
    cluster_facets = cut(boards.regrouped(facets, link, "kind", "name"))
    cluster_latest = boards.regrouped_recent(latest, link)
    clusters = boards.profile(archetype_board(cluster_counts), cluster_facets, cluster_latest, "representative", cfg.trend_anchor)
    axis = cut(matchups.axis(counts))
    return Boards(
        decks=cards_by_cost(deck_rows, card_dim),
        cards=labelled(card_rows, card_dim),
        archetypes=describe(clusters, members, card_dim, cfg.similar_cost),
        members=members,
        axis=axis,
        matrix=matchups.matrix(axis, facts.cells(counted)),
        totals=facts.scope_totals(counted),
    )


def describe(clusters: DataFrame, members: DataFrame, card_dim: DataFrame, threshold: float) -> DataFrame:
    """Add id, title, core cards, size and first members to the cluster rows."""
    core = labelled(clustering.core_cards(members, card_dim, threshold), card_dim)
    named = core.groupBy(*CLUSTER).agg(F.sort_array(F.collect_list(F.struct("place", "card_hash", "label"))).alias("core_cards"))
    first = clustering.first_members(members).groupBy(*CLUSTER).agg(
        F.sort_array(F.collect_list(F.struct("place", "deck_fingerprint", "sample_count", "win_rate"))).alias("member_decks")
    )
    size = members.groupBy(*CLUSTER).agg(F.count(F.lit(1)).alias("member_count"))
    joined = clusters.join(named, CLUSTER, "left").join(first, CLUSTER, "left").join(size, CLUSTER, "left")
    return joined.select(
        "*", decks.archetype_id(F.col("representative")).alias("archetype_id"), decks.archetype_title(F.col("core_cards.label")).alias("title")
    )


PLAIN = ["rank_scope", "rank", "entity", "sample_count", "win_count", "loss_count", "draw_count", "win_rate", "wilson_lower_bound"]


def published_rows(built: Boards) -> DataFrame:
    """The ranked rows of all boards in one table; the payload is the full row as JSON."""
    def flat(df: DataFrame, row_type: str, key: str) -> DataFrame:
        payload = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
        return df.select(
            F.lit(row_type).alias("row_type"), F.lit(row_type == "archetype").alias("cluster_enabled"), *[F.col(key if c == "entity" else c).alias(c) for c in PLAIN], payload.alias("payload")
        )

    rows = flat(built.decks, "deck", "deck_fingerprint")
    return rows.unionByName(flat(built.cards, "card", "card_hash")).unionByName(flat(built.archetypes, "archetype", "representative"))


# States of a run in their order; the log keeps every state, the last one counts.
BUILDING, READY, FAILED, DROPPED = ("building", 0), ("ready", 1), ("failed", 1), ("dropped", 2)
FOLDERS = ("rows", "matrix", "totals")


def publish(built: Boards, cfg: JobConfig, root: str, run_id: int, watermark: int = 0, keep: int = 1) -> None:
    """Write a run below ``root`` and log its states: building before the data, ready after it, failed if it breaks off.

    Readers only see ready runs, so never half of one. Runs that this one supersedes are dropped but for the ``keep`` newest, which
    a reader may still hold; their rows are logged as dropped before their folders go.
    """
    spark: SparkSession = built.decks.sparkSession
    run = lambda df: df.withColumn("run_id", F.lit(run_id).cast("bigint"))
    put = lambda df, name, *by: run(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", *by).parquet(f"{root}/{name}")
    facts = run(spark.range(1)).select(
        "run_id",
        F.lit("public").alias("scope"),
        F.lit(PAYLOAD_VERSION).alias("payload_version"),
        F.lit(cfg.version).alias("target_version"),
        F.lit(cfg.date_from).alias("date_from"),
        F.lit(cfg.date_to).alias("date_to"),
        F.lit(cfg.include_solo).alias("include_solo"),
        F.lit(watermark).cast("bigint").alias("watermark"),
        *[F.lit(None).cast("bigint").alias(c) for c in SIZES],
    )
    _log(facts, root, BUILDING)
    try:
        put(published_rows(built), "rows", "row_type", "rank_scope")
        put(built.matrix, "matrix", "rank_scope")
        put(built.totals, "totals")
    except Exception:
        _log(facts, root, FAILED)
        raise
    count = spark.read.parquet(f"{root}/rows").where(F.col("run_id") == run_id).agg(F.count(F.lit(1)).alias("row_count"))
    totals = spark.read.parquet(f"{root}/totals").where((F.col("run_id") == run_id) & (F.col("rank_scope") == "all"))
    sizes = totals.agg(*[F.max(c).alias(c) for c in SIZES[:2]])  # one row, also where nothing was counted
    _log(facts.drop(*SIZES).join(F.broadcast(sizes)).join(F.broadcast(count)), root, READY)
    prune(spark, root, cfg, run_id, keep)


SIZES = ["match_count", "side_sample_count", "row_count"]


def _log(facts: DataFrame, root: str, state: tuple[str, int]) -> None:
    name, step = state
    facts.withColumns({"status": F.lit(name), "step": F.lit(step)}).coalesce(1).write.mode("append").parquet(f"{root}/runs")


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Every run in its last state."""
    log = spark.read.parquet(f"{root}/runs")
    rest = [c for c in log.columns if c not in ("run_id", "step")]
    return log.groupBy("run_id").agg(F.max_by(F.struct(*rest), F.struct("step", F.coalesce("row_count", F.lit(-1)))).alias("r")).select("run_id", "r.*")


def prune(spark: SparkSession, root: str, cfg: JobConfig, run_id: int, keep: int = 1) -> list[int]:
    """Drop the runs that a ready run supersedes, all but the ``keep`` newest ready ones; returns those it dropped."""
    known = cut(runs(spark, root))
    old = superseded(known.where(F.col("status") != DROPPED[0]), known.where((F.col("run_id") == run_id) & (F.col("status") == READY[0]))).where(F.col("run_id") < run_id)
    held = [r["run_id"] for r in old.where(F.col("status") == READY[0]).orderBy(F.col("run_id").desc()).limit(keep).collect()]
    # a run that is still being built may belong to another job
    gone = old.where(~F.col("status").isin(BUILDING[0]) & ~F.col("run_id").isin(held)).drop("status")
    ids = sorted(r["run_id"] for r in gone.select("run_id").collect())  # one number per run
    if ids:
        _log(gone, root, DROPPED)
        for folder in (f"{root}/{name}/run_id={n}" for n in ids for name in FOLDERS):
            remove_folder(folder)
    return ids


def run_for(known: DataFrame, cfg: JobConfig, watermark: int, version: str = "", status: str = "ready") -> DataFrame:
    """The run a request reads (at most one row): for the configured version the run must match window and watermark,
    for another version the latest one does."""
    wanted = (F.col("scope") == "public") & (F.col("payload_version") == PAYLOAD_VERSION)
    if status:
        wanted = wanted & (F.col("status") == status)
    if version and version != cfg.version:
        wanted = wanted & (F.col("target_version") == version)
    else:
        wanted = (
            wanted
            & (F.col("target_version") == cfg.version)
            & (F.col("date_from") == cfg.date_from)
            & (F.col("date_to") == cfg.date_to)
            & (F.col("include_solo") == cfg.include_solo)
            & (F.col("watermark") == watermark)
        )
    newest = known.where(wanted).agg(F.max_by(F.struct(*known.columns), "run_id").alias("r"))
    return newest.where(F.col("r").isNotNull()).select("r.*")


def superseded(known: DataFrame, keep: DataFrame) -> DataFrame:
    """Other runs over the same version, window and mode setting; their partitions may go."""
    same = ["target_version", "date_from", "date_to", "include_solo"]
    kept = keep.select(*same, F.col("run_id").alias("keep_id"))
    return known.join(F.broadcast(kept), same).where(F.col("run_id") != F.col("keep_id")).drop("keep_id")


def available_versions(known: DataFrame, current: str) -> DataFrame:
    ready = known.where((F.col("scope") == "public") & (F.col("payload_version") == PAYLOAD_VERSION) & (F.col("status") == "ready"))
    one = known.sparkSession.range(1).select(F.lit(current).alias("target_version"))
    names = ready.select(strip(F.col("target_version")).alias("target_version")).unionByName(one)
    return names.where(F.col("target_version") != "").distinct().orderBy(F.col("target_version").desc())


def upload_watermark(uploads: DataFrame) -> DataFrame:
    return uploads.agg(F.coalesce(F.max("upload_id"), F.lit(0)).alias("watermark"))


@dataclass(frozen=True)
class Page:
    status: str
    rows: DataFrame | None
    total: int
    has_more: bool


def read_page(
    spark: SparkSession,
    root: str,
    cfg: JobConfig,
    watermark: int = 0,
    version: str = "",
    row_type: str = "",
    rank_scope: str = "all",
    sort_key: str = "sample",
    offset: int = 0,
    limit: int | None = None,
    archetypes: bool = True,
) -> Page:
    """One page of a published board; ``missing`` when no run fits the request."""
    found = run_for(runs(spark, root), cfg, watermark, version).first()
    if found is None:
        return Page("missing", None, 0, False)
    kind, scope = row_type_name(row_type, archetypes), rank_scope_name(rank_scope)
    rows = spark.read.parquet(f"{root}/rows").where(
        (F.col("run_id") == found["run_id"]) & (F.col("row_type") == kind) & (F.col("rank_scope") == scope)
    )
    total, start, size = rows.count(), max(0, offset), page_limit(limit)
    return Page("ready", page(rows, sort_key, start, size), total, start + size < total)


def reachable_matches(uploads: DataFrame, bridge: DataFrame, users: DataFrame, wanted: Column) -> DataFrame:
    """Matches brought in by the uploads of the wanted users or contributors."""
    mine = uploads.join(users.where(wanted).select("user_id"), "user_id", "left_semi")
    packages = mine.where(F.coalesce("package_id", F.lit("")) != "").select("package_id")
    return bridge.join(packages, "package_id", "left_semi").select("match_id").distinct()


def personal_board(bouts: DataFrame, match_ids: DataFrame, cfg: JobConfig, rank_scope: str = "all") -> DataFrame:
    """Deck board over a subset of matches."""
    mine = samples.in_scope(bouts, cfg).join(match_ids, "match_id", "left_semi")
    counts = boards.deck_counts(samples.side_samples(mine)).where(F.col("rank_scope") == rank_scope_name(rank_scope))
    return boards.ranked_board(counts, "deck_fingerprint")


def remembered(spark: SparkSession, root: str, key: str, compute) -> DataFrame:
    """Persisted result of a request: computed once per key (see ``params.memo_key``), then read."""
    path = f"{root}/{key.replace(':', '_')}"
    if read_if_there(spark, f"{path}/done") is None:  # written after the rows, so that half a result doesn't count
        compute().write.mode("overwrite").parquet(f"{path}/rows")
        spark.range(1).write.mode("overwrite").parquet(f"{path}/done")
    return spark.read.parquet(f"{path}/rows")
