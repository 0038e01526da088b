"""Checkable queries: samples, analysis statistics, reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from duelstats.functions import decks, outcomes, ranks
from duelstats.operators import clustering, samples, stats
from duelstats.plans import analysis as jobs
from duelstats.queries.base import CONTESTS, SCOPED, counts_sql, query, raw_wilson_sql, win_rate_sql, wilson_sql
from duelstats.session import cut
from duelstats.sources import contest_tables as ct

CFG = ct.CONFIG
WINDOW = replace(CFG, date_from="1999-03-01", date_to="2000-10-31")
VERSIONED = replace(CFG, version="V1999")


def _scoped(spark: SparkSession, d: str) -> DataFrame:
    return samples.in_scope(ct.bouts(spark, d), CFG)


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return samples.side_samples(_scoped(spark, d))


def _known(spark: SparkSession, d: str) -> DataFrame:
    return samples.known_samples(_samples(spark, d))


MEASURES_SQL = (
    "round(avg(diff), 6) AS avg_castle_diff, round(avg(own), 6) AS avg_own_castle_rate, "
    "round(avg(dealt), 6) AS avg_castle_damage_dealt, round(avg(taken), 6) AS avg_castle_damage_taken, "
    "round(avg(kill_count), 6) AS avg_kill_count, round(avg(death_count), 6) AS avg_death_count"
)
CRASH_SQL = (
    "CAST(count(*) FILTER (WHERE crash) AS BIGINT) AS castle_crash_count, "
    "CAST(count(*) FILTER (WHERE crashed) AS BIGINT) AS castle_crashed_count"
)
DECK_SQL = (
    SCOPED
    + f""",
deck_all AS (
  SELECT sample_scope, version_scope, deck_fingerprint, {counts_sql()}, {MEASURES_SQL}, {CRASH_SQL}
  FROM scoped GROUP BY 1, 2, 3),
deck_scored AS (SELECT *, {win_rate_sql()} AS win_rate, {wilson_sql()} AS wilson_lower_bound FROM deck_all),
deck_stat AS (SELECT * FROM deck_scored WHERE sample_count >= 3)"""
)
CARD_SQL = (
    DECK_SQL
    + f""",
card_all AS (
  SELECT sample_scope, version_scope, card_hash, {counts_sql()}, {MEASURES_SQL}
  FROM (SELECT *, unnest(list_distinct(string_split(deck_fingerprint, ','))) AS card_hash FROM scoped) GROUP BY 1, 2, 3),
winner AS (
  SELECT sample_scope, version_scope, unnest(list_distinct(string_split(deck_fingerprint, ','))) AS card_hash
  FROM deck_stat WHERE win_count + loss_count > 0 AND CAST(win_count AS DOUBLE) / (win_count + loss_count) >= 0.55::DOUBLE),
won AS (SELECT sample_scope, version_scope, card_hash, count(*) AS high_win_deck_count FROM winner GROUP BY 1, 2, 3),
card_scored AS (
  SELECT c.*, {win_rate_sql()} AS win_rate, {wilson_sql()} AS wilson_lower_bound,
         CAST(coalesce(high_win_deck_count, 0) AS BIGINT) AS high_win_deck_count
  FROM card_all c LEFT JOIN won USING (sample_scope, version_scope, card_hash)),
card_stat AS (SELECT * FROM card_scored WHERE sample_count >= 10)"""
)


@query(
    "rank_decks",
    CONTESTS
    + f""", d AS (SELECT deck_fingerprint, {counts_sql()} FROM known GROUP BY 1)
SELECT *, {win_rate_sql()} AS win_rate, {wilson_sql()} AS wilson_lower_bound FROM d WHERE sample_count >= 3""",
)
def rank_decks(spark, d):
    base = stats.base_stats(stats.deck_stats(_known(spark, d), CFG))
    shown = base.select("deck_fingerprint", *stats.COUNTS, "win_rate", "wilson_lower_bound")
    return shown.orderBy(*stats.base_order("deck_fingerprint"))


SAMPLE_SQL = """SELECT match_id, side_index, mode, version, played_at, result, board_result, player_name, rank, rank_order,
  deck_fingerprint, own AS own_castle_rate, opp AS opponent_castle_rate, diff AS castle_diff, dealt AS castle_damage_dealt,
  taken AS castle_damage_taken, crash AS castle_crash, crashed AS castle_crashed, kill_count, death_count, weapon, style"""


@query("rs1_side_samples", CONTESTS + SAMPLE_SQL + " FROM sample")
def rs1(spark, d):
    return _samples(spark, d).drop("cards", "souls")


@query(
    "src3_match_store",
    CONTESTS
    + """SELECT h.match_id, played_at, mode, version, match_result AS result, s.side_index, s.player_name, s.own_result AS side_result,
  coalesce(s.fp, '') AS deck_fingerprint, CAST(count(*) OVER (PARTITION BY h.match_id) AS INT) AS side_count
FROM header h JOIN side s USING (match_id)""",
)
def src3(spark, d):
    rows = ct.bouts(spark, d).select("match_id", "played_at", "mode", "version", "result", F.size("sides").alias("side_count"), F.explode("sides").alias("s"))
    return rows.select(
        "match_id", "played_at", "mode", "version", "result", "s.side_index", "s.player_name", F.col("s.result").alias("side_result"),
        F.coalesce("s.deck_fingerprint", F.lit("")).alias("deck_fingerprint"), "side_count",
    )


@query(
    "src4_side_rows",
    CONTESTS
    + """SELECT match_id, side_index, played_at, mode, player_name, deck_fingerprint, weapon, style, rank_order, board_result AS result
FROM raw_sample WHERE version = 'V1999' AND substr(played_at, 1, 10) BETWEEN '1999-03-01' AND '2000-10-31'""",
)
def src4(spark, d):
    cfg = replace(WINDOW, version="V1999", include_solo=True)
    rows = samples.side_samples(samples.in_scope(ct.bouts(spark, d), cfg))
    names = ["match_id", "side_index", "played_at", "mode", "player_name", "deck_fingerprint", "weapon", "style", "rank_order"]
    return rows.select(*names, F.col("board_result").alias("result"))


@query("flt1_modes", CONTESTS + "SELECT mode, count(*) AS matches FROM header WHERE mode <> '5-LOW' GROUP BY 1")
def flt1(spark, d):
    return ct.bouts(spark, d).where(samples.regular_mode(F.col("mode"), CFG)).groupBy("mode").agg(F.count(F.lit(1)).alias("matches"))


@query(
    "flt2_window",
    CONTESTS + "SELECT match_id, played_at FROM header WHERE substr(played_at, 1, 10) BETWEEN '1999-03-01' AND '2000-10-31'",
)
def flt2(spark, d):
    return ct.bouts(spark, d).where(samples.in_window(F.col("played_at"), WINDOW)).select("match_id", "played_at")


@query("flt3_version", CONTESTS + "SELECT match_id, version, mode FROM header WHERE version = 'V1999' AND mode <> '5-LOW'")
def flt3(spark, d):
    return samples.in_scope(ct.bouts(spark, d), VERSIONED).select("match_id", "version", "mode")


@query("flt4_known_results", CONTESTS + "SELECT result, count(*) AS samples FROM known GROUP BY 1")
def flt4(spark, d):
    return _known(spark, d).groupBy("result").agg(F.count(F.lit(1)).alias("samples"))


@query("flt5_floors", DECK_SQL + "SELECT sample_scope, version_scope, count(*) AS decks FROM deck_stat GROUP BY 1, 2")
def flt5(spark, d):
    return stats.deck_stats(_known(spark, d), CFG).groupBy(*stats.SCOPE).agg(F.count(F.lit(1)).alias("decks"))


@query(
    "flt9_complete_matches",
    CONTESTS
    + """SELECT 'R' || h.match_id AS replay_id FROM header h JOIN side s USING (match_id) WHERE match_result <> 'unknown'
GROUP BY h.match_id HAVING count(s.fp) = count(*) AND h.match_id % 4 <> 0""",
)
def flt9(spark, d):
    from duelstats.operators.merge import complete_detail

    # every fourth match was told without any profile
    blank = F.substring("replay_id", 2, 20).cast("bigint") % 4 == 0
    told = F.transform("players", lambda p: p.withField("profile", F.when(blank, F.lit("{}")).otherwise(p["profile"])))
    return ct.matches(spark, d).withColumn("players", told).where(complete_detail()).select("replay_id")


@query(
    "flt12_share_scope",
    CONTESTS
    + """SELECT match_id, played_at FROM header WHERE mode <> '5-LOW' AND version = 'V1999'
  AND substr(played_at, 1, 10) BETWEEN '1999-03-01' AND '1999-09-30'""",
)
def flt12(spark, d):
    cfg = replace(CFG, version="V1999", date_from="1999-03-01", date_to="1999-09-30")
    return samples.in_scope(ct.bouts(spark, d), cfg, version_required=True).select("match_id", "played_at")


@query(
    "rs2_analysis_scopes",
    SCOPED + "SELECT sample_scope, version_scope, count(*) AS samples, count(DISTINCT deck_fingerprint) AS decks FROM scoped GROUP BY 1, 2",
)
def rs2(spark, d):
    sums = samples.analysis_scopes(stats.deck_sums(_known(spark, d), CFG), CFG)
    per_deck = sums.groupBy(*stats.SCOPE, "deck_fingerprint").agg(F.sum("sample_count").alias("n"))
    return per_deck.groupBy(*stats.SCOPE).agg(F.sum("n").alias("samples"), F.count(F.lit(1)).alias("decks"))


@query(
    "rs3_side_cards",
    CONTESTS
    + """SELECT match_id, side_index, unnest(list_distinct(string_split(deck_fingerprint, ','))) AS card_hash FROM sample""",
)
def rs3(spark, d):
    return _samples(spark, d).select("match_id", "side_index", F.explode(decks.distinct_cards(F.col("cards"))).alias("card_hash"))


@query("ag1_deck_stats", DECK_SQL + "SELECT * FROM deck_stat")
def ag1(spark, d):
    return stats.deck_stats(_known(spark, d), CFG)


@query("ag2_card_stats", CARD_SQL + "SELECT * EXCLUDE (high_win_deck_count) FROM card_stat")
def ag2(spark, d):
    return stats.scoped_card_stats(_known(spark, d), CFG).where(F.col("sample_count") >= CFG.card_floor)


@query("ag3_high_win_decks", CARD_SQL + "SELECT sample_scope, version_scope, card_hash, high_win_deck_count FROM card_stat")
def ag3(spark, d):
    return stats.card_stats(_known(spark, d), CFG).select(*stats.SCOPE, "card_hash", "high_win_deck_count")


COUNTERS_SQL = (
    CARD_SQL
    + """,
scoped_header AS (SELECT * FROM header WHERE mode <> '5-LOW'),
counter AS (
SELECT 'matches' AS metric, CAST(count(*) AS VARCHAR) AS value FROM scoped_header
UNION ALL SELECT 'current_version', arg_max(version, (played_at, match_id)) FROM scoped_header
UNION ALL SELECT 'side_samples', CAST(count(*) AS VARCHAR) FROM known
UNION ALL SELECT 'raw_side_samples', CAST(count(*) AS VARCHAR) FROM sample
UNION ALL SELECT 'unknown_result_side_samples', CAST(count(*) AS VARCHAR) FROM sample WHERE result = 'unknown'
UNION ALL SELECT 'deck_groups', CAST(count(*) AS VARCHAR) FROM deck_all WHERE sample_scope = 'all_players' AND version_scope = 'all_versions'
UNION ALL SELECT 'deck_groups_exported', CAST(count(*) AS VARCHAR) FROM deck_stat WHERE sample_scope = 'all_players' AND version_scope = 'all_versions'
UNION ALL SELECT 'scoped_deck_groups', CAST(count(*) AS VARCHAR) FROM deck_all
UNION ALL SELECT 'card_groups', CAST(count(*) AS VARCHAR) FROM card_all WHERE sample_scope = 'all_players' AND version_scope = 'all_versions'
UNION ALL SELECT 'card_groups_exported', CAST(count(*) AS VARCHAR) FROM card_stat WHERE sample_scope = 'all_players' AND version_scope = 'all_versions'
UNION ALL SELECT 'scoped_card_groups', CAST(count(*) AS VARCHAR) FROM card_all
UNION ALL SELECT 'mode_counts.' || mode, CAST(count(*) AS VARCHAR) FROM scoped_header GROUP BY mode
UNION ALL SELECT 'version_counts.' || version, CAST(count(*) AS VARCHAR) FROM scoped_header GROUP BY version
UNION ALL SELECT 'result_counts.' || result, CAST(count(*) AS VARCHAR) FROM known GROUP BY result
UNION ALL SELECT 'sample_scope_counts.' || sample_scope, CAST(count(*) AS VARCHAR) FROM scoped WHERE version_scope = 'all_versions' GROUP BY sample_scope)"""
)


@query("ag4_run_counters", COUNTERS_SQL + "SELECT * FROM counter")
def ag4(spark, d):
    bouts = cut(_scoped(spark, d))  # every counter reads them
    return stats.counters(bouts, samples.side_samples(bouts), CFG)


@query(
    "rs6_overview",
    COUNTERS_SQL
    + """SELECT * FROM counter UNION ALL SELECT 'run_id', '7' UNION ALL SELECT 'date_from', '0000-00-00'
UNION ALL SELECT 'date_to', '9999-99-99'""",
)
def rs6(spark, d):
    bouts = cut(_scoped(spark, d))
    return jobs.overview(7, CFG, stats.counters(bouts, samples.side_samples(bouts), CFG))


@query("ag5_scope_counts", SCOPED + "SELECT sample_scope, count(*) AS sample_count FROM scoped WHERE version_scope = 'all_versions' GROUP BY 1")
def ag5(spark, d):
    return stats.scope_counts(_known(spark, d), CFG)


@query("ag6_current_version", CONTESTS + "SELECT arg_max(version, (played_at, match_id)) AS current_version FROM header WHERE mode <> '5-LOW'")
def ag6(spark, d):
    return stats.current_version(_scoped(spark, d))


def _comparison_sql(table: str, key: str, own: str) -> str:
    parts = {
        "all_ranker": "sample_scope = 'all_ranker' AND version_scope = 'all_versions'",
        "high_ranker_top100": "sample_scope = 'high_ranker_top100' AND version_scope = 'all_versions'",
        "current_version": "sample_scope = 'all_players' AND version_scope = (SELECT v FROM cur)",
    }
    joins = " ".join(f"LEFT JOIN (SELECT * FROM {table} WHERE {test}) {p} USING ({key})" for p, test in parts.items())
    columns = ", ".join(f"{p}.{c} AS {p}_{c}" for p in parts for c in stats.COMPARED)
    return f""", cur AS (SELECT arg_max(version, (played_at, match_id)) AS v FROM header WHERE mode <> '5-LOW')
SELECT b.* EXCLUDE (sample_scope, version_scope), (SELECT v FROM cur) AS current_version, {columns}
FROM (SELECT * FROM {table} WHERE sample_scope = 'all_players' AND version_scope = 'all_versions') b {joins}"""


@query("jn4_deck_report", DECK_SQL + _comparison_sql("deck_stat", "deck_fingerprint", ""))
def jn4(spark, d):
    bouts = _scoped(spark, d)
    rows = stats.deck_stats(samples.known_samples(samples.side_samples(bouts)), CFG)
    return stats.with_comparisons(rows, "deck_fingerprint", stats.current_version(bouts).first()["current_version"], CFG)


@query("jn4_card_report", CARD_SQL + _comparison_sql("card_stat", "card_hash", ""))
def jn4_cards(spark, d):
    bouts = _scoped(spark, d)
    rows = stats.card_stats(samples.known_samples(samples.side_samples(bouts)), CFG)
    return stats.with_comparisons(rows, "card_hash", stats.current_version(bouts).first()["current_version"], CFG)


VERSIONS = [f"V{y}" for y in range(1995, 2002)]


def _pivot_sql(table: str, key: str) -> str:
    columns = ", ".join(
        f"max(CASE WHEN sample_scope = 'all_players' AND version_scope = '{v}' THEN {c} END) AS \"{v}_{c}\"" for v in VERSIONS for c in stats.COMPARED
    )
    return f""", p AS (SELECT {key}, {columns} FROM {table} GROUP BY 1)
SELECT b.* EXCLUDE (sample_scope, version_scope), p.* EXCLUDE ({key})
FROM (SELECT * FROM {table} WHERE sample_scope = 'all_players' AND version_scope = 'all_versions') b JOIN p USING ({key})"""


@query("rs4_deck_versions", DECK_SQL + _pivot_sql("deck_stat", "deck_fingerprint"))
def rs4(spark, d):
    bouts = _scoped(spark, d)
    rows = stats.deck_stats(samples.known_samples(samples.side_samples(bouts)), CFG)
    return stats.version_pivot(rows, "deck_fingerprint", jobs.versions_of(bouts))


@query("rs4_card_versions", CARD_SQL + _pivot_sql("card_stat", "card_hash"))
def rs4_cards(spark, d):
    bouts = _scoped(spark, d)
    rows = stats.card_stats(samples.known_samples(samples.side_samples(bouts)), CFG)
    return stats.version_pivot(rows, "card_hash", jobs.versions_of(bouts))


@query(
    "srt1_report_order",
    DECK_SQL
    + f"""SELECT deck_fingerprint, row_number() OVER (ORDER BY coalesce({raw_wilson_sql()}, 0) DESC, sample_count DESC, deck_fingerprint) AS rank
FROM deck_stat WHERE sample_scope = 'all_players' AND version_scope = 'all_versions'""",
)
def srt1(spark, d):
    from duelstats.operators.ranking import ranked

    base = stats.base_stats(stats.deck_stats(_known(spark, d), CFG)).withColumn("board", F.lit("report"))
    return ranked(base, ["board"], stats.base_order("deck_fingerprint")).select("deck_fingerprint", "rank")


@query(
    "srt9_top_decks",
    DECK_SQL
    + f"""SELECT deck_fingerprint, sample_count, wilson_lower_bound FROM deck_stat
WHERE sample_scope = 'all_players' AND version_scope = 'all_versions'
ORDER BY coalesce({raw_wilson_sql()}, 0) DESC, sample_count DESC, deck_fingerprint LIMIT 30""",
)
def srt9(spark, d):
    base = stats.base_stats(stats.deck_stats(_known(spark, d), CFG))
    return jobs.top_decks(base).select("deck_fingerprint", "sample_count", "wilson_lower_bound")


CLUSTER_SQL = """,
ranked_deck AS MATERIALIZED (
  SELECT b.*, row_number() OVER (ORDER BY coalesce({wilson}, 0) DESC, sample_count DESC, {ties}) AS r FROM {base} b),
deck_card AS (
  SELECT r, cost.card, cost FROM (SELECT r, unnest(list_distinct(string_split(deck_fingerprint, ','))) AS card FROM ranked_deck) x JOIN cost USING (card)),
edge AS MATERIALIZED (SELECT a.r AS rb, b.r AS ra FROM deck_card a JOIN deck_card b ON a.card = b.card AND b.r < a.r GROUP BY 1, 2 HAVING sum(a.cost) >= 5.0),
near AS MATERIALIZED (SELECT rb, list(ra ORDER BY ra) AS near_ranks FROM edge GROUP BY 1),
deck_number AS MATERIALIZED (SELECT max(r) AS n FROM ranked_deck),
walk AS (
  SELECT 0::BIGINT AS r, []::BIGINT[] AS reps, NULL::BIGINT AS leader
  UNION ALL
  SELECT w.r + 1, CASE WHEN hit IS NULL THEN list_append(reps, w.r + 1) ELSE reps END, coalesce(hit, w.r + 1)
  FROM walk w LEFT JOIN near n ON n.rb = w.r + 1, LATERAL (SELECT list_min(list_intersect(n.near_ranks, w.reps)) AS hit)
  WHERE w.r < (SELECT n FROM deck_number)),
member AS MATERIALIZED (SELECT d.*, leader FROM walk JOIN ranked_deck d USING (r))"""
REPORT_CLUSTER_SQL = (
    DECK_SQL.replace("WITH line", "WITH RECURSIVE line")
    + ",\nbase AS (SELECT * FROM deck_stat WHERE sample_scope = 'all_players' AND version_scope = 'all_versions')"
    + CLUSTER_SQL.format(wilson=raw_wilson_sql(), ties="deck_fingerprint", base="base")
)


def _clusters(spark, d):
    base = stats.base_stats(stats.deck_stats(_known(spark, d), CFG))
    return clustering.analysis_archetypes(base, ct.card_dim(spark))


@query("gr1_archetypes", REPORT_CLUSTER_SQL + "SELECT r AS rank, leader, deck_fingerprint FROM member")
def gr1(spark, d):
    return _clusters(spark, d)[0].select("rank", "leader", "deck_fingerprint")


ROLLUP_SQL = f"""SELECT arg_min(deck_fingerprint, r) AS representative, count(*) AS member_count,
  CAST(sum(sample_count) AS BIGINT) AS sample_count, CAST(sum(win_count) AS BIGINT) AS win_count,
  CAST(sum(loss_count) AS BIGINT) AS loss_count, CAST(sum(draw_count) AS BIGINT) AS draw_count,
  CAST(sum(castle_crash_count) AS BIGINT) AS castle_crash_count, CAST(sum(castle_crashed_count) AS BIGINT) AS castle_crashed_count,
  round(sum(avg_castle_diff * sample_count) / sum(CASE WHEN avg_castle_diff IS NOT NULL THEN sample_count END), 4) AS avg_castle_diff,
  {win_rate_sql('sum(win_count)', 'sum(loss_count)')} AS win_rate
FROM member GROUP BY leader"""


@query("ag15_archetype_rollup", REPORT_CLUSTER_SQL + ROLLUP_SQL)
def ag15(spark, d):
    summary = _clusters(spark, d)[1].drop("board", "wilson_lower_bound")
    return summary.withColumn("avg_castle_diff", F.round("avg_castle_diff", 4))


@query(
    "ag16_archetype_scopes",
    REPORT_CLUSTER_SQL
    + """SELECT leader, sample_scope, version_scope, count(*) AS member_count, CAST(sum(s.sample_count) AS BIGINT) AS sample_count,
  CAST(sum(s.win_count) AS BIGINT) AS win_count, CAST(sum(s.loss_count) AS BIGINT) AS loss_count
FROM (SELECT deck_fingerprint, leader FROM member) m JOIN deck_stat s USING (deck_fingerprint) GROUP BY 1, 2, 3""",
)
def ag16(spark, d):
    rows = cut(stats.deck_stats(_known(spark, d), CFG))  # clustered, then summed by cluster
    members, _ = clustering.analysis_archetypes(stats.base_stats(rows), ct.card_dim(spark))
    scoped = jobs.archetype_scopes(members, rows)
    return scoped.select("leader", *stats.SCOPE, "member_count", "sample_count", "win_count", "loss_count")


CORE_SQL = """,
slot AS (
  SELECT leader, r, sample_count, unnest(string_split(deck_fingerprint, ',')) AS card,
         generate_subscripts(string_split(deck_fingerprint, ','), 1) AS pos FROM member),
weight AS (SELECT leader, card, sum(sample_count) AS weight, min((r, pos)) AS seen FROM slot GROUP BY 1, 2),
placed AS (
  SELECT w.*, cost, row_number() OVER (PARTITION BY leader ORDER BY weight DESC, cost DESC, seen) AS place
  FROM weight w JOIN cost USING (card)),
core AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY leader ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM placed)
"""


@query(
    "wn4_core_cards",
    REPORT_CLUSTER_SQL
    + CORE_SQL
    + """SELECT (SELECT deck_fingerprint FROM ranked_deck q WHERE q.r = leader) AS representative, CAST(place AS INT) AS place,
  card AS card_hash, CAST(weight AS BIGINT) AS weight, cost FROM core WHERE place <= 5 AND spent < 5.0""",
)
def wn4(spark, d):
    members, _ = _clusters(spark, d)
    return clustering.core_cards(members, ct.card_dim(spark), board="board").drop("board")


@query(
    "srt5_archetype_report",
    REPORT_CLUSTER_SQL
    + f""", rolled AS ({ROLLUP_SQL})
SELECT *, {wilson_sql()} AS wilson_lower_bound FROM rolled
ORDER BY coalesce({raw_wilson_sql()}, 0) DESC, sample_count DESC, representative DESC LIMIT 30""",
)
def srt5(spark, d):
    summary = jobs.top_archetypes(_clusters(spark, d)[1]).drop("board")
    return summary.withColumn("avg_castle_diff", F.round("avg_castle_diff", 4))


@query(
    "jn9_similar_decks",
    DECK_SQL.replace("WITH line", "WITH RECURSIVE line")
    + ",\nbase AS (SELECT * FROM deck_stat WHERE sample_scope = 'all_players' AND version_scope = 'all_versions')"
    + CLUSTER_SQL.format(wilson=raw_wilson_sql(), ties="deck_fingerprint", base="base")
    + """SELECT rb AS rank, CAST(min(ra) AS BIGINT) AS first_similar FROM edge GROUP BY 1""",
)
def jn9(spark, d):
    from duelstats.operators.ranking import ranked

    base = stats.base_stats(stats.deck_stats(_known(spark, d), CFG)).withColumn("board", F.lit("report"))
    numbered = ranked(base, ["board"], stats.base_order("deck_fingerprint"))
    return clustering.first_similar(numbered, ct.card_dim(spark), board="board").drop("board")


@query(
    "srt6_cards_by_cost",
    CONTESTS
    + """SELECT DISTINCT deck_fingerprint, (SELECT string_agg(card, ',' ORDER BY cost DESC, card) FROM
  (SELECT unnest(string_split(deck_fingerprint, ',')) AS card) JOIN cost USING (card)) AS by_cost FROM sample""",
)
def srt6(spark, d):
    fps = _samples(spark, d).select("deck_fingerprint").distinct()
    return jobs.cards_by_cost(fps, ct.card_dim(spark)).select("deck_fingerprint", F.array_join("cards_by_cost", ",").alias("by_cost"))


@query(
    "jn5_card_labels",
    CARD_SQL
    + """SELECT s.card_hash, s.sample_count, cost, s.card_hash || '(' || cost || ')' AS label
FROM card_stat s JOIN cost ON cost.card = s.card_hash WHERE sample_scope = 'all_players' AND version_scope = 'all_versions'""",
)
def jn5(spark, d):
    dim = ct.card_dim(spark).withColumn("cost_label", F.col("cost").cast("string"))
    rows = stats.base_stats(stats.card_stats(_known(spark, d), CFG)).select("card_hash", "sample_count")
    return jobs.labelled(rows, dim).select("card_hash", "sample_count", "cost", "label")


@query(
    "job1_analysis_refresh",
    CARD_SQL
    + """SELECT 'deck' AS row_type, sample_scope, version_scope, deck_fingerprint AS entity, sample_count, wilson_lower_bound, avg_kill_count FROM deck_stat
UNION ALL SELECT 'card', sample_scope, version_scope, card_hash, sample_count, wilson_lower_bound, avg_kill_count FROM card_stat""",
)
def job1(spark, d):
    run = jobs.refresh(ct.bouts(spark, d), CFG)
    names = [*stats.SCOPE, "entity", "sample_count", "wilson_lower_bound", "avg_kill_count"]
    deck_rows = run.decks.withColumnRenamed("deck_fingerprint", "entity").select(F.lit("deck").alias("row_type"), *names)
    return deck_rows.unionByName(run.cards.withColumnRenamed("card_hash", "entity").select(F.lit("card").alias("row_type"), *names))


@query(
    "fn8_side_results",
    CONTESTS + "SELECT side_index, result, board_result, count(*) AS samples FROM raw_sample GROUP BY 1, 2, 3",
)
def fn8(spark, d):
    rows = samples.side_samples(ct.bouts(spark, d))
    return rows.groupBy("side_index", "result", "board_result").agg(F.count(F.lit(1)).alias("samples"))


@query(
    "fn11_wilson",
    DECK_SQL + f"SELECT sample_scope, version_scope, deck_fingerprint, {wilson_sql()} AS lower_bound FROM deck_all",
)
def fn11(spark, d):
    rows = stats.scoped_deck_stats(_known(spark, d), CFG)
    return rows.select(*stats.SCOPE, "deck_fingerprint", outcomes.wilson(F.col("win_count"), F.col("loss_count")).alias("lower_bound"))


@query(
    "fn5_castle_damage",
    CONTESTS + "SELECT match_id, player_total, enemy_total FROM header LEFT JOIN castle USING (match_id)",
)
def fn5(spark, d):
    rows = F.col("castle_rows")
    return ct.bouts(spark, d).select(
        "match_id", outcomes.rate_total(rows, "player").alias("player_total"), outcomes.rate_total(rows, "enemy").alias("enemy_total")
    )


@query(
    "fn14_rank_scopes",
    CONTESTS
    + """SELECT match_id, side_index, 'all' || CASE WHEN rank_order <= 20 THEN ',traveler_down' ELSE '' END ||
  CASE WHEN rank_order <= 50 THEN ',knight_down' ELSE '' END || CASE WHEN rank_order >= 50 THEN ',knight_up' ELSE '' END AS scopes
FROM raw_sample""",
)
def fn14(spark, d):
    rows = samples.side_samples(ct.bouts(spark, d))
    scopes = ranks.scopes_of_order_class(ranks.order_class(F.col("rank_order")))
    return rows.select("match_id", "side_index", F.array_join(scopes, ",").alias("scopes"))
