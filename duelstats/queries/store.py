"""Checkable queries: entity resolution, merging, packages, exports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from duelstats.functions import text
from duelstats.operators import merge, samples, stats
from duelstats.plans import leaderboard, store as jobs
from duelstats.queries.analysis import DECK_SQL
from duelstats.queries.base import CONTESTS, RESULT, query
from duelstats.session import cut, release, scratch_path
from duelstats.sources import contest_tables as ct, packages

CFG = ct.CONFIG
PUBLIC_ID = """CASE WHEN replay_id <> '' THEN 'r:' || replay_id WHEN follow_id <> '' AND detail_t <> '' THEN 'd:' || follow_id || ':' || detail_t END"""
SIGHT_SQL = f"""
WITH RECURSIVE s0 AS (
  SELECT o_orderkey AS k, o_orderkey % 5 = 0 AS light, CASE WHEN o_orderkey % 3 <> 0 THEN 'R' || (o_orderkey // 2) ELSE '' END AS replay_id,
    'F' || (o_custkey % 40) AS follow_id, CASE WHEN o_orderkey % 4 <> 1 THEN CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) ELSE '' END AS detail_t,
    CASE WHEN o_orderkey % 4 <> 1 THEN strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS played_at,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS mode, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'V' || year(o_orderdate) END AS version,
    CASE WHEN o_totalprice < 20000 THEN 'unknown' ELSE {RESULT} END AS result, 'P' || o_custkey AS player_name FROM orders),
sight AS MATERIALIZED (
  SELECT *, CASE WHEN replay_id <> '' THEN 'r:' || replay_id END AS ra, CASE WHEN detail_t <> '' THEN 'd:' || follow_id || ':' || detail_t END AS da,
    CASE WHEN detail_t <> '' THEN 'https://site.example/members/history/detail?f=' || follow_id || '&t=' || detail_t ELSE '' END AS detail_url FROM s0),
link AS MATERIALIZED (
  SELECT DISTINCT ra AS a, da AS b FROM sight WHERE ra IS NOT NULL AND da IS NOT NULL
  UNION SELECT DISTINCT da, ra FROM sight WHERE ra IS NOT NULL AND da IS NOT NULL),
reach(node, label) AS (SELECT a, a FROM link UNION SELECT link.b, reach.label FROM reach JOIN link ON link.a = reach.node),
comp AS MATERIALIZED (SELECT node, min(label) AS label FROM reach GROUP BY 1),
res AS MATERIALIZED (
  SELECT s.*, coalesce(c.label, ra, da, 'x:' || k) AS entity FROM sight s LEFT JOIN comp c ON c.node = coalesce(ra, da))"""


def _resolved(spark, d):
    return merge.resolve(ct.sightings(spark, d))


@query("gr2_entities", SIGHT_SQL + "SELECT CASE WHEN entity LIKE 'x:%' THEN 'x' ELSE entity END AS entity, k AS seq FROM res")
def gr2(spark, d):
    return _resolved(spark, d).select(F.when(F.col("entity").startswith("x:"), "x").otherwise(F.col("entity")).alias("entity"), "seq")


MERGED_SQL = (
    SIGHT_SQL
    + """,
m AS (
  SELECT entity, count(*) AS sightings, coalesce(arg_max(replay_id, k) FILTER (WHERE replay_id <> ''), '') AS replay_id,
    coalesce(arg_max(detail_t, k) FILTER (WHERE detail_t <> ''), '') AS detail_t, arg_max(follow_id, k) AS follow_id,
    coalesce(arg_max(played_at, k) FILTER (WHERE NOT light), arg_min(played_at, k) FILTER (WHERE light)) AS played_at,
    arg_max(mode, k) FILTER (WHERE mode <> '') AS mode, arg_max(version, k) FILTER (WHERE version <> '') AS version,
    coalesce(arg_max(result, k) FILTER (WHERE result <> 'unknown'), 'unknown') AS result,
    coalesce(arg_max(detail_url, k) FILTER (WHERE NOT light AND detail_url <> ''), arg_min(detail_url, k) FILTER (WHERE light AND detail_url <> ''),
      arg_min('https://site.example/members/enbujyo/play?p=' || replay_id, k) FILTER (WHERE replay_id <> '')) AS detail_url,
    coalesce(arg_max('t' || k, k) FILTER (WHERE NOT light OR k % 3 = 1), arg_min('t' || k, k) FILTER (WHERE light)) AS title,
    coalesce(arg_max(CASE WHEN k % 11 <> 0 THEN player_name ELSE '' END, k) FILTER (WHERE NOT light), arg_min(player_name, k) FILTER (WHERE light AND k % 11 <> 0)) AS player_name
  FROM res GROUP BY 1)
"""
)


@query(
    "up1_match_fields",
    MERGED_SQL
    + f"""SELECT coalesce({PUBLIC_ID}, 'unnamed') AS public_id, sightings, played_at, mode, version, result, detail_url FROM m""",
)
def up1(spark, d):
    rows = merge.merged(_resolved(spark, d))
    public = F.when(F.col("public_id").startswith("d:unknown:"), "unnamed").otherwise(F.col("public_id"))
    return rows.select(public.alias("public_id"), "sightings", "played_at", "mode", "version", "result", "detail_url")


@query("up2_sides", MERGED_SQL + "SELECT coalesce(player_name, '') AS player_name, count(*) AS matches FROM m GROUP BY 1")
def up2(spark, d):
    rows = merge.merged(_resolved(spark, d))
    name = F.coalesce(F.get("players", F.lit(0))["player_name"], F.lit(""))
    return rows.groupBy(name.alias("player_name")).agg(F.count(F.lit(1)).alias("matches"))


@query("up4_summaries", MERGED_SQL + "SELECT title, sightings FROM m")
def up4(spark, d):
    return merge.merged(_resolved(spark, d)).select("title", "sightings")


@query(
    "up5_replay_assets",
    MERGED_SQL
    + """SELECT replay_id, 'https://site.example/members/enbujyo/play?p=' || replay_id AS play_url, 'https://stream.example/' || replay_id || '/x' AS m3u8_url
FROM m WHERE replay_id <> ''""",
)
def up5(spark, d):
    rows = merge.merged(_resolved(spark, d), "https://stream.example/{id}/x")
    return rows.where(F.col("replay_id") != "").select("replay_id", "play_url", "m3u8_url")


@query("uq_aliases", SIGHT_SQL + "SELECT DISTINCT ra AS alias, 'replay' AS alias_type FROM res WHERE ra IS NOT NULL UNION SELECT DISTINCT da, 'detail' FROM res WHERE da IS NOT NULL")
def uq_aliases(spark, d):
    return merge.aliases(_resolved(spark, d)).select("alias", "alias_type")


@query(
    "up6_players",
    """SELECT 'F' || (o_custkey % 40) AS follow_id, coalesce(arg_max('P' || o_custkey, o_orderkey) FILTER (WHERE o_orderkey % 3 <> 0), 'f-F' || (o_custkey % 40)) AS name,
  coalesce(arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 7 <> 0), '') AS state, max(o_orderkey) AS last_seen FROM orders GROUP BY o_custkey % 40""",
)
def up6(spark, d):
    k = F.col("o_orderkey")
    rows = ct.table(spark, d, "orders").select(
        k.alias("seq"), F.concat(F.lit("F"), F.col("o_custkey") % 40).alias("follow_id"),
        F.when(k % 3 != 0, F.concat(F.lit("P"), "o_custkey")).otherwise("").alias("name"),
        F.when(k % 7 != 0, F.col("o_orderpriority")).otherwise("").alias("state"), F.lit("").alias("daily_url"),
    )
    return merge.players(rows).drop("daily_url")


def _uploads(spark, d):
    """Every order of an odd customer uploads the package of its nation and year."""
    rows = ct.orders(spark, d)
    return rows.select(
        F.col("order_key").alias("seq"), F.col("order_key").alias("upload_id"), F.col("contributor").alias("user_id"), "version",
        F.concat_ws(":", F.col("contributor").cast("string"), "version").alias("content_hash"), F.substring("played_at", 1, 10).alias("date_from"),
        F.date_format(F.date_add(F.to_date(F.substring("played_at", 1, 10)), 3), "yyyy-MM-dd").alias("date_to"),
    )


UPLOAD_SQL = CONTESTS + """, up AS (
  SELECT o_orderkey AS upload_id, c_nationkey AS user_id, 'V' || year(o_orderdate) AS version, c_nationkey || ':V' || year(o_orderdate) AS content_hash,
    strftime(o_orderdate, '%Y-%m-%d') AS date_from, strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') AS date_to FROM orders LEFT JOIN customer ON c_custkey = o_custkey)
"""


@query("up9_new_uploads", UPLOAD_SQL + "SELECT user_id, content_hash, min(upload_id) AS upload_id FROM up WHERE version <> 'V1998' GROUP BY 1, 2")
def up9(spark, d):
    rows = _uploads(spark, d)
    known = rows.where(F.col("version") == "V1998").select("user_id", "content_hash").distinct()
    return merge.new_uploads(rows, known).select("user_id", "content_hash", "upload_id")


@query("up15_watermark", "SELECT max(o_orderkey) AS watermark FROM orders")
def up15(spark, d):
    return leaderboard.upload_watermark(_uploads(spark, d))


@query("ag20_version_spans", UPLOAD_SQL + "SELECT version, min(date_from) AS date_from, max(date_to) AS date_to FROM up GROUP BY 1")
def ag20(spark, d):
    from duelstats.operators.versions import uploaded_spans

    return uploaded_spans(_uploads(spark, d))


@query("job15_my_uploads", UPLOAD_SQL + "SELECT upload_id, version, date_from FROM up WHERE user_id = 7")
def job15(spark, d):
    rows = _uploads(spark, d).where(F.col("user_id") == 7)
    return rows.orderBy(F.col("date_from").desc(), F.col("upload_id").desc()).select("upload_id", "version", "date_from")


def _runs(spark, d):
    """Orders read as published runs."""
    o, k = ct.table(spark, d, "orders"), F.col("o_orderkey")
    return o.select(
        k.alias("run_id"), F.lit("public").alias("scope"), F.lit(3).alias("payload_version"), F.concat(F.lit("V"), F.year("o_orderdate")).alias("target_version"),
        F.lit("1999-01-01").alias("date_from"), F.concat(F.lit("1999-12-"), F.lpad((k % 3 + 10).cast("string"), 2, "0")).alias("date_to"), F.lit(False).alias("include_solo"),
        (k % 50).alias("watermark"), F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "failed").otherwise("building").alias("status"),
    )


RUN_CFG = replace(CFG, version="V1999", date_from="1999-01-01", date_to="1999-12-11")
RUN_SQL = """WITH run AS (
  SELECT o_orderkey AS run_id, 'V' || year(o_orderdate) AS target_version, '1999-12-' || (o_orderkey % 3 + 10) AS date_to, o_orderkey % 50 AS watermark,
    CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'failed' ELSE 'building' END AS status FROM orders)
"""


@query(
    "up11_current_run",
    RUN_SQL + "SELECT * FROM run WHERE target_version = 'V1999' AND date_to = '1999-12-11' AND watermark = 7 AND status = 'ready' ORDER BY run_id DESC LIMIT 1",
)
def up11(spark, d):
    return leaderboard.run_for(_runs(spark, d), RUN_CFG, 7).select("run_id", "target_version", "date_to", "watermark", "status")


@query("up11_latest_run_of_version", RUN_SQL + "SELECT * FROM run WHERE target_version = 'V1997' AND status = 'ready' ORDER BY run_id DESC LIMIT 1")
def up11_other(spark, d):
    return leaderboard.run_for(_runs(spark, d), RUN_CFG, 7, "V1997").select("run_id", "target_version", "date_to", "watermark", "status")


@query(
    "up12_superseded_runs",
    RUN_SQL
    + """SELECT run_id, status FROM run WHERE target_version = 'V1999' AND date_to = '1999-12-11'
  AND run_id <> (SELECT max(run_id) FROM run WHERE target_version = 'V1999' AND date_to = '1999-12-11' AND watermark = 7 AND status = 'ready')""",
)
def up12(spark, d):
    runs = _runs(spark, d)
    return leaderboard.superseded(runs, leaderboard.run_for(runs, RUN_CFG, 7)).select("run_id", "status")


@query("up13_versions", RUN_SQL + "SELECT DISTINCT target_version FROM run WHERE status = 'ready' UNION SELECT 'V2020'")
def up13(spark, d):
    return leaderboard.available_versions(_runs(spark, d), "V2020")


WIDE_SQL = CONTESTS + """SELECT h.match_id, played_at, mode, version, match_result AS result, coalesce(a.player_name, '') AS player_name, coalesce(b.player_name, '') AS enemy_name,
  coalesce(a.slots, '') AS player_deck, coalesce(b.slots, '') AS enemy_deck,
  played_at || ' ' || match_result || ' ' || coalesce(a.player_name, '-') || ' vs ' || coalesce(b.player_name, '-') AS summary
FROM header h LEFT JOIN side a ON a.match_id = h.match_id AND a.side_index = 1 LEFT JOIN side b ON b.match_id = h.match_id AND b.side_index = 2"""


@query("rs5_wide_matches", WIDE_SQL)
def rs5(spark, d):
    return jobs.wide_matches(ct.bouts(spark, d))


@query("srt7_match_order", f"SELECT match_id, played_at FROM ({WIDE_SQL}) ORDER BY played_at DESC NULLS LAST, match_id DESC")
def srt7(spark, d):
    return jobs.wide_matches(ct.bouts(spark, d)).select("match_id", "played_at")


@query(
    "job9_match_export",
    f"""SELECT match_id, result, player_deck, array_to_string(list_transform(string_split(player_deck, '|'), lambda x: CASE WHEN x = '' THEN '' ELSE x || '(' || x || ')' END), ' / ') AS player_deck_names
FROM ({WIDE_SQL})""",
)
def job9(spark, d):
    dim = ct.card_dim(spark).withColumn("unit_type", F.col("card_hash"))
    path = scratch_path(spark, "export")
    jobs.export_matches(jobs.wide_matches(ct.bouts(spark, d), dim), path)
    return spark.read.parquet(path).select("match_id", "result", "player_deck", "player_deck_names")


def _written(spark, d):
    path = scratch_path(spark, "packages")
    rows = ct.matches(spark, d)
    cfg = replace(CFG, date_from="1990-01-01", date_to="2010-12-31")
    manifests = jobs.export_contributions(rows, cfg, F.col("contributor"), path, "2024-01-01T00:00:00")
    return path, manifests


@query(
    "job10_contribution_export",
    CONTESTS
    + """SELECT CAST(contributor AS VARCHAR) AS contributor_id, version AS target_version, count(*) AS match_count
FROM header JOIN side USING (match_id) WHERE side_index = 1 AND mode <> '5-LOW' GROUP BY 1, 2""",
)
def job10(spark, d):
    path, _ = _written(spark, d)
    lines = packages.read_lines(spark, path)
    seen = cut(packages.inspect(lines))
    release(lines)
    fine = seen.where((F.col("reason") == "") & (F.col("records") == F.col("match_count")))
    return fine.select("contributor_id", "target_version", "match_count")


@query(
    "src1_package_lines",
    CONTESTS
    + """SELECT CAST(contributor AS VARCHAR) || '/' || version AS package, CAST(count(*) + 1 AS BIGINT) AS lines, CAST(1 AS BIGINT) AS first_line, CAST(count(*) + 1 AS BIGINT) AS last_line
FROM header JOIN side USING (match_id) WHERE side_index = 1 AND mode <> '5-LOW' GROUP BY contributor, version""",
)
def src1(spark, d):
    path, _ = _written(spark, d)
    lines = packages.read_lines(spark, path)
    name = F.concat_ws("/", F.regexp_extract("path", "contributor_id=([^/]+)", 1), F.regexp_extract("path", "target_version=([^/]+)", 1))
    return lines.groupBy(name.alias("package")).agg(F.count(F.lit(1)).alias("lines"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))


@query("job11_contribution_import", DECK_SQL + "SELECT deck_fingerprint, sample_count, win_count, wilson_lower_bound, avg_kill_count FROM deck_stat WHERE sample_scope = 'all_players' AND version_scope = 'all_versions'")
def job11(spark, d):
    path, _ = _written(spark, d)
    store = jobs.Store(spark, scratch_path(spark, "store"))
    lines = packages.read_lines(spark, path)
    store.add(lines, 1)
    release(lines)
    rows = samples.known_samples(samples.side_samples(samples.in_scope(cut(store.bouts()), CFG)))
    base = stats.base_stats(stats.deck_stats(rows, CFG))
    return base.select("deck_fingerprint", "sample_count", "win_count", "wilson_lower_bound", "avg_kill_count")


@query(
    "ag24_import_twice",
    CONTESTS
    + """, p AS (SELECT count(DISTINCT contributor || ':' || version) AS n, count(*) AS m FROM header JOIN side USING (match_id) WHERE side_index = 1 AND mode <> '5-LOW')
SELECT 1 AS batch, n AS packages_seen, n AS packages_imported, 0 AS packages_skipped, m AS matches_imported, 0 AS errors FROM p
UNION ALL SELECT 2, n, 0, n, 0, 0 FROM p""",
)
def ag24(spark, d):
    path, _ = _written(spark, d)
    store = jobs.Store(spark, scratch_path(spark, "store"))
    lines = packages.read_lines(spark, path)
    once = cut(jobs.import_summary(store.add(lines, 1)).withColumn("batch", F.lit(1)))
    again = cut(jobs.import_summary(store.add(lines, 2)).withColumn("batch", F.lit(2)))
    release(lines)
    return once.unionByName(again)


@query(
    "up8_package_bridge",
    CONTESTS
    + """SELECT 'r:R' || match_id AS public_id, 'R' || match_id AS replay_id, CAST(contributor AS VARCHAR) || ':' || version AS package
FROM header JOIN side USING (match_id) WHERE side_index = 1 AND mode <> '5-LOW'""",
)
def up8(spark, d):
    path, _ = _written(spark, d)
    store = jobs.Store(spark, scratch_path(spark, "store"))
    lines = packages.read_lines(spark, path)
    store.add(lines, 1)
    release(lines)
    return store.bridge().select("public_id", "replay_id", F.concat_ws(":", F.split("package_id", ":")[0], F.split("package_id", ":")[1]).alias("package"))


@query(
    "fn38_package_ids",
    """SELECT doc_id, trim(coalesce(nullif(regexp_replace(regexp_replace(trim(source), '[^0-9A-Za-z._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'unknown')) || ':' || lang
  || ':1999-01-01:1999-02-01:' || substr(sha256(text), 1, 16) AS package_id FROM documents""",
)
def fn38(spark, d):
    rows = ct.table(spark, d, "documents")
    return rows.select("doc_id", text.package_id(F.col("source"), F.col("lang"), F.lit("1999-01-01"), F.lit("1999-02-01"), F.sha2("text", 256)).alias("package_id"))


@query("flt10_light_records", SIGHT_SQL + "SELECT k AS seq, result = 'unknown' AND k % 3 <> 1 AS light FROM sight")
def flt10(spark, d):
    rows = ct.sightings(spark, d)
    return rows.select("seq", merge.lightweight(F.col("result"), F.col("castle_rows"), F.col("timeline_data")).alias("light"))


@query(
    "jn10_open_replays",
    SIGHT_SQL + "SELECT DISTINCT replay_id FROM sight WHERE replay_id <> '' AND replay_id NOT IN (SELECT replay_id FROM sight WHERE k % 11 <> 0 AND NOT light)",
)
def jn10(spark, d):
    rows = ct.sightings(spark, d).where(F.col("replay_id") != "")
    stored = rows.where((F.size("players") > 0) & ~F.col("light")).select("replay_id")
    return rows.join(stored, "replay_id", "left_anti").select("replay_id").distinct()
