"""Checkable queries: pages, search frontier, catalog, versions, streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from duelstats.operators import frontier, pages, samples, versions
from duelstats.plans import leaderboard
from duelstats.queries.base import CONTESTS, ORACLES, counts_sql, query
from duelstats.session import scratch_path
from duelstats.sources import catalog, contest_tables as ct, snapshots
from duelstats.streaming import daily

CFG = ct.CONFIG


@query(
    "src9_page_overview",
    r"""SELECT page_id, url, len(regexp_extract_all(html, '<a [^>]*href=')) AS links FROM pages""",
)
def src9(spark, d):
    return pages.overview(ct.table(spark, d, "pages")).select("page_id", "url", "links")


@query(
    "par_page_titles",
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages""",
)
def par_titles(spark, d):
    return pages.overview(ct.table(spark, d, "pages")).select("page_id", "title")


@query(
    "par_page_links",
    r"""WITH l AS (SELECT page_id, url, regexp_extract_all(html, '<a [^>]*href="([^"]+)"', 1) AS h FROM pages)
SELECT page_id, CAST(i - 1 AS INT) AS place, href FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) AS i FROM l)""",
)
def par_links(spark, d):
    return pages.page_links(ct.table(spark, d, "pages")).select("page_id", "place", "href")


EMPTY_LINES = '{"player":{"school_counts":[],"wave_calls":[],"orange_changes":[]},"enemy":{"school_counts":[],"wave_calls":[],"orange_changes":[]},"castle":{"player":[],"enemy":[]}}'


@query(
    "src11_script_arrays",
    rf"""SELECT page_id, coalesce(len(TRY_CAST(nullif(regexp_extract(html, '(?:var|let|const)?\s*data\s*=\s*(\[[^\]]*\])', 1), '') AS DOUBLE[])), 0)::INT AS numbers,
  CASE WHEN NOT regexp_matches(html, '[pe]_(schoolCnt|waveCnt|orangeCnt|castleTL)') THEN {len(EMPTY_LINES)} END::INT AS timeline FROM pages""",
)
def src11(spark, d):
    rows = ct.table(spark, d, "pages")
    return rows.select("page_id", F.size(pages.js_array(F.col("html"), "data")).alias("numbers"), F.length(pages.timeline(F.col("html"))).alias("timeline"))


@query("snk6_raw_landing", "SELECT sha256(html) AS content_hash, min(url) AS source_url, CAST(length(arg_min(html, url)) AS INT) AS n FROM pages GROUP BY 1")
def snk6(spark, d):
    root = scratch_path(spark, "landing")
    rows = ct.table(spark, d, "pages")
    snapshots.land(rows.select(F.lit("2026-01-01").alias("date"), F.lit("page").alias("source_kind"), F.col("url").alias("source_url"), "html"), root)
    found = snapshots.read(spark, root, "page", "2026-01-01", "2026-01-31")
    return found.select("content_hash", "source_url", F.length("html").alias("n"))


def _units(spark, d):
    rows = ct.table(spark, d, "lineitem")
    return rows.select(F.col("l_orderkey").alias("match_id"), F.col("l_partkey").cast("string").alias("card_hash"))


FRONTIER_SQL = """WITH u AS (SELECT DISTINCT l_orderkey AS m, CAST(l_partkey AS VARCHAR) AS c FROM lineitem), c1 AS (SELECT '17' AS c),
m1 AS (SELECT DISTINCT m FROM u JOIN c1 USING (c)), c2 AS (SELECT DISTINCT c FROM u JOIN m1 USING (m) WHERE c NOT IN (SELECT c FROM c1)),
m2 AS (SELECT DISTINCT m FROM u JOIN c2 USING (c) WHERE m NOT IN (SELECT m FROM m1)),
c3 AS (SELECT DISTINCT c FROM u JOIN m2 USING (m) WHERE c NOT IN (SELECT c FROM c1) AND c NOT IN (SELECT c FROM c2))
SELECT c AS card_hash, 1 AS round FROM c1 UNION ALL SELECT c, 2 FROM c2 UNION ALL SELECT c, 3 FROM c3"""


@query("gr3_frontier", FRONTIER_SQL)
def gr3(spark, d):
    return frontier.expand(_units(spark, d), spark.createDataFrame([("17",)], "card_hash string"), 2)


@query("ag18_frequent_cards", CONTESTS + "SELECT card AS card_hash, count(*) AS sample_count FROM line GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def ag18(spark, d):
    return frontier.frequent_cards(ct.lines(spark, d, souls=False).withColumnRenamed("card", "card_hash"), 5)


def _items(spark, d):
    """Orders read as search items."""
    k = F.col("o_orderkey")
    day = F.least(F.dayofmonth("o_orderdate"), F.lit(28))
    label = F.concat(F.month("o_orderdate").cast("string"), F.lit("/"), day.cast("string"), F.lit(" 10:05"))
    return ct.table(spark, d, "orders").select(
        k.alias("seq"), F.when(k % 23 != 0, F.concat(F.lit("R"), F.col("o_custkey"))).otherwise("").alias("replay_id"), (k % 13 != 0).alias("has_opponent"),
        F.concat(F.lit("V"), F.year("o_orderdate")).alias("version"), F.col("o_orderpriority").alias("mode"), label.alias("label"),
    )


FUNNEL_SQL = """WITH i AS (
  SELECT o_orderkey AS k, o_custkey, make_date(1999, month(o_orderdate), least(day(o_orderdate), 28)) AS day, o_orderpriority AS mode, year(o_orderdate) AS y FROM orders),
j AS (
  SELECT *, CASE WHEN k % 13 = 0 THEN 'skipped_without_opponent' WHEN y <> 1999 THEN 'skipped_by_version' WHEN mode = '5-LOW' THEN 'skipped_by_mode'
    WHEN NOT day BETWEEN DATE '1999-02-10' AND DATE '1999-09-30' THEN 'skipped_by_date' WHEN k % 23 = 0 THEN 'blank_id' END AS early FROM i),
t AS (SELECT *, CASE WHEN early IS NULL THEN row_number() OVER (PARTITION BY early, o_custkey ORDER BY k) END AS nth FROM j),
judged AS (SELECT k, o_custkey, coalesce(early, CASE WHEN nth > 1 THEN 'duplicates_in_run' WHEN o_custkey % 4 = 0 THEN 'duplicates_existing' ELSE 'accepted' END) AS reason FROM t)
"""


def _judged(spark, d):
    cfg = replace(CFG, version="V1999", date_from="1999-02-10", date_to="1999-09-30")
    stored = ct.table(spark, d, "customer").where(F.col("c_custkey") % 4 == 0).select(F.concat(F.lit("R"), "c_custkey").alias("replay_id"))
    return frontier.funnel_reason(_items(spark, d), cfg, stored)


@query("ag23_search_funnel", FUNNEL_SQL + "SELECT reason, count(*) AS items FROM judged GROUP BY 1")
def ag23(spark, d):
    return frontier.funnel(_judged(spark, d))


@query("wn8_budget", FUNNEL_SQL + "SELECT k AS seq FROM judged WHERE reason = 'accepted' ORDER BY k LIMIT 100")
def wn8(spark, d):
    accepted = _judged(spark, d).where(F.col("reason") == "accepted")
    return frontier.within_budget(accepted, [F.col("seq").asc()], 100).select("seq")


@query("wn7_first_items", "SELECT 'R' || o_custkey AS replay_id, min(o_orderkey) AS seq FROM orders WHERE o_orderkey % 23 <> 0 GROUP BY 1")
def wn7(spark, d):
    from duelstats.operators.merge import first_per_key

    return first_per_key(_items(spark, d).where(F.col("replay_id") != ""), "replay_id").select("replay_id", "seq")


@query("flt13_item_versions", "SELECT o_orderkey AS seq FROM orders WHERE year(o_orderdate) = 1997")
def flt13(spark, d):
    return _items(spark, d).where(F.col("version") == "V1997").select("seq")


@query(
    "set3_frontier_difference",
    "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS card_hash FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)",
)
def set3(spark, d):
    url = F.concat(F.lit("https://site.example/search?r=0&g="), "p_partkey", F.lit("&min=0"))
    shots = ct.table(spark, d, "part").where(F.col("p_size") > 10).select(url.alias("source_url"), F.lit("video_search_api").alias("source_kind"))
    return _units(spark, d).select("card_hash").distinct().join(frontier.searched_cards(shots), "card_hash", "left_anti")


@query(
    "jn12_work_list",
    """SELECT 'P' || c_custkey AS follow_id, strftime(day, '%Y-%m-%d') AS iso_date FROM customer, (SELECT unnest(generate_series(DATE '1999-02-27', DATE '1999-03-02', INTERVAL 1 DAY)) AS day) ds
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND CAST(o_orderdate AS DATE) = ds.day)""",
)
def jn12(spark, d):
    players = ct.table(spark, d, "customer").select(F.concat(F.lit("P"), "c_custkey").alias("follow_id"), F.col("c_name").alias("name"))
    done = ct.orders(spark, d).select(F.col("player_name").alias("follow_id"), F.substring("played_at", 1, 10).alias("iso_date"))
    jobs = pages.work_list(players, "1999-02-27", "1999-03-02", "https://site.example")
    return jobs.join(done, ["follow_id", "iso_date"], "left_anti").select("follow_id", "iso_date")


# ---- catalog --------------------------------------------------------------------------------------------------------


def _card_table(spark, d):
    """Parts read as a card table with two picture keys each; the code is shared by two parts."""
    k = F.col("p_partkey")
    keys = F.to_json(F.struct(F.concat(F.lit("s"), k).alias("card_small"), F.concat(F.lit("f"), k % 500).alias("card_face")))
    return ct.table(spark, d, "part").select(
        F.concat(F.lit("c"), k).alias("card_code"), F.col("p_name").alias("name"), F.when(k % 2 == 0, (F.col("p_size") / 2).cast("string")).alias("cost_label"),
        (F.col("p_size") * 10.0).alias("cost_value"), F.col("p_type").alias("unit_type"), keys.alias("image_keys_json"),
    )


CARD_SQL = """WITH c AS (SELECT p_partkey AS k, 'c' || p_partkey AS card_code, p_name AS name, p_type AS unit_type, CASE WHEN p_partkey % 2 = 0 THEN p_size / 2.0 ELSE p_size * 10.0 END::DOUBLE AS cost FROM part),
h AS (SELECT 's' || k AS card_hash, * FROM c UNION ALL SELECT 'f' || (k % 500), * FROM c UNION ALL SELECT 'c' || k, * FROM c),
dim AS (SELECT card_hash, arg_max((card_code, name, unit_type, cost, k), k) AS r FROM h GROUP BY 1)
"""


@query("rs7_card_hashes", CARD_SQL + "SELECT card_hash, r[1] AS card_code, r[2] AS name, r[3] AS unit_type, r[4] AS cost FROM dim")
def rs7(spark, d):
    return catalog.by_hash(catalog.from_table(_card_table(spark, d))).select("card_hash", "card_code", "name", "unit_type", "cost")


@query(
    "set1_overlay",
    CARD_SQL
    + """, newer AS (SELECT card_hash, arg_max(upper(name), k) AS new_name FROM h WHERE k % 3 = 0 GROUP BY 1)
SELECT card_hash, coalesce(new_name, r[2]) AS name FROM dim LEFT JOIN newer USING (card_hash)""",
)
def set1(spark, d):
    table = _card_table(spark, d)
    base = catalog.by_hash(catalog.from_table(table))
    newer = table.where(F.substring("card_code", 2, 20).cast("int") % 3 == 0).withColumn("name", F.upper("name"))
    return catalog.overlaid(base, catalog.by_hash(catalog.from_table(newer))).select("card_hash", "name")


query("set1_overlay_all", ORACLES["set1_overlay"])(set1)  # its name of the round before


@query(
    "up17_new_cards",
    "SELECT 'c' || p_partkey AS card_code FROM part WHERE p_partkey % 5 = 0",
)
def up17(spark, d):
    cards = catalog.from_table(_card_table(spark, d))
    number = F.substring("card_code", 2, 20).cast("int")
    return catalog.overlay_cards(cards, catalog.by_hash(cards.where(number % 5 != 0)).where(F.col("card_hash").startswith("s"))).select("card_code")


@query("job16_catalog_build", CARD_SQL + "SELECT count(*) AS hashes, count(DISTINCT r[1]) AS cards, round(sum(r[4]), 6) AS cost FROM dim")
def job16(spark, d):
    dim = catalog.load(spark, _card_table(spark, d))
    return dim.agg(F.count(F.lit(1)).alias("hashes"), F.countDistinct("card_code").alias("cards"), F.sum("cost").alias("cost"))


@query(
    "ag22_first_names",
    CONTESTS
    + """SELECT brand AS card_hash, arg_min(p_name, (played_at, h.match_id, l_orderkey % 2, l_linenumber, l_partkey)) AS seen_name
FROM (SELECT l_orderkey, l_linenumber, l_partkey, p_brand AS brand, p_name FROM lineitem JOIN part ON p_partkey = l_partkey) JOIN header h ON h.match_id = l_orderkey // 2 GROUP BY 1""",
)
def ag22(spark, d):
    header = ct.orders(spark, d).where(F.col("side_index") == 1).select("match_id", "played_at")
    names = ct.table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("raw_name"))
    rows = ct.lines(spark, d, "p_brand", souls=False).join(names, "part").join(header, "match_id")
    return leaderboard.first_names(rows.select("played_at", "match_id", "side_index", F.struct("line", "part").alias("slot"), F.col("card").alias("card_hash"), "raw_name"))


# ---- versions -------------------------------------------------------------------------------------------------------

STARTS_SQL = "WITH v AS (SELECT 'V' || year(o_orderdate) AS version, strftime(min(o_orderdate), '%Y-%m-%d') AS start FROM orders GROUP BY 1),\n"
WINDOWS_SQL = (
    STARTS_SQL
    + """w AS (SELECT version, start AS date_from, coalesce(strftime(CAST(lead(start) OVER (ORDER BY start) AS DATE) - INTERVAL 1 DAY, '%Y-%m-%d'), greatest(start, '2001-12-31')) AS date_to FROM v)
"""
)


def _starts(spark, d):
    return ct.orders(spark, d).groupBy("version").agg(F.min(F.substring("played_at", 1, 10)).alias("start"))


@query("wn5_version_windows", WINDOWS_SQL + "SELECT * FROM w")
def wn5(spark, d):
    return versions.windows(_starts(spark, d), "2001-12-31")


@query(
    "jn13_version_lookup",
    WINDOWS_SQL + "SELECT l_orderkey, l_linenumber, l_partkey, version AS known_version FROM lineitem LEFT JOIN w ON strftime(l_shipdate, '%Y-%m-%d') BETWEEN date_from AND date_to",
)
def jn13(spark, d):
    rows = ct.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    return versions.version_at(rows, F.col("day"), versions.windows(_starts(spark, d), "2001-12-31")).drop("day")


@query("srt8_versions", "SELECT DISTINCT 'V' || year(o_orderdate) AS version FROM orders UNION SELECT DISTINCT 'V' || year(l_shipdate) FROM lineitem UNION SELECT 'V2030'")
def srt8(spark, d):
    uploads = ct.table(spark, d, "lineitem").select(F.concat(F.lit("V"), F.year("l_shipdate")).alias("version"))
    return versions.offered(_starts(spark, d), uploads, "V2030").select("version")


@query("set2_version_union", "SELECT DISTINCT 'V' || year(o_orderdate) AS version FROM orders UNION SELECT DISTINCT 'V' || year(l_shipdate) FROM lineitem")
def set2(spark, d):
    a = ct.orders(spark, d).select("version")
    return a.unionByName(ct.table(spark, d, "lineitem").select(F.concat(F.lit("V"), F.year("l_shipdate")).alias("version"))).distinct()


@query(
    "set4_shared_cost",
    CONTESTS
    + """, duo AS (SELECT a.match_id, a.fp AS fa, b.fp AS fb FROM side a JOIN side b ON a.match_id = b.match_id AND a.side_index = 1 AND b.side_index = 2 WHERE a.fp IS NOT NULL AND b.fp IS NOT NULL),
shared AS (SELECT match_id, unnest(list_intersect(list_distinct(string_split(fa, ',')), list_distinct(string_split(fb, ',')))) AS card FROM duo)
SELECT b.match_id, coalesce(sum(cost), 0.0)::DOUBLE AS shared FROM duo b LEFT JOIN shared USING (match_id) LEFT JOIN cost USING (card) GROUP BY 1""",
)
def set4(spark, d):
    from duelstats.operators.clustering import shared_cost

    costs = F.create_map(*[F.lit(x) for pair in ct.CARD_COSTS.items() for x in pair])
    sides = samples.in_scope(ct.bouts(spark, d), replace(CFG, include_solo=True)).select("match_id", F.get("sides", F.lit(0))["cards"].alias("a"), F.get("sides", F.lit(1))["cards"].alias("b"))
    return sides.where((F.size("a") > 0) & (F.size("b") > 0)).select("match_id", shared_cost(F.col("a"), F.col("b"), costs).alias("shared"))


# ---- streams --------------------------------------------------------------------------------------------------------


def _results(rows):
    result = F.when(F.col("value") >= 35, "win").otherwise("loss")
    return rows.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("deck"), result.alias("result"))


DAILY_SQL = f"""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS deck, {counts_sql("CASE WHEN value >= 35 THEN 'win' ELSE 'loss' END")} FROM events GROUP BY 1, 2"""


@query("st4_daily_counts_stream", DAILY_SQL)
def st4(spark, d):
    schema = ct.table(spark, d, "events").schema
    stream = _results(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))
    path = scratch_path(spark, "daily")
    daily.maintain(stream, path, scratch_path(spark, "daily-checkpoint")).awaitTermination()
    return daily.read(spark, path)


@query("st4_daily_counts_batch", DAILY_SQL)
def st4_batch(spark, d):
    return daily.daily_counts(_results(ct.table(spark, d, "events")))


@query(
    "st1_package_stream",
    CONTESTS
    + """SELECT version AS target_version, CAST(contributor AS VARCHAR) AS contributor_id, 'completed' AS status, count(*) AS imported_match_count
FROM header JOIN side USING (match_id) WHERE side_index = 1 AND mode <> '5-LOW' GROUP BY 1, 2""",
)
def st1(spark, d):
    from duelstats.plans.store import Store
    from duelstats.queries.store import _written
    from duelstats.streaming.packages import ingest

    path, _ = _written(spark, d)
    root = scratch_path(spark, "store")
    ingest(spark, path, root, scratch_path(spark, "ingest-checkpoint")).awaitTermination()
    return Store(spark, root).registry().select("target_version", "contributor_id", "status", "imported_match_count")


@query("jn1_nested_bouts", CONTESTS + "SELECT s.match_id, side_index, player_name, coalesce(slots, '') AS slots FROM side s")
def jn1(spark, d):
    rows = ct.orders(spark, d)
    matches = rows.where(F.col("side_index") == 1).select("match_id", "played_at", "mode", "version", F.col("match_result").alias("result"))
    units = ct.lines(spark, d, souls=False).select("match_id", "side_index", F.struct("line", "part").alias("slot"), "card")
    castle = ct.lines(spark, d, souls=False).select("match_id", F.col("line").alias("ordinal"), "player", F.lit("").alias("label"), "enemy")
    bouts = samples.nest(matches, rows.select("match_id", "side_index", "player_name", "result", "castle_rate"), units, castle)
    return bouts.select("match_id", F.explode("sides").alias("s")).select("match_id", "s.side_index", "s.player_name", F.coalesce(F.array_join("s.cards", "|"), F.lit("")).alias("slots"))
