"""Checkable queries: scalar functions over whole columns of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelstats.functions import decks, links, outcomes, ranks, text
from duelstats.operators import pages
from duelstats.queries.base import CONTESTS, query
from duelstats.sources import contest_tables as ct


def _docs(spark, d):
    return ct.table(spark, d, "documents")


@query("fn1_rates", r"SELECT doc_id, try_cast(regexp_extract(text, '-?\d+(?:\.\d+)?') AS DOUBLE) AS rate FROM documents")
def fn1(spark, d):
    return _docs(spark, d).select("doc_id", text.parse_rate(F.col("text")).alias("rate"))


@query("fn2_numbers", "SELECT event_id, round(CAST(json_extract(props, '$.k') AS DOUBLE), 6) AS k FROM events")
def fn2(spark, d):
    return ct.table(spark, d, "events").select("event_id", text.coerce_number(F.try_parse_json("props"), "$.k").alias("k"))


@query(
    "fn3_rankings",
    "SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_custkey AS INT) * 1000 + 7 END AS ranking FROM orders",
)
def fn3(spark, d):
    label = F.concat(F.lit("全国 "), F.col("o_custkey").cast("string"), F.lit(",007位"))
    profile = F.to_json(F.struct(F.when(F.col("o_custkey") % 3 != 0, label).otherwise("-").alias(ranks.RANKING_KEY)))
    return ct.table(spark, d, "orders").select("o_orderkey", ranks.ranking(F.parse_json(profile)).alias("ranking"))


@query(
    "fn4_battle_totals",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS kills, CAST(l_suppkey AS DOUBLE) AS deaths FROM lineitem",
)
def fn4(spark, d):
    stats = F.struct(F.struct(F.col("l_quantity").alias("total")).alias("kill_count"), F.col("l_suppkey").cast("string").alias("death_count"))
    profile = F.parse_json(F.to_json(F.struct(stats.alias("battle_stats"))))
    total = lambda key: F.coalesce(
        text.coerce_number(profile, f"$.battle_stats.{key}.total"), text.coerce_number(profile, f"$.battle_stats.{key}")
    )
    rows = ct.table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", total("kill_count").alias("kills"), total("death_count").alias("deaths"))


@query(
    "fn6_remaining_damage",
    CONTESTS + "SELECT match_id, side_index, greatest(0, 100 - rate) AS damage FROM side",
)
def fn6(spark, d):
    rate = text.parse_rate(F.col("castle_rate"))
    return ct.orders(spark, d).select("match_id", "side_index", outcomes.remaining_damage(rate).alias("damage"))


@query(
    "fn7_reversed_results",
    CONTESTS
    + """SELECT match_id, side_index, own_result AS result, CASE own_result WHEN 'win' THEN 'loss' WHEN 'loss' THEN 'win' WHEN 'draw' THEN 'draw' ELSE 'unknown' END AS reversed FROM side""",
)
def fn7(spark, d):
    rows = ct.orders(spark, d)
    return rows.select("match_id", "side_index", outcomes.normal_result(F.col("result")).alias("result"), outcomes.reversed_result(F.col("result")).alias("reversed"))


@query("fn12_fingerprints", CONTESTS + "SELECT order_key, fp AS deck_fingerprint FROM deck")
def fn12(spark, d):
    cards = F.collect_list("card")
    return ct.lines(spark, d, souls=False).groupBy("order_key").agg(decks.fingerprint(cards).alias("deck_fingerprint"))


LABELS = ["風来坊三", "旅人", "食客二", "従騎士1", "騎士", "五万石", "男爵", "團"]


@query(
    "fn13_rank_orders",
    """SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 WHEN 3 THEN 40 WHEN 4 THEN 50 WHEN 5 THEN 60 WHEN 6 THEN 70
  ELSE CASE WHEN c_custkey % 130 <= 9 THEN 20 WHEN c_custkey % 130 < 50 THEN 40 WHEN c_custkey % 130 < 100 THEN 50 ELSE 60 END END AS rank_order FROM customer""",
)
def fn13(spark, d):
    k = F.col("c_custkey")
    label = F.get(F.array(*[F.lit(x) for x in LABELS]), (k % 8).cast("int"))
    label_key = F.when(k % 2 == 0, F.to_json(F.struct(label.alias("段位")))).otherwise(
        F.to_json(F.struct(F.lit("").alias("段位"), label.alias("league"), F.concat(F.lit("証 "), (k % 130).cast("string")).alias("証")))
    )
    return ct.table(spark, d, "customer").select("c_custkey", ranks.rank_order(F.parse_json(label_key)).alias("rank_order"))


@query("fn16_choice_names", r"""SELECT doc_id, CASE WHEN trim(regexp_replace(source, '\s+', ' ', 'g')) IN ('', '-', 'None', 'none') THEN '' ELSE trim(regexp_replace(source, '\s+', ' ', 'g')) END AS name FROM documents""")
def fn16(spark, d):
    from duelstats.functions.loadout import choice_name

    return _docs(spark, d).select("doc_id", choice_name(F.col("source")).alias("name"))


@query("fn19_sample_dates", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def fn19(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm")
    return ct.table(spark, d, "events").select("event_id", F.date_format(text.sample_date(stamp), "yyyy-MM-dd").alias("day"))


@query(
    "fn20_clean_text",
    r"""SELECT doc_id, sha256(trim(regexp_replace(trim(regexp_replace(text, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}]+', ' ', 'g')), '\s*---$', ''))) AS digest FROM documents""",
)
def fn20(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(text.clean_text(F.col("text")), 256).alias("digest"))


@query(
    "fn21_inferred_results",
    """SELECT conv_id, turn, role, CASE WHEN lower(text) LIKE '%win%' THEN 'win' WHEN lower(text) LIKE '%lose%' OR lower(text) LIKE '%loss%' THEN 'loss'
  WHEN lower(text) LIKE '%draw%' THEN 'draw' ELSE 'unknown' END AS result FROM conversations""",
)
def fn21(spark, d):
    return ct.table(spark, d, "conversations").select("conv_id", "turn", "role", text.infer_result(F.col("text")).alias("result"))


@query(
    "fn22_inferred_times",
    r"""SELECT doc_id, CASE WHEN regexp_extract(text, '(\d{2}:\d{2})', 1) <> '' THEN '2026-01-02 ' || regexp_extract(text, '(\d{2}:\d{2})', 1) ELSE '' END AS played_at FROM documents""",
)
def fn22(spark, d):
    return _docs(spark, d).select("doc_id", text.infer_played_at(F.col("text"), F.lit("2026-01-02")).alias("played_at"))


@query(
    "fn23_url_parts",
    r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page_no, regexp_extract(url, '[?&]ref=([^&#]*)', 1) AS ref FROM pages""",
)
def fn23(spark, d):
    url = F.col("url")
    return ct.table(spark, d, "pages").select("page_id", links.host(url).alias("host"), links.query_value(url, "page").alias("page_no"), links.query_value(url, "ref").alias("ref"))


@query("fn24_played_at", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS played_at FROM orders")
def fn24(spark, d):
    return ct.orders(spark, d).select(F.col("order_key").alias("o_orderkey"), links.played_at_of(F.col("unix_time").cast("string")).alias("played_at"))


@query(
    "fn25_public_ids",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'r:R' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'd:' || o_custkey || ':9' ELSE 'd:unknown:' || substr(sha256(o_custkey || '|'), 1, 16) END AS public_id FROM orders""",
)
def fn25(spark, d):
    k = F.col("o_orderkey")
    replay = F.when(k % 3 == 0, F.concat(F.lit("R"), k))
    second = F.when(k % 3 != 2, F.lit("9")).otherwise("")
    return ct.table(spark, d, "orders").select("o_orderkey", links.public_id(replay, F.col("o_custkey").cast("string"), second).alias("public_id"))


@query("fn26_digests", "SELECT doc_id, sha256(text) AS digest FROM documents")
def fn26(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("fn27_stream_urls", "SELECT o_orderkey, 'https://stream.example/live/R' || o_orderkey || '/x' AS url FROM orders")
def fn27(spark, d):
    replay = F.concat(F.lit("R"), "o_orderkey")
    return ct.table(spark, d, "orders").select("o_orderkey", links.stream_url(replay, "https://stream.example/live/{id}/x").alias("url"))


@query(
    "fn28_label_years",
    """SELECT o_orderkey, CASE WHEN make_date(1999, month(o_orderdate), least(day(o_orderdate), 28)) BETWEEN DATE '1998-11-10' AND DATE '1999-04-30'
    THEN '1999' || strftime(make_date(1999, month(o_orderdate), least(day(o_orderdate), 28)), '-%m-%d 10:05')
  WHEN make_date(1998, month(o_orderdate), least(day(o_orderdate), 28)) BETWEEN DATE '1998-11-10' AND DATE '1999-04-30'
    THEN '1998' || strftime(make_date(1998, month(o_orderdate), least(day(o_orderdate), 28)), '-%m-%d 10:05') ELSE '' END AS played_at FROM orders""",
)
def fn28(spark, d):
    day = F.least(F.dayofmonth("o_orderdate"), F.lit(28))
    label = F.concat(F.month("o_orderdate").cast("string"), F.lit("/"), day.cast("string"), F.lit(" 10:05"))
    return ct.table(spark, d, "orders").select("o_orderkey", text.year_for_label(label, "1998-11-10", "1999-04-30").alias("played_at"))


@query(
    "fn29_card_costs",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size / 2.0 WHEN p_partkey % 3 = 1 THEN p_retailprice ELSE 0.0 END::DOUBLE AS cost FROM part""",
)
def fn29(spark, d):
    k = F.col("p_partkey")
    first = F.when(k % 3 == 0, (F.col("p_size") / 2.0).cast("string")).otherwise("n/a")
    second = F.when(k % 3 == 1, F.col("p_retailprice").cast("string")).otherwise("")
    return ct.table(spark, d, "part").select("p_partkey", decks.card_cost(first, second).alias("cost"))


@query(
    "fn30_card_labels",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '未识别卡(' || substr(p_type, 1, 8) || ')' WHEN p_partkey % 4 = 1 THEN p_name
  ELSE p_name || '(' || p_size || ' ' || p_brand || ')' END AS label FROM part""",
)
def fn30(spark, d):
    k, known = F.col("p_partkey"), F.col("p_partkey") % 4 != 1
    size = F.when(known, F.col("p_size").cast("string"))
    brand = F.when(known, F.col("p_brand")).otherwise("")
    label = decks.card_label(F.col("p_name"), F.lit(""), F.col("p_type"), size, brand)
    return ct.table(spark, d, "part").select("p_partkey", F.when(k % 4 == 0, decks.unknown_label(F.col("p_type"))).otherwise(label).alias("label"))


@query(
    "fn31_code_like",
    r"""SELECT p_partkey, length(p_brand) <= 8 AND regexp_matches(p_brand, '[A-Za-z]') AND regexp_matches(p_brand, '\d') AS code_like FROM part""",
)
def fn31(spark, d):
    return ct.table(spark, d, "part").select("p_partkey", decks.looks_like_code(F.col("p_brand")).alias("code_like"))


@query(
    "fn33_matchup_tones",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount * 10 >= 0.55 THEN 'advantage' WHEN l_discount * 10 <= 0.45 THEN 'disadvantage' ELSE 'even' END AS tone FROM lineitem""",
)
def fn33(spark, d):
    return ct.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", outcomes.matchup_tone(F.col("l_discount") * 10).alias("tone"))


@query(
    "fn39_version_order",
    """WITH v AS (SELECT DISTINCT 'Ver.' || p_size || '.' || (p_partkey % 12) AS version, p_size AS a, p_partkey % 12 AS b FROM part)
SELECT version, array_to_string([a, b], '.') AS version_key FROM v""",
)
def fn39(spark, d):
    label = F.concat(F.lit("Ver."), "p_size", F.lit("."), F.col("p_partkey") % 12)
    rows = ct.table(spark, d, "part").select(label.alias("version")).distinct()
    ordered = rows.withColumn("k", text.version_key(F.col("version"))).orderBy(F.col("k").desc(), F.col("version").desc())
    return ordered.select("version", F.array_join(F.transform("k", lambda n: n.cast("string")), ".").alias("version_key"))


@query(
    "flt7_named_players",
    "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%r#00000001%'",
)
def flt7(spark, d):
    rows = ct.table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("follow_id"), F.col("c_name").alias("name"))
    return pages.wanted_players(rows, player_name="R#00000001").select("c_custkey", F.col("name").alias("c_name"))


@query(
    "flt8_active_players",
    """SELECT o_orderkey FROM orders WHERE o_orderkey % 9 = 0 OR CAST(o_orderdate + INTERVAL 9 HOUR AS DATE) >= DATE '1999-05-05'""",
)
def flt8(spark, d):
    last = F.when(F.col("order_key") % 9 == 0, "unknown").otherwise(F.col("unix_time").cast("string"))
    rows = ct.orders(spark, d).where(~pages.inactive_before(last, "1999-05-05"))
    return rows.select(F.col("order_key").alias("o_orderkey"))
