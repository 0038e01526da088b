"""Order and line-item tables read as contests (the mapping of the data under test).

Two orders with neighbouring keys are the two sides of one contest; the even one also carries the header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from duelstats.functions import decks
from duelstats.functions.ranks import CERTIFICATE_KEYS
from duelstats.params import JobConfig

EXCLUDED = ("5-LOW",)
CONFIG = JobConfig(excluded_modes=EXCLUDED, anchor="2001-07-31")
CARD_COSTS = {"ECONOMY": 1.0, "LARGE": 1.5, "MEDIUM": 2.0, "PROMO": 2.5, "SMALL": 3.0, "STANDARD": 3.5}


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; its schema is read from the file footer once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def result_of(status: Column) -> Column:
    return F.when(status == "F", "win").when(status == "O", "loss").when(status == "P", "draw").otherwise("unknown")


def tier_of(balance: Column) -> Column:
    return (
        F.when(balance < 0, 10).when(balance < 2000, 20).when(balance < 4000, 30)
        .when(balance < 6000, 40).when(balance < 8000, 50).when(balance < 9000, 70)
    )


def match_of(order_key: Column) -> Column:
    return F.shiftright(order_key, 1)


def side_of(order_key: Column) -> Column:
    return (F.pmod(order_key, F.lit(2)) + 1).cast("int")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per side with its own and its possible header fields."""
    price, key, cust = F.col("o_totalprice"), F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), cust == F.col("c_custkey"), "left")
    return o.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        key.alias("order_key"),
        match_of(key).alias("match_id"),
        side_of(key).alias("side_index"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("played_at"),
        F.col("o_orderpriority").alias("mode"),
        F.concat(F.lit("V"), F.year("o_orderdate")).alias("version"),
        F.when(price < 20000, "unknown").otherwise(result_of(F.col("o_orderstatus"))).alias("match_result"),
        result_of(F.col("o_orderstatus")).alias("result"),
        F.concat(F.lit("P"), cust).alias("player_name"),
        F.when(cust % 2 == 0, (cust % 1000).cast("int")).alias("rank"),
        tier_of(F.col("c_acctbal")).alias("rank_order"),
        F.concat(F.greatest(F.lit(0), F.floor(price / 5000) - 20), F.lit("%")).alias("castle_rate"),
        F.col("n_name").alias("weapon"),
        F.col("c_mktsegment").alias("style"),
        F.col("c_nationkey").alias("contributor"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("unix_time"),
    )


def lines(spark: SparkSession, sf_dir: str, card: str = "p_type", souls: bool = True) -> DataFrame:
    """One row per card of a deck."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    if souls:
        li = li.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
        li = li.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    key = F.col("l_orderkey")
    percent = lambda c: F.concat(F.round(F.col(c) * 100).cast("int"), F.lit("%"))
    return li.select(
        key.alias("order_key"),
        match_of(key).alias("match_id"),
        side_of(key).alias("side_index"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col(card).alias("card"),
        F.col("l_quantity").alias("quantity"),
        percent("l_discount").alias("player"),
        percent("l_tax").alias("enemy"),
        *([F.col("n_name").alias("soul")] if souls else []),
    )


def bouts(spark: SparkSession, sf_dir: str, card: str = "p_type") -> DataFrame:
    """Contests as bouts: one shuffle of the orders, one of the line items, and a join that reuses both."""
    def mine(column: Column, side: int) -> Column:
        return F.first(F.when(F.col("side_index") == side, column), ignorenulls=True)

    has_castle = (F.col("side_index") == 1) & (F.col("match_id") % 3 == 0)
    packed = (
        lines(spark, sf_dir, card)
        .repartition("match_id")
        .groupBy("match_id", "side_index")
        .agg(
            F.sort_array(F.collect_list(F.struct("line", "part", "card"))).alias("slots"),
            F.sort_array(F.collect_set("soul")).alias("souls"),
            F.sum("quantity").alias("kills"),
            F.count("line").alias("lines"),
            F.collect_list(F.when(has_castle, F.struct("player", F.lit("").alias("label"), "enemy"))).alias("castle_rows"),
        )
        .withColumn("deck", F.struct(F.col("slots.card").alias("cards"), "souls", "kills", "lines"))
        .groupBy("match_id")
        .agg(
            mine(F.col("deck"), 1).alias("d1"),
            mine(F.col("deck"), 2).alias("d2"),
            mine(F.col("castle_rows"), 1).alias("castle_rows"),
        )
    )
    own = F.struct("player_name", "contributor", "result", "castle_rate", "rank", "rank_order", "weapon", "style")
    pairs = (
        orders(spark, sf_dir)
        .repartition("match_id")
        .groupBy("match_id")
        .agg(
            mine(F.struct("played_at", "mode", "version", "match_result"), 1).alias("h"),
            mine(own, 1).alias("s1"),
            mine(own, 2).alias("s2"),
        )
    )

    def side(n: int) -> Column:
        s, d = F.col(f"s{n}"), F.col(f"d{n}")
        return F.when(
            s.isNotNull(),
            F.struct(
                F.lit(n).alias("side_index"),
                F.lit("player" if n == 1 else "enemy").alias("role"),
                s["player_name"].alias("player_name"),
                s["contributor"].cast("string").alias("follow_id"),
                s["result"].alias("result"),
                s["castle_rate"].alias("castle_rate"),
                s["rank"].alias("rank"),
                s["rank_order"].alias("rank_order"),
                F.when(F.col("match_id") % 4 != 0, d["kills"]).alias("kill_count"),
                (10.0 * d["lines"]).alias("death_count"),
                s["weapon"].alias("weapon"),
                s["style"].alias("style"),
                d["souls"].alias("souls"),
                d["cards"].alias("cards"),
                decks.fingerprint(d["cards"]).alias("deck_fingerprint"),
            ),
        )

    return pairs.join(packed, "match_id", "left").select(
        "match_id", "h.played_at", "h.mode", "h.version", F.col("h.match_result").alias("result"),
        "castle_rows", F.array_compact(F.array(side(1), side(2))).alias("sides"),
    )


def card_dim(spark: SparkSession, card: str = "p_type") -> DataFrame:
    """Cards with their costs; the brand variant spreads the same costs over 25 cards."""
    if card == "p_type":
        rows = [(name, cost) for name, cost in CARD_COSTS.items()]
    else:
        costs = sorted(CARD_COSTS.values())
        rows = [(f"Brand#{i}", costs[i % len(costs)]) for i in range(1, 26)]
    return spark.createDataFrame(rows, "card_hash string, cost double")


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as sightings: some full, some light, with replay and detail names that overlap now and then."""
    site = "https://site.example/members"
    price, k = F.col("o_totalprice"), F.col("o_orderkey")
    base = table(spark, sf_dir, "orders").select(
        k.alias("seq"),
        (k % 5 == 0).alias("light"),
        F.when(k % 3 != 0, F.concat(F.lit("R"), match_of(k))).otherwise("").alias("replay_id"),
        F.concat(F.lit("F"), F.col("o_custkey") % 40).alias("follow_id"),
        F.when(k % 4 != 1, F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string")).otherwise("").alias("detail_t"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("played_at"),
        F.when(k % 7 == 0, "").otherwise(F.col("o_orderpriority")).alias("mode"),
        F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("V"), F.year("o_orderdate"))).alias("version"),
        F.when(price < 20000, "unknown").otherwise(result_of(F.col("o_orderstatus"))).alias("result"),
        F.concat(F.lit("P"), "o_custkey").alias("player_name"),
    )
    page = F.concat(F.lit(f"{site}/history/detail?f="), "follow_id", F.lit("&t="), "detail_t")
    play = F.concat(F.lit(f"{site}/enbujyo/play?p="), "replay_id")
    empty = F.lit("").alias
    person = F.struct(
        F.lit(1).alias("side_index"), F.lit("player").alias("role"), "player_name", "follow_id", "result", empty("castle_rate"),
        F.lit("{}").alias("profile"), F.lit("{}").alias("selected"), F.array().cast("array<string>").alias("deck_ids"),
    )
    row = F.struct(F.lit("1%").alias("player"), F.lit("x").alias("label"), F.lit("2%").alias("enemy"))
    return base.select(
        *[c for c in base.columns if c != "player_name"],
        F.when(F.col("detail_t") != "", page).otherwise("").alias("detail_url"),
        F.when(F.col("replay_id") != "", play).otherwise("").alias("play_url"),
        empty("m3u8_url"), empty("source_url"), F.concat(F.lit("t"), "seq").alias("title"), empty("detail_error"), empty("castle_title"),
        F.when(F.col("seq") % 3 == 1, F.array(row)).otherwise(F.array().cast(row_type())).alias("castle_rows"),
        F.array().cast("array<string>").alias("timeline_labels"), F.lit("{}").alias("timeline_data"),
        F.when(F.col("seq") % 11 != 0, F.array(person)).otherwise(F.slice(F.array(person), 1, 0)).alias("players"),
    )


def row_type() -> str:
    return "array<struct<player:string,label:string,enemy:string>>"


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests as merged matches with JSON pockets, as the store holds and packages carry them."""
    def profile(s: Column) -> Column:
        ranking = F.when(s["rank"].isNotNull(), s["rank"].cast("string"))
        order = s["rank_order"]  # as the certificate number that stands for the same class
        certificate = F.when(order <= 20, "1").when(order < 50, "10").when(order == 50, "50").when(order > 50, "100")
        stats = F.struct(
            F.struct(s["death_count"].alias("total")).alias("death_count"), F.struct(s["kill_count"].alias("total")).alias("kill_count")
        )
        return F.to_json(F.struct(stats.alias("battle_stats"), ranking.alias("全国主君ランキング"), certificate.alias(CERTIFICATE_KEYS[0])))

    def selected(s: Column) -> Column:
        souls = F.transform(s["souls"], lambda n: F.struct(n.alias("name")))
        return F.to_json(
            F.struct(F.struct(s["style"].alias("name")).alias("school"), souls.alias("souls"), F.struct(s["weapon"].alias("name")).alias("weapon"))
        )

    def person(s: Column) -> Column:
        return F.struct(
            s["side_index"].alias("side_index"), s["role"].alias("role"), s["player_name"].alias("player_name"), s["follow_id"].alias("follow_id"),
            s["result"].alias("result"), s["castle_rate"].alias("castle_rate"), profile(s).alias("profile"), selected(s).alias("selected"),
            F.coalesce(s["cards"], F.array().cast("array<string>")).alias("deck_ids"),
        )

    replay = F.concat(F.lit("R"), "match_id")
    empty = F.lit("").alias
    return bouts(spark, sf_dir).select(
        F.concat(F.lit("r:"), replay).alias("public_id"), replay.alias("replay_id"), empty("detail_t"), empty("primary_follow_id"), "played_at", "mode", "version", "result",
        empty("detail_url"), F.concat(F.lit("https://site.example/members/enbujyo/play?p="), replay).alias("play_url"), empty("m3u8_url"), empty("source_url"),
        F.concat(F.lit("t"), "match_id").alias("title"), empty("detail_error"), empty("castle_title"),
        F.coalesce("castle_rows", F.array().cast(row_type())).alias("castle_rows"), F.array().cast("array<string>").alias("timeline_labels"),
        F.lit('{"castle":{"enemy":[],"player":[]}}').alias("timeline_data"), F.transform("sides", person).alias("players"),
        F.get("sides", F.lit(0))["follow_id"].alias("contributor"),
    )
