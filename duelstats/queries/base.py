"""Registry of the checkable queries and the SQL reading of the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RESULT = "CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'loss' WHEN 'P' THEN 'draw' ELSE 'unknown' END"
SIDE_RESULT = (
    "CASE WHEN s.side_index = 1 OR h.match_result NOT IN ('win', 'loss') THEN h.match_result "
    "WHEN h.match_result = 'win' THEN 'loss' ELSE 'win' END"
)

# The tables read as contests: the SQL twin of duelstats.sources.contest_tables.
CONTESTS = f"""
WITH line AS (
  SELECT l_orderkey AS order_key, l_linenumber AS ln, l_partkey AS pk, p_type AS card, p_brand AS brand, l_quantity AS qty,
         CAST(round(l_discount * 100) AS INT) AS player, CAST(round(l_tax * 100) AS INT) AS enemy, n_name AS soul
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey
  LEFT JOIN nation ON n_nationkey = s_nationkey),
deck AS (
  SELECT order_key, string_agg(card, ',' ORDER BY card) AS fp, string_agg(DISTINCT card, ',' ORDER BY card) AS card_set,
         string_agg(card, '|' ORDER BY ln, pk) AS slots, sum(qty) AS kills, 10.0 * count(*) AS deaths
  FROM line GROUP BY 1),
castle AS (
  SELECT order_key // 2 AS match_id, CAST(sum(player) AS DOUBLE) AS player_total, CAST(sum(enemy) AS DOUBLE) AS enemy_total
  FROM line WHERE order_key % 2 = 0 AND (order_key // 2) % 3 = 0 GROUP BY 1),
header AS (
  SELECT o_orderkey // 2 AS match_id, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS played_at, o_orderpriority AS mode,
         'V' || year(o_orderdate) AS version, CASE WHEN o_totalprice < 20000 THEN 'unknown' ELSE {RESULT} END AS match_result
  FROM orders WHERE o_orderkey % 2 = 0),
side AS (
  SELECT o_orderkey // 2 AS match_id, CAST(o_orderkey % 2 + 1 AS INT) AS side_index, 'P' || o_custkey AS player_name,
         {RESULT} AS own_result, CAST(greatest(0, floor(o_totalprice / 5000) - 20) AS DOUBLE) AS rate,
         CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey % 1000 AS INT) END AS rank,
         CASE WHEN c_acctbal < 0 THEN 10 WHEN c_acctbal < 2000 THEN 20 WHEN c_acctbal < 4000 THEN 30
              WHEN c_acctbal < 6000 THEN 40 WHEN c_acctbal < 8000 THEN 50 WHEN c_acctbal < 9000 THEN 70 END AS rank_order,
         n_name AS weapon, c_mktsegment AS style, c_nationkey AS contributor, o_orderkey AS order_key, fp, card_set, slots,
         CASE WHEN (o_orderkey // 2) % 4 <> 0 THEN kills END AS kill_count, deaths AS death_count
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN deck ON order_key = o_orderkey),
raw_sample AS (
  SELECT s.match_id, s.side_index, s.order_key, h.mode, h.version, h.played_at, {SIDE_RESULT} AS result,
         CASE WHEN h.match_result = 'unknown' THEN s.own_result ELSE {SIDE_RESULT} END AS board_result,
         s.player_name, s.rank, s.rank_order, s.weapon, s.style, s.fp AS deck_fingerprint, s.rate AS own, o.rate AS opp,
         s.rate - o.rate AS diff, coalesce(o.rate <= 0, false) AS crash, coalesce(s.rate <= 0, false) AS crashed,
         coalesce(CASE s.side_index WHEN 1 THEN enemy_total ELSE player_total END, 100 - o.rate) AS dealt,
         coalesce(CASE s.side_index WHEN 1 THEN player_total ELSE enemy_total END, 100 - s.rate) AS taken,
         s.kill_count, s.death_count
  FROM header h JOIN side s USING (match_id) LEFT JOIN side o ON o.match_id = s.match_id AND o.side_index = 3 - s.side_index
  LEFT JOIN castle c ON c.match_id = s.match_id WHERE s.fp IS NOT NULL),
sample AS (SELECT * FROM raw_sample WHERE mode <> '5-LOW'),
known AS (SELECT * FROM sample WHERE result <> 'unknown'),
cost(card, cost) AS (VALUES ('ECONOMY', 1.0::DOUBLE), ('LARGE', 1.5), ('MEDIUM', 2.0), ('PROMO', 2.5), ('SMALL', 3.0), ('STANDARD', 3.5))"""

SCOPED = (
    CONTESTS
    + """,
scoped AS (
  SELECT k.*, sample_scope, version_scope FROM known k,
    (VALUES ('all_players'), ('all_ranker'), ('high_ranker_top100')) a(sample_scope), (SELECT unnest([0, 1]) AS own_version) v,
    LATERAL (SELECT CASE own_version WHEN 0 THEN 'all_versions' ELSE k.version END AS version_scope)
  WHERE sample_scope = 'all_players' OR (sample_scope = 'all_ranker' AND rank IS NOT NULL)
     OR (sample_scope = 'high_ranker_top100' AND rank <= 100))"""
)

BOARD = (
    CONTESTS
    + """,
board AS (
  SELECT s.*, rank_scope FROM sample s, (VALUES ('all'), ('traveler_down'), ('knight_down'), ('knight_up')) a(rank_scope)
  WHERE rank_scope = 'all' OR (rank_scope = 'traveler_down' AND rank_order <= 20)
     OR (rank_scope = 'knight_down' AND rank_order <= 50) OR (rank_scope = 'knight_up' AND rank_order >= 50))"""
)


def counts_sql(result: str = "result") -> str:
    return "CAST(count(*) AS BIGINT) AS sample_count, " + ", ".join(
        f"CAST(count(*) FILTER (WHERE {result} = '{r}') AS BIGINT) AS {r}_count" for r in ("win", "loss", "draw")
    )


def win_rate_sql(w: str = "win_count", n: str = "loss_count") -> str:
    return f"CASE WHEN {w} + {n} > 0 THEN round(CAST({w} AS DOUBLE) / ({w} + {n}), 6) END"


def raw_wilson_sql(w: str = "win_count", n: str = "loss_count") -> str:
    """Same operations in the same order as the Column expression, so that ties break alike."""
    t = f"CAST({w} + {n} AS DOUBLE)"
    p = f"({w} / {t})"
    z = "1.96::DOUBLE * 1.96::DOUBLE"
    return (
        f"CASE WHEN {w} + {n} > 0 THEN ({p} + {z} / (2 * {t}) - "
        f"sqrt(({p} * (1 - {p}) + {z} / (4 * {t})) / {t}) * 1.96::DOUBLE) / (1 + {z} / {t}) END"
    )


def wilson_sql(w: str = "win_count", n: str = "loss_count") -> str:
    return f"round({raw_wilson_sql(w, n)}, 6)"


def rounded(df: DataFrame) -> DataFrame:
    """Round every double to six places, as the SQL does."""
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
