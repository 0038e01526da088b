"""Checkable queries: leaderboards, behaviour, matchups."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from duelstats.operators import boards, clustering, facts, matchups, samples
from duelstats.operators.ranking import page, ranked
from duelstats.plans import leaderboard as jobs
from duelstats.queries.analysis import CLUSTER_SQL, CORE_SQL
from duelstats.queries.base import BOARD, CONTESTS, ORACLES, counts_sql, query, raw_wilson_sql, win_rate_sql, wilson_sql
from duelstats.session import cut
from duelstats.sources import contest_tables as ct

CFG = ct.CONFIG
V1999 = replace(CFG, version="V1999")
DECK, KEYS = "deck_fingerprint", ["rank_scope", "deck_fingerprint"]


def _scoped(spark, d):
    return samples.in_scope(ct.bouts(spark, d), CFG)


def _samples(spark, d):
    return samples.side_samples(_scoped(spark, d))


DECKS_SQL = (
    BOARD
    + f""",
deck_count AS (SELECT rank_scope, deck_fingerprint, {counts_sql('board_result')} FROM board GROUP BY 1, 2),
card_count AS (
  SELECT rank_scope, card_hash, {counts_sql('board_result')}
  FROM (SELECT *, unnest(list_distinct(string_split(deck_fingerprint, ','))) AS card_hash FROM board) GROUP BY 1, 2)"""
)
SCORES = f"{win_rate_sql()} AS win_rate, {wilson_sql()} AS wilson_lower_bound"
ORDER = f"coalesce({raw_wilson_sql()}, 0) DESC, sample_count DESC, win_count DESC"


@query("ag7_deck_board", DECKS_SQL + f"SELECT *, {SCORES} FROM deck_count")
def ag7(spark, d):
    return boards.scored(boards.deck_counts(_samples(spark, d)))


@query("ag8_card_board", DECKS_SQL + f"SELECT *, {SCORES} FROM card_count")
def ag8(spark, d):
    return boards.scored(boards.card_counts(boards.deck_counts(_samples(spark, d))))


@query(
    "wn1_deck_ranks",
    DECKS_SQL
    + f"""SELECT rank_scope, deck_fingerprint, sample_count, row_number() OVER (PARTITION BY rank_scope ORDER BY {ORDER}, deck_fingerprint DESC) AS rank
FROM deck_count""",
)
def wn1(spark, d):
    return jobs.ranked_decks(boards.deck_counts(_samples(spark, d))).select(*KEYS, "sample_count", "rank")


@query(
    "srt2_card_ranks",
    DECKS_SQL
    + f"""SELECT rank_scope, card_hash, sample_count, row_number() OVER (PARTITION BY rank_scope ORDER BY {ORDER}, card_hash DESC) AS rank
FROM card_count""",
)
def srt2(spark, d):
    counts = boards.card_counts(boards.deck_counts(_samples(spark, d)))
    return boards.ranked_board(counts, "card_hash").select("rank_scope", "card_hash", "sample_count", "rank")


PAGED_SQL = (
    DECKS_SQL
    + f""", numbered AS (
  SELECT *, {raw_wilson_sql()} AS w, row_number() OVER (ORDER BY {ORDER}, deck_fingerprint DESC) AS rank
  FROM deck_count WHERE rank_scope = 'knight_down')
SELECT deck_fingerprint, sample_count, rank FROM numbered """
)


def _paged(spark, d, **request):
    numbered = jobs.ranked_decks(boards.deck_counts(_samples(spark, d)).where(F.col("rank_scope") == "knight_down"))
    return page(numbered, **request).select("deck_fingerprint", "sample_count", "rank")


@query("srt4_page_by_sample", PAGED_SQL + "ORDER BY sample_count DESC, coalesce(w, 0) DESC, rank LIMIT 80 OFFSET 40")
def srt4_sample(spark, d):
    return _paged(spark, d, sort_key="sample", offset=40, limit=80)


@query("srt4_page_by_rank", PAGED_SQL + "ORDER BY rank LIMIT 80 OFFSET 40")
def srt4_rank(spark, d):
    return _paged(spark, d, sort_key="wilson", offset=40, limit=80)


@query(
    "ag19_scope_totals",
    BOARD + "SELECT rank_scope, count(DISTINCT match_id) AS match_count, count(*) AS side_sample_count FROM board GROUP BY 1",
)
def ag19(spark, d):
    return boards.scope_totals(_samples(spark, d))


PLAYERS_SQL = (
    BOARD
    + """,
player AS (SELECT rank_scope, deck_fingerprint, player_name, count(*) AS n FROM board GROUP BY 1, 2, 3),
player_rank AS (SELECT *, row_number() OVER (PARTITION BY rank_scope, deck_fingerprint ORDER BY n DESC, player_name) AS k FROM player),
people AS (
  SELECT rank_scope, deck_fingerprint, count(*) AS player_count, arg_min(player_name, k) AS top_player, max(n) AS top_player_count,
         CAST(sum(n) FILTER (WHERE k <= 3) AS BIGINT) AS top3_count, CAST(sum(n) AS BIGINT) AS sample_count
  FROM player_rank GROUP BY 1, 2)"""
)


def _players(rows):
    """The players' facets, written once for the totals and the most frequent ones."""
    return cut(boards.facets(rows, kinds=("player",)))


@query("ag10_player_concentration", PLAYERS_SQL + "SELECT * EXCLUDE (sample_count) FROM people")
def ag10(spark, d):
    return boards.concentration(_players(_samples(spark, d)), DECK)


@query(
    "ag14_credibility",
    PLAYERS_SQL
    + """SELECT rank_scope, deck_fingerprint, player_count, sample_count, round(CAST(top3_count AS DOUBLE) / sample_count, 6) AS top3_player_share,
  CASE WHEN sample_count >= 500 AND player_count >= 30 AND top3_count < 0.5 * sample_count THEN 'high'
       WHEN sample_count >= 200 AND player_count >= 15 AND top3_count < 0.7 * sample_count THEN 'medium' ELSE 'low' END AS label
FROM people""",
)
def ag14(spark, d):
    rows = cut(_samples(spark, d).drop("cards", "souls"))
    return boards.trust(boards.deck_counts(rows), boards.concentration(_players(rows), DECK), DECK)


def _mix_sql(column: str) -> str:
    return (
        BOARD
        + f""",
named AS (SELECT rank_scope, deck_fingerprint, {column} AS name, {counts_sql('board_result')} FROM board GROUP BY 1, 2, 3),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY rank_scope, deck_fingerprint ORDER BY sample_count DESC, win_count DESC, name) AS k,
         sum(sample_count) OVER (PARTITION BY rank_scope, deck_fingerprint) AS all_n, sum(win_count) OVER (PARTITION BY rank_scope, deck_fingerprint) AS all_w
  FROM named),
folded AS (
  SELECT rank_scope, deck_fingerprint, least(k, 4) AS place, CASE WHEN k <= 3 THEN name ELSE '其他' END AS name,
         sum(sample_count) AS n, sum(win_count) AS w, sum(loss_count) AS l, max(all_n) AS all_n, max(all_w) AS all_w
  FROM placed GROUP BY 1, 2, 3, 4)
SELECT rank_scope, deck_fingerprint, CAST(place AS INT) AS place, name, CAST(n AS BIGINT) AS sample_count, CAST(w AS BIGINT) AS win_count,
  round(CAST(n AS DOUBLE) / all_n, 6) AS usage_rate, CASE WHEN all_w > 0 THEN round(CAST(w AS DOUBLE) / all_w, 6) END AS win_usage_rate,
  CASE WHEN n >= 20 AND w + l > 0 THEN round(CAST(w AS DOUBLE) / (w + l), 6) END AS conditional_win_rate, n < 20 AS low_sample
FROM folded"""
    )


@query("ag11_weapon_mix", _mix_sql("weapon"))
def ag11(spark, d):
    return boards.category_mix(cut(boards.facets(_samples(spark, d))), DECK, "weapon")


@query("ag11_style_mix", _mix_sql("style"))
def ag11_style(spark, d):
    return boards.category_mix(cut(boards.facets(_samples(spark, d))), DECK, "style")


@query(
    "ag12_soul_mix",
    DECKS_SQL
    + f""",
soul AS (SELECT DISTINCT order_key, soul FROM line),
named AS (SELECT rank_scope, deck_fingerprint, soul AS name, {counts_sql('board_result')} FROM board JOIN soul USING (order_key) GROUP BY 1, 2, 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY rank_scope, deck_fingerprint ORDER BY sample_count DESC, win_count DESC, name) AS k FROM named)
SELECT p.rank_scope, p.deck_fingerprint, CAST(k AS INT) AS place, name, p.sample_count, p.win_count,
  round(CAST(p.sample_count AS DOUBLE) / t.sample_count, 6) AS usage_rate,
  CASE WHEN t.win_count > 0 THEN round(CAST(p.win_count AS DOUBLE) / t.win_count, 6) END AS win_usage_rate,
  CASE WHEN p.sample_count >= 20 AND p.win_count + p.loss_count > 0 THEN round(CAST(p.win_count AS DOUBLE) / (p.win_count + p.loss_count), 6) END AS conditional_win_rate,
  p.sample_count < 20 AS low_sample
FROM placed p JOIN deck_count t USING (rank_scope, deck_fingerprint) WHERE k <= 3""",
)
def ag12(spark, d):
    rows = _samples(spark, d)
    return boards.soul_mix(boards.facets(rows), boards.deck_counts(rows), DECK)


def _trend_sql(anchor: str) -> str:
    return (
        DECKS_SQL
        + f""",
day AS (SELECT *, CAST(substr(played_at, 1, 10) AS DATE) AS day FROM board),
aged AS (SELECT *, {anchor} - day AS age FROM day),
sums AS (
  SELECT rank_scope, deck_fingerprint,
    count(*) FILTER (WHERE age BETWEEN 0 AND 6) AS n1, count(*) FILTER (WHERE age BETWEEN 7 AND 13) AS n2,
    count(*) FILTER (WHERE age BETWEEN 0 AND 6 AND board_result = 'win') AS w1, count(*) FILTER (WHERE age BETWEEN 0 AND 6 AND board_result = 'loss') AS l1,
    count(*) FILTER (WHERE age BETWEEN 7 AND 13 AND board_result = 'win') AS w2, count(*) FILTER (WHERE age BETWEEN 7 AND 13 AND board_result = 'loss') AS l2
  FROM aged GROUP BY 1, 2)
SELECT rank_scope, deck_fingerprint, n1 AS last_7d_sample_count, {win_rate_sql('w1', 'l1')} AS last_7d_win_rate,
  n2 AS previous_7d_sample_count, {win_rate_sql('w2', 'l2')} AS previous_7d_win_rate,
  CASE WHEN w1 + l1 > 0 AND w2 + l2 > 0 THEN round(CAST(w1 AS DOUBLE) / (w1 + l1) - CAST(w2 AS DOUBLE) / (w2 + l2), 6) END AS delta_7d
FROM sums"""
    )


@query("ag13_trend", _trend_sql("DATE '2001-07-31'"))
def ag13(spark, d):
    rows = _samples(spark, d)
    return boards.trend(boards.facets(rows), boards.deck_counts(rows), DECK, CFG.anchor)


@query("ag13_trend_own_anchor", _trend_sql("max(day) OVER (PARTITION BY rank_scope, deck_fingerprint)"))
def ag13_own(spark, d):
    rows = _samples(spark, d)
    return boards.trend(boards.facets(rows), boards.deck_counts(rows), DECK, "")


RECENT_SQL = (
    BOARD
    + """,
late AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rank_scope, deck_fingerprint
    ORDER BY played_at DESC, player_name DESC, weapon DESC, style DESC, match_id DESC, side_index DESC) AS back FROM board) WHERE back <= 30)"""
)


@query("wn2_recent_samples", RECENT_SQL + "SELECT rank_scope, deck_fingerprint, match_id, side_index, played_at, board_result AS result FROM late")
def wn2(spark, d):
    return boards.deck_recent(_samples(spark, d)).select(*KEYS, "match_id", "side_index", "played_at", "result")


@query(
    "wn3_running_rate",
    RECENT_SQL
    + """, pt AS (
  SELECT rank_scope, deck_fingerprint, played_at, board_result AS result, row_number() OVER w AS index,
    count(*) FILTER (WHERE board_result = 'win') OVER w AS wins, count(*) FILTER (WHERE board_result = 'loss') OVER w AS losses
  FROM late WINDOW w AS (PARTITION BY rank_scope, deck_fingerprint ORDER BY back DESC))
SELECT rank_scope, deck_fingerprint, CAST(index AS INT) AS index, substr(played_at, 1, 10) AS date, played_at, result,
  CASE WHEN wins + losses > 0 THEN round(CAST(wins AS DOUBLE) / (wins + losses), 6) END AS rolling_win_rate FROM pt""",
)
def wn3(spark, d):
    return boards.recent_points(boards.deck_recent(_samples(spark, d)), DECK)


BOARD_CLUSTERS = (
    DECKS_SQL.replace("WITH line", "WITH RECURSIVE line")
    + f""",
ranked_deck AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY rank_scope ORDER BY {ORDER}, deck_fingerprint DESC) AS r FROM deck_count),
priced AS (
  SELECT rank_scope, r, card, cost FROM (SELECT rank_scope, r, unnest(list_distinct(string_split(deck_fingerprint, ','))) AS card FROM ranked_deck) JOIN cost USING (card) WHERE cost > 0),
deck_set AS MATERIALIZED (SELECT rank_scope, r, string_agg(card, ',' ORDER BY card) AS cards FROM priced GROUP BY 1, 2 HAVING sum(cost) >= 5.0),
card_set AS MATERIALIZED (
  SELECT rank_scope, cards, min(r) AS first, row_number() OVER (PARTITION BY rank_scope ORDER BY min(r)) AS i FROM deck_set GROUP BY 1, 2),
set_card AS (SELECT rank_scope, i, card, cost FROM (SELECT rank_scope, i, unnest(string_split(cards, ',')) AS card FROM card_set) JOIN cost USING (card)),
near AS MATERIALIZED (
  SELECT rank_scope, ib, list(ia ORDER BY ia) AS near_sets FROM (
    SELECT a.rank_scope, a.i AS ib, b.i AS ia FROM set_card a JOIN set_card b ON a.rank_scope = b.rank_scope AND a.card = b.card AND b.i < a.i GROUP BY 1, 2, 3 HAVING sum(a.cost) >= 5.0)
  GROUP BY 1, 2),
walk AS (
  SELECT DISTINCT rank_scope, 0::BIGINT AS i, []::BIGINT[] AS reps, NULL::BIGINT AS leader FROM card_set
  UNION ALL
  SELECT w.rank_scope, w.i + 1, CASE WHEN hit IS NULL THEN list_append(reps, w.i + 1) ELSE reps END, coalesce(hit, w.i + 1)
  FROM walk w JOIN card_set c ON c.rank_scope = w.rank_scope AND c.i = w.i + 1 LEFT JOIN near n ON n.rank_scope = w.rank_scope AND n.ib = w.i + 1,
    LATERAL (SELECT list_min(list_intersect(n.near_sets, w.reps)) AS hit)),
member AS MATERIALIZED (
  SELECT d.*, coalesce(h.first, d.r) AS leader
  FROM ranked_deck d LEFT JOIN deck_set s USING (rank_scope, r) LEFT JOIN card_set c USING (rank_scope, cards)
  LEFT JOIN walk w ON w.rank_scope = c.rank_scope AND w.i = c.i LEFT JOIN card_set h ON h.rank_scope = w.rank_scope AND h.i = w.leader)"""
)


def _clusters(spark, d):
    counts = cut(boards.deck_counts(_samples(spark, d)))
    return counts, cut(jobs.archetype_members(cut(jobs.ranked_decks(counts)), ct.card_dim(spark)))


@query("gr1_board_archetypes", BOARD_CLUSTERS + "SELECT rank_scope, r AS rank, leader, deck_fingerprint FROM member")
def gr1(spark, d):
    return _clusters(spark, d)[1].select("rank_scope", "rank", "leader", "deck_fingerprint")


@query(
    "ag17_archetype_board",
    BOARD_CLUSTERS
    + f""", rolled AS (
  SELECT rank_scope, arg_min(deck_fingerprint, r) AS representative, CAST(sum(sample_count) AS BIGINT) AS sample_count, CAST(sum(win_count) AS BIGINT) AS win_count,
    CAST(sum(loss_count) AS BIGINT) AS loss_count, CAST(sum(draw_count) AS BIGINT) AS draw_count FROM member GROUP BY rank_scope, leader)
SELECT *, {SCORES}, row_number() OVER (PARTITION BY rank_scope ORDER BY {ORDER}, representative DESC) AS rank FROM rolled""",
)
def ag17(spark, d):
    counts, members = _clusters(spark, d)
    return jobs.archetype_board(boards.regrouped(counts, members.select(*KEYS, "representative")))


WIDE_SQL = (
    """WITH RECURSIVE owned AS (
  SELECT o_custkey AS owner, count(*) AS n, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS deck_fingerprint
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1),
cost AS (SELECT 'Brand#' || i AS card, [1.0, 1.5, 2.0, 2.5, 3.0, 3.5][i % 6 + 1]::DOUBLE AS cost FROM range(1, 26) t(i))"""
    + CLUSTER_SQL.replace("sum(a.cost) >= 5.0", "sum(a.cost) >= 46.0").format(wilson="n", ties="owner", base="(SELECT *, 0 AS sample_count FROM owned)")
)


def _wide(spark, d):
    """A customer's deck: the brands of all parts they ordered, up to 25."""
    lines = ct.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    owned = lines.join(ct.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").join(ct.table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    decks = owned.groupBy(F.col("o_custkey").alias("owner")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("deck_fingerprint"))
    return cut(ranked(decks.withColumn("board", F.lit("wide")), ["board"], [F.col("n").desc(), F.col("owner").asc()]))


@query("gr1_wide_decks", WIDE_SQL + "SELECT owner, r AS rank, leader FROM member")
def gr1_wide(spark, d):
    numbered = _wide(spark, d)
    found = clustering.leaders(numbered, ct.card_dim(spark, "p_brand"), 46.0, "board")
    return found.join(numbered.select("board", "rank", "owner"), ["board", "rank"]).select("owner", "rank", "leader")


@query("jn9_wide_decks", WIDE_SQL + "SELECT rb AS rank, CAST(min(ra) AS BIGINT) AS first_similar FROM edge GROUP BY 1")
def jn9_wide(spark, d):
    return clustering.first_similar(_wide(spark, d), ct.card_dim(spark, "p_brand"), 46.0, "board").drop("board")


BOARD_CORE_SQL = CORE_SQL.replace("leader", "rank_scope, leader").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3")


@query(
    "fn37_archetype_titles",
    BOARD_CLUSTERS
    + BOARD_CORE_SQL
    + """SELECT c.rank_scope, substr(sha256('archetype:' || any_value(q.deck_fingerprint)), 1, 16) AS archetype_id,
  string_agg(card, ' / ' ORDER BY place) FILTER (WHERE place <= 3) || ' 系' AS title
FROM core c JOIN ranked_deck q ON q.rank_scope = c.rank_scope AND q.r = c.leader WHERE place <= 5 AND spent < 5.0 GROUP BY c.rank_scope, leader""",
)
def fn37(spark, d):
    counts, members = _clusters(spark, d)
    board = jobs.archetype_board(boards.regrouped(counts, members.select(*KEYS, "representative")))
    return jobs.describe(board, members, ct.card_dim(spark), 5.0).select("rank_scope", "archetype_id", "title")


CELLS_SQL = (
    BOARD
    + f""",
pair AS (
  SELECT a.rank_scope, a.match_id, a.side_index, a.deck_fingerprint AS row_fingerprint, b.deck_fingerprint AS column_fingerprint, a.board_result
  FROM board a JOIN sample b ON a.match_id = b.match_id AND a.side_index <> b.side_index AND a.deck_fingerprint <> b.deck_fingerprint),
cell_count AS (SELECT rank_scope, row_fingerprint, column_fingerprint, {counts_sql('board_result')} FROM pair GROUP BY 1, 2, 3),
cell AS (
  SELECT *, {win_rate_sql()} AS win_rate, sample_count >= 5 AND win_count + loss_count > 0 AS visible,
    CASE WHEN sample_count < 5 OR win_count + loss_count = 0 THEN 'empty' WHEN CAST(win_count AS DOUBLE) / (win_count + loss_count) >= 0.55::DOUBLE THEN 'advantage'
         WHEN CAST(win_count AS DOUBLE) / (win_count + loss_count) <= 0.45::DOUBLE THEN 'disadvantage' ELSE 'even' END AS tone
  FROM cell_count)"""
)


@query("jn7_matchup_pairs", CELLS_SQL + "SELECT match_id, side_index, row_fingerprint, column_fingerprint, board_result AS result FROM pair WHERE rank_scope = 'all'")
def jn7(spark, d):
    return matchups.pairs(_scoped(spark, d)).drop("order_class")


@query("ag9_matchup_cells", CELLS_SQL + "SELECT * FROM cell")
def ag9(spark, d):
    return matchups.cells(matchups.pairs(_scoped(spark, d)))


AXIS_SQL = (
    CELLS_SQL
    + f""",
deck_count AS (SELECT rank_scope, deck_fingerprint, {counts_sql('board_result')} FROM board GROUP BY 1, 2),
axis AS (
  SELECT *, row_number() OVER (PARTITION BY rank_scope ORDER BY coalesce(CASE WHEN win_count + loss_count > 0 THEN CAST(win_count AS DOUBLE) / (win_count + loss_count) END, -1) DESC,
    sample_count DESC, coalesce({raw_wilson_sql()}, 0) DESC, deck_fingerprint) AS matrix_index FROM deck_count QUALIFY matrix_index <= 20)"""
)


@query("srt3_matrix_axis", AXIS_SQL + f"SELECT rank_scope, deck_fingerprint, CAST(matrix_index AS INT) AS matrix_index, sample_count, {win_rate_sql()} AS win_rate FROM axis")
def srt3(spark, d):
    counts = boards.deck_counts(samples.side_samples(_scoped(spark, d)))
    return matchups.axis(counts).select(*KEYS, "matrix_index", "sample_count", "win_rate")


MATRIX_SQL = (
    AXIS_SQL
    + """SELECT r.rank_scope, r.deck_fingerprint AS row_fingerprint, c.deck_fingerprint AS column_fingerprint, CAST(r.matrix_index AS INT) AS row_index,
  CAST(c.matrix_index AS INT) AS column_index, coalesce(x.sample_count, 0) AS sample_count, coalesce(x.win_count, 0) AS win_count,
  coalesce(x.loss_count, 0) AS loss_count, coalesce(x.draw_count, 0) AS draw_count, x.win_rate, coalesce(visible, false) AS visible, coalesce(tone, 'empty') AS tone
FROM axis r JOIN axis c ON r.rank_scope = c.rank_scope
LEFT JOIN cell x ON x.rank_scope = r.rank_scope AND x.row_fingerprint = r.deck_fingerprint AND x.column_fingerprint = c.deck_fingerprint"""
)


def _matrix(spark, d):
    bouts = _scoped(spark, d)
    axis = matchups.axis(boards.deck_counts(samples.side_samples(bouts)))
    return matchups.matrix(axis, matchups.cells(matchups.pairs(bouts)))


@query("jn8_matchup_matrix", MATRIX_SQL)
def jn8(spark, d):
    return _matrix(spark, d)


@query(
    "rs8_matrix_rows",
    f"SELECT rank_scope, row_index, string_agg(tone, ',' ORDER BY column_index) AS tones, CAST(sum(sample_count) AS BIGINT) AS samples FROM ({MATRIX_SQL}) GROUP BY 1, 2",
)
def rs8(spark, d):
    rows = _matrix(spark, d).groupBy("rank_scope", "row_index").agg(
        F.sort_array(F.collect_list(F.struct("column_index", "tone"))).alias("cells"), F.sum("sample_count").alias("samples")
    )
    return rows.select("rank_scope", "row_index", F.array_join("cells.tone", ",").alias("tones"), "samples")


@query("job6_matrix_totals", CELLS_SQL + "SELECT rank_scope, CAST(sum(sample_count) AS BIGINT) AS sample_count FROM cell GROUP BY 1")
def job6(spark, d):
    return matchups.matrix_totals(matchups.cells(matchups.pairs(_scoped(spark, d))))


# the names under which the queries over whole decks were first known
for _name, _fn in (("ag9_matchup_cells", ag9), ("srt3_matrix_axis", srt3), ("jn8_matchup_matrix", jn8), ("rs8_matrix_rows", rs8), ("job6_matrix_totals", job6)):
    query(f"{_name}_decks", ORACLES[_name])(_fn)


# what a profile shows of an entity: {entity} of the rows of {rows}
PROFILE_SQL = """,
shown AS (SELECT *, {entity} AS entity FROM {rows}),
whole AS (SELECT rank_scope, entity, count(*) AS sample_count FROM shown GROUP BY 1, 2),
person AS (SELECT rank_scope, entity, player_name, count(*) AS n, row_number() OVER (PARTITION BY rank_scope, entity ORDER BY count(*) DESC, player_name) AS k FROM shown GROUP BY 1, 2, 3),
crowd AS (SELECT rank_scope, entity, count(*) AS player_count, arg_min(player_name, k) AS top_player, sum(n) FILTER (WHERE k <= 3) AS top3 FROM person GROUP BY 1, 2),
trait AS (
  SELECT rank_scope, entity, least(count(DISTINCT weapon), 4) AS weapons, count(*) FILTER (WHERE date_diff('day', CAST(substr(played_at, 1, 10) AS DATE), DATE '2001-07-31') BETWEEN 0 AND 6) AS last_7d,
    least(count(*), 30) AS points FROM shown GROUP BY 1, 2),
spirit AS (SELECT rank_scope, entity, least(count(DISTINCT soul), 3) AS souls FROM shown JOIN (SELECT DISTINCT order_key, soul FROM line WHERE soul IS NOT NULL) USING (order_key) GROUP BY 1, 2),
profile AS (
  SELECT rank_scope, entity, sample_count, top_player, CAST(nullif(weapons, 0) AS INT) AS weapons, CAST(souls AS INT) AS souls, last_7d, CAST(points AS INT) AS points,
    CASE WHEN sample_count >= 500 AND player_count >= 30 AND top3 < 0.5 * sample_count THEN 'high'
         WHEN sample_count >= 200 AND player_count >= 15 AND top3 < 0.7 * sample_count THEN 'medium' ELSE 'low' END AS label
  FROM whole JOIN crowd USING (rank_scope, entity) JOIN trait USING (rank_scope, entity) LEFT JOIN spirit USING (rank_scope, entity))
"""


@query("job8_behaviour_profile", BOARD + PROFILE_SQL.format(entity="deck_fingerprint", rows="board") + "SELECT * RENAME (entity AS deck_fingerprint) FROM profile")
def job8(spark, d):
    scoped = cut(_scoped(spark, d))  # for the facts and the latest samples
    counted = cut(facts.daily(scoped, every_day=False))
    counts = cut(boards.scored(facts.deck_counts(counted)))
    built = boards.profile(counts, cut(facts.facets(counted, CFG.anchor)), boards.deck_recent(samples.side_samples(scoped)), DECK, CFG.anchor)
    return built.select(
        *KEYS, "sample_count", "top_player", F.size("weapons").alias("weapons"), F.size("souls").alias("souls"),
        F.col("trend.last_7d_sample_count").alias("last_7d"), F.size("last_30_points").alias("points"), F.col("credibility.label").alias("label"),
    )


@query(
    "ag19_totals_of_facts",
    BOARD + "SELECT rank_scope, count(DISTINCT match_id) AS match_count, count(*) AS side_sample_count FROM board GROUP BY 1",
)
def ag19_facts(spark, d):
    return facts.scope_totals(facts.daily(_scoped(spark, d)))


@query("ag9_cells_of_facts", CELLS_SQL + "SELECT * FROM cell")
def ag9_facts(spark, d):
    return facts.cells(facts.daily(_scoped(spark, d), every_day=False))


@query(
    "job4_leaderboard",
    DECKS_SQL.replace("FROM sample s,", "FROM sample s WHERE_VERSION,").replace(
        "FROM sample s WHERE_VERSION,", "FROM (SELECT * FROM sample WHERE version = 'V1999') s,"
    )
    + f"""SELECT 'deck' AS row_type, rank_scope, deck_fingerprint AS entity, sample_count, {SCORES}, row_number() OVER (PARTITION BY rank_scope ORDER BY {ORDER}, deck_fingerprint DESC) AS rank FROM deck_count
UNION ALL SELECT 'card', rank_scope, card_hash, sample_count, {SCORES}, row_number() OVER (PARTITION BY rank_scope ORDER BY {ORDER}, card_hash DESC) FROM card_count""",
)
def job4(spark, d):
    built = jobs.build(cut(ct.bouts(spark, d)), V1999, ct.card_dim(spark))
    names = ["rank_scope", "entity", "sample_count", "win_rate", "wilson_lower_bound", "rank"]
    deck_rows = built.decks.withColumnRenamed("deck_fingerprint", "entity").select(F.lit("deck").alias("row_type"), *names)
    return deck_rows.unionByName(built.cards.withColumnRenamed("card_hash", "entity").select(F.lit("card").alias("row_type"), *names))


IN_V1999 = ("FROM sample s,", "FROM (SELECT * FROM sample WHERE version = 'V1999') s,")


@query(
    "job4_archetypes",
    BOARD_CLUSTERS.replace(*IN_V1999)
    + BOARD_CORE_SQL.rstrip()
    + PROFILE_SQL.format(entity="leader", rows="(SELECT b.*, leader FROM board b JOIN (SELECT rank_scope, deck_fingerprint, leader FROM member) USING (rank_scope, deck_fingerprint))")
    + f""", rolled AS (
  SELECT rank_scope, leader, arg_min(deck_fingerprint, r) AS representative, count(*) AS member_count, CAST(sum(sample_count) AS BIGINT) AS sample_count,
    CAST(sum(win_count) AS BIGINT) AS win_count, CAST(sum(loss_count) AS BIGINT) AS loss_count FROM member GROUP BY 1, 2),
placed_cluster AS (SELECT *, {win_rate_sql()} AS win_rate, row_number() OVER (PARTITION BY rank_scope ORDER BY {ORDER}, representative DESC) AS rank FROM rolled),
titled AS (SELECT rank_scope, leader, string_agg(card, ' / ' ORDER BY place) FILTER (WHERE place <= 3) || ' 系' AS title, string_agg(card, ',' ORDER BY place) AS core
  FROM core WHERE place <= 5 AND spent < 5.0 GROUP BY 1, 2),
firsts AS (SELECT rank_scope, leader, string_agg(deck_fingerprint, ';' ORDER BY r) AS member_decks
  FROM (SELECT *, row_number() OVER (PARTITION BY rank_scope, leader ORDER BY r) AS k FROM member) WHERE k <= 8 GROUP BY 1, 2)
SELECT c.rank_scope, rank, substr(sha256('archetype:' || representative), 1, 16) AS archetype_id, representative, title, core, member_decks, member_count, c.sample_count, win_rate, top_player,
  weapons, souls, last_7d, points, label
FROM placed_cluster c JOIN titled USING (rank_scope, leader) JOIN firsts USING (rank_scope, leader) JOIN profile p ON p.rank_scope = c.rank_scope AND p.entity = c.leader""",
)
def job4_archetypes(spark, d):
    built = jobs.build(cut(ct.bouts(spark, d)), V1999, ct.card_dim(spark)).archetypes
    return built.select(
        "rank_scope", "rank", "archetype_id", "representative", "title", F.array_join("core_cards.card_hash", ",").alias("core"), F.array_join("member_decks.deck_fingerprint", ";").alias("member_decks"),
        "member_count", "sample_count", "win_rate", "top_player", F.size("weapons").alias("weapons"), F.size("souls").alias("souls"),
        F.col("trend.last_7d_sample_count").alias("last_7d"), F.size("last_30_points").alias("points"), F.col("credibility.label").alias("label"),
    )


@query(
    "job7_contributor_board",
    CONTESTS
    + f""",
mine AS (SELECT s.* FROM sample s JOIN (SELECT match_id FROM side WHERE side_index = 1 AND contributor = 7) USING (match_id)),
deck_count AS (SELECT deck_fingerprint, {counts_sql('board_result')} FROM mine GROUP BY 1)
SELECT deck_fingerprint, sample_count, {SCORES}, row_number() OVER (ORDER BY {ORDER}, deck_fingerprint DESC) AS rank FROM deck_count""",
)
def job7(spark, d):
    header = ct.orders(spark, d).where(F.col("side_index") == 1)
    package = F.concat_ws(":", F.col("contributor").cast("string"), "version")
    bridge = header.select(package.alias("package_id"), "match_id")
    uploads = header.select(F.col("contributor").alias("user_id"), package.alias("package_id")).distinct()
    users = ct.table(spark, d, "nation").select(F.col("n_nationkey").alias("user_id"), F.col("n_name").alias("contributor_name"))
    matches = jobs.reachable_matches(uploads, bridge, users, F.col("contributor_name") == "NATION_7")
    return jobs.personal_board(ct.bouts(spark, d), matches, CFG).select("deck_fingerprint", "sample_count", "win_rate", "wilson_lower_bound", "rank")


@query(
    "jn6_reachable_matches",
    CONTESTS + "SELECT match_id FROM side WHERE side_index = 1 AND contributor = 7",
)
def jn6(spark, d):
    header = ct.orders(spark, d).where(F.col("side_index") == 1)
    package = F.concat_ws(":", F.col("contributor").cast("string"), "version")
    uploads = header.select(F.col("contributor").alias("user_id"), package.alias("package_id")).distinct()
    users = ct.table(spark, d, "nation").select(F.col("n_nationkey").alias("user_id"), F.col("n_name").alias("contributor_name"))
    return jobs.reachable_matches(uploads, header.select(package.alias("package_id"), "match_id"), users, F.col("contributor_name") == "NATION_7")
