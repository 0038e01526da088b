import pytest
from pyspark.sql import Window, functions as F

from duelstats.operators import boards, matchups, samples
from duelstats.operators.ranking import page, ranked
from duelstats.params import JobConfig, memo_key, override_window, page_limit, rank_scope_name, row_type_name
from duelstats.plans import leaderboard
from tests.literals import bout, bouts, cards, side

CFG = JobConfig(version="V1", date_from="2026-05-01", date_to="2026-05-14")


def rows_of(spark, rows):
    return samples.side_samples(samples.in_scope(bouts(spark, rows), CFG))


def test_rank_scopes(spark):
    rows = [
        bout(1, side(1, "a", rank_order=20, player_name="p"), side(2, "b", rank_order=50, player_name="q")),
        bout(2, side(1, "a", rank_order=20, player_name="p"), side(2, "b", rank_order=70, player_name="q")),
        bout(3, side(1, "c", rank_order=40, player_name="r"), side(2, "b", rank_order=70, player_name="q")),
    ]
    found = rows_of(spark, rows)
    totals = {r.rank_scope: (r.side_sample_count, r.match_count) for r in boards.scope_totals(found).collect()}
    assert totals == {"all": (6, 3), "traveler_down": (2, 2), "knight_down": (4, 3), "knight_up": (3, 3)}
    people = {(r.rank_scope, r.deck_fingerprint): r for r in boards.concentration(boards.facets(found), "deck_fingerprint").collect()}
    low = people["traveler_down", "a"]
    assert (low.top_player, low.top_player_count, low.player_count) == ("p", 2, 1)


def test_unknown_results_count_as_samples(spark):
    found = rows_of(spark, [bout(1, side(1, "a", result="win"), side(2, "b"), "unknown")])
    got = {r.deck_fingerprint: r for r in boards.scored(boards.deck_counts(found)).where("rank_scope = 'all'").collect()}
    assert (got["a"].sample_count, got["a"].win_count) == (1, 1)
    assert (got["b"].sample_count, got["b"].win_rate, got["b"].wilson_lower_bound) == (1, None, None)


def test_matchups(spark):
    rows = [bout(i, side(1, "a"), side(2, "b")) for i in range(5)] + [bout(9 + i, side(1, "c"), side(2, "a")) for i in range(4)]
    rows += [bout(20, side(1, "z"), side(2, "z"))]
    scoped = bouts(spark, rows)
    cells = matchups.cells(matchups.pairs(scoped)).where("rank_scope = 'all'")
    axis = matchups.axis(boards.deck_counts(samples.side_samples(scoped))).where("rank_scope = 'all'")
    order = [r.deck_fingerprint for r in axis.orderBy("matrix_index").collect()]
    assert [d for d in order if d != "z"] == ["c", "a", "b"]
    grid = {(r.row_fingerprint, r.column_fingerprint): r for r in matchups.matrix(axis, cells).collect()}
    assert len(grid) == 16
    assert (grid["a", "b"].sample_count, grid["a", "b"].win_rate, grid["a", "b"].tone) == (5, 1.0, "advantage")
    assert (grid["b", "a"].win_rate, grid["b", "a"].tone) == (0.0, "disadvantage")
    assert (grid["c", "a"].sample_count, grid["c", "a"].visible, grid["z", "z"].sample_count) == (4, False, 0)


def test_behaviour_and_trend(spark):
    rows = []
    def add(day, result, weapon, souls):
        n = len(rows)
        own = side(1, "a", weapon=weapon, souls=souls, player_name=f"p{n % 9}")
        rows.append(bout(n, own, side(2, "z"), result, played_at=f"2026-05-{day:02d} 10:{n:02d}"))
    for n in range(10):
        add(1 + n % 7, "win" if n < 5 else "loss", "A", ["S1", "S2"])
    for n in range(10):
        add(8 + n % 3, "win" if n < 9 else "loss", "A", ["S1", "S2"])
    for n in range(5):
        add(14, "win" if n < 3 else "loss", "B", ["S1"])
    found = rows_of(spark, rows)
    counts = boards.scored(boards.deck_counts(found)).where("rank_scope = 'all' and deck_fingerprint = 'a'")
    built = boards.profile(counts, boards.facets(found, CFG.trend_anchor), boards.deck_recent(found), "deck_fingerprint", CFG.trend_anchor).first()
    s1, s2 = built.souls
    assert (s1["name"], s1.sample_count, s1.usage_rate, s2.sample_count, s2.usage_rate) == ("S1", 25, 1.0, 20, 0.8)
    a, b = built.weapons
    assert (a["name"], a.sample_count, a.win_count, a.usage_rate, round(a.conditional_win_rate, 2), a.low_sample) == ("A", 20, 14, 0.8, 0.7, False)
    assert round(a.win_usage_rate, 6) == round(14 / 17, 6) and b.low_sample and b.conditional_win_rate is None
    t = built.trend
    assert (t.last_7d_sample_count, round(t.last_7d_win_rate, 6), t.previous_7d_sample_count, t.previous_7d_win_rate, round(t.delta_7d, 6)) == (15, 0.8, 10, 0.5, 0.3)
    assert len(built.last_30_points) == 25 and built.last_30_points[0]["index"] == 1
    assert round(built.last_30_points[-1].rolling_win_rate, 6) == round(17 / 25, 6)
    assert built.credibility.label == "low" and round(built.credibility.top3_player_share, 6) == round(9 / 25, 6)


def test_rest_row(spark):
    rows = [bout(i, side(1, "a", weapon=w), side(2, "z")) for i, w in enumerate("AAABBBCCDE")]
    mix = boards.category_mix(boards.facets(rows_of(spark, rows)), "deck_fingerprint", "weapon").where("rank_scope = 'all' and deck_fingerprint = 'a'")
    assert [(r["name"], r.sample_count) for r in mix.orderBy("place").collect()] == [("A", 3), ("B", 3), ("C", 2), ("其他", 2)]


def test_archetypes_and_published_pages(spark, tmp_path):
    rows = [bout(1, side(1, "abc", weapon="W1", souls=["S1"]), side(2, "ef")), bout(2, side(1, "bcd", weapon="W2", souls=["S1", "S2"]), side(2, "ef"))]
    dim = cards(spark, a=1.0, b=2.0, c=3.0, d=1.0, e=2.5, f=2.5)
    built = leaderboard.build(bouts(spark, rows), CFG, dim)
    leaderboard.publish(built, CFG, str(tmp_path), 1, 5)
    first = built.archetypes.where("rank_scope = 'all' and rank = 1").first()
    assert (first.member_count, first.sample_count, first.win_count, first.loss_count) == (2, 2, 2, 0)
    assert len(first.weapons) == 2 and [(s["name"], s.sample_count) for s in first.souls] == [("S1", 2), ("S2", 1)]
    ask = lambda **more: leaderboard.read_page(spark, str(tmp_path), CFG, 5, **more)
    got = ask(row_type="decks", sort_key="wilson", limit=2)
    assert (got.status, got.total, got.has_more, [r["rank"] for r in got.rows.collect()]) == ("ready", 3, True, [1, 2])
    assert [r["rank"] for r in ask(row_type="deck", sort_key="wilson", offset=2, limit=2).rows.collect()] == [3]
    assert ask(row_type="card").total == 6 and ask().total == 2
    assert ask(row_type="deck", rank_scope="knight-below").total == 0
    assert leaderboard.read_page(spark, str(tmp_path), CFG, 6).status == "missing"
    assert ask(version="V9").status == "missing"


def test_runs_have_states_and_old_ones_go(spark, tmp_path):
    import os
    from dataclasses import replace

    root = str(tmp_path)
    built = leaderboard.build(bouts(spark, [bout(1, side(1, "ab"), side(2, "cd"))]), CFG, cards(spark, a=1.0))
    broken = replace(built, totals=built.totals.withColumn("match_count", F.raise_error(F.lit("broken")).cast("bigint")))
    states = lambda: {r.run_id: r.status for r in leaderboard.runs(spark, root).collect()}
    leaderboard.publish(built, CFG, root, 1, 5)
    with pytest.raises(Exception, match="broken"):
        leaderboard.publish(broken, CFG, root, 2, 5)
    assert states() == {1: "ready", 2: "failed"} and leaderboard.read_page(spark, root, CFG, 5).status == "ready"
    held = leaderboard.read_page(spark, root, CFG, 5, row_type="deck").rows
    leaderboard.publish(built, CFG, root, 3, 5)
    assert states() == {1: "ready", 2: "dropped", 3: "ready"} and held.count() == 2  # a reader of the run before goes on
    leaderboard.publish(built, replace(CFG, version="V9"), root, 4, 5)  # another version supersedes nothing
    leaderboard.publish(built, CFG, root, 5, 5)
    assert states() == {1: "dropped", 2: "dropped", 3: "ready", 4: "ready", 5: "ready"}
    assert sorted(os.listdir(f"{root}/rows"))[-3:] == ["run_id=3", "run_id=4", "run_id=5"] and not os.path.exists(f"{root}/totals/run_id=1")
    assert leaderboard.read_page(spark, root, CFG, 5, row_type="deck").total == 2
    (row,) = leaderboard.runs(spark, root).where("run_id = 5").collect()
    assert (row.match_count, row.side_sample_count, row.row_count > 0) == (1, 2, True)


def test_page_orders(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (2, 10, 0.1)], "rank bigint, sample_count bigint, wilson_lower_bound double")
    assert [r.sample_count for r in page(rows, "sample").collect()] == [10, 1]
    assert [r.sample_count for r in page(rows, "wilson").collect()] == [1, 10]


def test_ranks_equal_a_window(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "x").when(F.col("id") < 4000, "y").otherwise("z").alias("b"), F.pmod(F.hash("id"), F.lit(7)).alias("v"), "id")
    window = Window.partitionBy("b").orderBy(F.col("v").desc(), F.col("id").asc())
    expect = {(r.b, r.id): r.w for r in df.withColumn("w", F.row_number().over(window)).collect()}
    assert {(r.b, r.id): r["rank"] for r in ranked(df, ["b"], [F.col("v").desc(), F.col("id").asc()]).collect()} == expect


def test_request_names():
    assert [rank_scope_name(x) for x in ("", "Traveler-Below", "knight_above", "odd")] == ["all", "traveler_down", "knight_up", "all"]
    assert (row_type_name("Cards"), row_type_name(""), row_type_name("", False)) == ("card", "archetype", "deck")
    assert [page_limit(x) for x in (None, 0, 9999)] == [80, 1, 500]
    assert override_window(CFG, "2026-04-01", "2026-06-01", "2026-05-03").date_from == "2026-05-03"
    assert memo_key("public", "", CFG, 1) != memo_key("public", "", CFG, 2)


def test_remembered_result_is_computed_once(spark, tmp_path):
    calls = []
    def compute():
        calls.append(1)
        return spark.range(3)
    key = memo_key("personal", "7", CFG, 1)
    assert [leaderboard.remembered(spark, str(tmp_path), key, compute).count() for _ in range(2)] == [3, 3] and len(calls) == 1


def test_plans_stay_in_the_jvm(spark):
    from duelstats.operators import stats
    from duelstats.sources import contest_tables as ct

    found = samples.side_samples(samples.in_scope(ct.bouts(spark, "/root/testdata/sf0.001"), ct.CONFIG))
    for df in (stats.card_stats(found, CFG), boards.deck_counts(found), boards.deck_recent(found)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
    assert "WindowGroupLimit" in plan
