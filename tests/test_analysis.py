import pytest

from duelstats.operators import clustering, samples, stats
from duelstats.params import ALL_PLAYERS, ALL_RANKER, ALL_VERSIONS, JobConfig
from duelstats.plans import analysis
from tests.literals import bout, bouts, cards, side

CFG = JobConfig(deck_floor=1, card_floor=1)


def known(spark, rows, cfg=CFG):
    return samples.known_samples(samples.side_samples(samples.in_scope(bouts(spark, rows), cfg)))


def pick(df, key, value, scope=ALL_PLAYERS, version=ALL_VERSIONS):
    found = [r for r in df.collect() if r[key] == value and r.sample_scope == scope and r.version_scope == version]
    return found[0] if found else None


def test_counts_and_mode_filter(spark):
    pair = lambda i, res, own, opp, second="c": bout(i, side(1, "ab", castle_rate=own), side(2, second, castle_rate=opp), res)
    rows = [pair(1, "win", "80%", "0%"), pair(2, "loss", "20%", "90%"), pair(3, "loss", "10.00%", "100%", "cd"), bout(4, side(1, "ab"), side(2, "c"), mode=" 戦祭り ")]
    found = known(spark, rows)
    assert found.count() == 6
    deck = pick(stats.deck_stats(found, CFG), "deck_fingerprint", "a,b")
    assert (deck.sample_count, deck.win_count, deck.loss_count, deck.castle_crash_count) == (3, 1, 2, 1)
    assert round(deck.avg_castle_diff, 2) == -26.67
    card = pick(stats.card_stats(found, CFG), "card_hash", "c")
    assert (card.sample_count, card.win_count, card.loss_count) == (3, 2, 1)
    floor = JobConfig(deck_floor=2, card_floor=3)
    assert pick(stats.card_stats(found, floor), "card_hash", "c").high_win_deck_count == 0
    assert pick(stats.card_stats(found, floor), "card_hash", "d") is None


def test_unknown_and_missing(spark):
    rows = [bout(1, side(1, "ab"), side(2, "c")), bout(2, side(1, "ab", castle_rate="50"), side(2, "c", castle_rate="50"), "unknown")]
    raw = samples.side_samples(samples.in_scope(bouts(spark, rows), CFG))
    found = samples.known_samples(raw)
    assert (raw.count(), found.count()) == (4, 2)
    deck = pick(stats.deck_stats(found, CFG), "deck_fingerprint", "a,b")
    assert (deck.sample_count, deck.win_count, deck.avg_castle_damage_dealt, deck.avg_castle_diff) == (1, 1, None, None)


def test_damage_from_castle_rows_and_fallback(spark):
    told = bout(1, side(1, "ab", castle_rate="80.00%", kill_count=6.0, death_count=4.0), side(2, "c", castle_rate="0.00%", kill_count=4.0, death_count=6.0), castle=[("20.00%", "101.50%")])
    rows = {r.side_index: r for r in known(spark, [told]).collect()}
    assert (rows[1].castle_damage_dealt, rows[1].castle_damage_taken, rows[2].castle_damage_dealt) == (101.5, 20.0, 20.0)
    bare = bout(1, side(1, "ab", castle_rate="80%"), side(2, "c", castle_rate="-5%"))
    rows = {r.side_index: r for r in known(spark, [bare]).collect()}
    assert (rows[1].castle_damage_dealt, rows[1].castle_damage_taken) == (105.0, 20.0)
    assert rows[1].castle_crash and rows[2].castle_crashed and not rows[1].castle_crashed


def test_scopes_and_versions(spark):
    rows = [
        bout(1, side(1, "ab"), side(2, "c", rank=40), version="old", played_at="2026-05-01 10:00"),
        bout(2, side(1, "ab", rank=50), side(2, "c"), "loss", version="new", played_at="2026-05-02 10:00"),
        bout(3, side(1, "ab", rank=200), side(2, "c", rank=500), "loss", version="new", played_at="2026-05-03 10:00"),
    ]
    found, all_bouts = known(spark, rows), bouts(spark, rows)
    assert stats.current_version(all_bouts).first()["current_version"] == "new"
    assert {r.sample_scope: r.sample_count for r in stats.scope_counts(found, CFG).collect()} == {"all_players": 6, "all_ranker": 4, "high_ranker_top100": 2}
    deck = stats.deck_stats(found, CFG)
    figures = lambda r: (r.sample_count, r.win_count, r.loss_count)
    assert figures(pick(deck, "deck_fingerprint", "a,b")) == (3, 1, 2)
    assert figures(pick(deck, "deck_fingerprint", "a,b", ALL_RANKER)) == (2, 0, 2)
    assert figures(pick(deck, "deck_fingerprint", "a,b", "high_ranker_top100")) == (1, 0, 1)
    assert figures(pick(deck, "deck_fingerprint", "a,b", version="new")) == (2, 0, 2)
    assert pick(stats.card_stats(found, CFG), "card_hash", "a", version="new").sample_count == 2
    report = stats.with_comparisons(deck, "deck_fingerprint", "new", CFG).where("deck_fingerprint = 'a,b'").first()
    assert (report.sample_count, report.all_ranker_sample_count, report.current_version_sample_count) == (3, 2, 2)
    only = JobConfig(deck_floor=1, card_floor=1, version="new")
    assert known(spark, rows, only).count() == 4
    pivot = stats.version_pivot(deck, "deck_fingerprint", analysis.versions_of(all_bouts)).where("deck_fingerprint = 'a,b'").first()
    assert (pivot["old_sample_count"], pivot["new_sample_count"], pivot["new_win_rate"]) == (1, 2, 0.0)


def test_duplicate_cards_count_once(spark):
    found = known(spark, [bout(1, side(1, "aab"), side(2, "c"))])
    assert pick(stats.deck_stats(found, CFG), "deck_fingerprint", "a,a,b").sample_count == 1
    assert pick(stats.card_stats(found, CFG), "card_hash", "a").sample_count == 1


def test_report_clusters_and_names(spark):
    rows = [bout(1, side(1, "abc"), side(2, "x")), bout(2, side(1, "bcd"), side(2, "x"))]
    dim = cards(spark, a=1.0, b=2.0, c=3.0, d=1.5)
    run = analysis.refresh(bouts(spark, rows), CFG)
    report = analysis.archetype_report(run, dim).where("win_count > 0").collect()
    assert [(r.member_count, r.title) for r in report] == [(2, "Card C / Card B 系")]
    deck = analysis.cards_by_cost(spark.createDataFrame([("a,b,c,zzzzzzzzzz",)], ["deck_fingerprint"]), dim).first()
    assert deck.cards_by_cost == ["c", "b", "a", "zzzzzzzzzz"]
    assert deck.deck_name == "Card C(3.0) / Card B(2.0) / Card A(1.0) / 未识别卡(zzzzzzzz)"


def test_written_run_can_be_written_again(spark, tmp_path):
    run = analysis.refresh(bouts(spark, [bout(1, side(1, "ab"), side(2, "c"))]), CFG)
    for _ in range(2):
        analysis.write_run(run, str(tmp_path), 3)
    assert spark.read.parquet(f"{tmp_path}/deck_stats").where("run_id = 3 and sample_scope = 'all_players' and version_scope = 'all_versions'").count() == 2
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 1


def test_clusters_equal_the_sequential_rule(spark):
    import random

    draw = random.Random(5)
    costs = {c: draw.choice([0.0, 1.0, 1.5, 2.0, 2.5, 3.0]) for c in "abcdefghijklmnopqrst"}
    decks = sorted({",".join(sorted(draw.choices(list(costs), k=draw.randint(1, 7)))) for _ in range(250)})
    draw.shuffle(decks)
    leaders, expect = [], {}
    for rank, fp in enumerate(decks, 1):
        mine = set(fp.split(","))
        hit = next((r for r, other in leaders if sum(costs[c] for c in mine & other) >= 5.0), None)
        if hit is None:
            leaders.append((rank, mine))
        expect[rank] = hit or rank
    rows = spark.createDataFrame([("s", i, fp) for i, fp in enumerate(decks, 1)], "rank_scope string, rank bigint, deck_fingerprint string")
    dim = cards(spark, **costs)
    assert len(leaders) > 20
    assert {r["rank"]: r.leader for r in clustering.leaders(rows, dim).collect()} == expect


def _sequential(decks, costs, threshold):
    leaders, leader, first = [], {}, {}
    sets = [(r, {c for c in fp.split(",") if costs.get(c, 0) > 0}) for r, fp in enumerate(decks, 1)]
    near = lambda a, b: sum(costs[c] for c in a & b) >= threshold
    for rank, mine in sets:
        hit = next((r for r, other in leaders if near(mine, other)), None)
        if hit is None:
            leaders.append((rank, mine))
        leader[rank] = hit or rank
        seen = next((r for r, other in sets[: rank - 1] if near(mine, other)), None)
        if seen is not None:
            first[rank] = seen
    return leader, first


@pytest.mark.parametrize("names,low,high,threshold,many", [(60, 20, 40, 16.0, 400), (20, 1, 7, 5.0, 250), (25, 2, 25, 12.0, 300)])
def test_wide_decks_in_blocks_equal_the_sequential_rule(spark, monkeypatch, names, low, high, threshold, many):
    import random

    draw = random.Random(names)
    costs = {f"c{i}": draw.choice([0.0, 1.0, 1.5, 2.0, 2.5, 3.0]) for i in range(names)}
    boards = {}
    for board in ("s", "t"):
        decks = list(dict.fromkeys(",".join(sorted(draw.choices(list(costs) + ["unpriced"], k=draw.randint(low, high)))) for _ in range(many)))
        decks += ["c1,c2" + ",c1" * k for k in range(3)]  # one set in several decks
        draw.shuffle(decks)
        boards[board] = list(dict.fromkeys(decks))
    rows = spark.createDataFrame([(b, i, fp) for b, decks in boards.items() for i, fp in enumerate(decks, 1)], "rank_scope string, rank bigint, deck_fingerprint string")
    dim = cards(spark, **costs)
    want = {b: _sequential(decks, costs, threshold) for b, decks in boards.items()}
    assert all(5 < len(set(leader.values())) < many - 5 for leader, _ in want.values())
    monkeypatch.setattr(clustering, "BLOCK", 40)
    monkeypatch.setattr(clustering, "GROWTH", 2)
    got = {(r.rank_scope, r["rank"]): r.leader for r in clustering.leaders(rows, dim, threshold).collect()}
    assert got == {(b, rank): head for b, (leader, _) in want.items() for rank, head in leader.items()}
    near = {(r.rank_scope, r["rank"]): r.first_similar for r in clustering.first_similar(rows, dim, threshold).collect()}
    assert near == {(b, rank): r for b, (_, first) in want.items() for rank, r in first.items()}


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([], "rank_scope string, rank bigint, deck_fingerprint string")
    assert clustering.leaders(none, cards(spark, a=1.0)).count() == 0 and clustering.first_similar(none, cards(spark, a=1.0)).count() == 0
