"""The match store kept by entity: any batches equal all at once, and untouched buckets stay as they are."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from duelstats.operators import boards, facts, matchups, merge, samples
from duelstats.params import JobConfig
from duelstats.plans.entity_state import EntityState, VersionBoards
from duelstats.schemas import SIGHTING
from tests.test_store import player, sighting

CFG = JobConfig(date_from="2026-01-01", date_to="2026-12-31")


def random_sightings(seed, many=160):
    draw = random.Random(seed)
    rows = []
    for seq in range(many):
        people = [player(k, draw.choice(["Ann", "", "Ben"]), draw.choice([["a", "b"], ["c"], []])) for k in (1, 2)] if draw.random() < 0.8 else []
        rows.append(
            sighting(
                seq, light=draw.random() < 0.3, replay_id=draw.choice(["", f"r{draw.randrange(25)}"]), follow_id="f", detail_t=draw.choice(["", str(1773932045 + draw.randrange(40))]),
                played_at=draw.choice(["", f"2026-05-{draw.randrange(1, 29):02} 10:00"]), version=draw.choice(["", "V1", "V2"]), mode=draw.choice(["", "m"]),
                result=draw.choice(["unknown", "win", "loss"]), title=f"t{seq}", detail_url=draw.choice(["", f"u{seq}", f"https://site.example/members/history/detail?n={seq}"]),
                source_url=draw.choice(["", f"s{seq}"]), castle_rows=[("1%", "x", "2%")] if draw.random() < 0.3 else [], players=people,
            )
        )
    return rows


def told(rows):
    return sorted(map(str, rows.select(*sorted(rows.columns)).collect()))


def test_batches_equal_all_at_once(spark, tmp_path):
    rows = spark.createDataFrame(random_sightings(1), SIGHTING).cache()
    resolved = merge.resolve(rows)
    state = EntityState(spark, str(tmp_path / "s"), buckets=5)
    for batch in (2, 0, 1):  # in any order, the last name of an entity may come first
        assert state.advance(rows.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == batch), [batch]) == {2: 1, 0: 2, 1: 3}[batch]
    found = merge.labelled(merge.named_alone(rows), state.labels())
    assert told(found.select("seq", "entity")) == told(resolved.select("seq", "entity"))
    whole = merge.merged(resolved)
    assert told(state.matches().drop("bucket")) == told(whole)
    # labels and members are the same table, and every daily count adds up
    assert told(state.read("members").select("alias", "entity")) == told(state.labels()) and state.labels().count() == merge.aliases(resolved).select("alias").distinct().count()
    scoped = samples.in_scope(merge.typed_sides(whole), CFG)
    kept, sides = facts.within(state.read("daily"), CFG).cache(), samples.side_samples(scoped).cache()
    for stored, direct in (
        (facts.deck_counts(kept), boards.deck_counts(sides)),
        (facts.facets(kept, "2026-05-20"), boards.facets(sides, "2026-05-20")),
        (facts.scope_totals(kept), boards.scope_totals(sides)),
        (facts.cells(kept), matchups.cells(matchups.pairs(scoped))),
    ):
        assert told(stored) == told(direct) and direct.count() > 0
    with pytest.raises(ValueError):
        state.advance(rows, [1])
    state.rebuild(rows, [0, 1, 2])
    assert told(state.matches().drop("bucket")) == told(whole) and state.heads().batches == {0, 1, 2}


def test_untouched_buckets_stay_unread(spark, tmp_path):
    root = str(tmp_path / "s")
    rows = spark.createDataFrame([sighting(n, replay_id=f"r{n}", version="V1", played_at="2026-05-01") for n in range(200)], SIGHTING)
    state = EntityState(spark, root, buckets=16)
    state.advance(rows, [0])
    files = set(glob.glob(f"{root}/states/**/*.parquet", recursive=True))
    assert set(state.heads().at["states"]) == set(range(16))
    one = spark.createDataFrame([sighting(500, replay_id="r7", version="V2", played_at="2026-05-02")], SIGHTING)
    generation = state.advance(one, [1])
    heads = state.heads()
    (bucket,) = [b for b, g in heads.at["states"].items() if g == generation]
    written = set(glob.glob(f"{root}/states/**/*.parquet", recursive=True)) - files
    assert {os.path.basename(os.path.dirname(f)) for f in written} == {f"bucket={bucket}"}
    # the plan of the step's read lists the touched bucket alone
    before = state.read("states", heads, [bucket])
    assert all(f"bucket={bucket}/" in f for f in before.inputFiles()) and before.count() < 60
    assert sorted(map(tuple, state.changes(generation).collect())) == [("V1", bucket), ("V2", bucket)]
    assert sum(g == generation for g in heads.at["labels"].values()) == 0  # known names move nothing
    # a step that dies before its heads changes nothing that is read
    last = f"{root}/heads/generation={generation}"
    os.rename(last, str(tmp_path / "gone"))
    assert EntityState(spark, root).matches().where("version = 'V2'").count() == 0
    assert state.advance(one, [1]) == generation and state.matches().where("version = 'V2'").count() == 1


def test_joined_matches_are_relabelled(spark, tmp_path):
    state = EntityState(spark, str(tmp_path / "s"), buckets=4)
    apart = [sighting(1, replay_id="b", title="one"), sighting(2, follow_id="f", detail_t="9", title="two"), sighting(3, follow_id="f", detail_t="8", title="three")]
    state.advance(spark.createDataFrame(apart, SIGHTING), [0])
    assert state.matches().count() == 3
    state.advance(spark.createDataFrame([sighting(4, replay_id="b", follow_id="f", detail_t="9")], SIGHTING), [1])
    assert sorted((r.entity, r.sightings) for r in state.matches().collect()) == [("d:f:8", 1), ("d:f:9", 3)]
    # a smaller new name moves them all, the names of earlier batches too
    state.advance(spark.createDataFrame([sighting(5, replay_id="b", follow_id="a", detail_t="1")], SIGHTING), [2])
    assert {r.alias: r.entity for r in state.labels().collect()} == {"r:b": "d:a:1", "d:f:9": "d:a:1", "d:a:1": "d:a:1", "d:f:8": "d:f:8"}
    assert sorted((r.entity, r.sightings) for r in state.matches().collect()) == [("d:a:1", 4), ("d:f:8", 1)]


def test_full_record_without_players_empties_the_sides(spark):
    rows = [sighting(1, replay_id="r", players=[player(1, "Ann", ["a"])]), sighting(2, replay_id="r", title="late"), sighting(3, light=True, replay_id="r", players=[player(1, "Ben", ["b"])])]
    (row,) = merge.merged(merge.resolve(spark.createDataFrame(rows, SIGHTING))).collect()
    assert row.players == [] and row.title == "late"
    (row,) = merge.merged(merge.resolve(spark.createDataFrame(rows[2:], SIGHTING))).collect()
    assert row.players[0].player_name == "Ben"


def test_stream_rewrites_only_touched_versions(spark, tmp_path):
    from duelstats.plans import store as jobs
    from duelstats.streaming.packages import ingest
    from tests.test_store import match_rows

    drop, root = str(tmp_path / "drop"), str(tmp_path / "store")
    refresh = lambda s, g: VersionBoards(s.state, f"{root}/boards", CFG).refresh(g)
    one = match_rows(spark).where("version = 'V1'")
    more = one.withColumns({"version": F.lit("V2"), "replay_id": F.lit("z"), "public_id": F.lit("r:z")})
    for rows, version in ((one, "V1"), (more, "V2")):
        cfg = JobConfig(version=version, date_from="2026-05-01", date_to="2026-05-31")
        jobs.export_contributions(rows, cfg, F.lit("ann"), f"{drop}/{version}", "2026-06-01T00:00:00")
        ingest(spark, drop, root, str(tmp_path / "cp"), refresh).awaitTermination()
    published = VersionBoards(jobs.Store(spark, root).state, f"{root}/boards", CFG)
    assert sorted(map(tuple, published.heads().collect())) == [("V1", 1), ("V2", 2)]
    assert {os.path.basename(f) for f in glob.glob(f"{root}/boards/rows/generation=2/*=*")} == {"version=V2"}
    rows = published.read().where("rank_scope = 'all' AND row_type = 'deck'").collect()
    assert sorted((r.version, r.entity, r.sample_count) for r in rows) == [("V1", "a,a,b", 1), ("V1", "c", 1), ("V2", "a,a,b", 1), ("V2", "c", 1)]
    # a match that leaves its version takes its row along
    moved = more.withColumn("version", F.lit("V3"))
    jobs.export_contributions(moved, JobConfig(version="V3", date_from="2026-05-01", date_to="2026-05-31"), F.lit("ann"), f"{drop}/V3", "2026-06-01T00:00:00")
    ingest(spark, drop, root, str(tmp_path / "cp"), refresh).awaitTermination()
    assert {r.version for r in published.read().collect()} == {"V1", "V3"} and dict(published.heads().collect())["V2"] == 3


def test_a_step_opens_only_the_matches_that_it_changes(spark, tmp_path, monkeypatch):
    from duelstats.plans import entity_state

    opened, typed = [], merge.typed_sides

    def counted(rows):
        opened.append(rows.count())
        return typed(rows)

    monkeypatch.setattr(entity_state.merge, "typed_sides", counted)
    people = lambda n: [player(1, f"P{n}", ["a"]), player(2, "Q", ["b"])]
    rows = lambda some, **more: spark.createDataFrame([sighting(n, **{"replay_id": f"r{n % 1000}", "version": "V1", "played_at": "2026-05-01 10:00", "mode": "m", "result": "win", "players": people(n)} | more) for n in some], SIGHTING)
    state = EntityState(spark, str(tmp_path / "s"), buckets=2)
    state.advance(rows(range(40)), [0])
    state.advance(rows(range(40, 50)), [1])
    assert opened == [40, 10]
    # one match is told anew: its old facts go
    state.advance(rows([1003], version="V2"), [2])
    assert sum(opened[2:]) == 2
    daily = state.read("daily")
    whole = facts.daily(typed(merge.finished(state.read("states"))), "bucket")
    assert told(daily) == told(whole) and daily.where("version = 'V2' AND name = 'P1003'").count() == 1 and daily.where("name = 'P3'").count() == 0


def test_facts_that_were_not_told_are_made_of_all_matches(spark, tmp_path):
    rows = spark.createDataFrame(random_sightings(3), SIGHTING).cache()
    state = EntityState(spark, str(tmp_path / "s"), buckets=3)
    for batch in range(3):
        state.advance(rows.where(F.col("seq") % 3 == batch), [batch], daily=batch > 0)
    assert told(state.read("daily")) == told(facts.daily(merge.typed_sides(merge.finished(state.read("states"))), "bucket"))
