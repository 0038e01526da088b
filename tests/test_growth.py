"""Work that must not grow with the rows around it: pages a few at a time, inputs evaluated once, pockets opened once."""

import datetime
import glob
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from duelstats.functions import loadout, markup, ranks
from duelstats.llm import near_dedup, suffix_buckets
from duelstats.params import JobConfig
from duelstats.plans import store as jobs
from duelstats.plans.entity_state import EntityState
from duelstats.schemas import SIGHTING
from duelstats.session import cut, empty, release, scratch_dir
from duelstats.sources import packages, snapshots
from tests.test_store import match_rows, player, sighting


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_a_batch_of_pages_is_handed_on_in_portions():
    pages = [f"<p>{n}</p>" for n in range(150)] + [None, "x" * 2_000_000, "<b>last</b>"]
    parts = list(markup._doms(iter([pd.Series(pages), pd.Series(["<i>next</i>"]), pd.Series([], dtype=object)])))
    assert max(map(len, parts)) <= markup.PAGES_AT_ONCE and len(parts) > 3
    strings = [[s["s"] for s in row] for part in parts for row in part["strings"]]
    assert strings[:150] == [[str(n)] for n in range(150)] and strings[150] == [] and strings[152:] == [["last"], ["next"]]


def test_dom_of_more_pages_than_a_portion(spark):
    rows = spark.range(300).select("id", F.concat(F.lit("<p>"), "id", F.lit("</p>")).alias("html")).coalesce(1)
    found = rows.select("id", markup.dom(F.col("html")).alias("dom")).select("id", F.get("dom.strings.s", F.lit(0)).alias("s")).collect()
    assert [(r.id, r.s) for r in found] == [(n, str(n)) for n in range(300)]


def test_lines_are_parsed_once(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"record_type":"manifest"}\n\n{"record_type":"match"}\nno\n')
    lines = packages.read_lines(spark, str(tmp_path))
    assert "MapInPandas" not in plan(lines)
    assert [(r.line, r.kind, r.problem) for r in lines.orderBy("line").collect()] == [(1, "manifest", ""), (3, "match", ""), (4, "", "not JSON")]


def test_exported_lines_are_made_once(spark, tmp_path, monkeypatch):
    made, ranked = [], packages.ranked
    monkeypatch.setattr(packages, "ranked", lambda df, *a: made.append(plan(df)) or ranked(df, *a))
    rows = [sighting(n, replay_id=f"r{n}", version="V", result="win", played_at="2026-05-01 10:00", players=[player(1, "Ann", ["a"])]) for n in range(3)]
    matches = spark.createDataFrame(rows, SIGHTING).withColumns({"public_id": F.concat(F.lit("r:"), "replay_id"), "primary_follow_id": F.lit("")})
    packages.write_packages(matches, F.lit("c"), "2026-01-01", "2026-12-31", "2026-06-01", str(tmp_path / "out"))
    assert "canonical_text" not in made[0]
    assert packages.read_lines(spark, str(tmp_path / "out")).count() == 4


def tables_left(spark, old=frozenset()):
    top = scratch_dir(spark).removeprefix("file:")
    return {x for x in os.listdir(top) if x not in old and glob.glob(f"{top}/{x}/part-*")} if os.path.isdir(top) else set()


def test_an_export_and_its_import_leave_no_table_of_lines(spark, tmp_path):
    old = tables_left(spark)
    cfg = JobConfig(version="V1", date_from="2026-05-01", date_to="2026-05-31")
    manifests = jobs.export_contributions(match_rows(spark), cfg, F.lit("ann"), str(tmp_path / "out"), "2026-06-01T00:00:00")
    top = scratch_dir(spark).removeprefix("file:")
    columns = lambda: [spark.read.parquet(f"{top}/{x}").columns for x in tables_left(spark, old)]
    assert columns() and not any({"line", "value"} & set(c) for c in columns()) and manifests.count() == 1
    lines = packages.read_lines(spark, str(tmp_path / "out"))
    # a line that is canonical as it stands is written once, and comes with its canonical text all the same
    kept = [spark.read.parquet(f"{top}/{x}") for x in tables_left(spark, old)]
    (text,) = [t for t in kept if "canonical" in t.columns]
    assert text.where("canonical IS NOT NULL").isEmpty() and lines.where("canonical = value").count() == lines.count() > 1
    store = jobs.Store(spark, str(tmp_path / "store"))
    store.add(lines, 1)
    release(lines)
    lines_told = manifests.first()["match_count"]
    wide = {"value", "winners", "players", "replay_id", "sides", "deck_fingerprint"}
    assert not any(wide & set(c) for c in columns()) and store.matches().count() == lines_told


def test_a_table_without_rows_starts_no_python(spark):
    none = empty(spark, "a bigint, s struct<b:string>, v variant, bucket int")
    assert none.dtypes == [("a", "bigint"), ("s", "struct<b:string>"), ("v", "variant"), ("bucket", "int")] and none.count() == 0
    assert "PythonRDD" not in none._jdf.queryExecution().toRdd().toDebugString()


def test_a_pocket_is_opened_once_for_all_fragments(spark):
    profiles = [{"段位": "騎士2"}, {"league": "旅人"}, {"証": "12"}, {"证": "１００"}, {"rank": "?"}, {}]
    df = spark.createDataFrame([(json.dumps(p),) for p in profiles], "p string").select(F.parse_json("p").alias("v"))
    order = df.select(ranks.rank_order(F.col("v")).alias("o"), loadout.choice_name(F.lit(" None ")).alias("c"))
    assert [(r.o, r.c) for r in order.collect()] == [(50, ""), (20, ""), (40, ""), (60, ""), (None, ""), (None, "")]
    assert plan(order).count("$['段位']") == 1


def test_landed_pages_of_a_day_and_kind_lie_together(spark, tmp_path):
    rows = spark.range(400).select(
        F.concat(F.lit("2026-03-0"), (F.col("id") % 3 + 1).cast("string")).alias("date"), F.lit("daily").alias("source_kind"),
        F.concat(F.lit("u"), "id").alias("source_url"), F.concat(F.lit("h"), F.col("id") % 200).alias("html"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        snapshots.land(rows, str(tmp_path / "pages"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(f"{tmp_path}/pages/date=*/source_kind=daily/*.parquet")) == 3
    assert snapshots.read(spark, str(tmp_path / "pages")).count() == rows.select("date", "html").distinct().count()


def test_a_first_step_takes_the_fresh_states_as_they_are(spark, tmp_path, monkeypatch):
    from duelstats.plans import entity_state

    added, combined = [], entity_state.merge.combined
    monkeypatch.setattr(entity_state.merge, "combined", lambda parts: added.append(1) or combined(parts))
    rows = [sighting(n, replay_id=f"r{n % 4}", version="V", result="win", played_at="2026-05-01 10:00", players=[player(1, "Ann", ["a"])]) for n in range(8)]
    state, seen = EntityState(spark, str(tmp_path / "s"), buckets=2), spark.createDataFrame(rows, SIGHTING)
    state.advance(seen.where("seq < 6"), [1])
    assert added == []
    state.advance(seen.where("seq >= 6"), [2])
    assert added == [1] and sorted(r.sightings for r in state.matches().collect()) == [2, 2, 2, 2]


def contest_tables(spark, folder):
    """Six matches between two players with one deck each, and one whose orders have no lines."""
    keys, day = range(2, 16), datetime.date(2001, 7, 30)
    rows = {
        "nation": ([(1, "PERU")], "n_nationkey int, n_name string"),
        "customer": ([(1, 1, -5.0, "A"), (2, 1, 9500.0, "B")], "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": ([(1, 1)], "s_suppkey bigint, s_nationkey int"),
        "part": ([(1, "SMALL"), (2, "LARGE")], "p_partkey bigint, p_type string"),
        "orders": ([(k, k % 2 + 1, "FO"[k % 2], 150000.0, day, "1-URGENT") for k in keys], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"),
        "lineitem": ([(k, n, n, 1, 3.0, 0.05, 0.02) for k in keys if k < 14 for n in (1, 2)], "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_discount double, l_tax double"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


BOARDS = {("all", 12), ("traveler_down", 6), ("knight_down", 6)}


@pytest.mark.parametrize("name", ["job8_behaviour_profile", "ag16_archetype_scopes", "ag4_run_counters", "ag14_credibility", "ag10_player_concentration"])
def test_contests_are_put_together_once(spark, tmp_path, name):
    found = entry.queries()[name](spark, contest_tables(spark, tmp_path))
    assert not any("lineitem" in f for f in found.inputFiles())
    got = found.collect()
    if name == "ag4_run_counters":
        assert {r.metric: r.value for r in got}["raw_side_samples"] == "12" and len({r.metric for r in got}) == len(got)
    elif name == "ag16_archetype_scopes":
        assert sorted(r.sample_count for r in got) == [6, 6, 6, 6, 12, 12]
    elif name == "ag10_player_concentration":
        assert {(r.rank_scope, r.top3_count) for r in got} == BOARDS
    else:
        assert {(r.rank_scope, r.sample_count) for r in got} == BOARDS


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in glob.glob(f"{d.getPath()}/*/shuffle_*.data")}


def test_written_tables_give_back_their_shuffles(spark):
    before = shuffle_files(spark)
    kept = cut(spark.range(1000).repartition(5).groupBy((F.col("id") % 7).alias("k")).count())
    assert kept.count() == 7 and len(shuffle_files(spark) - before) <= 8  # those of the count alone
    release(kept)
    assert not any(os.path.exists(f.removeprefix("file:")) for f in kept.inputFiles())


@pytest.mark.parametrize("job", [suffix_buckets.remove_repeats, near_dedup.near_groups])
def test_tables_of_whole_texts_are_removed(spark, job):
    text = lambda n: " ".join(f"w{n}x{i * i % 331}" for i in range(300))
    docs = spark.createDataFrame([(n, text(n // 2) + f" end{n}") for n in range(12)], "doc_id bigint, text string")
    top = scratch_dir(spark).removeprefix("file:")
    old = set(os.listdir(top)) if os.path.isdir(top) else set()
    found = job(docs)
    left = [f for x in set(os.listdir(top)) - old for f in glob.glob(f"{top}/{x}/part-*")]
    tables = {tuple(spark.read.parquet(os.path.dirname(f)).columns) for f in left}
    assert found.count() == 12
    assert not tables & {("_doc", "_id", "_text"), ("_bucket", "_doc", "_at"), ("_doc", "_at", "_part", "_core", "_hull"), ("_doc", "_id", "_words", "_bands", "_packed")}
