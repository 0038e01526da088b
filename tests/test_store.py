import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from duelstats.functions import loadout
from duelstats.operators import frontier, merge, versions
from duelstats.params import JobConfig, effective_config
from duelstats.plans import store as jobs
from duelstats.schemas import PLAYER, SIGHTING
from duelstats.sources import catalog, packages

SITE = "https://site.example/members"


def sighting(seq, **more):
    empty = {n.strip().split(" ")[0]: "" for n in SIGHTING.split(", ") if n.endswith(" string")}
    base = dict(empty, seq=seq, light=False, result="unknown", castle_rows=[], timeline_labels=[], timeline_data="{}", players=[])
    return {**base, **more}


def player(n, name, deck):
    return dict(side_index=n, role="player", player_name=name, follow_id="", result="", castle_rate="", profile="{}", selected="{}", deck_ids=deck)


def merged(spark, *rows):
    return merge.merged(merge.resolve(spark.createDataFrame(list(rows), SIGHTING)))


def test_alias_merge(spark):
    url = f"{SITE}/history/detail?t=1781234567&f=42"
    rows = [sighting(1, detail_url=url, played_at="x"), sighting(2, detail_url=url, replay_id="abc"), sighting(3, detail_url=url)]
    (row,) = merged(spark, *rows).collect()
    assert (row.public_id, row.replay_id, row.played_at, row.sightings, row.id_state) == ("r:abc", "abc", "2026-06-12 12:22", 3, "replay")
    found = merge.aliases(merge.resolve(spark.createDataFrame(rows, SIGHTING)))
    assert {(r.alias, r.alias_type) for r in found.collect()} == {("r:abc", "replay"), ("d:42:1781234567", "detail")}


def test_chained_aliases_and_nameless_records(spark):
    rows = [sighting(i, replay_id=f"r{i // 2}", follow_id="f", detail_t=str((i + 1) // 2)) for i in range(0, 40)]
    rows += [sighting(50, title="one"), sighting(51, title="two")]
    got = merged(spark, *rows).collect()
    assert sorted(r.sightings for r in got) == [1, 1, 40]
    assert len({r.public_id for r in got}) == 3


def test_light_source_keeps_full_fields(spark):
    full = sighting(1, replay_id="r", played_at="2026-05-01 10:00", mode="m", version="V", result="win", detail_url=f"{SITE}/history/detail?x=1", title="full",
                    castle_rows=[("1%", "", "2%")], players=[player(1, "Ann", ["a"])])
    light = sighting(2, light=True, replay_id="r", played_at="2026-05-02 10:00", detail_url=f"{SITE}/play", title="light", players=[player(1, "", ["z"])])
    for rows in ([full, light], [dict(light, seq=0), full]):
        (row,) = merged(spark, *rows).collect()
        assert (row.played_at, row.result, row.title, row.detail_url) == ("2026-05-01 10:00", "win", "full", f"{SITE}/history/detail?x=1")
        assert row.players[0].deck_ids == ["a"] and len(row.castle_rows) == 1
    (row,) = merged(spark, light).collect()
    assert (row.players[0].deck_ids, row.title, row.result) == (["z"], "light", "unknown")


def match_rows(spark):
    players = [dict(player(1, "Ann", ["b", "a", "a"]), profile='{"全国主君ランキング":"1,234位","n":1.50}'), player(2, "Ben/", ["c"])]
    base = dict(public_id="r:x", replay_id="x", detail_t="", primary_follow_id="", played_at="2026-05-10 10:00", mode="全国対戦", version="V1", result="win",
                detail_url="", play_url="", m3u8_url="", source_url="", title="t", detail_error="", castle_title="城", castle_rows=[("20%", "門", "101.5%")],
                timeline_labels=[], timeline_data="{}", players=players)
    old = dict(base, public_id="r:y", replay_id="y", version="V0")
    schema = (
        "public_id string, replay_id string, detail_t string, primary_follow_id string, played_at string, mode string, version string, result string, detail_url string, play_url string, "
        "m3u8_url string, source_url string, title string, detail_error string, castle_title string, castle_rows array<struct<player:string,label:string,enemy:string>>, "
        f"timeline_labels array<string>, timeline_data string, players array<{PLAYER}>"
    )
    return spark.createDataFrame([base, old], schema)


CFG = JobConfig(version="V1", date_from="2026-05-01", date_to="2026-05-31")


@pytest.fixture(scope="module")
def package(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("packages"))
    jobs.export_contributions(match_rows(spark), CFG, F.lit("ann/1"), path, "2026-06-01T00:00:00")
    return path


def read(spark, path):
    return packages.read_lines(spark, path)


def test_package_round_trip_and_idempotency(spark, package, tmp_path):
    import glob

    (file,) = glob.glob(f"{package}/**/*.jsonl", recursive=True)
    lines = open(file, encoding="utf-8").read().splitlines()
    manifest, record = json.loads(lines[0]), json.loads(lines[1])
    assert len(lines) == 2 and manifest["match_count"] == 1 and manifest["package_id"].startswith("ann_1:V1:2026-05-01:2026-05-31:")
    assert lines[1] == packages.canonical(record) and record["players"][1]["player_name"] == "Ben/"
    store = jobs.Store(spark, str(tmp_path / "store"))
    once = jobs.import_summary(store.add(read(spark, package), 1)).first()
    again = jobs.import_summary(store.add(read(spark, package), 2)).first()
    assert tuple(once) == (1, 1, 0, 1, 0) and tuple(again) == (1, 0, 1, 0, 0)
    (bout,) = store.bouts().collect()
    assert (bout.public_id, bout.sides[0].deck_fingerprint, bout.sides[0]["rank"], bout.sides[1].result) == ("r:x", "a,a,b", 1234, "unknown")
    # the same batch run again replaces itself
    assert jobs.import_summary(store.add(read(spark, package), 1)).first().matches_imported == 1
    assert store.bridge().count() == 1 and store.sightings().count() == 1


def test_own_exports_come_back_whatever_they_hold(spark, tmp_path):
    odd = lambda p: p.withField("player_name", F.lit("a\u0001b\u2028\u00e9")).withField("profile", F.lit('{"n":1e20,"m":0.00001,"k":"\\u0007"}'))
    jobs.export_contributions(match_rows(spark).withColumn("players", F.transform("players", odd)), CFG, F.lit("ann"), str(tmp_path / "p"), "now")
    (found,) = packages.inspect(packages.read_lines(spark, str(tmp_path / "p"))).collect()
    assert (found.reason, found.records) == ("", 1)


def test_daily_counts_take_late_rows(spark, tmp_path):
    from duelstats.streaming import daily

    schema, folder = "ts timestamp, deck string, result string", str(tmp_path / "in")
    parts = [[("2026-05-20 10:00:00", "a", "win"), ("2026-05-20 11:00:00", "b", "loss")], [("2026-05-20 12:00:00", "a", "loss"), ("2026-04-01 10:00:00", "a", "win")]]
    frames = [spark.createDataFrame(rows, "ts string, deck string, result string").withColumn("ts", F.to_timestamp("ts")) for rows in parts]
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(folder)
        daily.maintain(spark.readStream.schema(schema).parquet(folder), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = lambda df: sorted(map(tuple, df.select("day", "deck", *daily.COUNTS).collect()))
    assert rows(daily.read(spark, str(tmp_path / "out"))) == rows(daily.daily_counts(frames[0].unionByName(frames[1])))


def test_first_address_falls_back(spark):
    (row,) = merged(spark, sighting(1, replay_id="r", source_url="s"), sighting(2, replay_id="r", play_url="p")).collect()
    assert row.detail_url == "s"


def test_busy_contributor_gets_several_packages(spark, tmp_path):
    one = match_rows(spark).where("version = 'V1'")
    rows = spark.range(7).join(one.drop("public_id")).withColumn("public_id", F.concat(F.lit("r:"), "id")).withColumn("replay_id", F.col("id").cast("string")).drop("id")
    manifests = jobs.export_contributions(rows, CFG, F.lit("ann"), str(tmp_path / "p"), "now", size=3)
    assert sorted(r.match_count for r in manifests.collect()) == [1, 3, 3]
    found = packages.inspect(read(spark, str(tmp_path / "p"))).collect()
    assert [r.reason for r in found] == [""] * 3 and sum(r.records for r in found) == 7


def test_saved_bouts_prune(spark, tmp_path):
    from duelstats.operators import samples
    from tests.literals import bout, bouts, side

    path = str(tmp_path / "bouts")
    jobs.save_bouts(bouts(spark, [bout(i, side(1, "a"), side(2, "b"), version=f"V{i % 2}") for i in range(6)]), path)
    kept = samples.in_scope(spark.read.parquet(path), JobConfig(version="V1", date_from="2026-05-10", date_to="2026-05-10"))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = kept._jdf.queryExecution().explainString(mode)
    print(plan)
    assert kept.count() == 3 and "GreaterThanOrEqual(played_at,2026-05-10)" in plan and "LessThan(played_at,2026-05-11)" in plan
    assert "PartitionFilters: [isnotnull(version" in plan


def test_refused_packages(spark, tmp_path):
    good = {"record_type": "match", "version": "V1", "public_id": "p", "players": [{"side_index": 0, "player_name": None, "deck_ids": ["a"]}]}
    def write(name, head, *records, raw=""):
        text = "\n".join([json.dumps(head), "", *[json.dumps(r) for r in records]]) + "\n" + raw
        (tmp_path / name).write_text(text, encoding="utf-8")
    head = {"record_type": "manifest", "schema_version": "share_v1", "package_id": "k", "contributor_id": "c", "target_version": "V1", "match_count": 1}
    write("a.jsonl", head, good)
    write("b.jsonl", {**head, "package_id": "k2"}, {**good, "players": [{"profile": {"cookie": 1}}]})
    write("c.jsonl", {**head, "match_count": 2}, good)
    write("d.jsonl", {**head, "body_hash": "no"}, good)
    write("e.jsonl", good, head)
    write("f.jsonl", {**head, "package_id": "k3", "match_count": 2}, good, {**good, "version": "V2"})
    write("g.jsonl", head, good, raw="{broken")
    write("h.jsonl", {**head, "schema_version": "v0"}, good)
    found = jobs.import_packages(packages.read_lines(spark, str(tmp_path)), jobs.Store(spark, str(tmp_path / "none")).registry())
    status = {r.path.rsplit("/", 1)[1][0]: (r.status, r.imported_match_count) for r in found.registry.collect()}
    assert status == {"a": ("completed", 1), "f": ("completed_with_errors", 1), **{k: ("failed", 0) for k in "bcdegh"}}
    errors = {(r.package_id, r.line): r.error for r in found.errors.collect()}
    assert errors["k3", 4] == "record version differs from target_version"
    reasons = " ".join(errors.values())
    for part in ("forbidden key cookie", "match_count differs", "body_hash differs", "no manifest", "not JSON", "unsupported schema_version v0"):
        assert part in reasons
    one = found.sightings.where("package_id = 'k'").first()
    assert one.light and (one.players[0].side_index, one.players[0].player_name, one.players[0].result) == (1, "", "unknown")


def test_aggregate_shared_writes_every_report(spark, tmp_path):
    shown = '{"generals":[{"hash_id":"c","raw_name":" Seen "},{"hash_id":"b","raw_name":""}]}'
    named = lambda p: p.withField("selected", F.lit(shown))
    drop, root = str(tmp_path / "drop"), str(tmp_path / "out")
    rows = match_rows(spark).withColumn("players", F.transform("players", named))
    jobs.export_contributions(rows, CFG, F.lit("ann"), drop, "now")
    dim = spark.createDataFrame([("a", "Known", 2.0), ("b", "Bee", 1.0)], "card_hash string, name string, cost double")
    cfg = JobConfig(version="", date_from="2026-05-01", date_to="2026-05-31", deck_floor=1, card_floor=1)
    store = jobs.Store(spark, str(tmp_path / "store"), buckets=2)
    paths = jobs.aggregate_shared(store, read(spark, drop), cfg, dim, root, 7, 1)
    assert set(paths) == {"overview", "deck", "card", "deck-version", "card-version", "deck-top", "summary"}
    summary = spark.read.json(paths["summary"]).first()
    assert (summary.run_id, summary["import"].packages_imported, summary["import"].matches_imported, len(summary.reports)) == (7, 1, 1, 6)
    tables = {name: spark.read.option("header", True).csv(path) for name, path in paths.items() if name != "summary"}
    assert {r.card_hash for r in tables["card"].collect()} == {"a", "b", "c"} and tables["deck"].count() == 2 and tables["overview"].count() > 5
    text = str([r.asDict() for r in tables["card"].collect()])
    assert "Known" in text and "Seen" in text  # a card of no catalog goes by the name that players saw
    version = [c for c in tables["deck-version"].columns if "V1" in c]
    assert version and spark.read.parquet(f"{root}/runs/runs").first().status == "completed"
    wide = jobs.wide_matches(store.bouts(), dim)
    jobs.export_matches(wide, f"{root}/csv", "csv")
    assert spark.read.option("header", True).csv(f"{root}/csv").first().player_deck == "b|a|a"
    with pytest.raises(ValueError):
        jobs.export_matches(wide, f"{root}/x", "odd")


def test_empty_and_named_files(spark, tmp_path):
    folder = tmp_path / "drop.v1"
    folder.mkdir()
    head = {"record_type": "manifest", "schema_version": "share_v1", "package_id": "k", "contributor_id": "c", "target_version": "V1", "match_count": 0}
    (folder / "a.jsonl").write_text(json.dumps(head) + "\n")
    (folder / "none.jsonl").write_text("")
    (folder / "blank.jsonl").write_text(" \n\n")
    (folder / "stray.txt").write_text("no package")
    (tmp_path / "own name.dat").write_text(json.dumps({**head, "package_id": "k2"}) + "\n")

    def seen(*paths):
        found = jobs.import_packages(packages.read_lines(spark, [str(p) for p in paths]), jobs.Store(spark, str(tmp_path / "none")).registry())
        rows = found.registry.unionByName(found.skipped.withColumn("status", F.lit("skipped")), allowMissingColumns=True).collect()
        return sorted((r.path.rsplit("/", 1)[1], r.status) for r in rows), tuple(jobs.import_summary(found).first())

    status, summary = seen(folder)
    assert [n for n, _ in status] == ["a.jsonl", "blank.jsonl", "none.jsonl"] and dict(status)["a.jsonl"] == "completed" and summary[0] == 3 and summary[4] == 1
    assert seen(tmp_path / "own name.dat")[0] == [("own%20name.dat", "completed")]
    assert len(seen(folder, tmp_path / "own name.dat", folder / "stray.txt")[0]) == 5


def test_shared_hashes_go_by_load_order(spark, tmp_path):
    rows = [("c9", "First", '{"card_small":"s"}'), ("c10", "Second", '{"card_small":"s"}'), ("c1", "Third", '{"card_small":"t"}'), ("c0", "Last", '{"card_small":"t"}')]
    table = spark.createDataFrame(rows, "card_code string, name string, image_keys_json string")
    table.coalesce(1).write.parquet(str(tmp_path / "cards"))
    for source in (table, spark.read.parquet(str(tmp_path / "cards"))):
        names = {r.card_hash: r.name for r in catalog.by_hash(catalog.from_table(source)).collect()}
        assert (names["s"], names["t"]) == ("Second", "Last")


def test_remembered_results(spark, tmp_path):
    from duelstats.plans.leaderboard import remembered

    calls = []
    compute = lambda: calls.append(1) or spark.range(3)
    assert [remembered(spark, str(tmp_path), "lb:x", compute).count() for _ in range(2)] == [3, 3] and len(calls) == 1


def test_stream_equals_batch(spark, package, tmp_path):
    from duelstats.streaming.packages import ingest

    seen = []
    root = str(tmp_path / "store")
    for _ in range(2):
        ingest(spark, package, root, str(tmp_path / "cp"), lambda s, g: seen.append((g, sorted({r.version for r in s.state.changes(g).collect()})))).awaitTermination()
    assert seen == [(1, ["V1"])] and jobs.Store(spark, root).matches().count() == 1


def test_uploads_and_windows(spark):
    rows = spark.createDataFrame([(1, 7, "h"), (2, 7, "h"), (3, 8, "h")], "seq bigint, user_id bigint, content_hash string")
    known = rows.where("user_id = 8").select("user_id", "content_hash")
    assert [(r.user_id, r.seq) for r in merge.new_uploads(rows, known).collect()] == [(7, 1)]
    assert effective_config(JobConfig(date_from="2026-05-01", date_to="2026-05-12"), date(2026, 5, 20)).date_to == "2026-05-20"
    cur = JobConfig(version="V2", date_from="2026-05-20", date_to="2026-05-25")
    ask = lambda v, span=None: versions.config_for(v, cur, JobConfig(version="V0", date_from="2026-01-01", date_to="2026-01-02"), {"V1": "2026-04-22", "V2": "2026-05-20"}, span, date(2026, 6, 1))
    assert (ask("V1").date_from, ask("V1").date_to) == ("2026-04-22", "2026-05-19")
    assert ask("VX", ("2026-02-01", "2026-02-03")).date_to == "2026-02-03" and ask("V0").date_to == "2026-06-01"
    with pytest.raises(ValueError):
        ask("none")


def test_soul_names(spark):
    pockets = [
        {"souls": [{"name": "A"}, {"name": " A "}, {"label": "B  C"}]},
        {"weapon": {"souls": ["x", None, "-"], "summary": "s 英魂 y"}},
        {"weapon": {"summary": "刀 英魂 p、q / r"}},
        {"summary": "英魂 z", "weapon": "w"},
        {"souls": {"effects": [{"summary": "英魂 u,v"}]}},
        [1],
    ]
    df = spark.createDataFrame([(i, json.dumps(p, ensure_ascii=False)) for i, p in enumerate(pockets)], "i int, p string")
    got = {r.i: r.s for r in df.select("i", loadout.soul_names(F.array("p"))[0].alias("s")).collect()}
    assert got == {0: ["A", "B C"], 1: ["x"], 2: ["p", "q", "r"], 3: ["z"], 4: ["u", "v"], 5: []}
    name = df.select("i", loadout.selected_name(F.parse_json("p"), "weapon").alias("w"))
    assert {r.i: r.w for r in name.collect() if r.i in (2, 3)} == {2: "刀 英魂 p、q / r", 3: "w"}


def test_frontier(spark):
    units = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "c"), (3, "d"), (9, "q")], "match_id int, card_hash string")
    seeds = spark.createDataFrame([("a",)], "card_hash string")
    rounds = lambda **more: {r.card_hash: r["round"] for r in frontier.expand(units, seeds, **more).collect()}
    assert rounds(rounds=1) == {"a": 1, "b": 2}
    assert rounds(rounds=None) == {"a": 1, "b": 2, "c": 3, "d": 4}
    assert rounds(rounds=None, searched=spark.createDataFrame([("c",)], "card_hash string")) == {"a": 1, "b": 2}


def test_catalogs(spark, tmp_path):
    (tmp_path / "cards.json").write_text(json.dumps({"cards": [{"hash_id": "h1", "code": "c1", "name": "One", "cost": "x", "cost_label": "1.5", "image_keys": {"card_small": "s1"}}, {"name": "none"}]}))
    general = ["p1,d1,f1,Two,,1,,,,,0,0,7,1,,0", "short,row"]
    base = {"general": general, "color": ["0,red", "1,blue"], "cardType": ["t"], "cost": ["0,1.0", "1,2.0"], "unitType": ["0,spear"], "indexInitial": ["蒼"]}
    (tmp_path / "base").mkdir()
    (tmp_path / "base" / "b.json").write_text(json.dumps(base, ensure_ascii=False), encoding="utf-8")
    legacy = {r.card_hash: r for r in catalog.by_hash(catalog.read_json(spark, str(tmp_path / "cards.json"))).collect()}
    assert set(legacy) == {"h1", "c1", "s1"} and (legacy["s1"].cost, legacy["h1"].image_key, legacy["h1"].name) == (1.5, "s1", "One")
    dim = catalog.load(spark, base_dir=str(tmp_path / "base"), overlay=str(tmp_path / "cards.json"))
    got = {r.card_hash: r for r in dim.collect()}
    assert set(got) == {"p1", "d1", "f1", "h1", "c1", "s1"}
    two = got["d1"]
    assert (two.name, two.card_code, two.cost, two.unit_type, two.faction, two.card_type) == ("Two", "蒼007", 2.0, "spear", "blue", "t")
    snapshot = catalog.read_base(spark, str(tmp_path / "base" / "b.json"))
    assert catalog.overlay_cards(snapshot, dim).count() == 0
    table = spark.createDataFrame([("c9", "Nine", "2.5")], "card_code string, name string, cost_value string")
    assert catalog.by_hash(catalog.from_table(table)).first().cost == 2.5
