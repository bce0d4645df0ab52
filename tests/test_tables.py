"""Keyed tables, logs, sessions of streams, contracts and published drafts: restarts, changed inputs and odd rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cutroom.sources import contracts, sinks
from cutroom.streaming import jobs, sessions
from cutroom.streaming.tables import Changed, KeyedTable, append_only, unchanged


def told(df):
    return None if df is None else sorted(map(tuple, df.collect()))


def test_upserts_cost_a_batch_and_survive_being_run_again(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ["k"], buckets=4, every=3)
    sink, rng, held = table.upserts(["at"]), random.Random(5), {}
    assert table.rows(spark) is None
    for number in range(14):
        rows = [(rng.randrange(12) if rng.random() < 0.95 else None, rng.randrange(100) * 1000 + i, f"{number}.{i}") for i in range(rng.randrange(0, 9))]
        batch = spark.createDataFrame(rows, "k long, at long, v string")
        for k in {r[0] for r in rows}:
            held[k] = max((r for r in rows if r[0] == k), key=lambda r: r[1])
        for _ in range(1 + number % 2):  # every second batch is run twice, also after it was folded
            sink(batch, number)
            assert sorted(map(str, table.rows(spark).select("k", "at", "v").collect() if table.rows(spark) is not None else [])) == sorted(f"Row(k={k}, at={a}, v={v!r})" for k, a, v in held.values())
    # slots are written over: the folder does not grow with the batches
    assert len(list((tmp_path / "t" / "deltas").glob("_slot=*"))) <= 6 and len(list((tmp_path / "t" / "base").iterdir())) == 2


def test_a_fold_that_fails_changes_nothing(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ["k"], buckets=2, every=100)
    batches = [spark.createDataFrame([(k, n, f"{n}") for k in range(n, n + 3)], "k long, at long, v string") for n in range(4)]
    for n, batch in enumerate(batches):
        table.upserts(["at"])(batch, n)
    before = told(table.rows(spark))
    table.fold(spark, 2)
    assert told(table.rows(spark)) == before
    # a base that was half written under the other slot, and no line in the manifest for it
    spark.createDataFrame([(99, 9, "x", 50, False, 0)], "k long, at long, v string, _batch long, _gone boolean, _bucket int").write.mode("overwrite").partitionBy("_bucket").parquet(f"{table.path}/base/1")
    assert told(table.rows(spark)) == before
    table.fold(spark, 3)
    assert told(table.rows(spark)) == before
    table.upserts(["at"])(batches[1], 4)
    assert {r[0]: r[2] for r in told(table.rows(spark))} == {0: "0", 1: "1", 2: "1", 3: "1", 4: "3", 5: "3"}


def test_first_rows_of_an_outbox(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ["id"], buckets=3, every=2)
    sink, sent = table.firsts(), {}
    rng = random.Random(2)
    for number in range(7):
        rows = [(rng.randrange(20), f"{number}-{rng.randrange(9)}") for _ in range(6)]
        for i, v in sorted(rows):
            sent.setdefault(i, v)
        for _ in range(2):
            sink(spark.createDataFrame(rows, "id long, v string"), number)
    assert told(table.rows(spark)) == sorted(sent.items())


def test_replace_by_key_is_refused_when_the_source_changed(spark, tmp_path):
    table, source = KeyedTable(str(tmp_path / "t"), ["clip"], buckets=2), str(tmp_path / "source")
    put = lambda rows: spark.createDataFrame(rows, "clip long, v long").write.mode("overwrite").parquet(source)
    read = lambda: spark.read.parquet(source)
    double = lambda rows: rows.where("v > 0").select("clip", F.explode(F.array("v", -F.col("v"))).alias("made"))
    put([(1, 5), (2, 6)])
    table.replace(0, read, double)
    assert told(table.rows(spark)) == [(1, -5), (1, 5), (2, -6), (2, 6)]
    put([(1, 7), (3, 8)])
    table.replace(1, read, double)
    assert told(table.rows(spark)) == [(1, -7), (1, 7), (2, -6), (2, 6), (3, -8), (3, 8)]
    put([(1, 0)])
    table.replace(2, read, double)  # a key that has nothing any more
    assert told(table.rows(spark)) == [(2, -6), (2, 6), (3, -8), (3, 8)]

    def meanwhile(rows):
        put([(2, 1), (2, 2)])
        return double(rows)

    put([(2, 9)])
    with pytest.raises(Changed):
        table.replace(3, read, meanwhile)
    assert told(table.rows(spark)) == [(2, -6), (2, 6), (3, -8), (3, 8)]
    table.replace(3, read, double)
    assert told(table.rows(spark)) == [(2, -2), (2, -1), (2, 1), (2, 2), (3, -8), (3, 8)]


def test_results_of_other_inputs_are_dropped(spark):
    results = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30), (4, None, 40)], "clip long, hash string, v long")
    inputs = spark.createDataFrame([(1, "a"), (2, "changed"), (4, None)], "clip long, hash string")
    assert sorted(r.clip for r in unchanged(results, inputs, ["clip"], "hash").collect()) == [1, 4]


def test_a_log_is_only_appended_to(spark, tmp_path):
    path = str(tmp_path / "log")
    df = lambda rows: spark.createDataFrame(rows, "id long, v string")
    append_only(df([(1, "a"), (2, None), (1, "a")]), path, ["id"], 0)
    append_only(df([(1, "a"), (3, "c")]), path, ["id"], 1)
    append_only(df([(1, "a"), (3, "c")]), path, ["id"], 1)
    read = lambda: sorted(((r.id, r.v) for r in spark.read.parquet(path).collect()), key=str)
    assert read() == [(1, "a"), (2, None), (3, "c")]
    for bad in ([(2, "now")], [(4, "x"), (4, "y")]):
        with pytest.raises(ValueError, match="not to be changed"):
            append_only(df(bad), path, ["id"], 2)
    assert read() == [(1, "a"), (2, None), (3, "c")]


def test_sessions_of_a_stream_equal_the_batch(spark, tmp_path):
    """Events exactly a gap apart belong together, in whatever order and batch they come; the last ones wait for the watermark."""
    rng, start, gap = random.Random(7), datetime(2024, 1, 1), 45 * 60
    times = {u: [] for u in ("a", "b", "c")}
    for line in times.values():
        at = 0
        for _ in range(25):
            at += rng.choice([1, 60, gap - 1, gap, gap + 1, 3 * gap])
            line.append(at)
    schema, folder = "user string, ts timestamp", str(tmp_path / "in")
    events = sorted((start + timedelta(seconds=s), u) for u, line in times.items() for s in line)
    parts = [events[i : i + 20] for i in range(0, len(events), 20)]
    for k, part in enumerate([*parts, [(start + timedelta(days=400), "end")], [(start + timedelta(days=800), "end")]]):
        rng.shuffle(part)
        spark.createDataFrame([(u, t) for t, u in part] + [(None, part[0][0]), ("a", None)], schema).coalesce(1).write.mode("append").json(folder + f"/{k:03}")
    stream = jobs.watch(spark, folder + "/*", spark.createDataFrame([], schema).schema, "json", 1)
    got = []
    found = sessions.gap_sessions(stream, "user", "ts", gap * 1_000_000, late="2 hours")
    query = jobs.run_available(found, str(tmp_path / "cp"), lambda df, n: got.extend(map(tuple, df.collect())))
    assert query.exception() is None
    want = []
    for u, line in times.items():
        held = [(s, s, 1) for s in line]
        for s, e, n in sessions.merge(held, gap):
            at = lambda x: int((start + timedelta(seconds=x) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
            want.append((u, at(s), at(e), n))
    assert sorted(r for r in got if r[0] != "end") == sorted(want) and len(want) > 10
    assert any(b - a == gap for line in times.values() for a, b in zip(line, line[1:], strict=False))


def test_contract_is_checked_at_opening(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 3, 0.5, "x"), (2, None, 9, 2.0, "x"), (2, "c", 3, None, "x")], "id long, name string, schema int, share double, more string").write.parquet(path)
    sound = contracts.Contract({"id": "bigint", "share": "double"})
    assert contracts.checked_open(spark, path, sound).columns == ["id", "share"]
    with pytest.raises(contracts.BrokenContract) as broken:
        contracts.checked_open(spark, path, contracts.Contract({"id": "int", "title": "string", "NAME": "string"}))
    assert broken.value.args[1] == [("id", "is bigint, not int"), ("title", "missing")]
    strict = contracts.Contract({"id": "bigint"}, required=("id", "name"), unique=("id",), rules={"share": F.col("share") <= 1}, version=("schema", 7))
    with pytest.raises(contracts.BrokenContract) as broken:
        contracts.checked_open(spark, path, strict)
    assert broken.value.args[1] == [("id", "repeated", 1), ("name", "null", 1), ("schema", "version over 7", 1), ("share", "rule", 1)]
    assert contracts.checked_open(spark, path, strict, rows=False).count() == 3
    empty = spark.createDataFrame([], "id long, name string, schema int, share double")
    assert contracts.row_faults(empty, strict).collect() == []


def draft(spark, **changed):
    rows = {
        "drafts": [("d", "cut", "11", 30)], "tracks": [("d", 0, "video"), ("d", 1, "audio")], "segments": [("d", 0, 1, 0, 10, 5, 10, "m1"), ("d", 0, 2, 10, 20, 0, 20, "m2"), ("d", 1, 1, 0, 25, 0, 25, "s")],
        "materials": [("d", "m1", "video", "/a", 99), ("d", "m2", "video", "/b", 99), ("d", "s", "audio", "/c", 60)],
    } | changed
    kinds = {"drafts": "draft string, name string, version string, duration long", "tracks": "draft string, track int, kind string", "segments": "draft string, track int, place int, start long, duration long, source_start long, source_duration long, material string", "materials": "draft string, material string, kind string, path string, duration long"}
    return sorted(r.fault for r in sinks.draft_faults(*[spark.createDataFrame(rows[k], kinds[k]) for k in ("drafts", "tracks", "segments", "materials")], "11").collect())


def test_faults_of_drafts(spark):
    video, music = [("d", 0, 1, 0, 10, 5, 10, "m1"), ("d", 0, 2, 10, 20, 0, 20, "m2")], ("d", 1, 1, 0, 25, 0, 25, "s")
    assert draft(spark) == []
    assert draft(spark, drafts=[("d", "", "12", 31)]) == ["duration", "name", "version"]
    assert draft(spark, drafts=[("d", None, None, None)]) == ["duration", "name", "version"]
    assert draft(spark, segments=[video[0], ("d", 0, 2, 11, 20, 0, 20, "m2"), music]) == ["timeline"]
    assert draft(spark, segments=[video[0], ("d", 0, 2, 10, 20, 0, 20, "other"), music]) == ["timeline"]
    assert draft(spark, segments=[video[0], ("d", 0, 2, 10, 20, 0, 20, None), music]) == ["timeline"]
    assert draft(spark, tracks=[("d", 0, "video"), ("d", 1, "audio"), ("d", 2, "text")]) == ["tracks"]
    assert draft(spark, tracks=[("d", 0, "video"), ("d", 1, "text")]) == ["music count"]
    for bad in ((5, 25, 0, 25), (0, 25, 1, 25), (0, 25, 0, 24), (0, 31, 0, 31), (0, 0, 0, 0)):
        assert draft(spark, segments=[*video, ("d", 1, 1, *bad, "s")]) == ["music"], bad
    assert draft(spark, segments=[*video, music, music]) == ["music"]
    assert draft(spark, materials=[("d", "m1", "video", "a", 99), ("d", "m2", "video", None, 99), ("d", "s", "audio", "/c", 60)]) == ["path"]
    assert draft(spark, tracks=[], segments=[], materials=[], drafts=[("d", "x", "11", 0)]) == ["tracks"]
    assert draft(spark, drafts=[]) == []


def test_timelines_are_told_without_numbering_their_segments(spark, monkeypatch):
    rng, segments, want = random.Random(6), [], set()
    for k in range(120):
        at, rows = 0, []
        for place in rng.sample(range(-9, 9), rng.randrange(1, 6)) if k % 2 else [None, *range(rng.randrange(1, 4))]:
            rows.append([place, at, rng.randrange(1, 4)])
            at += rows[-1][2]
        if k % 2 and k % 3:
            for row, place in zip(rows, sorted(r[0] for r in rows), strict=True):
                row[0] = place
        if rng.random() < 0.4:
            rng.choice(rows)[rng.randrange(1, 3)] = rng.choice([None, 0, 1, 2, 3, -1])
        before = 0
        for place, start, size in sorted(rows, key=lambda r: -99 if r[0] is None else r[0]):
            if start is None or size is None or size <= 0 or start != before:
                want.add(k)
                break
            before += size
        segments += [(k, 0, place, start, size, 0, size, "m") for place, start, size in rows]
    assert 20 < len(want) < 100
    monkeypatch.setattr(sinks, "placed", None)
    frames = [(k, "x", "11", 1) for k in range(120)], [(k, 0, "video") for k in range(120)], segments, [(k, "m", "video", "/a", 99) for k in range(120)]
    kinds = "draft int, name string, version string, duration long", "draft int, track int, kind string", "draft int, track int, place int, start long, duration long, source_start long, source_duration long, material string", "draft int, material string, kind string, path string, duration long"
    found = sinks.draft_faults(*[spark.createDataFrame(*x) for x in zip(frames, kinds, strict=True)], "11")
    assert {r.draft for r in found.where("fault = 'timeline'").collect()} == want


def test_parts_are_published_together(spark, tmp_path):
    path = str(tmp_path / "out")
    parts = {"drafts": spark.range(3), "rows": spark.range(0)}
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, path)
    broken = {"drafts": spark.range(3), "rows": spark.range(5).select(F.raise_error(F.lit("stop")).alias("id"))}
    with pytest.raises(Exception, match="stop"):
        sinks.publish(broken, path)
    with pytest.raises(FileNotFoundError):  # the first part is there, the marker is not
        sinks.published(spark, path)
    sinks.publish(parts, path)
    assert {k: v.count() for k, v in sinks.published(spark, path).items()} == {"drafts": 3, "rows": 0}
    with pytest.raises(FileExistsError):
        sinks.publish(parts, path)
    spark.range(9).write.mode("append").parquet(f"{path}/drafts")
    with pytest.raises(ValueError, match="not 3"):
        sinks.published(spark, path)


def test_shot_lists_as_files(spark, tmp_path):
    rows = [("d1", k, f"f{k}", "o", 1.5 * k, 2.0, 10, 20, "c", 25, 1, False, "t", "ch", "b", 3, "x", 'say "hi", you', "web", 1, 2, None, 0, "done", None) for k in range(1, 40)] + [("d2", 5, "=f", None, None, 0.0, None, 20, None, 1, 0, True, None, None, None, None, None, "a\nb", None, None, None, 2, 0, "open", "+n")]
    names = "delivery string, n long, file string, output string, start double, seconds double, width int, height int, codec string, fps_num int, fps_den int, vfr boolean, taken string, chapter string, beat string, stars int, badges string, dialogue string, platform string, canvas_width int, canvas_height int, track int, tracks int, status string, note string"
    sinks.write_shot_rows(sinks.shot_rows(spark.createDataFrame(rows, names).repartition(5), "delivery", [F.col("n")]), "delivery", str(tmp_path / "lists"))
    text = {d: "".join(p.read_bytes().decode() for p in sorted((tmp_path / "lists" / f"delivery={d}").glob("part-*"))) for d in ("d1", "d2")}
    lines = text["d1"].split("\r\n")
    assert lines[0] == "\ufeff" + ",".join(sinks.SHOT_COLUMNS) and len(lines) == 41 and lines[-1] == ""
    assert lines[3] == '3,f3,Selected/o,00:00:04.500,00:00:06.500,00:00:02.000,10×20,c,25.000,否,t,ch,b,3,x,"say ""hi"", you",web,1x2,,已导出'
    assert text["d2"] == "\ufeff" + ",".join(sinks.SHOT_COLUMNS) + "\r\n1,'=f,,00:00:00.000,00:00:00.000,00:00:00.000,,,,是,,,,,,\"a\nb\",,,2,'+n\r\n"


def test_dump_of_tables(spark, tmp_path):
    sinks.dump({"clips": spark.createDataFrame([(1, "a", None), (2, None, [1, 2])], "id long, name string, cuts array<int>"), "none": spark.createDataFrame([], "id long")}, str(tmp_path))
    assert sorted(map(str, spark.read.json(str(tmp_path / "clips")).select("id", "name", "cuts").collect())) == ["Row(id=1, name='a', cuts=None)", "Row(id=2, name=None, cuts=[1, 2])"]
    assert spark.read.schema("id long").json(str(tmp_path / "none")).count() == 0
