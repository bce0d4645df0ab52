import datetime as dt

from pyspark.sql import functions as F

from cutroom.sources import media, sinks
from cutroom.streaming import jobs
from cutroom.streaming.tables import KeyedTable
from tests.conftest import rows


def test_subtitles_there_and_back(spark):
    text = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\nHello\r\nworld\r\n\r\n2\r\n00:00:02,000 --> 00:00:04,000\r\n\r\n3\n00:00:03,000 --> bad\nLast\n"
    cues = media.parse_srt(spark.createDataFrame([(1, text)], "k long, t string"), ["k"], "t")
    assert rows(cues.select("cue", "start_ms", "end_ms", "text")) == [(1, 1000, 2500, "Hello\nworld"), (3, 3000, None, "Last")]
    odd = media.parse_srt(spark.createDataFrame([(1, "x\n00:00:01,000 --> 00:00:02,000\nA\n\n7\n00:00:05,000 --> 00:00:04,000\nB")], "k long, t string"), ["k"], "t")
    assert rows(odd.select("cue", "fault", "text")) == [(7, "order", "B"), (None, "number", "A")]
    srt = sinks.subtitles(spark.createDataFrame([(1, 0, 3000, "a"), (1, 2000, 4000, "b")], "k long, s long, e long, t string"), ["k"], "s", "e", "t").first().srt
    assert srt == "1\n00:00:00,000 --> 00:00:02,000\na\n\n2\n00:00:02,000 --> 00:00:04,000\nb\n"


def test_window_log(spark):
    lines = ["noise k=1", "frame t=0.0", "yavg=10.5", "entropy=x", "frame t=0.5", "yavg=3 entropy=0.25", "yavg=4"]
    df = spark.createDataFrame([(1, i, line) for i, line in enumerate(lines)], "k long, n long, line string")
    assert rows(media.parse_window_log(df, ["k"], "n", "line", r"^frame t=(\S+)", ["yavg", "entropy"])) == [(1, 0, 0.0, 10.5, None), (1, 1, 0.5, 4.0, 0.25)]


def test_media_rules(spark):
    probe = '{"streams":[{"codec_type":"audio","sample_rate":"48000","channels":2},{"codec_type":"video","width":1920,"time_base":"1/1000","r_frame_rate":"30/1","avg_frame_rate":"30000/1001","tags":{"Rotate":"-90"}}],"format":{"duration":"12.5","tags":{"CREATION_TIME":"now"}}}'
    row = spark.range(1).select(
        media.media_kind(F.lit("/a/b.MOV")).alias("a"), media.media_kind(F.lit("x.txt")).alias("b"), media.parse_probe(F.lit(probe)).alias("p"), media.offset_seconds(F.lit("UTC-03:30")).alias("o"),
        media.capture_time(F.lit("2024:02:29 10:00:00"), F.lit("+02:00")).alias("t"),
    ).first()
    assert (row.a, row.b, row.o) == ("video", None, -12600) and (row.p.width, row.p.height, row.p.duration_ticks, row.p.fps_num, row.p.fps_den) == (1920, None, 12500, 30000, 1001)
    assert (row.p.is_vfr, row.p.rotation, row.p.created, row.p.audio_rate) == (True, 270, "now", 48000)
    taken = {"/a/b.insv": "video", "/a/.b.mov": None, "/a/x.photoslibrary/originals/b.mov": None, "/a/c.ARW": "photo", "/a/c.nef": None, "/a/.mov": None, "/a/d.3gp": "video"}
    found = spark.createDataFrame([(k,) for k in taken], "p string").select("p", F.when(media.importable(F.col("p")), media.media_kind(F.col("p"))).alias("k"))
    assert {r.p: r.k for r in found.collect()} == taken
    pairs = media.companions(spark.createDataFrame([("/a/IMG.jpg",), ("/a/img.DNG",), ("/a/IMG.mov",), ("/b/IMG.mov",)], "p string"), "p")
    assert rows(pairs) == [("/a/IMG.jpg", "/a/IMG.mov"), ("/a/IMG.jpg", "/a/img.DNG")]
    assert row.t == dt.datetime(2024, 2, 29, 8, 0)
    files = spark.createDataFrame([(1, "q", "f", 10), (2, "q", None, 10), (3, "q", "f", 99_000_000), (4, "q", "f", 99_000_000), (5, "q", None, 99_000_000)], "i long, q string, f string, n long")
    assert rows(media.duplicate_files(files, "q", "f", "n", "i")) == [(2, 1), (4, 3)]


def test_shot_list_is_guarded(spark, tmp_path):
    sinks.write_shot_list(spark.createDataFrame([("=1+1", None)], "a string, b string"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, quote='"').first().a == "'=1+1"


def test_stream_merges_batches_and_sessions(spark, tmp_path):
    schema = "k long, at timestamp, v long"
    day = dt.datetime(2024, 1, 1)
    table = KeyedTable(str(tmp_path / "table"), ["k"], buckets=2)
    for n, part in enumerate([[(1, day, 1), (2, day, 2)], [(1, day + dt.timedelta(minutes=10), 5), (3, day + dt.timedelta(hours=5), 7)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.watch(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        jobs.run_available(stream, str(tmp_path / "check"), table.upserts(["at", "v"]))
        assert table.rows(spark).count() == (2, 3)[n]
    assert rows(table.rows(spark).select("k", "v")) == [(1, 5), (2, 2), (3, 7)]
    again = table.upserts(["at", "v"])
    late = spark.createDataFrame([(1, day, 9), (1, day, 8), (4, day, 1)], schema)
    for _ in range(2):  # a batch that is run again gives the same table
        again(late, 2)
        assert rows(table.rows(spark).select("k", "v")) == [(1, 9), (2, 2), (3, 7), (4, 1)]
    seen = []
    stream = jobs.sessions(jobs.watch(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), "k", "at", "30 minutes")
    jobs.run_available(stream, str(tmp_path / "check2"), lambda df, n: seen.extend(rows(df.select("k", "n"))))
    assert sorted(seen) == [(1, 2), (2, 1)]  # the last session is still open


def test_stream_dedups_windows_and_outbox(spark, tmp_path):
    schema = "k long, at timestamp, v double"
    day = dt.datetime(2024, 1, 1)
    tick = lambda ms: day + dt.timedelta(milliseconds=ms)
    spark.createDataFrame([(1, tick(0), 1.0), (1, tick(100), 3.0), (1, tick(600), 5.0), (2, tick(700), 7.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    kind = spark.createDataFrame([], schema).schema
    first, windows = [], []
    jobs.run_available(jobs.enqueue_once(jobs.watch(spark, str(tmp_path / "in"), kind), ["k"], "at"), str(tmp_path / "c1"), lambda df, n: first.extend(rows(df.select("k"))))
    assert sorted(first) == [(1,), (2,)]
    fresh = jobs.tumbling(jobs.watch(spark, str(tmp_path / "in"), kind), "k", "at", "500 milliseconds", "v")
    jobs.run_available(fresh, str(tmp_path / "c2"), lambda df, n: windows.extend(rows(df.select("k", "mean", "n"))), mode="update")
    assert sorted(windows) == [(1, 2.0, 2), (1, 5.0, 1), (2, 7.0, 1)]
    out = KeyedTable(str(tmp_path / "out"), ["k"], buckets=2)
    send = out.firsts()
    for number in (0, 0, 1, 1):
        send(spark.createDataFrame([(1, day, 1.0), (2 + number, day, 2.0)], schema), number)
    assert rows(out.rows(spark).select("k")) == [(1,), (2,), (3,)]
    batches = jobs.drained(spark.createDataFrame([(1, tick(0), 1.0), (1, tick(10), 1.0)], schema), "k", "at", "1 minute")
    assert rows(batches.select("k", "rows")) == [(1, 2)]


def test_dependents_and_stale_results(spark):
    needs = spark.createDataFrame([(3, 1), (3, 2), (4, 1), (5, 9)], "job long, need long")
    states = spark.createDataFrame([(1, "done"), (2, "retry"), (3, "waiting"), (4, "waiting"), (5, "waiting"), (6, "waiting")], "job long, state string")
    assert rows(jobs.ready(needs, states, "job", "need", "state")) == [(4,), (6,)]
    results = spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (3, 2, "old")], "k long, version int, h string")
    inputs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "k long, h string")
    assert rows(jobs.stale(results, inputs, "k", "version", "h", 2)) == [(2,), (3,), (4,)]


def test_job_states(spark):
    log = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False), (2, 2, False), (3, 1, False), (3, 2, False), (3, 3, False)], "job long, at long, ok boolean")
    assert rows(jobs.job_states(log, "job", "at", "ok").select("job", "state", "wait_seconds")) == [(1, "done", None), (2, "retry", 2), (3, "blocked", None)]


def test_words_of_routines_are_sought_in_one_folded_text(spark):
    from cutroom.functions import scalars

    none = F.lit(None).cast("string")
    assert str(scalars.routine_of(F.col("t"), none, none, none, none)).count("lower(") == 1
    rows = [("We DRIVE after Coffee", "咖啡"), ("再去加油。站", "加油"), ("手 冲", None), (None, None), ("in reverse", "倒车"), ("İ sleep", "睡觉")]
    found = spark.createDataFrame([r[0] for r in rows], "string").select(F.col("value").alias("t"), scalars.routine_of(F.col("value"), none, none, none, none).alias("r")).collect()
    assert [(r.t, r.r) for r in found] == rows


def test_cells_of_a_line_are_worked_out_once(spark):
    from cutroom.functions import scalars

    assert str(sinks.csv_line([scalars.guard_formula(F.upper("a")), F.upper("b")])).count("upper(") == 2
    rows = [("=x", "a,b", "'=x,\"a,b\""), ("  -x", 'q"', "'  -x,\"q\"\"\""), ("é=", "a\nb", "é=,\"a\nb\""), ("", None, ""), (None, "\r", '"\r"'), ("\t@", "@", "\t@,'@")]
    df = spark.createDataFrame([r[:2] for r in rows], "a string, b string")
    assert [r[0] for r in df.select(sinks.csv_line([scalars.guard_formula(F.col(c)) for c in df.columns])).collect()] == [r[2] for r in rows]


def test_probes_of_a_small_file_are_parsed_by_many_tasks(spark):
    from cutroom import catalogue

    found = catalogue.QUERIES["probe_rows"](spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
