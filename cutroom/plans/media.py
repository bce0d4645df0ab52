"""Sources through queries: probe, frame, log, subtitle and manifest texts are made of the tables' columns and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutroom.functions import geo, scalars
from cutroom.plans.registry import Register
from cutroom.session import spread, table
from cutroom.sources import media

_register = Register()
QUERIES, ORACLE_SQL = _register.queries, _register.sql


def text_of(template: str, **parts: Column) -> Column:
    """A text with named parts in angle brackets filled in."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit(f"<{name}>"), value.cast("string"))
    return out


_PROBE = '{"streams":[{"codec_type":"audio","sample_rate":"<rate>","channels":2},{"codec_type":"video","width":<w>,"height":1080,"time_base":"1/<den>","r_frame_rate":"30/1","avg_frame_rate":"<fps>",<ticks>"tags":{"Rotate":"<rot>"}}],"format":{"duration":"<sec>","tags":{"CREATION_TIME":"<made>"}}}'


@_register.query("""
SELECT p_partkey, CAST(p_size AS BIGINT) * 40 AS width, CAST(1000 AS BIGINT) AS tb_den, CAST(CASE WHEN p_partkey % 4 = 0 THEN 30 ELSE 30000 END AS BIGINT) AS fps_num, p_partkey % 4 <> 0 AS is_vfr,
 CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 7 ELSE (p_partkey % 50) * 1500 END AS duration_ticks, 'on ' || p_partkey AS created, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(48000 AS BIGINT) END AS audio_rate, CAST(CASE WHEN p_partkey % 2 = 0 THEN 270 ELSE 90 END AS BIGINT) AS rotation FROM part
""")
def probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05, SRC-01, 2.9 #7: probe JSON as typed rows, with fallbacks and tags of any case."""
    k = F.col("p_partkey")
    made = text_of(
        _PROBE, rate=F.when(k % 5 == 0, "0").otherwise("48000"), w=F.col("p_size") * 40, den=F.lit(1000), fps=F.when(k % 4 == 0, "30/1").otherwise("30000/1001"),
        ticks=F.when(k % 3 == 0, F.concat(F.lit('"duration_ts":'), (k * 7).cast("string"), F.lit(","))).otherwise(""), rot=F.when(k % 2 == 0, "-90").otherwise("90"), sec=((k % 50) * 1.5), made=F.concat(F.lit("on "), k.cast("string")),
    )
    row = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", media.parse_probe(made).alias("p"))
    return row.select("p_partkey", *[f"p.{c}" for c in ("width", "tb_den", "fps_num", "is_vfr", "duration_ticks", "created", "audio_rate", "rotation")])


@_register.query("""
WITH t AS (SELECT DISTINCT l_orderkey AS k, l_linenumber * 100 + CASE WHEN l_orderkey % 3 = 0 THEN l_partkey % 30 ELSE 0 END AS t FROM lineitem WHERE l_suppkey % 9 <> 0), d AS (SELECT k, t - lag(t) OVER (PARTITION BY k ORDER BY t) AS d FROM t), m AS (SELECT k, avg(d) AS m, count(d) AS n FROM d GROUP BY k),
v AS (SELECT d.k, count(*) FILTER (abs(d - m) > 0.1 * m) / any_value(n) AS share, any_value(n) AS n FROM d JOIN m ON m.k = d.k WHERE d IS NOT NULL GROUP BY d.k)
SELECT t.k AS l_orderkey, list(t ORDER BY t) AS times, coalesce(any_value(v.n) >= 2 AND any_value(v.share) > 0.05, FALSE) AS is_vfr FROM t LEFT JOIN v ON v.k = t.k GROUP BY t.k
""")
def frame_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06: frame JSON as sorted times, and whether they are of a variable rate; frames without a time are none."""
    t = F.col("l_linenumber") * 100 + F.when(F.col("l_orderkey") % 3 == 0, F.col("l_partkey") % 30).otherwise(0)
    frame = F.when(F.col("l_suppkey") % 9 != 0, F.concat(F.lit('{"best_effort_timestamp":"'), t.cast("string"), F.lit('"}'))).otherwise('{"best_effort_timestamp":"N/A"}')
    files = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit('{"frames":['), F.array_join(F.collect_list(frame), ","), F.lit("]}")).alias("j"))
    times = files.select("l_orderkey", media.frame_times(F.col("j")).alias("times")).where("size(times) > 0")
    return times.select("l_orderkey", "times", media.variable_rate(F.col("times")).alias("is_vfr"))


@_register.query("""
SELECT o_custkey, count(*) FILTER (o_orderkey % 6 <> 0) AS yavg_n, round(avg(o_orderkey % 250) FILTER (o_orderkey % 6 <> 0), 6) AS yavg_mean, CAST(max(o_orderkey % 250) FILTER (o_orderkey % 6 <> 0) AS DOUBLE) AS yavg_max, CAST(min(-(o_orderkey % 40)) AS DOUBLE) AS rms_min FROM orders GROUP BY o_custkey
""")
def signal_log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-08, 2.9 #34: aggregates of a whole log's signals, broken numbers left out."""
    k = F.col("o_orderkey")
    said = text_of("frame:1 lavfi.signalstats.YAVG=<y> lavfi.astats.RMS=<r>", y=F.when(k % 6 != 0, (k % 250).cast("string")).otherwise("nan"), r=-(k % 40))
    found = media.signal_totals(table(spark, sf_dir, "orders").select("o_custkey", said.alias("line")), ["o_custkey"], "line", ["YAVG", "RMS"])
    return found.select("o_custkey", "yavg_n", F.round("yavg_mean", 6).alias("yavg_mean"), "yavg_max", "rms_min")


@_register.query("SELECT DISTINCT o_custkey, (o_orderkey % 500) / 4.0::DOUBLE AS seconds FROM orders WHERE o_orderkey % 3 <> 0")
def cut_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-09: the times of scene cuts that a filter's log names."""
    k = F.col("o_orderkey")
    said = text_of("<w> n: 1 pts: 77 pts_time:<t> pos: 5", w=F.when(k % 3 != 0, "[showinfo @ 0x1]").otherwise("frame"), t=(k % 500) / 4.0)
    return media.cut_times(table(spark, sf_dir, "orders").select("o_custkey", said.alias("line")), ["o_custkey"], "line")


@_register.query("""
WITH c AS (SELECT conv_id, turn, turn * 2000 AS a, turn * 2000 + CASE WHEN conv_id % 5 = 0 THEN -10 ELSE 1500 END AS b FROM conversations WHERE turn % 4 <> 3) SELECT conv_id, turn + 1 AS cue, a AS start_ms, CASE WHEN b < 0 THEN NULL ELSE b END AS end_ms, CASE WHEN b < 0 THEN 'clock' WHEN b < a THEN 'order' END AS fault, 'line ' || turn AS text FROM c
""")
def subtitle_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10, SNK-02: subtitle texts read cue by cue, with what a strict reader would refuse."""
    turn = F.col("turn")
    clock = lambda ms: F.when(ms < 0, F.lit("--")).otherwise(scalars.clock(ms, comma=True))
    end = turn * 2000 + F.when(F.col("conv_id") % 5 == 0, -10).otherwise(1500)
    cue = F.concat((turn + 1).cast("string"), F.lit("\r\n"), clock(turn * 2000), F.lit(" --> "), clock(end), F.lit("\r\n"), F.when(turn % 4 != 3, F.concat(F.lit("line "), turn.cast("string"))).otherwise(" "))
    files = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", cue.alias("c")))), lambda s: s["c"]), "\r\n\r\n").alias("t"))
    return media.parse_srt(files, ["conv_id"], "t")


@_register.query("""
SELECT l_orderkey, l_linenumber * 500 AS tick, l_returnflag || l_linestatus AS text, round(least(1.0, l_discount * 12), 4) AS confidence FROM lineitem WHERE l_linenumber % 5 <> 0
""")
def screen_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11: JSON lines of text in frames; broken lines and empty texts are none."""
    n = F.col("l_linenumber")
    said = text_of('{"t": <t>, "text": " <x> ", "confidence": <c>}', t=n * 500, x=F.concat("l_returnflag", "l_linestatus"), c=F.col("l_discount") * 12)
    said = F.when(n % 5 == 0, F.when(n % 2 == 0, "{broken").otherwise('{"t": 5, "text": "  "}')).otherwise(said)
    files = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(said), "\n").alias("t"))
    rows = media.ocr_lines(files, ["l_orderkey"], "t")
    return rows.select("l_orderkey", F.col("tick").cast("long").alias("tick"), "text", F.round("confidence", 4).alias("confidence"))


@_register.query("""
WITH f AS (SELECT p_partkey, ['mp4', 'insv', 'ARW', 'jpeg', 'nef', 'txt', 'MPG'][p_partkey % 7 + 1] AS e, CASE WHEN p_partkey % 11 = 0 THEN 'lib.photoslibrary/in/' WHEN p_partkey % 13 = 0 THEN '.hidden/' ELSE 'card/' END AS d FROM part)
SELECT p_partkey, CASE WHEN e IN ('ARW', 'jpeg') THEN 'photo' ELSE 'video' END AS kind, e = 'ARW' AS raw FROM f WHERE d = 'card/' AND e NOT IN ('nef', 'txt')
""")
def importable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03, SRC-04: what is imported of a listing, by extension, without hidden files and packages."""
    k = F.col("p_partkey")
    ending = F.element_at(F.array(*[F.lit(e) for e in ("mp4", "insv", "ARW", "jpeg", "nef", "txt", "MPG")]), (k % 7 + 1).cast("int"))
    folder = F.when(k % 11 == 0, "lib.photoslibrary/in/").when(k % 13 == 0, ".hidden/").otherwise("card/")
    files = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/v/"), folder, F.lit("x"), k.cast("string"), F.lit("."), ending).alias("path"))
    return files.where(media.importable(F.col("path"))).select("p_partkey", media.media_kind(F.col("path")).alias("kind"), media.is_raw(F.col("path")).alias("raw"))


@_register.query("""
SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 - CASE o_orderkey % 3 WHEN 0 THEN 19800 WHEN 1 THEN -12600 ELSE 0 END AS utc, CASE o_orderkey % 3 WHEN 0 THEN 19800 WHEN 1 THEN -12600 END AS zone FROM orders
""")
def capture_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-18, 2.9 #2, 2.9 #6: a camera's wall clock and zone text as UTC."""
    k = F.col("o_orderkey")
    zone = F.when(k % 3 == 0, "+05:30").when(k % 3 == 1, "UTC-0330")
    clock = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp(media.capture_time(clock, zone)).alias("utc"), media.offset_seconds(zone).alias("zone"))


@_register.query("SELECT doc_id, sha256(encode(text)[1:40] || encode(text)[greatest(strlen(text) - 39, 1) : strlen(text)] || encode(CAST(strlen(text) AS VARCHAR))) AS identity FROM documents")
def quick_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-20: identities by the first and last chunk and the size; chunks of forty bytes here, four megabytes in files."""
    docs = table(spark, sf_dir, "documents").withColumn("b", F.col("text").cast("binary"))
    return docs.select("doc_id", media.quick_hash(F.col("b"), F.length("b"), 40).alias("identity"))


@_register.query("""
SELECT 'G' || r_regionkey AS group_id, 'F' || n_nationkey AS id, n_name AS scenario, CASE WHEN n_nationkey % 3 = 0 THEN TRUE ELSE r_regionkey = 1 END AS golden, CASE WHEN n_nationkey % 4 = 0 THEN CAST(n_nationkey AS BIGINT) ELSE r_regionkey * 1000 END AS tolerance_us, [CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT) * 2] AS boundaries FROM nation JOIN region ON r_regionkey = n_regionkey
""")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-21: fixtures of evaluation manifests under their groups' defaults."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    one = text_of(
        '{"id":"F<n>","scenario":"<name>",<g><t>"scene_boundaries_us":[<n>,<m>]}', g=F.when(n % 3 == 0, '"golden":true,').otherwise(""), t=F.when(n % 4 == 0, F.concat(F.lit('"scene_tolerance_us":'), n.cast("string"), F.lit(","))).otherwise(""),
        n=n, name=F.col("n_name"), m=n * 2,
    )
    files = table(spark, sf_dir, "nation").groupBy(r.alias("r")).agg(F.array_join(F.collect_list(one), ",").alias("f"))
    whole = text_of('{"group":{"id":"G<r>"},"defaults":{"golden":<g>,"scene_tolerance_us":<t>},"fixtures":[<f>]}', r=F.col("r"), g=F.when(F.col("r") == 1, "true").otherwise("false"), t=F.col("r") * 1000, f=F.col("f"))
    return media.manifest_fixtures(files.select(whole.alias("text")), "text")


@_register.query("""
WITH f AS (SELECT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS id, 'q' || (l_partkey % 40) AS q, CASE WHEN l_suppkey % 5 <> 0 THEN 'h' || (l_partkey % 80) END AS h, CASE WHEN l_partkey % 2 = 0 THEN 100 ELSE 9000000 END AS n FROM lineitem),
s AS (SELECT id, min(id) OVER (PARTITION BY q, n) AS o FROM f WHERE n = 100), b AS (SELECT id, min(id) OVER (PARTITION BY q, n, h) AS o FROM f WHERE n > 100 AND h IS NOT NULL) SELECT id, o AS original FROM s WHERE id <> o UNION ALL SELECT id, o FROM b WHERE id <> o
""")
def repeated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-22: files that repeat another: quick hash and size, and the full hash where they are large."""
    p = F.col("l_partkey")
    files = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("q"), (p % 40).cast("string")).alias("q"), F.when(F.col("l_suppkey") % 5 != 0, F.concat(F.lit("h"), (p % 80).cast("string"))).alias("h"), F.when(p % 2 == 0, 100).otherwise(9_000_000).alias("n"),
    )
    return media.duplicate_files(files, "q", "h", "n", "id")


@_register.query("""
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE round((event_id % 900) / 10.0 - 45, 4) END AS lat, CASE WHEN event_id % 9 = 0 THEN NULL ELSE round((event_id % 3000) / 10.0 - 150, 4) END AS lon FROM events
""")
def position_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9 #10, 2.9 #11: places out of ISO 6709 and "lat,lon" texts; anything else is none."""
    i = F.col("event_id")
    lat, lon = (i % 900) / 10.0 - 45, (i % 3000) / 10.0 - 150
    iso = F.concat(F.format_string("%+08.4f", lat), F.format_string("%+09.4f", lon), F.lit("+100.000/"))
    text = F.when(i % 9 == 0, "nowhere").when(i % 2 == 0, iso).otherwise(F.concat_ws(", ", F.format_string("%.4f", lat), F.format_string("%.4f", lon)))
    place = geo.parse_place(text)
    return table(spark, sf_dir, "events").select("event_id", F.round(place["lat"], 4).alias("lat"), F.round(place["lon"], 4).alias("lon"))
