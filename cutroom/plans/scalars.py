"""The scalar functions through queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutroom.functions import geo, scalars
from cutroom.plans.registry import Register
from cutroom.session import table

_register = Register()
QUERIES, ORACLE_SQL = _register.queries, _register.sql


@_register.query("""
SELECT p_partkey, CAST(round(CAST(p_partkey AS DECIMAL(19,0)) * (p_size % 3 + 1) * 1000000 / 30000) AS BIGINT) AS micros, CAST(floor(p_partkey * (p_size % 3 + 1) * 1000.0 / 30000) AS BIGINT) AS floor_ms, greatest(-12, least(14, CAST(round((p_partkey % 360 - 180) / 15.0) AS INTEGER))) AS zone,
 bit_count(xor(CAST(p_partkey * 2654435761 AS BIGINT), CAST(p_partkey * 40503 AS BIGINT))) AS distance, least(300, CAST(pow(2, greatest(p_size % 12 - 1, 0)) AS INTEGER)) AS wait, CASE WHEN p_size * 2 <= 15 THEN 4 WHEN p_size * 2 <= 60 THEN 5 WHEN p_size * 2 <= 90 THEN 6 ELSE 8 END AS seconds_each FROM part
""")
def ticks_zones_and_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9 #5, #7, #8, #14, #17, #20: ticks to other units in exact arithmetic, zones by longitude, bits that differ, waits and tiers."""
    k, size = F.col("p_partkey"), F.col("p_size")
    bits = F.bit_count((k * 2654435761).bitwiseXOR(k * 40503))
    return table(spark, sf_dir, "part").select(
        "p_partkey", scalars.rescale(k, size % 3 + 1, F.lit(30000), 1_000_000).alias("micros"), F.floor(k * (size % 3 + 1) * 1000.0 / 30000).cast("long").alias("floor_ms"),
        geo.zone_hours((k % 360 - 180).cast("double")).alias("zone"), bits.alias("distance"), scalars.backoff_seconds(size % 12).alias("wait"), scalars.seconds_per_clip(size * 2).alias("seconds_each"),
    )


@_register.query("""
SELECT doc_id, contains(lower(text), 'the_') AS literal, contains(lower(text), 'http') OR contains(lower(text), '@') AS has_any, length(text) > 24 AS cut, CASE WHEN length(text) > 24 THEN left(text, 24) || '…' ELSE text END AS short FROM documents WHERE text IS NOT NULL
""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9 #21, #24, #29: literal search in spite of wildcards, any word of a list, shortened texts."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").where("text is not null").select(
        "doc_id", scalars.like_literal(text, "the_").alias("literal"), scalars.contains_any(text, ["HTTP", "@"]).alias("has_any"), (F.length(text) > 24).alias("cut"), scalars.shorten(text, 24).alias("short")
    )


@_register.query("""
WITH p AS (SELECT p_partkey, 'card/' || p_brand || '/' || CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE 'DSC' || p_partkey END || '.mp4' AS path FROM part)
SELECT p_partkey, split_part(path, '/', 3) AS name, 'card/' || split_part(path, '/', 2) AS folder, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey END AS number, CASE WHEN p_partkey % 2 = 0 THEN 'clip:' || p_partkey || ':' ELSE 'segment:' || p_partkey || ':' || (p_partkey + 1) END AS story FROM p
""")
def names_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9 #27, #28, #37: names, folders and numbers of files, and keys of story items."""
    k = F.col("p_partkey")
    path = F.concat(F.lit("card/"), "p_brand", F.lit("/"), F.when(k % 5 == 0, F.col("p_name")).otherwise(F.concat(F.lit("DSC"), k.cast("string"))), F.lit(".mp4"))
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    story = scalars.story_key(F.when(k % 2 == 0, "clip").otherwise("segment"), k, F.when(k % 2 == 1, k + 1))
    return rows.select("p_partkey", scalars.file_name(F.col("path")).alias("name"), scalars.folder(F.col("path")).alias("folder"), scalars.stem_number(F.col("path")).alias("number"), story.alias("story"))


@_register.query("""
SELECT conv_id, turn, round(0.55 * coalesce(length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) / nullif(length(regexp_replace(text, '\\s', '', 'g')), 0), 0) + 0.45 * least(1.0, greatest(0.0, turn / 4.0)), 6) AS clarity FROM conversations WHERE text IS NOT NULL
""")
def transcript_clarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9 #26: how clear a transcript is, by its characters and by what it covers."""
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", F.round(scalars.clarity(F.col("text"), F.col("turn") / 4.0), 6).alias("clarity"))


@_register.query("""
WITH t AS (SELECT event_id, 40.0 + event_id % 200 AS bpm, (event_id % 7) * 1.0 AS a, 10.0 AS b, (event_id % 5) * 1.0 AS c FROM events)
SELECT event_id, round(exp(-0.5 * pow(log2(bpm / 120.0) / 0.9, 2)), 6) AS prior, round(CASE WHEN abs(a - 2 * b + c) > 1e-12 THEN greatest(-0.5, least(0.5, 0.5 * (a - c) / (a - 2 * b + c))) ELSE 0 END, 6) AS peak FROM t
""")
def tempo_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9 #19: a log-normal weight of tempi, and a peak between its neighbours."""
    i = F.col("event_id")
    peak = scalars.parabolic_peak((i % 7) * 1.0, F.lit(10.0), (i % 5) * 1.0)
    return table(spark, sf_dir, "events").select("event_id", F.round(scalars.tempo_prior(40.0 + i % 200), 6).alias("prior"), F.round(peak, 6).alias("peak"))


@_register.query("""
WITH n AS (SELECT DISTINCT CAST(p_size AS INTEGER) AS n FROM part), d AS (SELECT n, substr('零一二三四五六七八九', n // 10 + 1, 1) AS t, substr('零一二三四五六七八九', n % 10 + 1, 1) AS o FROM n),
w AS (SELECT n, CASE WHEN n < 10 THEN o ELSE CASE WHEN n < 20 THEN '' ELSE t END || '十' || CASE WHEN n % 10 = 0 THEN '' ELSE o END END AS words FROM d) SELECT n, words, n AS read, n * 60 + CASE WHEN n % 2 = 0 THEN 30.0 ELSE n END::DOUBLE AS seconds FROM w
""")
def spoken_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9 #31: numbers and lengths of time in words."""
    n = F.col("n")
    digit = lambda c: F.substring(F.lit("零一二三四五六七八九"), c + 1, F.lit(1))
    tens = F.floor(n / 10).cast("int")
    words = F.when(n < 10, digit(n)).otherwise(F.concat(F.when(n < 20, "").otherwise(digit(tens)), F.lit("十"), F.when(n % 10 == 0, "").otherwise(digit(n % 10))))
    rows = table(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("n")).distinct().withColumn("words", words)
    phrase = F.concat("words", F.when(n % 2 == 0, "分半").otherwise(F.concat(F.lit("分钟"), n.cast("string"), F.lit("秒"))))
    return rows.select("n", "words", scalars.han_number(F.col("words")).alias("read"), scalars.spoken_seconds(phrase).alias("seconds"))
