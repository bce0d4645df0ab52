"""Sound through queries: streams of bytes are made of the tables' columns, cut into chunks anywhere, and analysed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutroom.operators import sound
from cutroom.plans.registry import Register
from cutroom.session import table

_register = Register()
QUERIES, ORACLE_SQL = _register.queries, _register.sql
#: Samples a second of the tracks that are made of events: a quarter of a decoder's, which is enough for clicks.
RATE = sound.RATE // 4


@_register.query("""
WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(range(0, len(h) // 4)) AS i, h FROM b),
v AS (SELECT doc_id, i, CAST('0x' || substr(h, 4 * i + 3, 2) || substr(h, 4 * i + 1, 2) AS BIGINT) AS u FROM s),
w AS (SELECT doc_id, i, CASE WHEN u > 32767 THEN u - 65536 ELSE u END AS v FROM v)
SELECT doc_id, count(*) AS n_samples, CAST(sum(v) AS BIGINT) AS total, CAST(min(v) AS BIGINT) AS low, CAST(max(v) AS BIGINT) AS high, CAST(sum(v * (i % 1000)) AS BIGINT) AS by_place FROM w GROUP BY doc_id
""")
def carried_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13: 16-bit samples of a byte stream that is cut anywhere; the streams are the texts' bytes, in chunks of odd and even sizes."""
    data = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    # chunks of 7, 8, 9, ... bytes: the k-th begins at 7k + k(k - 1) / 2
    last = F.ceil(F.sqrt(2.0 * F.octet_length("data") + 50)).cast("long")
    chunks = data.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last))).selectExpr("doc_id", "k", "substring(data, CAST(7 * k + k * (k - 1) DIV 2 + 1 AS INT), CAST(7 + k AS INT)) AS chunk")
    return sound.sample_totals(sound.carried_samples(chunks, ["doc_id"], "k", "chunk"), ["doc_id"])


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track a user: each event a click of bytes out of its digest and the silence up to the next, at the user's tempo; some users have noise alone."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    digest = F.sha2(F.col("event_id").cast("string"), 512)
    beat = F.floor(60.0 / (70 + F.col("user_id") % 7 * 15) * RATE).cast("int") * 2 - 512
    click = F.concat(F.unhex(F.repeat(digest, 8)), F.unhex(F.repeat(F.lit("00"), beat)))
    quiet = F.unhex(F.repeat(F.regexp_replace(digest, "(..)(.)(.)", "$100"), 175))
    return events.select("user_id", "event_id", F.when(F.col("user_id") % 5 == 4, quiet).otherwise(click).alias("chunk"))


@_register.query()
def sound_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-44, SRC-13, WIN-15 to WIN-19: tempo, beats, sections and cuts of a track a user, from chunks of sound."""
    found = sound.analyse(_tracks(spark, sf_dir), ["user_id"], "event_id", "chunk", RATE)
    beats = found.beats.groupBy("user_id").agg(F.count("*").alias("n_beats"), F.sum(F.col("is_downbeat").cast("long")).alias("n_downbeats"))
    sections = found.sections.groupBy("user_id").agg(F.count("*").alias("n_sections"))
    cuts = found.cuts.groupBy("user_id").agg(F.count("*").alias("n_cuts"))
    told = found.tracks.select("user_id", "n_samples", "duration_ticks", F.round("bpm", 1).alias("bpm"), "fault")
    for counted in (beats, sections, cuts):
        told = told.join(counted, "user_id", "left")
    return told.na.fill(0, ["n_beats", "n_downbeats", "n_sections", "n_cuts"])
