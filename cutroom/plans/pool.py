"""The pool's lists and filters over analogues of clips: customers, their orders as a log of ratings, parts as photos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cutroom.operators import intervals, pool, windows
from cutroom.plans.registry import Register, greedy_groups_sql
from cutroom.plans.timelines import EVENTS, line, micros, seconds
from cutroom.session import table

_register = Register()
QUERIES, ORACLE_SQL = _register.queries, _register.sql

#: The log of ratings: two priorities are favourites and rejections, the rest stars.
RATINGS = """SELECT o_custkey AS clip, o_orderkey AS id, o_orderdate AS t, o_orderpriority >= '3' AS is_star,
 CAST(CASE WHEN o_orderpriority >= '3' THEN o_orderkey % 6 WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 ELSE -1 END AS BIGINT) AS value FROM orders"""
_LAST = f"""SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, coalesce(b, 0) AS "binary", coalesce(s, 0) AS star FROM customer LEFT JOIN (
 SELECT clip, arg_max(value, (t, id)) FILTER (NOT is_star) AS b, arg_max(value, (t, id)) FILTER (is_star) AS s FROM ({RATINGS}) GROUP BY clip) ON clip = c_custkey"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = F.col("o_orderpriority") >= "3"
    value = F.when(star, F.col("o_orderkey") % 6).when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).otherwise(-1)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("clip"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.when(star, "star").otherwise("binary").alias("kind"), value.alias("value"))


def rated_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = ratings(spark, sf_dir).withColumnRenamed("clip", "c_custkey")
    return pool.rated(table(spark, sf_dir, "customer"), log, "c_custkey", "kind", "value", ["at", "id"])


@_register.query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS price FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderstatus = 'F'")
def live_selects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-02: rows of one kind that are not deleted; both tests reach the scan."""
    return table(spark, sf_dir, "orders").where("o_orderkey % 17 <> 0 and o_orderstatus = 'F'").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("price"))


@_register.query(f"""
WITH r AS ({_LAST}) SELECT c_custkey, "binary", star, "binary" = 1 OR star >= 3 AS favorites_or_rated3, "binary" = 1 AS favorites, star >= 3 AS rated3, TRUE AS "all" FROM r
""")
def selection_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-04: the four scopes of an automatic selection, on the latest ratings."""
    clips = rated_clips(spark, sf_dir)
    return clips.select("c_custkey", "binary", "star", *[pool.in_scope(s, F.col("binary"), F.col("star")).alias(s) for s in ("favorites_or_rated3", "favorites", "rated3", "all")])


@_register.query(f"""
WITH whole AS (SELECT * FROM ({RATINGS}) WHERE id % 3 <> 0), r AS (SELECT clip, arg_max(value, (t, id)) FILTER (NOT is_star) AS b, arg_max(value, (t, id)) FILTER (is_star) AS s FROM whole GROUP BY clip)
SELECT clip AS c_custkey FROM r WHERE b = 1 OR s >= 3
""")
def whole_clip_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-06: clips rated as a whole; ratings of selected segments do not count."""
    log = ratings(spark, sf_dir).where("id % 3 <> 0").withColumnRenamed("clip", "c_custkey")
    clips = pool.rated(table(spark, sf_dir, "customer").select("c_custkey"), log, "c_custkey", "kind", "value", ["at", "id"])
    return clips.where(pool.in_scope("favorites_or_rated3", F.col("binary"), F.col("star"))).select("c_custkey")


@_register.query(f"""
WITH r AS ({_LAST}), x AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000), s AS (SELECT r.*, c_acctbal < 0 AND c_custkey NOT IN (SELECT o_custkey FROM x) AS out FROM r)
SELECT 'all' AS mode, c_custkey FROM s WHERE NOT out UNION ALL SELECT 'favorite', c_custkey FROM s WHERE NOT out AND "binary" = 1
UNION ALL SELECT 'unrated', c_custkey FROM s WHERE NOT out AND "binary" = 0 AND star = 0 UNION ALL SELECT 'rejected', c_custkey FROM s WHERE NOT out AND "binary" = -1
""")
def rating_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-08: shown by rating, suspected waste left out unless a clip is exempt."""
    exempt = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select("o_custkey").distinct()
    clips = rated_clips(spark, sf_dir).join(exempt, F.col("o_custkey") == F.col("c_custkey"), "left")
    shown = [F.when(pool.rating_filter(m, F.col("binary"), F.col("star"), F.col("c_acctbal") < 0, F.col("o_custkey").isNotNull(), True), m) for m in ("all", "favorite", "unrated", "rejected")]
    return clips.select("c_custkey", F.explode(F.array_compact(F.array(*shown))).alias("mode")).select("mode", "c_custkey")


@_register.query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def clips_with_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-09: clips that carry a label in a dimension."""
    labels = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit("priority").alias("dimension"), F.col("o_orderpriority").alias("label"))
    return pool.labelled(table(spark, sf_dir, "customer"), labels, "c_custkey", "priority", "1-URGENT").select("c_custkey", "c_name")


@_register.query("""
WITH r AS (SELECT user_id, list(CASE WHEN event_type = 'error' AND value > 60 THEN 'excessive_shake' WHEN event_type = 'view' AND value > 100 THEN '失焦' WHEN event_type = 'click' THEN 'sharp' END) AS reasons FROM events GROUP BY user_id)
SELECT user_id, list_contains(reasons, 'excessive_shake') OR list_contains(reasons, '失焦') AS blocked FROM r
""")
def blocked_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-14: clips with a window whose reasons rule it out, by key or by label; aggregated before they move."""
    kind, v = F.col("event_type"), F.col("value")
    reason = F.when((kind == "error") & (v > 60), "excessive_shake").when((kind == "view") & (v > 100), "失焦").when(kind == "click", "sharp")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(reason).alias("reasons")).select("user_id", pool.blocked(F.col("reasons")).alias("blocked"))


_SIGNALS = "SELECT event_id, -value AS rms, CASE WHEN event_id % 13 = 0 THEN NULL ELSE -value + event_id % 23 END AS peak, CASE WHEN event_id % 7 = 0 THEN NULL ELSE -value + (event_id % 5) - 1 END AS band, (event_id % 3) - 1.0 AS base, -value + event_id % 9 AS top, -value - event_id % 4 AS low FROM events"


@_register.query(f"""
WITH s AS ({_SIGNALS}) SELECT event_id, coalesce(rms >= -30 AND peak - rms >= 10 AND band - rms - base >= 1 AND top - low >= 4, FALSE) AS speech,
 NOT (event_id % 256 >= 225 AND event_id % 200 >= 170) AND NOT (event_id % 40 <= 16 AND event_id % 200 <= 60 AND event_id % 251 < 200) AS exposure_ok FROM s
""")
def speech_and_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-15, FLT-16: level, crest, band prominence and syllables, all four or none; and neither burnt out nor dark."""
    i, rms = F.col("event_id"), -F.col("value")
    speech = pool.has_speech(rms, F.when(i % 13 != 0, rms + i % 23), F.when(i % 7 != 0, rms + (i % 5) - 1), (i % 3) - 1.0, rms + i % 9, rms - i % 4)
    return table(spark, sf_dir, "events").select("event_id", speech.alias("speech"), pool.exposure_ok(i % 40, i % 200, i % 256, i % 251).alias("exposure_ok"))


@_register.query("SELECT event_id, user_id, epoch_us(ts) AS at_us FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-17, CRD-15: the latest failed jobs; a report of a hundred, by definition."""
    failed = table(spark, sf_dir, "events").where("event_type = 'error'")
    return failed.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id", micros("ts").alias("at_us"))


@_register.query("SELECT o_orderkey, (SELECT count(*) FROM orders b WHERE b.o_custkey = a.o_custkey AND (b.o_totalprice > a.o_totalprice OR (b.o_totalprice = a.o_totalprice AND b.o_orderkey < a.o_orderkey))) AS before FROM orders a")
def ranks_by_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-07: how many rows of a key come before each; a row number in place of a counting join."""
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", (rank - 1).cast("long").alias("before"))


@_register.query(f"""
WITH e AS ({EVENTS}), w AS (SELECT event_id, user_id, s AS w0, s + 1800 AS w1, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) - 1 AS idx FROM e WHERE event_type = 'view'), c AS (SELECT user_id, s AS cut FROM e WHERE event_type = 'click')
SELECT event_id, idx > 0 AND EXISTS (SELECT 1 FROM c WHERE c.user_id = w.user_id AND cut >= w0 AND cut < w1) AS scene_cut FROM w
""")
def cuts_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-09: which windows [start, end) hold a cut, the first of a clip excepted; points are intervals of one tick, joined by bins."""
    events = table(spark, sf_dir, "events").withColumn("s", seconds("ts"))
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("s", "event_id")) - 1
    windows_ = events.where("event_type = 'view'").select("event_id", "user_id", F.col("s").alias("w0"), (F.col("s") + 1800).alias("w1"), idx.alias("idx"))
    cuts = events.where("event_type = 'click'").select("user_id", F.col("s").alias("c0"), (F.col("s") + 1).alias("c1")).distinct()
    hit = intervals.overlapping(windows_.where("idx > 0"), cuts, ["user_id"], 3600, ("w0", "w1"), ("c0", "c1")).select("event_id", F.lit(True).alias("hit")).distinct()
    return windows_.select("event_id").join(hit, "event_id", "left").select("event_id", F.coalesce("hit", F.lit(False)).alias("scene_cut"))


_PHOTOS = """SELECT v.vec_id AS id, v.vec_id // 40 AS event, CASE WHEN v.vec_id % 5 = 0 THEN '' ELSE 'cam' || (v.vec_id % 3) END AS camera, CASE WHEN (v.vec_id // 40) % 4 = 3 THEN NULL ELSE v.vec_id * (CASE WHEN v.vec_id % 2 = 0 THEN 700 ELSE 90000 END) END AS taken,
 v.vec_id % 17 AS number, CASE WHEN v.vec_id % 11 <> 0 THEN list_sum(list_transform(range(1, 25), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE 0 END)) END AS hash, v.embedding::DOUBLE[] AS e FROM embeddings v"""


@_register.query(f"""
WITH p AS ({_PHOTOS}), q AS (SELECT a.id AS a, b.id AS b, a.camera <> '' AND a.camera = b.camera AND (coalesce(abs(a.taken - b.taken) <= 1200, FALSE) OR coalesce(abs(a.number - b.number) <= 3, FALSE)) AS burst,
 bit_count(xor(CAST(a.hash AS BIGINT), CAST(b.hash AS BIGINT))) AS bits, list_cosine_similarity(a.e, b.e) AS sim FROM p a JOIN p b ON a.event = b.event AND a.id < b.id AND coalesce(abs(a.taken - b.taken) <= 1800000, TRUE) WHERE a.hash IS NOT NULL AND b.hash IS NOT NULL)
SELECT a, b, CASE WHEN burst THEN 'burst' WHEN bits <= 8 THEN 'visual' ELSE 'semantic' END AS why FROM q WHERE burst OR bits <= 8 OR sim >= 0.9
""")
def photo_pair_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-15: bursts, few differing bits of a hash of signs, or similar vectors, inside an event and half an hour."""
    i = F.col("vec_id")
    signs = F.aggregate(F.sequence(F.lit(1), F.lit(24)), F.lit(0).cast("long"), lambda a, k: a + F.when(F.element_at("embedding", k) > 0, F.pow(F.lit(2.0), k).cast("long")).otherwise(F.lit(0)))
    photos = table(spark, sf_dir, "embeddings").select(
        i.alias("id"), F.floor(i / 40).alias("event"), F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("cam"), (i % 3).cast("string"))).alias("camera"),
        F.when(F.floor(i / 40) % 4 != 3, i * F.when(i % 2 == 0, 700).otherwise(90000)).alias("taken_ms"), (i % 17).alias("number"), F.when(i % 11 != 0, signs).alias("hash"), F.col("embedding").alias("vector"),
    )
    return pool.photo_pairs(photos, close=8)


#: Photos of an episode of 120: bursts every 700 ms, and three quarters of an hour from one burst to the next.
_SHOTS = """SELECT vec_id AS id, vec_id // 120 AS ep, CASE WHEN vec_id % 5 = 0 THEN '' ELSE 'cam' || (vec_id % 3) END AS camera, CASE WHEN vec_id % 29 = 7 THEN NULL ELSE vec_id * 700 + vec_id // 30 * 2700000 END AS taken, vec_id * 7 % 40 AS number, label % 5 AS sharp,
 CASE WHEN vec_id % 11 <> 0 THEN list_sum(list_transform(range(1, 25), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE 0 END)) END AS hash, embedding::DOUBLE[] AS e FROM embeddings"""


@_register.query(f"""
WITH RECURSIVE s AS ({_SHOTS}), b AS (SELECT *, CASE WHEN taken - lag(taken) OVER (PARTITION BY ep, taken IS NULL ORDER BY taken, id) > 1800000 THEN 1 ELSE 0 END AS cut FROM s),
p AS (SELECT *, ep * 1000 + CASE WHEN taken IS NULL THEN 999 ELSE sum(cut) OVER (PARTITION BY ep, taken IS NULL ORDER BY taken, id) END AS event FROM b),
n AS (SELECT a.id, list(b.id) AS near FROM p a JOIN p b ON a.event = b.event AND a.id <> b.id AND coalesce(abs(a.taken - b.taken) <= 1800000, TRUE) AND a.hash IS NOT NULL AND b.hash IS NOT NULL
 AND (a.camera <> '' AND a.camera = b.camera AND (coalesce(abs(a.taken - b.taken) <= 1200, FALSE) OR abs(a.number - b.number) <= 3) OR bit_count(xor(CAST(a.hash AS BIGINT), CAST(b.hash AS BIGINT))) <= 9 OR list_cosine_similarity(a.e, b.e) >= 0.3) GROUP BY a.id),
o AS (SELECT CAST(p.event AS BIGINT) AS event, p.id, row_number() OVER (PARTITION BY p.event ORDER BY p.taken, p.id) AS pos, coalesce(near, CAST([] AS BIGINT[])) AS near FROM p LEFT JOIN n ON n.id = p.id), {greedy_groups_sql(200)},
k AS (SELECT unnest(groups) AS members FROM g), x AS (SELECT unnest(members) AS id, list_min(members) AS "group" FROM k WHERE len(members) > 1)
SELECT x.id, x."group", row_number() OVER (PARTITION BY x."group" ORDER BY sharp DESC, x.id) = 1 AS is_primary FROM x JOIN s ON s.id = x.id
""")
def photo_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-12, WIN-05, JON-15: groups of photos in which every two belong together, inside events split at half-hour gaps."""
    i = F.col("vec_id")
    signs = F.aggregate(F.sequence(F.lit(1), F.lit(24)), F.lit(0).cast("long"), lambda a, k: a + F.when(F.element_at("embedding", k) > 0, F.pow(F.lit(2.0), k).cast("long")).otherwise(F.lit(0)))
    shots = table(spark, sf_dir, "embeddings").select(
        i.alias("id"), F.floor(i / 120).alias("ep"), F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("cam"), (i % 3).cast("string"))).alias("camera"), F.when(i % 29 != 7, i * 700 + F.floor(i / 30) * 2_700_000).alias("taken_ms"),
        (i * 7 % 40).alias("number"), F.when(i % 11 != 0, signs).alias("hash"), F.col("embedding").alias("vector"), (F.col("label") % 5).alias("sharpness"),
    )
    split = windows.chains(shots.where("taken_ms is not null").select("ep", "id", "taken_ms"), ["ep"], "taken_ms", 1_800_001).select("id", "chain")
    events = shots.join(split, "id", "left").withColumn("event", F.concat_ws(":", "ep", F.coalesce(F.col("chain").cast("string"), F.lit("undated"))))
    return pool.photo_clusters(events, close=9, similar=0.3)


@_register.query("""
WITH m AS (SELECT p_partkey, p_brand AS stack, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS member_place, p_size % 10 = 0 AS preferred FROM part WHERE p_size > 10),
s AS (SELECT p_partkey, p_partkey * 7 % 10007 * 100000 + p_partkey AS place FROM part WHERE p_partkey % 3 <> 0), j AS (SELECT * FROM m JOIN s USING (p_partkey))
SELECT stack, min(place) AS place, arg_min(p_partkey, (NOT preferred, member_place)) AS p_partkey, count(*) AS shown FROM j GROUP BY stack
UNION ALL SELECT NULL, place, p_partkey, 1 FROM s WHERE p_partkey NOT IN (SELECT p_partkey FROM m)
""")
def shot_stack_wall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-18: shown clips with every stack once, by its preferred shown member."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    members = part.where("p_size > 10").select("p_partkey", F.col("p_brand").alias("stack"), place.alias("member_place"), (F.col("p_size") % 10 == 0).alias("preferred"))
    shown = part.where(k % 3 != 0).select("p_partkey", (k * 7 % 10007 * 100000 + k).alias("place"))
    return pool.stack_wall(shown, members, "p_partkey", "stack", "preferred", "place")


@_register.query("""
SELECT event_id, key, CAST(json_extract(props, '$.' || key) AS BIGINT) AS n FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) WHERE CAST(json_extract(props, '$.' || key) AS BIGINT) >= 50
""")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-20: a table out of each row's JSON."""
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "n"))
    return rows.where("n >= 50")


@_register.query("""
WITH s AS (SELECT p_partkey, 'v/' || p_name || '/' || p_partkey AS path, p_size AS bytes, CASE WHEN p_partkey % 6 <> 0 THEN md5(p_name) END AS full_hash FROM part WHERE p_partkey % 2 = 0),
n AS (SELECT 'v/' || p_name || '/' || p_partkey AS path, CASE WHEN p_partkey % 10 = 0 THEN p_size + 1 ELSE p_size END AS bytes, md5(CASE WHEN p_partkey % 14 = 0 THEN 'other' ELSE p_name END) AS full_hash FROM part WHERE p_partkey % 4 = 0)
SELECT p_partkey, CASE WHEN n.path IS NULL THEN 'missing' WHEN s.full_hash IS NULL THEN 'no_hash' WHEN s.bytes = n.bytes AND s.full_hash = n.full_hash THEN 'relinked' ELSE 'differs' END AS state FROM s LEFT JOIN n ON n.path = s.path
""")
def relinked_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-23, DOM-53: missing assets found again under a new mount: one path, and size and hashes must agree; without a stored hash it stays."""
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    path = F.concat_ws("/", F.lit("v"), "p_name", k.cast("string"))
    stored = part.where(k % 2 == 0).select("p_partkey", path.alias("path"), F.col("p_size").alias("bytes"), F.when(k % 6 != 0, F.md5("p_name")).alias("full_hash"))
    found = part.where(k % 4 == 0).select(path.alias("path"), F.when(k % 10 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("new_bytes"), F.md5(F.when(k % 14 == 0, F.lit("other")).otherwise(F.col("p_name"))).alias("new_hash"))
    same = (F.col("bytes") == F.col("new_bytes")) & (F.col("full_hash") == F.col("new_hash"))
    state = F.when(F.col("new_hash").isNull(), "missing").when(F.col("full_hash").isNull(), "no_hash").when(same, "relinked").otherwise("differs")
    return stored.join(found, "path", "left").select("p_partkey", state.alias("state"))


@_register.query(f"WITH e AS ({EVENTS}) SELECT user_id, CAST(sum(CASE WHEN event_type = 'view' THEN 600 ELSE 60 END) AS BIGINT) AS spanned, count(*) AS spans FROM e GROUP BY user_id")
def summed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10: lengths of a key's spans, added up; what overlaps counts twice."""
    spans = table(spark, sf_dir, "events").withColumn("a", seconds("ts")).withColumn("b", F.col("a") + F.when(F.col("event_type") == "view", 600).otherwise(60))
    return spans.groupBy("user_id").agg(F.sum(F.col("b") - F.col("a")).alias("spanned"), F.count("*").alias("spans"))


@_register.query("""
WITH r AS (SELECT o_custkey, max(CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice * 20 END) AS m FROM orders GROUP BY o_custkey)
SELECT o_custkey, CAST(floor(coalesce(least(greatest(m * 1.5, 2000000), 8000000), 8000000) / 1000 + 0.5) AS BIGINT) AS kbps FROM r
""")
def export_bit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-31: an export's bit rate from its sources' greatest one."""
    rate = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") * 20)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(pool.bit_rate(rate, 8_000_000).alias("kbps"))


@_register.query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS number FROM orders")
def dense_surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01: numbers without gaps over a whole table, by ranges and their counts."""
    return pool.dense_numbers(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "number")


@_register.query("""
WITH l AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
s AS (SELECT user_id, unnest(range(CAST(ceil(max(n) / 2.0) AS BIGINT))) AS second FROM l GROUP BY user_id)
SELECT s.user_id, s.second, count(*) AS rows, round(avg(value), 6) AS mean FROM s JOIN l ON l.user_id = s.user_id AND i >= second * 2 - 1 AND i < second * 2 + 3 GROUP BY s.user_id, s.second
""")
def per_second_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-11: overlapping slices of two rows a second, with one row more on either side."""
    rows = line(spark, sf_dir).withColumn("i", F.col("idx") - 1)
    sliced = pool.overlapping_slices(rows, ["user_id"], "i", 2)
    return sliced.groupBy("user_id", F.col("second").cast("long").alias("second")).agg(F.count("*").alias("rows"), F.round(F.avg("value"), 6).alias("mean"))


@_register.query("""
WITH s AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, round(sum(value), 4) AS energy FROM events GROUP BY ALL), k AS (SELECT *, count(*) OVER w AS n, max(day) OVER w AS last, lag(energy) OVER (PARTITION BY user_id ORDER BY day) AS before,
 row_number() OVER (PARTITION BY user_id ORDER BY energy DESC, day DESC) AS strongest FROM s WINDOW w AS (PARTITION BY user_id))
SELECT user_id, day, CASE WHEN n < 2 THEN NULL WHEN strongest = 1 THEN 'climax' WHEN before IS NULL THEN 'intro' WHEN day = last THEN 'outro' WHEN energy > before THEN 'build' ELSE 'verse' END AS label FROM k
""")
def section_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-17: sections named by their energy and by the one before."""
    days = table(spark, sf_dir, "events").groupBy("user_id", F.floor(micros("ts") / 86_400_000_000).cast("long").alias("day")).agg(F.round(F.sum("value"), 4).alias("energy"))
    return pool.section_labels(days, ["user_id"], "day", "energy").select("user_id", "day", "label")


@_register.query(f"""
WITH e AS ({EVENTS}), l AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS done, count(*) OVER (PARTITION BY user_id) AS n FROM e), g AS (SELECT user_id, s, max(done) AS done, min(200 - done) AS left_ FROM l GROUP BY user_id, s),
w AS (SELECT * FROM g QUALIFY s >= max(s) OVER (PARTITION BY user_id) - 86400), x AS (SELECT user_id, min(s) AS s0, max(s) AS s1, arg_min(done, s) AS d0, arg_max(done, s) AS d1, arg_max(left_, s) AS left_ FROM w GROUP BY user_id)
SELECT user_id, CASE WHEN d1 > d0 AND s1 > s0 THEN round(left_ / CAST(d1 - d0 AS DOUBLE) * (s1 - s0), 4) END AS eta FROM x
""")
def time_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-23: what is left by the speed of the last day."""
    events = table(spark, sf_dir, "events").withColumn("s", seconds("ts"))
    done = F.row_number().over(Window.partitionBy("user_id").orderBy("s", "event_id"))
    samples = events.withColumn("done", done).groupBy("user_id", "s").agg(F.max("done").alias("done"), F.min(200 - F.col("done")).alias("left"))
    return pool.trailing_eta(samples, ["user_id"], "s", "done", "left", 86400).select("user_id", F.round("eta", 4).alias("eta"))


@_register.query("SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 200")
def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-05: a list of two hundred at most, in order."""
    return table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").limit(200).select("conv_id", "turn", "role")


@_register.query("""
WITH d AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part) SELECT name, row_number() OVER (ORDER BY lower(name), name) AS place FROM d
""")
def names_ignoring_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-06: names sorted without regard to case, the exact spelling deciding between equals."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return pool.dense_numbers(table(spark, sf_dir, "part").select(name.alias("name")).distinct(), [F.lower("name"), F.col("name")], "place")


@_register.query("SELECT p_brand, count(*) AS moments, count(DISTINCT p_type) AS clips, row_number() OVER (ORDER BY count(*) DESC, count(DISTINCT p_type) DESC, p_brand DESC) = 1 AS reference FROM part GROUP BY p_brand")
def reference_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-10: the device whose clock the others follow: most moments, then most clips, then the greater name. One aggregate over a row a device."""
    devices = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("moments"), F.countDistinct("p_type").alias("clips"))
    best = devices.agg(F.max(F.struct("moments", "clips", "p_brand")).alias("b")).select(F.col("b.p_brand").alias("best"))
    return devices.join(F.broadcast(best), F.col("best") == F.col("p_brand"), "left").select("p_brand", "moments", "clips", F.col("best").isNotNull().alias("reference"))


@_register.query("""
WITH m AS (SELECT p_partkey AS k, p_size AS rank FROM part WHERE p_partkey % 4 = 0) SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY rank IS NULL, rank, o_orderdate IS NULL, o_orderdate, o_orderkey) AS place FROM orders LEFT JOIN m ON k = o_orderkey
""")
def manual_then_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-11: a saved order first, then capture time, unknown last."""
    manual = table(spark, sf_dir, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("o_orderkey"), F.col("p_size").alias("rank"))
    rows = table(spark, sf_dir, "orders").join(manual, "o_orderkey", "left")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.asc_nulls_last("rank"), F.asc_nulls_last("o_orderdate"), "o_orderkey"))
    return rows.select("o_orderkey", place.cast("long").alias("place"))


@_register.query("""
WITH t AS (SELECT o_custkey, trim(CASE WHEN o_orderkey % 9 = 0 THEN '  ' ELSE ' ' || o_orderpriority || ' ' END) AS phrase, o_totalprice, o_orderkey FROM orders), d AS (SELECT o_custkey, phrase, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS k, max(o_totalprice) AS p FROM t WHERE phrase <> '' GROUP BY ALL)
SELECT o_custkey, phrase, row_number() OVER (PARTITION BY o_custkey ORDER BY p DESC, k) AS rank FROM d QUALIFY rank <= 3
""")
def leading_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-13: the three most confident phrases of each clip, trimmed and distinct."""
    text = F.when(F.col("o_orderkey") % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))
    rows = table(spark, sf_dir, "orders").withColumn("text", text)
    found = pool.top_phrases(rows, "o_custkey", "text", [-F.col("o_totalprice"), F.col("o_orderkey")])
    return found.select("o_custkey", "phrase", F.col("rank").cast("long").alias("rank"))


@_register.query("""
WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN epoch_us(o_orderdate) END AS t, o_orderkey * 7919 % 1000003 AS pos FROM orders) SELECT o_orderkey, row_number() OVER (ORDER BY t IS NULL, t, pos, o_orderkey) AS place FROM p
""")
def pool_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-16, DOM-55: the pool by capture time, unknown last and in the order they had."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 10 != 0, micros("o_orderdate")).alias("at"), (k * 7919 % 1000003).alias("pos"))
    return pool.dense_numbers(rows, [F.asc_nulls_last("at"), F.col("pos"), k], "place").select("o_orderkey", "place")


@_register.query("""
WITH a AS (SELECT doc_id, 'text' AS kind, n_chars AS score FROM documents WHERE lang = 'en'), b AS (SELECT DISTINCT ON (doc_id) doc_id, 'name' AS kind, n_chars + k AS score FROM documents, (SELECT unnest([0, 1]) AS k) WHERE doc_id % 3 = 0 ORDER BY doc_id, n_chars + k)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)
""")
def authoritative_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-03: one list of hits wins by clip; the other adds what it has none of, once."""
    docs = table(spark, sf_dir, "documents")
    first = docs.where("lang = 'en'").select("doc_id", F.lit("text").alias("kind"), F.col("n_chars").alias("score"))
    second = docs.where("doc_id % 3 = 0").select("doc_id", F.lit("name").alias("kind"), F.explode(F.array(F.col("n_chars"), F.col("n_chars") + 1)).alias("score"))
    return pool.authoritative_union(first, second, "doc_id", ["score"])


@_register.query("""
WITH u AS (SELECT 'clip' AS kind, o_orderkey AS id, CASE WHEN o_orderkey % 8 <> 0 THEN epoch_us(o_orderdate) END AS t FROM orders UNION ALL SELECT 'place', n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 1000000 END FROM nation)
SELECT kind, id, row_number() OVER (ORDER BY t IS NULL, t, kind, id) AS place FROM u
""")
def journey_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-07, DOM-49: clips and destinations on one line, the undated last."""
    k, n = F.col("o_orderkey"), F.col("n_nationkey")
    clips = table(spark, sf_dir, "orders").select(F.lit("clip").alias("kind"), k.alias("id"), F.when(k % 8 != 0, micros("o_orderdate")).alias("at"))
    places = table(spark, sf_dir, "nation").select(F.lit("place").alias("kind"), n.cast("long").alias("id"), F.when(n % 2 == 0, n.cast("long") * 1_000_000).alias("at"))
    return pool.dense_numbers(clips.unionByName(places), [F.asc_nulls_last("at"), F.col("kind"), F.col("id")], "place").select("kind", "id", "place")
