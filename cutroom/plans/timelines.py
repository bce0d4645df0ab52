"""Time lines: sessions, intervals, as-of joins, sliding windows, running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cutroom.functions.geo import haversine_km
from cutroom.operators import intervals, sessions, windows
from cutroom.plans.registry import Register
from cutroom.session import table

_register = Register()
QUERIES, ORACLE_SQL = _register.queries, _register.sql


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def seconds(c: str) -> Column:
    return F.floor(micros(c) / 1_000_000).cast("long")


#: Events on each user's own line of whole seconds.
EVENTS = "SELECT *, epoch_us(ts) // 1000000 AS s FROM events"


@_register.query("""
WITH gaps AS (
  SELECT user_id, ts, event_id, value,
         epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap
  FROM events
), numbered AS (
  SELECT *, sum(CASE WHEN gap > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no
  FROM gaps
)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS n_events, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us,
       round(sum(value), 4) AS total_value
FROM numbered GROUP BY user_id, session_no
""")
def sessionize_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-03: sessions of a user's events, split at gaps over twelve hours."""
    marked = sessions.mark_sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", 12 * 3600, tie="event_id")
    return marked.groupBy("user_id", "session_no").agg(
        F.count("*").alias("n_events"), F.min(micros("ts")).alias("start_us"), F.max(micros("ts")).alias("end_us"), F.round(F.sum("value"), 4).alias("total_value")
    )


_PLACES = "40 + (event_id % 50) * 0.01 AS lat, 10 + (event_id % 70) * 0.01 AS lon"


def placed(events: DataFrame) -> DataFrame:
    """Events with places derived from their ids; the tables have none of their own."""
    return events.withColumn("lat", 40 + (F.col("event_id") % 50) * 0.01).withColumn("lon", 10 + (F.col("event_id") % 70) * 0.01)


@_register.query(f"""
WITH p AS (SELECT *, {_PLACES} FROM events), l AS (
  SELECT *, lag(ts) OVER w AS pts, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), f AS (
  SELECT *, CASE WHEN epoch_us(ts) - epoch_us(pts) > 86400000000 OR
    2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2)))) > 20 THEN 1 ELSE 0 END AS s FROM l
), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM f)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS n_events FROM n GROUP BY ALL
""")
def sessionize_gap_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-03: sessions split at a gap or a move; a missing place splits nothing."""
    events = placed(table(spark, sf_dir, "events"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    moved = haversine_km(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon")) > 20
    marked = sessions.mark_sessions(events, ["user_id"], "ts", 24 * 3600, tie="event_id", also=moved)
    return marked.groupBy("user_id", "session_no").agg(F.count("*").alias("n_events"))


@_register.query("""
WITH f AS (SELECT user_id, event_type, event_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 120000000 THEN 1 ELSE 0 END AS s FROM events)
SELECT event_id, CAST(sum(s) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS BIGINT) AS bucket FROM f
""")
def bucket_takes_120s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04: takes of one kind belong together while the gap is two minutes at most."""
    marked = sessions.mark_sessions(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", 120, tie="event_id")
    return marked.select("event_id", F.col("session_no").alias("bucket"))


@_register.query("""
WITH iv AS (SELECT o_custkey AS k, epoch_us(o_orderdate) // 86400000000 AS s, min(epoch_us(l_shipdate)) // 86400000000 AS e
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate), v AS (SELECT * FROM iv WHERE e > s), m AS (
  SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM v
), i AS (SELECT *, sum(f) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM m)
SELECT k AS o_custkey, CAST(sum(b - a) AS BIGINT) AS covered FROM (SELECT k, n, min(s) AS a, max(e) AS b FROM i GROUP BY k, n) GROUP BY k
""")
def interval_union_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11: days covered by any of a customer's orders, from order to first shipment."""
    day = lambda c: F.floor(micros(c) / 86_400_000_000).cast("long")
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("l_shipdate"))
    spans = table(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", day("o_orderdate").alias("s"), day("l_shipdate").alias("e"))
    return intervals.coverage(spans, ["o_custkey"], "s", "e")


@_register.query(f"""
WITH e AS ({EVENTS}), w AS (SELECT event_id, user_id, s AS w0, s + 3600 AS w1 FROM e WHERE event_type = 'view'),
t AS (SELECT user_id, s - 900 AS t0, s + 900 AS t1 FROM e WHERE event_type = 'purchase')
SELECT event_id, count(t0) > 0 AS overlapped, count(t0) AS n FROM w LEFT JOIN t ON t.user_id = w.user_id AND t0 < w1 AND w0 < t1 GROUP BY event_id
""")
def range_overlap_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-08: which windows meet a span of their key, by a binned equi-join."""
    events = table(spark, sf_dir, "events").withColumn("s", seconds("ts"))
    left = events.where("event_type = 'view'").select("event_id", "user_id", F.col("s").alias("w0"), (F.col("s") + 3600).alias("w1"))
    right = events.where("event_type = 'purchase'").select("user_id", (F.col("s") - 900).alias("t0"), (F.col("s") + 900).alias("t1"))
    hits = intervals.overlapping(left, right, ["user_id"], 3600, ("w0", "w1"), ("t0", "t1")).groupBy("event_id").agg(F.count("*").alias("n"))
    return left.select("event_id").join(hits, "event_id", "left").select("event_id", F.col("n").isNotNull().alias("overlapped"), F.coalesce("n", F.lit(0)).alias("n"))


@_register.query(f"""
WITH e AS ({EVENTS}), r AS (SELECT user_id, s, min(event_id) AS event_id FROM e WHERE event_type = 'click' GROUP BY user_id, s)
SELECT q.event_id, arg_min(r.s, abs(r.s - q.s) * 100000000000 + r.s) AS matched_t, arg_min(r.event_id, abs(r.s - q.s) * 100000000000 + r.s) AS matched_event_id
FROM (SELECT * FROM e WHERE event_type = 'error') q LEFT JOIN r ON r.user_id = q.user_id GROUP BY q.event_id
""")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-10: each error's nearest click of the same user, the earlier of equals, by windows over one time line."""
    events = table(spark, sf_dir, "events").withColumn("s", seconds("ts"))
    clicks = events.where("event_type = 'click'").groupBy("user_id", "s").agg(F.min("event_id").alias("event_id"))
    errors = events.where("event_type = 'error'").select("user_id", "s", "event_id")
    found = intervals.nearest(errors, clicks, ["user_id"], "s", "s", ["event_id"])
    return found.select("event_id", "matched_t", "matched_event_id")


@_register.query(f"""
WITH e AS ({EVENTS}), p AS (SELECT user_id, s AS x, avg(value) AS y FROM e WHERE event_type = 'view' AND value IS NOT NULL GROUP BY user_id, s),
q AS (SELECT event_id, user_id, s FROM e WHERE event_type = 'signup'), b AS (
 SELECT q.event_id, max(CASE WHEN p.x <= q.s THEN p.x END) AS x0, min(CASE WHEN p.x >= q.s THEN p.x END) AS x1, any_value(q.s) AS s, any_value(q.user_id) AS user_id FROM q LEFT JOIN p ON p.user_id = q.user_id GROUP BY q.event_id)
SELECT event_id, round(CASE WHEN x0 IS NULL THEN p1.y WHEN x1 IS NULL OR x0 = x1 THEN p0.y ELSE p0.y + (s - x0) / (x1 - x0) * (p1.y - p0.y) END, 4) AS interpolated
FROM b LEFT JOIN p p0 ON p0.user_id = b.user_id AND p0.x = b.x0 LEFT JOIN p p1 ON p1.user_id = b.user_id AND p1.x = b.x1
""")
def bracket_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-11: a value between the points around it, level beyond the ends."""
    events = table(spark, sf_dir, "events").withColumn("s", seconds("ts"))
    points = events.where("event_type = 'view' and value is not null").groupBy("user_id", F.col("s").alias("x")).agg(F.avg("value").alias("y"))
    queries = events.where("event_type = 'signup'").select("event_id", "user_id", "s")
    return intervals.interpolated(queries, points, ["user_id"], "s", "x", "y").select("event_id", F.round("interpolated", 4).alias("interpolated"))


@_register.query("""
SELECT l_suppkey, round(median(l_quantity), 4) AS mean_of_middles, quantile_disc(l_quantity, 0.5) AS lower_median, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS upper_median
FROM lineitem GROUP BY l_suppkey
""")
def medians_three_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15: the three medians in use: mean of the middles, the lower one, the upper one."""
    n, order = F.count("*").over(Window.partitionBy("l_suppkey")), F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_quantity"))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity").withColumn("n", n).withColumn("r", order)
    at = lambda place: F.max(F.when(F.col("r") == place, F.col("l_quantity")))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    return rows.groupBy("l_suppkey").agg(at(low).alias("lower_median"), at(high).alias("upper_median")).select(
        "l_suppkey", F.round((F.col("lower_median") + F.col("upper_median")) / 2, 4).alias("mean_of_middles"), "lower_median", "upper_median"
    )


@_register.query("""
WITH i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events WHERE value IS NOT NULL), b AS (SELECT *, idx // 8 AS bucket FROM i)
SELECT user_id, bucket, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) AS end_us, bool_or(event_type = 'error') AS has_error,
 arg_min(event_id, struct_pack(a := -value, b := idx)) AS best_event, round(max(value), 4) AS best_value FROM b GROUP BY user_id, bucket
""")
def downsample_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20: buckets of eight rows that keep their best row, their span and any flag."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").where("value is not null").withColumn("idx", F.row_number().over(order) - 1).withColumn("bucket", F.floor(F.col("idx") / 8))
    best = F.min(F.struct((-F.col("value")).alias("v"), "idx", "event_id"))
    out = rows.groupBy("user_id", "bucket").agg(F.min(micros("ts")).alias("start_us"), F.max(micros("ts")).alias("end_us"), F.bool_or(F.col("event_type") == "error").alias("has_error"), best.alias("b"))
    return out.select("user_id", "bucket", "start_us", "end_us", "has_error", F.col("b.event_id").alias("best_event"), F.round(-F.col("b.v"), 4).alias("best_value"))


@_register.query("""
SELECT CAST(ts AS DATE)::VARCHAR AS day, CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS part, count(*) AS n, min(event_id) AS first_seen
FROM events GROUP BY ALL
""")
def daypart_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22: groups by date and part of the day, with the place of their first row."""
    h = F.hour("ts")
    part = F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day"), part.alias("part")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_seen"))


_LINE = "SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx FROM events WHERE value IS NOT NULL"


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events with a value, numbered from 1."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").where("value is not null").select("user_id", "event_id", "event_type", "value", F.row_number().over(order).cast("long").alias("idx"))


@_register.query(f"""
WITH RECURSIVE l AS ({_LINE}), m AS (
 SELECT user_id, idx, avg(value) OVER w AS mean, count(*) OVER w AS n, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS cut
 FROM l WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
), c AS (SELECT user_id, idx, mean, row_number() OVER (PARTITION BY user_id ORDER BY mean DESC, idx) AS r FROM m WHERE n = 5 AND coalesce(cut, 0) = 0),
f AS (SELECT user_id, list(idx ORDER BY r) AS ids, list(mean ORDER BY r) AS means, max(r) AS n FROM c GROUP BY user_id),
g AS (SELECT user_id, ids, means, n, 1 AS pos, CAST([] AS BIGINT[]) AS picked, CAST([] AS DOUBLE[]) AS kept FROM f UNION ALL
 SELECT user_id, ids, means, n, pos + 1, CASE WHEN len(picked) < 3 AND len(list_filter(picked, lambda p: abs(p - ids[pos]) < 5)) = 0 THEN list_append(picked, ids[pos]) ELSE picked END,
  CASE WHEN len(picked) < 3 AND len(list_filter(picked, lambda p: abs(p - ids[pos]) < 5)) = 0 THEN list_append(kept, means[pos]) ELSE kept END FROM g WHERE pos <= n)
SELECT user_id, CAST(unnest(range(1, len(picked) + 1)) AS BIGINT) AS rank, unnest(picked) AS idx, round(unnest(kept), 4) AS mean FROM g WHERE pos = n + 1
""")
def sliding_mean_top3_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-07, SRT-12, DOM-05: best stretches of five rows without a cut inside, three at most, none over another."""
    rows = line(spark, sf_dir).withColumn("cut", F.col("event_type") == "error")
    means = windows.sliding_mean(rows, ["user_id"], "idx", "value", 5, cut="cut")
    top = windows.suppressed_top(means, ["user_id"], "idx", "mean", 5)
    return top.select("user_id", F.col("rank").cast("long").alias("rank"), "idx", F.round("mean", 4).alias("mean"))


@_register.query(f"""
WITH l AS ({_LINE}), m AS (SELECT user_id, idx, avg(value) OVER w AS mean, count(*) OVER w AS n FROM l WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT user_id, idx, round(mean, 4) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mean, idx) AS r FROM m WHERE n = 4) WHERE r = 1
""")
def best_contiguous_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-08, DOM-27: the steadiest four rows in a row."""
    return windows.best_window(line(spark, sf_dir), ["user_id"], "idx", "value", 4).withColumn("mean", F.round("mean", 4))


@_register.query(f"""
WITH l AS ({_LINE}), i AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY idx) AS island FROM l),
k AS (SELECT *, count(*) OVER (PARTITION BY user_id, island) AS n FROM i WHERE event_type <> 'error')
SELECT event_id, round(avg(value) OVER (PARTITION BY user_id, island ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS smooth FROM k WHERE n >= 3
""")
def moving_avg_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-09, WIN-10: a moving mean inside runs between errors, runs of under three rows left out."""
    runs = windows.smoothed_runs(line(spark, sf_dir), ["user_id"], "idx", "value", F.col("event_type") != "error")
    return runs.select("event_id", F.round("smooth", 4).alias("smooth"))


@_register.query(f"""
WITH e AS ({EVENTS}), d AS (SELECT user_id, s, s - lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM e), m AS (SELECT user_id, d, avg(d) OVER (PARTITION BY user_id) AS m FROM d WHERE d IS NOT NULL)
SELECT user_id, round(avg(CASE WHEN abs(d - m) > 0.5 * m THEN 1.0 ELSE 0.0 END), 6) AS irregular, count(*) AS steps FROM m GROUP BY user_id
""")
def irregular_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-13, SRC-06: share of steps far from the mean step."""
    return windows.irregular_share(table(spark, sf_dir, "events"), ["user_id"], seconds("ts"), ["ts", "event_id"], 0.5).withColumn("irregular", F.round("irregular", 6))


@_register.query(f"""
WITH e AS ({EVENTS}), c AS (SELECT user_id, s, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM e)
SELECT user_id, n, s AS last FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, s) AS r FROM c) WHERE r = 1
""")
def dense_offset_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-14: the day-long stretch with the most rows, the earliest of equals."""
    rows = table(spark, sf_dir, "events").select("user_id", seconds("ts").alias("s"))
    return windows.densest(rows, ["user_id"], "s", 86_400)


@_register.query(f"""
WITH l AS ({_LINE}), n AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS f, avg(value) OVER v AS m, stddev_pop(value) OVER v AS sd, max(value) OVER (PARTITION BY user_id) AS top FROM l
 WINDOW w AS (PARTITION BY user_id ORDER BY idx), v AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT user_id, idx, round(value, 4) AS value FROM n WHERE value > coalesce(p, -1e308) AND value >= coalesce(f, -1e308) AND value >= m + sd AND value >= 0.05 * top
""")
def adaptive_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-15: local maxima above mean plus deviation of their surroundings."""
    return windows.peaks(line(spark, sf_dir), ["user_id"], "idx", "value", 3, 0.05).select("user_id", "idx", F.round("value", 4).alias("value"))


@_register.query("""
SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS starts,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem
""")
def cumulative_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-20, WIN-22: where each part starts on its time line, its place and the number of parts."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    before = F.sum("l_quantity").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.coalesce(before, F.lit(0.0)).alias("starts"), (F.row_number().over(order).cast("long") - 1).alias("place"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("n")
    )


@_register.query("""
WITH c AS (SELECT p_partkey, p_size, coalesce(sum(p_size) OVER (ORDER BY p_retailprice, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(p_size) OVER () AS total FROM part)
SELECT p_partkey, CAST(before AS BIGINT) AS before FROM c WHERE total - before > 20000
""")
def lru_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-24: what must go, oldest first, until the rest fits; a running sum that never sits in one task."""
    return windows.evicted(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size"), [F.col("p_retailprice"), F.col("p_partkey")], "p_size", 20_000).select("p_partkey", "before")


@_register.query("""
WITH c AS (SELECT p_partkey, p_size, coalesce(sum(p_size) OVER (ORDER BY p_partkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM part)
SELECT p_partkey, CAST(before AS BIGINT) AS before FROM c WHERE before + p_size <= 5000 OR before = 0
""")
def retention_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-25, SNK-13: the newest that fit, one at least."""
    return windows.retained(table(spark, sf_dir, "part").select("p_partkey", "p_size"), [F.col("p_partkey").desc()], "p_size", 5000).select("p_partkey", "before")


@_register.query(f"""
WITH e AS ({EVENTS}), d AS (SELECT user_id, min(s) AS t0, max(s) - min(s) AS length FROM e GROUP BY user_id), c AS (
 SELECT DISTINCT e.user_id, e.s - d.t0 AS start, length FROM e JOIN d ON d.user_id = e.user_id WHERE event_type = 'error' AND e.s > d.t0 AND e.s - d.t0 < length UNION SELECT user_id, 0, length FROM d WHERE length > 0)
SELECT user_id, start, coalesce(lead(start) OVER w, length) AS "end", row_number() OVER w - 1 AS scene_index FROM c WINDOW w AS (PARTITION BY user_id ORDER BY start)
""")
def scene_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-45, SRC-09: segments between cuts, from 0 to the end."""
    events = table(spark, sf_dir, "events").withColumn("s", seconds("ts"))
    whole = events.groupBy("user_id").agg(F.min("s").alias("t0"), (F.max("s") - F.min("s")).alias("length"))
    cuts = events.where("event_type = 'error'").join(whole, "user_id").select("user_id", (F.col("s") - F.col("t0")).alias("cut"))
    out = intervals.segments_from_cuts(cuts, whole.select("user_id", "length"), ["user_id"], "cut", "length")
    return out.withColumn("scene_index", F.col("scene_index").cast("long"))


@_register.query(f"""
WITH e AS ({EVENTS}), d AS (SELECT user_id, max(s) - min(s) AS length FROM e GROUP BY user_id)
SELECT user_id, unnest(list_distinct(list_concat(range(0, length + 1, 864000), [length]))) AS mark FROM d
""")
def time_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-18: a grid over each length and its end."""
    events = table(spark, sf_dir, "events").withColumn("s", seconds("ts"))
    lengths = events.groupBy("user_id").agg((F.max("s") - F.min("s")).alias("length"))
    return intervals.grid(lengths, "length", 864_000).select("user_id", "mark")


@_register.query(f"""
WITH e AS ({EVENTS}), f AS (SELECT user_id, event_type, s // 604800 AS frame FROM e GROUP BY ALL)
SELECT a.user_id, a.frame, a.event_type FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.user_id = a.user_id AND b.frame = a.frame - 1 AND b.event_type = a.event_type)
""")
def drop_repeated_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-27: what the frame just before did not show; a run keeps its first frame."""
    frames = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor(seconds("ts") / 604_800).alias("frame")).distinct()
    before = frames.select("user_id", "event_type", (F.col("frame") + 1).alias("frame"))
    return frames.join(before, ["user_id", "event_type", "frame"], "left_anti").select("user_id", "frame", "event_type")
