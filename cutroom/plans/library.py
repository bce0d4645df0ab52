"""Catalogue queries around the operators: wide rows, filters, badges, sampling, chapters, tags, settings, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cutroom.functions import scalars
from cutroom.operators import evaluate, intervals, latest, selection, windows
from cutroom.plans.registry import Register
from cutroom.plans.timelines import line, seconds
from cutroom.session import table

_register = Register()
QUERIES, ORACLE_SQL = _register.queries, _register.sql
_LINE = "SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx FROM events WHERE value IS NOT NULL"


@_register.query("""
SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, epoch_us(o_orderdate) AS ordered_us, c_name, c_mktsegment, n_name, r_name, coalesce(n_lines, 0) AS n_lines, last_line
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, max(l_linenumber) AS last_line FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
""")
def wide_catalogue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01, JON-02, JON-03: one wide row a thing, enriched from pre-aggregated and small tables."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.max("l_linenumber").alias("last_line"))
    wide = (
        t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"), "left").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"), "left").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    )
    return wide.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ordered_us"), "c_name", "c_mktsegment", "n_name", "r_name", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "last_line")


@_register.query("""
SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 40 THEN 'overexposed' END, CASE WHEN p_size % 7 = 0 THEN 'underexposed' END, CASE WHEN p_retailprice > 1500 THEN 'out_of_focus' END, CASE WHEN p_size % 5 = 0 THEN 'clipped' END], lambda x: x IS NOT NULL), ',') AS badges,
 CASE WHEN p_size % 2 = 0 THEN 'portrait' ELSE 'landscape' END AS shape FROM part
""")
def quality_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10, FLT-11, FLT-12: badges by threshold, and the shape after rotation."""
    size = F.col("p_size")
    badges = selection.quality_badges(F.when(size > 40, 1.0).otherwise(0.0), (size % 7 == 0).cast("double"), F.when(F.col("p_retailprice") > 1500, 0.5), size % 5 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(badges, ",").alias("badges"), scalars.orientation(F.lit(1920), F.lit(1080), (size % 2) * 90 + 90).alias("shape"))


@_register.query("""
WITH s AS (SELECT event_id, value - 40 AS rms, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 20 END AS crest FROM events)
SELECT event_id, coalesce(rms >= -30 AND crest >= 10, FALSE) AS speech FROM s
""")
def speech_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-15, FLT-16: a test that fails closed where a signal is missing."""
    rms, crest = F.col("value") - 40, F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 20)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce((rms >= -30) & (crest >= 10), F.lit(False)).alias("speech"))


@_register.query("""
WITH wanted AS (SELECT DISTINCT o_custkey * 3 AS k FROM orders WHERE o_orderstatus = 'P')
SELECT c_custkey AS k, 'found' AS state FROM customer WHERE c_custkey IN (SELECT k FROM wanted) UNION ALL SELECT k, 'unmatched' FROM wanted WHERE k NOT IN (SELECT c_custkey FROM customer)
""")
def narrowed_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-18: a narrowed selection, and the asked-for ids that nothing matches."""
    wanted = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select((F.col("o_custkey") * 3).alias("k")).distinct()
    have = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return have.join(wanted, "k", "left_semi").withColumn("state", F.lit("found")).unionByName(wanted.join(have, "k", "left_anti").withColumn("state", F.lit("unmatched")))


@_register.query("""
WITH e AS (SELECT *, epoch_us(ts) // 1000000 AS s FROM events), seg AS (SELECT event_id AS seg, user_id, s AS a, s + 7200 AS b FROM e WHERE event_type = 'view'), cue AS (SELECT event_id AS cue, user_id, s AS c, s + 2400 AS d FROM e WHERE event_type = 'click'),
x AS (SELECT seg, cue, greatest(a, c) - a AS f, least(b, d) - a AS t FROM seg JOIN cue ON seg.user_id = cue.user_id AND c < b AND d > a),
p AS (SELECT *, greatest(f, coalesce(max(t) OVER (PARTITION BY seg ORDER BY f, cue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS g FROM x)
SELECT seg, cue, g AS starts, t AS ends FROM p WHERE g < t
""")
def clipped_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-16: cues cut to their segment, shifted to its start, and trimmed to where the ones before end."""
    e = table(spark, sf_dir, "events").withColumn("s", seconds("ts"))
    seg = e.where("event_type = 'view'").select(F.col("event_id").alias("seg"), "user_id", F.col("s").alias("a"), (F.col("s") + 7200).alias("b"))
    cue = e.where("event_type = 'click'").select(F.col("event_id").alias("cue"), "user_id", F.col("s").alias("c"), (F.col("s") + 2400).alias("d"))
    hits = intervals.overlapping(seg, cue, ["user_id"], 3600, ("a", "b"), ("c", "d"))
    cut = hits.select("seg", "cue", (F.greatest("a", "c") - F.col("a")).alias("f"), (F.least("b", "d") - F.col("a")).alias("t"))
    before = F.max("t").over(Window.partitionBy("seg").orderBy("f", "cue").rowsBetween(Window.unboundedPreceding, -1))
    return cut.withColumn("starts", F.greatest("f", F.coalesce(before, F.lit(0)))).where("starts < t").select("seg", "cue", "starts", F.col("t").alias("ends"))


@_register.query("""
SELECT a.p_partkey, b.p_partkey AS sibling FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey WHERE a.p_partkey % 5 = 0 AND b.p_partkey % 5 <> 0
""")
def sibling_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-19: members of a selected one's group that are not selected; groups are small stacks."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    chosen = part.where("p_partkey % 5 = 0")
    rest = part.join(chosen.select("p_partkey"), "p_partkey", "left_anti").withColumnRenamed("p_partkey", "sibling")
    return chosen.join(rest, ["p_brand", "p_type", "p_size"]).select("p_partkey", "sibling")


@_register.query("SELECT o_custkey, max(epoch_us(o_orderdate)) AS last_us, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY max(o_orderdate) DESC, o_custkey LIMIT 12")
def recent_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06, DOM-60: the groups that were last at work; the limit is the feature."""
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("last_us"), F.count("*").alias("n"))
    return grouped.orderBy(F.desc("last_us"), "o_custkey").limit(12)


@_register.query("""
SELECT event_type, round(coalesce(avg(CASE WHEN event_id % 9 <> 0 THEN value END), 0.0), 4) AS mean, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS high_share FROM events GROUP BY event_type
""")
def finite_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12, AGG-13: a mean without what isn't finite, 0 for none, and shares of rows that meet a test."""
    v = F.when(F.col("event_id") % 9 != 0, F.col("value")).otherwise(F.lit(float("nan")))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(F.coalesce(F.avg(F.when(~F.isnan(v), v)), F.lit(0.0)), 4).alias("mean"), F.round(F.avg(F.coalesce((F.col("value") > 50).cast("double"), F.lit(0.0))), 6).alias("high_share")
    )


@_register.query(f"""
WITH l AS ({_LINE}), n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM l)
SELECT user_id, (idx - 1) * 10 // n AS bucket, round(min(value), 4) AS low, round(max(value), 4) AS high FROM n GROUP BY ALL
""")
def waveform_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19: least and greatest value of ten equal parts of each line."""
    rows = line(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    return rows.groupBy("user_id", F.floor((F.col("idx") - 1) * 10 / F.col("n")).alias("bucket")).agg(F.round(F.min("value"), 4).alias("low"), F.round(F.max("value"), 4).alias("high"))


@_register.query("""
SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers,
 (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = n_nationkey) AS orders,
 (SELECT c_mktsegment FROM customer WHERE c_nationkey = n_nationkey GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1) AS usual FROM nation
""")
def episode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-24: correlated counts as joins of pre-aggregates."""
    t = lambda n: table(spark, sf_dir, n)
    count = lambda df, key, name: df.groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias(name))
    out = t("nation").select("n_nationkey").join(count(t("customer"), "c_nationkey", "customers"), "n_nationkey", "left").join(count(t("supplier"), "s_nationkey", "suppliers"), "n_nationkey", "left")
    out = out.join(count(t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")), "c_nationkey", "orders"), "n_nationkey", "left")
    usual = latest.mode_per_parent(t("customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment"), "n_nationkey", "c_mktsegment").select("n_nationkey", F.col("c_mktsegment").alias("usual"))
    return out.join(usual, "n_nationkey", "left").na.fill(0, ["customers", "suppliers", "orders"])


@_register.query("SELECT conv_id, sha256(string_agg(turn || ':' || role || ':' || coalesce(text, ''), '|' ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id")
def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-27: a digest of each group's rows in order."""
    rows = table(spark, sf_dir, "conversations").withColumn("part", F.concat_ws(":", F.col("turn").cast("string"), "role", F.coalesce("text", F.lit(""))))
    joined = latest.ordered_text("part", ["turn", "role", "text"], "|")
    return rows.groupBy("conv_id").agg(F.sha2(joined.cast("binary"), 256).alias("digest"))


@_register.query("""
SELECT o_orderpriority AS kind, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, greatest(count(*) - count(*) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderstatus = 'P'), 0) AS waiting,
 CAST(floor(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*)) AS BIGINT) AS percent FROM orders GROUP BY 1
""")
def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-29, DOM-59: progress by kind, what is left over as waiting."""
    done, failed = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") == "P")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(
        F.count("*").alias("total"), done.alias("done"), F.greatest(F.count("*") - done - failed, F.lit(0)).alias("waiting"), F.floor(100 * done / F.count("*")).alias("percent")
    )


@_register.query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1")
def stage_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-32: middle and 95th percentile of each stage, by ranks over ranges; a stage may hold a third of all rows."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber")
    found = windows.interpolated_percentiles(lines, ["l_returnflag"], "l_extendedprice", [F.col("l_orderkey"), F.col("l_linenumber")], {"p50": 0.5, "p95": 0.95})
    return found.select("l_returnflag", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


@_register.query("""
WITH e AS (SELECT user_id, event_id, event_type, ts, CASE WHEN event_type = 'signup' THEN NULL ELSE epoch_us(ts) // 1000000 END AS s FROM events), l AS (SELECT *, lag(s) OVER w AS ps, lag(event_id) OVER w AS pid FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, CASE WHEN pid IS NULL THEN 0 WHEN (s IS NULL) <> (ps IS NULL) THEN 1 WHEN s - ps > 1800 THEN 1 ELSE 0 END AS b FROM l)
SELECT event_id, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS event FROM f
""")
def photo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05: events split at half an hour, and between dated and undated rows."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("s", F.when(F.col("event_type") != "signup", seconds("ts")))
    before = F.lag("s").over(order)
    split = F.when(F.lag("event_id").over(order).isNull(), 0).when(F.col("s").isNull() != before.isNull(), 1).when(F.col("s") - before > 1800, 1).otherwise(0)
    return rows.withColumn("b", split).select("event_id", F.sum("b").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("event"))


@_register.query("""
WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, event_id, ts FROM events), d AS (SELECT *, s - lag(s) OVER w AS d, lag(s) OVER w - lag(s, 2) OVER w AS pd, row_number() OVER w AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back,
 row_number() OVER (PARTITION BY user_id, s // 864000 ORDER BY ts, event_id) AS first FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id FROM d WHERE r <= 32 OR back = 1 OR first = 1 OR abs(d - pd) > 0.1 * pd
""")
def cadence_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-12: the first 32 points, the last, the first of each stretch, and wherever the step changes."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("s", seconds("ts"))
    step, before = F.col("s") - F.lag("s").over(order), F.lag("s").over(order) - F.lag("s", 2).over(order)
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    first = F.row_number().over(Window.partitionBy("user_id", F.floor(F.col("s") / 864_000)).orderBy("ts", "event_id"))
    keep = (F.row_number().over(order) <= 32) | (last == 1) | (first == 1) | F.coalesce(F.abs(step - before) > 0.1 * before, F.lit(False))
    return rows.withColumn("_k", keep).where("_k").select("user_id", "event_id")


@_register.query(f"""
WITH l AS ({_LINE}), n AS (SELECT *, abs(avg(value) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) - avg(value) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) AS nov FROM l)
SELECT user_id, idx, round(nov, 6) AS novelty FROM (SELECT *, lag(nov) OVER w AS p, lead(nov) OVER w AS f FROM n WINDOW w AS (PARTITION BY user_id ORDER BY idx)) WHERE nov > coalesce(p, -1) AND nov >= coalesce(f, -1)
""")
def section_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-16: where the mean before and after differ most."""
    order = Window.partitionBy("user_id").orderBy("idx")
    rows = line(spark, sf_dir).withColumn("nov", F.abs(F.avg("value").over(order.rowsBetween(-8, -1)) - F.avg("value").over(order.rowsBetween(0, 7))))
    peak = (F.col("nov") > F.coalesce(F.lag("nov").over(order), F.lit(-1.0))) & (F.col("nov") >= F.coalesce(F.lead("nov").over(order), F.lit(-1.0)))
    return rows.withColumn("_k", peak).where("_k").select("user_id", "idx", F.round("nov", 6).alias("novelty"))


@_register.query("""
WITH RECURSIVE s AS (SELECT user_id, list(DISTINCT epoch_us(ts) // 1000000 ORDER BY epoch_us(ts) // 1000000) AS ticks FROM events GROUP BY user_id), g AS (
 SELECT user_id, ticks, 1 AS pos, CAST([] AS BIGINT[]) AS kept FROM s UNION ALL
 SELECT user_id, ticks, pos + 1, CASE WHEN len(kept) = 0 OR ticks[pos] - kept[-1] >= 100000 THEN list_append(kept, ticks[pos]) ELSE kept END FROM g WHERE pos <= len(ticks))
SELECT user_id, unnest(kept) AS tick FROM g WHERE pos = len(ticks) + 1
""")
def thinned_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-18: ticks at least so far from the last one kept."""
    ticks = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(seconds("ts"))).alias("ticks"))
    return ticks.select("user_id", F.explode(windows.thinned(F.col("ticks"), F.lit(100_000))).alias("tick"))


@_register.query(f"""
WITH l AS ({_LINE}), f AS (SELECT user_id, max_by(idx, struct_pack(v := value, i := idx)) AS phase FROM l WHERE idx <= 4 GROUP BY user_id)
SELECT l.user_id, l.event_id FROM l JOIN f ON f.user_id = l.user_id WHERE idx >= phase AND (idx - phase) % 4 = 0
""")
def downbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-19: every fourth row from the strongest of the first four, of equals the last."""
    rows = line(spark, sf_dir)
    phase = rows.where("idx <= 4").groupBy("user_id").agg(F.max(F.struct("value", "idx")).alias("b")).select("user_id", F.col("b.idx").alias("phase"))
    return rows.join(phase, "user_id").where("idx >= phase and (idx - phase) % 4 = 0").select("user_id", "event_id")


@_register.query(f"""
WITH l AS ({_LINE}), c AS (SELECT *, min(idx) OVER (PARTITION BY user_id, event_type) AS first FROM l)
SELECT event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY first) AS ordinal, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY idx) THEN printf('%02d · %s', dense_rank() OVER (PARTITION BY user_id ORDER BY first), event_type) END AS heading FROM c
""")
def chapter_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-21: chapters by first appearance, named only where they change."""
    rows = line(spark, sf_dir).withColumn("first", F.min("idx").over(Window.partitionBy("user_id", "event_type")))
    ordinal = F.dense_rank().over(Window.partitionBy("user_id").orderBy("first"))
    rows = rows.withColumn("ordinal", ordinal).withColumn("before", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("idx")))
    heading = F.when(~F.col("event_type").eqNullSafe(F.col("before")), F.format_string("%02d · %s", "ordinal", "event_type"))
    return rows.select("event_id", F.col("ordinal").cast("long").alias("ordinal"), heading.alias("heading"))


@_register.query("""
WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, event_id FROM events), d AS (SELECT user_id, s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS d, s FROM e)
SELECT user_id, max(d) AS longest_gap, max(s) - min(s) AS span, max(d) > 172800 AS sparse FROM d GROUP BY user_id
""")
def longest_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-26: the longest gap between rows, and whether it is too long."""
    order = Window.partitionBy("user_id").orderBy("s", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", seconds("ts").alias("s")).withColumn("d", F.col("s") - F.lag("s").over(order))
    return rows.groupBy("user_id").agg(F.max("d").alias("longest_gap"), (F.max("s") - F.min("s")).alias("span"), (F.max("d") > 172_800).alias("sparse"))


@_register.query("""
SELECT user_id, event_type, round(best, 4) AS best, event_id FROM (SELECT user_id, event_type, max(value) AS best, arg_min(event_id, struct_pack(a := -value, b := event_id)) AS event_id FROM events WHERE value IS NOT NULL GROUP BY ALL)
""")
def best_moment_per_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-13, SRT-14: the best row of each group, of equals the first."""
    best = latest.first_per_key(table(spark, sf_dir, "events").where("value is not null"), ["user_id", "event_type"], [-F.col("value"), F.col("event_id")], ["value", "event_id"])
    return best.select("user_id", "event_type", F.round("value", 4).alias("best"), "event_id")


@_register.query("""
SELECT DISTINCT doc_id, lower(trim(regexp_replace(lang || '   ' || source, '\\s+', ' ', 'g'))) AS tag FROM documents WHERE length(trim(source)) BETWEEN 1 AND 30
""")
def normalised_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRD-02, SRT-06: tags with single spaces and one case, checked for length, once each."""
    tag = F.lower(F.trim(F.regexp_replace(F.concat("lang", F.lit("   "), "source"), r"\s+", " ")))
    return table(spark, sf_dir, "documents").where(F.length(F.trim("source")).between(1, 30)).select("doc_id", tag.alias("tag")).distinct()


@_register.query("""
SELECT l_orderkey, arg_min(l_linenumber, struct_pack(a := CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, b := CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_linenumber END, c := l_linenumber)) AS representative FROM lineitem GROUP BY l_orderkey
""")
def representative_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRD-03: the segment that a rating of the whole goes to: the first scene, unknown scenes last."""
    unknown = F.col("l_returnflag") == "R"
    picked = latest.first_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.when(unknown, 1).otherwise(0), F.when(unknown, 0).otherwise(F.col("l_linenumber")), F.col("l_linenumber")], ["l_linenumber"])
    return picked.select("l_orderkey", F.col("l_linenumber").alias("representative"))


@_register.query("""
WITH m AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 10 = 3 THEN o_custkey - 1 ELSE o_custkey END AS chapter, o_orderdate FROM orders)
SELECT chapter, count(*) AS items, epoch_us(min(o_orderdate)) AS starts, epoch_us(max(o_orderdate)) AS ends, count(DISTINCT o_custkey) AS merged FROM m GROUP BY chapter
""")
def merged_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRD-04: chapters merged into their neighbour: members re-keyed, ranges joined."""
    chapter = F.when(F.col("o_custkey") % 10 == 3, F.col("o_custkey") - 1).otherwise(F.col("o_custkey"))
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").groupBy(chapter.alias("chapter")).agg(F.count("*").alias("items"), F.min(at).alias("starts"), F.max(at).alias("ends"), F.count_distinct("o_custkey").alias("merged"))


@_register.query("""
WITH d AS (SELECT * FROM (VALUES ('threshold', 0.25::DOUBLE), ('weight', 0.5::DOUBLE), ('limit', 20::DOUBLE)) t(k, v)), s AS (SELECT n_nationkey AS scope, CASE n_nationkey % 3 WHEN 0 THEN 'threshold' WHEN 1 THEN 'weight' ELSE 'odd' END AS k, n_regionkey / 10.0::DOUBLE AS v FROM nation)
SELECT n_nationkey AS scope, d.k AS name, coalesce(s.v, d.v) AS value FROM nation, d LEFT JOIN s ON s.scope = n_nationkey AND s.k = d.k
""")
def settings_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRD-16, CRD-17: defaults under what each scope has set; unknown names are left out."""
    defaults = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("default")) for k, v in (("threshold", 0.25), ("weight", 0.5), ("limit", 20.0))])
    nation = table(spark, sf_dir, "nation")
    own = nation.select(F.col("n_nationkey").alias("scope"), F.when(F.col("n_nationkey") % 3 == 0, "threshold").when(F.col("n_nationkey") % 3 == 1, "weight").otherwise("odd").alias("name"), (F.col("n_regionkey") / 10).alias("own"))
    every = nation.select(F.col("n_nationkey").alias("scope"), F.explode(defaults).alias("d")).select("scope", "d.*")
    return every.join(own, ["scope", "name"], "left").select("scope", "name", F.coalesce("own", "default").alias("value"))


@_register.query("""
WITH t AS (SELECT d.doc_id, l.toxic AS truth, CASE WHEN n_chars % 3 = 0 THEN 1 ELSE 0 END AS found, CASE WHEN quality = 1 THEN 'a|b' WHEN toxic = 1 THEN '*' ELSE 'c' END AS expected, CASE WHEN n_chars % 2 = 0 THEN 'a' ELSE 'c' END AS actual FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
SELECT count(*) AS n, round(CASE WHEN count(*) FILTER (truth = 1) > 0 THEN count(*) FILTER (truth = 1 AND found = 1) / count(*) FILTER (truth = 1) ELSE 1.0 END, 6) AS recall,
 round(count(*) FILTER (truth = 0 AND found = 1) / count(*) FILTER (truth = 0), 6) AS false_rate, count(*) FILTER (expected <> '*') AS judged, count(*) FILTER (expected <> '*' AND list_contains(string_split(expected, '|'), actual)) AS matched FROM t
""")
def label_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-04, EVL-10: recall and false alarms over labelled rows, and labels of which any may match."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = F.col("n_chars") % 3 == 0
    expected = F.when(F.col("quality") == 1, "a|b").when(F.col("toxic") == 1, "*").otherwise("c")
    match = evaluate.any_label(expected, F.when(F.col("n_chars") % 2 == 0, "a").otherwise("c"))
    of = lambda t: F.count_if(F.col("toxic") == t)
    hit = lambda t: F.count_if((F.col("toxic") == t) & found)
    return docs.join(labels, "doc_id").agg(
        F.count("*").alias("n"), F.round(evaluate.ratio(hit(1), of(1), 1.0), 6).alias("recall"), F.round(evaluate.ratio(hit(0), of(0), 0.0), 6).alias("false_rate"),
        F.count(match).alias("judged"), F.count_if(match).alias("matched"),
    )


@_register.query("""
WITH b AS (SELECT event_type AS metric, avg(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), a AS (SELECT event_type AS metric, avg(value) AS v FROM events WHERE event_id % 2 = 1 AND event_type <> 'signup' GROUP BY 1)
SELECT b.metric, round(b.v, 4) AS old, round(a.v, 4) AS new, CASE WHEN a.v IS NULL THEN 'missing' WHEN b.v - a.v > 0.2 THEN 'worse' WHEN b.v - a.v < -0.2 THEN 'better' ELSE 'same' END AS verdict FROM b LEFT JOIN a ON a.metric = b.metric
""")
def run_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-07: what got worse between two runs, by more than an epsilon."""
    events = table(spark, sf_dir, "events")
    side = lambda df: df.groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    before = side(events.where("event_id % 2 = 0")).withColumn("higher_is_better", F.lit(True))
    out = evaluate.regressions(before, side(events.where("event_id % 2 = 1 and event_type <> 'signup'")), 0.2)
    return out.select("metric", F.round("old", 4).alias("old"), F.round("new", 4).alias("new"), "verdict")
