"""Text search, excerpts, evaluation metrics and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutroom.functions import scalars
from cutroom.operators import evaluate, intervals, search
from cutroom.plans.registry import Register
from cutroom.plans.timelines import seconds
from cutroom.session import table

_register = Register()
QUERIES, ORACLE_SQL = _register.queries, _register.sql


def _hits(place: int, name: str, source: str, ident: str, text: str, needle: str) -> str:
    at = f"instr(lower({text}), '{needle}')"
    cut = f"substr({text}, greatest({at} - 1 - 18, 0) + 1, {36 + len(needle)})"
    return f"""SELECT {place} AS place, '{name}' AS source, {ident} AS id, CASE WHEN greatest({at} - 1 - 18, 0) > 0 THEN '…' || {cut} ELSE {cut} END AS excerpt
 FROM (SELECT * FROM {source} WHERE contains(lower({text}), '{needle}') ORDER BY {ident}, {text} LIMIT 20)"""


@_register.query(" UNION ALL ".join(_hits(i, n, n, k, t, "license") for i, (n, k, t) in enumerate([("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text")])))
def text_search_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-15, SRT-04: hits of several sources, twenty each, with the text around them."""
    parts = [(n, table(spark, sf_dir, n), k, t) for n, k, t in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text"))]
    return search.search_text(parts, "license")


@_register.query("""
SELECT conv_id, arg_min(text, struct_pack(a := turn, b := text)) AS text, count(*) AS hits FROM conversations WHERE contains(lower(text), 'the') GROUP BY conv_id
""")
def first_hit_per_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05, DOM-16: one stated row stands for a group of hits."""
    return search.first_hit_per_group(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "the")


@_register.query("""
WITH a AS (SELECT doc_id, 1.0::DOUBLE AS score, 'name' AS part FROM documents WHERE contains(source, '1')), b AS (SELECT doc_id, 0.5::DOUBLE, 'text' FROM documents WHERE contains(lower(text), 'license'))
SELECT doc_id, max(score) AS score, string_agg(DISTINCT part, ',' ORDER BY part) AS parts FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id
""")
def pool_search_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-03, SET-04: the union of name and text hits, with the best score."""
    docs = table(spark, sf_dir, "documents")
    named = docs.where(F.contains("source", F.lit("1"))).select("doc_id", F.lit(1.0).alias("score"))
    said = docs.where(scalars.contains_folded(F.col("text"), "license")).select("doc_id", F.lit(0.5).alias("score"))
    return search.union_hits([("name", named), ("text", said)], "doc_id", "score")


@_register.query("""
WITH d AS (SELECT d.doc_id, source AS found, CASE WHEN l.quality IS NULL THEN NULL ELSE lang || l.quality END AS truth FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
f AS (SELECT sum(n * (n - 1) // 2) AS n FROM (SELECT count(*) AS n FROM d GROUP BY found)), t AS (SELECT sum(n * (n - 1) // 2) AS n FROM (SELECT count(*) AS n FROM d WHERE truth IS NOT NULL GROUP BY truth)),
b AS (SELECT sum(n * (n - 1) // 2) AS n FROM (SELECT count(*) AS n FROM d WHERE truth IS NOT NULL GROUP BY truth, found))
SELECT CAST(f.n AS BIGINT) AS found_pairs, CAST(t.n AS BIGINT) AS true_pairs, CAST(b.n AS BIGINT) AS right_pairs, round(b.n / f.n, 6) AS precision, round(b.n / t.n, 6) AS recall FROM f, t, b
""")
def pair_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-02, EVL-03: precision and recall over pairs in one group, counted from sizes."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = docs.select(F.col("source").alias("found"), F.when(F.col("quality").isNotNull(), F.concat("lang", F.col("quality").cast("string"))).alias("truth"))
    out = evaluate.pair_counts(rows, "truth", "found")
    return out.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@_register.query("""
WITH l AS (SELECT user_id, epoch_us(ts) // 1000000 AS s FROM events), a AS (SELECT user_id, min(s) AS a0, max(s) AS a1 FROM l GROUP BY user_id), b AS (SELECT user_id, quantile_disc(s, 0.25) AS b0, quantile_disc(s, 0.75) AS b1 FROM l GROUP BY user_id)
SELECT a.user_id, round((least(a1, b1) - greatest(a0, b0)) / (greatest(a1, b1) - least(a0, b0)), 6) AS iou, (least(a1, b1) - greatest(a0, b0)) / (greatest(a1, b1) - least(a0, b0)) >= 0.5 AS good FROM a JOIN b ON a.user_id = b.user_id
""")
def interval_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-08: how far a found interval and the true one agree."""
    rows = table(spark, sf_dir, "events").select("user_id", seconds("ts").alias("s"))
    a = rows.groupBy("user_id").agg(F.min("s").alias("a0"), F.max("s").alias("a1"))
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY s)").cast("long")
    b = rows.groupBy("user_id").agg(at(0.25).alias("b0"), at(0.75).alias("b1"))
    joined = a.join(b, "user_id").withColumn("v", intervals.iou(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")))
    return joined.select("user_id", F.round("v", 6).alias("iou"), (F.col("v") >= 0.5).alias("good"))


@_register.query("""
WITH r AS (SELECT label AS q, vec_id, list_sum(list_slice(embedding, 1, 4)::DOUBLE[]) AS s FROM embeddings), k AS (SELECT q, vec_id, row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) AS rank FROM r),
f AS (SELECT q, min(rank) AS first FROM k WHERE vec_id % 7 = 0 GROUP BY q)
SELECT count(*) AS queries, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_k, round(avg(1.0 / first), 6) AS mrr FROM f
""")
def search_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-09: hits in the first five and mean reciprocal rank."""
    rows = table(spark, sf_dir, "embeddings")
    head = F.aggregate(F.slice("embedding", 1, 4).cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    results = rows.select(F.col("label").alias("q"), "vec_id", head.alias("s"))
    out = evaluate.ranking(results, results.where("vec_id % 7 = 0"), "q", "vec_id", "s", k=5)
    return out.select("queries", F.round("hit_at_k", 6).alias("hit_at_k"), F.round("mrr", 6).alias("mrr"))


@_register.query("""
WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) // 1000000 AS s FROM events), h AS (SELECT user_id, coalesce(list(s ORDER BY s) FILTER (event_type = 'error'), CAST([] AS BIGINT[])) AS truth, coalesce(list(s ORDER BY s) FILTER (event_type = 'click'), CAST([] AS BIGINT[])) AS free FROM e GROUP BY user_id),
m AS (SELECT user_id, truth, free, len(free) AS n, 1 AS pos, 0 AS tp FROM h UNION ALL
 SELECT user_id, truth, CASE WHEN best IS NULL THEN free ELSE list_concat(free[1 : list_position(free, best.f) - 1], free[list_position(free, best.f) + 1 :]) END, n, pos + 1, tp + CASE WHEN best IS NULL THEN 0 ELSE 1 END
 FROM (SELECT *, list_sort(list_transform(list_filter(free, lambda f: abs(f - truth[pos]) <= 1800), lambda f: struct_pack(d := abs(f - truth[pos]), f := f)))[1] AS best FROM m WHERE pos <= len(truth)))
SELECT user_id, tp, CAST(n - tp AS INTEGER) AS fp, CAST(len(truth) - tp AS INTEGER) AS fn FROM m WHERE pos = len(truth) + 1
""")
def boundary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-01: greedy one-to-one matches of boundaries within half an hour."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", seconds("ts").alias("s"))
    sides = rows.groupBy("user_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("event_type") == "error", F.col("s")))).alias("truth"), F.sort_array(F.collect_list(F.when(F.col("event_type") == "click", F.col("s")))).alias("found")
    )
    return evaluate.matched_boundaries(sides, ["user_id"], "truth", "found", 1800)


@_register.query("""
WITH m AS (SELECT 'mean_value' AS metric, avg(value) AS actual FROM events UNION ALL SELECT 'error_share', avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) FROM events),
p AS (SELECT * FROM (VALUES ('mean_value', '>=', 0.1::DOUBLE), ('error_share', '<=', 0.05::DOUBLE), ('unknown', '>=', 0.5::DOUBLE)) t(metric, op, threshold))
SELECT p.metric, op, threshold, round(actual, 6) AS actual, coalesce(CASE WHEN op = '>=' THEN actual >= threshold ELSE actual <= threshold END, FALSE) AS passed FROM p LEFT JOIN m ON m.metric = p.metric
""")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-06: a policy's gates; a metric that is missing fails."""
    events = table(spark, sf_dir, "events")
    mean = events.agg(F.avg("value").alias("actual")).select(F.lit("mean_value").alias("metric"), "actual")
    share = events.agg(F.avg((F.col("event_type") == "error").cast("double")).alias("actual")).select(F.lit("error_share").alias("metric"), "actual")
    policy = spark.createDataFrame([("mean_value", ">=", 0.1), ("error_share", "<=", 0.05), ("unknown", ">=", 0.5)], "metric string, op string, threshold double")
    return evaluate.gates(mean.unionByName(share), policy).select("metric", "op", "threshold", F.round("actual", 6).alias("actual"), "passed")


@_register.query("""
SELECT l_orderkey, l_linenumber, lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS clock,
 CASE WHEN l_linenumber % 3 = 0 THEN '''=' || l_returnflag ELSE l_returnflag END AS cell
FROM (SELECT *, CAST(l_extendedprice * 100 AS BIGINT) AS ms FROM lineitem)
""")
def shot_list_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01, SNK-02: clocks and guarded cells of a shot list."""
    cell = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("="), F.col("l_returnflag"))).otherwise(F.col("l_returnflag"))
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", scalars.clock(F.round(F.col("l_extendedprice") * 100), comma=True).alias("clock"), scalars.guard_formula(cell).alias("cell"))
