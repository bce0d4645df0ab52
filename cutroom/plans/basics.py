"""Small building blocks through queries of their own: null-safe matches, orders with nulls, variances, vectors, logs, prototypes and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cutroom.functions.vectors import sound
from cutroom.operators import pictures
from cutroom.operators.windows import ranked
from cutroom.plans.registry import Register
from cutroom.session import table
from cutroom.sources import media
from cutroom.streaming.tables import unchanged

_register = Register()
QUERIES, ORACLE_SQL = _register.queries, _register.sql


@_register.query("""
WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 3 END AS x FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 > 0 THEN o_custkey % 3 END AS y FROM orders)
SELECT a.o_orderkey, x, y, x IS NOT DISTINCT FROM y AS same FROM a JOIN b ON a.o_orderkey = b.o_orderkey
""")
def null_safe_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-07: equality in which null equals null."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, F.when(k % 4 > 0, k % 3).alias("x"), F.when(k % 6 > 0, F.col("o_custkey") % 3).alias("y"))
    return rows.withColumn("same", F.col("x").eqNullSafe(F.col("y")))


@_register.query("""
SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN event_id % 7 > 0 THEN value END DESC NULLS LAST, CASE WHEN event_id % 5 > 0 THEN ts END ASC NULLS LAST, event_id) AS place FROM events
""")
def nulls_last_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-01: orders of several columns in which what is unknown comes last; a key may hold any share of the rows."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", F.when(e % 7 > 0, F.col("value")).alias("v"), F.when(e % 5 > 0, F.col("ts")).alias("t"))
    return ranked(rows, ["event_type"], [F.desc_nulls_last("v"), F.asc_nulls_last("t"), e], "place").select("event_id", F.col("place").cast("long").alias("place"))


@_register.query("SELECT l_suppkey, l_linenumber // 4 AS block, count(*) AS n, round(var_pop(CAST(l_quantity AS BIGINT)), 6) AS variance FROM lineitem GROUP BY ALL")
def block_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18: variances of blocks, of the whole population."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.floor(F.col("l_linenumber") / 4).cast("int").alias("block"), F.col("l_quantity").cast("long").alias("q"))
    return rows.groupBy("l_suppkey", "block").agg(F.count("*").alias("n"), F.round(F.var_pop("q"), 6).alias("variance"))


@_register.query("""
SELECT vec_id, CASE WHEN vec_id % 11 = 4 THEN 'missing' WHEN vec_id % 10 = 3 THEN 'length' WHEN vec_id % 7 = 2 THEN 'not finite' END AS fault, CASE WHEN NOT (vec_id % 11 = 4 OR vec_id % 10 = 3 OR vec_id % 7 = 2) THEN round(list_sum(embedding::DOUBLE[]), 6) END AS total FROM embeddings
""")
def checked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14: vectors of the expected length and finite parts; what is wrong with the others."""
    i, e = F.col("vec_id"), F.col("embedding").cast("array<double>")
    broken = F.when(i % 11 == 4, None).when(i % 10 == 3, F.slice(e, 1, 63)).when(i % 7 == 2, F.concat(F.slice(e, 1, 63), F.array(F.lit(float("nan"))))).otherwise(e)
    rows = table(spark, sf_dir, "embeddings").select(i, broken.alias("v"))
    fault = F.when(F.col("v").isNull(), "missing").when(F.size("v") != 64, "length").when(~sound("v"), "not finite")
    total = F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6)
    return rows.select(i, fault.alias("fault"), F.when(fault.isNull(), total).alias("total"))


@_register.query("""
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events), b AS (SELECT user_id, event_id, i // 3 AS w, i % 3 AS p FROM e)
SELECT user_id, w AS win_index, max(CASE WHEN p = 0 THEN event_id / 4.0::DOUBLE END) AS t, CAST(arg_max(event_id % 50, event_id) FILTER (p > 0 AND event_id % 4 > 0) AS DOUBLE) AS YAVG, CAST(arg_max(-(event_id % 9), event_id) FILTER (p > 0) AS DOUBLE) AS RMS FROM b GROUP BY user_id, w
""")
def window_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07: a log's blocks as rows: a header with the window's time, then lines of signals."""
    e = F.col("event_id")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    lines = table(spark, sf_dir, "events").select("user_id", e, F.when(number % 3 == 0, F.concat(F.lit("window pts_time:"), (e / 4.0).cast("string"))).otherwise(
        F.concat(F.lit("x "), F.when(e % 4 > 0, F.concat(F.lit("YAVG="), (e % 50).cast("string"))).otherwise("y=1"), F.lit(" RMS="), (-(e % 9)).cast("string")))
    .alias("line"))
    return media.parse_window_log(lines, ["user_id"], "event_id", "line", r"^window pts_time:(\S+)", ["YAVG", "RMS"])


@_register.query("""
SELECT 'dim' || n_regionkey % 3 AS dimension, n_name AS label, 'a photo of ' || n_name AS prompt FROM nation UNION ALL SELECT 'dim' || n_regionkey % 3, n_name, n_name || ' outdoors' FROM nation WHERE n_nationkey % 2 = 0
""")
def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-16: a configuration of dimensions, labels and prompts in JSON, as rows."""
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("dim"), (F.col("n_regionkey") % 3).cast("string")).alias("d"), F.col("n_name").alias("l"), F.concat(
        F.array(F.concat(F.lit("a photo of "), "n_name")), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.concat("n_name", F.lit(" outdoors")))).otherwise(F.array().cast("array<string>"))).alias("p"))
    files = nations.groupBy("d").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("l", "p")))).alias("json"))
    read = files.select(F.col("d").alias("dimension"), F.explode(F.from_json("json", "map<string,array<string>>")).alias("label", "prompts"))
    return read.select("dimension", "label", F.explode("prompts").alias("prompt"))


@_register.query("""
WITH r AS (SELECT c_custkey AS clip, c_nationkey % 5 AS version, c_acctbal AS v FROM customer), i AS (SELECT c_custkey AS clip, CASE WHEN c_custkey % 6 = 1 THEN 9 ELSE c_nationkey % 5 END AS version FROM customer WHERE c_custkey % 8 > 0) SELECT r.* FROM r JOIN i ON i.clip = r.clip AND i.version = r.version
""")
def fresh_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-01, STR-06: results whose inputs still are what they were made of."""
    k = F.col("c_custkey")
    own = (F.col("c_nationkey") % 5).alias("version")
    customer = table(spark, sf_dir, "customer")
    inputs = customer.where(k % 8 > 0).select(k.alias("clip"), F.when(k % 6 == 1, 9).otherwise(F.col("c_nationkey") % 5).alias("version"))
    return unchanged(customer.select(k.alias("clip"), own, F.col("c_acctbal").alias("v")), inputs, ["clip"], "version")


@_register.query("""
WITH d AS (SELECT doc_id, hex(encode(text)) AS h, CAST(floor(sqrt(strlen(text))) AS BIGINT) AS side FROM documents WHERE strlen(text) > 0), x AS (SELECT doc_id, side, h, unnest(range(0, side * side)) AS i FROM d),
b AS (SELECT doc_id, side, i // side AS y, i % side AS x, CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) AS v FROM x), l AS (SELECT doc_id, side, x, y, lag(v) OVER r + lead(v) OVER r + lag(v) OVER c + lead(v) OVER c - 4 * v AS lap FROM b WINDOW r AS (PARTITION BY doc_id, y ORDER BY x), c AS (PARTITION BY doc_id, x ORDER BY y))
SELECT doc_id, side, round(coalesce(var_pop(lap) FILTER (x > 0 AND y > 0 AND x < side - 1 AND y < side - 1), 0), 4) AS sharpness FROM l GROUP BY doc_id, side
""")
def laplacian_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-42, AGG-18: variances of the Laplacian of square pictures of text bytes."""
    side = F.floor(F.sqrt(F.octet_length("text").cast("double")))
    docs = table(spark, sf_dir, "documents").where("octet_length(text) > 0").select("doc_id", side.alias("side"), F.encode("text", "UTF-8").alias("b"))
    gray = F.substring("b", F.lit(1), (F.col("side") * F.col("side")).cast("int"))
    return pictures.sharpness(docs.select("doc_id", "side", gray.alias("gray")), "gray", "side", "side").select("doc_id", "side", F.round("sharpness", 4).alias("sharpness"))
