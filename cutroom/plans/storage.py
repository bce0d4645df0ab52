"""Drafts, contracts and replaced keys through queries, over analogues: orders are drafts and their lines segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cutroom.operators import merge
from cutroom.plans.registry import Register
from cutroom.session import table, tasks
from cutroom.sources import contracts, sinks

_register = Register()
QUERIES, ORACLE_SQL = _register.queries, _register.sql


@_register.query("""
WITH li AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL), s AS (SELECT l_orderkey AS k, l_linenumber AS place, CAST(l_quantity AS BIGINT) AS d, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - CAST(l_quantity AS BIGINT) + CASE WHEN l_partkey % 41 = 0 THEN 1 ELSE 0 END AS start, l_partkey % 37 - 1 AS src,
  CAST(l_quantity AS BIGINT) + CASE WHEN l_suppkey % 53 = 0 THEN 1 ELSE 0 END AS long, l_suppkey % 61 = 0 AS lost FROM li),
t AS (SELECT k, count(*) AS n, sum(d) AS total, max(CASE WHEN start <> before OR src < 0 OR long <> d OR lost THEN 1 ELSE 0 END) AS broken FROM (SELECT *, sum(d) OVER (PARTITION BY k ORDER BY place) - d AS before FROM s) GROUP BY k),
o AS (SELECT o_orderkey AS k, o_custkey AS c, coalesce(n, 0) AS n, coalesce(total, 0) AS total, coalesce(broken, 0) AS broken FROM orders LEFT JOIN t ON t.k = o_orderkey),
f AS (SELECT k, unnest(list_filter([CASE WHEN k % 17 = 3 THEN 'version' END, CASE WHEN k % 19 = 4 THEN 'name' END, CASE WHEN c % 7 = 3 OR c % 7 = 4 THEN 'tracks' END, CASE WHEN k % 23 = 5 THEN 'counts' END, CASE WHEN broken = 1 THEN 'timeline' END, CASE WHEN k % 29 = 6 THEN 'duration' END,
  CASE WHEN k % 31 = 7 AND n > 0 THEN 'path' END, CASE WHEN (CASE WHEN k % 13 = 2 THEN 1 ELSE 0 END) <> (CASE WHEN c % 7 IN (1, 2, 3) THEN 1 ELSE 0 END) THEN 'music count' END,
  CASE WHEN c % 7 = 3 OR c % 7 IN (1, 2) AND (k % 13 <> 2 OR k % 5 = 1 OR 40 > total) THEN 'music' END], lambda x: x IS NOT NULL)) AS fault FROM o)
SELECT k AS draft, fault FROM f
""")
def draft_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03: what an editor would refuse in drafts of tracks, segments and materials."""
    k, c, line = F.col("o_orderkey"), F.col("o_custkey"), F.col("l_linenumber")
    orders = table(spark, sf_dir, "orders")
    # rows are dealt out by their order once, for the lines of a number and for the clock that runs over them
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    dealt = rows.repartition(tasks(rows), "l_orderkey")
    items = dealt.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    length = F.col("l_quantity").cast("long")
    clock = F.sum(length).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - length
    lines = items.select(
        F.col("l_orderkey").alias("draft"), F.lit(0).alias("track"), line.alias("place"), (clock + F.when(F.col("l_partkey") % 41 == 0, 1).otherwise(0)).alias("start"), length.alias("duration"), (F.col("l_partkey") % 37 - 1).alias("source_start"),
        (length + F.when(F.col("l_suppkey") % 53 == 0, 1).otherwise(0)).alias("source_duration"), F.concat(F.when(F.col("l_suppkey") % 61 == 0, "lost").otherwise("m"), line.cast("string")).alias("material"),
    )
    total = lines.groupBy("draft").agg(F.sum("duration").alias("total"))
    drafts = orders.join(total, k == total["draft"], "left").select(
        k.alias("draft"), F.when(k % 19 != 4, "cut").alias("name"), F.when(k % 17 == 3, "9").otherwise("11").alias("version"), (F.coalesce("total", F.lit(0)) + F.when(k % 29 == 6, 1).otherwise(0)).alias("duration")
    )
    kinds = F.when(c % 7 == 0, F.array(F.lit("video"))).when(c % 7 == 1, F.array(F.lit("video"), F.lit("audio"))).when(c % 7 == 2, F.array(F.lit("video"), F.lit("text"), F.lit("audio"))).when(c % 7 == 3, F.array(F.lit("audio"), F.lit("video"))).when(
        c % 7 == 4, F.array(F.lit("video"), F.lit("video"))).otherwise(F.array(F.lit("video"), F.lit("text")))
    tracks = orders.select(k.alias("draft"), F.posexplode(kinds).alias("track", "kind"))
    music = tracks.where("kind = 'audio'").join(orders.select(k.alias("draft"), c.alias("c")), "draft").where(F.col("draft") % 13 == 2).select(
        "draft", "track", F.lit(99).alias("place"), F.when(F.col("draft") % 5 == 1, 5).otherwise(0).cast("long").alias("start"), F.lit(40).cast("long").alias("duration"), F.lit(0).cast("long").alias("source_start"), F.lit(40).cast("long").alias("source_duration"), F.lit("song").alias("material")
    )
    path = F.when(F.col("draft") % 31 == 7, "a.mov").otherwise("/a.mov")
    videos = items.select(F.col("l_orderkey").alias("draft"), line.alias("place"), F.concat(F.lit("m"), line.cast("string")).alias("material")).select("draft", "material", F.lit("video").alias("kind"), path.alias("path"), F.lit(100).cast("long").alias("duration"))
    spare = orders.where(k % 23 == 5).select(k.alias("draft"), F.lit("spare").alias("material"), F.lit("video").alias("kind"), F.lit("/b.mov").alias("path"), F.lit(1).cast("long").alias("duration"))
    songs = orders.where(k % 13 == 2).select(k.alias("draft"), F.lit("song").alias("material"), F.lit("audio").alias("kind"), F.lit("/c.mp3").alias("path"), F.lit(60).cast("long").alias("duration"))
    return sinks.draft_faults(drafts, tracks, lines.unionByName(music.where("track > 0")), videos.unionByName(spare).unionByName(songs), "11")


@_register.query("""
SELECT * FROM (SELECT 'n_chars' AS name, 'is bigint, not string' AS fault, CAST(NULL AS BIGINT) AS n UNION ALL SELECT 'title', 'missing', NULL UNION ALL SELECT 'lang', 'null', count(*) FILTER (lang IS NULL) FROM documents
 UNION ALL SELECT 'length', 'rule', count(*) FILTER (n_chars < 200) FROM documents UNION ALL SELECT 'doc_id', 'version over 150', count(*) FILTER (doc_id > 150) FROM documents
 UNION ALL SELECT 'text', 'repeated', count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)) WHERE n IS NULL OR n > 0
""")
def contract_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01, SRC-02: all that a table differs in from a contract on columns, nulls, keys, rules and versions."""
    docs = table(spark, sf_dir, "documents")
    wished = contracts.Contract({"doc_id": "bigint", "n_chars": "string", "title": "string"})
    schema = [(name, fault, None) for name, fault in contracts.schema_faults(docs, wished)]
    held = contracts.Contract({}, required=("doc_id", "lang"), unique=("text",), rules={"length": F.col("n_chars") >= 200}, version=("doc_id", 150))
    return contracts.row_faults(docs, held).unionByName(spark.createDataFrame(schema, "name string, fault string, n long"))


@_register.query("""
WITH s AS (SELECT o_orderkey AS k, CAST(1 AS INTEGER) AS line, CAST(o_custkey AS DOUBLE) AS v FROM orders WHERE o_orderstatus = 'P') SELECT * FROM s UNION ALL SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM s)
""")
def replaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-08: all rows of a key make way for its new ones."""
    old = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_quantity").cast("double").alias("v"))
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("line"), F.col("o_custkey").cast("double").alias("v"))
    return merge.replace_by_key(old, new, ["k"])


@_register.query("""
WITH t AS (SELECT o_custkey AS k, min(o_orderkey) AS first FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey), s AS (SELECT o_custkey AS k, min(o_orderkey) AS first FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey) SELECT * FROM t UNION ALL SELECT * FROM s WHERE k NOT IN (SELECT k FROM t)
""")
def inserted_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-11: of new rows the least of each key goes in where the table has none of that key."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("first"))
    return merge.insert_absent(rows.where("first % 2 = 0").groupBy("k").agg(F.min("first").alias("first")), rows.where("first % 3 = 0"), ["k"])


@_register.query("""
WITH li AS (SELECT l_orderkey AS d, l_linenumber AS n, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY n) AS place, (s % 500) * 250 AS a, (p % 40) * 125 AS len FROM li),
k AS (SELECT d, place, [CAST(place AS VARCHAR), CASE WHEN p % 3 = 0 THEN '=' WHEN p % 3 = 1 THEN ' -' ELSE '' END || 'clip' || p, 'Selected/o' || n || '.mov', c1, c2, c3, CASE WHEN p % 5 > 0 THEN (p * 10) || '×1080' ELSE '' END, CASE WHEN p % 4 > 0 THEN 'h"' || p ELSE '' END,
 CASE p % 3 WHEN 0 THEN '29.970' WHEN 1 THEN '25.000' ELSE '' END, CASE WHEN s % 2 = 0 THEN '是' ELSE '否' END, '', 'A, ' || s % 4, '', CAST(s % 6 AS VARCHAR), '', '', 'web', '1920x1080', CASE WHEN s % 3 = 0 THEN CAST(s % 4 AS VARCHAR) WHEN s % 3 = 1 THEN '0' ELSE '' END, CASE WHEN p % 7 = 0 THEN '@note' WHEN p % 2 = 0 THEN '已导出' ELSE '等待处理' END] AS cells
 FROM (SELECT *, lpad(CAST(a // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(a // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(a // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(a % 1000 AS VARCHAR), 3, '0') AS c1, lpad(CAST((a + len) // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST((a + len) // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((a + len) // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST((a + len) % 1000 AS VARCHAR), 3, '0') AS c2,
  '00:00:' || lpad(CAST(len // 1000 AS VARCHAR), 2, '0') || '.' || lpad(CAST(len % 1000 AS VARCHAR), 3, '0') AS c3 FROM x))
SELECT d AS delivery, place, array_to_string(list_transform(list_transform(cells, lambda c: CASE WHEN regexp_matches(ltrim(c), '^[=+@-]') THEN chr(39) || c ELSE c END), lambda c: CASE WHEN contains(c, ',') OR contains(c, '"') THEN '"' || replace(c, '"', '""') || '"' ELSE c END), ',') AS line FROM k
""")
def shot_list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01: the lines of shot lists, twenty columns each, numbered in their delivery and guarded."""
    p, s, none = F.col("p"), F.col("s"), F.lit(None).cast("string")
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("delivery"), F.col("l_linenumber").alias("n")).agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    clips = items.select(
        "delivery", "n", F.concat(F.when(p % 3 == 0, "=").when(p % 3 == 1, " -").otherwise(""), F.lit("clip"), p.cast("string")).alias("file"), F.concat(F.lit("o"), F.col("n").cast("string"), F.lit(".mov")).alias("output"),
        (s % 500 * 0.25).alias("start"), (p % 40 * 0.125).alias("seconds"), F.when(p % 5 > 0, p * 10).alias("width"), F.lit(1080).alias("height"), F.when(p % 4 > 0, F.concat(F.lit('h"'), p.cast("string"))).alias("codec"),
        F.when(p % 3 == 0, 30000).when(p % 3 == 1, 25).alias("fps_num"), F.when(p % 3 == 0, 1001).when(p % 3 == 1, 1).otherwise(0).alias("fps_den"), (s % 2 == 0).alias("vfr"), none.alias("taken"), F.concat(F.lit("A, "), (s % 4).cast("string")).alias("chapter"), none.alias("beat"),
        (s % 6).alias("stars"), none.alias("badges"), none.alias("dialogue"), F.lit("web").alias("platform"), F.lit(1920).alias("canvas_width"), F.lit(1080).alias("canvas_height"), F.when(s % 3 == 0, s % 4).alias("track"), F.when(s % 3 == 1, 2).otherwise(0).alias("tracks"),
        F.when(p % 2 == 0, "done").otherwise("open").alias("status"), F.when(p % 7 == 0, "@note").alias("note"),
    )
    rows = sinks.shot_rows(clips, "delivery", [F.col("n")])
    return rows.select("delivery", F.col(sinks.SHOT_COLUMNS[0]).cast("long").alias("place"), sinks.csv_line([F.col(c) for c in sinks.SHOT_COLUMNS]).alias("line"))
