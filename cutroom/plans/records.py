"""Records through queries: segments, batches, cards, overrides, trees, ledgers, caches, reservations, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cutroom.operators import records
from cutroom.plans.registry import Register
from cutroom.plans.timelines import seconds
from cutroom.session import table

_register = Register()
QUERIES, ORACLE_SQL = _register.queries, _register.sql


@_register.query("""
WITH s AS (SELECT l_orderkey, l_linenumber, greatest(CAST(l_quantity AS BIGINT) - 20, 0) AS a, least(CAST(l_quantity AS BIGINT) + l_linenumber, 45) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, a, b FROM s WHERE b - a >= 1
""")
def created_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRD-01: segments cut to their clips, a tick at least."""
    q = F.col("l_quantity").cast("long")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (q - 20).alias("a"), (q + F.col("l_linenumber")).alias("b"), F.lit(45).cast("long").alias("n"))
    return records.clamped_segments(rows, "a", "b", "n").select("l_orderkey", "l_linenumber", "a", "b")


@_register.query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45 OR l_discount IS NULL)")
def whole_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-10: batches that go in as a whole or not at all."""
    return records.all_or_nothing(table(spark, sf_dir, "lineitem"), "l_orderkey", (F.col("l_quantity") <= 45) & F.col("l_discount").isNotNull()).select("l_orderkey", "l_linenumber")


@_register.query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY l_orderkey")
def cascaded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-14: what depends on deleted ids goes with them."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return records.cascaded(table(spark, sf_dir, "lineitem"), gone, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@_register.query("""
WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_orderkey)
SELECT o_custkey, count(*) AS clips, CAST(sum(coalesce(n, 0)) AS BIGINT) AS segments, CAST(sum(coalesce(r, 0)) AS BIGINT) AS rated, count(*) FILTER (o_orderstatus = 'F') AS selected FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY o_custkey
""")
def removal_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRD-07: what removing an import batch would take with it."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("r"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return rows.groupBy("o_custkey").agg(F.count("*").alias("clips"), total("n").alias("segments"), total("r").alias("rated"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("selected"))


@_register.query("SELECT s_nationkey AS volume, count(*) AS missing, min(s_suppkey) AS first_clip, round(sum(s_acctbal), 2) AS bytes FROM supplier WHERE s_acctbal < 5000 GROUP BY s_nationkey")
def missing_by_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRD-08: missing clips by the volume they were on."""
    return table(spark, sf_dir, "supplier").where("s_acctbal < 5000").groupBy(F.col("s_nationkey").alias("volume")).agg(F.count("*").alias("missing"), F.min("s_suppkey").alias("first_clip"), F.round(F.sum("s_acctbal"), 2).alias("bytes"))


@_register.query("""
WITH b AS (SELECT user_id AS ep, event_type AS chapter, event_id AS place, event_id % 20 AS item FROM events), s AS (SELECT DISTINCT user_id AS ep, event_id % 20 AS item FROM events WHERE user_id % 4 <> 0 OR event_id % 20 <> 6),
bad AS (SELECT ep FROM (SELECT DISTINCT ep, item FROM b) x FULL OUTER JOIN s USING (ep, item) WHERE x.item IS NULL OR s.item IS NULL), c AS (SELECT ep, chapter, list(item ORDER BY place) AS items FROM b GROUP BY ep, chapter)
SELECT ep, list(chapter || ':' || array_to_string(items, ',') ORDER BY chapter) AS chapters FROM c WHERE ep NOT IN (SELECT DISTINCT ep FROM b EXCEPT SELECT ep FROM (SELECT ep, count(DISTINCT item) AS n FROM b GROUP BY ep) u JOIN (SELECT ep, count(*) AS m FROM s GROUP BY ep) v USING (ep) WHERE n = m) GROUP BY ep
""")
def narrative_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRD-10: an episode's tree of chapters and items, where it has just the selected items."""
    e = table(spark, sf_dir, "events")
    beats = e.select(F.col("user_id").alias("ep"), F.col("event_type").alias("chapter"), F.col("event_id").alias("place"), (F.col("event_id") % 20).alias("item"))
    chosen = e.where("user_id % 4 <> 0 or event_id % 20 <> 6").select(F.col("user_id").alias("ep"), (F.col("event_id") % 20).alias("item"))
    tree = records.overview(beats, chosen, "ep", "chapter", "place", "item")
    return tree.select("ep", F.transform("chapters", lambda c: F.concat_ws(":", c["chapter"], F.array_join(F.transform(c["items"], lambda i: i.cast("string")), ","))).alias("chapters"))


@_register.query("SELECT s_suppkey, s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 AND s_nationkey % 5 > 0 AS verified FROM supplier")
def verified_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRD-11: a card is verified when all of its fields are; an edit takes a field's mark away."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    state = lambda ok: F.when(ok, "verified").otherwise("draft")
    fields = F.map_filter(F.create_map(F.lit("name"), state(k % 2 == 0), F.lit("place"), F.when(k % 3 != 0, "verified"), F.lit("fee"), state(n % 5 > 0), F.lit("hours"), F.lit("verified")), lambda _, v: v.isNotNull())
    return table(spark, sf_dir, "supplier").select("s_suppkey", records.verified(fields, ["name", "place", "fee", "hours"]).alias("verified"))


@_register.query("""
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_size % 3 > 0 THEN CASE WHEN p_partkey % 4 = 0 THEN 'by hand' ELSE p_type END END AS routine FROM part
""")
def routine_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRD-12: suggestions under the overrides made by hand."""
    k = F.col("p_partkey")
    routine = records.overridden(F.when(F.col("p_size") % 3 > 0, F.col("p_type")), F.when(k % 4 == 0, "by hand"), k % 7 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", routine.alias("routine"))


@_register.query("""
SELECT o_orderkey, c_mktsegment, n_name, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS BIGINT) AS spent FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100) GROUP BY ALL
""")
def generation_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRD-13: the latest hundred requests with what they cost, over four tables; the hundred come first, so little is joined."""
    latest = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select("o_orderkey", "o_custkey")
    joined = table(spark, sf_dir, "lineitem").join(F.broadcast(latest), F.col("l_orderkey") == F.col("o_orderkey"))  # a hundred rows
    joined = joined.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.groupBy("o_orderkey", "c_mktsegment", "n_name").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long") * (100 - F.round(F.col("l_discount") * 100).cast("long"))).alias("spent"))


@_register.query("""
WITH RECURSIVE r AS (SELECT o_custkey AS k, o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders), f AS (SELECT k, list(id ORDER BY r) AS ids, list(c ORDER BY r) AS cs, count(*) AS n FROM r GROUP BY k),
g AS (SELECT k, ids, cs, n, 1 AS pos, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS got FROM f UNION ALL SELECT k, ids, cs, n, pos + 1, CASE WHEN used + cs[pos] <= 600000 THEN used + cs[pos] ELSE used END, CASE WHEN used + cs[pos] <= 600000 THEN list_append(got, ids[pos]) ELSE got END FROM g WHERE pos <= n)
SELECT k AS o_custkey, unnest(got) AS request, used FROM g WHERE pos = n + 1
""")
def budget_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRD-14: requests granted in order as long as the budget lasts."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("request"), "o_orderdate", F.floor("o_totalprice").cast("long").alias("cost"))
    return records.reserved(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("request")], "cost", 600_000).select("o_custkey", "request", "used")


@_register.query("""
SELECT event_type, count(*) AS files, CAST(sum(event_id % 1000) AS BIGINT) AS bytes, count(*) FILTER (1704067200 + 2592000 - epoch_us(ts) // 1000000 > 1209600) AS stale_files, CAST(coalesce(sum(event_id % 1000) FILTER (1704067200 + 2592000 - epoch_us(ts) // 1000000 > 1209600), 0) AS BIGINT) AS stale_bytes FROM events GROUP BY event_type
""")
def cache_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRD-21, CRD-22: what caches hold, and how much of it is older than a fortnight."""
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 1000).alias("n"), seconds("ts").alias("s"))
    return records.stale(rows, "s", "n", ["event_type"], F.lit(1704067200 + 2592000), 1209600)


@_register.query("""
WITH p AS (SELECT o_custkey, o_orderkey AS t, o_orderkey * 3 AS truth FROM orders), m AS (SELECT o_orderkey AS t, o_orderkey * 3 + o_orderkey % 9 - 4 AS got FROM orders WHERE o_orderkey % 6 <> 0)
SELECT o_custkey, max(abs(got - truth)) AS greatest, round(avg(abs(got - truth)), 6) AS mean, count(*) FILTER (got IS NULL) AS missing FROM p LEFT JOIN m USING (t) GROUP BY o_custkey
""")
def time_map_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL-05: how far a time map is off at its checkpoints, and which it lacks."""
    k = F.col("o_orderkey")
    points = table(spark, sf_dir, "orders").select("o_custkey", k.alias("t"), (k * 3).alias("truth"))
    mapped = table(spark, sf_dir, "orders").where("o_orderkey % 6 <> 0").select("o_custkey", k.alias("t"), (k * 3 + k % 9 - 4).alias("got"))
    return records.mapping_errors(points, mapped, ["o_custkey"], "t", "truth", "got").select("o_custkey", "greatest", F.round("mean", 6).alias("mean"), "missing")


@_register.query("""
WITH e AS (SELECT l_partkey AS thing, l_orderkey AS batch, l_orderkey * 10 + l_linenumber AS seq FROM lineitem), l AS (SELECT *, max(seq) OVER (PARTITION BY thing) AS last, max(seq) OVER (PARTITION BY thing, batch) AS own FROM e) SELECT batch, min(own = last) AS undoable FROM l GROUP BY batch
""")
def undoable_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-40, DOM-35: batches of edits that nothing later has touched."""
    edits = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("thing"), F.col("l_orderkey").alias("batch"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return records.undoable(edits, "thing", "seq", "batch")


@_register.query("""
WITH h AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders), n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders),
s AS (SELECT o_custkey, sum(o_orderkey) AS seen FROM orders GROUP BY o_custkey), x AS (SELECT o_custkey, CASE WHEN o_custkey % 5 = 0 THEN seen + 1 ELSE seen END = seen AS fresh FROM s) SELECT o_orderkey, CASE WHEN fresh THEN n.place ELSE h.place END AS place FROM h JOIN n USING (o_custkey, o_orderkey) JOIN x USING (o_custkey)
""")
def rewritten_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRD-05: a whole order rewritten, unless the list changed since it was read."""
    rows = table(spark, sf_dir, "orders")
    seen = rows.groupBy("o_custkey").agg(F.sum("o_orderkey").alias("now")).withColumn("read", F.when(F.col("o_custkey") % 5 == 0, F.col("now") + 1).otherwise(F.col("now")))
    line = lambda *order: F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order)).cast("long")
    both = rows.withColumns({"held": line("o_orderdate", "o_orderkey"), "new": line(F.desc("o_totalprice"), "o_orderkey")}).join(seen, "o_custkey")
    return both.select("o_orderkey", F.when(F.col("read") == F.col("now"), F.col("new")).otherwise(F.col("held")).alias("place"))


@_register.query("""
SELECT o_custkey, '{"clips":' || count(*) || ',"selected":' || count(*) FILTER (o_orderstatus = 'F') || ',"status":"' || CASE WHEN o_custkey % 2 = 0 THEN 'archived' ELSE 'active' END || '"}' AS summary FROM orders GROUP BY o_custkey
""")
def archived_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRD-06: episodes with the JSON summary that an archive keeps."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("clips"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("selected"))
    status = F.when(F.col("o_custkey") % 2 == 0, "archived").otherwise("active")
    return rows.select("o_custkey", F.to_json(F.struct("clips", "selected", status.alias("status"))).alias("summary"))


@_register.query("""
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'square' WHEN c_nationkey % 5 = 0 THEN 'episode' WHEN c_acctbal > 5000 THEN 'preset' WHEN n > 8 THEN 'majority' ELSE 'landscape' END AS shape FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
""")
def resolved_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRD-17: an override, the episode, the preset, the majority, or landscape: the first that is known."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left")
    shape = F.coalesce(F.when(F.col("c_custkey") % 7 == 0, "square"), F.when(F.col("c_nationkey") % 5 == 0, "episode"), F.when(F.col("c_acctbal") > 5000, "preset"), F.when(F.col("n") > 8, "majority"), F.lit("landscape"))
    return rows.select("c_custkey", shape.alias("shape"))
