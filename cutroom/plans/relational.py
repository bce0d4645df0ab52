"""Relational queries: latest rows, conditional aggregates, pivots, semi and anti joins, set operations, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutroom.operators import latest, merge
from cutroom.plans.registry import Register
from cutroom.session import table

_register = Register()
QUERIES, ORACLE_SQL = _register.queries, _register.sql


@_register.query("""
SELECT user_id, event_type, event_id, round(value, 4) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events
) WHERE r = 1
""")
def latest_event_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-02: the latest event of each user and type, by time, then id."""
    found = latest.latest_per_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return found.select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))


@_register.query("""
WITH last_rating AS (
  SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC) AS r FROM lineitem WHERE l_returnflag <> 'N'
)
SELECT o.o_orderkey, o.o_orderstatus = 'F' AS derived, CASE WHEN l.l_quantity IS NULL THEN NULL WHEN l.l_quantity > 25 THEN 1 ELSE 0 END AS manual,
       CASE WHEN l.l_quantity IS NULL THEN o.o_orderstatus = 'F' ELSE l.l_quantity > 25 END AS selected
FROM orders o LEFT JOIN (SELECT * FROM last_rating WHERE r = 1) l ON l.l_orderkey = o.o_orderkey
""")
def latest_vs_derived_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05, JON-03: an explicit latest rating beats the derived choice; 0 clears it, no row leaves it."""
    rated = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select("l_orderkey", "l_linenumber", "l_quantity")
    last = latest.latest_per_key(rated, ["l_orderkey"], ["l_linenumber", "l_quantity"]).select("l_orderkey", (F.col("l_quantity") > 25).cast("int").alias("manual"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("derived"))
    return orders.join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", "derived", "manual", latest.effective(F.col("manual"), F.col("derived")).alias("selected")
    )


@_register.query("""
SELECT c_custkey, c_mktsegment FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O')
  AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')
""")
def semi_anti_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-03, JON-05: customers with an open order and without an urgent one."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    of = customers["c_custkey"] == orders["o_custkey"]
    found = customers.join(orders.where("o_orderstatus = 'O'"), of, "left_semi").join(orders.where("o_orderpriority = '1-URGENT'"), of, "left_anti")
    return found.select("c_custkey", "c_mktsegment")


@_register.query("""
SELECT user_id, max(CASE WHEN event_type = 'click' THEN props END) AS click, max(CASE WHEN event_type = 'error' THEN props END) AS error,
       max(CASE WHEN event_type = 'purchase' THEN props END) AS purchase, max(CASE WHEN event_type = 'signup' THEN props END) AS signup,
       max(CASE WHEN event_type = 'view' THEN props END) AS "view"
FROM events WHERE event_type IN ('click', 'error', 'purchase', 'signup', 'view') GROUP BY user_id
""")
def pivot_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-04: a long table of labels as one wide row a key, in one aggregate."""
    return latest.pivot_labels(table(spark, sf_dir, "events"), "user_id", "event_type", "props", ["click", "error", "purchase", "signup", "view"])


@_register.query("""
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open_orders,
       count(DISTINCT o_custkey) AS customers, count(DISTINCT CASE WHEN o_totalprice > 100000 THEN o_custkey END) AS large_customers
FROM orders GROUP BY o_orderpriority
""")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, AGG-02: conditional and distinct counts over one scan."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("o_orderstatus") == "F").alias("done"),
        F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"),
        F.count_distinct("o_custkey").alias("customers"),
        F.count_distinct(F.when(F.col("o_totalprice") > 100000, F.col("o_custkey"))).alias("large_customers"),
    )


@_register.query("""
SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 6) AS mean_price, max(o_orderkey) AS last_order,
       CASE WHEN sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) > 3 THEN 'trusted'
            WHEN sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) > 0 THEN 'active' ELSE 'idle' END AS state
FROM orders GROUP BY o_custkey
""")
def priority_case_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03: a label by the first rule that a group's sums meet."""
    count = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean_price"), F.max("o_orderkey").alias("last_order"),
        F.when(count("F") > 3, "trusted").when(count("O") > 0, "active").otherwise("idle").alias("state"),
    )


@_register.query("""
SELECT c_custkey, count(DISTINCT o_orderpriority) AS kinds FROM customer LEFT JOIN orders ON o_custkey = c_custkey
GROUP BY c_custkey HAVING count(DISTINCT o_orderpriority) < 5
""")
def having_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04: entities that lack some of the dimensions."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    joined = customers.join(orders, customers["c_custkey"] == orders["o_custkey"], "left")
    return joined.groupBy("c_custkey").agg(F.count_distinct("o_orderpriority").alias("kinds")).where("kinds < 5")


@_register.query("""
SELECT l_suppkey, l_returnflag, n FROM (
  SELECT l_suppkey, l_returnflag, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag) AS r
  FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_suppkey, l_returnflag
) WHERE r = 1
""")
def mode_per_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07, AGG-08: the dominant label of each parent, one label left out, ties to the smallest."""
    return latest.mode_per_parent(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag"), "l_suppkey", "l_returnflag", ignore="R")


@_register.query("""
SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS roles, count(*) AS turns FROM conversations GROUP BY conv_id
""")
def ordered_string_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-09: values joined in order; AGG-05's arbitrary column becomes a stated one."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(latest.ordered_text("role", ["turn"], ">").alias("roles"), F.count("*").alias("turns"))


@_register.query("""
SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
FROM orders QUALIFY rank <= 3
""")
def top_rows_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-02, SRT-15: a group's first rows by score, then id."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("rank", rank).where("rank <= 3").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), "rank")


@_register.query("""
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS calls, round(sum(o_totalprice), 2) AS spent, sum(o_totalprice) > 2000000 AS over_budget
FROM orders GROUP BY 1
""")
def monthly_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-25: a ledger by month against a budget."""
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("calls"), F.round(F.sum("o_totalprice"), 2).alias("spent"), (F.sum("o_totalprice") > 2_000_000).alias("over_budget")
    )


@_register.query("""
SELECT 'events' AS name, count(*) AS n, max(event_id) AS last_id, count(DISTINCT user_id) AS keys FROM events
UNION ALL SELECT 'orders', count(*), max(o_orderkey), count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'documents', count(*), max(doc_id), count(DISTINCT source) FROM documents
""")
def library_fingerprint_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-26, AGG-28: a census from which a change of the library shows."""
    def part(name: str, ident: str, key: str) -> DataFrame:
        return table(spark, sf_dir, name).agg(F.count("*").alias("n"), F.max(ident).alias("last_id"), F.count_distinct(key).alias("keys")).select(F.lit(name).alias("name"), "n", "last_id", "keys")

    return part("events", "event_id", "user_id").unionByName(part("orders", "o_orderkey", "o_custkey")).unionByName(part("documents", "doc_id", "source"))


@_register.query("""
SELECT 'segment' AS kind, l_orderkey AS id, l_linenumber AS part FROM lineitem WHERE l_returnflag = 'A'
UNION ALL
SELECT 'whole', o_orderkey, NULL FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'A')
""")
def union_selected_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-01, DOM-20: selected parts, and wholes of which no part is selected."""
    parts = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.lit("segment").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("part"))
    whole = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.lit("whole").alias("kind"), F.col("o_orderkey").alias("id"), F.lit(None).cast("int").alias("part"))
    return parts.unionByName(whole.join(parts.select("id"), "id", "left_anti"))


@_register.query("""
SELECT DISTINCT k AS key FROM (SELECT o_custkey AS k FROM orders UNION SELECT user_id FROM events UNION SELECT l_suppkey FROM lineitem)
WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
""")
def orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-02: keys of three fact tables that name no row of the master table."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).union(table(spark, sf_dir, "events").select("user_id")).union(table(spark, sf_dir, "lineitem").select("l_suppkey"))
    return merge.orphans(keys.distinct(), table(spark, sf_dir, "customer").where("c_acctbal > 0"), "key", "c_custkey")


@_register.query("""
WITH a AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 7 <> 0),
b AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 11 <> 0)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey,
       CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM a FULL JOIN b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_size <> b.p_size
""")
def tree_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-06: what was added, deleted and modified between two versions of a table."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    changed = part.where("p_partkey % 11 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return merge.delta(part.where("p_partkey % 7 <> 0"), changed, ["p_partkey"])


@_register.query("""
SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY
  CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 1 END DESC, o_orderdate, o_orderkey) AS place
FROM orders WHERE o_orderstatus <> 'F'
""")
def claim_queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-09: each worker's queue by weight of kind, then age, then id."""
    from pyspark.sql.window import Window

    weight = F.when(F.col("o_orderpriority") == "1-URGENT", 4).when(F.col("o_orderpriority") == "2-HIGH", 3).when(F.col("o_orderpriority") == "3-MEDIUM", 2).otherwise(1)
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(weight.desc(), "o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_orderpriority", place.alias("place"))


@_register.query("""
WITH source AS (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY o_custkey), target AS (SELECT c_custkey AS key, c_nationkey AS n, c_mktsegment AS origin FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(t.key, s.key) AS key, CAST(CASE WHEN s.key IS NOT NULL AND (t.key IS NULL OR t.origin <> 'BUILDING') THEN s.n ELSE t.n END AS BIGINT) AS n,
       CASE WHEN s.key IS NOT NULL AND (t.key IS NULL OR t.origin <> 'BUILDING') THEN 'derived' ELSE t.origin END AS origin
FROM target t FULL JOIN source s ON t.key = s.key
""")
def guarded_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05, SNK-06: an upsert in which rows of one origin keep what they have."""
    target = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("n"), F.col("c_mktsegment").alias("origin"))
    source = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n")).withColumn("origin", F.lit("derived"))
    return merge.upsert(target, source, ["key"], guard=F.col("origin") != "BUILDING")


@_register.query("""
SELECT l_returnflag, l_linestatus, CAST(sum(n) AS BIGINT) AS n, CAST(least(0.20, round(sum(boost), 6)) AS DOUBLE) AS boost FROM (
  SELECT l_returnflag, l_linestatus, count(*) AS n, 0.0000015 * count(*) AS boost FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL
  UNION ALL SELECT l_returnflag, l_linestatus, count(*), 0.003 * count(*) FROM lineitem WHERE l_linenumber > 3 GROUP BY ALL
) GROUP BY l_returnflag, l_linestatus
""")
def capped_counter_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-07, AGG-30: counters of two batches add up, one of them to a cap. Boosts are above 0, so capping the sum is capping at every upsert."""
    rows = table(spark, sf_dir, "lineitem")
    side = lambda df, w: df.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), (F.lit(w) * F.count("*")).alias("boost"))
    both = merge.counter_upsert(side(rows.where("l_linenumber <= 3"), 0.0000015), side(rows.where("l_linenumber > 3"), 0.003), ["l_returnflag", "l_linestatus"], {"n": None, "boost": 0.20})
    return both.withColumn("boost", F.round("boost", 6))


@_register.query("""
SELECT o_orderkey, l.l_linenumber, l.l_extendedprice > 50000 AS large FROM orders LEFT JOIN lineitem l ON l.l_orderkey = o_orderkey
  AND ((o_orderstatus = 'O' AND l.l_linenumber = 1) OR (o_orderstatus <> 'O' AND l.l_returnflag = 'R'))
""")
def conditional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-06: a disjunctive condition kept as a residual of an equi-join."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & (
        ((F.col("o_orderstatus") == "O") & (F.col("l_linenumber") == 1)) | ((F.col("o_orderstatus") != "O") & (F.col("l_returnflag") == "R"))
    )
    return orders.join(lines, on, "left").select("o_orderkey", "l_linenumber", (F.col("l_extendedprice") > 50000).alias("large"))


@_register.query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract_string(props, '$.missing') AS BIGINT), -1) AS fallback FROM events
""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05, JON-20: typed fields out of JSON text, with fallbacks; what isn't valid is null."""
    field = lambda p: F.get_json_object("props", p).try_cast("long")
    return table(spark, sf_dir, "events").select("event_id", field("$.k").alias("k"), F.coalesce(field("$.missing"), F.lit(-1)).alias("fallback"))


@_register.query("""
SELECT rule, broken FROM (VALUES
 ('positive_quantity', (SELECT count(*) FROM lineitem WHERE NOT l_quantity > 0)), ('known_flag', (SELECT count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N'))),
 ('discount_range', (SELECT count(*) FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.05)))) t(rule, broken)
""")
def check_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema's CHECKs as one aggregate: rows that break each rule."""
    rules = {"positive_quantity": F.col("l_quantity") > 0, "known_flag": F.col("l_returnflag").isin("A", "N"), "discount_range": F.col("l_discount").between(0, 0.05)}
    return merge.violations_check(table(spark, sf_dir, "lineitem"), rules)
