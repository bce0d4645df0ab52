"""Delivery, bands, revisions and plans, over analogues: customers are episodes, their orders items, order lines frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cutroom.operators import delivery
from cutroom.plans.pool import _LAST, rated_clips
from cutroom.plans.registry import Register
from cutroom.plans.timelines import line, micros
from cutroom.session import table

_register = Register()
QUERIES, ORACLE_SQL = _register.queries, _register.sql


@_register.query("""
WITH p AS (SELECT l_orderkey, l_quantity / 10.0 AS pts, CASE WHEN l_linenumber % 2 = 0 THEN l_tax END AS d FROM lineitem), b AS (SELECT l_orderkey, min(pts) AS first_seconds, max(pts + greatest(coalesce(d, 0.04), 0)) AS end_seconds FROM p GROUP BY l_orderkey)
SELECT l_orderkey, round(first_seconds, 6) AS first_seconds, round(end_seconds, 6) AS end_seconds, abs(first_seconds) <= 0.5 + 0.05 + 2.220446049250313e-16 AND abs(end_seconds - first_seconds - 3) <= 0.5 + 2.220446049250313e-16 AS holds FROM b
""")
def packet_time_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-61, DOM-38: first and last times of a file's packets, and whether they fit what was asked for."""
    packets = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") / 10.0).alias("pts"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax")).alias("d"))
    found = delivery.packet_bounds(packets, ["l_orderkey"], "pts", "d", F.lit(0.04))
    holds = delivery.bounds_hold(F.col("first_seconds"), F.col("end_seconds"), F.lit(3.0), F.lit(0.5))
    return found.select("l_orderkey", F.round("first_seconds", 6).alias("first_seconds"), F.round("end_seconds", 6).alias("end_seconds"), holds.alias("holds"))


@_register.query("""
WITH f AS (SELECT l_suppkey % 50 AS k, l_orderkey * 3 AS pts, max(CASE WHEN l_linenumber = 1 THEN 2 END) AS d FROM lineitem GROUP BY ALL), n AS (SELECT *, lead(pts) OVER (PARTITION BY k ORDER BY pts) AS nxt FROM f),
w AS (SELECT *, 300 + k * 40 AS a, 900 + k * 60 AS b FROM n), g AS (SELECT k, min(pts) FILTER (pts >= a AND pts < b) AS first, max(pts) FILTER (pts >= a AND pts < b) AS last, arg_max(coalesce(nxt - pts, d, 1), pts) FILTER (pts >= a AND pts < b) AS step, min(pts) FILTER (pts >= b) AS after FROM w GROUP BY k)
SELECT k, first, coalesce(after, last + step) AS "end" FROM g WHERE first IS NOT NULL
""")
def frames_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-62: the first frame in a window, and where the last one ends."""
    k = F.col("l_suppkey") % 50
    frames = table(spark, sf_dir, "lineitem").select(k.alias("k"), (F.col("l_orderkey") * 3).alias("pts"), F.when(F.col("l_linenumber") == 1, F.lit(2).cast("long")).alias("d"))
    return delivery.window_bounds(frames, ["k"], "pts", "d", 300 + F.col("k") * 40, 900 + F.col("k") * 60)


_ITEMS = """SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 END AS chapter, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 END AS beat, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 11 END AS position,
 CASE WHEN o_orderkey % 13 <> 0 THEN epoch_us(o_orderdate) END AS captured, o_orderpriority = '5-LOW' AS photo FROM orders WHERE o_orderstatus = 'F' OR o_custkey IN (SELECT c_custkey FROM r WHERE "binary" = 1)"""


@_register.query(f"""
WITH r AS ({_LAST}), i AS ({_ITEMS}) SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY photo, chapter NULLS LAST, beat NULLS LAST, position NULLS LAST, captured NULLS LAST, o_orderkey) AS place FROM i
""")
def delivery_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-37: live selects and favourites, in the order of the narrative, the story, then time, photos last."""
    i = F.col("o_orderkey")
    favourites = rated_clips(spark, sf_dir).where("binary = 1").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("favourite"))
    rows = table(spark, sf_dir, "orders").join(favourites, "o_custkey", "left").where("o_orderstatus = 'F' or favourite")
    items = rows.select(
        "o_custkey", "o_orderkey", F.when(i % 3 == 0, i % 4).alias("chapter"), F.when(i % 3 == 0, i % 7).alias("beat"), F.when(i % 5 != 0, i % 11).alias("position"),
        F.when(i % 13 != 0, micros("o_orderdate")).alias("captured"), (F.col("o_orderpriority") == "5-LOW").alias("photo"), F.lit(0).alias("start"),
    )
    return delivery.delivery_order(items, ["o_custkey"], "o_orderkey").select("o_orderkey", F.col("place").cast("long").alias("place"))


@_register.query("""
WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'P'), h AS (SELECT o_custkey, max(o_orderkey % 1000) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT o_orderkey, coalesce(last + r, r - 1) AS position FROM n LEFT JOIN h USING (o_custkey)
""")
def auto_arrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-21: items in canonical order behind what an episode holds already."""
    rows = table(spark, sf_dir, "orders")
    held = rows.where("o_orderstatus = 'F'").select("o_custkey", (F.col("o_orderkey") % 1000).alias("position"))
    new = rows.where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey", "o_orderdate")
    return delivery.appended(new, held, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", F.col("position").cast("long").alias("position"))


@_register.query("""
WITH b AS (SELECT n_nationkey AS item, n_regionkey AS chapter, n_nationkey AS place FROM nation), o AS (SELECT n_nationkey AS item, (n_regionkey + 1) % 5 AS chapter FROM nation WHERE n_nationkey % 4 = 0), c AS (SELECT r_regionkey AS chapter, 4 - r_regionkey AS rank FROM region WHERE r_regionkey <> 2)
SELECT item, coalesce(o.chapter, b.chapter) AS chapter, row_number() OVER (ORDER BY rank IS NULL, rank, coalesce(o.chapter, b.chapter), place) AS place FROM b LEFT JOIN o USING (item) LEFT JOIN c ON c.chapter = coalesce(o.chapter, b.chapter)
""")
def band_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-22: a hand-made layout over the derived one: items' chapters and the chapters' order; the rest follows."""
    n = F.col("n_nationkey")
    base = table(spark, sf_dir, "nation").select(n.alias("item"), F.col("n_regionkey").alias("own"), n.alias("at"))
    items = table(spark, sf_dir, "nation").where(n % 4 == 0).select(n.alias("item"), ((F.col("n_regionkey") + 1) % 5).alias("given"))
    order = table(spark, sf_dir, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").alias("chapter"), (4 - F.col("r_regionkey")).alias("rank"))
    laid = base.join(items, "item", "left").withColumn("chapter", F.coalesce("given", "own")).join(F.broadcast(order), "chapter", "left")  # a band's chapters
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("rank"), "chapter", "at"))  # of one episode's band
    return laid.select("item", "chapter", place.cast("long").alias("place"))


@_register.query("""
WITH l AS (SELECT o_custkey AS k, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders), m AS (SELECT k, arg_min(item, place) FILTER (place = k % 4) AS item, CASE WHEN k % 3 = 0 THEN NULL ELSE k % 9 END AS target FROM l GROUP BY k HAVING item IS NOT NULL),
r AS (SELECT l.k, l.item, row_number() OVER (PARTITION BY l.k ORDER BY l.place) - 1 AS p FROM l LEFT JOIN m ON m.k = l.k AND m.item = l.item WHERE m.item IS NULL),
u AS (SELECT k, item, p * 1.0 AS p, 1 AS o FROM r UNION ALL SELECT k, item, target - 0.5, 0 FROM m WHERE target IS NOT NULL)
SELECT k, item, row_number() OVER (PARTITION BY k ORDER BY p, o) - 1 AS place FROM u
""")
def moved_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-57, DOM-35: a list's item moved or removed, the list numbered anew."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("item_id"), place.alias("place"))
    moves = rows.where(F.col("place") == F.col("k") % 4).select("k", F.col("item_id").alias("item"), F.when(F.col("k") % 3 != 0, F.col("k") % 9).alias("target"))
    found = delivery.moved(rows, "k", "place", "item_id", moves)
    return found.select("k", F.col("item_id").alias("item"), F.col("place").cast("long").alias("place"))


@_register.query("""
WITH l AS (SELECT user_id, event_id, event_type = 'view' AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx FROM events WHERE value IS NOT NULL), m AS (SELECT *, CASE WHEN g AND lag(g) OVER (PARTITION BY user_id ORDER BY idx) THEN 0 ELSE 1 END AS f FROM l),
r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY idx) AS run FROM m) SELECT user_id, min(idx) AS idx, any_value(g) AS gap, list(event_id ORDER BY idx) AS names FROM r GROUP BY user_id, run
""")
def adjacent_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-56: neighbouring gaps of a band shown as one."""
    rows = line(spark, sf_dir)
    return delivery.collapsed_gaps(rows, ["user_id"], "idx", F.col("event_type") == "view", "event_id").select("user_id", F.col("idx").cast("long").alias("idx"), "gap", "names")


@_register.query("""
WITH d AS (SELECT p_partkey, p_retailprice / 7.0 AS s, CAST(least(floor(p_retailprice / 7.0 / 40.0), p_size % 6 + 1, 4) AS INTEGER) AS c FROM part), x AS (SELECT *, unnest(range(0, c)) AS i FROM d WHERE c >= 2)
SELECT p_partkey, i AS part, floor(i * (s / c) / 0.5 + 0.5) * 0.5 AS start, CASE WHEN i = 0 THEN 0.0 ELSE greatest(floor(i * (s / c) / 0.5 + 0.5) * 0.5 - 0.5, 0.0) END AS seek, CASE WHEN i + 1 < c THEN floor((i + 1) * (s / c) / 0.5 + 0.5) * 0.5 END AS "end" FROM x
""")
def long_clip_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-46: parts of long recordings, on a half-second grid with half a second before each."""
    plan = delivery.part_plan(F.col("p_retailprice") / 7.0, F.col("p_size") % 6)
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(plan).alias("part", "x")).select("p_partkey", F.col("part").cast("long").alias("part"), "x.start", "x.seek", "x.end")


@_register.query("""
WITH s AS (SELECT l_orderkey, l_linenumber - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey % 4 % 2 + 1 END AS ch, CASE WHEN l_partkey % 3 = 0 THEN 44100 ELSE 48000 END AS rate FROM lineitem)
SELECT l_orderkey, i, CASE WHEN coalesce(ch = 1, FALSE) AND rate = 48000 AND n > 1 THEN 'wireless_mic' WHEN i = 0 AND coalesce(ch = 2, FALSE) THEN 'onboard_mic' ELSE 'unknown' END AS role FROM s
""")
def audio_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-48, SRC-17: what each audio stream of a file probably is."""
    streams = table(spark, sf_dir, "lineitem").withColumn("i", F.col("l_linenumber") - 1).withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey")))
    channels = F.when(F.col("l_suppkey") % 4 != 0, F.col("l_suppkey") % 4 % 2 + 1)
    return streams.select("l_orderkey", "i", delivery.audio_role(F.col("i"), F.col("n"), channels, F.when(F.col("l_partkey") % 3 == 0, 44100).otherwise(48000)).alias("role"))


_FLOW = "['DH INTRO', 'MAP', 'REAL/ESTABLISHING', 'REAL/EXPERIENCE', 'REAL/DETAIL', 'DH OVERLAY', 'REAL/HUMAN', 'ATMOSPHERE', 'TRANSITION']"


@_register.query(f"""
WITH p AS (SELECT user_id, event_id, {_FLOW}[event_id % 9 + 1] AS slot, event_id % 9 + 1 AS b, row_number() OVER w AS r, lag(event_id % 9 + 1) OVER w AS a FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, CASE WHEN b > a THEN len(list_filter({_FLOW}[a + 1 : b - 1], lambda s: s LIKE 'REAL/%' OR s IN ('ATMOSPHERE', 'TRANSITION'))) ELSE 0 END AS between_ FROM p WHERE a IS NOT NULL AND CASE WHEN b > a THEN len(list_filter({_FLOW}[a + 1 : b - 1], lambda s: s LIKE 'REAL/%' OR s IN ('ATMOSPHERE', 'TRANSITION'))) ELSE 0 END < 2
""")
def host_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-31: appearances with fewer than two filmed slots since the one before."""
    flow = F.array(*[F.lit(f) for f in delivery.FLOW])
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("slot", F.element_at(flow, (F.col("event_id") % 9 + 1).cast("int")))
    before = F.lag("slot").over(Window.partitionBy("user_id").orderBy("event_id"))
    return rows.withColumn("_b", before).where("_b is not null").select("event_id", delivery.filmed_between(F.col("_b"), F.col("slot")).cast("long").alias("between_")).where("between_ < 2")


@_register.query("""
WITH b AS (SELECT o_custkey AS draft, o_orderkey % 30 AS item, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT DISTINCT o_custkey AS draft, o_orderkey % 30 AS item FROM orders WHERE o_orderkey % 7 <> 0 UNION SELECT c_custkey, c_custkey % 30 FROM customer)
SELECT coalesce(b.draft, s.draft) AS draft, CAST(sum(CASE WHEN s.item IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS "foreign", CAST(sum(CASE WHEN b.item IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN b.n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeated
FROM b FULL OUTER JOIN s ON s.draft = b.draft AND s.item = b.item GROUP BY 1
""")
def draft_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-34: drafts must use every selected item, once, and no other."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("draft"), (F.col("o_orderkey") % 30).alias("item"), "o_orderkey")
    wanted = rows.where("o_orderkey % 7 <> 0").select("draft", "item").union(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey") % 30))
    return delivery.draft_faults(rows, wanted, "draft", "item")


@_register.query("""
SELECT p_partkey, round(CASE WHEN p_partkey % 3 = 0 AND p_size % 4 > 0 THEN least(1.0, greatest(0.0, coalesce(CASE WHEN p_partkey % 5 <> 0 THEN p_size / 50.0 END, 0.5) + CASE WHEN p_partkey % 2 = 0 THEN 0.10 ELSE -0.20 END)) ELSE CASE WHEN p_partkey % 5 <> 0 THEN p_size / 50.0 END END::DOUBLE, 6) AS narrative FROM part
""")
def memory_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-25: the narrative score after what the channel has shown before."""
    k, size = F.col("p_partkey"), F.col("p_size")
    score = delivery.remembered(F.lit(None), F.when(k % 5 != 0, size / 50.0), k % 3 == 0, k % 2 == 0, size % 4)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("narrative"))


@_register.query("SELECT c_custkey, CASE WHEN c_acctbal >= 300 THEN 300 WHEN c_acctbal >= 180 THEN 180 WHEN c_acctbal >= 90 THEN 90 WHEN c_acctbal >= 60 THEN 60 END AS target FROM customer")
def target_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-58: the greatest target on offer that a budget allows, else none."""
    targets = F.array(*[F.lit(t) for t in (60, 90, 180, 300)])
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_max(F.filter(targets, lambda t: t <= F.col("c_acctbal"))).alias("target"))


@_register.query("""
WITH i AS (SELECT p_brand AS ep, p_size % 4 AS ch, count(*) AS n, sum(p_size) AS secs FROM part WHERE p_size % 5 > 0 GROUP BY ALL), c AS (SELECT ep, ch FROM (SELECT DISTINCT p_brand AS ep FROM part), (SELECT unnest(range(4)) AS ch))
SELECT ep, ch AS chapter, coalesce(n, 0) AS items, coalesce(CAST(secs AS BIGINT), 0) AS seconds, coalesce(CAST(sum(n) OVER (PARTITION BY ep ORDER BY ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) + 1 AS first_number, n IS NULL AS gap FROM c LEFT JOIN i USING (ep, ch)
""")
def band_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-54: chapters of a band with their items, lengths and running numbers; an empty one is a gap."""
    part = table(spark, sf_dir, "part")
    items = part.where("p_size % 5 > 0").groupBy(F.col("p_brand").alias("ep"), (F.col("p_size") % 4).cast("long").alias("chapter")).agg(F.count("*").alias("n"), F.sum("p_size").alias("secs"))
    chapters = part.select(F.col("p_brand").alias("ep")).distinct().withColumn("chapter", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    before = F.sum("n").over(Window.partitionBy("ep").orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1))
    joined = chapters.join(items, ["ep", "chapter"], "left")
    return joined.select("ep", "chapter", F.coalesce("n", F.lit(0)).alias("items"), F.coalesce("secs", F.lit(0)).alias("seconds"), (F.coalesce(before, F.lit(0)) + 1).alias("first_number"), F.col("n").isNull().alias("gap"))


@_register.query("""
WITH g AS (SELECT doc_id, source, n_chars, coalesce(toxic, 0) AS junk, doc_id % 60 AS grp FROM documents LEFT JOIN labels USING (doc_id)), p AS (SELECT grp, count(*) AS n, max(junk) AS junk, arg_max(doc_id, (n_chars, -doc_id)) AS shown, max(n_chars) AS c FROM g GROUP BY grp)
SELECT grp, shown, n, junk = 1 AS junk, row_number() OVER (ORDER BY junk, c DESC, grp) AS place FROM p
""")
def photo_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-50: groups shown by one photo each, those with junk last."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("junk", F.coalesce("toxic", F.lit(0)))
    groups = docs.groupBy((F.col("doc_id") % 60).alias("grp")).agg(F.count("*").alias("n"), F.max("junk").alias("junk"), F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("shown"), F.max("n_chars").alias("c"))
    place = F.row_number().over(Window.orderBy("junk", F.desc("c"), "grp"))  # of sixty groups
    return groups.select("grp", "shown", "n", (F.col("junk") == 1).alias("junk"), place.cast("long").alias("place"))


@_register.query("""
SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'import' WHEN count(*) FILTER (o_orderpriority = '1-URGENT') > 1 THEN 'analyse' WHEN count(*) FILTER (o_orderstatus = 'F') < 2 THEN 'select' WHEN max(o_totalprice) < 300000 THEN 'arrange' ELSE 'done' END AS state FROM orders GROUP BY o_custkey
""")
def pipeline_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-51: the first step of each episode that is not finished, out of one aggregate."""
    n = lambda c: F.count(F.when(c, 1))
    state = F.when(n(F.col("o_orderstatus") == "P") > 0, "import").when(n(F.col("o_orderpriority") == "1-URGENT") > 1, "analyse").when(n(F.col("o_orderstatus") == "F") < 2, "select").when(F.max("o_totalprice") < 300000, "arrange").otherwise("done")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(state.alias("state"))


@_register.query("""
WITH e AS (SELECT p_partkey AS clip, p_brand AS grp, p_retailprice AS stars FROM part), a AS (SELECT clip, grp, row_number() OVER (PARTITION BY grp ORDER BY stars DESC, clip) = 1 AS auto FROM e),
m AS (SELECT l_partkey AS clip, arg_max(l_returnflag, (l_orderkey, l_linenumber, l_suppkey, l_returnflag)) AS act FROM lineitem GROUP BY l_partkey), s AS (SELECT grp, arg_max(clip, (p, -clip)) AS manual FROM (SELECT a.grp, m.clip, (SELECT max(l_orderkey) FROM lineitem l WHERE l.l_partkey = m.clip) AS p FROM m JOIN a ON a.clip = m.clip WHERE act = 'R') GROUP BY grp)
SELECT a.grp, coalesce(s.manual, a.clip) AS primary_clip, s.manual IS NOT NULL AS by_hand FROM a LEFT JOIN s ON s.grp = a.grp WHERE auto
""")
def preferred_primaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-13: each group's primary: the latest preference by hand that still holds, else the best by score."""
    from cutroom.operators.latest import first_per_key, latest_per_key

    members = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("clip"), F.col("p_brand").alias("grp"), "p_retailprice")
    auto = first_per_key(members, ["grp"], [-F.col("p_retailprice"), F.col("clip")], ["clip"])
    ledger = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("clip"), "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    active = latest_per_key(ledger, ["clip"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag"]).where("l_returnflag = 'R'").join(members.select("clip", "grp"), "clip")
    manual = first_per_key(active, ["grp"], [-F.col("l_orderkey"), F.col("clip")], ["clip"]).withColumnRenamed("clip", "manual")
    return auto.join(manual, "grp", "left").select("grp", F.coalesce("manual", "clip").alias("primary_clip"), F.col("manual").isNotNull().alias("by_hand"))
