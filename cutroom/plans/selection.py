"""Scores, budgets, stacks and story structure over analogues of clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutroom.functions.scalars import keywords
from cutroom.operators import selection, story
from cutroom.plans.registry import Register
from cutroom.plans.timelines import micros, placed, seconds
from cutroom.session import table

_register = Register()
QUERIES, ORACLE_SQL = _register.queries, _register.sql

_MODERATE = "CASE WHEN m < 0.05 THEN m / 0.05 WHEN m <= 0.45 THEN 1.0 ELSE 1.0 - (m - 0.45) / 0.55 * 0.8 END"


@_register.query(f"""
WITH w AS (SELECT event_id, (event_id % 11) / 10.0::DOUBLE AS sharp, (event_id % 21) / 20.0::DOUBLE AS m, event_id % 3 <> 0 AS expo, event_type = 'purchase' AS speech, event_type = 'click' AS loud,
 event_type = 'error' AS cut, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 5) / 4.0::DOUBLE END AS interest, event_id % 2 = 0 AS audio FROM events)
SELECT event_id, round((0.24 * sharp + 0.20 * {_MODERATE} + 0.16 * expo::INT + 0.08 * (1 - cut::INT) + CASE WHEN audio THEN 0.12 * CASE WHEN speech THEN 1.0 WHEN loud THEN 0.6 ELSE 0 END ELSE 0 END
 + coalesce(0.20 * interest, 0)) / (0.68 + CASE WHEN audio THEN 0.12 ELSE 0 END + CASE WHEN interest IS NULL THEN 0 ELSE 0.20 END)::DOUBLE, 6) AS score FROM w
""")
def moment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-01, AGG-17: window scores whose unknown terms leave the denominator as well; signals are derived from ids."""
    i, kind = F.col("event_id"), F.col("event_type")
    score = selection.moment_score(
        (i % 11) / 10.0, (i % 21) / 20.0, i % 3 != 0, kind == "purchase", kind == "click", kind == "error", F.when(i % 4 != 0, (i % 5) / 4.0), i % 2 == 0
    )
    return table(spark, sf_dir, "events").select("event_id", F.round(score, 6).alias("score"))


@_register.query("""
SELECT p_partkey, round(CAST(least(1.0, greatest(0.0, (0.28 * a + 0.18 * coalesce(b, 0) + 0.20 * c + coalesce(0.12 * d, 0)) / (0.48 + CASE WHEN b IS NULL THEN 0 ELSE 0.18 END + CASE WHEN d IS NULL THEN 0 ELSE 0.12 END)
 + least(0.20, 0.03 * (p_partkey % 10)))) AS DOUBLE), 6) AS score FROM (
 SELECT p_partkey, p_size / 50.0 AS a, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey % 7) / 7.0 END AS b, (p_partkey % 13) / 13.0 AS c, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 0.5 END AS d FROM part)
""")
def best_take_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-24, AGG-16: a mean of the known axes by weight, with a capped boost."""
    k = F.col("p_partkey")
    axes = {"technical": F.col("p_size") / 50.0, "composition": F.when(k % 3 != 0, (k % 7) / 7.0), "motion": (k % 13) / 13.0, "audio": F.when(k % 5 != 0, F.lit(0.5))}
    return table(spark, sf_dir, "part").select("p_partkey", F.round(selection.take_score(axes, 0.03 * (k % 10)), 6).alias("score"))


@_register.query("""
SELECT doc_id, quality, toxic, CASE WHEN NOT bad THEN 'usable' WHEN toxic * 0.4 + (doc_id % 10) / 10.0 >= 0.70 THEN 'rescue' ELSE 'unusable' END AS state FROM (
 SELECT *, quality <= 0.35 AND (doc_id % 4) / 4.0 <= 0.35 AS bad FROM labels)
""")
def safety_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-26: unusable where all technical scores are low, rescued where the story needs it."""
    i = F.col("doc_id")
    state = selection.safety(F.array(F.col("quality").cast("double"), (i % 4) / 4.0), F.col("toxic") * 0.4 + (i % 10) / 10.0)
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", state.alias("state"))


@_register.query("""
WITH RECURSIVE o AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS id, CAST(l_quantity AS BIGINT) AS c, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber, CAST(l_quantity AS BIGINT)) AS r FROM lineitem),
f AS (SELECT k, list(id ORDER BY r) AS ids, list(c ORDER BY r) AS cs, max(r) AS n FROM o GROUP BY k), g AS (
 SELECT k, ids, cs, n, 1 AS pos, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS picked FROM f UNION ALL
 SELECT k, ids, cs, n, pos + 1, CASE WHEN used + cs[pos] <= 300 THEN used + cs[pos] ELSE used END, CASE WHEN used + cs[pos] <= 300 THEN list_append(picked, ids[pos]) ELSE picked END FROM g WHERE pos <= n)
SELECT k AS l_suppkey, used, unnest(picked) AS id, CAST(unnest(range(1, len(picked) + 1)) AS BIGINT) AS place FROM g WHERE pos = n + 1
""")
def greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-07: best first within a budget; what does not fit is passed over, and later rows still may."""
    rows = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    found = selection.greedy_budget(rows, ["l_suppkey"], [-F.col("l_extendedprice"), F.col("id")], "id", "l_quantity", 300)
    return found.select("l_suppkey", "used", "id", F.col("place").cast("long").alias("place"))


@_register.query("""
WITH RECURSIVE t AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS id, CAST(l_quantity AS BIGINT) AS c, l_returnflag AS g, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber, l_quantity) AS turn FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn, g, id, c) AS r FROM t), f AS (SELECT k, list(id ORDER BY r) AS ids, list(c ORDER BY r) AS cs, max(r) AS n FROM o GROUP BY k), g AS (
 SELECT k, ids, cs, n, 1 AS pos, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS picked FROM f UNION ALL
 SELECT k, ids, cs, n, pos + 1, CASE WHEN used + cs[pos] <= 200 THEN used + cs[pos] ELSE used END, CASE WHEN used + cs[pos] <= 200 THEN list_append(picked, ids[pos]) ELSE picked END FROM g WHERE pos <= n)
SELECT k AS l_suppkey, used, unnest(picked) AS id, CAST(unnest(range(1, len(picked) + 1)) AS BIGINT) AS place FROM g WHERE pos = n + 1
""")
def rotate_by_group_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-07: the same budget, groups taking turns."""
    rows = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    turns = selection.rotated_order(rows, ["l_suppkey"], "l_returnflag", [F.desc("l_extendedprice"), F.col("id"), F.col("l_quantity")])
    found = selection.greedy_budget(turns, ["l_suppkey"], [F.col("turn"), F.col("l_returnflag"), F.col("id")], "id", "l_quantity", 200)
    return found.select("l_suppkey", "used", "id", F.col("place").cast("long").alias("place"))


@_register.query("""
WITH r AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS c FROM orders WHERE floor(o_totalprice) > 0), n AS (SELECT *, 500000 // count(*) OVER (PARTITION BY o_custkey) AS share FROM r), g AS (SELECT *, least(c, greatest(share, 2000)) AS g FROM n),
l AS (SELECT *, greatest(500000 - sum(g) OVER (PARTITION BY o_custkey), 0) AS rest, coalesce(sum(c - g) OVER (PARTITION BY o_custkey ORDER BY c DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT o_custkey, o_orderkey, CAST(g + greatest(0, least(c - g, rest - before)) AS BIGINT) AS granted FROM l
""")
def rough_cut_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-36: equal shares of a target, what is left extending the longest first; tests hold it against a plain loop."""
    rows = table(spark, sf_dir, "orders").withColumn("ms", F.floor("o_totalprice").cast("long"))
    return selection.rough_cut(rows, ["o_custkey"], "o_orderkey", "ms", 500_000)


@_register.query("""
SELECT CASE WHEN p_size % 9 = 0 THEN '#' || p_partkey ELSE p_brand || '|' || p_type || '|' || (p_size // 10) END AS stack, count(*) AS members, min(p_partkey) AS first_member, round(max(p_retailprice), 2) AS best
FROM part GROUP BY 1
""")
def stack_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-23: takes of one subject by a composite key; rows with an unknown label stay alone."""
    key = selection.stack_key([F.col("p_brand"), F.col("p_type"), F.floor(F.col("p_size") / 10).cast("string")], F.col("p_size") % 9 == 0, F.col("p_partkey"))
    return table(spark, sf_dir, "part").groupBy(key.alias("stack")).agg(F.count("*").alias("members"), F.min("p_partkey").alias("first_member"), F.round(F.max("p_retailprice"), 2).alias("best"))


@_register.query("""
WITH e AS (SELECT *, epoch_us(ts) // 1000000 AS s, 40 + (event_id % 50) * 0.01 AS lat, 10 + (event_id % 70) * 0.01 AS lon FROM events), l AS (
 SELECT *, lag(s) OVER w AS ps, lag(CAST(ts AS DATE)) OVER w AS pd, lag(lat) OVER w AS pa, lag(lon) OVER w AS po, lag(event_type) OVER w AS pt, lag(event_id) OVER w AS pid FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, coalesce(s - ps > 2700, FALSE) AS f0, coalesce(CAST(ts AS DATE) <> pd, FALSE) AS f1,
 coalesce(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - pa) / 2), 2) + cos(radians(pa)) * cos(radians(lat)) * pow(sin(radians(lon - po) / 2), 2)))) > 2, FALSE) AS f2,
 coalesce(event_type <> pt, FALSE) AS f3, coalesce(event_id % 3 <> pid % 3, FALSE) AS f4 FROM l)
SELECT event_id, round(CAST(least(1.0, 0.40 * f0::INT + 0.65 * f1::INT + 0.35 * f2::INT + 0.20 * f3::INT + 0.35 * f4::INT) AS DOUBLE), 6) AS boundary,
 array_to_string(list_filter([CASE WHEN f0 THEN 'time_gap' END, CASE WHEN f1 THEN 'date_change' END, CASE WHEN f2 THEN 'moved' END, CASE WHEN f3 THEN 'stage_change' END, CASE WHEN f4 THEN 'new_subject' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM f WHERE f0 OR f1 OR f2 OR f3 OR f4
""")
def boundary_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-06, SET-05: how much each event begins something new, and why."""
    events = placed(table(spark, sf_dir, "events"))
    words = F.array(F.concat(F.lit("word"), F.col("event_id") % 3))
    found = story.boundary_scores(events, ["user_id"], ["ts", "event_id"], seconds("ts"), F.to_date("ts"), F.col("lat"), F.col("lon"), F.col("event_type"), words)
    return found.select("event_id", F.round("boundary", 6).alias("boundary"), F.array_join("reasons", ",").alias("reasons"))


@_register.query("""
WITH e AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events), last AS (SELECT day FROM e GROUP BY day ORDER BY day DESC LIMIT 4)
SELECT user_id, count(DISTINCT day) AS groups, count(DISTINCT day) >= 3 AS routine FROM e WHERE day IN (SELECT day FROM last) GROUP BY user_id
""")
def routine_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-30: signatures met in three of the last four groups are routine."""
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "user_id", "ts")
    return story.routine(events, "day", "day", "user_id").select("user_id", "groups", "routine")


@_register.query("""
WITH p AS (SELECT s_suppkey, -60 + (s_suppkey * 7919 % 1200) / 10.0::DOUBLE AS lat, -170 + (s_suppkey * 104729 % 3400) / 10.0::DOUBLE AS lon FROM supplier), q AS (SELECT c_custkey, -60 + (c_custkey * 6151 % 1200) / 10.0::DOUBLE AS lat, -170 + (c_custkey * 3571 % 3400) / 10.0::DOUBLE AS lon FROM customer)
SELECT c_custkey FROM q WHERE NOT EXISTS (SELECT 1 FROM p WHERE 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(p.lat - q.lat) / 2), 2) + cos(radians(q.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - q.lon) / 2), 2)))) < 200)
""")
def novel_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-30, JON-12: places far from all that were seen, by a grid; the tables have none, so places come from keys."""
    place = lambda key, a, b: ((F.lit(-60) + (F.col(key) * a % 1200) / 10.0).alias("lat"), (F.lit(-170) + (F.col(key) * b % 3400) / 10.0).alias("lon"))
    seen = table(spark, sf_dir, "supplier").select("s_suppkey", *place("s_suppkey", 7919, 104729))
    rows = table(spark, sf_dir, "customer").select("c_custkey", *place("c_custkey", 6151, 3571))
    return story.far_from_all(rows, seen, "c_custkey", "lat", "lon", km=200.0).select("c_custkey")


@_register.query("""
WITH planned AS (SELECT n_nationkey AS nation, r_regionkey AS slot FROM nation, region WHERE (n_nationkey + r_regionkey) % 3 <> 0), covered AS (SELECT DISTINCT c_nationkey AS nation, CAST(c_custkey % 5 AS INTEGER) AS slot FROM customer WHERE c_acctbal > 9000),
known AS (SELECT n_nationkey AS nation, n_regionkey AS slot FROM nation)
SELECT p.nation, p.slot, CASE WHEN c.nation IS NULL THEN 'open' ELSE 'dismissed' END AS state FROM planned p LEFT JOIN covered c ON c.nation = p.nation AND c.slot = p.slot
UNION ALL SELECT nation, slot, 'closed' FROM known k WHERE NOT EXISTS (SELECT 1 FROM planned p WHERE p.nation = k.nation AND p.slot = k.slot)
""")
def story_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-32: planned slots that nothing covers, covered ones, and known ones that are planned no more."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    slots = regions.agg(F.collect_list("r_regionkey").alias("slots"))  # five regions
    planned = nations.join(F.broadcast(slots)).select(F.col("n_nationkey").alias("nation"), F.explode("slots").alias("slot")).where("(nation + slot) % 3 <> 0")
    covered = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 5).cast("int").alias("slot"))
    return story.gaps(planned, covered, nations.select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("slot")), ["nation", "slot"])


@_register.query("""
WITH m AS (SELECT user_id, epoch_us(ts) // 1000 AS own, epoch_us(ts) // 1000 + (user_id % 7) * 60000 + (event_id % 5) * 20000 + CASE WHEN event_id % 6 = 0 THEN 900000 ELSE 0 END AS other FROM events), o AS (SELECT *, other - own AS o FROM m),
n AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY o RANGE BETWEEN 120000 PRECEDING AND CURRENT ROW) AS n FROM o), b AS (SELECT user_id, arg_min(o, struct_pack(a := -n, b := o)) AS last FROM n GROUP BY user_id),
i AS (SELECT o.* FROM o JOIN b ON b.user_id = o.user_id AND o.o BETWEEN b.last - 120000 AND b.last), g AS (SELECT *, own - lag(own) OVER w AS g1, other - lag(other) OVER w AS g2 FROM i WINDOW w AS (PARTITION BY user_id ORDER BY own, other)),
h AS (SELECT user_id, list_sort(list(o)) AS os, count(*) AS matches, count(*) FILTER (g1 > 0 AND g2 > 0 AND abs(g1 - g2) <= 30000) AS intervals FROM g GROUP BY user_id HAVING count(*) >= 2),
k AS (SELECT *, os[len(os) // 2 + 1] AS offset_ms FROM h), d AS (SELECT *, list_sort(list_transform(os, lambda x: abs(x - offset_ms)))[len(os) // 2 + 1] AS deviation FROM k)
SELECT user_id, matches, intervals, offset_ms, deviation, round(0.45 * least(matches / 4.0, 1.0) + 0.35 * least(intervals / 2.0, 1.0) + 0.20 * greatest(0.0, 1.0 - deviation / 120000.0)::DOUBLE, 6) AS confidence,
 matches >= 3 AND intervals >= 1 AND deviation <= 30000 AND 0.45 * least(matches / 4.0, 1.0) + 0.35 * least(intervals / 2.0, 1.0) + 0.20 * greatest(0.0, 1.0 - deviation / 120000.0)::DOUBLE >= 0.70 AS accepted FROM d
""")
def clock_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-17: each device's clock offset from its matched moments; a second clock is derived from ids."""
    ms, i, u = F.floor(micros("ts") / 1000).cast("long"), F.col("event_id"), F.col("user_id")
    other = ms + (u % 7) * 60_000 + (i % 5) * 20_000 + F.when(i % 6 == 0, 900_000).otherwise(0)
    found = story.clock_offsets(table(spark, sf_dir, "events").select("user_id", ms.alias("own"), other.alias("other")), "user_id", "own", "other")
    return found.select("user_id", "matches", "intervals", "offset_ms", "deviation", F.round("confidence", 6).alias("confidence"), "accepted")


@_register.query("""
SELECT event_id, arg_min(chapter, struct_pack(a := abs(s - t), b := chapter)) AS chapter FROM (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s FROM events) e
JOIN (SELECT user_id, event_id AS chapter, epoch_us(ts) // 1000000 AS t FROM events WHERE event_type = 'signup' AND event_id % 3 = 0) a ON a.user_id = e.user_id GROUP BY event_id
""")
def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-19: every item goes to the hand-made chapter nearest in time."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", seconds("ts").alias("s"))
    anchors = events.where("event_type = 'signup' and event_id % 3 = 0").select("user_id", F.col("event_id").alias("chapter"), F.col("s").alias("t"))
    return story.nearest_anchor(events, anchors, "user_id", "event_id", "s", "chapter", "t").select("event_id", "chapter")


@_register.query("""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source FROM r WHERE r <= greatest(1, round(n * 0.4))
""")
def montage_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-33: a montage keeps its share of each group, one at least."""
    return story.montage_keep(table(spark, sf_dir, "documents"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 0.6).select("doc_id", "source")


@_register.query("""
WITH g AS (SELECT d.doc_id, lang, quality, toxic, n_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY quality DESC NULLS LAST, toxic ASC NULLS LAST, n_chars, doc_id) AS place FROM g
""")
def primary_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-07, SRT-08: who stands for a group: rating, then flaws, then size, then id; unknown last."""
    from cutroom.operators.search import primary_pick as pick

    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    order = [F.col("quality").desc_nulls_last(), F.col("toxic").asc_nulls_last(), F.col("n_chars"), F.col("doc_id")]
    return pick(joined, "lang", order).select("doc_id", "lang", F.col("place").cast("long").alias("place"))


@_register.query("""
WITH RECURSIVE q AS (SELECT conv_id, list(turn ORDER BY turn) AS queue FROM conversations GROUP BY conv_id), v AS (SELECT conv_id, queue, list_transform(queue[2:], lambda t: CASE WHEN t % 4 = 3 THEN NULL WHEN t % 2 = 0 THEN t ELSE t - 1 END) AS vs FROM q),
g AS (SELECT conv_id, queue, vs, queue[1] AS front, 2 AS pos, CAST([] AS BIGINT[]) AS parked, 1 AS i FROM v UNION ALL
 SELECT conv_id, queue, vs, CASE WHEN known AND (w IS NULL OR w = other) THEN other ELSE front END, CASE WHEN known THEN pos + 1 ELSE pos END, CASE WHEN known AND w IS NULL THEN list_append(parked, front) ELSE parked END, i + 1
 FROM (SELECT *, queue[pos] AS other, vs[i] AS w, coalesce(queue[pos] IS NOT NULL AND (vs[i] IS NULL OR vs[i] = front OR vs[i] = queue[pos]), FALSE) AS known FROM g WHERE i <= len(vs)))
SELECT conv_id, front AS winner, array_to_string(parked, ',') AS co_winners, CAST(greatest(len(queue) - pos + 1, 0) AS INTEGER) AS waiting FROM g WHERE i = len(vs) + 1
""")
def duel_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-39: winners of sessions whose queue is the turns and whose verdicts come from their lengths; tests replay by hand."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("queue"))
    verdicts = F.transform(F.slice("queue", F.lit(2), F.size("queue")), lambda t: F.when(t % 4 == 3, F.lit(None)).when(t % 2 == 0, t).otherwise(t - 1).cast("long"))
    rows = turns.withColumn("verdicts", verdicts)
    found = selection.replay_duels(rows, "conv_id", "queue", "verdicts")
    return found.withColumn("co_winners", F.array_join(F.transform("co_winners", lambda x: x.cast("string")), ","))


@_register.query("""
WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) AS word FROM documents)
SELECT word, count(*) AS docs FROM w GROUP BY word HAVING count(*) >= 20
""")
def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of each text, and in how many texts each occurs; those in twenty texts or more are topics."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(keywords(F.col("text")))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("docs")).where("docs >= 20")


@_register.query("""
SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') > count(*) FILTER (o_orderstatus = 'F') AS portrait FROM orders GROUP BY o_custkey
""")
def majority_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23: the majority of a group, ties to the default."""
    count = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), (count("O") > count("F")).alias("portrait"))





@_register.query("""
WITH p AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t, epoch_us(ts) // 7200000000 % 5000 AS a, event_id % 2 AS b FROM events), m AS (SELECT q.event_id, q.user_id, any_value(q.t) AS own, min(r.t) AS other FROM p q JOIN p r ON r.a = q.a AND r.b = q.b WHERE q.user_id % 5 <> 0 AND r.user_id % 5 = 0 GROUP BY ALL)
SELECT event_id, user_id, other - own AS offset_ms FROM m WHERE abs(other - own) <= 50400000
""")
def gps_clock_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-17, JON-12: each moment's nearest reference moment by place, and how far the clocks differ; users of a fifth are the reference."""
    spot = F.floor(micros("ts") / 7_200_000_000) % 5000  # a place for every two hours, and two sides of it
    rows = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.floor(micros("ts") / 1000).cast("long").alias("t"), (40 + (spot % 70) * 0.01).alias("lat"), (10 + F.floor(spot / 70) * 0.02 + (F.col("event_id") % 2) * 0.01).alias("lon")
    )
    found = story.gps_matches(rows.where("user_id % 5 <> 0"), rows.where("user_id % 5 = 0"), "user_id", "event_id", "t", "lat", "lon")
    return found.select("event_id", "user_id", (F.col("other") - F.col("own")).alias("offset_ms"))
