"""Automatic selection end to end over analogues: users are clips, their events moments, remainders of ids chapters and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutroom.operators import autoselect, selection
from cutroom.plans.registry import Register
from cutroom.plans.timelines import EVENTS, line, seconds
from cutroom.session import table

_register = Register()
QUERIES, ORACLE_SQL = _register.queries, _register.sql
#: Values are whole hundredths, so that means of 2, 4 or 8 of them are exact and order alike everywhere.
_LINE = "SELECT user_id, event_id, event_type, CAST(round(value * 100) AS BIGINT) AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx FROM events WHERE value IS NOT NULL"
#: Moments of a suggestion, halved down to the least while every stretch has a cut inside; seconds of a moment; an episode's seconds.
TARGET, LEAST, MOMENT, BUDGET = 8, 2, 5, 220


@_register.query(f"""
WITH e AS ({EVENTS}), m AS (SELECT event_id, user_id, s + 900 AS mid FROM e WHERE event_type = 'view'), f AS (SELECT user_id, s, min(value) AS interest FROM e WHERE event_type = 'click' GROUP BY user_id, s)
SELECT m.event_id, round(arg_min(interest, abs(f.s - mid) * 100000000000 + f.s), 4) AS interest FROM m LEFT JOIN f ON f.user_id = m.user_id GROUP BY m.event_id
""")
def painted_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-02: moments get the interest of the frame nearest to their middle."""
    events = table(spark, sf_dir, "events").withColumn("s", seconds("ts"))
    moments = events.where("event_type = 'view'").select("event_id", "user_id", F.col("s").alias("a"), (F.col("s") + 1800).alias("b"))
    frames = events.where("event_type = 'click'").groupBy("user_id", F.col("s").alias("t")).agg(F.min("value").alias("interest"))
    return autoselect.painted(moments, frames, ["user_id"], "a", "b", "t", "interest").select("event_id", F.round("interest", 4).alias("interest"))


@_register.query(f"""
WITH e AS ({EVENTS}), m AS (SELECT event_id, user_id, s AS a, s + 1800 AS b, value > 50 AS own FROM e WHERE event_type = 'view'), t AS (SELECT user_id, s AS x, s + 600 AS y FROM e WHERE event_type = 'purchase' AND user_id % 4 <> 0)
SELECT event_id, CASE WHEN user_id IN (SELECT user_id FROM t) THEN EXISTS (SELECT 1 FROM t WHERE t.user_id = m.user_id AND x < b AND y > a) ELSE own END AS speech FROM m
""")
def transcript_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-03: where a clip has a transcript, speech is where its lines are."""
    events = table(spark, sf_dir, "events").withColumn("s", seconds("ts"))
    moments = events.where("event_type = 'view'").select("event_id", "user_id", F.col("s").alias("a"), (F.col("s") + 1800).alias("b"), (F.col("value") > 50).alias("speech"))
    spans = events.where("event_type = 'purchase' and user_id % 4 <> 0").select("user_id", F.col("s").alias("x"), (F.col("s") + 600).alias("y"))
    return autoselect.spoken(moments, spans, ["user_id"], "event_id", "a", "b", ("x", "y"), 3600).select("event_id", "speech")


def _tries() -> str:
    out = []
    for n, (span, wall) in enumerate([(s, True) for s in selection.spans_for(TARGET, LEAST)] + [(s, False) for s in selection.spans_for(TARGET, LEAST)]):
        inside = f"max(CASE WHEN event_type IN ('error', 'click') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND {span - 1} FOLLOWING)"
        out.append(
            f"SELECT user_id, idx, mean, {span} AS span, {n} AS try FROM (SELECT user_id, idx, avg(value) OVER w AS mean, count(*) OVER w AS n, {inside} AS cut FROM l WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND {span - 1} FOLLOWING)) WHERE n = {span}"
            + (" AND coalesce(cut, 0) = 0" if wall else "")
        )
    return " UNION ALL ".join(out)


_SUGGESTED = f"""l AS ({_LINE}), t AS ({_tries()}), c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mean DESC, idx) AS r FROM t QUALIFY try = min(try) OVER (PARTITION BY user_id)),
f AS (SELECT user_id, any_value(span) AS span, list(idx ORDER BY r) AS ids, list(mean ORDER BY r) AS means, count(*) AS n FROM c GROUP BY user_id),
g AS (SELECT user_id, span, ids, means, n, 1 AS pos, CAST([] AS BIGINT[]) AS picked, CAST([] AS DOUBLE[]) AS kept FROM f UNION ALL
 SELECT user_id, span, ids, means, n, pos + 1, CASE WHEN len(picked) < 3 AND len(list_filter(picked, lambda p: abs(p - ids[pos]) < span)) = 0 THEN list_append(picked, ids[pos]) ELSE picked END,
  CASE WHEN len(picked) < 3 AND len(list_filter(picked, lambda p: abs(p - ids[pos]) < span)) = 0 THEN list_append(kept, means[pos]) ELSE kept END FROM g WHERE pos <= n),
s AS (SELECT user_id, CAST(unnest(range(1, len(picked) + 1)) AS BIGINT) AS rank, unnest(picked) AS idx, span, unnest(kept) / 100 AS mean FROM g WHERE pos = n + 1)"""


def _suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line(spark, sf_dir).withColumn("cut", F.col("event_type").isin("error", "click")).withColumn("value", F.round(F.col("value") * 100).cast("long"))
    return autoselect.suggestions(rows, ["user_id"], "idx", "value", TARGET, LEAST, "cut").withColumn("value", F.round(F.col("value") / 100, 6))


@_register.query(f"WITH RECURSIVE {_SUGGESTED} SELECT user_id, rank, idx, span, round(mean, 6) AS mean FROM s")
def suggested_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-05: up to three stretches a clip, shorter where every long one has a cut inside, and with cuts where all have."""
    return _suggested(spark, sf_dir).select("user_id", F.col("rank").cast("long").alias("rank"), "idx", F.col("span").cast("long").alias("span"), F.col("value").alias("mean"))


_CANDIDATES = f"""SELECT user_id, user_id % 3 AS ep, user_id % 4 AS ch, CASE WHEN user_id % 5 <> 0 THEN user_id % 7 END AS grp, span * {MOMENT} AS secs, round(mean, 6) AS score FROM s WHERE rank = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 190)"""
_DEDUPED = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ep, grp ORDER BY score DESC, user_id) AS best FROM k) WHERE grp IS NULL OR best = 1"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One suggestion a clip that no blocker rules out, one clip of each similar group."""
    u = F.col("user_id")
    ruled_out = table(spark, sf_dir, "events").where("event_type = 'error' and value > 190").select("user_id").distinct()
    best = _suggested(spark, sf_dir).where("rank = 1").join(ruled_out, "user_id", "left_anti")
    rows = best.select(
        (u % 3).alias("ep"), u, (u % 4).alias("ch"), F.when(u % 5 != 0, u % 7).alias("grp"), (F.col("span") * MOMENT).cast("long").alias("secs"), F.col("value").alias("score")
    )
    return autoselect.one_a_group(rows, ["ep"], "grp", "user_id", "score")


@_register.query(f"""
WITH RECURSIVE {_SUGGESTED}, k AS ({_CANDIDATES}), d AS ({_DEDUPED}), o AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY score DESC, user_id) AS r FROM d),
h AS (SELECT ep, list(user_id ORDER BY r) AS ids, list(secs ORDER BY r) AS cs, count(*) AS n FROM o GROUP BY ep), b AS (SELECT ep, ids, cs, n, 1 AS pos, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS picked FROM h UNION ALL
 SELECT ep, ids, cs, n, pos + 1, CASE WHEN used + cs[pos] <= {BUDGET} THEN used + cs[pos] ELSE used END, CASE WHEN used + cs[pos] <= {BUDGET} THEN list_append(picked, ids[pos]) ELSE picked END FROM b WHERE pos <= n)
SELECT ep, used, unnest(picked) AS user_id, CAST(unnest(range(1, len(picked) + 1)) AS BIGINT) AS place FROM b WHERE pos = n + 1
""")
def auto_select_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-07, FLT-14: candidates, one suggestion each, one clip a similar group, the best first within the budget."""
    found = selection.greedy_budget(_candidates(spark, sf_dir), ["ep"], [-F.col("score"), F.col("user_id")], "user_id", "secs", BUDGET)
    return found.select("ep", "used", "user_id", F.col("place").cast("long").alias("place"))


@_register.query(f"""
WITH RECURSIVE {_SUGGESTED}, k AS ({_CANDIDATES}), d AS ({_DEDUPED}), q AS (SELECT ep, ch, list(user_id ORDER BY score DESC, user_id) AS ids, list(secs ORDER BY score DESC, user_id) AS cs FROM d GROUP BY ep, ch),
h AS (SELECT ep, list(ids ORDER BY ch) AS ids, list(cs ORDER BY ch) AS cs, list(1 ORDER BY ch) AS pos, count(*) AS n FROM q GROUP BY ep),
turn AS (SELECT *, 1 AS c, FALSE AS going, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS picked, 1 AS step FROM h UNION ALL
 SELECT ep, ids, cs, CASE WHEN c <= n AND has THEN list_transform(pos, lambda p, i: CASE WHEN i = c THEN p + 1 ELSE p END) ELSE pos END, n, CASE WHEN c > n THEN 1 WHEN NOT has OR fits THEN c + 1 ELSE c END, c <= n AND (going OR fits),
  CASE WHEN fits THEN used + cs[c][pos[c]] ELSE used END, CASE WHEN fits THEN list_append(picked, ids[c][pos[c]]) ELSE picked END, step + 1
  FROM (SELECT *, coalesce(pos[c] <= len(ids[c]), FALSE) AS has, coalesce(pos[c] <= len(ids[c]) AND used + cs[c][pos[c]] <= {BUDGET}, FALSE) AS fits FROM turn) WHERE c <= n OR going),
z AS (SELECT ep, arg_max(picked, step) AS picked FROM turn GROUP BY ep) SELECT ep, unnest(picked) AS user_id, CAST(unnest(range(1, len(picked) + 1)) AS BIGINT) AS place FROM z
""")
def auto_select_in_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-07: the same candidates, chapters taking turns."""
    rows = _candidates(spark, sf_dir).withColumn("rank", F.col("ch"))
    return autoselect.take_turns(rows, "ep", "ch", "rank", "user_id", "score", "secs", BUDGET)


@_register.query(f"""
WITH RECURSIVE {_SUGGESTED}, k AS ({_CANDIDATES}), d AS ({_DEDUPED}), top AS (SELECT ep, user_id, score FROM d WHERE score >= 70), u AS (SELECT ep, user_id, score, FALSE AS fallback FROM top UNION ALL SELECT ep, user_id, score, TRUE FROM d WHERE ep NOT IN (SELECT ep FROM top)),
r AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY score DESC, user_id) AS place FROM u) SELECT ep, user_id, fallback, place FROM r WHERE place <= 5
""")
def auto_select_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-07: a wider scope where the first one has nothing, and a cap on the count."""
    rows = _candidates(spark, sf_dir).select("ep", "user_id", "score")
    both = autoselect.with_fallback(rows.where("score >= 70"), rows, ["ep"])
    return autoselect.numbered_best(both, ["ep"], [F.desc("score"), F.col("user_id")], 5).select("ep", "user_id", "fallback", F.col("place").cast("long").alias("place"))


@_register.query("""
WITH p AS (SELECT p_partkey, p_brand AS grp, p_size / 100.0 AS over_, (p_partkey % 7) / 40.0 AS under, p_retailprice / 20 AS focus, CASE WHEN p_partkey % 11 <> 0 THEN p_size * 100 END AS hold, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1 AS main, p_partkey % 9 = 0 AS rejected FROM part),
g AS (SELECT grp, max(CASE WHEN main AND rejected THEN 1 ELSE 0 END) = 1 AS open FROM p GROUP BY grp)
SELECT p_partkey, round(100.0 * focus / (focus + 60.0), 4) AS score, hold / 1000.0 AS secs FROM p JOIN g USING (grp) WHERE over_ <= 0.15 AND under <= 0.15 AND hold > 0 AND NOT rejected AND (main OR open)
""")
def photo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-08: sound photos that lead their group, or any of it where its leader was rejected; scored by focus."""
    k = F.col("p_partkey")
    photos = table(spark, sf_dir, "part").select(
        k, F.col("p_brand").alias("grp"), (F.col("p_size") / 100.0).alias("over_"), ((k % 7) / 40.0).alias("under"), (F.col("p_retailprice") / 20).alias("focus"), F.when(k % 11 != 0, F.col("p_size") * 100).alias("hold"), (k % 9 == 0).alias("rejected"), "p_retailprice",
    )
    lead = photos.groupBy("grp").agg(F.min_by(F.struct("p_partkey", "rejected"), F.struct((-F.col("p_retailprice")).alias("m"), "p_partkey")).alias("l"))
    rows = photos.join(lead, "grp").where("over_ <= 0.15 and under <= 0.15 and hold > 0 and not rejected and (l.p_partkey = p_partkey or l.rejected)")
    return rows.select("p_partkey", F.round(autoselect.photo_score(F.col("focus")), 4).alias("score"), (F.col("hold") / 1000.0).alias("secs"))


@_register.query("""
WITH w AS (SELECT event_id, (event_id % 11) / 10.0::DOUBLE AS sharp, (event_id % 21) / 20.0::DOUBLE AS motion, CASE WHEN event_id % 2 = 0 THEN (event_id % 3) / 2.0::DOUBLE END AS sound, CASE WHEN event_id % 4 <> 0 THEN (event_id % 5) / 4.0::DOUBLE END AS interest FROM events), t AS (SELECT 0.24 * 2 + 0.20 + 0.12 * 1.5 + 0.20 AS s)
SELECT event_id, round(((0.48 * sharp + 0.20 * motion + coalesce(0.18 * sound, 0) + coalesce(0.20 * interest, 0)) / s / ((0.48 + 0.20 + 0.18 + CASE WHEN interest IS NULL THEN 0 ELSE 0.20 END) / s))::DOUBLE, 6) AS score FROM w, t
""")
def reweighted_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-06, DOM-10: scores by biased weights that sum to 1 again; sound stays in the denominator where there is none."""
    i = F.col("event_id")
    parts = {"sharp": ((i % 11) / 10.0, 0.24), "motion": ((i % 21) / 20.0, 0.20), "sound": (F.when(i % 2 == 0, (i % 3) / 2.0), 0.12), "interest": (F.when(i % 4 != 0, (i % 5) / 4.0), 0.20)}
    return table(spark, sf_dir, "events").select("event_id", F.round(autoselect.reweighted(parts, {"sharp": 2.0, "sound": 1.5}, {"sound"}), 6).alias("score"))


@_register.query(f"""
WITH RECURSIVE {_SUGGESTED}, k AS ({_CANDIDATES}), d AS ({_DEDUPED}) SELECT d.ep, d.user_id, d.score, d.score AS now_score, (SELECT count(*) FROM k o WHERE o.ep = d.ep AND o.grp = d.grp AND o.user_id <> d.user_id) AS alternatives FROM d
""")
def selection_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-09: a run's rows with today's score beside the stored one, and how many alternatives of the group it left."""
    u = F.col("user_id")
    chosen = _candidates(spark, sf_dir)
    ruled_out = table(spark, sf_dir, "events").where("event_type = 'error' and value > 190").select("user_id").distinct()
    every = _suggested(spark, sf_dir).where("rank = 1").join(ruled_out, "user_id", "left_anti").select((u % 3).alias("_e"), u.alias("_u"), F.when(u % 5 != 0, u % 7).alias("_g"), F.col("value").alias("now_score"))
    sizes = every.where("_g is not null").groupBy("_e", "_g").agg(F.count("*").alias("n"))
    joined = chosen.join(every.select("_u", "now_score"), F.col("_u") == u, "left").join(sizes, (F.col("_e") == F.col("ep")) & (F.col("_g") == F.col("grp")), "left")
    return joined.select("ep", "user_id", "score", "now_score", F.coalesce(F.col("n") - 1, F.lit(0)).alias("alternatives"))
