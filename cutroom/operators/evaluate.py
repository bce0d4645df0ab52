"""Evaluation: matching, precision and recall, ranking and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutroom.operators.windows import ranked


def ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def matched_boundaries(df: DataFrame, keys: list[str], truth: str, found: str, tolerance: int) -> DataFrame:
    """Greedy one-to-one matches of two sorted arrays of boundaries within the tolerance, each row for itself.

    Truth is taken in order; each takes the nearest found boundary that is still free, of equals the
    earlier. Returns keys, tp, fp, fn.
    """
    free = F.sort_array(F.coalesce(F.col(found), F.array().cast("array<bigint>"))).cast("array<bigint>")

    def step(acc: Column, t: Column) -> Column:
        best = F.array_min(F.transform(F.filter(acc["free"], lambda f: F.abs(f - t) <= tolerance), lambda f: F.struct(F.abs(f - t).alias("d"), f.alias("f"))))
        hit = best.isNotNull()
        at = F.array_position(acc["free"], best["f"]).cast("int")
        left = F.concat(F.slice(acc["free"], F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(acc["free"], at + 1, F.size(acc["free"])))
        return F.struct(F.when(hit, left).otherwise(acc["free"]).alias("free"), (acc["tp"] + hit.cast("int")).alias("tp"))

    start = F.struct(free.alias("free"), F.lit(0).alias("tp"))
    wanted = F.sort_array(F.coalesce(F.col(truth), F.array().cast("array<bigint>"))).cast("array<bigint>")
    tp = F.aggregate(wanted, start, step, lambda a: a["tp"])
    return df.withColumn("tp", tp).select(*keys, "tp", (F.size(free) - F.col("tp")).alias("fp"), (F.size(wanted) - F.col("tp")).alias("fn"))


def pair_counts(df: DataFrame, truth: str, found: str) -> DataFrame:
    """Pairs of rows in one found group, in one true group, and in both, from group sizes alone; no pair is made."""
    pairs = lambda n: n * (n - 1) / 2

    def of(*keys: str) -> DataFrame:
        rows = df
        for k in keys:
            rows = rows.where(F.col(k).isNotNull())
        return rows.groupBy(*keys).count().agg(F.coalesce(F.sum(pairs(F.col("count"))), F.lit(0)).cast("long").alias("n"))

    name = lambda rows, n: rows.select(F.lit(1).alias("_k"), F.col("n").alias(n))
    out = name(of(found), "found_pairs").join(name(of(truth), "true_pairs"), "_k").join(name(of(truth, found), "right_pairs"), "_k").drop("_k")
    return out.withColumn("precision", ratio(F.col("right_pairs"), F.col("found_pairs"), 1.0)).withColumn("recall", ratio(F.col("right_pairs"), F.col("true_pairs"), 1.0))


def ranking(results: DataFrame, relevant: DataFrame, query: str, item: str, score: str, k: int = 5) -> DataFrame:
    """Hit rate in the first k and mean reciprocal rank over queries; ranks by score, then item, whatever a query's results."""
    found = ranked(results, [query], [F.desc(score), F.col(item)]).join(relevant.select(query, item).distinct(), [query, item], "left_semi")
    first = found.groupBy(query).agg(F.min("rank").alias("first"))
    every = relevant.select(query).distinct().join(first, query, "left")
    return every.agg(
        F.count("*").alias("queries"), F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias("hit_at_k"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr")
    )


def any_label(expected: Column, actual: Column) -> Column:
    """Whether actual is one of a|b|c; null where * says not to judge."""
    return F.when(expected != "*", F.array_contains(F.split(expected, r"\|"), actual))


def gates(metrics: DataFrame, policy: DataFrame) -> DataFrame:
    """Every gate of a policy (metric, op, threshold) against its metric (metric, actual); a missing metric fails."""
    joined = policy.join(metrics, "metric", "left")
    good = F.when(F.col("op") == ">=", F.col("actual") >= F.col("threshold")).when(F.col("op") == "<=", F.col("actual") <= F.col("threshold")).otherwise(F.col("actual") == F.col("threshold"))
    return joined.withColumn("passed", F.coalesce(good, F.lit(False)))


def regressions(before: DataFrame, after: DataFrame, epsilon: float) -> DataFrame:
    """Metrics (metric, value, higher_is_better) that got worse by more than epsilon."""
    joined = before.select("metric", F.col("value").alias("old"), "higher_is_better").join(after.select("metric", F.col("value").alias("new")), "metric", "full")
    loss = F.when(F.col("higher_is_better"), F.col("old") - F.col("new")).otherwise(F.col("new") - F.col("old"))
    return joined.withColumn("verdict", F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "new").when(loss > epsilon, "worse").when(loss < -epsilon, "better").otherwise("same"))
