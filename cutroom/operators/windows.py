"""Window analytics over ordered rows: sliding means, peaks, runs, budgets and global running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cutroom.session import ROWS, settle

#: Rows of a table, one for a key and a range that is asked for, that are sent to all tasks.
FEW = 10_000


def mean_ahead(keys: list[str], order: str, value: str, span: int, cut: str | None = None, blocked: str | None = None) -> Column:
    """Mean of exactly span rows from each row on, null where one is blocked or one after the first is a cut."""
    ahead = Window.partitionBy(*keys).orderBy(order)
    own, rest = ahead.rowsBetween(0, span - 1), ahead.rowsBetween(1, span - 1)
    ok = F.count(F.lit(1)).over(own) == span
    if blocked:
        ok = ok & ~F.coalesce(F.max(F.col(blocked)).over(own), F.lit(False))
    if cut and span > 1:
        ok = ok & ~F.coalesce(F.max(F.col(cut)).over(rest), F.lit(False))
    return F.when(ok, F.avg(value).over(own))


def sliding_mean(df: DataFrame, keys: list[str], order: str, value: str, span: int, cut: str | None = None, blocked: str | None = None) -> DataFrame:
    """The rows that mean_ahead() has a mean for."""
    return df.withColumn("mean", mean_ahead(keys, order, value, span, cut, blocked)).where("mean is not null")


def suppressed_top(df: DataFrame, keys: list[str], start: str, score: str, span: int | str, most: int = 3) -> DataFrame:
    """Up to most rows of each key, best first and earliest of equals, none within span (a number, or a column
    that is one for each key) of one picked before."""
    width = F.lit(span) if isinstance(span, int) else F.col(span)
    ranked = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("m"), F.col(start).cast("long").alias("s")))).alias("_c"), F.max(width).alias("_w"))
    none = F.array().cast("array<struct<m:double,s:bigint>>")

    def take(picked: Column, one: Column) -> Column:
        free = (F.size(picked) < most) & ~F.exists(picked, lambda p: F.abs(p["s"] - one["s"]) < F.col("_w"))
        return F.when(free, F.concat(picked, F.array(F.struct(one["m"].cast("double").alias("m"), one["s"].alias("s"))))).otherwise(picked)

    return ranked.withColumn("_p", F.aggregate("_c", none, take)).select(*keys, F.posexplode("_p").alias("rank", "_x")).select(
        *keys, (F.col("rank") + 1).alias("rank"), F.col("_x.s").alias(start), (-F.col("_x.m")).alias(score)
    )


def best_window(df: DataFrame, keys: list[str], order: str, value: str, span: int) -> DataFrame:
    """The span rows in a row with the least mean, the earliest of equals."""
    means = sliding_mean(df, keys, order, value, span)
    return means.groupBy(*keys).agg(F.min(F.struct("mean", order)).alias("_b")).select(*keys, F.col(f"_b.{order}").alias(order), F.col("_b.mean").alias("mean"))


def islands(df: DataFrame, keys: list[str], order: str, ok: Column) -> DataFrame:
    """Rows that are ok, numbered by the run they belong to."""
    line = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn("island", F.sum((~F.col("_ok")).cast("int")).over(line)).where("_ok").drop("_ok")


def smoothed_runs(df: DataFrame, keys: list[str], order: str, value: str, ok: Column, least: int = 3, reach: int = 1) -> DataFrame:
    """Centred moving mean inside runs of ok rows, cut at the runs' edges; shorter runs are left out."""
    runs = islands(df, keys, order, ok)
    near = Window.partitionBy(*keys, "island").orderBy(order).rowsBetween(-reach, reach)
    size = F.count("*").over(Window.partitionBy(*keys, "island"))
    return runs.withColumn("_n", size).withColumn("smooth", F.avg(value).over(near)).where(F.col("_n") >= least).drop("_n")


def densest(df: DataFrame, keys: list[str], value: str, width: int) -> DataFrame:
    """The most values of a key that lie within width, and where the first such stretch ends."""
    behind = Window.partitionBy(*keys).orderBy(value).rangeBetween(-width, 0)
    counted = df.withColumn("_n", F.count("*").over(behind))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("m"), F.col(value).alias("v"))).alias("_b")).select(
        *keys, (-F.col("_b.m")).alias("n"), F.col("_b.v").alias("last")
    )


def irregular_share(df: DataFrame, keys: list[str], t: Column, order: list[str], tolerance: float) -> DataFrame:
    """Share of a key's steps that differ from its mean step by more than the tolerance."""
    line = Window.partitionBy(*keys).orderBy(*order)
    steps = df.withColumn("_t", t).withColumn("_d", F.col("_t") - F.lag("_t").over(line)).where("_d is not null")
    mean = F.avg("_d").over(Window.partitionBy(*keys))
    off = (F.abs(F.col("_d") - F.col("_m")) > tolerance * F.col("_m")).cast("double")
    return steps.withColumn("_m", mean).groupBy(*keys).agg(F.avg(off).alias("irregular"), F.count("*").alias("steps"))


def peaks(df: DataFrame, keys: list[str], order: str, value: str, reach: int, floor: float) -> DataFrame:
    """Local maxima that reach mean plus deviation of their surroundings and a share of the key's greatest value."""
    line = Window.partitionBy(*keys).orderBy(order)
    near = line.rowsBetween(-reach, reach)
    v = F.col(value)
    local = (v > F.coalesce(F.lag(value).over(line), F.lit(float("-inf")))) & (v >= F.coalesce(F.lead(value).over(line), F.lit(float("-inf"))))
    tall = (v >= F.avg(value).over(near) + F.stddev_pop(value).over(near)) & (v >= floor * F.max(value).over(Window.partitionBy(*keys)))
    return df.withColumn("_peak", local & tall).where("_peak").drop("_peak")


def thinned(sorted_values: Column, least: Column) -> Column:
    """Values of a sorted array that are at least that far from the last one kept."""
    none = F.slice(sorted_values, 1, 0)
    return F.aggregate(sorted_values, none, lambda kept, v: F.when((F.size(kept) == 0) | (v - F.try_element_at(kept, F.lit(-1)) >= least), F.concat(kept, F.array(v))).otherwise(kept))


def running_sum(df: DataFrame, order: list[Column], value: str, name: str = "before") -> DataFrame:
    """Sum of value over all rows that come earlier in order, without gathering the rows in one task.

    The table is ranged by order; each range sums itself, and the ranges' sums, one row for each partition,
    are added in front. order must tell rows apart.
    """
    ranged = settle(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    totals = ranged.groupBy("_p").agg(F.sum(value).alias("_s"))
    ahead = totals.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_i", inside).join(F.broadcast(ahead), "_p").withColumn(name, F.col("_o") + F.col("_i")).drop("_p", "_o", "_i")


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Rows with their rank in their key, from 1; a key may hold any share of the rows.

    The table is ranged by key and order; a range numbers its own rows, and the counts of the ranges before it,
    one row for each range and key in it, are added. order must tell the rows of a key apart.
    """
    ranged = settle(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id())).withColumn("_key", _whole(keys))
    counts = ranged.groupBy("_p", "_key").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_p", "_key", before.alias("_before"))
    numbered = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_p", "_key").orderBy(*order)))
    return numbered.join(starts, ["_p", "_key"]).select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))


def _whole(keys: list[str]) -> Column:
    """A row's keys as one value, whose nulls are equal: what is grouped, numbered and joined by it is dealt out and sorted once."""
    return F.struct(*keys) if keys else F.lit(0)


def placed(df: DataFrame, keys: list[str], order: list[Column], size: str, place: str = "place", before: str = "before") -> DataFrame:
    """Rows with their rank in their key, from 1, and the sum of size over those before; a key may hold any share of the rows.

    Ranges number and sum their own rows; what lies in the ranges before, one row for each range and key in it,
    is added. order must tell the rows of a key apart.
    """
    ranged = settle(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id())).withColumn("_key", _whole(keys))
    parts = ranged.groupBy("_p", "_key").agg(F.count("*").alias("_n"), F.sum(size).alias("_s"))
    ahead = Window.partitionBy("_key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_p", "_key", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_c"), F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_p", "_key").orderBy(*order)
    own = ranged.withColumn("_own", F.row_number().over(inside)).withColumn("_sum", F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(starts, ["_p", "_key"]).select(*df.columns, (F.col("_own") + F.col("_c")).alias(place), (F.col("_sum") + F.col("_o")).alias(before))


def beside(rows: DataFrame, keys: list[str], columns: dict[str, str], step: int, place: str = "place") -> DataFrame:
    """placed() rows with columns of the row so many places on, under new names; null where there is none.

    A join on key and place, so neighbours meet wherever they lie.
    """
    other = rows.select(*keys, (F.col(place) - step).alias(place), *[F.col(old).alias(new) for old, new in columns.items()])
    return rows.join(other, [*keys, place], "left")


def chains(df: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    """Rows numbered by the chain they belong to: in a chain, each value is less than least after the one before.

    What a rule that goes from value to value does in one chain does not depend on any other, so chains can be
    dealt out where a key would be too much for a task.
    """
    rows = beside(placed(df.withColumn("_one", F.lit(1)), keys, [F.col(value)], "_one", "_at", "_n"), keys, {value: "_before"}, -1, "_at")
    rows = rows.withColumn("_break", F.coalesce(F.col(value) - F.col("_before") >= least, F.lit(True)).cast("long")).select(*df.columns, "_break")
    return placed(rows, keys, [F.col(value)], "_break", "_at", "_n").select(*df.columns, (F.col("_n") + F.col("_break")).alias("chain"))


def interpolated_percentiles(df: DataFrame, keys: list[str], value: str, order: list[Column], shares: dict[str, float]) -> DataFrame:
    """Percentiles of each key, interpolated between neighbours; a key may hold any share of the rows.

    The table is dealt to ranges of about ROWS rows by key and value; the ranges' counts tell which of them hold the places that
    are asked for, and only those are sorted. order splits equal values between ranges.
    """
    known = df.where(F.col(value).isNotNull())
    ranges = known.repartitionByRange(known.count() // ROWS + 1, *keys, value, *order)
    ranged = settle(ranges.select(*keys, value, F.spark_partition_id().alias("_p"))).withColumn("_key", _whole(keys))
    line = Window.partitionBy("_key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_p", "_key").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(line), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy("_key")))
    at = {name: (F.col("_all") - 1) * share for name, share in shares.items()}
    edges = [edge(x) for x in at.values() for edge in (F.floor, F.ceil)]
    asked = settle(starts.where(F.exists(F.array(*edges), lambda e: (e >= F.col("_before")) & (e < F.col("_before") + F.col("_n")))).select("_p", "_key", "_before", "_all"))
    held = ranged.join(F.broadcast(asked) if asked.count() <= FEW else asked, ["_p", "_key"])
    own = F.row_number().over(Window.partitionBy("_p", "_key").orderBy(value))
    numbered = held.withColumn("_r", own + F.col("_before") - 1)
    out = []
    for name, x in at.items():
        low, high = (F.max(F.when(F.col("_r") == edge(x), F.col(value))) for edge in (F.floor, F.ceil))
        out.append((low + (high - low) * F.max(x - F.floor(x))).alias(name))
    return numbered.groupBy(*keys).agg(*out)


def evicted(df: DataFrame, order: list[Column], size: str, limit: int) -> DataFrame:
    """Oldest rows that must go until the rest is within the limit."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return running_sum(df, order, size).where(F.lit(total) - F.col("before") > limit)


def retained(df: DataFrame, order: list[Column], size: str, limit: int) -> DataFrame:
    """The first rows whose sum is within the limit, one at least."""
    return running_sum(df, order, size).where((F.col("before") + F.col(size) <= limit) | (F.col("before") == 0))
