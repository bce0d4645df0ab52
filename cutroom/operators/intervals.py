"""Interval algebra: coverage, overlap, nearest and bracketing rows, cuts to segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merged(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Maximal intervals of each key: those that touch or overlap are one."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.coalesce(F.col(start) > reach, F.lit(True)).cast("int"))
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("island", island).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def coverage(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Length of the union of each key's intervals, those that end before they start left out."""
    return merged(df.where(F.col(end) > F.col(start)), keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], bin_width: int, left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs of rows of one key whose half-open integer intervals overlap.

    Both sides are cut into bins of bin_width, so the join is on equal keys and bins, and a pair is
    kept in the bin in which it overlaps first. Columns of the two sides must differ, keys aside.
    """
    (ls, le), (rs, re) = left_span, right_span

    def binned(df: DataFrame, s: str, e: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col(s) / bin_width), F.floor((F.col(e) - 1) / bin_width))
        return df.where(F.col(e) > F.col(s)).withColumn("_bin", F.explode(bins))

    joined = binned(left, ls, le).join(binned(right, rs, re), [*keys, "_bin"])
    first = F.floor(F.greatest(ls, rs) / bin_width)
    return joined.where((F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)) & (F.col("_bin") == first)).drop("_bin")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, payload: list[str]) -> DataFrame:
    """For each left row the right row of its key nearest in time, the earlier of equals; none leaves nulls.

    Both sides are laid on one time line, so nothing is joined: the neighbours come from windows.
    """
    both = left.select(*keys, F.col(left_t).alias("_t"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(F.col(right_t).alias("_at"), *payload).alias("s")).schema["s"].dataType).alias("_r"))
    other = right.select(*keys, F.col(right_t).alias("_t"), F.lit(None).cast(both.schema["_l"].dataType).alias("_l"), F.struct(F.col(right_t).alias("_at"), *payload).alias("_r"))
    line = both.unionByName(other)
    back = Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("_t").rangeBetween(0, Window.unboundedFollowing)
    near = line.withColumn("_b", F.last("_r", ignorenulls=True).over(back)).withColumn("_a", F.first("_r", ignorenulls=True).over(ahead)).where("_l is not null")
    before, after = F.col("_t") - F.col("_b._at"), F.col("_a._at") - F.col("_t")
    pick = F.when(F.col("_a").isNull() | (before <= after), F.col("_b")).otherwise(F.col("_a"))
    pick = F.when(F.col("_b").isNull(), F.col("_a")).otherwise(pick)
    return near.withColumn("_p", pick).select("_l.*", F.col("_p._at").alias("matched_t"), *[F.col(f"_p.{c}").alias(f"matched_{c}") for c in payload])


def interpolated(queries: DataFrame, points: DataFrame, keys: list[str], t: str, x: str, y: str) -> DataFrame:
    """y at each query's t on the broken line of a key's points (x, y), level beyond its ends."""
    q = queries.select(*keys, F.col(t).cast("double").alias("_t"), F.lit(None).cast("struct<x:double,y:double>").alias("_p"), F.struct(*queries.columns).alias("_q"))
    p = points.select(*keys, F.col(x).cast("double").alias("_t"), F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).alias("_p"), F.lit(None).cast(q.schema["_q"].dataType).alias("_q"))
    back = Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("_t").rangeBetween(0, Window.unboundedFollowing)
    line = q.unionByName(p).withColumn("_b", F.last("_p", True).over(back)).withColumn("_a", F.first("_p", True).over(ahead)).where("_q is not null")
    share = (F.col("_t") - F.col("_b.x")) / (F.col("_a.x") - F.col("_b.x"))
    value = F.when(F.col("_b").isNull(), F.col("_a.y")).when(F.col("_a").isNull() | (F.col("_a.x") == F.col("_b.x")), F.col("_b.y"))
    return line.withColumn("_y", value.otherwise(F.col("_b.y") + share * (F.col("_a.y") - F.col("_b.y")))).select("_q.*", F.col("_y").alias("interpolated"))


def segments_from_cuts(cuts: DataFrame, lengths: DataFrame, keys: list[str], cut: str, length: str) -> DataFrame:
    """[0, c1), [c1, c2) ... [cn, length) of each key; cuts at or beyond the ends are none."""
    inner = cuts.join(lengths, keys).where((F.col(cut) > 0) & (F.col(cut) < F.col(length))).select(*keys, F.col(cut).alias("start"), length).distinct()
    starts = inner.unionByName(lengths.where(F.col(length) > 0).select(*keys, F.lit(0).cast(dict(inner.dtypes)["start"]).alias("start"), length))
    order = Window.partitionBy(*keys).orderBy("start")
    return starts.select(*keys, "start", F.coalesce(F.lead("start").over(order), F.col(length)).alias("end"), (F.row_number().over(order) - 1).alias("scene_index"))


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two intervals; 0 where they don't meet."""
    both = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))
    union = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(union > 0, both / F.when(both > 0, union).otherwise((a1 - a0) + (b1 - b0))).otherwise(F.lit(0.0))


def grid(lengths: DataFrame, length: str, step: int) -> DataFrame:
    """A row at every step of a length from 0, and one at its end."""
    marks = F.array_union(F.sequence(F.lit(0).cast("long"), F.col(length).cast("long"), F.lit(step).cast("long")), F.array(F.col(length).cast("long")))
    return lengths.withColumn("mark", F.explode(marks))
