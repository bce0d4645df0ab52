"""Latest rows, modes, priorities: what one group is represented by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest in order. An aggregate, so a hot key is reduced before it moves."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The columns kept of each key's row that is least in order (a struct of sortable columns)."""
    best = F.min_by(F.struct(*keep), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def mode_per_parent(df: DataFrame, parent: str, value: str, ignore: str | None = None) -> DataFrame:
    """The most frequent value of each parent, of equals the smallest; a label to ignore never counts."""
    rows = df.where(F.col(value).isNotNull())
    if ignore is not None:
        rows = rows.where(F.col(value) != ignore)
    counted = rows.groupBy(parent, value).agg(F.count("*").alias("n"))
    return counted.groupBy(parent).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b")).select(
        parent, F.col("b.v").alias(value), (-F.col("b.m")).alias("n")
    )


def effective(manual: Column, derived: Column) -> Column:
    """A manual decision beats a derived one; an explicit 0 clears it, no row leaves it."""
    return F.when(manual.isNull(), derived).otherwise(manual != 0)


def pivot_labels(df: DataFrame, key: str, dimension: str, label: str, names: list[str]) -> DataFrame:
    """One column a dimension in one pass, rather than a self-join for each."""
    pick = lambda n: F.max(F.when(F.col(dimension) == n, F.col(label))).alias(n)
    return df.where(F.col(dimension).isin(names)).groupBy(key).agg(*[pick(n) for n in names])


def ordered_text(value: str, order: list[str], separator: str = ",") -> Column:
    """An aggregate that joins values in order."""
    held = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return F.array_join(F.transform(held, lambda s: s["_v"]), separator)
