"""Table maintenance as new tables: upserts, deltas, constraints. Nothing is changed in place; write the result where it belongs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str], guard: Column | None = None) -> DataFrame:
    """Source rows replace target rows of the same key or join them; where a guard over the target row is false, the target stays.

    source must have one row a key. Columns are the target's.
    """
    rest = [c for c in target.columns if c not in keys]
    old = target.select(*keys, F.struct(*rest).alias("_old"), *([guard.alias("_open")] if guard is not None else [F.lit(True).alias("_open")]))
    new = source.select(*keys, F.struct(*rest).alias("_new"))
    take = F.col("_new").isNotNull() & (F.col("_old").isNull() | F.coalesce("_open", F.lit(False)))
    return old.join(new, keys, "full").withColumn("_r", F.when(take, F.col("_new")).otherwise(F.col("_old"))).select(*keys, "_r.*").select(target.columns)


def counter_upsert(target: DataFrame, source: DataFrame, keys: list[str], counters: dict[str, float | None]) -> DataFrame:
    """Counters of equal keys add up, up to a cap where one is given. An aggregate of both sides; no join."""
    both = target.select(*keys, *counters).unionByName(source.select(*keys, *counters))
    total = lambda c, cap: F.sum(c) if cap is None else F.least(F.lit(cap), F.sum(c))
    return both.groupBy(*keys).agg(*[total(c, cap).alias(c) for c, cap in counters.items()])


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows whose key the target lacks; of a key's rows the least in order of the other columns, so that a run again inserts the same."""
    rest = [c for c in target.columns if c not in keys]
    first = source.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else source.select(*keys).distinct()
    fresh = first.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(target.columns))


def replace_by_key(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the source's keys are replaced."""
    return target.join(source.select(*keys).distinct(), keys, "left_anti").unionByName(source.select(target.columns))


def delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that were added, deleted or modified between two versions."""
    def side(df: DataFrame, name: str) -> DataFrame:
        rest = sorted(c for c in df.columns if c not in keys)
        return df.select(*keys, F.struct(*rest).alias(name))

    joined = side(before, "_a").join(side(after, "_b"), keys, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return joined.withColumn("change", change).where("change is not null").select(*keys, "change")


def violations_unique(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys that a (partial) unique constraint would refuse."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children whose key names no parent; a null key names none and is allowed."""
    return children.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def violations_check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each check; as in SQL, unknown passes."""
    broken = [F.sum((~F.coalesce(rule, F.lit(True))).cast("long")).alias(name) for name, rule in rules.items()]
    wide = df.agg(*broken)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(n, F.lit(0)).alias("broken")) for n in rules])).alias("x")).select("x.*")


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A digest of a table that does not depend on the order of rows: count and sums of row hashes."""
    h = F.xxhash64(*(columns or sorted(df.columns)))
    return df.agg(F.concat_ws("-", F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.pmod(h, F.lit(1_000_003))), F.lit(0))).alias("fingerprint"))
