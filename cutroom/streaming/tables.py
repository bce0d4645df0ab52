"""Keyed tables that batches change by what is new: deltas in buckets of keys, folded into a base now and then.

A table is a folder. A batch appends its rows under its own number, cut into buckets by a hash of the key; a reader takes, of each
key, the rows of the last batch that had it. Every few batches the deltas are folded into one of two bases that alternate, and
a line in the manifest says up to which batch. Slots of old deltas are written over, so the disk holds about two bases and two
rounds of deltas. Whatever step fails, a batch that is run again writes the same rows over the same slot, and
readers see the state before or after it.

    sink = KeyedTable(path, ["clip"]).upserts(["at"])
    run_available(stream, checkpoint, sink)
    KeyedTable(path, ["clip"]).rows(spark)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutroom.operators.latest import latest_per_key
from cutroom.session import settle

#: Buckets of a table's keys, and batches from one fold to the next.
BUCKETS, EVERY = 64, 8


class Changed(Exception):
    """The inputs of a result are not the ones it was made of."""


def version_of(rows: DataFrame) -> str:
    """A digest of rows whatever their order: equal for equal tables."""
    h = F.xxhash64(*sorted(rows.columns))
    return str(tuple(rows.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1_000_003)))).first()))


class KeyedTable:
    def __init__(self, path: str, keys: list[str], buckets: int = BUCKETS, every: int = EVERY):
        self.path, self.keys, self.buckets, self.every = path, keys, buckets, every

    # Reading

    def _read(self, spark: SparkSession, part: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.path}/{part}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
                return None
            raise

    def _manifest(self, spark: SparkSession) -> tuple[int, int]:
        """(last batch folded, slot of the base); -1 before the first fold."""
        lines = [row for k in (0, 1) if (part := self._read(spark, f"manifest/{k}")) is not None for row in part.collect()]
        return max(((r.upto, r.slot) for r in lines), default=(-1, 1))

    def _versions(self, spark: SparkSession, upto: int | None = None, buckets: list[int] | None = None, columns: list[str] | None = None) -> DataFrame | None:
        """Base and deltas after it, up to a batch, of some buckets: _bucket, _batch, _gone, keys, columns."""
        folded, slot = self._manifest(spark)
        parts = [self._read(spark, f"base/{slot}")] if folded >= 0 else []
        deltas = self._read(spark, "deltas")
        if deltas is not None:
            parts.append(deltas.where(F.col("_batch") > folded).drop("_slot"))
        held = None
        for part in parts:
            if part is None:
                continue
            if upto is not None:
                part = part.where(F.col("_batch") <= upto)
            if buckets is not None:
                part = part.where(F.col("_bucket").isin(buckets))
            if columns is not None:
                part = part.select("_bucket", "_batch", "_gone", *self.keys, *columns)
            held = part if held is None else held.unionByName(part)
        return held

    def _last(self, versions: DataFrame) -> DataFrame:
        newest = versions.groupBy("_bucket", *self.keys).agg(F.max("_batch").alias("_batch"))
        match = (F.col("v._bucket") == F.col("n._bucket")) & (F.col("v._batch") == F.col("n._batch"))
        for k in self.keys:
            match = match & F.col(f"v.{k}").eqNullSafe(F.col(f"n.{k}"))
        return versions.alias("v").join(newest.alias("n"), match, "left_semi")

    def rows(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame | None:
        """The table as it is now, or None before the first batch."""
        versions = self._versions(spark, buckets=buckets)
        return None if versions is None else self._last(versions).where("not _gone").drop("_bucket", "_batch", "_gone")

    # Writing

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, number: int, replaced: DataFrame | None = None) -> None:
        """Batch number: rows stand in place of all rows of their keys, and of those in replaced, which may have none any more."""
        delta = rows.withColumn("_gone", F.lit(False))
        if replaced is not None:
            empty = replaced.select(*self.keys).distinct().join(rows.select(*self.keys).distinct(), self.keys, "left_anti").withColumn("_gone", F.lit(True))
            delta = delta.unionByName(empty, allowMissingColumns=True)
        slot = number % (2 * self.every)
        delta = delta.withColumn("_bucket", self.bucket()).withColumn("_batch", F.lit(number).cast("long"))
        delta.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/deltas/_slot={slot}")
        if number % self.every == self.every - 1:
            self.fold(rows.sparkSession, number)

    def fold(self, spark: SparkSession, upto: int) -> None:
        """Fold the deltas up to a batch into the other base, and then say so; nothing where that is done already."""
        folded, slot = self._manifest(spark)
        versions = self._versions(spark, upto)
        if folded >= upto or versions is None:
            return
        whole = self._last(versions).where("not _gone")
        whole.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/base/{1 - slot}")
        line = spark.createDataFrame([(upto, 1 - slot)], "upto long, slot long")
        line.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{1 - slot}")

    # Sinks for foreachBatch

    def upserts(self, order: list[str]) -> Callable[[DataFrame, int], None]:
        """Of a batch's rows of one key the greatest in order stands in place of the one before. Costs the batch, not the table."""
        def each(batch: DataFrame, number: int) -> None:
            self.write(latest_per_key(batch, self.keys, order).select(batch.columns), number)

        return each

    def firsts(self) -> Callable[[DataFrame, int], None]:
        """Rows whose key the table does not hold yet, of those of one key in a batch the least: an outbox's receiver.

        A batch is held against the keys alone, and only those of its own buckets.
        """
        def each(batch: DataFrame, number: int) -> None:
            spark = batch.sparkSession
            rest = [c for c in batch.columns if c not in self.keys]
            new = batch.groupBy(*self.keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*self.keys, "_r.*") if rest else batch.distinct()
            new = settle(new.select(batch.columns))
            touched = [r[0] for r in new.select(self.bucket()).distinct().collect()]  # as many as there are buckets
            known = self._versions(spark, number - 1, touched, [])
            if known is not None:
                # settled, as the slot that is written over is among the files that are read
                new = settle(new.join(known.select(*self.keys).distinct(), self.keys, "left_anti"))
            self.write(new.select(batch.columns), number)

        return each

    def replace(self, number: int, read: Callable[[], DataFrame], work: Callable[[DataFrame], DataFrame]) -> None:
        """Put work(read()) in place of all rows of the keys that read() has, unless read() gives something else when that is done.

        The inputs are read once for the work and again before the batch becomes visible; on a difference
        nothing is written and Changed is raised. What changes between that reading and the write of a delta is left to the
        store, as Parquet has no transactions.
        """
        seen = settle(read())
        before = version_of(seen)
        made = settle(work(seen))
        if version_of(read()) != before:
            raise Changed(f"inputs of batch {number} changed while it was worked on")
        self.write(made, number, seen)


def unchanged(results: DataFrame, inputs: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Results whose inputs still have the version (a column of both) that they were made of; others, and those without inputs, are dropped."""
    now = inputs.select(*keys, F.col(version).alias("_now")).distinct()
    return results.join(now, keys).where(F.col(version).eqNullSafe(F.col("_now"))).select(results.columns)


def append_only(rows: DataFrame, path: str, keys: list[str], number: int) -> None:
    """Append a batch to a log that is never changed: a key that the log has with other values is refused, one it has with equal values is left out.

    A batch run again adds nothing. Raises ValueError and writes nothing where a row would change another.
    """
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c not in keys]
    new = settle(rows.distinct())
    try:
        held = spark.read.parquet(path).where(F.col("_batch") != number)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        held = None
    twice = new.groupBy(*keys).count().where("count > 1")
    if held is not None:
        old = held.select(*keys, F.struct(*rest).alias("_old"))
        met = new.withColumn("_new", F.struct(*rest)).join(old, keys, "left")
        twice = twice.select(*keys).unionByName(met.where(F.col("_old").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_new"))).select(*keys))
        new = met.where("_old is null").select(rows.columns)
    refused = twice.select(*keys).first()
    if refused is not None:
        raise ValueError(f"the log is not to be changed: {refused.asDict()}")
    new.write.mode("overwrite").parquet(f"{path}/_batch={number}")
