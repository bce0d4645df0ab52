"""Incremental work on Structured Streaming: file streams, deduplicated queues, sessions and windows; tables.py has what batches change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def watch(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """Files as they come in under a folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(folder)


def enqueue_once(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state is dropped after it."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, key: str, at: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions by gap with their number of rows, given out once the watermark has passed them."""
    grouped = stream.withWatermark(at, late).groupBy(key, F.session_window(at, gap))
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def tumbling(stream: DataFrame, key: str, at: str, width: str, value: str, late: str = "10 seconds") -> DataFrame:
    grouped = stream.withWatermark(at, late).groupBy(key, F.window(at, width))
    return grouped.agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "mean", "n")


def run_available(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Work off what is there in batches, then stop; a restart goes on where the checkpoint says."""
    query = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ready(needs: DataFrame, states: DataFrame, job: str, need: str, state: str) -> DataFrame:
    """Waiting jobs all of whose needs are done: what completion sets off. needs: (job, need), states: (job, state)."""
    done = states.where(F.col(state) == "done").select(F.col(job).alias(need), F.lit(True).alias("_done"))
    open_ = needs.join(done, need, "left").groupBy(job).agg(F.count(F.when(F.col("_done").isNull(), 1)).alias("_open"))
    waiting = states.where(F.col(state) == "waiting").select(job)
    return waiting.join(open_, job, "left").where(F.coalesce("_open", F.lit(0)) == 0).select(job)


def drained(stream: DataFrame, batch: str, at: str, late: str = "1 hour") -> DataFrame:
    """The end of each import batch, told once: batches whose rows stay out for the watermark, with their counts."""
    grouped = stream.withWatermark(at, late).groupBy(batch, F.session_window(at, late))
    return grouped.agg(F.count("*").alias("rows"), F.max(at).alias("last")).select(batch, "rows", "last")


def job_states(attempts: DataFrame, job: str, at: str, ok: str, most: int = 3) -> DataFrame:
    """State of every job from its log of attempts: done, blocked after most failures, or retry with its back-off.

    An aggregate over an append-only log, so it holds for a batch and, in complete mode, for a stream.
    """
    done, failed = F.max(F.col(ok).cast("int")) == 1, F.count_if(~F.col(ok))
    out = attempts.groupBy(job).agg(done.alias("done"), failed.alias("failed"), F.max(at).alias("last"))
    state = F.when(F.col("done"), "done").when(F.col("failed") >= most, "blocked").otherwise("retry")
    wait = F.when(state == "retry", F.pow(F.lit(2), F.col("failed") - 1).cast("int"))
    return out.select(job, state.alias("state"), "failed", "last", wait.alias("wait_seconds"))


def stale(results: DataFrame, inputs: DataFrame, key: str, version: str, hash_column: str, current: int) -> DataFrame:
    """Results of an older pipeline or of other inputs than there are now: what has to be worked again."""
    joined = inputs.select(key, F.col(hash_column).alias("_now")).join(results.select(key, version, F.col(hash_column).alias("_was")), key, "left")
    return joined.where(F.col("_was").isNull() | (F.col("_was") != F.col("_now")) | (F.col(version) != current)).select(key)
