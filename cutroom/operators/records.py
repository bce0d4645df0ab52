"""Rules of records: segments, cards, overrides, trees, batches, caches, reservations and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clamped_segments(df: DataFrame, start: str, stop: str, length: str) -> DataFrame:
    """Asked-for segments cut to their clips; those that come to less than a tick are left out."""
    inside = df.withColumn(start, F.greatest(F.col(start), F.lit(0))).withColumn(stop, F.least(F.col(stop), F.col(length)))
    return inside.where(F.col(stop) - F.col(start) >= 1)


def all_or_nothing(new: DataFrame, key: str, valid: Column) -> DataFrame:
    """The rows of those batches that have no invalid row."""
    bad = new.where(~F.coalesce(valid, F.lit(False))).select(F.col(key).alias("_bad")).distinct()
    return new.join(bad, F.col(key) == F.col("_bad"), "left_anti")


def cascaded(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """What is left of a table once the rows of some ids are gone."""
    return df.join(ids.select(F.col(key).alias("_gone")).distinct(), F.col(key) == F.col("_gone"), "left_anti")


def overridden(suggested: Column, override: Column, cleared: Column) -> Column:
    """A suggestion under its override: cleared is none, and an override never makes a suggestion."""
    return F.when(F.coalesce(cleared, F.lit(False)), None).when(suggested.isNotNull(), F.coalesce(override, suggested))


def verified(fields: Column, names: list[str]) -> Column:
    """Whether a card's map of states has every named field verified."""
    state = lambda n: F.coalesce(F.try_element_at(fields, F.lit(n)) == "verified", F.lit(False))
    out = F.lit(True)
    for name in names:
        out = out & state(name)
    return out


def overview(beats: DataFrame, selection: DataFrame, episode: str, chapter: str, place: str, item: str) -> DataFrame:
    """Each episode's chapters with their items in order, for those whose items are just the selected ones."""
    used = beats.select(episode, item).distinct().withColumn("_u", F.lit(1))
    wanted = selection.select(episode, item).distinct().withColumn("_w", F.lit(1))
    differs = used.join(wanted, [episode, item], "full_outer").where("_u is null or _w is null").select(F.col(episode).alias("_e")).distinct()
    kept = beats.join(differs, F.col(episode) == F.col("_e"), "left_anti")
    chapters = kept.groupBy(episode, chapter).agg(F.sort_array(F.collect_list(F.struct(place, item))).alias("_b"))
    return chapters.groupBy(episode).agg(F.sort_array(F.collect_list(F.struct(chapter, F.transform("_b", lambda b: b[item]).alias("items")))).alias("chapters"))


def reserved(requests: DataFrame, keys: list[str], order: list[Column], cost: str, limit: int) -> DataFrame:
    """Requests granted in order while all granted before and the request fit the limit; a refused one costs nothing."""
    from cutroom.operators.selection import greedy_budget

    return greedy_budget(requests, keys, order, "request", cost, limit)


def mapping_errors(points: DataFrame, mapped: DataFrame, keys: list[str], at: str, truth: str, got: str) -> DataFrame:
    """Greatest and mean absolute error of a time map's checkpoints, and how many it lacks."""
    joined = points.join(mapped, [*keys, at], "left").withColumn("_e", F.abs(F.col(got) - F.col(truth)))
    return joined.groupBy(*keys).agg(F.max("_e").alias("greatest"), F.avg("_e").alias("mean"), F.count(F.when(F.col(got).isNull(), 1)).alias("missing"))


def undoable(edits: DataFrame, thing: str, order: str, batch: str) -> DataFrame:
    """Batches that may be undone: nothing that they touch was edited later by another. batch, undoable."""
    later = F.max(order).over(Window.partitionBy(thing))
    own = edits.groupBy(thing, batch).agg(F.max(order).alias("_own"))
    last = edits.select(thing, later.alias("_last")).distinct()
    return own.join(last, thing).groupBy(batch).agg(F.min(F.col("_own") == F.col("_last")).alias("undoable"))


def stale(caches: DataFrame, used: str, size: str, keys: list[str], now: Column, age: int) -> DataFrame:
    """What a cache holds and what of it is older than an age, by key."""
    old = (now - F.col(used)) > age
    return caches.groupBy(*keys).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.count(F.when(old, 1)).alias("stale_files"), F.coalesce(F.sum(F.when(old, F.col(size))), F.lit(0)).alias("stale_bytes"))
