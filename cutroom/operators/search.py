"""Text search over several sources, with excerpts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutroom.functions.scalars import contains_folded, excerpt
from cutroom.operators.windows import ranked

SHORTEST = 2


def search_text(sources: list[tuple], needle: str, most: int = 20, radius: int = 18, one_each: bool = False) -> DataFrame:
    """Rows of each source whose text contains the needle, whatever the case: the first most by id, in order of the sources.

    sources: (name, table, id column, text column), and where the reader sees another text than the one that is searched, that column too. With
    one_each, of several rows of one id the least text stands for it. A needle of fewer than two characters finds nothing.
    The limit is the feature: a report of hits for a reader.
    """
    out = None
    for place, (name, df, ident, text, *shown) in enumerate(sources):
        hits = df.where(contains_folded(F.col(text), needle) & F.lit(len(needle) >= SHORTEST)).select(F.col(ident).cast("long").alias("id"), F.col(shown[0] if shown else text).alias("text"))
        hits = hits.groupBy("id").agg(F.min("text").alias("text")) if one_each else hits
        hits = hits.orderBy("id", "text").limit(most)
        rows = hits.select(F.lit(place).alias("place"), F.lit(name).alias("source"), "id", excerpt(F.col("text"), needle, radius).alias("excerpt"))
        out = rows if out is None else out.unionByName(rows)
    return out


def first_hit_per_group(df: DataFrame, group: str, order: str, text: str, needle: str) -> DataFrame:
    """One row a group, its first hit; which row stands for a group is stated, not left to chance."""
    hits = df.where(contains_folded(F.col(text), needle))
    return hits.groupBy(group).agg(F.min_by(text, F.struct(order, text)).alias(text), F.count("*").alias("hits"))


def union_hits(parts: list[tuple[str, DataFrame]], ident: str, score: str) -> DataFrame:
    """Rows found by any part, with the best score and the parts that found them."""
    out = None
    for name, df in parts:
        rows = df.select(ident, F.col(score).cast("double").alias(score), F.lit(name).alias("part"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy(ident).agg(F.max(score).alias(score), F.array_join(F.array_sort(F.collect_set("part")), ",").alias("parts"))


def primary_pick(df: DataFrame, group: str, order: list) -> DataFrame:  # noqa: ANN001
    """Rows with their place in the group; the first is the one that stands for it. Groups may be of any size."""
    return ranked(df, [group], order, "place")
