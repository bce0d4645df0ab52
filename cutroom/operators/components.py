"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutroom.session import settle

#: Edges that a task of a round takes, about: small graphs are not dealt to more tasks than they have work for.
EDGES = 100_000


def fold(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the labels of linked places in an array, in place; a label is the least place joined so far, and its own label."""
    while len(a):
        one, two = label[a], label[b]
        if (one == two).all():
            return
        low = np.minimum(one, two)
        np.minimum.at(label, one, low)
        np.minimum.at(label, two, low)
        while (label[label] != label).any():
            label[:] = label[label]


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every node that has an edge with the smallest node it can reach.

    edges: two columns of one orderable type; direction, loops, repeats and null ends are ignored.
    Returns (node, component). Every round is two group-and-join passes over at most as many edges
    as came in, so no neighbourhood is ever gathered in a task, and ends in O(log^2 n) rounds.
    """
    a, b = F.col(src), F.col(dst)
    current = settle(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    seen = _fingerprint(current)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        tasks = seen[0] // EDGES + 1
        current = current.coalesce(tasks)
        # large star: each node hands its larger neighbours to the smallest of its neighbourhood
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
        # small star: each node hands its smaller neighbours to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        current = settle(moved.unionByName(low.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: every edge leads from a node to the least of its component
    return (
        current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")))
        .distinct()
    )
