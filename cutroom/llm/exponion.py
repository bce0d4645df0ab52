"""Clusters around centroids by exponion search, in whole numbers.

Every vector keeps an upper bound of the distance to its centroid and a lower bound of that to any other. Where
the bounds leave a doubt, only centroids in a ball around its current one are looked at: each centroid has the others in order of
distance, and the ball is a prefix of that list. Distances are compared as exact integers; bounds only ever leave out
centroids that are farther, so ties are always seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutroom.session import settle, ship

#: Steps a unit of a component.
STEPS = 64
#: Rounds after which assignments and bounds are written; up to then tasks replay them from the vectors, which needs no disk.
REPLAYED = 8
#: Vectors that are compared at once.
BLOCK = 2048
#: Room for rounding in square roots and sums of them.
ROUNDING = 1e-9


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    step = x - y
    return np.einsum("ij,ij->i", step, step)


class Centroids:
    """The centroids of a round, each with the others in order of distance, and how far they moved since the last round."""

    def __init__(self, points: np.ndarray, before: np.ndarray | None = None):
        self.points = points
        k = len(points)
        gaps = np.sqrt(np.array([_apart(points, points[[i]]) for i in range(k)], float).reshape(k, k))
        np.fill_diagonal(gaps, -1.0)  # first in its own list, before any that equals it
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)
        self.near = self.gaps[:, 1] if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(_apart(points, before).astype(float))
        self.moved = moved * (1 + ROUNDING)
        ranked = np.sort(self.moved)[::-1]
        most, second = (ranked[0], ranked[1] if k > 1 else 0.0) if k else (0.0, 0.0)
        self.others_moved = np.where(self.moved == most, second if np.sum(self.moved == most) == 1 else most, most)

    def assign(self, x: np.ndarray, home: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Nearest centroid of each row, the smaller number at ties; home and the bounds are changed in place."""
        upper += self.moved[home]
        lower -= self.others_moved[home]
        doubt = np.flatnonzero(upper >= np.maximum(lower, self.near[home] / 2 * (1 - ROUNDING)))
        if not len(doubt):
            return
        best = _apart(x[doubt], self.points[home[doubt]])
        upper[doubt] = np.sqrt(best.astype(float)) * (1 + ROUNDING)
        still = upper[doubt] >= np.maximum(lower[doubt], self.near[home[doubt]] / 2 * (1 - ROUNDING))
        doubt, best = doubt[still], best[still]
        centre = home[doubt]
        # the nearest two lie in this ball: that next to the centre is at most upper + near away
        reach = (2 * upper[doubt] + self.near[centre]) * (1 + ROUNDING)
        inside = (self.gaps[centre] <= reach[:, None]).sum(axis=1)
        found, second = centre.copy(), np.full(len(doubt), np.iinfo(np.int64).max)
        for place in range(1, inside.max(initial=0)):
            rows = np.flatnonzero(inside > place)
            other = self.order[centre[rows], place]
            d = _apart(x[doubt[rows]], self.points[other])
            nearer = (d < best[rows]) | ((d == best[rows]) & (other < found[rows]))
            second[rows] = np.where(nearer, best[rows], np.minimum(second[rows], d))
            best[rows] = np.where(nearer, d, best[rows])
            found[rows] = np.where(nearer, other, found[rows])
        home[doubt] = found
        upper[doubt] = np.sqrt(best.astype(float)) * (1 + ROUNDING)
        lower[doubt] = np.sqrt(second.astype(float)) * (1 - ROUNDING)


def _replay(batches: Iterator[pa.RecordBatch], history: list[Centroids]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, vectors, home, upper, lower) after the rounds of the history."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(at, BLOCK)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
            limit = int((2**61 // max(1, x.shape[1])) ** 0.5)
            if x.max(initial=0) > limit or x.min(initial=0) < -limit:
                raise ValueError(f"squared distances of components beyond {limit} steps do not fit into 64 bits")
            home, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("home", "upper", "lower"))
            for centroids in history:
                centroids.assign(x, home, upper, lower)
            yield batch, x, home, upper, lower


def _sums(history):  # noqa: ANN001, ANN202
    """Sums of each component and the rows of each cluster, over what a task has read: at most clusters x components rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = history.value
        total, rows = np.zeros(rounds[-1].points.shape, np.int64), np.zeros(len(rounds[-1].points), np.int64)
        for _, x, home, *_ in _replay(batches, rounds):
            rows += np.bincount(home, minlength=len(rows))
            np.add.at(total, home, x)
        cluster, place = np.nonzero(rows[:, None] * np.ones(total.shape[1], np.int64))
        yield pa.RecordBatch.from_pydict({"cluster": cluster, "place": place, "total": total[cluster, place], "rows": rows[cluster]})

    return run


def _state(history):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, home, upper, lower in _replay(batches, history.value):
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), *map(pa.array, (home, upper, lower))], ["id", "x", "home", "upper", "lower"])

    return run


def _assigned(history):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = history.value[-1].points
        for batch, x, home, *_ in _replay(batches, history.value):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(home.astype(np.int32)), pa.array(_apart(x, points[home]))], ["id", "cluster", "distance"])

    return run


def whole_vectors(vectors: DataFrame, dim: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x) of the vectors with that many components, all of them finite: each component as floor(STEPS * component)."""
    e = vectors[vector_col]
    fit = F.coalesce((F.size(e) == dim) & F.forall(e, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False))), F.lit(False))
    rows = vectors.select(vectors[id_col].alias("id"), F.when(fit, e).alias("e")).where(F.col("e").isNotNull())
    return rows.select("id", F.transform("e", lambda v: F.floor(v.cast("double") * STEPS)).alias("x"))


def cluster_vectors(
    vectors: DataFrame, dim: int = 64, k: int = 16, rounds: int = 3, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Clusters of all vectors around k centroids after so many rounds, in exact arithmetic.

    The first centroids are the vectors whose ids have the smallest sha256 of ``seed:id``; a round assigns every vector to the
    nearest (the smaller number at ties) and moves each centroid that has any to floor(mean). Returns id_col, cluster,
    distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors of another length, null ones and those with null or non-finite components are left out. Equal vectors and
    repeated ids are rows of their own; among rows of one id the smallest vector is the first to be a centroid, and
    rows without an id come last. Fewer than k vectors give as many centroids; none, no rows. Other columns are ignored.
    A component so large that a squared distance might not fit into 64 bits is an error.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    kept = whole_vectors(vectors, dim, id_col, vector_col)
    drawn = kept.select("x", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256).alias("h"))
    first = [r.x for r in drawn.orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()]  # k rows
    points = np.array(first, np.int64).reshape(len(first), dim)
    state = kept.select("id", "x", F.lit(0).cast("long").alias("home"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    if not first:
        return state.limit(0).select(
            F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256")
        )
    history = [Centroids(points)]
    for _ in range(rounds):
        if len(history) > REPLAYED:
            shared = spark.sparkContext.broadcast(history[:-1])
            state = settle(state.mapInArrow(_state(shared), f"id {kind}, x array<bigint>, home long, upper double, lower double"))
            history = history[-1:]
        shared = spark.sparkContext.broadcast(history)  # at most REPLAYED + 1 times k x dim numbers
        sums = state.mapInArrow(_sums(shared), "cluster long, place long, total long, rows long").groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows"))
        points = history[-1].points.copy()
        for r in sums.collect():  # k x dim rows
            points[r.cluster, r.place] = r.total // r.rows
        history.append(Centroids(points, history[-1].points))
    shared = spark.sparkContext.broadcast(history)
    told = settle(state.mapInArrow(_assigned(shared), f"id {kind}, cluster int, distance long"))
    inertia = {r.cluster: r.inertia for r in told.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows
    facts = spark.createDataFrame([(c, n, sum(inertia.values()), ",".join(map(str, points[c].tolist()))) for c, n in inertia.items()], "cluster int, cluster_inertia long, inertia long, components string")
    facts = facts.select("cluster", "cluster_inertia", "inertia", F.sha2(F.col("components").cast("binary"), 256).alias("centroid_sha256"))
    return told.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
