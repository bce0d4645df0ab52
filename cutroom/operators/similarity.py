"""Vector similarity: exact pairs over a threshold, clusters, centroids, two-stage search."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutroom.functions.vectors import cosine, norm, sound
from cutroom.operators.components import connected_components, fold
from cutroom.session import settle, ship

#: Pivots at most (the root of the vectors, where that is less); vectors of one block.
PIVOTS = 2048
BLOCK = 2048
#: Vectors that a task holds to compare others with, about, others that come to it, and of those how many are multiplied at a time.
HELD, ASKED, CHUNK = 8192, 32_768, 256
#: Frames of a clip that its mean brings along.
FEW = 16
#: Prompts that a configuration may hold.
PROMPTS = 10_000


def _sound(df: DataFrame, ident: str, vector: str, *more: str) -> DataFrame:
    """(i, v, n, more): the vectors that have a direction, as wide as they came, and their lengths."""
    double = F.col(vector).cast("array<double>")
    kept = F.col(vector) if dict(df.dtypes)[vector] == "array<float>" else double
    known = df.select(F.col(ident).alias("i"), double.alias("_v"), kept.alias("v"), *more)
    return known.where(sound("_v")).withColumn("n", norm("_v")).where("n > 0").select("i", "v", "n", *more)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _chain(near: np.ndarray) -> np.ndarray:
    """Places in an order in which each is followed by the one nearest to it that is left."""
    order, left = [0], np.ones(len(near), bool)
    left[0] = False
    while len(order) < len(near):
        order.append(int(np.where(left, near[order[-1]], -np.inf).argmax()))
        left[order[-1]] = False
    return np.array(order)


class _Bins:
    """Cells in a row of bins: small neighbours share one, a large cell has several."""

    def __init__(self, pivots: np.ndarray, reach: float, counts: dict[int, int]):
        self.pivots, self.reach = pivots, reach
        self.apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-12))
        self.order = _chain(pivots @ pivots.T)
        self.first, self.many = np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64)
        starts, spans, bins, room = [], [], 0, -1
        for at, cell in enumerate(self.order):
            n = counts.get(int(cell), 0)
            if n > room:
                starts.append(at)
                self.first[cell], self.many[cell] = bins, max(1, -(-n // HELD))
                spans.append((bins, self.many[cell]))
                bins += self.many[cell]
                room = HELD - n if self.many[cell] == 1 else -1
            else:
                self.first[cell] = bins - 1
                room -= n
        self.starts = np.array(starts)
        self.spread = np.repeat(np.arange(len(spans)), [k for _, k in spans])  # the group of cells that each bin is of

    def homes(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.pivots.T).argmax(axis=1)

    def place(self, x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's bin, and (rows x bins) whether it must look into a bin that comes after its own."""
        near = x @ self.pivots.T
        home = near.argmax(axis=1)
        gap = (near[np.arange(len(x)), home][:, None] - near) / self.apart[home]
        gap[np.arange(len(x)), home] = 0
        own = self.first[home] + turn % self.many[home]
        looks = np.logical_or.reduceat((gap <= self.reach + 1e-9)[:, self.order], self.starts, axis=1)[:, self.spread]
        return own, looks & (np.arange(len(self.spread)) > own[:, None])


def _met(df: DataFrame, ident: str, vector: str, threshold: float, emit: Callable, shape: str, *more: str) -> DataFrame:
    """What emit yields of every bin: emit(held, some, own, inside) for the rows it holds and up to CHUNK others, (ids, vectors, more) each, and with None for others at its end.

    own is what emit may keep of a bin, {} at its beginning. A pair comes once: a row meets those of its own bin and of later bins.
    """
    ship(df.sparkSession)
    units = _sound(df, ident, vector, *more)
    many = int(min(PIVOTS, max(16, units.count() ** 0.5)))
    sample = [np.array(r["v"], float) / r["n"] for r in units.orderBy(F.xxhash64("v"), "i").limit(many).collect()]
    kind = dict(units.dtypes)
    if not sample:
        return df.sparkSession.createDataFrame([], shape)
    dim = len(sample[0])
    units = units.where(F.size("v") == dim)
    pivots = np.array([s for s in sample if len(s) == dim])
    first = _Bins(pivots, 0.0, {})

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.bincount(first.homes(_matrix(batch.column("v"), dim) / batch.column("n").to_numpy()[:, None]), minlength=len(pivots)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found), pa.int32()), pa.array(found[found > 0], pa.int64())], ["cell", "n"])

    counts = {r.cell: r.n for r in units.select("v", "n").mapInArrow(home, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # PIVOTS rows at most
    bins = _Bins(pivots, float(np.sqrt(max(0.0, 2 - 2 * threshold))), counts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, looks = bins.place(_matrix(batch.column("v"), dim) / batch.column("n").to_numpy()[:, None], batch.column("turn").to_numpy())
            ends = np.concatenate([[0], np.cumsum(looks.sum(axis=1))])
            asks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(looks)[1], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), asks], [*batch.schema.names, "own", "asks"])

    held = ["i", "v", "n", *more]
    turned = units.select(*held, F.pmod(F.xxhash64("i"), F.lit(1 << 30)).alias("turn"))
    coded = settle(turned.mapInArrow(place, ", ".join(f"{c} {kind[c]}" for c in held) + ", turn long, own int, asks array<int>"))
    asked = coded.select(F.explode("asks").alias("bin")).groupBy("bin").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("slices"))
    asked = settle(asked)  # a row a bin
    slices = F.coalesce("slices", F.lit(1))
    members = coded.withColumn("bin", F.col("own")).join(F.broadcast(asked), "bin", "left").select("bin", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.lit(0).alias("side"), *held)
    queries = coded.withColumn("bin", F.explode("asks")).join(F.broadcast(asked), "bin").select("bin", F.pmod("turn", "slices").cast("int").alias("slice"), F.lit(1).alias("side"), *held)
    tasks = int(asked.agg(F.coalesce(F.sum("slices"), F.lit(0))).first()[0]) + len(bins.spread)
    dealt = members.unionByName(queries).repartition(tasks, "bin", "slice").sortWithinPartitions("bin", "slice", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(batch: pa.RecordBatch) -> tuple:
            x = _matrix(batch.column("v"), dim) / batch.column("n").to_numpy()[:, None]
            return batch.column("i").to_numpy(zero_copy_only=False), x, [batch.column(c) for c in more]

        def whole(parts: list[tuple]) -> tuple:
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [pa.concat_arrays(list(c)) for c in zip(*(p[2] for p in parts), strict=True)]

        def cut(rows: tuple) -> Iterator[tuple]:
            for at in range(0, len(rows[0]), CHUNK):
                yield rows[0][at : at + CHUNK], rows[1][at : at + CHUNK], [c.slice(at, CHUNK) for c in rows[2]]

        def inner(kept: tuple, own: dict, slice_: int) -> Iterator[tuple]:
            """The held rows among themselves, in the first slice, once all have come."""
            if slice_ == 0:
                for some in cut(kept):
                    yield from emit(kept, some, own, True)

        ident_type, now, parts, kept, own = None, None, [], None, {}
        for batch in batches:
            ident_type = batch.schema.field("i").type
            tags = np.stack([batch.column(c).to_numpy() for c in ("bin", "slice", "side")], axis=1)
            edges = [0, *(np.flatnonzero((tags[1:] != tags[:-1]).any(axis=1)) + 1), len(tags)] if len(tags) else [0]
            for low, high in zip(edges, edges[1:], strict=False):
                tag = (int(tags[low][0]), int(tags[low][1]))
                if tag != now:
                    if now is not None:
                        if kept is None and parts:
                            kept = whole(parts)
                            yield from _arrows(inner(kept, own, now[1]), ident_type)
                        if kept is not None:
                            yield from _arrows(emit(kept, None, own, False), ident_type)
                    now, parts, kept, own = tag, [], None, {}
                rows = read(batch.slice(low, high - low))
                if tags[low][2] == 0:
                    parts.append(rows)
                    continue
                if kept is None and parts:
                    kept = whole(parts)
                    yield from _arrows(inner(kept, own, now[1]), ident_type)
                if kept is not None:
                    for some in cut(rows):
                        yield from _arrows(emit(kept, some, own, False), ident_type)
        if now is not None:
            if kept is None and parts:
                kept = whole(parts)
                yield from _arrows(inner(kept, own, now[1]), ident_type)
            if kept is not None:
                yield from _arrows(emit(kept, None, own, False), ident_type)

    return dealt.mapInArrow(compare, shape)


def _arrows(found: Iterable[tuple], ident: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Batches of (a, b) or (a, b, similarity), as many as there are."""
    for a, b, *more in found:
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a, ident), pa.array(b, ident), *(pa.array(m, pa.float64()) for m in more)], ["a", "b", "similarity"][: 2 + len(more)])


def _close(held: tuple, some: tuple, threshold: float, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in held and in some of the pairs at the threshold, and their cosines; inside a bin each pair once."""
    near = held[1] @ some[1].T
    p, q = np.nonzero(near >= threshold)
    if inside:
        once = held[0][p] < some[0][q]
        p, q = p[once], q[once]
    return p, q, near[p, q]


def _pairs(threshold: float) -> Callable:
    def emit(held: tuple, some: tuple | None, own: dict, inside: bool) -> Iterator[tuple]:
        if some is not None:
            p, q, near = _close(held, some, threshold, inside)
            a, b = held[0][p], some[0][q]
            yield np.where(a < b, a, b), np.where(a < b, b, a), near

    return emit


def _labels(threshold: float) -> Callable:
    """An edge at most for each held row and each that came: all held rows that one row meets are joined."""

    def emit(held: tuple, some: tuple | None, own: dict, inside: bool) -> Iterator[tuple]:
        label = own.setdefault("label", np.arange(len(held[0])))
        if some is None:
            moved = np.flatnonzero(label != np.arange(len(label)))
            yield held[0][moved], held[0][label[moved]]
            return
        p, q, _ = _close(held, some, threshold, False)
        if inside:
            at = own["at"] = own.get("at", 0)
            own["at"] += len(some[0])
            fold(label, p, q + at)
            return
        turn = np.argsort(q, kind="stable")
        p, q = p[turn], q[turn]
        same = q[1:] == q[:-1]
        fold(label, p[:-1][same], p[1:][same])
        lead = np.concatenate([[True], ~same])[: len(q)]
        yield some[0][q[lead]], held[0][p[lead]]

    return emit


def similar_pairs(df: DataFrame, ident: str, vector: str, threshold: float) -> DataFrame:
    """All pairs (a, b, similarity) with a < b and a cosine of threshold or more; exact.

    Vectors gather around pivots, a bounded sample of them that grows with the table. A pair at the threshold
    lies within r = sqrt(2 - 2 threshold), so a vector has to look only into those pivots' cells whose bisecting
    plane is within r. Cells lie in a row of bins that a task holds whole, small neighbours together, and a vector is sent to
    later bins alone, so that it has no more copies than there are bins however little the planes exclude; those that come to
    a bin pass by in batches. Vectors that are null, zero, not finite or of another length than the first pivot's pair with nothing.
    """
    return _met(df, ident, vector, threshold, _pairs(threshold), f"a {_kind(df, ident)}, b {_kind(df, ident)}, similarity double")


def _kind(df: DataFrame, ident: str) -> str:
    return dict(df.dtypes)[ident]


def similar_clusters(df: DataFrame, ident: str, vector: str, threshold: float, least: int = 2) -> DataFrame:
    """Connected components (node, component, members) of the pairs of similar_pairs(), which are never made: a block
    returns at most an edge for each of its rows."""
    return clusters(_met(df, ident, vector, threshold, _labels(threshold), f"a {_kind(df, ident)}, b {_kind(df, ident)}"), least)


def clusters(pairs: DataFrame, least: int = 2) -> DataFrame:
    """Connected components (node, component) of pairs a, b with at least that many members."""
    nodes = connected_components(pairs, "a", "b")
    big = nodes.groupBy("component").agg(F.count("*").alias("members")).where(F.col("members") >= least)
    return nodes.join(big, "component")


def _refined(sure: float, least: float, frame_sure: float) -> Callable:
    """Pairs whose means reach sure (2), those that reach least and have two frames that reach frame_sure (1), and those that reach least whose frames are not at hand (0)."""

    def stacked(rows: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(rows, frames, components) of unit frames, NaN where there is none, and which rows hold theirs."""
        dim, column = rows[1].shape[1], rows[2][0]
        sizes = np.array([-1 if n is None else n for n in column.value_lengths().to_pylist()])
        sizes = np.where(sizes < 0, -1, sizes // dim)
        out = np.full((len(sizes), max(1, sizes.max(initial=0)), dim), np.nan)
        flat = _matrix(column, dim)
        out[np.arange(out.shape[1]) < sizes[:, None]] = flat / np.linalg.norm(flat, axis=1, keepdims=True)
        return out, sizes >= 0

    def emit(held: tuple, some: tuple | None, own: dict, inside: bool) -> Iterator[tuple]:
        if some is None:
            return
        if "frames" not in own:
            own["frames"] = stacked(held)
        x, x_known = own["frames"]
        y, y_known = stacked(some)
        p, q, near = _close(held, some, least, inside)
        told = np.where(near >= sure, 2.0, np.where(x_known[p] & y_known[q], 1.0, 0.0))
        open_ = np.flatnonzero(told == 1)
        open_ = open_[np.argsort(q[open_], kind="stable")]
        for at in np.split(open_, np.flatnonzero(np.diff(q[open_])) + 1):
            if not len(at):
                continue
            k = q[at[0]]
            met = (x[p[at]].reshape(-1, x.shape[2]) @ y[k].T >= frame_sure).reshape(len(at), -1).any(axis=1)
            told[at[~met]] = -1
        keep = told >= 0
        one, two = held[0][p[keep]], some[0][q[keep]]
        yield np.where(one < two, one, two), np.where(one < two, two, one), told[keep]

    return emit


def refined_pairs(means: DataFrame, frames: DataFrame, ident: str, frame: str, vector: str, sure: float = 0.90, slack: float = 0.15, frame_sure: float = 0.95) -> DataFrame:
    """Pairs whose means reach sure, or reach sure - slack while any two of their frames reach frame_sure.

    A clip's mean brings its frames along where they are FEW, so that a near pair is told where it is found; only pairs with a clip
    of more meet their frames in a join.
    """
    good = _sound(frames.withColumn("_f", F.struct(F.col(ident).alias("c"), F.col(frame).alias("f"))), "_f", vector).select(F.col("i.c").alias("_c"), "v")
    size = F.size("v")
    few = good.groupBy("_c").agg(F.count("*").alias("k"), F.min(size).alias("low"), F.max(size).alias("high")).where((F.col("k") <= FEW) & (F.col("low") == F.col("high"))).select("_c", F.col("low").alias("_size"))
    packs = good.join(few, "_c").groupBy("_c", "_size").agg(F.flatten(F.collect_list("v")).alias("_frames"))
    brought = means.join(packs, means[ident] == packs["_c"], "left").select(ident, vector, F.when(F.size(vector) == F.col("_size"), F.col("_frames")).alias("_frames"))
    kind = _kind(means, ident)
    found = settle(_met(brought, ident, vector, sure - slack, _refined(sure, sure - slack, frame_sure), f"a {kind}, b {kind}, similarity double", "_frames"))
    keyed = frames.select(F.col(ident).alias("c"), F.col(vector).alias("v"))
    left = found.where("similarity = 0").select("a", "b").join(keyed.select(F.col("c").alias("a"), F.col("v").alias("va")), "a")
    both = left.join(keyed.select(F.col("c").alias("b"), F.col("v").alias("vb")), "b")
    by_frame = both.where(cosine("va", "vb") >= frame_sure).select("a", "b").distinct()
    return found.where("similarity > 0").select("a", "b").unionByName(by_frame)


def centroid(df: DataFrame, keys: list[str], vector: str, name: str = "centroid") -> DataFrame:
    """Mean vector of each key, of length 1; a mean of zero gives null. Sums by place, so nothing is gathered."""
    parts = df.where(sound(vector)).select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("p", "x"))
    means = parts.groupBy(*keys, "p").agg(F.avg("x").alias("m"))
    rows = means.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("v"))
    return rows.select(*keys, F.when(norm("v") > 0, F.transform("v", lambda x: x / norm("v"))).alias(name))


def novelty(similarity: Column) -> Column:
    """1 at a similarity of 0.5 or less, 0 at 0.95 or more."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (0.95 - similarity) / (0.95 - 0.50)))


def least_within(df: DataFrame, group: str, ident: str, vector: str) -> DataFrame:
    """Least cosine of two members of each group, 0 where a vector is missing, and how many pairs that is the least of.

    A group is cut into blocks, and a task multiplies two of them and returns one number; no pair is ever a row.
    """
    ship(df.sparkSession)
    rows = df.select(group, F.col(ident).alias("i"), F.col(vector).cast("array<double>").alias("v")).withColumn("v", F.when(sound("v") & (norm("v") > 0), F.col("v")))
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    held = rows.join(sizes.drop("n"), group).withColumn("own", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int"))
    met = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = met.select(group, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "i", "v")
    kind = dict(df.dtypes)[group]

    def least(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = int(frame.x.iloc[0]), int(frame.y.iloc[0])
        one, two = frame[frame.own == x], frame[frame.own == y]
        low = np.inf
        if len(one) and len(two) and (x != y or len(one) > 1):
            if one.v.isna().any() or two.v.isna().any():
                low = 0.0
            lengths = {len(v) for v in frame.v if v is not None}
            if len(lengths) > 1:
                low = 0.0
            for size in lengths:
                unit = [np.stack([v / np.linalg.norm(v) for v in side.v if v is not None and len(v) == size] or [np.zeros(size)]) for side in (one, two)]
                for at in range(0, len(unit[0]), 256):
                    near = unit[0][at : at + 256] @ unit[1].T
                    if x == y:
                        near[np.arange(len(near)), np.arange(at, at + len(near))] = np.inf
                    if near.size:
                        low = min(low, float(near.min()))
        return pd.DataFrame({group: [frame[group].iloc[0]], "low": [None if np.isinf(low) else low]})

    lows = blocks.groupBy(group, "x", "y").applyInPandas(least, f"{group} {kind}, low double").groupBy(group).agg(F.min("low").alias("least"))
    pairs = F.floor(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs")
    return sizes.where("n > 1").select(group, pairs).join(lows, group).select(group, "least", "pairs")


def two_stage_search(means: DataFrame, frames: DataFrame, ident: str, frame: str, vector: str, query: list[float], coarse: int = 50, least: float = 0.25) -> DataFrame:
    """Rank all means by cosine to the query, then the coarse best ones by their best frame as well.

    score is the greater of the mean's and the best frame's cosine; frame is the best one, of equals the
    last. Rows below least are left out.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    ranked = means.select(F.col(ident), cosine(vector, q).alias("mean_score")).where("mean_score is not null")
    top = ranked.orderBy(F.desc("mean_score"), ident).limit(coarse)
    best = (
        frames.join(F.broadcast(top.select(ident)), ident)  # coarse rows
        .select(ident, frame, cosine(vector, q).alias("s")).where("s is not null")
        .groupBy(ident).agg(F.max(F.struct("s", frame)).alias("b")).select(ident, F.col("b.s").alias("frame_score"), F.col(f"b.{frame}").alias(frame))
    )
    joined = ranked.join(best, ident, "left").withColumn("score", F.greatest("mean_score", F.coalesce("frame_score", "mean_score")))
    return joined.where(F.col("score") >= least)


def complete_link(df: DataFrame, event: str, order: list[str], ident: str, close, most: int = 200, schema: str | None = None, weakest: list[str] | None = None) -> DataFrame:  # noqa: ANN001
    """Greedy complete-link clusters inside each event, in order: a row joins the first cluster all of whose members it is close to.

    close(rows, i, members) says, for a pandas frame of one event, whether row i is close to all of the
    members. An event is one task, so it should be split by time gaps before; a cluster holds most members.
    With weakest, a row left alone gets the first member in that order of the first full cluster before it
    that it is close to all of, so that the limit leaves no copy alone.
    """
    ship(df.sparkSession)

    def assign(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable").reset_index(drop=True)
        groups: list[list[int]] = []
        label = []
        for i in range(len(frame)):
            for k, members in enumerate(groups):
                if len(members) < most and close(frame, i, members):
                    members.append(i)
                    label.append(k)
                    break
            else:
                label.append(len(groups))
                groups.append([i])
        if weakest is not None:
            rank = frame[weakest].assign(_at=-frame.index).sort_values([*weakest, "_at"], kind="stable").index
            place = {i: k for k, i in enumerate(rank)}
            for spill, alone in enumerate(groups):
                if len(alone) == 1:
                    full = next((g for g in groups[:spill] if len(g) == most and close(frame, alone[0], g)), None)
                    if full is not None:
                        moved = min(full, key=place.__getitem__)
                        full.remove(moved)
                        alone.append(moved)
                        label[moved] = spill
        return pd.DataFrame({event: frame[event], ident: frame[ident], "cluster": label})

    kinds = dict(df.dtypes)
    return df.groupBy(event).applyInPandas(assign, schema or f"{event} {kinds[event]}, {ident} {kinds[ident]}, cluster long")


def prototype_scores(df: DataFrame, ident: str, vector: str, prototypes: DataFrame) -> DataFrame:
    """Mean cosine of each row to each label's prompts (dimension, label, vector); a cosine that cannot be told counts in no mean.

    Prompts are a configuration that every task holds: more than PROMPTS of them are refused.
    """
    ship(df.sparkSession)
    prompts = prototypes.select("dimension", "label", F.col("vector").cast("array<double>").alias("v")).where(sound("v")).limit(PROMPTS + 1).collect()
    if len(prompts) > PROMPTS:
        raise ValueError(f"a configuration holds {PROMPTS} prompts at most")
    names = sorted({(p.dimension, p.label) for p in prompts})
    units = [(names.index((p.dimension, p.label)), np.array(p.v) / np.linalg.norm(p.v)) for p in prompts if np.linalg.norm(p.v) > 0]
    kind = dict(df.dtypes)[ident]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.array(v, float) for v in batch.column("v").to_pylist()]
            total, count = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
            for size in {len(v) for v in x}:
                rows = [k for k, v in enumerate(x) if len(v) == size and np.linalg.norm(v) > 0]
                same = [(n, u) for n, u in units if len(u) == size]
                if rows and same:
                    near = np.stack([x[k] / np.linalg.norm(x[k]) for k in rows]) @ np.stack([u for _, u in same]).T
                    for c, (n, _) in enumerate(same):
                        total[rows, n] += near[:, c]
                        count[rows, n] += 1
            at, n = np.nonzero(count)
            yield pa.RecordBatch.from_arrays(
                [batch.column("i").take(pa.array(at)), pa.array([names[k][0] for k in n], pa.string()), pa.array([names[k][1] for k in n], pa.string()), pa.array(total[at, n] / count[at, n])],
                [ident, "dimension", "label", "score"],
            )

    rows = df.select(F.col(ident).alias("i"), F.col(vector).cast("array<double>").alias("v")).where(sound("v"))
    return rows.mapInArrow(score, f"{ident} {kind}, dimension string, label string, score double")


def classify(scores: DataFrame, ident: str, least: float = 0.22, unknown: str = "unknown") -> DataFrame:
    """Best label of each row and dimension, of equals the smaller; below least it is unknown."""
    best = scores.groupBy(ident, "dimension").agg(F.min(F.struct((-F.col("score")).alias("m"), F.col("label").alias("l"))).alias("b"))
    return best.select(ident, "dimension", F.when(-F.col("b.m") >= least, F.col("b.l")).otherwise(unknown).alias("label"), (-F.col("b.m")).alias("score"))
