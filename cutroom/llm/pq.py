"""Near-duplicate vectors by product quantisation: coarse inverted lists, residual subspace codes,
asymmetric table-lookup distances over sufficient probes, exact cosine rerank."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from cutroom.llm.words import integer_id
from cutroom.operators.components import connected_components, fold
from cutroom.session import release, settle, ship

#: Rows the index is fitted on; every row is indexed.
FIT_ROWS = 20_000
MAX_LISTS = 4096
SUBSPACES = 8
CODES = 64
#: Vectors of a block, about.
BLOCK = 8192
#: Partitions of blocks, at most, up to HELD blocks in each; more hold HELD. Every two of them make a task.
PARTS, HELD = 32, 16
#: Queries and members that are compared at once: their sums and tables stay near.
PIECE, CHUNK = 512, 512
#: Room for rounding in products of single precision.
ROUNDING = 1e-4


def _kmeans(points: np.ndarray, k: int, rounds: int, unit: bool) -> np.ndarray:
    rng = np.random.default_rng(7)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        off = 0 if unit else 0.5 * (centres**2).sum(1)
        near = np.concatenate([np.argmax(points[at : at + 1024] @ centres.T - off, axis=1) for at in range(0, len(points), 1024)])
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        full = count > 0
        centres[full] = total[full] / count[full, None]
        if unit:
            norm = np.linalg.norm(centres, axis=1, keepdims=True)
            centres = np.where(norm > 1e-9, centres / np.maximum(norm, 1e-9), points[: len(centres)])
    return centres


class Index:
    """Coarse unit centroids and one codebook a subspace."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = _kmeans(sample, min(lists, len(sample)), 8, unit=True)
        dim = sample.shape[1]
        self.cuts = np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)
        residual = sample - self.centres[np.argmax(sample @ self.centres.T, axis=1)]
        self.books = [_kmeans(residual[:, a:b], min(CODES, len(sample)), 6, unit=False) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        #: Whole numbers a one of a product, so that look-ups and their sums fit two bytes.
        self.scale = int(32_000 / (1 + np.sqrt(sum((book**2).sum(1).max() for book in self.books))))

    def code(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Codes of the residuals."""
        residual = x - self.centres[home]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        for m, book in enumerate(self.books):
            part = residual[:, self.cuts[m] : self.cuts[m + 1]]
            codes[:, m] = np.argmax(part @ book.T - 0.5 * (book**2).sum(1), axis=1)
        return codes

    def tables(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Products of queries with the centres of some lists, and with the entries of each book: a row a centre or entry, a column a query."""
        single = x.astype(np.float32)
        parts = [book.astype(np.float32) @ single[:, a:b].T for book, a, b in zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)]
        return self.centres[lists].astype(np.float32) @ single.T, parts

    def decode(self, codes: np.ndarray, home: np.ndarray) -> np.ndarray:
        """What home and codes stand for; a query's product with it is the sum of its look-ups."""
        out = self.centres[home]
        for m, book in enumerate(self.books):
            out[:, self.cuts[m] : self.cuts[m + 1]] += book[codes[:, m]]
        return out

    def bound(self, x: np.ndarray, codes: np.ndarray, home: np.ndarray, threshold: float) -> np.ndarray:
        """Least product of a neighbour at the threshold with the row's decoded codes.

        By the triangle inequality on the sphere, the neighbour's angle to the decoded row is at most the
        threshold's angle and that between the row and its decoded self.
        """
        decoded = self.decode(codes, home)
        length = np.linalg.norm(decoded, axis=1)
        off = np.arccos(np.clip(np.einsum("ij,ij->i", x, decoded) / np.maximum(length, 1e-12), -1, 1))
        return length * np.cos(np.minimum(np.pi, off + np.arccos(np.clip(threshold, -1, 1)))) - ROUNDING

    def gaps(self, x: np.ndarray, home: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Distance of each row to the plane between its home and each of the lists; 0 for home itself.

        A neighbour in list c lies beyond that plane, so rows within r of each other have a gap of r at most.
        """
        own = np.einsum("ij,ij->i", x, self.centres[home])
        homes, at = np.unique(home, return_inverse=True)
        apart = np.sqrt(np.maximum(2 - 2 * self.centres[homes] @ self.centres[lists].T, 1e-12))
        gap = (own[:, None] - x @ self.centres[lists].T) / apart[at]
        gap[home[:, None] == lists[None, :]] = 0
        return gap

    def bins(self, members: dict[int, int]) -> np.ndarray:
        """Bin of each list: lists beside each other along the centres' widest direction, up to BLOCK members unless one list has more."""
        middle = self.centres - self.centres.mean(0)
        order = np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")
        bins, current, held = np.zeros(len(order), np.int32), 0, 0
        for c in order:
            n = members.get(int(c), 0)
            if held and held + n > BLOCK:
                current, held = current + 1, 0
            bins[c], held = current, held + n
        return bins


def _reach(threshold: float) -> float:
    """Greatest distance of unit vectors at the threshold, with room for rounding."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6


def _units(vectors: pa.Array, rows: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True) + 0.0


def _homes(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            yield batch, np.argmax(_units(batch.column("x"), batch.num_rows) @ index.centres.T, axis=1)


def _count(index: Index):
    """Rows of each list, a row a list and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(index.centres), np.int64)
        for _, home in _homes(index, batches):
            seen += np.bincount(home, minlength=len(seen))
        full = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(seen[full])], ["home", "n"])

    return run


def _deal(index: Index, bins: np.ndarray, first: np.ndarray, parts: np.ndarray):
    """Rows with their list and their block, one of the parts of the list's bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, home in _homes(index, batches):
            mixed = batch.column("cid").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
            block = first[bins[home]] + (mixed % parts[bins[home]].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(home.astype(np.int32)), *(batch.column(c) for c in ("cid", "weight", "x"))], ["block", "home", "cid", "weight", "x"])

    return run


#: A row a block: its number and bin, the bins with a list that may hold a neighbour, and the arrays of its rows, those of a list together.
_PACKED = ("cids", "weights", "homes", "codes", "bounds", "vectors")
_BLOCK = "block int, bin int, probes array<int>, " + ", ".join(f"{c} binary" for c in _PACKED)


def _pack(index: Index, bins: np.ndarray, threshold: float):
    lists, order = np.arange(len(bins)), np.argsort(bins, kind="stable")
    starts = np.searchsorted(bins[order], np.arange(bins.max() + 1))

    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().sort_by("home").to_batches()[0]
        home, x = batch.column("home").to_numpy(), _units(batch.column("x"), batch.num_rows)
        codes = index.code(x, home)
        near = np.zeros(len(starts), bool)
        for at in range(0, len(x), 1024):
            near |= np.logical_or.reduceat((index.gaps(x[at : at + 1024], home[at : at + 1024], lists) <= _reach(threshold)).any(axis=0)[order], starts)
            if near.all():
                break
        # the parts of a look-up's sum are rounded to half of a whole each
        bound = np.floor(index.bound(x, codes, home, threshold) * index.scale) - len(index.books) / 2 - 1
        packed = [batch.column("cid"), batch.column("weight"), home, codes, bound.astype(np.int16), batch.column("x").flatten()]
        return pa.table(
            {
                "block": batch.column("block").slice(0, 1),
                "bin": pa.array([bins[home[0]]], pa.int32()),
                "probes": pa.array([np.flatnonzero(near).astype(np.int32)], pa.list_(pa.int32())),
                **{c: pa.array([np.asarray(a).tobytes()], pa.binary()) for c, a in zip(_PACKED, packed, strict=True)},
            }
        )

    return run


class _Block(NamedTuple):
    cid: np.ndarray
    weight: np.ndarray
    home: np.ndarray
    codes: np.ndarray
    bound: np.ndarray
    x: np.ndarray


def _unpack(index: Index, held: dict[str, bytes], kind: str) -> _Block:
    cid, home, x = np.frombuffer(held["cids"], np.int64), np.frombuffer(held["homes"], np.int32), np.frombuffer(held["vectors"], np.float32 if kind == "float" else np.float64)
    codes = np.frombuffer(held["codes"], np.uint8).reshape(len(cid), -1)
    return _Block(cid, np.frombuffer(held["weights"], np.int64), home, codes.T.astype(np.intp), np.frombuffer(held["bounds"], np.int16)[:, None], _units(pa.array([x]), len(cid)))


def _true(hit: np.ndarray) -> np.ndarray:
    """Places that are true, where few are: eight are looked at together."""
    flat = hit.ravel()
    whole = len(flat) // 8 * 8
    place = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([place[flat[place]], whole + np.flatnonzero(flat[whole:])])


def _links(index: Index, own: _Block, other: _Block, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (of own, of other) of links between different ids; of a block with itself both ways."""
    lists, place = np.unique(other.home, return_inverse=True)
    for at in range(0, len(own.cid), PIECE):
        x = own.x[at : at + PIECE]
        reached = (index.gaps(x, own.home[at : at + PIECE], lists) <= _reach(threshold)).any(axis=0)
        rows = np.flatnonzero(reached[place])
        coarse, parts = index.tables(x, lists)
        coarse, *parts = (np.rint(table * index.scale).astype(np.int16) for table in (coarse, *parts))
        total, looked = np.empty((CHUNK, len(x)), np.int16), np.empty((CHUNK, len(x)), np.int16)
        for from_ in range(0, len(rows), CHUNK):
            some = rows[from_ : from_ + CHUNK]
            near, one = total[: len(some)], looked[: len(some)]
            np.take(coarse, place[some], axis=0, out=near, mode="clip")
            for table, code in zip(parts, other.codes, strict=True):
                np.take(table, code[some], axis=0, out=one, mode="clip")
                near += one
            b, a = np.divmod(_true(near >= other.bound[some]), len(x))
            b = some[b]
            keep = np.zeros(len(a), bool)
            for s in range(0, len(a), 16384):
                keep[s : s + 16384] = np.einsum("ij,ij->i", x[a[s : s + 16384]], other.x[b[s : s + 16384]]) >= threshold
            a += at
            keep &= own.cid[a] != other.cid[b]
            if keep.any():
                yield a[keep], b[keep]


def _search(index: Index, threshold: float, kind: str):
    def compare(own: _Block, other: _Block, same: bool) -> Iterator[pa.RecordBatch]:
        ids = own.cid if same else np.concatenate([own.cid, other.cid])
        off = 0 if same else len(own.cid)
        links, order = np.zeros(len(ids), np.int64), np.argsort(ids)
        # labels are places in the order of the ids, so that the least place is the least id
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        label = np.arange(len(ids))
        for a, b in _links(index, own, other, threshold):
            np.add.at(links, a, other.weight[b])
            if not same:
                np.add.at(links, b + off, own.weight[a])
            fold(label, rank[a], rank[b + off])  # pairs live as long as their chunk
        full, joined = links > 0, label != np.arange(len(ids))
        sorted_ids = ids[order]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([ids[full], sorted_ids[joined]])),
                pa.array(np.concatenate([links[full], np.zeros(joined.sum(), np.int64)])),
                pa.array(np.concatenate([ids[full], sorted_ids[label[joined]]])),
            ],
            ["cid", "links", "label"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["a_block"] != number:  # rows of a block follow each other
                    number, own = row["a_block"], _unpack(index, {c: row[f"a_{c}"] for c in _PACKED}, kind)
                same = row["b_block"] == number
                yield from compare(own, own if same else _unpack(index, {c: row[f"b_{c}"] for c in _PACKED}, kind), same)

    return run


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", fit_rows: int = FIT_ROWS
) -> DataFrame:
    """Link vectors whose cosine, in double precision, is threshold or more.

    Returns one row per input row: id_col, n_links (other vectors linked directly), component_id (least
    id reachable by links, itself included), kept (the id is that id). Vectors that are null, empty, zero,
    of another length than most (of lengths as frequent, the greater) or with null or non-finite parts link
    with nothing; so do rows without an id, which get a null component and are kept. Rows that repeat an id
    count as further vectors in n_links. Other columns are ignored.

    Equal vectors are one class before anything else. The index is fitted on at most fit_rows rows, those
    of least hash; every class is coded and searched, in each list that a neighbour may be in, so no link
    is missed. Lists share bins, and bins are cut into blocks of bounded size, a row a block. Blocks lie in the
    checkpoint folder once, and every two whose bins may hold neighbours are read from there by one task, which returns
    counts and labels, never pairs: a vector crosses two shuffles, in single precision if it came so, however many
    lists are searched for it. A task needs its members' vectors beside their codes, as the rerank takes place where
    the candidates are found: to join them in later would make rows of all candidate pairs.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = "float" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "double"
    raw = vectors.select(integer_id(vectors, id_col).alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    if kind == "double":
        # squares of these would not fit or be lost: they are told by their directions, and those by the greatest part
        extreme = (norm > 1e140) | (norm < 1e-140)
        raw = raw.withColumn("x", F.when(extreme, F.transform("x", lambda v: v / F.nullif(F.array_max(F.transform("x", lambda w: F.abs(w))), F.lit(0.0)))).otherwise(F.col("x")))
    sound = F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good = raw.where(sound).where((norm > 0) & (norm < float("inf")))
    lengths = good.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    dim = lengths[0]["n"] if lengths else 0
    # two hashes name a vector where its own numbers would be shuffled again
    names = [F.xxhash64("x").alias("d1"), F.xxhash64(F.lit(1), "x").alias("d2")]
    classes = settle(good.where(F.size("x") == dim).groupBy("x").agg(F.min("vec_id").alias("cid"), F.count("*").alias("weight")))
    total = classes.count()
    if not total:
        return raw.select(F.col("vec_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    release(spark)
    least = F.xxhash64("x")
    some = classes if total <= 2 * fit_rows + 1000 else classes.where(least < int((2 * fit_rows + 1000) / total * 2.0**64) - 2**63)  # the others are not among the least
    sample = some.orderBy(least, "cid").limit(fit_rows).select("x").collect()
    points = np.array([r.x for r in sample], float)
    index = Index(points / np.linalg.norm(points, axis=1, keepdims=True), int(min(MAX_LISTS, max(1, 2 * round(total**0.5)))))
    homes = classes.select("x").mapInArrow(_count(index), "home int, n long").groupBy("home").agg(F.sum("n").alias("n")).collect()  # a row a list, MAX_LISTS at most
    bins = index.bins({r.home: r.n for r in homes})
    held = np.zeros(bins.max() + 1, np.int64)
    for r in homes:
        held[bins[r.home]] += r.n
    parts = np.maximum(1, -(-held // BLOCK))
    first, n = np.cumsum(parts) - parts, int(parts.sum())
    tasks = min(n, max(PARTS, n // HELD))
    dealt = classes.select("cid", "weight", "x").mapInArrow(_deal(index, bins, first, parts), f"block int, home int, cid long, weight long, x array<{kind}>")
    blocks = settle(dealt.repartition(tasks, "block").groupBy("block").applyInArrow(_pack(index, bins, threshold), _BLOCK).coalesce(tasks))
    release(spark)
    own, other = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in "ab")
    # each two blocks once, so that every block comes as often first as second
    once = F.expr("a_block = b_block or ((a_block + b_block) % 2 = 1) = (a_block < b_block)")
    near = F.array_contains("a_probes", F.col("b_bin")) & F.array_contains("b_probes", F.col("a_bin"))
    pairs = own.hint("shuffle_replicate_nl").join(other, once & near).select(*[f"{side}_{c}" for side in "ab" for c in ("block", *_PACKED)])
    found = settle(pairs.mapInArrow(_search(index, threshold, kind), "cid long, links long, label long")).coalesce(tasks)
    links = found.where("links > 0").groupBy("cid").agg(F.sum("links").alias("links"))
    nodes = connected_components(found.where("cid <> label"), "cid", "label")
    named = (
        classes.select("cid", "weight", *names).join(links, "cid", "left").join(nodes.withColumnRenamed("node", "cid"), "cid", "left")
        .select("d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    )
    told = sound & (F.size("x") == dim) & (norm > 0) & (norm < float("inf"))
    keyed = raw.select("vec_id", *[F.when(told, name).alias(c) for name, c in zip(names, ("d1", "d2"), strict=True)])
    return keyed.join(named, ["d1", "d2"], "left").select(
        F.col("vec_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id"))).alias("kept"),
    )
