"""Removing passages that repeat, by seed and extend.

Windows of n consecutive words are judged by their first place in the corpus, in order of document and
position. To find the rest without posting every window:

1. Texts are cut into units at places that the words themselves choose. A unit with the n - 1 words after
   it holds all windows that start in it, so a unit met before is a repeat whole; the first place of any
   window lies in the first place of its unit. Only those first units go on.
2. Each winnows anchors from its runs of words: every window selects one, and equal windows the same one.
   Documents are joined on the anchors that occur more than once: the seeds.
3. Around each seed, matches are extended both ways: first over the stretch of all windows that select
   it, judged as a unit was; then, where that occurs nowhere else, over three parts of it (more words on
   the left, as many, more on the right), by the words that all windows of a part share; what matches
   still is judged window by window. Overlapping repeats merge into maximal ones.

Each step groups by hash and passes on places, never pairs, so a passage in a third of all documents costs
one row a place. Tasks work on chunks of many texts at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutroom.llm.words import Words, _power_table, chunks, integer_id, mix, rolled
from cutroom.session import release, settle, ship

#: Words of an anchor; a window of n words has n - ANCHOR + 1 of them to choose from.
ANCHOR = 6
#: Words of a unit, about.
UNIT = 64
#: Parts of a stretch, by how many words its windows have left of the anchor.
PARTS = 3
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_NO_PLACES = np.zeros(0, np.int64)


def _rolling_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the place of the least of values[i : i + width], of equals the last."""
    at = np.arange(len(values))
    best, size = values, 1

    def lesser(step: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(best) - step
        later = best[step:] <= best[:n]
        return np.where(later, best[step:], best[:n]), np.where(later, at[step:], at[:n])

    while size * 2 <= width:
        best, at = lesser(size)
        size *= 2
    if size < width:
        best, at = lesser(width - size)
    return at


class Passages:
    """Windows, units, anchors and stretches of a chunk of texts; all places are words of the chunk."""

    def __init__(self, texts: list[bytes], n: int):
        self.n, self.source = n, Words(texts)
        self.size = min(ANCHOR, n)
        self.step = -(-(n - self.size + 1) // PARTS)
        self.hash, bounds = self.source.hash, self.source.bounds
        self.first, self.last = bounds[:-1], bounds[1:]
        total = len(self.hash)
        self.doc = np.repeat(np.arange(len(texts)), self.last - self.first)
        # starts of whole windows
        self.valid = np.arange(total) + n <= self.last[self.doc] if total else np.zeros(0, bool)
        self.windows = np.flatnonzero(self.valid)

    def _pieces(self, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of runs of windows; begins marks windows that start one, and a text's first always does."""
        s = self.windows
        fresh = begins[s].copy()
        fresh[0] = True
        fresh[1:] |= self.doc[s[1:]] != self.doc[s[:-1]]
        at = np.flatnonzero(fresh)
        return s[at], s[np.append(at[1:], len(s)) - 1] + 1

    def hashes(self, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the words from each start to its stop."""
        up, down = _power_table(len(self.hash) + 1)
        out = []
        for seed in (np.uint64(0), _SECOND):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.hash ^ seed) * up[: len(self.hash)], dtype=np.uint64)])
            out.append(mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64) * _GOLD))
        return out[0], out[1]

    def units(self) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.windows):
            return _NO_PLACES, _NO_PLACES
        return self._pieces(rolled(self.hash, 2) % np.uint64(UNIT) == 0)

    def stretches(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of runs of windows that select one anchor inside one unit, the anchors' places and hashes."""
        if not len(self.windows):
            return _NO_PLACES, _NO_PLACES, _NO_PLACES, np.zeros(0, np.uint64)
        grams = rolled(self.hash, self.size)[: len(self.hash) - self.size + 1]
        at = _rolling_min(grams, self.n - self.size + 1)
        begins = np.zeros(len(self.hash), bool)
        begins[1 : len(at)] = at[1:] != at[:-1]
        begins[units] = True
        starts, ends = self._pieces(begins)
        return starts, ends, at[starts], grams[at[starts]]

    def part_of(self, windows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        return (anchors - windows) // self.step

    def parts(self, starts: np.ndarray, ends: np.ndarray, anchors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each part: which stretches have windows of it, and a hash of the words that those windows share."""
        out = []
        low, high = self.part_of(ends - 1, anchors), self.part_of(starts, anchors)
        for part in range(PARTS):
            has = (low <= part) & (part <= high)
            left = part * self.step
            right = max(0, self.n - self.size - left - self.step + 1)
            g = anchors[has]
            out.append((has, self.hashes(g - left, g + self.size + right)[0] ^ mix(np.full(1, part + 1, np.uint64))))
        return out

    def marked(self, lists: list[np.ndarray]) -> np.ndarray:
        """Which words are named by places that count from their text's first word."""
        out = np.zeros(len(self.hash), bool)
        for first, places in zip(self.first.tolist(), lists, strict=True):
            out[first + places] = True
        return out

    def seeded(self, starts: np.ndarray, anchors: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
        """Which stretches have an anchor among their text's seeds."""
        of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        seeds = np.concatenate(lists).view(np.uint64) if lists else np.zeros(0, np.uint64)
        key = lambda a, d: mix(a ^ (d.astype(np.uint64) + np.uint64(1)) * _GOLD)
        return np.isin(key(anchors, self.doc[starts]), key(seeds, of))

    def kept(self, gone: np.ndarray) -> list[bytes]:
        """The words of each text that are not gone, joined by a space."""
        left = ~gone
        start, end = self.source.start[left], self.source.end[left]
        buf = self.source.buf.copy()
        buf[end] = 32
        edge = np.zeros(len(buf) + 1, np.int32)
        edge[start] += 1
        edge[end + 1] -= 1
        inside = np.cumsum(edge[:-1]) > 0
        out = buf[inside].tobytes()
        sizes = np.where(left, self.source.end - self.source.start + 1, 0)
        cuts = np.concatenate([[0], np.cumsum(sizes)])[np.append(self.first, self.last[-1:])].tolist()
        return [out[a : max(a, b - 1)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64), pa.int64())


def _lists(values: pa.Array, cuts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one: that is how they cross a shuffle."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            texts = [pack((t.as_py() or "").encode("utf-8", "replace")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "id", "other")), pa.array(texts, pa.binary())], ["key", "id", "other", "packed"])


def _chunks(batch: pa.RecordBatch, n: int) -> Iterator[tuple[slice, Passages]]:
    """(rows, passages) of a batch in chunks of bounded size."""
    if "packed" in batch.schema.names:
        unpack = zstandard.ZstdDecompressor().decompress
        texts = (unpack(t.as_py()) for t in batch.column("packed"))
    else:
        texts = (t.as_py() for t in batch.column("text"))
    for first, part in chunks(texts):
        yield slice(first, first + len(part)), Passages(part, n)


def _rows(column: pa.Array, rows: slice) -> list[np.ndarray]:
    """Lists of a column as arrays; null ones are empty."""
    part = column.slice(rows.start, rows.stop - rows.start)
    return [x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int64) for x in part]


def _unit_batches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, other = batch.column("id").to_numpy(), batch.column("other").to_numpy()
            for rows, text in _chunks(batch, n):
                units, ends = text.units()
                if not len(units):
                    continue
                starts, _, _, anchors = text.stretches(units)
                unit = np.searchsorted(units, starts, side="right") - 1
                # each anchor of a unit once, or twice if the unit has it more than once
                order = np.lexsort((anchors, unit))
                u, a = unit[order], anchors[order]
                third = np.zeros(len(u), bool)
                third[2:] = (u[2:] == u[:-2]) & (a[2:] == a[:-2])
                u, a = u[~third], a[~third]
                h1, h2 = text.hashes(units, ends + n - 1)
                doc = text.doc[units]
                yield pa.RecordBatch.from_arrays(
                    [
                        _long(h1), _long(h2), _long(ids[rows][doc]), _long(other[rows][doc]), pa.array((units - text.first[doc]).astype(np.int32)),
                        _lists(_long(a), np.searchsorted(u, np.arange(len(units) + 1))),
                    ],
                    ["h1", "h2", "id", "other", "start", "anchors"],
                )

    return run


def _posted(text: Passages, firsts: list[np.ndarray], seeds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and anchors' places of the stretches in first units that have a seed."""
    units, _ = text.units()
    starts, ends, places, anchors = text.stretches(units)
    if not len(starts):
        return starts, ends, places
    own = units[np.searchsorted(units, starts, side="right") - 1]
    at = text.marked(firsts)[own] & text.seeded(starts, anchors, seeds)
    return starts[at], ends[at], places[at]


def _stretch_batches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, other = batch.column("id").to_numpy(), batch.column("other").to_numpy()
            for rows, text in _chunks(batch, n):
                starts, ends, places = _posted(text, _rows(batch.column("units"), rows), _rows(batch.column("seeds"), rows))
                if not len(starts):
                    continue
                h1, h2 = text.hashes(starts, ends + n - 1)
                doc = text.doc[starts]
                keys = []
                for has, key in text.parts(starts, ends, places):
                    whole = np.zeros(len(starts), np.uint64)
                    whole[has] = key
                    keys.append(pa.array(whole.view(np.int64), pa.int64(), mask=~has))
                yield pa.RecordBatch.from_arrays(
                    [_long(h1), _long(h2), _long(ids[rows][doc]), _long(other[rows][doc]), pa.array((starts - text.first[doc]).astype(np.int32)), *keys],
                    ["h1", "h2", "id", "other", "start", *(f"k{p}" for p in range(PARTS))],
                )

    return run


def _window_batches(n: int):
    """Windows of the parts that are open; a part is its stretch's start times PARTS and its number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, other = batch.column("id").to_numpy(), batch.column("other").to_numpy()
            for rows, text in _chunks(batch, n):
                units, _ = text.units()
                starts, ends, places, _ = text.stretches(units)
                lists = _rows(batch.column("open"), rows)
                found = np.concatenate([first * PARTS + x for first, x in zip(text.first.tolist(), lists, strict=True)])
                stretch = np.searchsorted(starts, found // PARTS)
                sizes = (ends - starts)[stretch]
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                windows = np.arange(cuts[-1]) - np.repeat(cuts[:-1], sizes) + np.repeat(starts[stretch], sizes)
                own = text.part_of(windows, np.repeat(places[stretch], sizes)) == np.repeat(found % PARTS, sizes)
                windows = windows[own]
                h1, h2 = text.hashes(windows, windows + n)
                doc = text.doc[windows]
                yield pa.RecordBatch.from_arrays(
                    [_long(h1), _long(h2), _long(ids[rows][doc]), _long(other[rows][doc]), pa.array((windows - text.first[doc]).astype(np.int32))], ["h1", "h2", "id", "other", "start"]
                )

    return run


def _kept_batches(n: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in _chunks(batch, n):
                firsts, seeds, stretches, repeats = (_rows(batch.column(c), rows) for c in ("firsts", "seeds", "stretches", "repeats"))
                size = len(text.hash)
                units, ends = text.units()
                again = ~text.marked(firsts)[units]
                gone = _covered(size, units[again], ends[again] + n - 1) if size else np.zeros(0, bool)
                if size:
                    starts, stops, _ = _posted(text, firsts, seeds)
                    again = ~text.marked(stretches)[starts]
                    gone |= _covered(size, starts[again], stops[again] + n - 1)
                    single = np.flatnonzero(text.marked(repeats))
                    gone |= _covered(size, single, single + n)
                removed = np.concatenate([[0], np.cumsum(gone)])
                kept = text.kept(gone)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(rows.start, rows.stop - rows.start), _long(text.last - text.first), _long(removed[text.last] - removed[text.first]),
                        pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                        pa.array([k.decode("utf-8", "replace") if with_text else None for k in kept], pa.string()),
                    ],
                    ["key", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return run


def _place(*more: str) -> Column:
    return F.struct("id", "other", "start", *more)


def remove_repeats(docs: DataFrame, n: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove each word covered by a window of n words whose sequence also starts earlier in the corpus.

    Earlier is in a document of smaller id, or in the same one before. Words are runs of characters outside
    space and tab to carriage return, unchanged. Windows are judged on the input. Returns one row per input
    row: id_col, n_words, n_removed, kept_sha256 (of the words left, joined by one space, in UTF-8), and
    ``kept``, those words, if with_text. A null text has no words; texts of fewer than n words lose none.
    Rows that repeat both id and text are one document, and get the same result each; rows that repeat an id
    with another text are documents of their own, in order of a hash of the text; rows without an id come
    after all others, as if their id were the greatest long. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(docs[text_col], F.lit(""))
    keyed = docs.select(docs[id_col].alias("key"), F.coalesce(integer_id(docs, id_col), F.lit(2**63 - 1)).alias("id"), F.xxhash64(text, docs[id_col].isNull()).alias("other"), text.alias("text"))
    kind = dict(docs.dtypes)[id_col]
    packed = keyed.mapInArrow(_packed, f"key {kind}, id long, other long, packed binary")
    doc = ["id", "other"]
    units = keyed.select("id", "other", "text").mapInArrow(_unit_batches(n), "h1 long, h2 long, id long, other long, start int, anchors array<long>")
    firsts = settle(units.groupBy("h1", "h2").agg(F.min(_place("anchors")).alias("p")).select("p.*"))
    release(spark)
    posted = firsts.select(*doc, "start", F.explode("anchors").alias("anchor"))
    seeds = posted.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    wanted = settle(posted.join(seeds, "anchor").groupBy(*doc).agg(F.collect_set("start").alias("units"), F.collect_set("anchor").alias("seeds")))
    release(spark)
    # from here on the places of first units are enough; the checkpoint with their anchors may go
    known = settle(firsts.groupBy(*doc).agg(F.collect_list("start").alias("firsts")))
    del firsts, posted, seeds
    release(spark)
    keys = [f"k{p}" for p in range(PARTS)]
    stretches = packed.join(wanted, doc).select(*doc, "packed", "units", "seeds").mapInArrow(
        _stretch_batches(n), "h1 long, h2 long, id long, other long, start int, " + ", ".join(f"{k} long" for k in keys)
    )
    leading = settle(stretches.groupBy("h1", "h2").agg(F.min(_place(*keys)).alias("p")).select("p.*"))
    release(spark)
    parts = leading.select(*doc, "start", F.posexplode(F.array(*keys)).alias("part", "key")).where("key is not null")
    shared = parts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    open_parts = settle(parts.join(shared, "key").groupBy(*doc).agg(F.collect_list(F.col("start") * PARTS + F.col("part")).alias("open")))
    release(spark)
    led = settle(leading.groupBy(*doc).agg(F.collect_list("start").alias("stretches")))
    del leading, parts, shared
    release(spark)
    windows = packed.join(open_parts, doc).select(*doc, "packed", "open").mapInArrow(_window_batches(n), "h1 long, h2 long, id long, other long, start int")
    windows = settle(windows)
    release(spark)
    earliest = windows.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).where("first <> last").select("h1", "h2", "first")
    repeats = windows.join(earliest, ["h1", "h2"]).where(_place() != F.col("first")).groupBy(*doc).agg(F.collect_list("start").alias("repeats"))
    joined = (
        packed.join(known, doc, "left")
        .join(wanted.select(*doc, "seeds"), doc, "left")
        .join(led, doc, "left")
        .join(repeats, doc, "left")
        .select("key", "packed", "firsts", "seeds", "stretches", "repeats")
    )
    done = joined.mapInArrow(_kept_batches(n, with_text), f"key {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
    return done.select(F.col("key").alias(id_col), "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else []))
