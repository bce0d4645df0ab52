"""Benchmark decontamination by pigeonhole edit matching.

A test item of m normalised characters may be met with up to k edits. Split into k + 1 pieces, one piece
must be met unchanged, so an Aho-Corasick machine over all pieces finds every place that can hold the item,
and Myers' bit-parallel distance verifies it there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutroom.llm.words import integer_id
from cutroom.session import settle, ship, table

#: Characters of an item for each edit allowed.
CHARS_PER_EDIT = 20
#: Items with fewer normalised characters match nothing; those with too few for an edit are met as whole words.
MIN_CHARS = 1
#: Characters of items in one machine; more items take more passes.
MACHINE_CHARS = 8_000_000
_WORD = re.compile(r"[^\W_]+")


def _lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def normalised(text: str) -> str:
    """Letters and digits in lower case, everything between them one space."""
    return " ".join(_WORD.findall(_lowered(text)))


def budget(length: int, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    return length // chars_per_edit


def split_pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of edits + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(pattern: str, text: str, edits: int, anchored: bool = False) -> tuple[int, int] | None:
    """(distance, end) of the best match of the pattern within edits in the text, the first of equals.

    It may start anywhere in the text, or only at its start if anchored (ends then count from there).
    """
    m = len(pattern)
    masks, top, ones = _masks(pattern), 1 << (m - 1), (1 << m) - 1
    plus, minus, score, best = ones, 0, m, None
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | x
        up = minus | ~(d | plus) & ones
        down = plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1 | (1 if anchored else 0)) & ones
        down = down << 1 & ones
        plus = down | ~(d | up) & ones
        minus = up & d
        if score <= edits and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


class Matcher:
    """All pieces of a set of (id, normalised item) in one machine."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int):
        import ahocorasick

        self.items = [(name, text, budget(len(text), chars_per_edit)) for name, text in items]
        self.machine = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, edits) in enumerate(self.items):
            for offset, piece in split_pieces(text, edits):
                where.setdefault(piece, []).append((i, offset))
        for piece, places in where.items():
            self.machine.add_word(piece, (len(piece), places))
        self.machine.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, distance) in the text as given: the best place of each item, the first of equals."""
        if not self.items:
            return []
        norm = normalised(text)
        starts: dict[int, set[int]] = {}
        for last, (size, places) in self.machine.iter(norm):
            for i, offset in places:
                starts.setdefault(i, set()).add(last - size + 1 - offset)
        found = []
        for i, begins in starts.items():
            name, item, edits = self.items[i]
            if not edits:
                whole = next((b for b in sorted(begins) if norm[max(0, b - 1) : b] in ("", " ") and norm[b + len(item) : b + len(item) + 1] in ("", " ")), None)
                if whole is not None:
                    found.append((name, whole, whole + len(item), 0))
                continue
            best, covered = None, -1
            for begin in sorted(begins):
                low, high = max(0, begin - edits), min(len(norm), begin + len(item) + edits)
                if high <= covered:
                    continue
                # places that overlap are searched as one stretch, so repeats of a piece cost once
                low = low if covered < low else max(low, covered - len(item) - 2 * edits)
                covered = high
                hit = myers(item, norm[low:high], edits)
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], low + hit[1])
            if best:
                distance, end = best
                back = myers(item[::-1], norm[max(0, end - len(item) - distance) : end][::-1], distance, anchored=True)
                found.append((name, end - back[1], end, distance))
        return self._placed(text, found) if found else []

    @staticmethod
    def _placed(text: str, found: list) -> list:
        """Offsets in the normalised text as offsets in the text."""
        origin: list[int] = []
        for m in _WORD.finditer(_lowered(text)):
            if origin:
                origin.append(origin[-1] + 1)
            origin.extend(range(m.start(), m.end()))
        return sorted((name, origin[a], origin[b - 1] + 1, d) for name, a, b, d in found)


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    chars_per_edit: int = CHARS_PER_EDIT, min_chars: int = MIN_CHARS,
) -> DataFrame:
    """Benchmark items in whole documents, with up to one edit for chars_per_edit characters.

    Returns a row for each document and item met: id_col, item_id, start, end (characters of the text as it
    is), distance. Both sides are lower-cased and stripped of everything but letters and digits first; items
    with too few characters for an edit are met unchanged, as whole words. Items with fewer than min_chars
    characters, null and empty ones at least, match nothing, like null and empty documents. Repeated documents are searched each; items that repeat an id
    count once for each different text. Other columns are ignored.

    The items travel to the tasks in machines of MACHINE_CHARS characters; a larger benchmark takes several
    passes over the documents, one after the other, rather than a larger machine.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(integer_id(benchmark, item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = -(-size // MACHINE_CHARS) or 1
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, item_id long, start long, end long, distance long"

    def search(part: list[tuple[int, str]]):
        held: list[Matcher] = []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not held:
                held.append(Matcher(part, chars_per_edit))
            for batch in batches:
                at, rows = [], []
                for i, text in enumerate(batch.column("text")):
                    for row in held[0].find(text.as_py() or ""):
                        at.append(i)
                        rows.append(row)
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], ["id", "item_id", "start", "end", "distance"]
                )

        return run

    out = None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).collect()
        texts = sorted({(r["item"], t) for r in part if len(t := normalised(r["text"])) >= min_chars}, key=str)
        found = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(search(texts), schema)
        found = settle(found) if passes > 1 else found  # a part is let go before the next one is fetched
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no item is met; rows without an id are kept, as nothing can name them."""
    met = find_benchmark(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("_met")).distinct()
    return docs.join(met, docs[id_col] == met["_met"], "left_anti")


def decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ANN001
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))
