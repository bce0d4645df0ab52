"""Token counts that follow edits, by a segment tree of pre-tokens for each document.

The leaves of a tree are short runs of pre-tokens with their token counts; every node above holds the
characters and tokens below it. An edit is found by descending the sums of characters. Only the pre-tokens
that it touches, with as much context as the pattern can see, are split and encoded anew, until a boundary
falls on an old one; then the sums on the way to the root are updated. Token counts of new pre-tokens are
asked for together, a chunk of documents at a time, and then enter the sums.

Trees can be kept: tree_table() makes a table of them and edit_trees() brings it up to date, without
splitting or encoding what the edits do not touch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutroom.llm.bpe import Encoder, encoder, pieces
from cutroom.session import ship

#: Pre-tokens of a leaf when a tree is built; a leaf with more than SPLIT times as many has the tree built anew.
LEAF = 64
SPLIT = 16
#: Characters past a match that the pattern may look at, white space aside: contractions have three.
LOOK_AHEAD = 3

EDIT = "struct<start: int, stop: int, text: string>"


class Counter(dict):
    """Token counts of pre-tokens, kept by pre-token."""

    def __init__(self, coder: Encoder, entries: int = 150_000):
        super().__init__()
        self.coder, self.entries = coder, entries

    def split(self, text: str) -> list[str]:
        return self.coder.split(text)

    def learn(self, parts: Iterable[str]) -> None:
        """Counts of those that are not known yet, merged all at once."""
        new = [p for p in set(parts) if p not in self]
        if new:
            self.update(zip(new, map(len, self.coder.merge([p.encode("utf-8", "replace") for p in new])), strict=True))

    def rest(self) -> None:
        """Between chunks: forget all where too many are held."""
        if len(self) > self.entries:
            self.clear()


class Tree:
    """Pre-tokens of one text under sums of characters and tokens; after edits, recount() brings the tokens up to date."""

    def __init__(self, parts: list[str], counts: list[int], split: Callable[[str], list[str]]):
        self.split = split
        self.encoded = 0  # pre-tokens encoded since the tree was built first
        self._build(parts, counts)

    def _build(self, parts: list[str], counts: list[int | None]) -> None:
        self.leaves = [(parts[a : a + LEAF], counts[a : a + LEAF]) for a in range(0, max(1, len(parts)), LEAF)]
        self.stale = {i for i, (_, held) in enumerate(self.leaves) if None in held}
        self.width = 1
        while self.width < len(self.leaves):
            self.width *= 2
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (held, counted) in enumerate(self.leaves):
            self.chars[self.width + i] = sum(map(len, held))
            self.tokens[self.width + i] = 0 if i in self.stale else sum(counted)
        for sums in (self.chars, self.tokens):
            for node in range(self.width - 1, 0, -1):
                sums[node] = sums[2 * node] + sums[2 * node + 1]

    def unknown(self) -> Iterator[str]:
        """Pre-tokens whose counts are asked for."""
        for i in self.stale:
            yield from (p for p, n in zip(*self.leaves[i], strict=True) if n is None)

    def recount(self, counter: Counter) -> None:
        """Fill in the counts of new pre-tokens and the sums above them."""
        for i in self.stale:
            parts, counts = self.leaves[i]
            counts = [counter[p] if n is None else n for p, n in zip(parts, counts, strict=True)]
            self.leaves[i] = (parts, counts)
            self.tokens[self.width + i] = sum(counts)
        above = {(self.width + i) // 2 for i in self.stale}
        while above - {0}:
            for node in above - {0}:
                self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            above = {node // 2 for node in above - {0}}
        self.stale = set()

    def _update(self, leaves: range) -> None:
        """Characters of the leaves and of what stands above them, each node once; their tokens wait for recount()."""
        self.stale.update(leaves)
        for i in leaves:
            self.chars[self.width + i] = sum(map(len, self.leaves[i][0]))
        low, high = (self.width + leaves.start) // 2, (self.width + leaves.stop - 1) // 2
        while low:
            for node in range(low, high + 1):
                self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            low, high = low // 2, high // 2

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(p for parts, _ in self.leaves for p in parts)

    def parts(self) -> list[tuple[int, int]]:
        """Characters and tokens of every pre-token."""
        return [(len(p), n) for parts, counts in self.leaves for p, n in zip(parts, counts, strict=True)]

    def _locate(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf starts; the last leaf for the end of the text."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if char - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def _before(self, char: int) -> tuple[int, int, int]:
        """(leaf, piece, its first character) from which pre-tokens must be split anew for a change at char."""
        leaf, start = self._locate(max(0, char))
        seen = False  # whether what lies between here and the change has something besides white space
        pieces = self.leaves[leaf][0]
        k, at = 0, start
        while k < len(pieces) and at + len(pieces[k]) <= char:
            at += len(pieces[k])
            k += 1
        # here piece k holds the change; step back until a boundary is out of the pattern's sight
        while True:
            if at + LOOK_AHEAD <= char and seen:
                return leaf, k, at
            if k == 0:
                if leaf == 0:
                    return 0, 0, 0
                leaf -= 1
                while not self.leaves[leaf][0] and leaf:
                    leaf -= 1
                pieces = self.leaves[leaf][0]
                k = len(pieces)
                if not k:
                    return 0, 0, 0
            k -= 1
            at -= len(pieces[k])
            seen = seen or not pieces[k].isspace()

    def edit(self, start: int, stop: int, text: str) -> None:
        """Replace characters start to stop (bounds beyond the text are cut) by text."""
        start = min(max(0, start), self.n_chars)
        stop = min(max(start, stop), self.n_chars)
        leaf, k, at = self._before(start)
        # old pre-tokens from there on, taken up as they are needed
        last, skip = leaf, k
        held: list[str] = list(self.leaves[leaf][0][k:])
        reach = at + sum(map(len, held))
        want = stop + 8
        while True:
            while reach < want and last + 1 < len(self.leaves):
                last += 1
                held += self.leaves[last][0]
                reach = at + sum(map(len, held))
            whole = last + 1 >= len(self.leaves)
            old = "".join(held)
            new = old[: start - at] + text + old[stop - at :]
            pieces = self.split(new)
            # a boundary behind the change that falls on an old one, with enough text after it that the split is settled
            shift = len(text) - (stop - start)
            marks, place = set(), at
            for piece in held:
                if place >= stop:
                    marks.add(place + shift)
                place += len(piece)
            place, agreed, limit = at, None, at + len(new) - LOOK_AHEAD
            for n, piece in enumerate(pieces):
                if place in marks and (whole or place + len(piece) <= limit and n < len(pieces) - 2 and not piece.isspace()):
                    agreed = (n, place - shift)
                    break
                place += len(piece)
            if agreed:
                n, old_at = agreed
                pieces = pieces[:n]
                # the old pre-tokens from old_at on stay
                place, kept = at, len(held)
                for j, piece in enumerate(held):
                    if place == old_at:
                        kept = j
                        break
                    place += len(piece)
                fresh, tail = n, kept
                break
            if whole:
                fresh, tail = len(pieces), len(held)
                break
            want = reach + (reach - at)
        self.encoded += fresh
        head = self.leaves[leaf]
        counts = [n for i in range(leaf, last + 1) for n in self.leaves[i][1]][skip:]
        # what the leaves between held now stands in the first one; pre-tokens behind the change keep their counts
        self.leaves[leaf] = first = (head[0][:skip] + pieces[:fresh] + held[tail:], head[1][:skip] + [None] * fresh + counts[tail:])
        for i in range(leaf + 1, last + 1):
            self.leaves[i] = ([], [])
        if len(first[0]) > SPLIT * LEAF:
            self._build([p for parts, _ in self.leaves for p in parts], [n for _, held_counts in self.leaves for n in held_counts])
        else:
            self._update(range(leaf, last + 1))


def _edit_all(trees: list[Tree], edits: Iterable[list], counter: Counter) -> None:
    """Apply the edits of each tree, in order, and count what is new in all of them together."""
    for tree, todo in zip(trees, edits, strict=True):
        for edit in todo:
            edit = edit or {}
            tree.edit(edit.get("start") or 0, edit.get("stop") or 0, edit.get("text") or "")
    counter.learn(chain.from_iterable(tree.unknown() for tree in trees))
    for tree in trees:
        tree.recount(counter)


def _grown(texts: list[str], counter: Counter) -> list[Tree]:
    """Trees of whole texts."""
    split = [counter.split(text) for text in texts]
    counter.learn(chain.from_iterable(split))
    return [Tree(parts, [counter[p] for p in parts], counter.split) for parts in split]


def count_edited(
    docs: DataFrame, edits: Column | Callable[[str], list[dict]], path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token counts of every whole text before and after its edits, by a tree of each text.

    edits: an array of (start, stop, text), or a function that makes a list of such from the text; they are
    applied in order, each to the text the ones before left; places are characters, cut to the text. Returns
    one row per input row: id_col as it is, n_tokens (before), n_edits, n_tokens_after, n_chars_after,
    n_encoded (pre-tokens that the edits had encoded anew). A null text is an empty one; null edits, null
    places and null replacements are none, 0 and empty. Repeated rows are counted each; other columns are
    ignored.
    """
    ship(docs.sparkSession)
    find = edits if callable(edits) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(encoder(path, pattern))
        for batch in batches:
            done = 0
            for texts in pieces(text.as_py() or "" for text in batch.column("text")):
                counter.rest()
                trees = _grown(texts, counter)
                before = [tree.n_tokens for tree in trees]
                todo = [find(t) for t in texts] if find else [e.as_py() or [] for e in batch.column("edits").slice(done, len(texts))]
                _edit_all(trees, todo, counter)
                columns = (before, map(len, todo), [t.n_tokens for t in trees], [t.n_chars for t in trees], [t.encoded for t in trees])
                names = ["n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "n_encoded"]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(done, len(texts)), *(pa.array(list(c), pa.int64()) for c in columns)], ["id", *names])
                done += len(texts)

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_tokens long, n_edits long, n_tokens_after long, n_chars_after long, n_encoded long"
    asked = [] if find else [edits.cast(f"array<{EDIT}>").alias("edits")]
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *asked).mapInArrow(run, schema).withColumnRenamed("id", id_col)


_TREE = "text string, part_chars array<int>, part_tokens array<int>, n_tokens long, n_encoded long"


def _tree_batch(ids: pa.Array, trees: list[Tree]) -> pa.RecordBatch:
    parts = [np.array(tree.parts(), np.int32).reshape(-1, 2) for tree in trees]
    columns = [
        pa.array([t.text() for t in trees], pa.string()), pa.array([p[:, 0] for p in parts], pa.list_(pa.int32())), pa.array([p[:, 1] for p in parts], pa.list_(pa.int32())),
        pa.array([t.n_tokens for t in trees], pa.int64()), pa.array([t.encoded for t in trees], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays([ids, *columns], ["id", "text", "part_chars", "part_tokens", "n_tokens", "n_encoded"])


def tree_table(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A tree of every whole text, to be kept and edited later: id_col, text, the characters and tokens of its
    pre-tokens in order, n_tokens and n_encoded (0). A null text is an empty one; repeated rows have a tree each."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(encoder(path, pattern))
        for batch in batches:
            done = 0
            for texts in pieces(text.as_py() or "" for text in batch.column("text")):
                counter.rest()
                yield _tree_batch(batch.column("id").slice(done, len(texts)), _grown(texts, counter))
                done += len(texts)

    kind = dict(docs.dtypes)[id_col]
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, {_TREE}").withColumnRenamed("id", id_col)


def edit_trees(trees: DataFrame, edits: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """The trees after their edits, where only what those touch is split and encoded again (n_encoded says how much).

    trees: of tree_table() or of an earlier call. edits: one row an id with an array ``edits`` of (start, stop,
    text); ids without a row, and null edits, leave the tree as it is with n_encoded 0.
    """
    ship(trees.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(encoder(path, pattern))
        for batch in batches:
            done = 0
            for texts in pieces(text.as_py() or "" for text in batch.column("text")):
                counter.rest()
                some = batch.slice(done, len(texts))
                grown = []
                for text, chars, tokens in zip(texts, some.column("part_chars").to_pylist(), some.column("part_tokens").to_pylist(), strict=True):
                    ends = list(accumulate(chars))
                    grown.append(Tree([text[b - n : b] for b, n in zip(ends, chars, strict=True)], tokens, counter.split))
                _edit_all(grown, [e.as_py() or [] for e in some.column("edits")], counter)
                yield _tree_batch(some.column("id"), grown)
                done += len(texts)

    kind = dict(trees.dtypes)[id_col]
    new = edits.select(F.col(id_col).alias("_id"), F.col("edits").cast(f"array<{EDIT}>").alias("edits"))
    rows = trees.join(new, F.col(id_col) == F.col("_id"), "left").select(F.col(id_col).alias("id"), "text", "part_chars", "part_tokens", "edits")
    return rows.mapInArrow(run, f"id {kind}, {_TREE}").withColumnRenamed("id", id_col)
