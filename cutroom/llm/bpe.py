"""Byte-level BPE by ranks, with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte runs. Every adjacent pair that a rank exists for is posted in
that rank's bucket; a three-level bitmap of ranks gives the least occupied one by find-first-set, and
entries whose pair has changed meanwhile are skipped. The list of one queue holds all pre-tokens of a
piece of text that have not been met before, with breaks between them: the least rank of all is the
least rank of every list that has it, and a merge of rank r never makes another pair of rank r (the
pair's bytes are longer), so a bucket is merged at once. The cost is a few array operations a rank and
O(1) a byte and merge, whatever the lengths, so very long pre-tokens take no longer a byte.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cutroom.session import ship

CACHE_ENTRIES = 150_000
CACHE_LENGTH = 48
#: Characters of texts that are encoded together: a queue costs a run over the ranks that it meets, so that a few large ones cost less.
CHUNK_CHARS = 2_000_000
#: What an encoder may return for each document, and its type.
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Buckets of list positions by rank, under 64-way bitmaps; the least rank comes first."""

    def __init__(self, size: int):
        self.levels = []
        while True:
            size = (size + 63) >> 6
            self.levels.append([0] * size)
            if size == 1:
                break
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            at, bit = rank >> 6, 1 << (rank & 63)
            before = level[at]
            level[at] = before | bit
            if before:
                break
            rank = at

    def pop(self) -> tuple[int, np.ndarray] | None:
        """Least rank and its positions in order."""
        if not self.levels[-1][0]:
            return None
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = (rank << 6) | ((word & -word).bit_length() - 1)
        at = rank
        for level in self.levels:
            place, bit = at >> 6, 1 << (at & 63)
            level[place] &= ~bit
            if level[place]:
                break
            at = place
        bucket = self.buckets.pop(rank)
        if len(bucket) == 1 and len(bucket[0]) == 1:
            return rank, bucket[0]
        return rank, np.unique(bucket[0] if len(bucket) == 1 else np.concatenate(bucket))

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Post each position under its rank; those below zero have none."""
        has = ranks >= 0
        ranks, positions = ranks[has], positions[has]
        if len(ranks):
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            firsts = ranks[np.concatenate([[0], cuts])].tolist()
            cuts = [0, *cuts.tolist(), len(ranks)]
            for k, rank in enumerate(firsts):
                self.push(rank, positions[cuts[k] : cuts[k + 1]])


class Encoder(dict):
    """Ids of the pre-tokens met so far; decode() is the inverse of encode()."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        super().__init__()
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.width = max(ranks.values()) + 2  # the last id stands for the end of a list
        self.token = [b""] * self.width
        for token, rank in ranks.items():
            self.token[rank] = token
        self.names = [str(i) for i in range(self.width)]
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, -1 for none."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.pair_ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pre-tokens: one with a rank is itself, the rest merge in order of rank, then place."""
        out = [(rank,) if (rank := self.ranks.get(piece)) is not None else () for piece in pieces]
        rest = [i for i, piece in enumerate(pieces) if piece and not out[i]]
        if not rest:
            return out
        data = np.frombuffer(b"".join([pieces[i] for i in rest]), np.uint8)
        ends = np.cumsum([len(pieces[i]) for i in rest])
        n = len(data)
        starts = np.concatenate([[0], ends[:-1]])
        ids = np.append(self.byte[data], self.width - 1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1], before[starts] = n, n
        alive = np.ones(n, bool)
        pair = np.append(self.rank_of(ids[:n], ids[after[:n]]), -1)
        queue = RankQueue(self.width)
        queue.push_all(pair[:n], np.arange(n))
        while (least := queue.pop()) is not None:
            rank, at = least
            at = at[pair[at] == rank]  # the rest are stale
            if len(at) > 1 and (touch := at[1:] == after[at[:-1]]).any():  # runs like aaaa: every other pair
                first = np.concatenate([[True], ~touch])
                order = np.arange(len(at))
                at = at[(order - np.maximum.accumulate(np.where(first, order, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            end = after[gone]
            ids[at], after[at], before[end] = rank, end, at
            alive[gone], pair[gone] = False, -1
            left = before[at]
            left = left[left < n]
            touched = np.concatenate([at, left])
            ranks = self.rank_of(ids[touched], ids[after[touched]])
            pair[touched] = ranks
            queue.push_all(ranks, touched)
        kept = ids[:n][alive].tolist()
        cuts = [0, *np.cumsum(alive)[ends - 1].tolist()]
        for k, i in enumerate(rest):
            out[i] = tuple(kept[cuts[k] : cuts[k + 1]])
        return out

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts, special tokens being ordinary text."""
        split = [self.split(text) for text in texts]
        if len(self) > CACHE_ENTRIES:
            self.clear()
        new = [piece for piece in set().union(*split) if piece not in self]
        self.update(zip(new, self.merge([piece.encode("utf-8", "replace") for piece in new]), strict=True))
        ids = [list(chain.from_iterable(map(self.__getitem__, pieces))) for pieces in split]
        for piece in new:
            if len(piece) > CACHE_LENGTH:
                del self[piece]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_loaded: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file, one to a process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Encoder(read_ranks(path), pattern)
    return _loaded[path, pattern]


def pieces(texts: Iterable[str], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """The texts in lists of about limit characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_documents(
    docs: DataFrame, path: str, pattern: str, outputs: tuple[str, ...] = ("n_tokens", "ids"), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every whole text, and decode its ids again where an output asks for it.

    path: a rank file that every executor has, or that SparkContext.addFile has sent under that name.
    Returns one row per input row: id_col as it is (null included) and the outputs, of OUTPUTS. A null
    text is an empty one: no tokens. Lone surrogates count as "?". Repeated rows are encoded each; other
    columns are ignored.
    """
    ship(docs.sparkSession)
    columns = list(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded": pa.binary(), "decoded_sha256": pa.string()}
        for batch in batches:
            done = 0
            for some in pieces(text.as_py() or "" for text in batch.column("text")):
                rows: dict[str, list] = {name: [] for name in columns}
                for ids in coder.encode_all(some):
                    back = coder.decode(ids) if {"decoded", "decoded_sha256"} & rows.keys() else b""
                    for name, kept in rows.items():
                        if name == "n_tokens":
                            kept.append(len(ids))
                        elif name == "ids":
                            kept.append(np.array(ids, np.int32))
                        elif name == "ids_sha256":
                            kept.append(hashlib.sha256(",".join(map(coder.names.__getitem__, ids)).encode()).hexdigest())
                        elif name == "decoded":
                            kept.append(back)
                        else:
                            kept.append(hashlib.sha256(back).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(done, len(some)), *(pa.array(rows[c], types[c]) for c in columns)], ["id", *columns])
                done += len(some)
        coder.clear()  # the process lives on for other stages

    kind = dict(docs.dtypes)[id_col]
    schema = ", ".join([f"id {kind}", *(f"{c} {OUTPUTS[c]}" for c in columns)])
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
