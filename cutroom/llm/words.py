"""Words of a text, their 64-bit hashes and shingles, for whole batches of documents at a time.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text. Hashes are polynomial over
a random byte table, then mixed; they depend on the bytes alone, never on the process.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK_BYTES = 512 << 10
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MUL = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _byte_table(lower: bool) -> np.ndarray:
    byte = np.arange(256)
    if lower:
        byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    table = mix((byte.astype(np.uint64) + np.uint64(1)) * _MUL)
    table[_SPACE] = 0
    return table


_TABLES = {False: _byte_table(False), True: _byte_table(True)}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, CHUNK_BYTES * 2)
        base = np.uint64(0xBF58476D1CE4E5B9)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        for name, p in (("up", base), ("down", inverse)):
            steps = np.full(size, p, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def chunks(texts: Iterable[str | bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 texts) in pieces of about limit bytes; a text is never split."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text if isinstance(text, bytes) else b"" if text is None else text.encode("utf-8", "replace"))
        size += len(held[-1]) + 1
        if size >= limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


class Words:
    """The words of a chunk of texts: start, end (bytes in buf), hash, and bounds[i]:bounds[i+1] of text i."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(joined, np.uint8)
        self.raw = joined
        space = _SPACE[self.buf]
        edge = np.empty(len(space), bool)
        edge[0] = ~space[0]
        np.not_equal(space[1:], space[:-1], out=edge[1:])
        at = np.flatnonzero(edge)
        self.start, self.end = at[0::2], at[1::2]
        up, down = _power_table(len(self.buf) + 1)
        sums = _TABLES[lower][self.buf]
        sums *= up[: len(sums)]
        np.cumsum(sums, out=sums)
        begin = np.where(self.start > 0, sums[self.start - 1], np.uint64(0))
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mix((sums[self.end - 1] - begin) * down[self.start] + length * _MUL)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.bounds = np.concatenate([[0], np.searchsorted(self.start, ends)])

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the k words from each position on; meaningless for the last k - 1 positions of a text."""
        return rolled(self.hash, k)


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of hashes[i : i + k] for each i; the last k - 1 are padded with zeros."""
    out = np.zeros(len(hashes), np.uint64)
    n = len(hashes) - k + 1
    if n > 0:
        acc = hashes[:n].copy()
        for j in range(1, k):
            acc *= np.uint64(0x94D049BB133111EB)
            acc += hashes[j : j + n]
        out[:n] = mix(acc)
    return out


def set_of(hashes: np.ndarray, k: int, rolled_hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct k-word shingles of one text; the whole sequence as one where it is shorter."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < k:
        return rolled(hashes, n)[:1] ^ np.uint64(n)
    return np.unique(rolled_hashes[: n - k + 1])


def grams_of(words: dict[str, int], longest: int) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(length, grams, counts) for lengths from 1 to longest over words between spaces, a word counted as often as it says.

    Lengths that no word has a gram of are left out.
    """
    if not words:
        return
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, code = np.unique(codes, return_inverse=True)
    code = code.astype(np.uint64)
    space = codes == 32
    # a space belongs to the word after it; a gram, to the word of its first character
    weight = np.append(np.fromiter(words.values(), np.int64, len(words)), 0)[np.cumsum(space) - 1]
    bits = int(len(letters)).bit_length()
    key, held = code, bits
    inside = np.zeros(len(codes), bool)
    for size in range(1, longest + 1):
        n = len(codes) - size + 1
        if n < 1:
            return
        if size > 1:
            if held + bits > 64:  # more letters than fit: number the shorter grams
                met, key = np.unique(key, return_inverse=True)
                key, held = key.astype(np.uint64), len(met).bit_length()
            key, held = (key[:n] << np.uint64(bits)) | code[size - 1 : size - 1 + n], held + bits
        if size > 2:
            inside = inside[:n] | space[size - 2 : size - 2 + n]
        keep = np.flatnonzero(~inside[:n] & (weight[:n] > 0))
        if not len(keep):
            continue
        own = key[keep]
        order = np.argsort(own)
        own = own[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        text = codes[keep[order[first]][:, None] + np.arange(size)].tobytes().decode("utf-32-le", "surrogatepass")
        yield size, [text[i : i + size] for i in range(0, len(text), size)], np.add.reduceat(weight[keep[order]], first)


def integer_id(df, name: str):  # noqa: ANN001, ANN201
    """A table's id column as long; ids that are no whole numbers are refused rather than lost."""
    kind = dict(df.dtypes)[name]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{name} must hold whole numbers, not {kind}")
    return df[name].cast("long")
