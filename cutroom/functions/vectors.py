"""Vectors held as arrays, as column expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null for vectors of different lengths, and where one is zero."""
    size = lambda v: F.size(_doubles(v))
    scale = norm(a) * norm(b)
    return F.when((size(a) == size(b)) & (scale > 0), dot(a, b) / scale)


def sound(v: Column | str, n: int | None = None) -> Column:
    """Whether a vector is there, finite and, if asked, of length n."""
    ok = _doubles(v).isNotNull() & F.forall(_doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok if n is None else ok & (F.size(_doubles(v)) == n), F.lit(False))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit hashes differ."""
    return F.bit_count(a.bitwiseXOR(b))
