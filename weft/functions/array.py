"""Arrays and vectors; positions count from 0."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..columns import to_column


def _vector(v) -> Column:
    return F.lit([float(x) for x in v]) if isinstance(v, (list, tuple, np.ndarray)) else to_column(v)


def _checked(a, b) -> tuple[Column, Column]:
    if all(isinstance(v, (list, tuple, np.ndarray)) for v in (a, b)) and len(a) != len(b):
        raise ValueError("vectors of different lengths")
    doubles = lambda v: F.transform(_vector(v), lambda x: x.cast("double"))
    return doubles(a), doubles(b)


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)


def cosine_distance(a, b) -> Column:
    """1 - cosine, within [0, 2]; in double precision and JVM-side. Null if a vector is zero."""
    x, y = _checked(a, b)
    cosine = F.try_divide(_dot(x, y), F.sqrt(_dot(x, x) * _dot(y, y)))
    return F.when(cosine.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - cosine)))


def euclidean_distance(a, b) -> Column:
    x, y = _checked(a, b)
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, z: s + z))


def length(arr) -> Column:
    return F.size(to_column(arr)).cast("long")


def contains(arr, elem) -> Column:
    """1 or 0."""
    return F.array_contains(to_column(arr), to_column(elem, names=False)).cast("int")


def slice(arr, offset: int, length: int | None = None) -> Column:
    """As ``arr[offset:offset + length]``; out of range is empty."""
    a = to_column(arr)
    n = F.size(a)
    start = F.lit(offset) if offset >= 0 else F.greatest(F.lit(0), n + offset)
    most = F.greatest(F.lit(0), n - start)
    return F.slice(a, start + 1, most if length is None else F.least(most, F.lit(max(0, length))))


def join(arr, sep: str = "") -> Column:
    return F.array_join(to_column(arr), sep)


def get_element(arr, index: int) -> Column:
    """Null out of range; negative positions count from the end."""
    a = to_column(arr)
    return F.get(a, F.lit(index)) if index >= 0 else F.try_element_at(a, F.lit(index))


def _siphash(key: bytes, data: bytes) -> int:
    """SipHash-2-4 (Aumasson and Bernstein, 2012)."""
    mask = (1 << 64) - 1
    k0, k1 = (int.from_bytes(key[i : i + 8], "little") for i in (0, 8))
    v = [k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573]
    turn = lambda x, n: ((x << n) | (x >> (64 - n))) & mask

    def rounds(n):
        for _ in range(n):
            v[0] = (v[0] + v[1]) & mask
            v[1] = turn(v[1], 13) ^ v[0]
            v[0] = turn(v[0], 32)
            v[2] = (v[2] + v[3]) & mask
            v[3] = turn(v[3], 16) ^ v[2]
            v[0] = (v[0] + v[3]) & mask
            v[3] = turn(v[3], 21) ^ v[0]
            v[2] = (v[2] + v[1]) & mask
            v[1] = turn(v[1], 17) ^ v[2]
            v[2] = turn(v[2], 32)

    whole = data + b"\0" * (7 - len(data) % 8) + bytes([len(data) & 255])
    for i in range(0, len(whole), 8):
        m = int.from_bytes(whole[i : i + 8], "little")
        v[3] ^= m
        rounds(2)
        v[0] ^= m
    v[2] ^= 0xFF
    rounds(4)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def sip_hash_64(arr) -> Column:
    """SipHash-2-4 under a zero key of the elements' text, each ended by a zero byte; a signed integer."""

    @F.pandas_udf("long")
    def digest(parts: pd.Series) -> pd.Series:
        def one(p):
            if p is None:
                return None
            h = _siphash(bytes(16), b"".join(str(x).encode() + b"\0" for x in p))
            return h - (1 << 64) if h >> 63 else h

        return pd.Series([one(p) for p in parts], dtype="Int64")

    return digest(F.transform(to_column(arr), lambda x: x.cast("string")))
