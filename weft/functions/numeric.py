"""Bit arithmetic and hashes of integers; a null argument gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..columns import to_column


def bit_and(a, b) -> Column:
    return to_column(a).bitwiseAND(to_column(b))


def bit_or(a, b) -> Column:
    return to_column(a).bitwiseOR(to_column(b))


def bit_xor(a, b) -> Column:
    return to_column(a).bitwiseXOR(to_column(b))


def bit_hamming_distance(a, b) -> Column:
    return F.bit_count(to_column(a).cast("long").bitwiseXOR(to_column(b).cast("long"))).cast("long")


def shift_left(a, n: int) -> Column:
    return F.shiftleft(to_column(a).cast("long"), n)


def shift_right(a, n: int) -> Column:
    return F.shiftright(to_column(a).cast("long"), n)


def floor_divide(a, b) -> Column:
    """Whole quotient, towards zero; zero as divisor raises."""
    return F.call_function("div", to_column(a), to_column(b))


_LOW = 0xFFFFFFFF


def _multiply(x: Column, k: int) -> Column:
    """x * k modulo 2**64 without an overflow that ANSI mode would raise: limbs of 16 and 32 bits."""
    low_k, high_k = F.lit(k & _LOW), F.lit(k >> 32)
    limb = [F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    low, high = F.lit(0), F.lit(0)
    for i, c, half in ((0, low_k, 0), (1, low_k, 0), (2, low_k, 1), (3, low_k, 1), (0, high_k, 1), (1, high_k, 1)):
        shift = 16 * (i % 2)
        product = limb[i] * c  # below 2**48
        if half:
            high = high + F.shiftleft(product, shift).bitwiseAND(F.lit(_LOW))
        else:
            low = low + F.shiftleft(product, shift).bitwiseAND(F.lit(_LOW))
            high = high + F.shiftrightunsigned(product, 32 - shift)
    return F.shiftleft((high + F.shiftrightunsigned(low, 32)).bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def int_hash_64(col) -> Column:
    """The 64-bit finaliser of MurmurHash3, as a signed integer; the first shift keeps the sign."""
    x = to_column(col).cast("long")
    x = _multiply(x.bitwiseXOR(F.shiftright(x, 33)), 0xFF51AFD7ED558CCD)
    x = _multiply(x.bitwiseXOR(F.shiftrightunsigned(x, 33)), 0xC4CEB9FE1A85EC53)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 33))
