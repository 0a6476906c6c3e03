"""Stateless sample points: a value depends on its key only.

A stateful ``rand`` ties values to partition layout and stops Catalyst from
moving filters below it. Hashing the key gives the same numbers on every retry
and under every partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def uniform_from(key: Column, seed: int) -> Column:
    """Uniform double in [0, 1) from a 64-bit hash of ``key`` and ``seed``."""
    top_bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11)
    return top_bits.cast("double") * F.lit(2.0**-53)


def uniform_from_digest(text: Column, axis: str) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of an MD5 digest.

    Slower than :func:`uniform_from`, but any SQL engine can reproduce it.
    """
    digest = F.md5(F.concat_ws("/", text, F.lit(axis)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def radical_inverse(index: Column, base: int) -> Column:
    """Van der Corput value of a non-negative integer: its digits mirrored at the point.

    Numerator and denominator are whole numbers, so the one division is the
    correctly rounded answer while both stay under 2**53.
    """
    digits = F.conv(index.cast("string"), 10, base)
    mirrored = F.conv(F.reverse(digits), base, 10).cast("double")
    return mirrored / F.pow(F.lit(float(base)), F.length(digits).cast("double"))
