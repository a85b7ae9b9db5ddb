"""Portable random numbers as columns.

Randomised analytics draw from a hash of (id, round), so a run can be repeated
exactly on any engine that has MD5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*parts: Column) -> Column:
    """First 32 bits of the MD5 of the parts joined by ``:``, as a long."""
    digest = F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1)."""
    return hash32(*parts) / F.lit(float(1 << 32))


def geometric(*parts: Column) -> Column:
    """Trailing zero bits of the hash: k with probability 2**-(k+1); 31 if the hash is zero."""
    h = hash32(*parts)
    return F.when(h == 0, 31).otherwise(F.bit_count(h.bitwiseAND(-h) - 1)).cast("int")


def lowest_zero(mask: Column) -> Column:
    """Place of the lowest bit that is not set in a long."""
    return F.bit_count((F.bitwise_not(mask)).bitwiseAND(mask + 1) - 1)
