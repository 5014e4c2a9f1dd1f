"""Bit expressions over BIGINT columns, all inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The clamp of buckets in contexts, a fixed value.
CONTEXT_CLAMP = 16


def zigzag(v: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1).cast("long")))


def bucket(u: Column) -> Column:
    """Position of the highest bit; 0 for 0."""
    return F.when(u == 0, F.lit(0)).otherwise(F.length(F.bin(u))).cast("long")


def context(k1: Column, k2: Column) -> Column:
    """The two buckets before, clamped, as one number."""
    clamp = F.lit(CONTEXT_CLAMP).cast("long")
    return F.least(k1, clamp) * (CONTEXT_CLAMP + 1) + F.least(k2, clamp)


def slot(v: Column) -> Column:
    """For v of 1 or more the floor of its logarithm to base 2."""
    return (F.length(F.bin(v)) - 1).cast("long")


def slot_rest(v: Column) -> Column:
    return v - F.pow(F.lit(2), slot(v)).cast("long")


def varint_length(v: Column) -> Column:
    """Bytes of v in base 128."""
    return F.greatest(F.lit(1), F.ceil(bucket(v) / 7)).cast("long")


def rice_length(u: Column, k: int) -> Column:
    """Bits of a Rice code with parameter k."""
    return F.shiftrightunsigned(u, k) + 1 + k


def varint(v: Column) -> Column:
    """v, which isn't negative, as bytes of seven bits, low ones first; the high bit tells that more follow."""
    groups = F.sequence(F.lit(0), (varint_length(v) - 1).cast("int"))
    byte = lambda k: F.call_function("shiftrightunsigned", v, 7 * k).bitwiseAND(F.lit(127).cast("long"))
    last = (varint_length(v) - 1).cast("int")
    hexed = F.transform(groups, lambda k: F.lpad(F.hex(byte(k) + F.when(k < last, F.lit(128)).otherwise(F.lit(0))), 2, "0"))
    return F.unhex(F.array_join(hexed, ""))


def unvarint(b: Column) -> Column:
    """The number that such bytes tell."""
    at = F.sequence(F.lit(0), F.length(b) - 1)
    byte = lambda k: F.conv(F.substring(F.hex(b), 2 * k + 1, F.lit(2)), 16, 10).cast("long").bitwiseAND(F.lit(127).cast("long"))
    return F.aggregate(at, F.lit(0).cast("long"), lambda t, k: t.bitwiseOR(F.call_function("shiftleft", byte(k), 7 * k)))
