"""Bit strings: texts of 0 and 1, as Spark has no such type.

Operands of the two-sided operators have equal lengths; otherwise the result is
null, where the reference raises an error. Shifts keep the length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits_of(number: Column, width: int) -> Column:
    """The low bits of a whole number."""
    return F.right(F.lpad(F.bin(number.cast("long")), max(width, 64), "0"), F.lit(width))


def bits_to_long(bits: Column) -> Column:
    """A bit string of at most 64 bits as a signed number."""
    return F.conv(F.lpad(bits, 64, "0"), 2, -10).cast("long")


def hex_to_long(digits: Column) -> Column:
    """A hexadecimal text of at most 16 digits, as its bits make a signed number."""
    return F.conv(digits, 16, -10).cast("long")


def _both(a: Column, b: Column, fn) -> Column:
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(fn(x == "1", y == "1"), "1").otherwise("0"))
    return F.when(F.length(a) == F.length(b), F.array_join(pairs, ""))


def bit_and(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x & y)


def bit_or(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x | y)


def bit_xor(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x != y)


def bit_not(a: Column) -> Column:
    return F.translate(a, "01", "10")


def shift_left(a: Column, n: int) -> Column:
    return F.rpad(F.substring(a, n + 1, 1 << 30), F.length(a), F.lit("0"))


def shift_right(a: Column, n: int) -> Column:
    kept = F.greatest(F.length(a) - n, F.lit(0))
    return F.lpad(F.substring(a, F.lit(1), kept), F.length(a), F.lit("0"))


def get_bit(a: Column, n: int) -> Column:
    """The n-th bit from the left, counted from 0."""
    return F.substring(a, n + 1, 1).cast("int")


def set_bit(a: Column, n: int, to: int) -> Column:
    return F.concat(F.substring(a, 1, n), F.lit(str(to)), F.substring(a, n + 2, 1 << 30))


def bit_count(a: Column) -> Column:
    return F.length(F.replace(a, F.lit("0"), F.lit("")))
