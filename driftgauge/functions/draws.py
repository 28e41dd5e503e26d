"""Uniform numbers that depend on a seed, a tag and a counter alone.

They come from MD5, which every engine has: a sample can be drawn again, and
checked elsewhere, whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Bits of a number that a rank is drawn with: as many as a long holds in whole hexadecimal digits.
WIDE_BITS = 60
_HALF = WIDE_BITS // 2


def _leading(text: Column, digits: int) -> Column:
    """The first hexadecimal digits of the text's MD5, as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def md5_u32(text: Column) -> Column:
    """The first 32 bits of the text's MD5, as a long."""
    return _leading(text, 8)


def _label(seed, tag: str, counter: Column) -> Column:
    return F.concat(F.lit(f"{seed}|{tag}|"), counter.cast("string"))


def u32(seed, tag: str, counter: Column) -> Column:
    """A uniform 32-bit number of (seed, tag, counter), for chances."""
    return md5_u32(_label(seed, tag, counter))


def u60(seed, tag: str, counter: Column) -> Column:
    """A uniform 60-bit number of (seed, tag, counter), for ranks: 2^32 numbers would not reach every row of a large table."""
    return _leading(_label(seed, tag, counter), WIDE_BITS // 4)


def below(u: Column, width: Column) -> Column:
    """floor(u / 2^60 * width) exactly, for widths up to 2^60: a product of halves, as a long holds no more."""
    half = F.lit((1 << _HALF) - 1)
    split = lambda x: (F.shiftright(x, _HALF), x.bitwiseAND(half))
    (uh, ul), (wh, wl) = split(u), split(width.cast("long"))
    middle = uh * wl + ul * wh + F.shiftright(ul * wl, _HALF)
    return uh * wh + F.shiftright(middle, _HALF)


def unit(u: Column) -> Column:
    """A 32-bit number as a double in [0, 1)."""
    return u / F.lit(float(1 << 32))


def hash_block(key: Column, modulus: int = 100_000, blocks: int = 100_000) -> Column:
    """The block of a key in universe sampling: (md5 bits mod modulus) / modulus * blocks, rounded down."""
    return F.floor((md5_u32(key.cast("string")) % modulus) / F.lit(float(modulus)) * blocks).cast("int")
