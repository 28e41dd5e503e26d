"""The reference's hashes of whole numbers, so that values and hash partitions agree.

They are the final mix of Bob Jenkins' lookup3 (public domain) on one 32-bit
word, in long arithmetic modulo 2^32. :func:`mix_sql` writes the same steps as
SQL, for engines without the function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The golden ratio, what is added to it for a word of four bytes, and the rotations of the final mix.
GOLDEN, ADDED = 0x9E3779B9, 4 + 3923095
ROTATIONS = (14, 11, 25, 16, 4, 14, 24)
_MASK = (1 << 32) - 1


def _mixed(word: Column) -> Column:
    """Signed 32-bit hash of a word in [0, 2^32)."""
    mask = F.lit(_MASK)
    state = F.struct(*[(F.lit((GOLDEN + ADDED) & _MASK) + (word if n == "a" else F.lit(0))).bitwiseAND(mask).alias(n) for n in "abc"])
    plan = F.array(*[F.struct(F.lit("cab"[k % 3]).alias("at"), F.lit(r).alias("r")) for k, r in enumerate(ROTATIONS)])

    def rotate(x: Column, r: Column) -> Column:
        # by multiplication, as the number of bits is a column: x * 2^r, its low and its high word
        wide = x * F.pow(F.lit(2.0), r).cast("long")
        return wide.bitwiseAND(mask).bitwiseOR(F.shiftrightunsigned(wide, 32))

    def step(s: Column, p: Column) -> Column:
        at = p["at"]
        own = F.when(at == "a", s["a"]).when(at == "b", s["b"]).otherwise(s["c"])
        other = F.when(at == "a", s["c"]).when(at == "b", s["a"]).otherwise(s["b"])
        new = (own.bitwiseXOR(other) - rotate(other, p["r"])).bitwiseAND(mask)
        return F.struct(*[F.when(at == n, new).otherwise(s[n]).alias(n) for n in "abc"])

    out = F.aggregate(plan, state, step, lambda s: s["c"])
    return (F.when(out >= F.lit(1 << 31), out - F.lit(1 << 32)).otherwise(out)).cast("int")


def hash_int4(value: Column) -> Column:
    """Hash of a 32-bit (or shorter) whole number."""
    return _mixed(value.cast("long").bitwiseAND(F.lit(_MASK)))


def hash_int8(value: Column) -> Column:
    """Hash of a 64-bit number, equal to :func:`hash_int4` of a number that fits there."""
    v = value.cast("long")
    low, high = v.bitwiseAND(F.lit(_MASK)), F.shiftrightunsigned(v, 32)
    return _mixed(low.bitwiseXOR(F.when(v >= 0, high).otherwise(high.bitwiseXOR(F.lit(_MASK)))))


def mix_sql(word: str) -> str:
    """A SQL expression of the hash of a word in [0, 2^32), as nested SELECTs of one step each."""
    start = (GOLDEN + ADDED) & _MASK
    text = f"SELECT ({start} + {word}) & {_MASK} AS a, {start}::BIGINT AS b, {start}::BIGINT AS c"
    for k, r in enumerate(ROTATIONS):
        here = "cab"[k % 3]
        other = {"c": "b", "a": "c", "b": "a"}[here]
        new = f"((xor({here}, {other}) - ((({other} << {r}) & {_MASK}) | ({other} >> {32 - r})) + {1 << 32}) & {_MASK}) AS {here}"
        text = f"SELECT {', '.join(new if n == here else n for n in 'abc')} FROM ({text})"
    return f"(SELECT CAST(CASE WHEN c >= {1 << 31} THEN c - {1 << 32} ELSE c END AS INTEGER) FROM ({text}))"
