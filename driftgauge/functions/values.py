"""Values of types that Spark lacks: IPv4 networks, amounts of money, enumerations, points and boxes.

Each is a text or a struct; a text that is no such value gives null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_IPV4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?:/(\d{1,2}))?$"
#: Fixed value: radius of the earth in metres, as distances on it are computed with.
EARTH_RADIUS = 6378168.0


def inet(text: Column) -> Column:
    """(address, bits) of an IPv4 address or network."""
    part = lambda i: F.regexp_extract(text, _IPV4, i)
    parts = [part(i).try_cast("long") for i in range(1, 5)]
    address = reduce(lambda a, p: a * 256 + p, parts)
    bits = F.when(part(5) == "", F.lit(32)).otherwise(part(5).try_cast("int"))
    valid = text.rlike(_IPV4) & reduce(Column.__and__, [p <= 255 for p in parts]) & (bits <= 32)
    return F.when(valid, F.struct(address.alias("address"), bits.alias("bits")))


def _dotted(address: Column) -> Column:
    return F.when(address.isNotNull(), F.concat_ws(".", *[F.shiftright(address, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]))


def _net(i: Column) -> Column:
    size = F.pow(F.lit(2.0), 32 - i["bits"]).cast("long")
    return i["address"] - i["address"] % size


def host(i: Column) -> Column:
    return _dotted(i["address"])


def masklen(i: Column) -> Column:
    return i["bits"]


def network(i: Column) -> Column:
    return F.concat(_dotted(_net(i)), F.lit("/"), i["bits"].cast("string"))


def broadcast_address(i: Column) -> Column:
    return F.concat(_dotted(_net(i) + F.pow(F.lit(2.0), 32 - i["bits"]).cast("long") - 1), F.when(i["bits"] < 32, F.concat(F.lit("/"), i["bits"].cast("string"))).otherwise(F.lit("")))


def contained_or_equal(a: Column, b: Column) -> Column:
    """a <<= b."""
    size = F.pow(F.lit(2.0), 32 - b["bits"]).cast("long")
    return (a["bits"] >= b["bits"]) & (a["address"] - a["address"] % size == _net(b))


def money(text: Column) -> Column:
    """An amount such as ``$1,234.56`` or ``-$5``, in cents exactly; brackets are a minus."""
    plain = F.regexp_replace(text, r"[$,\s]", "")
    negative = plain.rlike(r"^\(.*\)$|^-|-$")
    digits = F.regexp_replace(plain, r"[()\-]", "")
    amount = F.when(digits.rlike(r"^\d+(\.\d+)?$"), F.round(digits.try_cast("decimal(20,4)"), 2).cast("decimal(18,2)"))
    return F.when(negative, -amount).otherwise(amount).cast("decimal(18,2)")


def money_text(amount: Column) -> Column:
    return F.concat(F.when(amount < 0, F.lit("-$")).otherwise(F.lit("$")), F.format_number(F.abs(amount), 2))


def enum_place(value: Column, labels: list[str]) -> Column:
    """Place of an enumeration's label, by which its values are ordered; null for no label."""
    return reduce(lambda c, kv: c.when(value == kv[1], F.lit(kv[0])), enumerate(labels[1:], 1), F.when(value == labels[0], F.lit(0)))


def enum_range(labels: list[str], first: str | None = None, last: str | None = None) -> list[str]:
    return labels[labels.index(first) if first else 0 : labels.index(last) + 1 if last else None]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(a: Column, b: Column) -> Column:
    """The box of two opposite corners."""
    low = lambda c: F.least(a[c], b[c])
    high = lambda c: F.greatest(a[c], b[c])
    return F.struct(low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"))


def point_distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def box_area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def box_contains(b: Column, p: Column) -> Column:
    return p["x"].between(b["x0"], b["x1"]) & p["y"].between(b["y0"], b["y1"])


def box_overlaps(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def box_center(b: Column) -> Column:
    return point((b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2)


def earth_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres between places in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def int_array_aggregate(value: Column) -> Column:
    """The numbers of a group as an array, in ascending order; nulls are left out."""
    return F.array_sort(F.collect_list(value.cast("int")))


def int_array_enum(array: Column) -> Column:
    """A row for each number of an array."""
    return F.explode(array)
