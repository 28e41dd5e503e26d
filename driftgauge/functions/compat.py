"""SQL features that Spark lacks, as short DataFrame rewrites."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """DISTINCT ON: the first row of each key by the order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__r", rank).where("__r = 1").drop("__r")


def with_ties(df: DataFrame, n: int, order: list[str], descending: bool = False) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES: the n first rows and all that tie with the last of them.

    The sort keys of the n-th row are found by a top-n over the keys alone; one
    row is broadcast, and no global window is needed.
    """
    keys = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    by = [nulls_largest(F.col(c), descending) for c in order]
    # the last of the n first: one row, whatever n
    first = df.select(*order).orderBy(*by).limit(n)
    back = [c.desc_nulls_last() if not descending else c.asc_nulls_first() for c in map(F.col, order)]
    last = first.orderBy(*back).limit(1).select(keys.alias("__last"))
    tests = []
    for i, c in enumerate(order):
        here, edge = F.col(c), F.col(f"__last.k{i}")
        less = (here > edge) if descending else (here < edge)
        sooner = (here.isNull() & edge.isNotNull()) if descending else (here.isNotNull() & edge.isNull())
        same = reduce(Column.__and__, [F.col(o).eqNullSafe(F.col(f"__last.k{k}")) for k, o in enumerate(order[:i])], F.lit(True))
        tests.append(same & (F.coalesce(less, F.lit(False)) | sooner))
    tests.append(reduce(Column.__and__, [F.col(o).eqNullSafe(F.col(f"__last.k{k}")) for k, o in enumerate(order)]))
    return df.join(F.broadcast(last), reduce(Column.__or__, tests), "left_semi")


def groups_frame(df: DataFrame, value: Column, by: list[str], order: str, before: int, after: int, out: str) -> DataFrame:
    """sum(value) over a GROUPS frame: peers count as one step."""
    peers = df.withColumn("__g", F.dense_rank().over(Window.partitionBy(*by).orderBy(order)))
    frame = Window.partitionBy(*by).orderBy("__g").rangeBetween(-before, after)
    return peers.withColumn(out, F.sum(value).over(frame)).drop("__g")


def exclude_current(value: Column, by, before: int, after: int) -> Column:
    """sum(value) over rows from ``before`` preceding to ``after`` following without the current one.

    ``by`` is a window specification without a frame. The parts before and after the row are
    added, as taking the row's value from the whole would lose digits, or all where it is infinite.
    """
    parts = [F.sum(value).over(by.rowsBetween(a, z)) for a, z in ((-before, -1), (1, after)) if a <= z]
    if len(parts) < 2:
        return parts[0] if parts else F.lit(None).cast("double")
    return F.coalesce(parts[0] + parts[1], *parts)


def moving_sum(value: Column, by, rows: int) -> Column:
    """sum(value) over the current row and ``rows`` - 1 before it, as a difference of running sums.

    That takes the leaving row back out, as an inverse transition does: the work does not grow with the
    frame. For whole numbers and decimals; nulls count as nothing, and a frame of nulls is null.
    """
    def running(x: Column, until: int) -> Column:
        return F.coalesce(F.sum(x).over(by.rowsBetween(Window.unboundedPreceding, until)), F.lit(0))

    seen = value.isNotNull().cast("long")
    some = running(seen, 0) - running(seen, -rows) > 0
    return F.when(some, running(value, 0) - running(value, -rows))


def similar_pattern(pattern: str, escape: str = "\\") -> str:
    """The regular expression of a SIMILAR TO pattern."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out.append("\\" + pattern[i])
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c in ".^$\\":
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    return f"^(?s:{''.join(out)})$"


def similar_to(col: Column, pattern: str, escape: str = "\\") -> Column:
    return col.rlike(similar_pattern(pattern, escape))


def between_symmetric(col: Column, a: Column, b: Column) -> Column:
    return col.between(F.least(a, b), F.greatest(a, b))


def hypothetical_rank(df: DataFrame, value: Column, of: Column, by: list[str] | None = None, out: str = "rank") -> DataFrame:
    """rank(of) WITHIN GROUP (ORDER BY value): the place a row would take."""
    return df.groupBy(*(by or [])).agg((F.sum(F.when(value < of, 1).otherwise(0)) + 1).cast("long").alias(out))


def hypothetical_dense_rank(df: DataFrame, value: Column, of: Column, by: list[str] | None = None, out: str = "dense_rank") -> DataFrame:
    return df.groupBy(*(by or [])).agg((F.count_distinct(F.when(value < of, value)) + 1).cast("long").alias(out))


def hypothetical_percent_rank(df: DataFrame, value: Column, of: Column, by: list[str] | None = None, out: str = "percent_rank") -> DataFrame:
    return df.groupBy(*(by or [])).agg((F.sum(F.when(value < of, 1).otherwise(0)) / F.count(value)).alias(out))


def hypothetical_cume_dist(df: DataFrame, value: Column, of: Column, by: list[str] | None = None, out: str = "cume_dist") -> DataFrame:
    return df.groupBy(*(by or [])).agg(((F.sum(F.when(value <= of, 1).otherwise(0)) + 1) / (F.count("*") + 1)).alias(out))


def exclude_peers(value: Column, partition: list[str], order: list[str], ties_only: bool = False) -> Column:
    """sum(value) over a partition EXCLUDE GROUP, or EXCLUDE TIES, which leaves the row itself in."""
    whole, peers = F.sum(value).over(Window.partitionBy(*partition)), F.sum(value).over(Window.partitionBy(*partition, *order))
    n = F.count(value).over(Window.partitionBy(*partition)) - F.count(value).over(Window.partitionBy(*partition, *order))
    rest = F.when(n > 0, whole - F.coalesce(peers, whole * 0))
    return F.coalesce(rest + value, rest, value) if ties_only else rest


def xml_table(xml: Column, row: str, columns: dict[str, str]) -> Column:
    """XMLTABLE: an array of structs, one for each element at the path ``row``; a column is an attribute or path below it.

    Every row must have every column, as paths are looked up one by one.
    """
    found = [F.xpath(xml, F.lit(f"{row}/{path}")).alias(name) for name, path in columns.items()]
    return F.arrays_zip(*found)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor; 92 steps of Euclid's rule are enough for 64 bits, and stop early in value."""
    start = F.struct(F.abs(a.cast("long")).alias("a"), F.abs(b.cast("long")).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.when(s["b"] != 0, s["a"] % F.when(s["b"] != 0, s["b"])).otherwise(F.lit(0)).cast("long").alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise(F.abs(F.floor(a.cast("long") / g) * b.cast("long")))


def degree(fn, col: Column) -> Column:
    """A trigonometric function of degrees, exact at multiples of 30 and 45 as far as rounding to 15 digits makes it."""
    return F.round(fn(F.radians(col)), 15)


def sind(col: Column) -> Column:
    return degree(F.sin, col)


def cosd(col: Column) -> Column:
    return degree(F.cos, col)


def tand(col: Column) -> Column:
    return degree(F.tan, col)


def asind(col: Column) -> Column:
    return F.round(F.degrees(F.asin(col)), 12)


def acosd(col: Column) -> Column:
    return F.round(F.degrees(F.acos(col)), 12)


def atand(col: Column) -> Column:
    return F.round(F.degrees(F.atan(col)), 12)


def make_interval(months: Column, days: Column, micros: Column) -> Column:
    """An interval of months, days and microseconds, kept apart."""
    return F.struct(months.cast("int").alias("months"), days.cast("int").alias("days"), micros.cast("long").alias("micros"))


def justify_days(interval: Column) -> Column:
    """Thirty days as a month."""
    extra = F.when(interval["days"] >= 0, F.floor(interval["days"] / 30)).otherwise(F.ceil(interval["days"] / 30))
    return make_interval(interval["months"] + extra, interval["days"] - extra * 30, interval["micros"])


def justify_hours(interval: Column) -> Column:
    """Twenty-four hours as a day."""
    day = F.lit(86_400_000_000)
    extra = F.when(interval["micros"] >= 0, F.floor(interval["micros"] / day)).otherwise(F.ceil(interval["micros"] / day))
    return make_interval(interval["months"], interval["days"] + extra, interval["micros"] - extra * day)


def justify_interval(interval: Column) -> Column:
    return justify_days(justify_hours(interval))


def sum_interval_days(interval: Column) -> Column:
    """Length of a group's intervals together, in days, a month as 30 of them.

    Months, days and microseconds are summed apart, so that the sum may be longer than any interval.
    """
    months, days, micros = (F.sum(interval[c].cast("decimal(20,0)")).cast("double") for c in ("months", "days", "micros"))
    return months * 30 + days + micros / 86_400_000_000


def avg_interval_days(interval: Column) -> Column:
    """Mean length of a group's intervals in days, not rounded to a microsecond."""
    return sum_interval_days(interval) / F.count(interval["days"])


def age(later: Column, earlier: Column) -> Column:
    """Whole months and remaining days between two dates, as a text of years, months and days."""
    months = F.floor(F.months_between(later, earlier, False)).cast("int")
    days = F.datediff(later, F.add_months(earlier, months))
    return F.struct(F.floor(months / 12).cast("int").alias("years"), (months % 12).cast("int").alias("months"), days.alias("days"))


def nulls_largest(col: Column, descending: bool = False) -> Column:
    """The reference's default order, in which nulls are the largest."""
    return col.desc_nulls_first() if descending else col.asc_nulls_last()


def char_n(col: Column, n: int) -> Column:
    """CHAR(n): cut and padded with blanks."""
    return F.rpad(col, n, " ")


def char_equal(a: Column, b: Column) -> Column:
    """Comparison of CHAR values: trailing blanks do not count."""
    return F.rtrim(a) == F.rtrim(b)


def num_nulls(*cols: Column) -> Column:
    return reduce(Column.__add__, [c.isNull().cast("int") for c in cols])


def num_nonnulls(*cols: Column) -> Column:
    return reduce(Column.__add__, [c.isNotNull().cast("int") for c in cols])


def array_agg(value: Column) -> Column:
    """array_agg that keeps nulls, in the order of values with nulls last."""
    packed = F.collect_list(F.struct(value.isNull().alias("n"), value.alias("v")))
    return F.transform(F.array_sort(packed), lambda s: s["v"])


def ordered_agg(value: Column, *order: Column) -> Column:
    """array_agg(value ORDER BY order..)."""
    packed = F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v")))
    return F.transform(F.array_sort(packed), lambda s: s["v"])


def regexp_replace_first(col: Column, pattern: str, to: str) -> Column:
    """The reference's regexp_replace without flags replaces the first match."""
    return F.regexp_replace(col, f"(?s)^(.*?)(?:{pattern})(.*)$", f"$1{to}$2")


def quote_ident(col: Column) -> Column:
    plain = col.rlike("^[a-z_][a-z0-9_]*$")
    return F.when(plain, col).otherwise(F.concat(F.lit('"'), F.replace(col, F.lit('"'), F.lit('""')), F.lit('"')))


def quote_literal(col: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(col, F.lit("'"), F.lit("''")), F.lit("'"))


def quote_nullable(col: Column) -> Column:
    return F.coalesce(quote_literal(col), F.lit("NULL"))


def trigrams(col: Column) -> Column:
    """Distinct trigrams of a text's words, each word with two blanks in front and one behind."""
    words = F.filter(F.split(F.lower(col), "[^a-z0-9]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Common over all trigrams."""
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def difference(a: Column, b: Column) -> Column:
    """How many of the four places of two soundex codes agree."""
    x, y = F.soundex(a), F.soundex(b)
    return reduce(Column.__add__, [(F.substring(x, i, 1) == F.substring(y, i, 1)).cast("int") for i in range(1, 5)])


def unaccent(col: Column) -> Column:
    """Latin-1 letters without their accents."""
    return F.translate(col, "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy")


def make_range(lo: Column, hi: Column, lo_inc: bool = True, hi_inc: bool = False) -> Column:
    """A range; a null end is open."""
    return F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(lo_inc).alias("lo_inc"), F.lit(hi_inc).alias("hi_inc"))


def range_contains(r: Column, value: Column) -> Column:
    low = r["lo"].isNull() | (value > r["lo"]) | (r["lo_inc"] & (value == r["lo"]))
    high = r["hi"].isNull() | (value < r["hi"]) | (r["hi_inc"] & (value == r["hi"]))
    return low & high


def range_empty(r: Column) -> Column:
    return F.coalesce((r["lo"] > r["hi"]) | ((r["lo"] == r["hi"]) & ~(r["lo_inc"] & r["hi_inc"])), F.lit(False))


def range_overlaps(a: Column, b: Column) -> Column:
    def before(x: Column, y: Column) -> Column:
        return F.coalesce((x["hi"] < y["lo"]) | ((x["hi"] == y["lo"]) & ~(x["hi_inc"] & y["lo_inc"])), F.lit(False))

    return ~range_empty(a) & ~range_empty(b) & ~before(a, b) & ~before(b, a)


def width_of_julian(day: Column) -> Column:
    """extract(julian from day)."""
    return F.datediff(day, F.lit("1970-01-01").cast("date")) + 2_440_588


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC with SHA-256 of a column under one key."""
    import hashlib

    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in block))
    outer = F.lit(bytearray(b ^ 0x5C for b in block))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def lock_step(df: DataFrame, **arrays: Column) -> DataFrame:
    """Several set-returning expressions of a select list, row by row; shorter ones end in nulls."""
    zipped = F.arrays_zip(*[c.alias(n) for n, c in arrays.items()])
    return df.select("*", F.explode(zipped).alias("__z")).select(*df.columns, *[F.col(f"__z.{n}").alias(n) for n in arrays])


def rounded_bigint(expr: str) -> str:
    """SQL text of a double's cast to bigint that rounds, ties to even; Spark's own cast truncates."""
    return f"cast(rint({expr}) AS bigint)"


def cbrt(col: Column) -> Column:
    return F.cbrt(col)


def is_finite(col: Column) -> Column:
    return ~F.isnan(col) & (F.abs(col) != math.inf)
