"""Cursors: an ordered result, read in steps that may go back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from driftgauge.store import write_once


class Cursor:
    """DECLARE .. SCROLL CURSOR over an ordered query.

    The result is written once in ranges of the order, with a count for each;
    a fetch then reads only the ranges that hold its rows. The place is that
    of the row fetched last: 0 is before the first.
    """

    def __init__(self, df: DataFrame, order: list[str]):
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
        rows = write_once(placed, "cursor")
        part = F.shiftright("__at", 33)
        counts = sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one number for each partition
        before, self.size = {}, 0
        for r in counts:
            before[r.part], self.size = self.size, self.size + r.n
        self.rows, self.columns, self.before, self.place = rows, df.columns, before, 0

    def _between(self, first: int, last: int) -> list[Row]:
        """Rows of places first to last, counted from 1."""
        wanted = F.lit(False)
        for part, n in self.before.items():
            start = part << 33
            wanted = wanted | F.col("__at").between(start + first - n - 1, start + last - n - 1) & (F.shiftright("__at", 33) == part)
        return [Row(*[r[c] for c in self.columns]) for r in self.rows.where(wanted).orderBy("__at").collect()] if last >= first else []

    def fetch(self, n: int) -> list[Row]:
        """FETCH FORWARD n, or BACKWARD for a negative n."""
        if n >= 0:
            first, last = self.place + 1, min(self.place + n, self.size)
            self.place = min(self.place + n, self.size + 1)
            return self._between(first, last)
        first, last = max(1, self.place + n), self.place - 1
        self.place = max(0, self.place + n)
        return self._between(first, last)[::-1]

    def fetch_absolute(self, n: int) -> Row | None:
        """FETCH ABSOLUTE n; a negative n counts from the end."""
        self.place = max(0, min(n if n >= 0 else self.size + 1 + n, self.size + 1))
        found = self._between(self.place, self.place) if 1 <= self.place <= self.size else []
        return found[0] if found else None

    def move(self, n: int) -> int:
        """MOVE n; how many rows a fetch would have given."""
        here, there = self.place, max(0, min(self.place + n, self.size + 1))
        self.place = there
        return min(there, self.size) - min(here, self.size) if n >= 0 else here - max(1, there) if here else 0
