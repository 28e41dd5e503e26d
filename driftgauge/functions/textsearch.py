"""Text search: vectors of words with places, queries of words, and rank.

A *vector* is an array of (word, place), sorted. Words are lower-cased
runs of letters and digits, which is the reference's plain configuration;
``stop`` leaves words out (their places still count). Dictionaries with stemming
are not part of this engine.

A query is text: words, ``&``, ``|``, ``!``, brackets, ``<->`` and ``<n>`` (the second
word n places after the first), and ``word:*`` for a prefix. It is parsed on the
driver and becomes one expression.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(<->|<\d+>|[&|!()]|[\w]+(?::\*)?)")


def to_tsvector(text: Column, stop: tuple[str, ...] = ()) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    placed = F.transform(words, lambda w, i: F.struct(w.alias("word"), (i + 1).alias("place")))
    return F.array_sort(F.filter(placed, lambda p: ~p["word"].isin(*stop)) if stop else placed)


def _fits(entry: Column, term: str) -> Column:
    return F.startswith(entry["word"], F.lit(term[:-2].lower())) if term.endswith(":*") else entry["word"] == term.lower()


def places(vector: Column, term: str) -> Column:
    """Where a term stands."""
    return F.transform(F.filter(vector, lambda e: _fits(e, term)), lambda e: e["place"])


def _moved(at: Column, n: int) -> Column:
    return F.transform(at, lambda p: p + n)


class _Parser:
    """Precedence: ! before <-> before & before |."""

    def __init__(self, text: str, vector: Column):
        self.tokens, self.vector = [], vector
        at = 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"syntax error in text search query at {text[at:]!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.tokens.append("")

    def take(self, *wanted: str) -> str | None:
        return self.tokens.pop(0) if self.tokens[0] in wanted else None

    def either(self) -> Column:
        out = self.both()
        while self.take("|"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.phrase()
        while self.take("&"):
            out = out & self.phrase()
        return out

    def phrase(self) -> Column:
        if self.take("!"):
            return ~self.phrase()
        if self.take("("):
            out = self.either()
            if not self.take(")"):
                raise ValueError("unclosed bracket in text search query")
            return out
        term = self.tokens.pop(0)
        if not re.match(r"\w", term):
            raise ValueError(f"a word is missing before {term!r} in text search query")
        ends, found = None, F.exists(self.vector, lambda e: _fits(e, term))
        while self.tokens[0].startswith("<"):
            gap, here, nxt = self.tokens.pop(0), ends if ends is not None else places(self.vector, term), self.tokens.pop(0)
            n = 1 if gap == "<->" else int(gap[1:-1])
            ends = F.array_intersect(_moved(here, n), places(self.vector, nxt))
            found = F.size(ends) > 0
        return found


def matches(vector: Column, query: str) -> Column:
    """vector @@ query."""
    parser = _Parser(query, vector)
    out = parser.either()
    if parser.tokens != [""]:
        raise ValueError(f"syntax error in text search query at {parser.tokens[0]!r}")
    return out


def strip(vector: Column) -> Column:
    """The distinct words without their places."""
    return F.array_distinct(F.transform(vector, lambda e: e["word"]))


def ts_length(vector: Column) -> Column:
    """Number of distinct words."""
    return F.size(strip(vector))


def occurrence_rank(vector: Column, terms: list[str]) -> Column:
    """Share of the places that the terms hold, a plain rank of this engine (the reference's weights by label are left out)."""
    return F.size(F.filter(vector, lambda e: reduce(Column.__or__, [_fits(e, t) for t in terms]))) / F.greatest(F.size(vector), F.lit(1))
