"""Quality rules learned as a decision list.

:func:`text_statistics` computes interpretable statistics of whole texts with
DataFrame functions only. :func:`learn_rules` covers labelled statistics one
rule at a time: a rule grows as a conjunction of thresholds while its purity
improves on one part of the labels, is pruned on the other, and takes what it
covers out of play. The rules, in order, become one Spark conditional
expression, so that judging a table is a projection.

What is learned comes from at most ``sample_rows`` labelled rows (those of the
smallest hash of ``doc_id``); everything is judged.

Null text counts as empty: no words, base rules fail. Repeated rows are judged
alike; rows with a null id are judged by their text. An empty table gives no row. With no labels of one kind no rule is learned and the base rules decide.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.llm import common
from driftgauge.llm.common import let

#: Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 50, 50, 3
SYMBOLS = "#*$%&|<>"

#: What conditions may test, as ratios that do not depend on a text's length.
FEATURES: dict[str, str] = {
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "distinct_word_share": "n_distinct_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more.

    Windows are compared by 64-bit hashes. Most texts have no equal windows,
    which a distinct count shows; the others sort (hash, place), mark equal
    neighbours, and add up the places they cover.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marks(p: Column) -> Column:
            twin = lambda x, j: F.coalesce(F.get(p, j)["h"] == x["h"], F.lit(False))
            return F.filter(p, lambda x, j: twin(x, j + 1) | (F.when(j > 0, twin(x, j - 1)).otherwise(F.lit(False))))

        def total(places: Column) -> Column:
            gaps = F.transform(places, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - i, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

        marked = let(placed, marks)
        return let(F.sort_array(F.transform(marked, lambda x: x["i"])), total)

    def of_hashes(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))

    def of_words(w: Column) -> Column:
        windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(windows, of_hashes)

    return let(words, of_words)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the statistics of every whole text."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    trimmed = F.btrim(body, F.lit(common.SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{common.WS}]+", -1))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(rf"[^{common.WS}]"))
    count = lambda pattern: F.length(body) - F.length(F.regexp_replace(body, pattern, ""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("repeat"), F.size(F.array_distinct(w)).alias("distinct"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))

    keep = [c for c in docs.columns if c != text]
    # a generator is a barrier: what it yields is computed once, though many columns use it
    once = docs.select(*keep, F.explode(F.array(F.struct(let(words, of_words).alias("w"), let(lines, of_lines).alias("l"), count(f"[{SYMBOLS}]").alias("symbols"), count("!").alias("bangs")))).alias("__s"))
    take = {"n_words": "w.n", "word_chars": "w.chars", "n_symbols": "symbols", "n_dup_lines": "l.dup", "n_repeat_words": "w.repeat", "n_bangs": "bangs", "n_lines": "l.n", "n_distinct_words": "w.distinct"}
    return once.select(*keep, *[F.col(f"__s.{path}").cast("long").alias(name) for name, path in take.items()])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] >= self.threshold if self.above else row[self.feature] < self.threshold

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    """Reject what meets all conditions."""

    conditions: tuple[Condition, ...]

    def holds(self, row: dict[str, float]) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>=' if c.above else '<'} {c.threshold:.6g}" for c in self.conditions)


def _cover(rows: list, conditions: tuple[Condition, ...]) -> tuple[int, int]:
    hit = [bad for row, bad in rows if all(c.holds(row) for c in conditions)]
    return sum(hit), len(hit) - sum(hit)


def _best_condition(rows: list, p0: int, n0: int) -> tuple[float, Condition] | None:
    """The condition of most FOIL gain over rows, of which p0 are bad and n0 good."""
    base, best = math.log2(p0 / (p0 + n0)), None
    for f in FEATURES:
        ordered = sorted((row[f], bad) for row, bad in rows)
        p = n = 0
        for i, (value, bad) in enumerate(ordered):
            if i and value > ordered[i - 1][0]:
                cut = (value + ordered[i - 1][0]) / 2
                for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                    if pp:
                        gain = pp * (math.log2(pp / (pp + nn)) - base)
                        if best is None or gain > best[0] + 1e-9:
                            best = gain, Condition(f, above, cut)
            p, n = p + bad, n + (not bad)
    return best


def learn_rules(rows: list[tuple[dict[str, float], bool]], least_purity: float = 0.9, least_covered: int = 3, most_rules: int = 16, most_conditions: int = 4) -> list[Rule]:
    """Rules for bad rows by sequential covering. ``rows``: (features, bad), in an order that means nothing."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    rules: list[Rule] = []
    while len(rules) < most_rules:
        left, conditions = grow, ()
        while len(conditions) < most_conditions:
            p = sum(bad for _, bad in left)
            n = len(left) - p
            if not p or not n:
                break
            found = _best_condition(left, p, n)
            if found is None or found[0] <= 0:
                break
            conditions += (found[1],)
            left = [r for r in left if found[1].holds(r[0])]
        if not conditions:
            break

        def worth(c: tuple[Condition, ...]) -> float:
            p, n = _cover(prune, c)
            return (p - n) / (p + n) if p + n else -1.0

        while len(conditions) > 1:  # drop last conditions as long as the other part of the labels does not suffer
            if worth(conditions[:-1]) >= worth(conditions):
                conditions = conditions[:-1]
            else:
                break
        p, n = (a + b for a, b in zip(_cover(grow, conditions), _cover(prune, conditions), strict=True))
        if p < least_covered or p < least_purity * (p + n):
            break
        rules.append(Rule(conditions))
        grow, prune = ([r for r in part if not rules[-1].holds(r[0])] for part in (grow, prune))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """False where a rule rejects, else true: the rules in order as one conditional expression."""
    out = F.lit(True)
    for rule in reversed(rules):
        test = rule.conditions[0].column()
        for c in rule.conditions[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(False)).otherwise(out)
    return out


def fit(statistics: DataFrame, labels: DataFrame, row_id: str = "doc_id", sample_rows: int = 20_000, **options) -> list[Rule]:
    """Rules from labelled statistics; only rows that the base rules keep teach anything.

    Rows with null quality are no labels. At most ``sample_rows`` rows come to
    the driver.
    """
    marked = labels.where(F.col("quality").isNotNull()).select(F.col(row_id).alias("__id"), "quality")
    joined = statistics.where(~base_failed()).join(marked, F.col(row_id) == F.col("__id"))
    ratios = joined.select(*[F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()], (F.col("quality") == 0).alias("bad"), F.xxhash64(row_id).alias("h"), F.col(row_id).alias("id"))
    # of the smallest hashes only, as every task would send sample_rows rows to the driver otherwise
    few = ratios.where(F.col("h") <= common.hash_below(min(1.0, 3 * sample_rows / max(marked.count(), 1))))
    rows = few.orderBy("h", "id").limit(sample_rows).collect()
    return learn_rules([({f: r[f] for f in FEATURES}, r.bad) for r in rows], **options)


def judge(statistics: DataFrame, rules: list[Rule]) -> DataFrame:
    return statistics.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = common.documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stats = common.materialize(text_statistics(docs), "quality-statistics")
    rules = fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
