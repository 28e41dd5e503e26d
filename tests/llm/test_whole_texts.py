"""Places where a result was once less than the whole."""

import random

from llm_tables import table
from pyspark.sql import functions as F
from test_corpus import PARTS, sentence

from driftgauge.llm import language, secrets


def test_spans_of_code_switching(spark):
    rnd = random.Random(8)
    model = language.train([(sentence(rnd, lang, 60), lang) for lang in PARTS for _ in range(30)])
    first, second = sentence(rnd, "en", 30), sentence(rnd, "fr", 30)
    text = f"İ 12 {first}; {second}."
    rows = [(1, text), (2, None), (3, "12 !!"), (4, sentence(rnd, "de", 40))]
    found = sorted(map(tuple, language.label_spans(table(spark, rows), model).collect()))
    assert {r[0] for r in found} == {1, 4} and all(0 < r[5] <= 1 for r in found)
    mixed = [r for r in found if r[0] == 1]
    assert all(a[3] <= b[2] and a[4] != b[4] for a, b in zip(mixed, mixed[1:], strict=False))
    border = text.index(";")
    covered = lambda lang, lo, hi: sum(max(0, min(hi, r[3]) - max(lo, r[2])) for r in mixed if r[4] == lang)
    assert covered("en", 0, border) > 0.8 * len(first) and covered("fr", border, len(text)) > 0.8 * len(second)
    assert mixed[-1][3] == len(text) - 1  # the last word ends before the full stop


def test_long_weak_secret_is_linked(spark):
    """The first digit, capital or small letter of a token may come late."""
    for token in ("q" * 80 + "R1" + "s" * 10, "Q" * 70 + "r" + "9" * 8, "7_" * 45 + "xY", "q" * 100_000 + "R1"):
        text = f"client_id: someone {token} end"
        start = text.index(token)
        spans = secrets.scan(table(spark, [(1, text)])).select(secrets.listed(F.col("__spans"))).first()[0]
        assert f"linked_secret:{start}:{start + len(token)}" in spans.split(",")
        assert token not in secrets.redact(table(spark, [(1, text)])).first().text
