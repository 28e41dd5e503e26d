"""Small documents tables for the tests."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns whose names an operator might use itself.
CLASHES = ["size", "shard", "slot", "n", "doc", "cls", "id", "rid", "h", "kind", "text_sha256", "kept"]


def table(spark, rows, clashes=True):
    """documents rows from (doc_id, text) or (doc_id, text, lang, source), with clashing extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if clashes:
        for c in CLASHES:
            df = df.withColumn(c, df.doc_id * 0)
    return df


LONG = " ".join(f"word{i % 977} and{i}" for i in range(30_000))
#: Nulls, empty and blank texts, a very long one, ties and repeated rows.
EDGES = [
    (1, "one two three four five six seven"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, LONG),
    (6, "one two three four five six seven"),
    (6, "one two three four five six seven"),
    (7, "One  two\nthree four five six seven"),
    (None, "no id here but text"),
    (8, "token = 'abcdefgh' <|endoftext|> naïve 日本語 🙂  double  spaces \n \n end "),
]
