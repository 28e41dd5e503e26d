"""Secret scans with multipart credential linking.

Strong findings are reported on their own: assignments of eight or more
characters, access keys of sixteen or more, hexadecimal runs of thirty-two or
more. Weak candidates (short or unnamed identifiers, short or unnamed secrets,
endpoints) mean little alone. They are reported only when complementary parts
lie within the same scope, ``SCOPE`` characters around the candidate: a weak
secret needs an identifier, a weak identifier needs a secret, an endpoint
needs both. The parts are found by an interval join: a candidate's scope and
the parts are dealt to blocks of ``SCOPE`` characters, joined on document and
block, and compared. Parts of a kind do not overlap, so a block holds a bounded
number and the join grows with the text.

Only DataFrame functions are used. The text is read once; what is shuffled is
spans of documents that hold a weak candidate next to something.

Places come from prefix sums in blocks, overlaps from a binary search: the work on
a text grows little faster than its matches. Positions count code points, ends are exclusive. Null text counts as empty.
Repeated rows each give their result, rows
with a null id too, and an empty table gives none. ``documents`` may have any extra columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.llm import common
from driftgauge.llm.common import let, running

#: Fixed values of the base rules: pattern, group that is measured, least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the maximal runs of 32 or more, as [0-9a-f]+ finds them
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
#: Weak candidates.
WEAK_ID = r"""(?i)\b(?:client_?id|access_?id|access_?key_?id|account|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=a-z-]*+[A-Z])(?=[0-9+/_=A-Z-]*+[a-z])[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""(?i)\b(?:[a-z][a-z0-9+.-]{1,10}://[^\x20\x09-\x0D"'<>]{3,}|(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?|(?<![a-z0-9.-])[a-z0-9-]++(?:\.[a-z0-9-]++)++:[0-9]{2,5}\b)"""
#: Kinds in the order in which equal starts are listed, and what each stands for.
KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")
SCOPE = 200

#: start and end in code points and in bytes, and the measured group's length.
_SPAN = "array<struct<start:int,end:int,from:int,to:int,size:int>>"
#: Strong spans up to which each weak candidate is compared with all of them.
FEW = 16


def match_spans(text: Column, pattern: str, measured: int = 0) -> Column:
    """Leftmost non-overlapping matches with the length of the measured group.

    Places follow from the lengths of the matches and of the gaps between
    them. Texts without a match are told apart by a search alone.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if measured == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(measured))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("match"), part.alias("part"))
    both = lambda f, z: (f(z["gap"]) + f(z["match"])).cast("int")
    named = F.transform(
        F.filter(zipped, lambda z: z["match"].isNotNull()),
        lambda z: F.struct(both(F.length, z).alias("step"), F.length(z["match"]).alias("len"), both(F.octet_length, z).alias("bytes"), F.octet_length(z["match"]).alias("long"), F.length(z["part"]).alias("size")),
    )

    def placed(items: Column) -> Column:
        sums = lambda f: running(F.transform(items, lambda x: x[f]), "int", F.lit(0), lambda at, x: at + x)

        def span(x: Column, e: Column) -> Column:
            return F.struct((e["c"] - x["len"]).alias("start"), e["c"].alias("end"), (e["b"] - x["long"]).alias("from"), e["b"].alias("to"), x["size"].alias("size"))

        return F.zip_with(items, F.arrays_zip(sums("step").alias("c"), sums("bytes").alias("b")), span)

    return F.when(text.rlike(pattern), let(named, placed)).otherwise(F.array().cast(_SPAN))


def outside(weak: Column, strong: Column) -> Column:
    """The weak candidates that overlap no strong span."""
    few = F.filter(weak, lambda w: ~F.exists(strong, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))

    def searched(ordered: Column) -> Column:
        def among(reach: Column) -> Column:
            powers = F.array(*[F.lit(1 << k) for k in range(28, -1, -1)])

            def free(w: Column) -> Column:
                # how many strong spans start before the candidate's end, found bit by bit
                before = F.aggregate(powers, F.lit(0), lambda at, p: F.when(F.coalesce(F.get(ordered, at + p - 1)["start"] < w["end"], F.lit(False)), at + p).otherwise(at))
                return F.coalesce(F.get(reach, before - 1) <= w["start"], F.lit(True))

            return F.filter(weak, free)

        return let(_reach(ordered, "end"), among)

    return F.when(F.size(strong) <= FEW, few).otherwise(let(F.array_sort(strong), searched))


def _reach(ordered: Column, end: str) -> Column:
    """How far the spans up to each one reach."""
    return running(F.transform(ordered, lambda s: s[end]), "int", F.lit(0), lambda at, e: F.greatest(at, e))


def _named(spans: Column, kind: int, role: str, weak: bool) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["from"].alias("from"), s["to"].alias("to"), F.lit(kind).alias("kind"), F.lit(role).alias("role"), F.lit(weak).alias("weak")))


def find_parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__base`` (strong spans) and ``__weak`` (weak candidates), arrays of (start, end, kind, role, weak)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = docs.select(
        "*",
        match_spans(body, ASSIGN, 2).alias("__a"),
        match_spans(body, ACCESS).alias("__k"),
        match_spans(body, HEX).alias("__h"),
        match_spans(body, WEAK_ID).alias("__wi"),
        match_spans(body, WEAK_SECRET).alias("__ws"),
        match_spans(body, ENDPOINT).alias("__we"),
    )
    at_least = lambda c, n: F.filter(F.col(c), lambda s: s["size"] >= n)
    below = lambda c, least, n: F.filter(F.col(c), lambda s: (s["size"] >= least) & (s["size"] < n))
    strong = F.concat(_named(at_least("__a", ASSIGN_LEAST), 0, "secret", False), _named(at_least("__k", ACCESS_LEAST), 1, "id", False), _named(F.col("__h"), 2, "secret", False))
    weak = F.concat(
        _named(below("__k", 8, ACCESS_LEAST), 3, "id", True),
        _named(F.col("__wi"), 3, "id", True),
        _named(below("__a", 4, ASSIGN_LEAST), 4, "secret", True),
        _named(F.col("__ws"), 4, "secret", True),
        _named(F.col("__we"), 5, "endpoint", True),
    )
    out = found.select(*docs.columns, strong.alias("__base"), weak.alias("__all_weak"))
    # a weak candidate inside a strong span of its role is that span's own text
    return out.select(*docs.columns, "__base", F.when(F.size("__all_weak") > 0, outside(F.col("__all_weak"), F.col("__base"))).otherwise(F.col("__all_weak")).alias("__weak"))


def link_parts(parts: DataFrame, key: list[str], scope: int = SCOPE) -> DataFrame:
    """For each key: ``__linked``, the weak candidates whose complementary parts lie in their scope.

    ``parts`` has the key columns, ``__base`` and ``__weak``.
    """
    both = F.concat("__base", "__weak")
    roles = F.array_distinct(F.transform(both, lambda s: s["role"]))
    some = parts.where((F.size("__weak") > 0) & F.array_contains(roles, "id") & F.array_contains(roles, "secret")).dropDuplicates(key)
    block = lambda p: F.expr(f"({p}) div {scope}")
    weak = some.select(*key, F.explode("__weak").alias("w")).select(*key, "w", F.explode(F.sequence(block(f"greatest(w.start - {scope}, 0)"), block(f"w.end + {scope}"))).alias("__block"))
    near = some.select(*[F.col(k).alias(f"__r_{k}") for k in key], F.explode(both).alias("p")).select("*", F.explode(F.sequence(block("p.start"), block("p.end"))).alias("__r_block"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in key])
    joined = weak.join(near, same & (F.col("__block") == F.col("__r_block")) & (F.col("p.start") < F.col("w.end") + scope) & (F.col("p.end") > F.col("w.start") - scope))
    has = lambda role: F.bool_or(F.col("p.role") == role)
    seen = joined.groupBy(*key, "w").agg(has("id").alias("i"), has("secret").alias("s"))
    need = F.when(F.col("w.role") == "endpoint", F.col("i") & F.col("s")).when(F.col("w.role") == "secret", F.col("i")).otherwise(F.col("s"))
    return seen.where(need).groupBy(*key).agg(F.collect_set("w").alias("__linked"))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """row id, ``__digest`` of the text, ``__base`` and ``__spans`` (strong and linked) of every row."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = find_parts(docs.select(F.col(row_id), body.alias("__text"), F.xxhash64(body).alias("__digest")), "__text").drop("__text")
    narrow = common.materialize(narrow, "secret-parts")
    key = [row_id, "__digest"]
    linked = link_parts(narrow, key).select(*[F.col(k).alias(f"__l_{k}") for k in key], "__linked")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__l_{k}")) for k in key])
    merged = narrow.join(linked, same, "left")
    return merged.select(*key, "__base", F.when(F.col("__linked").isNull(), F.col("__base")).otherwise(F.concat("__base", "__linked")).alias("__spans"))


def redact(docs: DataFrame, text: str = "text", row_id: str = "doc_id", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; other columns and rows stay as they are."""
    columns = docs.columns
    its_id, its_digest, its_spans = common.fresh(docs, "__s_id", "__s_digest", "__s_spans")
    found = scan(docs.select(row_id, text), text, row_id).where(F.size("__spans") > 0).dropDuplicates([row_id, "__digest"])
    spans = found.select(F.col(row_id).alias(its_id), F.col("__digest").alias(its_digest), F.col("__spans").alias(its_spans))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    hit = docs.join(spans, F.col(row_id).eqNullSafe(F.col(its_id)) & (F.xxhash64(body) == F.col(its_digest)), "left")
    ordered = F.array_sort(F.transform(its_spans, lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"))))

    def cut(raw: Column) -> Column:
        plain = lambda at, n: F.substring(raw, at + 1, n).cast("string")

        def of_spans(p: Column) -> Column:
            def of_reach(reach: Column) -> Column:
                done = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
                # overlapping spans (a hexadecimal run inside an assignment) make one mark
                pieces = F.transform(p, lambda s, i: F.when(s["from"] >= done(i), F.concat(plain(done(i), s["from"] - done(i)), F.lit(mark))).otherwise(F.lit("")))
                return F.concat(F.array_join(pieces, ""), plain(done(F.size(p)), F.lit(2147483647)))

            return let(_reach(p, "to"), of_reach)

        return let(ordered, of_spans)

    redacted = let(body.cast("binary"), cut)
    return hit.select(*[(F.when(F.col(its_spans).isNull(), F.col(text)).otherwise(redacted).alias(text) if c == text else F.col(c)) for c in columns])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    found = scan(common.documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("__base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("__spans")).alias("spans"))
