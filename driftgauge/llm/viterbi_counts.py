"""Token counts under a unigram vocabulary without building the tokens.

An Aho-Corasick automaton lists the vocabulary pieces that end at each place
of a word; dynamic programming carries the best score and the piece count of
that best path, and nothing else. Ties follow the tokenizers library's Unigram
model: among equal scores the piece that starts first wins, a character
without a piece of its own costs the smallest score less 10, neighbouring
unknown characters are one piece, and with byte fallback a piece for each of
their bytes.

Words are runs without Unicode white space, each with U+2581 in front. The
vocabulary is that of a sentencepiece file in which every piece i gets the
score -ln(i + 1) (Zipf's law over ids); any list of (piece, score) may be given
instead. Null or blank text has 0 tokens. Equal words are counted once in a
bounded cache. Rows with a null id and repeated rows each give their row; an
empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.llm import common

#: Runs without Unicode white space.
WORD = re.compile("[^\t-\r \x85\xa0  -     　]+")
#: What an unknown character costs beyond the smallest score.
UNKNOWN_PENALTY = 10.0


def zipf_vocabulary(model: str = "piece_bpe_32k.model") -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with the score -ln(id + 1)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_path(model))
    return [(sp.id_to_piece(i), -math.log(i + 1)) for i in range(sp.vocab_size())]


class CountOnlyViterbi:
    CACHE = 600_000
    _made: dict = {}

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        pieces = dict(reversed(vocabulary))
        for piece, score in pieces.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.cache = common.BoundedCache(self.CACHE)

    @classmethod
    def shared(cls, model: str) -> CountOnlyViterbi:
        if model not in cls._made:
            cls._made[model] = cls(zipf_vocabulary(model))
        return cls._made[model]

    def word(self, text: str) -> int:
        """Pieces of the best path over one word."""
        n = len(text)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at: list[list] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(text):
            at[end].append(piece)
        for end in range(n):
            best, source, single = -math.inf, end, False
            # longest first: of equal scores the earliest start stays
            for length, value in sorted(at[end], key=lambda x: -x[0]):
                start = end + 1 - length
                total = value + score[start]
                if total > best:
                    best, source = total, start
                single = length == 1
            total = self.unknown + score[end]
            if not single and total > best:
                score[end + 1], unknown[end + 1] = total, True
                if self.bytes:
                    count[end + 1] = count[end] + len(text[end].encode())
                else:
                    count[end + 1] = count[end] + (not unknown[end])
            else:
                score[end + 1], count[end + 1] = best, count[source] + 1
        return count[n]

    def text(self, text: str | None) -> int:
        cache, total = self.cache, 0
        for w in WORD.findall(text or ""):
            n = cache.get(w)
            if n is None:
                n = self.word("▁" + w)
                cache.put(w, n)
            total += n
        return total


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_tokens of every row; a map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = CountOnlyViterbi.shared(model)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([counter.text(t.as_py()) for t in batch.column(1)], pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every whole text of ``documents``."""
    return count_tokens(common.documents(spark, sf_dir))
