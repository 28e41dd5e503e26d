"""Language identification by a linear-chain conditional random field.

A text's words (runs of letters, lower-cased) are a chain. Each word has
features: affixes of one to three letters, letter n-grams, and its place in a
lexicon of frequent words. Weights of features and of transitions between
languages are learned together by maximum likelihood; forward-backward gives
each word the probability of each language given the whole text, so that a
foreign stretch in a text is told from its neighbours. The text's language is
that of the greatest mean probability, which is the score. Neighbouring words
of one language are a span, with places in the text as it is given.

Learned from ``per_language`` whole documents of each of the ``languages`` most
frequent languages at most (those of the smallest hash of ``doc_id`` outside the
held-out quarter, of at most ``document_bytes`` bytes each); every document
is then labelled in full. Only text and language are used. As labels name whole
documents, chains that change language are made for training: stretches of two
training documents in turn, from which the moves between languages are learned.

Null text, or text without a letter, is ``und`` with score 0. With nothing to
learn from, all is ``und``. A row with a null id is not held out. Repeated rows
each give their row; an empty table gives none. Of equal probabilities the
first language in alphabetical order wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgauge.llm import common

WORD = re.compile(r"[^\W\d_]+")
#: Training chains are cut after so many words; labelling never cuts.
CHAIN = 200
#: Words of one forward-backward call.
CALL_WORDS = 400_000


def word_features(word: str) -> list[str]:
    marked = f"<{word}>"
    n = len(word)
    return ["=" + word, *["<" + word[:k] for k in (1, 2, 3) if k <= n], *[">" + word[-k:] for k in (1, 2, 3) if k <= n], *["~" + marked[i : i + k] for k in (1, 2, 3) for i in range(len(marked) - k + 1)]]


def word_places(text: str) -> list[tuple[int, int]]:
    """Start and end, in ``text``, of the words of its lower case."""
    low = text.lower()
    found = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(text):
        return found
    owner = [k for k, c in enumerate(text) for _ in c.lower()]  # a letter may become two
    return [(owner[a], owner[b - 1] + 1) for a, b in found]


class Crf:
    """Weights and inference. ``index`` numbers the features, ``weights`` has a row for each."""

    CACHE = 500_000

    def __init__(self, labels: list[str], index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.labels, self.index, self.weights, self.moves = labels, index, weights, moves
        self.known: dict[str, int] = {}
        self.table = np.empty((0, len(labels)), np.float32)

    def __getstate__(self):
        return self.labels, self.index, self.weights, self.moves

    def __setstate__(self, state):
        self.__init__(*state)

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat feature numbers and where each word's begin; every word has feature 0, the bias."""
        get, flat, starts = self.index.get, [], []
        for w in words:
            starts.append(len(flat))
            flat.append(0)
            flat += [k for k in map(get, word_features(w)) if k is not None]
        return np.array(flat, np.int64), np.array(starts, np.int64)

    def places(self, words: list[str]) -> np.ndarray:
        """Rows of ``table`` with the scores of the words."""
        if len(self.known) > self.CACHE:
            self.known, self.table = {}, self.table[:0]
        known = self.known
        new = list({w for w in words if w not in known})
        if new:
            flat, starts = self.features(new)
            scores = np.add.reduceat(self.weights[flat], starts, axis=0).astype(np.float32)
            first = len(known)
            known.update((w, first + i) for i, w in enumerate(new))
            if first + len(new) > len(self.table):
                self.table = np.concatenate([self.table[:first], scores, np.empty((first + len(new), len(self.labels)), np.float32)])
            else:
                self.table[first : first + len(new)] = scores
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of the labels of each word, expected moves, and log partition of each chain.

        Chains lie one after another in ``scores``; all are stepped together.
        """
        top = scores.max(axis=1, keepdims=True)
        emit = np.exp(scores - top, dtype=np.float64)
        step = np.exp(self.moves)
        order = np.argsort(-lengths, kind="stable")
        begin = (np.cumsum(lengths) - lengths)[order]
        size = lengths[order]
        longest = int(size[0])
        active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
        ahead, scale = np.empty_like(emit), np.empty(len(emit))
        a = emit[begin]
        for t in range(longest):
            at = begin[: active[t]] + t
            if t:
                a = (a[: active[t]] @ step) * emit[at]
            total = a.sum(axis=1)
            a = a / total[:, None]
            ahead[at], scale[at] = a, total
        expected = np.zeros_like(step)
        out = np.empty_like(emit)
        back = np.ones((len(size), emit.shape[1]))
        for t in range(longest - 1, -1, -1):
            n = active[t]
            at = begin[:n] + t
            out[at] = ahead[at] * back[:n]
            if t:
                right = emit[at] * back[:n] / scale[at][:, None]
                expected += step * (ahead[at - 1].T @ right)
                back[:n] = right @ step.T
        logs = np.add.reduceat(np.log(scale) + top[:, 0], np.cumsum(lengths) - lengths)
        return out, expected, logs

    def inferred(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(numbers of texts, their lengths in words, probabilities of their words) in calls of bounded size; texts without a letter are left out."""
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        # numerals such as superscripts are word characters, but no letters
        words = [w if any(c.isalpha() for x in w for c in x) else [] for w in words]
        if not self.labels:
            return
        order = sorted((i for i, w in enumerate(words) if w), key=lambda i: len(words[i]))
        while order:
            part, held = [], 0
            while order and (not part or held + len(words[order[-1]]) <= CALL_WORDS):
                part.append(order.pop())
                held += len(words[part[-1]])
            at = self.places([w for i in part for w in words[i]])
            lengths = np.array([len(words[i]) for i in part])
            yield part, lengths, self.marginals(self.table[at], lengths)[0]

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        for part, lengths, prob in self.inferred(texts):
            mean = np.add.reduceat(prob, np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]
            for i, row in zip(part, mean, strict=True):
                best = int(row.argmax())
                out[i] = self.labels[best], float(min(1.0, max(0.0, row[best])))
        return out

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """(start, end, language, mean probability) of each text's runs of words of one language."""
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        for part, lengths, prob in self.inferred(texts):
            begin = 0
            for i, n in zip(part, lengths, strict=True):
                rows = prob[begin : begin + n]
                begin += n
                best, at = rows.argmax(axis=1), word_places(texts[i])
                cuts = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), int(n)]
                out[i] = [(at[a][0], at[b - 1][1], self.labels[best[a]], float(min(1.0, rows[a:b, best[a]].mean()))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out


def switching(chains: list[list[str]], gold: list[int], share: float = 0.25, stretch: int = 40) -> tuple[list[list[str]], list[np.ndarray]]:
    """Chains in which two of the given ones of different languages take turns, with the language of each word."""
    rnd = np.random.default_rng(len(chains))
    order = rnd.permutation(len(chains)).tolist()
    made, truth = [], []
    for a, b in zip(order, order[1:], strict=False):
        if len(made) >= share * len(chains):
            break
        if gold[a] == gold[b]:
            continue
        words, names, at = [], [], [0, 0]
        while at[0] < len(chains[a]) and at[1] < len(chains[b]) and len(words) < CHAIN:
            for side, c in enumerate((a, b)):
                part = chains[c][at[side] : at[side] + int(rnd.integers(5, stretch))]
                at[side] += len(part)
                words += part
                names += [gold[c]] * len(part)
        made.append(words)
        truth.append(np.array(names))
    return made, truth


def train(rows: list[tuple[str, str]], rounds: int = 15, rate: float = 0.5, decay: float = 1e-4, least_seen: int = 3, lexicon: int = 2000) -> Crf:
    """A model from (text, language) rows, by full-batch gradient steps with per-weight rates."""
    labels = sorted({lang for _, lang in rows})
    chains, gold = [], []
    for text, lang in rows:
        words = WORD.findall(text.lower())
        for i in range(0, len(words), CHAIN):
            chains.append(words[i : i + CHAIN])
            gold.append(labels.index(lang))
    seen = Counter(w for c in chains for w in c)
    frequent = {w for w, _ in seen.most_common(lexicon)}
    found: Counter = Counter()
    for w, n in seen.items():
        for f in word_features(w)[1:]:  # the first names the word itself
            found[f] += n
    kept = sorted(f for f, n in found.items() if n >= least_seen) + sorted("=" + w for w in frequent)
    index = {f: i + 1 for i, f in enumerate(kept)}
    model = Crf(labels, index, np.zeros((len(index) + 1, len(labels))), np.zeros((len(labels), len(labels))))
    if not chains:
        return model
    mixed, mixed_truth = switching(chains, gold)
    truths = [np.full(len(c), g) for c, g in zip(chains, gold, strict=True)] + mixed_truth
    chains = chains + mixed
    vocabulary = sorted(seen)
    number = {w: i for i, w in enumerate(vocabulary)}
    at = np.array([number[w] for c in chains for w in c])
    lengths = np.array([len(c) for c in chains])
    truth = np.concatenate(truths)
    flat, starts = model.features(vocabulary)
    owner = np.repeat(np.arange(len(vocabulary)), np.diff(np.r_[starts, len(flat)]))
    moves_seen = np.zeros_like(model.moves)
    for t in truths:
        np.add.at(moves_seen, (t[:-1], t[1:]), 1.0)
    scale, size = 1.0 / len(at), np.full_like(model.weights, 1e-8)
    size_moves = np.full_like(model.moves, 1e-8)
    for _ in range(rounds):
        scores = np.add.reduceat(model.weights[flat], starts, axis=0)
        prob, expected, _ = model.marginals(scores[at], lengths)
        prob[np.arange(len(at)), truth] -= 1.0
        by_word = np.stack([np.bincount(at, prob[:, k], len(vocabulary)) for k in range(len(labels))], axis=1)
        grad = np.stack([np.bincount(flat, by_word[owner, k], len(model.weights)) for k in range(len(labels))], axis=1) * scale + decay * model.weights
        grad_moves = (expected - moves_seen) * scale + decay * model.moves
        size += grad**2
        size_moves += grad_moves**2
        model.weights -= rate * grad / np.sqrt(size)
        model.moves -= rate * grad_moves / np.sqrt(size_moves)
    model.weights = model.weights.astype(np.float32)
    return model


def held_out(row_id: str = "doc_id"):
    return F.expr(f"crc32(cast({row_id} as string)) % 4 = 2")


def fit(docs: DataFrame, per_language: int = 120, languages: int = 256, document_bytes: int = 1 << 18, text: str = "text", lang: str = "lang", row_id: str = "doc_id", **options) -> Crf:
    """Train on at most ``per_language`` documents of each language, none of them held out.

    What comes to the driver is bounded by the three parameters; a language
    all of whose documents are longer than ``document_bytes`` is not learned.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.octet_length(text) <= document_bytes) & ~F.coalesce(held_out(row_id), F.lit(False)))
    rows = rows.select(F.col(row_id).alias("id"), F.col(lang).alias("lang"), F.xxhash64(row_id).alias("h"), F.col(text).alias("text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    # of the smallest hashes only, as every task would send per_language texts of each language otherwise
    most = F.expr(f"case when n <= {3 * per_language} then {(1 << 63) - 1}L else cast({3 * per_language}D / n * 18446744073709551616D - 9223372036854775808D as long) end")
    limits = common.materialize(counts.select(F.col("lang").alias("__lang"), most.alias("__most")), "languages")
    near = rows.join(F.broadcast(limits), F.col("lang") == F.col("__lang")).where(F.col("h") <= F.col("__most"))
    few = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "text"))).where(F.col("r") <= per_language)
    return train(sorted((r.text, r.lang) for r in few.select("text", "lang").collect()), **options)


def label_documents(docs: DataFrame, model: Crf, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(row_id, held_out, lang_pred, score) of every row; a map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.label(batch.column(2).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    plain = docs.select(F.col(row_id).cast("long").alias("id"), F.coalesce(held_out(row_id), F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", row_id)


def label_spans(docs: DataFrame, model: Crf, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(row_id, held_out, start, end, lang, probability): the spans of one language in every text; a map without a shuffle."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("start", "end", "lang", "probability"), s, strict=True)) for s in spans] for spans in model.spans(batch.column(2).to_pylist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, kind)], names=["id", "held_out", "spans"])

    plain = docs.select(F.col(row_id).cast("long").alias("id"), F.coalesce(held_out(row_id), F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    rows = plain.mapInArrow(run, "id long, held_out boolean, spans array<struct<start:int,end:int,lang:string,probability:double>>")
    return rows.select(F.col("id").alias(row_id), "held_out", F.inline("spans"))


def op7_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of one language in every whole text of ``documents``."""
    docs = common.documents(spark, sf_dir)
    return label_spans(docs, fit(docs))


def op7_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``."""
    docs = common.documents(spark, sf_dir)
    return label_documents(docs, fit(docs))
