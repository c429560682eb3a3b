"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learned from labels of documents."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.common import filter_rows, map_arrow, row_slices, text_key, written

#: Labelled documents that the model is fitted on, about, and features that it weighs, at most.
MAX_DOCS, MAX_FEATURES = 20_000, 3_000
#: Documents that must hold a feature, and the least chi-square of its presence and the label (one in a thousand by chance).
MIN_DOCS, MIN_CHI2 = 4, 10.8
#: Words and ends of sentences.
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]+")
_END = re.compile(r"[.!?\n]+")
_PIECE_CHARS = 1 << 19
_REMEMBERED = 500_000
_FLUSH = 400_000


def features(word: str) -> tuple[str, ...]:
    """A word and its first three, four and five letters, as insults come with many endings."""
    return (word, *[word[:k] + "*" for k in (3, 4, 5) if len(word) > k])


def pieces(text: str) -> list[str]:
    """A long text cut at ends of sentences, or at any character where a sentence has none for very long."""
    out, first = [], 0
    while len(text) - first > 2 * _PIECE_CHARS:
        m = _END.search(text, first + _PIECE_CHARS, first + 2 * _PIECE_CHARS)
        cut = m.end() if m else first + 2 * _PIECE_CHARS
        out.append(text[first:cut])
        first = cut
    return [*out, text[first:]]


@dataclass
class Model:
    """Weights of features and the score's constant; a sentence's score is their logistic sum."""

    weights: dict[str, float]
    bias: float


class _Memory(dict):
    """Place of each word seen among the sets of known features that words have; 0 for none, -1 for ends of sentences."""

    def __init__(self, model: Model):
        super().__init__()
        self.bias = model.bias
        self.index = {f: i for i, f in enumerate(model.weights)}
        self.weights = np.array([*model.weights.values(), 0.0])
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.places, self.sets = {(): 0}, np.full((64, 4), -1, np.int64)

    def __missing__(self, word: str) -> int:
        if word[0] in ".!?\n":
            self[word] = -1
            return -1
        known = tuple(self.index[f] for f in features(word) if f in self.index)
        place = self.places.setdefault(known, len(self.places))
        if place == len(self.sets):
            self.sets = np.concatenate([self.sets, np.full_like(self.sets, -1)])
        self.sets[place, : len(known)] = known
        self[word] = place
        return place

    def sentences(self, text: str) -> np.ndarray:
        """The logistic sum of each sentence with words of a lower-case piece, over the set of its features as in ``_bags``."""
        if len(self) > _REMEMBERED:
            self.clear()
        tokens = _TOKEN.findall(text)
        place = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        words = place >= 0
        starts = words & np.concatenate([[True], ~words[:-1]])[: len(words)]
        n = int(starts.sum())
        hit = np.flatnonzero(place > 0)
        found = self.sets[place[hit]]
        pairs = ((np.cumsum(starts)[hit] - 1) * len(self.weights))[:, None] + found
        pairs = np.unique(pairs[found >= 0])
        return np.bincount(pairs // len(self.weights), self.weights[pairs % len(self.weights)], n) + self.bias


def _log_clean(memory: _Memory, text: str) -> float:
    """Sum over the sentences of the logarithm of not being toxic; a text without words is one empty sentence."""
    total, sentences = 0.0, 0
    for piece in pieces(text.lower()):
        z = memory.sentences(piece)
        total -= float(np.logaddexp(0.0, z).sum())
        sentences += len(z)
    return total if sentences else -float(np.logaddexp(0.0, memory.bias))


def _bags(text: str, index: dict[str, int]) -> tuple[int, list[list[int]]]:
    """How many sentences hold no known feature, and the known features of each other one."""
    empty, bags = 0, []
    for piece in pieces(text.lower()):
        for sentence in _END.split(piece):
            words = _TOKEN.findall(sentence)
            if words:
                known = sorted({index[f] for w in words for f in features(w) if f in index})
                if known:
                    bags.append(known)
                else:
                    empty += 1
    return (empty, bags) if empty or bags else (1, [])


def _sample(docs: DataFrame, labels: DataFrame, max_docs: int) -> DataFrame:
    """Text and label (y) of about ``max_docs`` labelled documents, chosen by a hash of doc_id."""
    y = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    n = y.count()
    share = F.lit(int(min(1.0, max_docs / max(n, 1)) * (1 << 30)))
    chosen = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).withColumnRenamed("doc_id", "_labelled")
    # At most about max_docs rows of two numbers, so the texts need not be shuffled.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled")).select(F.coalesce("text", F.lit("")).alias("text"), "y")


def _counts(sample: DataFrame) -> DataFrame:
    """Documents that hold each feature, by label: feature, n0, n1. Summed in the tasks first."""

    def run(batches):
        held = (Counter(), Counter())

        def flush():
            names = list(held[0].keys() | held[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names), *[pa.array([h[f] for f in names], pa.int64()) for h in held]], names=["feature", "n0", "n1"])
            for h in held:
                h.clear()
            return out

        for batch in batches:
            y = batch.column("y").to_pylist()
            for first, _, texts in row_slices(batch.column("text")):
                for label, text in zip(y[first:], texts, strict=False):
                    seen: set[str] = set()
                    for piece in pieces(text.lower()):
                        seen.update(_TOKEN.findall(piece))
                    held[1 if label else 0].update({f for w in seen if w[0] not in ".!?\n" for f in features(w)})
                    if len(held[0]) + len(held[1]) > _FLUSH:
                        yield flush()
        if held[0] or held[1]:
            yield flush()

    return map_arrow(sample, run, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _fit(y: np.ndarray, empty: np.ndarray, doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, n_features: int, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Weights and constant that maximise the likelihood of the documents' labels under noisy-or, with a ridge.

    ``doc`` gives the document of each sentence that has features; ``sentence`` and ``feature`` list them.
    """
    w, bias = np.zeros(n_features), -6.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    n, ridge = len(y), 2.0
    for t in range(1, rounds + 1):
        z = np.bincount(sentence, w[feature], len(doc)) + bias
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + math.exp(-bias))
        clean = np.bincount(doc, -np.logaddexp(0, z), n) + empty * -np.logaddexp(0, bias)
        toxic = -np.expm1(np.minimum(clean, -1e-12))
        pull = np.where(y == 1, np.exp(clean) / toxic, -1.0)  # of each document on its sentences
        g = pull[doc] * p
        grad = np.append(np.bincount(feature, g[sentence], n_features) - ridge * w, g.sum() + (pull * empty).sum() * p0)
        grad /= n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (0.1 if t > 0.8 * rounds else 1)
        w, bias = w + step[:-1], float(np.clip(bias + step[-1], -14, 0))
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_features: int = MAX_FEATURES) -> Model:
    """Learn from ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text).

    Features are counted in the labelled sample over the cluster, and those whose presence tells most about the label
    are weighed. The weights are fitted here on the sample's bags of known features, of which there are ``max_docs`` at
    most, about. Without documents of both labels every score is the share of toxic ones.
    """
    sample = written(_sample(docs, labels, max_docs), "toxicity-sample")
    total = {r.y: r.n for r in sample.groupBy((F.col("y") != 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    if not n0 or not n1:
        share = min(max(n1 / max(n0 + n1, 1), 0.001), 0.999)
        return Model({}, math.log(share / (1 - share)))
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    p = (a + b) / (n0 + n1)
    told = (a - p * n1) ** 2 / (p * n1) + (b - p * n0) ** 2 / (p * n0)  # chi-square of presence and label
    best = _counts(sample).where((a + b >= MIN_DOCS) & (a + b < n0 + n1) & (told >= MIN_CHI2)).orderBy(told.desc(), "feature").limit(max_features)
    names = [r.feature for r in best.select("feature").collect()]
    index = {f: i for i, f in enumerate(names)}

    def run(batches):
        for batch in batches:
            y = batch.column("y").to_pylist()
            for first, last, texts in row_slices(batch.column("text")):
                got = [_bags(t, index) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bool(v)) for v in y[first:last]], pa.int32()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.list_(pa.int32())))],
                    names=["y", "empty", "bags"])

    rows = map_arrow(sample, run, "y int, empty long, bags array<array<int>>").toArrow()  # bounded by max_docs
    y, empty = (rows.column(c).to_numpy() for c in ("y", "empty"))
    bags = rows.column("bags").to_pylist()
    doc = np.repeat(np.arange(len(y)), [len(b) for b in bags])
    flat = [s for b in bags for s in b]
    sentence = np.repeat(np.arange(len(flat)), [len(s) for s in flat])
    feature = np.array([i for s in flat for i in s], np.int64)
    w, bias = _fit(y, empty.astype(float), doc, sentence, feature, len(names))
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_key and score of every row: the chance that some sentence is toxic.

    A missing text, or one without words, counts as one empty sentence. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights

    def run(batches):
        memory = _Memory(shared.value)
        for batch in batches:
            scores = [-math.expm1(_log_clean(memory, t)) for _, _, texts in row_slices(batch.column("text")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(scores, pa.float64())], names=["doc_id", "text_key", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.col("text").cast("string"))
    return map_arrow(rows, run, "doc_id long, text_key long, score double")


def locate(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The sentences that score ``threshold`` or more: doc_id, start and stop (code points), sentence, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        memory = _Memory(shared.value)
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            for first, _, texts in row_slices(batch.column("text")):
                for doc_id, text in zip(ids[first:], texts, strict=False):
                    begin = 0
                    for piece in pieces(text):
                        at = 0
                        for m in [*_END.finditer(piece), None]:
                            stop = m.start() if m else len(piece)
                            z = memory.sentences(piece[at:stop].lower())
                            if len(z):
                                p = math.exp(-np.logaddexp(0.0, -z[0]))
                                if p >= threshold:
                                    out.append((doc_id, begin + at, begin + stop, piece[at:stop], p))
                            at = m.end() if m else stop
                        begin += len(piece)
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "start", "stop", "sentence", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(rows, run, "doc_id long, start int, stop int, sentence string, score double")


def held_out() -> F.Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep():
        memory = _Memory(shared.value)
        return lambda batch: [-math.expm1(_log_clean(memory, t)) < threshold for _, _, texts in row_slices(batch.column("text")) for t in texts]

    return filter_rows(docs, keep)
