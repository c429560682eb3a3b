"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.common import map_arrow, row_slices, text_key, written
from tidewater.llm.hashing import mix

#: Documents of each language that the filters are fitted on, about.
MAX_DOCS = 4_000
#: Characters of an n-gram, bits of a filter's address, probes of a filter.
N, ADDRESS, PROBES = 4, 18, 3
#: An n-gram belongs to a language that holds it in this share of its documents and of its n-grams' best rate.
MIN_SHARE, MIN_RATE = 0.003, 0.2
UNKNOWN = "und"
_PIECE_CHARS = 1 << 19
_FACTOR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of lower-cased texts, and how many each text has. Words keep the blanks around them."""
    padded = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    if len(codes) < N:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    count = len(codes) - N + 1
    h = np.zeros(count, np.uint64)
    for k in range(N):
        h += (codes[k : k + count] + np.uint64(1)) * _FACTOR[k]
    within = np.ones(count, bool)  # an n-gram lies in one text
    crossing = (np.cumsum(sizes)[:-1, None] - np.arange(1, N)).ravel()
    within[crossing[(crossing >= 0) & (crossing < count)]] = False
    return mix(h[within]), np.maximum(sizes - N + 1, 0)


@dataclass
class Filters:
    """One Bloom filter for each language, sliced: a row of the table holds a bit for each language."""

    languages: list[str]
    table: np.ndarray
    common: str

    def rates(self) -> np.ndarray:
        """Chance that an n-gram of no language passes each language's filter."""
        return np.array([((self.table[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() ** PROBES for k in range(len(self.languages))])

    def members(self, h: np.ndarray) -> np.ndarray:
        """Masks of all languages that hold each n-gram."""
        return self.table[probe(h, 0)] & self.table[probe(h, 1)] & self.table[probe(h, 2)]


def probe(h: np.ndarray, k: int) -> np.ndarray:
    """Row of the table for the k-th probe of each n-gram."""
    return ((h >> np.uint64(k * ADDRESS)) & np.uint64((1 << ADDRESS) - 1)).astype(np.int64)


def _sample(docs: DataFrame, max_docs: int) -> DataFrame:
    """Texts of at most about ``max_docs`` documents of each language, chosen by a hash of ``doc_id`` and text.

    A text that many documents share is drawn as often as its share of them; rows that are repeated whole count once.
    """
    known = docs.where("lang is not null and text is not null").select("text", "lang", "doc_id")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language
    if not sizes:
        return known.select("text", "lang")
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, int(min(1.0, max_docs / r.n) * (1 << 30)))])
    drawn = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")))
    return drawn.dropDuplicates(["doc_id", "text", "lang"]).select("text", "lang")


def _document_counts(sample: DataFrame) -> DataFrame:
    """In how many documents of each language an n-gram is: lang, gram, n. Summed in the tasks first."""

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, _, texts in row_slices(batch.column("text")):
                for lang, text in zip(langs[first:], texts, strict=False):
                    own = np.unique(np.concatenate([np.unique(grams([text[i : i + _PIECE_CHARS]])[0]) for i in range(0, max(len(text), 1), _PIECE_CHARS)]))
                    held.setdefault(lang, []).append(own)
                    size += len(own)
                if size > 1 << 21:
                    yield from flush()
                    size = 0
        yield from flush()

    return map_arrow(sample, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, max_docs: int = MAX_DOCS) -> Filters:
    """Learn the filters from the texts of ``docs`` (text, lang) whose language is known.

    An n-gram belongs to every language where it is frequent and not much rarer than where it is most frequent. The
    filters' rows, of which there are 2**ADDRESS at most, are put together over the cluster.
    """
    sample = written(_sample(docs, max_docs), "language-sample")
    sizes = {r.lang: r.n for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    languages = sorted(sizes)
    if not languages:
        return Filters([], np.zeros((1 << ADDRESS, 1), np.uint64), UNKNOWN)
    spark = docs.sparkSession
    numbered = F.broadcast(spark.createDataFrame([(lang, k, sizes[lang]) for k, lang in enumerate(languages)], "lang string, k int, docs long"))
    rate = _document_counts(sample).where("n > 1").join(numbered, "lang").withColumn("rate", F.col("n") / F.col("docs")).where(F.col("rate") >= MIN_SHARE)
    rate = written(rate.select("gram", "k", "rate"), "language-rates")
    best = rate.groupBy("gram").agg(F.max("rate").alias("best"))
    own = rate.join(best, "gram").where(F.col("rate") >= MIN_RATE * F.col("best"))
    mask = (1 << ADDRESS) - 1
    rows = F.array(*[F.shiftrightunsigned("gram", k * ADDRESS).bitwiseAND(F.lit(mask)) for k in range(PROBES)])
    placed = own.select("k", F.explode(rows).alias("row")).groupBy("row", F.floor(F.col("k") / 64).cast("int").alias("slice"))
    bits = placed.agg(F.bit_or(F.expr("shiftleft(1L, k % 64)")).alias("bits"))
    table = np.zeros((1 << ADDRESS, -(-len(languages) // 64)), np.uint64)
    got = bits.toArrow()  # one row for each row of the table at most
    table[got.column("row").to_numpy(), got.column("slice").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return Filters(languages, table, max(languages, key=lambda x: (sizes[x], x)))


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, text_key, lang_pred and score (0 to 1) of every row, by its whole text.

    Counts, for each language, the text's n-grams that pass its filter, takes off those expected to pass by chance, and
    decides for the largest; equal counts go to the first name. ``score`` is its share of all counts. A missing text or one
    without a letter is ``und`` with score 0; letters that no filter knows give the commonest language with score 0.
    Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # a table of fixed size

    def run(batches):
        f = shared.value
        rates, names = f.rates(), f.languages
        for batch in batches:
            pred, score = [], []
            for _, _, texts in row_slices(batch.column("text")):
                counts, total = np.zeros((len(texts), len(names))), np.zeros(len(texts))
                parts = [(i, t[k : k + _PIECE_CHARS]) for i, t in enumerate(texts) for k in range(0, max(len(t), 1), _PIECE_CHARS)]
                h, sizes = grams([p for _, p in parts])
                owner = np.array([i for i, _ in parts])
                np.add.at(total, owner, sizes)
                ends = np.cumsum(sizes)
                masks = f.members(h)
                for k in range(len(names)):
                    passed = np.concatenate([[0], np.cumsum((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1), dtype=np.int64)])
                    np.add.at(counts[:, k], owner, passed[ends] - passed[ends - sizes])
                counts = np.maximum(0, (counts - total[:, None] * rates) / (1 - rates))
                for i, text in enumerate(texts):
                    if not any(map(str.isalpha, text)):
                        pred.append(UNKNOWN)
                        score.append(0.0)
                    elif not names or not counts[i].any():
                        pred.append(f.common)
                        score.append(0.0)
                    else:
                        k = int(counts[i].argmax())
                        pred.append(names[k])
                        score.append(float(counts[i, k] / counts[i].sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             names=["doc_id", "text_key", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.col("text").cast("string"))
    return map_arrow(rows, run, "doc_id long, text_key long, lang_pred string, score double")


def held_out() -> F.Column:
    """Rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
