"""Fill-in-middle: unit boundaries counted by ranks in a wavelet matrix over character classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewater.llm.common import map_arrow, text_slices

#: Marks that open the prefix, the suffix and the middle.
MARKS = (b"<P>", b"<S>", b"<M>")
# A byte's class, a sum of flags: not a blank, last of its run of blanks or non-blanks, a line feed, first of a code point.
SOLID, LAST, LINE, LEAD = 8, 4, 2, 1
_LEVELS = 4


class WaveletMatrix:
    """Ranks in a sequence of small symbols: how many of the first ``p`` symbols are of one kind, for many ``p`` at once.

    One bit vector a level, the highest bit first; after each level the sequence is parted by the bit, zeros first. A
    bit vector is words of 64 bits with the count of ones before each, so a rank is one lookup and one population count.
    """

    def __init__(self, symbols: np.ndarray, levels: int = _LEVELS):
        self.n, self.levels, self.words, self.before, self.zeros = len(symbols), levels, [], [], []
        for level in reversed(range(levels)):
            bits = symbols >> level & 1
            packed = np.zeros(self.n // 64 + 1, "<u8")
            raw = np.packbits(bits, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            ones = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=ones[1:])
            self.words.append(packed)
            self.before.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def _ones(self, level: int, p: np.ndarray) -> np.ndarray:
        word = p >> 6
        low = (np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & low)

    def rank(self, p: np.ndarray, value: int, care: int) -> np.ndarray:
        """How many of the first ``p`` symbols equal ``value`` in the bits of ``care``; other bits may be anything.

        A level whose bit is of no matter is walked both ways and the counts are added.
        """
        return self._walk(0, np.asarray(p, np.int64), np.zeros((), np.int64), value, care)

    def _walk(self, level: int, end: np.ndarray, start: np.ndarray, value: int, care: int) -> np.ndarray:
        below = 1 << (self.levels - level)
        if not care & (below - 1):  # also behind the last level
            return end - start
        bit = below >> 1
        ends, starts = self._ones(level, end), self._ones(level, start)
        total = 0
        if not care & bit or value & bit:
            total = total + self._walk(level + 1, self.zeros[level] + ends, self.zeros[level] + starts, value, care)
        if not care & bit or not value & bit:
            total = total + self._walk(level + 1, end - ends, start - starts, value, care)
        return total


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of every byte of texts laid end to end, which begin at ``starts`` (the last entry is the end)."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    last = np.empty(len(data), bool)
    last[:-1] = blank[1:] != blank[:-1]
    ends = starts[1:][starts[1:] > starts[:-1]] - 1
    last[ends] = True
    return (~blank * SOLID + last * LAST + (data == 10) * LINE + ((data & 0xC0) != 0x80) * LEAD).astype(np.uint8)


class Units:
    """Boundary counts of texts laid end to end: words with the blanks before them, or lines.

    A unit of words ends with each run of non-blanks, and with the blanks that end a text; one of lines ends with each
    line feed and at the end of a text. Both are sums of ranks, and the k-th boundary is found by bisection on them.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, unit: str = "word"):
        self.starts, self.unit = starts, unit
        kinds = classes(data, starts)
        self.matrix = WaveletMatrix(kinds)
        filled = starts[1:] > starts[:-1]
        final = np.zeros(len(starts) - 1, np.uint8)
        final[filled] = kinds[starts[1:][filled] - 1]
        closed = final & (SOLID if unit == "word" else LINE)
        self.open = filled & (closed == 0)  # the text's last unit ends without a mark of its own
        self.base = self._marked(starts[:-1])
        self.count = self._marked(starts[1:]) - self.base + self.open

    def _marked(self, p: np.ndarray) -> np.ndarray:
        if self.unit == "word":
            return self.matrix.rank(p, SOLID | LAST, SOLID | LAST)
        return self.matrix.rank(p, LINE, LINE)

    def chars(self, p: np.ndarray) -> np.ndarray:
        """Code points before each place."""
        return self.matrix.rank(p, LEAD, LEAD)

    def cut(self, k: np.ndarray) -> np.ndarray:
        """For each text the place behind its first ``k`` units (0 up to all): the least place with so many boundaries before it."""
        low, high = self.starts[:-1].copy(), self.starts[1:].copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self._marked(middle) - self.base >= k
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return np.where(k >= self.count, self.starts[1:], low)


def _draws(seed: int, id_col: str) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first groups of the SHA-256 of ``seed:id`` (no id: nothing behind the colon)."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42, unit: str = "word") -> DataFrame:
    """Rearrange documents for fill-in-middle: doc_id, n, form, output, prefix_chars, middle_chars.

    Two cuts between units (``unit`` word or line) part a text in prefix, middle and suffix, drawn from a hash of the
    ``doc_id``, so a run that is repeated gives the same cuts. ``rate`` of 100 texts are rearranged, ``spm_rate`` of 100 of those with the
    suffix first; the others, empty or missing texts and texts that hold a mark are ``plain``: their output is the text and
    their counts of code points are null. ``n`` is the number of units. Repeated rows give repeated rows, a missing
    ``doc_id`` counts as an empty one, other columns are ignored, and an empty table gives no rows.
    """
    p_mark, s_mark, m_mark = MARKS
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("output", pa.binary()),
                        ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            draws = np.stack([batch.column(f"h{i}").to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4)]) if batch.num_rows else None
            for first, last, data, starts in text_slices(batch.column("text")):
                units = Units(data, starts, unit)
                h1, h2, h3, h4 = draws[:, first:last]
                one, two = h1 % (units.count + 1), h2 % (units.count + 1)
                a, b = units.cut(np.minimum(one, two)), units.cut(np.maximum(one, two))
                before, between = units.chars(a) - units.chars(starts[:-1]), units.chars(b) - units.chars(a)
                raw = data.tobytes()
                forms, outs = [], []
                for k, (s, x, y, e) in enumerate(zip(starts[:-1].tolist(), a.tolist(), b.tolist(), starts[1:].tolist(), strict=True)):
                    text = raw[s:e]
                    if not text or h3[k] % 100 >= rate or any(m in text for m in MARKS):
                        forms.append("plain")
                        outs.append(text)
                    elif h4[k] % 100 < spm_rate:
                        forms.append("spm")
                        outs.append(b"".join((s_mark, raw[y:e], p_mark, raw[s:x], m_mark, raw[x:y])))
                    else:
                        forms.append("psm")
                        outs.append(b"".join((p_mark, raw[s:x], s_mark, raw[y:e], m_mark, raw[x:y])))
                plain = np.array([f == "plain" for f in forms])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, last - first), pa.array(units.count, pa.int64()), pa.array(forms), pa.array(outs, pa.binary()),
                    pa.array(before, pa.int64(), mask=plain), pa.array(between, pa.int64(), mask=plain)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *_draws(seed, "doc_id"))
    out = map_arrow(rows, run, "doc_id long, n long, form string, output binary, prefix_chars long, middle_chars long")
    return out.withColumn("output", F.col("output").cast("string"))


def restored() -> Column:
    """The text that ``output`` was made of, by its ``form``: a rearranged text holds each mark once."""
    parts = F.split("output", "|".join(m.decode() for m in MARKS), -1)
    one, two, three = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    psm, spm = F.concat(one, three, two), F.concat(two, three, one)
    return F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("output"))
