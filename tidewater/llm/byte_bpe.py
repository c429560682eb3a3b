"""Byte-level BPE by a rank file: texts to ids and back, merged in numpy matrices of pieces of like length."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.common import map_arrow, row_slices
from tidewater.llm.tokens import public_path

#: Pieces that a worker remembers before it starts anew.
REMEMBERED = 200_000
#: Characters cut into pieces at once; a longer text is parted before a blank between two non-blanks, where no piece crosses.
SPAN_CHARS = 1 << 18
#: Cells of a matrix of pieces.
CELLS = 1 << 18
#: Bytes of the longest piece that goes to a matrix.
WIDEST = 256
#: Bytes of ids or text that leave a task in one Arrow batch.
BATCH_BYTES = 4 << 20

# The public pattern on texts of these characters alone means the same as the plainer one below it.
_ODD = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]")
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")
_SEAM = re.compile(r"\S(?= \S)")


class PairTable:
    """Ranks of pairs of ids in an open-addressed hash table: where two ids' bytes together are a token, its id.

    Tokens' ids are their ranks. Keys are looked up for whole arrays; a pair without a token gives ``NONE``.
    """

    NONE = np.int32(np.iinfo(np.int32).max)
    _FREE = np.uint64(np.iinfo(np.uint64).max)

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        keys, values = np.array(keys, np.uint64), np.array(values, np.int32)
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, self._FREE), np.full(1 << bits, self.NONE)
        todo, place = np.arange(len(keys)), self._place(keys)
        while len(todo):  # keys whose place is taken go one place on
            at = place[todo]
            free = self.keys[at] == self._FREE
            self.keys[at[free]] = keys[todo[free]]
            won = self.keys[at] == keys[todo]
            self.values[at[won]] = values[todo[won]]
            todo = todo[~won]
            place[todo] = (place[todo] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        place = self._place(keys)
        found = self.keys[place]
        out = np.where(found == keys, self.values[place], self.NONE)
        open_ = np.flatnonzero(((found != keys) & (found != self._FREE)).ravel())
        flat, keys, place = out.ravel(), keys.ravel(), place.ravel()
        while len(open_):
            place[open_] = (place[open_] + 1) & self.mask
            found = self.keys[place[open_]]
            hit = found == keys[open_]
            flat[open_[hit]] = self.values[place[open_[hit]]]
            open_ = open_[~hit & (found != self._FREE)]
        return flat.reshape(out.shape)


class ByteBPE:
    """Encoder and decoder of one rank file; ids are ranks, and there are no special tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError("the rank file lacks single bytes")
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pattern = regex.compile(pattern)
        tokens = sorted(self.ranks.items(), key=lambda t: t[1])
        self.sizes = np.zeros(tokens[-1][1] + 1, np.int64)
        self.sizes[[r for _, r in tokens]] = [len(t) for t, _ in tokens]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        self.known: dict[str, bytes] = {}

    @cached_property
    def pairs(self) -> PairTable:
        """The hash table of pairs, which only encoding needs."""
        return PairTable(self.ranks)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, a span of the text at a time."""
        first = 0
        while first < len(text):
            last = len(text)
            if last - first > SPAN_CHARS:
                seam = _SEAM.search(text, first + SPAN_CHARS)
                last = seam.end() if seam else last
            span = text[first:last] if first or last < len(text) else text
            yield (self.pattern if _ODD.search(span) else _PLAIN).findall(span)
            first = last

    def _learn(self, new: list[str]) -> None:
        """Encode pieces that are not remembered: whole tokens by one lookup, the others in matrices of like length."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            raw = piece.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is not None:
                self.known[piece] = np.uint32(rank).tobytes()
            else:
                buckets.setdefault(max(3, (len(raw) - 1).bit_length()), []).append((piece, raw))
        for bits, group in buckets.items():
            if 1 << bits > WIDEST:
                self.known |= {piece: self.merge_long(raw) for piece, raw in group}
                continue
            rows = max(1, CELLS >> bits)
            for i in range(0, len(group), rows):
                part = group[i : i + rows]
                for (piece, _), ids in zip(part, self.merge([raw for _, raw in part]), strict=True):
                    self.known[piece] = ids

    def merge(self, raws: list[bytes]) -> list[bytes]:
        """The ids of byte strings of like length, one row of a padded matrix each.

        In each round every row merges its leftmost pair of least rank and closes the gap, so the matrix loses a column.
        Rows that have no pair left leave it.
        """
        sizes = np.array([len(r) for r in raws])
        width = int(sizes.max())
        filled = np.arange(width) < sizes[:, None]
        ids = np.full((len(raws), width), -1, np.int32)
        ids[filled] = self.first[np.frombuffer(b"".join(raws), np.uint8)]
        ranks = np.full((len(raws), width), PairTable.NONE)
        both = filled[:, 1:]
        ranks[:, :-1][both] = self.pairs.rank(ids[:, :-1][both], ids[:, 1:][both])
        row, out = np.arange(len(raws)), [b""] * len(raws)
        while len(row):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(row)), at]
            going = least != PairTable.NONE
            for k in np.flatnonzero(~going).tolist():
                out[row[k]] = ids[k, : sizes[k]].astype("<u4").tobytes()
            row, sizes, at, least = row[going], sizes[going] - 1, at[going], least[going]
            if not len(row):
                break
            width = int(sizes.max())
            source = np.arange(width) + (np.arange(width) > at[:, None])
            lines, every = np.flatnonzero(going)[:, None], np.arange(len(row))
            ids, ranks = ids[lines, source], ranks[lines, source]
            ids[every, at] = least
            ranks[every, at] = PairTable.NONE
            right, left = np.flatnonzero(at + 1 < sizes), np.flatnonzero(at > 0)
            ranks[right, at[right]] = self.pairs.rank(least[right], ids[right, at[right] + 1])
            ranks[left, at[left] - 1] = self.pairs.rank(ids[left, at[left] - 1], least[left])
        return out

    def merge_long(self, raw: bytes) -> bytes:
        """The ids of one long byte string: the same merges in the same order, the next one taken from a heap.

        A matrix row of ``n`` bytes may need ``n`` rounds, so long stretches without a cut would cost the square of their length.
        """
        n, get = len(raw), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # where the next part begins, and the one before
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1" * n)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or after[j] != end:
                continue  # one of the parts has grown since
            alive[j], after[i] = 0, end
            if end < n:
                before[end] = i
                if (rank := get(raw[i : after[end]])) is not None:
                    heapq.heappush(heap, (rank, i, after[end]))
            if (k := before[i]) >= 0 and (rank := get(raw[k:end])) is not None:
                heapq.heappush(heap, (rank, k, end))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[raw[i : after[i]]])
            i = after[i]
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut = [[p for span in self.pieces(t) for p in span] for t in texts]
        new: set[str] = set()
        for pieces in cut:
            new.update(pieces)
        new.difference_update(self.known)
        self._learn(list(new))
        get = self.known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids."""
        counts = np.array([len(x) // 4 for x in ids], np.int64)
        all_ids = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        sizes = self.sizes[all_ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        raw = self.bytes[np.repeat(self.starts[all_ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        stops = ends[np.cumsum(counts)].tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]


_coders: dict[tuple[str, str], ByteBPE] = {}


def coder(name: str, pattern: str | None = None) -> ByteBPE:
    """This worker's coder for the rank file ``name`` (a path, or a name among the public tokenizers)."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    key = (name, pattern)
    if key not in _coders:
        _coders[key] = ByteBPE(name if "/" in name else public_path(name), pattern)
    return _coders[key]


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows whose last value is binary, gathered to batches of bounded size."""
    out, held = [], 0
    for r in rows:
        out.append(r)
        held += len(r[-1])
        if held >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)


def encode(docs: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """The ids of every document: doc_id, n_tokens, ids (little-endian unsigned 32-bit).

    A missing text counts as empty and has no ids. Repeated rows give repeated rows, a missing ``doc_id`` stays missing,
    other columns are ignored, and an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for batch in batches:
            def rows(batch=batch):
                doc_ids, code = batch.column("doc_id").to_pylist(), coder(ranks)
                for first, _, texts in row_slices(batch.column("text")):
                    for doc_id, ids in zip(doc_ids[first:], code.encode(texts), strict=False):
                        yield doc_id, len(ids) // 4, ids

            yield from _batches(rows(), schema)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """The bytes of every list of ids, beside them: doc_id, n_tokens, ids, decoded. Missing ids count as none; an unknown id is an error."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches):
        for batch in batches:
            def rows(batch=batch):
                code, ids = coder(ranks), [x or b"" for x in batch.column("ids").to_pylist()]
                doc_ids, counts = batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist()
                first = 0
                while first < len(ids):  # some ids at a time
                    last, held = first, 0
                    while last < len(ids) and (last == first or held + len(ids[last]) <= BATCH_BYTES):
                        held += len(ids[last])
                        last += 1
                    yield from zip(doc_ids[first:last], counts[first:last], ids[first:last], code.decode(ids[first:last]), strict=True)
                    first = last

            yield from _batches(rows(), schema)

    return map_arrow(encoded.select("doc_id", "n_tokens", "ids"), run, "doc_id long, n_tokens long, ids binary, decoded binary")
