"""SimHash near-duplicates by tiled exact comparison."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.common import keep_rows, map_arrow, row_slices, text_key, written
from tidewater.llm.graphs import components

SEED = 42
#: Fingerprints in a tile, and the rows and columns of the blocks that a tile pair is compared by.
TILE = 32768
ROWS, COLS = 64, 512
#: Bytes of a text whose shingles are hashed at once.
_PIECE = 1 << 19
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
#: Links of a tile pair that are held before they are reduced to a forest.
_HELD = 1 << 20


def fingerprint(text: str, n: int) -> bytes:
    """The 64-bit SimHash of word ``n``-grams, most significant byte first.

    A-Z are lower-cased; words are runs without ASCII blanks. Fewer words than ``n`` are one shingle; none give zero.
    """
    data = text.encode("utf-8", "surrogatepass").lower()
    counts, total, at, words = np.zeros(64, np.int64), 0, 0, []
    while at < len(data):  # a long text is read piece by piece, the last words of one going on with the next
        blank = _BLANK.search(data, at + _PIECE) if len(data) - at > _PIECE else None
        end = blank.end() if blank else len(data)
        words += data[at:end].split()
        at = end
        if len(words) >= n:
            counts += _bit_counts(words, n)
            total += len(words) - n + 1
            words = words[len(words) - n + 1 :]
    if not total:
        if not words:
            return bytes(8)
        counts, total = _bit_counts(words, len(words)), 1
    return np.packbits(counts * 2 > total).tobytes()


def _bit_counts(words: list[bytes], n: int) -> np.ndarray:
    """In how many hashes of the ``n``-grams of ``words`` each bit is set."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts, digest = np.concatenate([[0], ends[:-1] + 1]).tolist(), xxhash.xxh64_digest
    raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends[n - 1 :].tolist(), strict=False)])
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, n: int = 4) -> DataFrame:
    """doc_id, text_key and fingerprint (a signed long) of every row."""

    def run(batches):
        for batch in batches:
            raw = b"".join(fingerprint(t, n) for _, _, texts in row_slices(batch.column("text")) for t in texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))],
                names=["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), F.col("text").cast("string"))
    return map_arrow(rows, run, "doc_id long, text_key long, fp long")


def populations(fps: np.ndarray) -> np.ndarray:
    """Bit counts of each fingerprint's four 16-bit parts."""
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def forest(size: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as ``a``-``b`` among nodes 0 to size - 1, at most one per node."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    child = np.flatnonzero(label != np.arange(size))
    return child, label[child]


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles of sorted fingerprints, or within one, reduced to a forest.

    Nodes are numbered through left, then right. Blocks whose bit counts, over the four parts, are farther apart than
    the radius are skipped: each differing bit changes one part's count by one.
    """
    own = right is None
    right = left if own else right
    size = len(left) + (0 if own else len(right))
    shift = 0 if own else len(left)
    row_at, col_at = np.arange(0, len(left), ROWS), np.arange(0, len(right), COLS)
    pl, pr = populations(left), populations(right)
    row_low, row_high = np.minimum.reduceat(pl, row_at), np.maximum.reduceat(pl, row_at)
    col_low, col_high = np.minimum.reduceat(pr, col_at), np.maximum.reduceat(pr, col_at)
    found_a, found_b, held = [], [], 0
    for k, r in enumerate(row_at):
        gap = np.maximum(0, np.maximum(row_low[k] - col_high, col_low - row_high[k])).sum(axis=1)
        rows = left[r : r + ROWS, None]
        for c in col_at[gap <= radius]:
            if own and c + COLS <= r:
                continue
            near = np.bitwise_count(rows ^ right[None, c : c + COLS]) <= radius
            if near.any():
                i, j = np.nonzero(near)
                i, j = i + r, j + c
                if own:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    found_a.append(i)
                    found_b.append(j + shift)
                    held += len(i)
                if held > _HELD:
                    a, b = forest(size, np.concatenate(found_a), np.concatenate(found_b))
                    found_a, found_b, held = [a], [b], len(a)
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(size, np.concatenate(found_a), np.concatenate(found_b))


def _tiles(classes: DataFrame) -> DataFrame:
    """Fingerprints in tiles of neighbouring bit counts: tile, low and high count, fps."""
    part = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(3)]
    count = max(1, math.ceil(classes.count() / TILE))
    keyed = classes.select("fp", F.bit_count("fp").alias("bits"), *[p.alias(f"p{k}") for k, p in enumerate(part)])
    order = ["bits", "p0", "p1", "p2", "fp"]

    def gather(batches):
        held, n = [], 0

        def tile():
            fps = np.concatenate(held)
            bits = np.bitwise_count(fps)
            return pa.RecordBatch.from_arrays(
                [pa.array([int(bits.min())], pa.int32()), pa.array([int(bits.max())], pa.int32()), pa.array([fps.tobytes()], pa.binary())],
                names=["low", "high", "fps"])

        for batch in batches:
            held.append(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            n += len(held[-1])
            if n >= 2 * TILE:
                yield tile()
                held, n = [], 0
        if n:
            yield tile()

    ranged = keyed.repartitionByRange(count, *order).sortWithinPartitions(*order).select("fp")
    tiles = map_arrow(ranged, gather, "low int, high int, fps binary")
    return written(tiles.withColumn("tile", F.monotonically_increasing_id()), "tiles")


def links(classes: DataFrame, radius: int) -> DataFrame:
    """Links between distinct fingerprints (``fp``) at ``radius`` or fewer differing bits, as forests of tile pairs.

    Tiles meet on their ranges of bit counts by an equi-join; two tiles whose ranges are farther apart than the radius
    never meet. The number of pairs is quadratic in the number of tiles, as the comparison is exact.
    """
    tiles = _tiles(classes)
    a = tiles.select(F.col("tile").alias("a"), F.col("low").alias("low_a"), F.explode(F.sequence(F.col("low") - radius, F.col("high") + radius)).alias("bits"))
    b = tiles.select(F.col("tile").alias("b"), F.col("low").alias("low_b"), F.explode(F.sequence("low", "high")).alias("bits"))
    pairs = a.join(b, "bits").where((F.col("a") <= F.col("b")) & (F.col("bits") == F.greatest(F.col("low_a") - radius, "low_b"))).select("a", "b")
    blob = tiles.select("tile", "fps")
    both = (pairs.join(blob.withColumnRenamed("tile", "a").withColumnRenamed("fps", "left"), "a")
            .join(blob.withColumnRenamed("tile", "b").withColumnRenamed("fps", "right"), "b"))
    # One pair is minutes of work at most and half a megabyte, so every pair may be a task of its own.
    spread = both.repartition(classes.sparkSession.sparkContext.defaultParallelism * 8, "a", "b")

    def compare(batches):
        for batch in batches:
            for x, y, left, right in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "left", "right")), strict=True):
                left = np.frombuffer(left, np.uint64)
                right = None if x == y else np.frombuffer(right, np.uint64)
                nodes = left if right is None else np.concatenate([left, right])
                i, j = tile_links(left, right, radius)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i].view(np.int64)), pa.array(nodes[j].view(np.int64))], names=["a", "b"])

    return map_arrow(spread, compare, "a long, b long")


def _linked(docs: DataFrame, n: int, radius: int) -> DataFrame:
    """doc_id, text_key, fp, root (a fingerprint that names the group) and component_id of every row."""
    fps = written(fingerprints(docs, n), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprint-classes")
    roots = components(links(classes, radius))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "fingerprint-roots")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = written(rooted.join(lowest, "root").select("fp", "root", "component_id"), "fingerprint-components")
    return fps.join(named, "fp")


def near_groups(docs: DataFrame, n: int = 4, radius: int = 4) -> DataFrame:
    """Group documents whose SimHash fingerprints are linked by ``radius`` or fewer differing bits, over any chain.

    A missing or blank text has fingerprint zero and is linked like any other. Equal fingerprints are one class, so
    copies are never compared. Gives one row per row of ``docs``: doc_id, text_key, fingerprint (16 hex digits),
    component_id (the smallest doc_id reachable; missing only if the whole group has none). Other columns of ``docs``
    are ignored. An empty table gives no rows.
    """
    return _linked(docs, n, radius).select("doc_id", "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, n: int = 4, radius: int = 4) -> DataFrame:
    """Of each group the row with the smallest ``doc_id`` stays, with all its columns; a missing one comes last.

    Groups may have no ``doc_id``, or the same smallest one: each is told by its root. Of rows that share the smallest
    ``doc_id`` the one with the smallest fingerprint and text hash stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.lpad(F.hex("fp"), 16, "0").alias("fingerprint"), "text_key")
    first = _linked(docs, n, radius).groupBy("root").agg(F.min(order).alias("best"))
    return keep_rows(docs, first.select("best.doc_id", "best.text_key"))
