"""Repeated byte strings across documents: a sparse enhanced suffix array, dealt out by anchors.

Every string of ``min_bytes`` bytes holds an anchor: the ``K``-byte string of the least hash in it. Equal strings have
equal anchors at equal places, so suffixes need to meet only where they share an anchor, and a text has one anchor in
about sixteen bytes. An anchor's context, ``REACH`` bytes before it and ``min_bytes`` from it on, holds every string
that it stands for.

1. Anchors travel as (hash of the anchor, hash of the context, document, place), packed by bucket. Within a task, of
   equal contexts only those of the smallest document travel; the others are covered by it.
2. A bucket settles equal contexts by the smallest document and asks for the bytes of contexts that differ though their
   anchors agree.
3. These contexts form a suffix array with common-prefix lengths; a stack scan gives the intervals of its tree, and
   those of at least ``min_bytes`` whose left extensions differ are the maximal repeats, with all their occurrences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidewater.llm.common import map_arrow, text_slices, written
from tidewater.llm.hashing import mix, powers, prefix_sums

#: Bytes of an anchor.
K = 18
#: Anchors that a task holds before it sends them on.
FLUSH = 1 << 18
#: Bytes of one text that are searched at once.
PIECE = 4 << 20
#: Contexts that a suffix array is built over at once, if no anchor has more.
GATHERED = 1 << 15
#: Differing contexts of one anchor beyond which its strings are matched one by one over the cluster.
CROWD = 1 << 19

SPAN = "d long, ver long, start int, stop int"


def _slide(fn, x: np.ndarray, width: int) -> np.ndarray:
    """``fn`` over every run of ``width`` values."""
    step = 1
    while step * 2 <= width:
        x = fn(x[:-step], x[step:])
        step *= 2
    return fn(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def find_anchors(data: np.ndarray, offsets: np.ndarray, min_bytes: int):
    """Anchors of joined texts: hash, context hash, row, place in the text, bytes of context from the anchor on."""
    reach, n = min_bytes - K, len(data)
    prefix, inverse = prefix_sums(data), powers(n + 1)[1]
    grams = mix((prefix[K:] - prefix[:-K]) * inverse[: n - K + 1])
    least = _slide(np.minimum, grams, reach + 1)
    start, stop = offsets[:-1], offsets[1:]
    whole = stop - start >= min_bytes
    inside = np.zeros(len(least) + 1, np.int32)
    np.add.at(inside, start[whole], 1)
    np.add.at(inside, stop[whole] - min_bytes + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    most = np.zeros(len(grams) + reach, np.uint64)
    most[reach : reach + len(least)] = np.where(inside, least, np.uint64(0))
    at = np.flatnonzero(_slide(np.maximum, most, reach + 1) == grams)
    row = np.searchsorted(offsets, at, "right") - 1
    left, right = np.maximum(at - reach, start[row]), np.minimum(at + min_bytes, stop[row])
    shape = ((at - left).astype(np.uint64) << np.uint64(32)) + (right - at).astype(np.uint64)
    context = mix((prefix[right] - prefix[left]) * inverse[left] + mix(shape))
    return grams[at], context, row, at - start[row], (right - at)


def _planes(*columns: np.ndarray) -> bytes:
    """Columns as planes of bytes, which compress well."""
    return b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)


def _columns(raw: bytes, n: int, *types) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        size = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(t).reshape(n))
        at += n * size
    return out


_ANCHOR = (np.uint64, np.uint64, np.int64, np.int64, np.int32, np.uint8)
_SPANS = (np.int64, np.int64, np.int32, np.int32)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _sizes(begin: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(begin, n))


def _combined(h, c, d, ver, pos, tail, reach):
    """Anchors of a task that must travel, and the spans of those that a smaller document of the task covers."""
    order = np.argsort(mix(h + (c << np.uint64(1))))
    begin = _runs(h[order], c[order])
    least = np.empty(len(h), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(d[order], begin), _sizes(begin, len(h)))
    go = d == least
    gone = ~go
    spans = (d[gone], ver[gone], np.maximum(0, pos[gone] - reach), pos[gone] + tail[gone])
    return [x[go] for x in (h, c, d, ver, pos, tail)], spans


def anchor_blobs(docs: DataFrame, min_bytes: int, buckets: int) -> DataFrame:
    """Anchors of ``docs`` (d, ver, text) packed by bucket: bucket, n, anchors, m, spans."""
    reach = min_bytes - K

    def run(batches):
        held, n = [], 0

        def flush():
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            (h, c, d, ver, pos, tail), spans = _combined(*columns, reach)
            bucket = (h % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            share = np.linspace(0, len(spans[0]), buckets + 1).astype(np.int64)
            rows = []
            for b in range(buckets):
                o, s = order[bounds[b] : bounds[b + 1]], slice(share[b], share[b + 1])
                if len(o) or share[b + 1] > share[b]:
                    rows.append((b, len(o), _planes(h[o], c[o], d[o], ver[o], pos[o], tail[o]),
                                 int(share[b + 1] - share[b]), _planes(spans[0][s], spans[1][s], spans[2][s].astype(np.int32), spans[3][s].astype(np.int32))))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds, strict=True)], names=["bucket", "n", "anchors", "m", "spans"])

        for batch in batches:
            d, ver = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "ver"))
            for first, _, data, offsets in text_slices(batch.column("text"), 1 << 18):
                if len(data) < min_bytes:
                    continue
                step = PIECE if len(offsets) == 2 else len(data)  # a long text is searched piece by piece
                for begin in range(0, len(data), step):
                    low, high = max(0, begin - reach), min(len(data), begin + step + min_bytes)
                    if high - low < min_bytes:
                        continue
                    h, c, row, pos, tail = find_anchors(data[low:high], offsets if step == len(data) else np.array([0, high - low]), min_bytes)
                    if step != len(data):
                        pos += low
                        own = (pos >= begin) & (pos < begin + step)
                        h, c, row, pos, tail = (x[own] for x in (h, c, row, pos, tail))
                    row += first
                    held.append((h, c, d[row], ver[row], pos.astype(np.int32), tail.astype(np.uint8)))
                    n += len(h)
                if n >= FLUSH:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    return map_arrow(docs, run, "bucket int, n int, anchors binary, m int, spans binary")


def settle(h, c, d, ver, pos, tail, reach: int, crowd: int = CROWD):
    """Compare the anchors of a bucket.

    Gives the spans that equal contexts of a smaller document cover, and the anchors whose contexts must be read: those
    of the smallest document of each context, where an anchor has several contexts and several documents.
    """
    order = np.argsort(h)
    begin = _runs(h[order])
    shared = np.minimum.reduceat(d[order], begin) != np.maximum.reduceat(d[order], begin)
    o = order[np.repeat(shared, _sizes(begin, len(h)))]
    if not len(o):
        return [x[:0] for x in (d, ver, pos, tail)], [x[:0] for x in (h, d, ver, pos, tail, pos)]
    h, c, d, ver, pos, tail = (x[o] for x in (h, c, d, ver, pos, tail))
    o = np.lexsort((c, h))
    h, c, d, ver, pos, tail = (x[o] for x in (h, c, d, ver, pos, tail))
    begin = _runs(h, c)
    least = np.repeat(np.minimum.reduceat(d, begin), _sizes(begin, len(h)))
    gone = d > least
    spans = [d[gone], ver[gone], np.maximum(0, pos[gone] - reach), pos[gone] + tail[gone]]
    group = _runs(h)
    kinds = np.diff(np.append(np.searchsorted(begin, group), len(begin)))
    kinds = np.repeat(kinds, _sizes(group, len(h)))
    ask = ~gone & (kinds > 1)
    return spans, [h[ask], d[ask], ver[ask], pos[ask], tail[ask], (kinds[ask] > crowd).astype(np.int32)]


def settled(blobs: DataFrame, min_bytes: int, crowd: int) -> DataFrame:
    """Per bucket the spans (h missing) and the contexts to read (h given)."""
    reach = min_bytes - K
    names = ["h", "d", "ver", "start", "stop", "crowded"]

    def answer(parts, spans):
        got, ask = settle(*[np.concatenate(x) for x in zip(*parts, strict=True)], reach, crowd) if parts else ([np.zeros(0, np.int64)] * 4, [np.zeros(0, np.int64)] * 6)
        spans.append(got)
        d, ver, start, stop = (np.concatenate(x) for x in zip(*spans, strict=True))
        cut = 1 << 18
        for i in range(0, len(d), cut):
            s = slice(i, i + cut)
            none = pa.nulls(len(d[s]), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(d[s]), pa.array(ver[s]), pa.array(start[s].astype(np.int32)), pa.array(stop[s].astype(np.int32)), none.cast(pa.int32())], names=names)
        h, d, ver, pos, tail, crowded = ask
        for i in range(0, len(h), cut):
            s = slice(i, i + cut)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[s].view(np.int64)), pa.array(d[s]), pa.array(ver[s]), pa.array(pos[s].astype(np.int32)), pa.array((pos[s] + tail[s]).astype(np.int32)), pa.array(crowded[s].astype(np.int32))], names=names)

    def run(batches):
        bucket, parts, spans = None, [], []
        for batch in batches:
            for b, n, anchors, m, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "anchors", "m", "spans")), strict=True):
                if b != bucket and (parts or spans):
                    yield from answer(parts, spans)
                    parts, spans = [], []
                bucket = b
                if n:
                    parts.append(_columns(anchors, n, *_ANCHOR))
                if m:
                    spans.append(_columns(raw, m, *_SPANS))
        if parts or spans:
            yield from answer(parts, spans)

    rows = blobs.repartition("bucket").sortWithinPartitions("bucket")
    return map_arrow(rows, run, "h long, d long, ver long, start int, stop int, crowded int")


def _words(raw: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as big-endian numbers that sort like them, most significant first."""
    padded = np.zeros((len(raw), -(-raw.shape[1] // 8) * 8), np.uint8)
    padded[:, : raw.shape[1]] = raw
    return list(padded.view(">u8").astype(np.uint64).T)


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows, at most ``most``."""
    differ = a != b
    run = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(run, most)


def _sorted(group: np.ndarray, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by group and bytes, and each row's common prefix with the one before."""
    order = np.lexsort([*_words(raw)[::-1], group])
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = _common(raw[order[1:]], raw[order[:-1]], np.minimum(size[order[1:]], size[order[:-1]]))
    lcp[1:][group[order[1:]] != group[order[:-1]]] = -1
    lcp[:1] = -1
    return order, lcp


def intervals(lcp: np.ndarray, least: int):
    """Stack scan: the intervals (common prefix, first, last) of the common-prefix tree of at least ``least``.

    ``lcp[i]`` is the common prefix of suffixes i - 1 and i; stretches below ``least`` are stepped over.
    """
    high = np.flatnonzero(lcp >= least)
    if not len(high):
        return
    for stretch in np.split(high, np.flatnonzero(np.diff(high) > 1) + 1):
        stack: list[tuple[int, int]] = []
        for i, value in zip(stretch.tolist(), lcp[stretch].tolist(), strict=True):
            first = i - 1
            while stack and stack[-1][0] > value:
                top, first = stack.pop()
                yield top, first, i - 1
            if not stack or stack[-1][0] < value:
                stack.append((value, first))
        last = int(stretch[-1])
        while stack:
            top, first = stack.pop()
            yield top, first, last


def maximal_repeats(group, left, left_size, right, right_size, min_bytes: int):
    """Maximal repeats of at least ``min_bytes`` among contexts that share an anchor (equal ``group``).

    ``left`` holds the bytes before the anchor, nearest first, ``right`` those from it on. Gives (length, members, bytes
    of each occurrence before the anchor). Bytes beyond a context belong to other anchors, and count as differing.
    """
    reach = left.shape[1]
    alive = np.arange(len(group))
    while True:  # a context with too little in common with any other has no part; without it others may have none
        lo, ll = _sorted(group[alive], left[alive], left_size[alive])
        ro, rl = _sorted(group[alive], right[alive], right_size[alive])
        best = []
        for order, lcp in ((lo, ll), (ro, rl)):
            both = np.maximum(lcp, np.append(lcp[1:], -1))
            own = np.empty(len(order), np.int64)
            own[order] = both
            best.append(own)
        keep = (best[0] >= 0) & (best[1] >= 0) & (best[0] + best[1] >= min_bytes)
        if keep.all():
            break
        alive = alive[keep]
        if not len(alive):
            return
    rank = np.empty(len(alive), np.int64)
    rank[ro] = np.arange(len(ro))
    size = left_size[alive]
    suffixes, depths, nodes, shift = [], [], [], 0
    for j in range(reach + 1):  # the nodes at depth j of the tree of left extensions
        node = np.cumsum(ll < j)
        count = int(node[-1]) + 1
        open_ = size[lo] >= j
        differs = np.zeros(count, bool)
        differs[node[ll == j]] = True
        differs[node[open_ & (size[lo] == j)]] = True
        members = np.bincount(node[open_], minlength=count)
        take = open_ & (members[node] > 1) & ((j == reach) | differs[node])
        suffixes.append(lo[take])
        depths.append(np.full(int(take.sum()), j))
        nodes.append(node[take] + shift)
        shift += count
    suffix, depth, node = (np.concatenate(x) for x in (suffixes, depths, nodes))
    order = np.lexsort((rank[suffix], node))
    suffix, depth, node = suffix[order], depth[order], node[order]
    at = alive[suffix]
    lcp = np.zeros(len(at), np.int64)
    lcp[1:] = depth[1:] + _common(right[at[1:]], right[at[:-1]], np.minimum(right_size[at[1:]], right_size[at[:-1]]))
    lcp[1:][node[1:] != node[:-1]] = 0
    # The byte before each suffix; none at the edge of a context or text, which differs from every other.
    before = np.where(depth < left_size[at], left[at, np.minimum(depth, reach - 1)].astype(np.int64), -1)
    for length, first, last in intervals(lcp, min_bytes):
        ahead = before[first : last + 1]
        if ahead[0] >= 0 and (ahead == ahead[0]).all():
            continue  # extends to the left in the same way everywhere: part of a longer repeat
        yield length, at[first : last + 1], depth[first : last + 1]


def contexts(texts: DataFrame, asked: DataFrame, min_bytes: int) -> DataFrame:
    """Read the asked contexts from ``texts`` (d, ver, text): h, d, ver, start (of the anchor), bytes on both sides, crowded."""
    reach = min_bytes - K
    lists = asked.groupBy("d", "ver").agg(F.collect_list(F.struct("h", "start", "stop", "crowded")).alias("asked"))

    def run(batches):
        for batch in batches:
            col = batch.column("asked").combine_chunks() if isinstance(batch.column("asked"), pa.ChunkedArray) else batch.column("asked")
            offsets, flat = np.asarray(col.offsets), col.values
            h, start, stop, crowded = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            d, ver = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "ver"))
            text = batch.column("text").cast(pa.large_binary()).fill_null(b"")
            begin = max(0, int(offsets[0]))
            row = np.repeat(np.arange(len(d)), np.diff(offsets))
            items = slice(begin, int(offsets[-1]))
            h, start, stop, crowded = (x[items] for x in (h, start, stop, crowded))
            raw, at = [], -1
            for k, (r, s, e) in enumerate(zip(row.tolist(), start.tolist(), stop.tolist(), strict=True)):
                if r != at:
                    data, at = text[r].as_py(), r
                raw.append(data[max(0, s - reach) : e])
            for i in range(0, len(h), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[s]), pa.array(d[row[s]]), pa.array(ver[row[s]]), pa.array(start[s]), pa.array(raw[s], pa.binary()), pa.array(crowded[s])],
                    names=["h", "d", "ver", "start", "bytes", "crowded"])

    # doc_id goes along so that both joins of the texts read the same shuffle.
    rows = texts.join(lists, ["d", "ver"]).select("d", "ver", "text", "asked", "doc_id")
    return map_arrow(rows, run, "h long, d long, ver long, start int, bytes binary, crowded int")


def repeat_groups(found: DataFrame, min_bytes: int) -> DataFrame:
    """Occurrences of the maximal repeats among contexts that differ: d, ver, start, stop, first (smallest d of the group)."""
    reach = min_bytes - K

    def answer(parts):
        table = pa.Table.from_batches(parts)
        h, d, ver, at = (table.column(c).to_numpy() for c in ("h", "d", "ver", "start"))
        raw = table.column("bytes").combine_chunks()
        raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        data = np.frombuffer(raw.buffers()[2], np.uint8)
        before = np.minimum(at, reach).astype(np.int64)
        tail = np.diff(offsets) - before
        anchor = offsets[:-1] + before
        left, right = np.zeros((len(h), reach), np.uint8), np.zeros((len(h), min_bytes), np.uint8)
        for j in range(reach):
            has = before > j
            left[has, j] = data[anchor[has] - j - 1]
        for j in range(min_bytes):
            has = tail > j
            right[has, j] = data[anchor[has] + j]
        out = [[], [], [], [], []]
        for length, members, depth in maximal_repeats(h, left, before, right, tail, min_bytes):
            first = d[members].min()
            start = at[members] - depth
            for store, x in zip(out, (d[members], ver[members], start, start + length, np.full(len(members), first)), strict=True):
                store.append(x)
        if out[0]:
            kinds = (np.int64, np.int64, np.int32, np.int32, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in zip(out, kinds, strict=True)], names=["d", "ver", "start", "stop", "first"])

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            h = batch.column("h").to_numpy()
            if n >= GATHERED:  # go on to the end of the anchor at hand
                same = h == parts[-1].column("h")[-1].as_py()
                end = len(h) if same.all() else int(np.argmin(same))
                if end:
                    parts.append(batch.slice(0, end))
                if end < len(h):
                    yield from answer(parts)
                    parts, n, batch = [batch.slice(end)], len(h) - end, None
                    continue
                n += end
                continue
            parts.append(batch)
            n += len(h)
        if n:
            yield from answer(parts)

    rows = found.select("h", "d", "ver", "start", "bytes").repartition("h").sortWithinPartitions("h")
    return map_arrow(rows, run, SPAN + ", first long")


def crowded_spans(found: DataFrame, min_bytes: int) -> DataFrame:
    """Spans among the contexts of anchors that have too many for one task: each string is matched by itself."""
    reach = min_bytes - K
    before = F.least("start", F.lit(reach))
    each = found.select("d", "ver", (F.col("start") - before).alias("base"), "bytes", F.explode(F.sequence(F.lit(0), F.length("bytes") - min_bytes)).alias("k"))
    strings = each.select("d", "ver", (F.col("base") + F.col("k")).alias("start"), F.substring("bytes", F.col("k") + 1, F.lit(min_bytes)).alias("string"))
    least = strings.groupBy("string").agg(F.min("d").alias("first"))
    return strings.join(least, "string").where("d > first").select("d", "ver", "start", (F.col("start") + min_bytes).alias("stop"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with the key that rows are told apart by: d (doc_id, the largest number if missing) and ver.

    ver is 0 unless rows share a doc_id: then it is a hash of the text. Equal rows keep equal keys and get equal spans.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("d", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    own = F.xxhash64(F.col("doc_id").isNull(), "text")
    shared = rows.groupBy("d").agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low <> high").select(F.col("d").alias("shared"))
    shared = written(shared, "shared-ids")
    return rows.join(shared, F.col("d") == F.col("shared"), "left").select(
        "doc_id", "text", "d", F.when(F.col("shared").isNotNull(), own).otherwise(F.lit(0)).cast("long").alias("ver"))


def repeated_spans(texts: DataFrame, min_bytes: int = 50, crowd: int = CROWD) -> DataFrame:
    """Byte spans of ``texts`` (see :func:`keyed`) covered by strings of ``min_bytes`` that start in a smaller document."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = written(settled(anchor_blobs(texts.select("d", "ver", "text"), min_bytes, max(16, 2 * partitions)), min_bytes, crowd), "repeat-anchors")
    found = contexts(texts, state.where("h is not null"), min_bytes)
    groups = repeat_groups(found.where("crowded = 0"), min_bytes).where("d > first")
    spans = state.where("h is null").select("d", "ver", "start", "stop").unionByName(groups.select("d", "ver", "start", "stop"))
    if not state.where("crowded = 1").isEmpty():
        spans = spans.unionByName(crowded_spans(found.where("crowded = 1"), min_bytes))
    return spans


def remove_repeats(docs: DataFrame, min_bytes: int = 50, crowd: int = CROWD) -> DataFrame:
    """Remove each byte of a text covered by a string of ``min_bytes`` bytes that also starts in a smaller document.

    Texts are UTF-8 bytes, a missing one is empty; matches stay within documents and are judged on the input. A row
    without doc_id comes after all others. Rows that share a doc_id cover nothing of one another. Gives one row per row:
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes). Other columns are ignored.
    """
    texts = keyed(docs)
    # The spans of a document in order: where a span begins behind all before it, a stretch is left between.
    before = W.partitionBy("d", "ver").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
    reach = F.max("stop").over(before)
    walked = repeated_spans(texts, min_bytes, crowd).select("d", "ver", "start", "stop", reach.alias("reach"))
    apart = F.col("start") > F.coalesce("reach", F.lit(0))
    runs = walked.groupBy("d", "ver").agg(
        F.array_sort(F.collect_list(F.when(apart, F.struct(F.coalesce("reach", F.lit(0)).alias("a"), F.col("start").alias("b"))))).alias("gaps"),
        F.max("stop").alias("reach"), F.sum((apart | F.col("reach").isNull()).cast("long")).alias("runs"))
    rows = texts.join(runs, ["d", "ver"], "left").select("doc_id", F.col("text").cast("binary").alias("data"), "gaps", "reach", "runs")
    n = F.length("data")
    stretches = F.concat("gaps", F.array(F.struct(F.col("reach").alias("a"), n.alias("b"))))
    pieces = F.transform(stretches, lambda g: F.hex(F.substring("data", g["a"] + 1, g["b"] - g["a"])))
    kept = F.when(F.col("runs").isNull(), F.col("data")).otherwise(F.unhex(F.array_join(pieces, "")))
    return rows.select("doc_id", n.cast("long").alias("n_bytes"), F.coalesce("runs", F.lit(0)).cast("long").alias("n_spans"), kept.alias("kept")).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), "n_spans", "kept")
