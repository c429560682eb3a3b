"""Exact dedup, SimHash groups and repeat removal against brute force."""

import hashlib
import os
import re

import numpy as np
import pytest
import xxhash
from helpers import awkward, documents, prose

from tidewater.llm import digests, graphs, repeats, simhash


def digest_of(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()


def test_exact_dedup_of_awkward_rows(spark):
    rows = awkward()
    got = digests.open_index(spark, buckets=2).absorb(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(digest_of(t), []).append((-len(t or ""), i is None, i or 0, i))
    for r in got:
        members = groups[r.text_sha256]
        assert r.group_size == len(members) and r.keep_id == min(members)[3]
    for h in groups:
        assert sum(r.kept for r in got if r.text_sha256 == h) == 1


def test_a_second_batch_meets_the_index(spark):
    index = digests.open_index(spark, buckets=2)
    index.absorb(documents(spark, [(1, "one text"), (2, "two texts")])).collect()
    got = {r.doc_id: (r.keep_id, r.kept) for r in index.absorb(documents(spark, [(3, "onetext"), (4, "three")])).collect()}
    assert got == {3: (1, False), 4: (4, True)}
    assert spark.table(index.table).count() == 3


def test_a_named_batch_may_be_absorbed_again(spark):
    index = digests.open_index(spark, buckets=2)
    index.absorb(documents(spark, [(1, "one text")]), "first").collect()
    rows = [(2, "one text"), (3, "two"), (3, "two"), (4, "t w o"), (5, None)]
    once = [tuple(r) for r in index.absorb(documents(spark, rows), "second").collect()]
    again = [tuple(r) for r in index.absorb(documents(spark, rows), "second").collect()]
    assert sorted(once, key=str) == sorted(again, key=str) and spark.table(index.table).count() == 3
    assert {r[0] for r in again if r[3]} == {4, 5}
    # The job died behind a part of the append: the rest is appended by the run that follows.
    half = digests.open_index(spark, buckets=2)
    half.absorb(documents(spark, rows[1:3]), "second").collect()
    assert {r.doc_id for r in half.absorb(documents(spark, rows), "second").where("kept").collect()} == {2, 4, 5}
    assert half.absorb(documents(spark, rows), "third").where("kept").count() == 0
    for i in (index, half):
        i.drop()
        assert not spark.catalog.tableExists(i.table)


def test_results_outlive_the_index(spark):
    index = digests.open_index(spark, buckets=2)
    got = index.absorb(documents(spark, awkward()))
    index.drop()
    assert got.count() == len(awkward())


def test_rows_with_columns_that_have_no_order(spark):
    rows = [(1, "a b", {"k": 1}), (1, "a b", {"k": 1}), (1, "a b", None), (2, "ab", {}), (3, "c", {"z": None})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>")
    kept = digests.drop_repeats(docs, digests.open_index(spark, buckets=2))
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert simhash.drop_near_copies(docs, n=4, radius=4).count() >= 1


def test_exact_dedup_keeps_columns_and_one_row(spark):
    docs = documents(spark, awkward())
    kept = digests.drop_repeats(docs, digests.open_index(spark, buckets=2))
    assert kept.columns == docs.columns and kept.schema == docs.schema
    rows = kept.collect()
    assert len(rows) == len({digest_of(t) for _, t in awkward()}) == len({digest_of(r.text) for r in rows})


def fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_brute_force(rows, n, radius):
    fps = [fingerprint(t, n) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    low = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    return sorted((-1 if i is None else i, f"{f:016x}", low[g]) for (i, _), f, g in zip(rows, fps, group, strict=True))


@pytest.mark.parametrize("n,radius", [(4, 4), (2, 10)])
def test_simhash_groups(spark, n, radius):
    base = prose(5, 300).split()
    chain = [(100 + k, " ".join(base[: 300 - k] + prose(k, k).split())) for k in range(0, 30, 3)]
    rows = awkward() + chain
    got = simhash.near_groups(documents(spark, rows), n, radius).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in got) == groups_by_brute_force(rows, n, radius)


def test_one_document_of_each_near_group_stays(spark):
    rows = [(3, "a b c d e"), (2, "A b c d e"), (2, "a B c d e"), (9, prose(9, 40)), (None, "a b c d e"), (8, None), (7, "")]
    docs = documents(spark, rows)
    kept = simhash.drop_near_copies(docs, 4, 4)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [2, 7, 9]


def test_groups_without_an_own_doc_id_stay(spark):
    """Unlinked groups without doc_id, and two unlinked groups whose smallest doc_id is the same, keep a row each."""
    one, two = prose(21, 60), prose(22, 60)
    rows = [(None, one), (None, one), (None, two), (7, prose(23, 60)), (7, prose(24, 60)), (8, prose(24, 60)), (None, prose(24, 60))]
    kept = [(r.doc_id, r.text) for r in simhash.drop_near_copies(documents(spark, rows), 4, 4).collect()]
    assert sorted(kept, key=str) == sorted([(None, one), (None, two), (7, prose(23, 60)), (7, prose(24, 60))], key=str)


def test_tiles_lose_no_link():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) for _ in range(30)]))
    order = np.lexsort((fps, *simhash.populations(fps).T[::-1], np.bitwise_count(fps)))
    fps = fps[order]
    for left, right in ((fps, None), (fps[:500], fps[500:])):
        nodes = fps if right is None else np.concatenate([left, right])
        near = np.bitwise_count(nodes[:, None] ^ nodes[None]) <= 4
        if right is not None:
            near[: len(left), : len(left)] = near[len(left) :, len(left) :] = False
        a, b = simhash.tile_links(left, right, 4)
        assert near[a, b].all() or len(a) < near.sum()  # forests may link through others
        want = simhash.forest(len(nodes), *np.nonzero(near))
        assert {*zip(*simhash.forest(len(nodes), a, b), strict=True)} == {*zip(*want, strict=True)}


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(500, k) for k in range(400, 500)] + [(7, 7), (3, 2), (900, 901), (901, 900)]
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 400 for k in range(400, 501)}, 900: 900, 901: 900}


def removed_by_brute_force(rows, width):
    rows = [((1 << 63) - 1 if i is None else i, i, (t or "").encode()) for i, t in rows]
    first = {}
    for d, _, b in rows:
        for p in range(len(b) - width + 1):
            s = b[p : p + width]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, i, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < d:
                gone[p : p + width] = True
        runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
        out.append((-1 if i is None else i, len(b), int(gone.sum()), runs, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out)


def repeat_rows(seed):
    """Texts of a tiny alphabet, stitched from shared parts cut at random places."""
    r = np.random.default_rng(seed)
    parts = ["".join(r.choice(list("abé "), r.integers(20, 140))) for _ in range(8)]
    rows = []
    for d in range(30):
        bits = []
        for _ in range(r.integers(1, 5)):
            p = parts[r.integers(len(parts))]
            lo = r.integers(0, 15)
            bits.append(p[lo : len(p) - r.integers(0, 15)] if r.random() < 0.8 else "".join(r.choice(list("xyz"), r.integers(1, 60))))
        rows.append((int(d), "".join(bits)))
    return rows


@pytest.mark.parametrize("case,crowd", [("awkward", repeats.CROWD), (1, repeats.CROWD), (2, 0), (3, 3)])
def test_repeats_are_removed(spark, case, crowd):
    rows = [(i, t if t is None else t[:3000]) for i, t in awkward()] + [(20, "a" * 300), (21, "b" * 70 + "a" * 120)] if case == "awkward" else repeat_rows(case)
    got = repeats.remove_repeats(documents(spark, rows), 50, crowd).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == removed_by_brute_force(rows, 50)


def test_long_texts_are_searched_in_pieces(monkeypatch):
    text = np.frombuffer(prose(4, 3000).encode(), np.uint8)
    whole = repeats.find_anchors(text, np.array([0, len(text)]), 50)
    places = []
    for begin in range(0, len(text), 4000):
        low, high = max(0, begin - 32), min(len(text), begin + 4000 + 50)
        h, c, _, pos, tail = repeats.find_anchors(text[low:high], np.array([0, high - low]), 50)
        own = (pos + low >= begin) & (pos + low < begin + 4000)
        places += zip((pos + low)[own].tolist(), h[own].tolist(), c[own].tolist(), tail[own].tolist(), strict=True)
    assert places == list(zip(whole[3].tolist(), whole[0].tolist(), whole[1].tolist(), whole[4].tolist(), strict=True))


def test_intervals_of_a_prefix_tree():
    texts = sorted(["banana", "bandana", "banal", "ban", "cab", "cabs"])
    lcp = np.array([0] + [len([1 for k in range(min(len(x), len(y))) if x[: k + 1] == y[: k + 1]]) for x, y in zip(texts[:-1], texts[1:], strict=True)])
    assert sorted(repeats.intervals(lcp, 2)) == [(3, 0, 3), (3, 4, 5), (4, 1, 2)]


def test_empty_tables(spark):
    none = documents(spark, [])
    assert digests.open_index(spark, buckets=2).absorb(none).count() == 0
    assert simhash.near_groups(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0


def test_fingerprints_of_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "_PIECE", 40)
    for text in (prose(8, 200), "a" * 300 + " b c", "", " \n", "one two", "x " * 100, " a  b\tc\nd e " * 9):
        for n in (1, 2, 4):
            assert simhash.fingerprint(text, n).hex() == f"{fingerprint(text, n):016x}"


def test_the_index_is_not_shuffled(spark):
    index = digests.open_index(spark, buckets=3)
    index.absorb(documents(spark, [(1, "one"), (2, "two")]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = spark.createDataFrame([("x",)], "digest string").repartition(index.buckets, "digest")
        plan = batch.join(spark.table(index.table).hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "SortMergeJoin" in plan


def test_a_batch_leaves_one_file_a_bucket(spark, monkeypatch):
    """Also where the session deals rows out to more tasks than asked for, as a setting of its shuffles."""
    frame, before = type(spark.range(0)), spark.conf.get("spark.sql.shuffle.partitions")
    plain = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols: plain(self, max(n, 80) if cols and isinstance(n, int) else n, *cols))
    spark.conf.set("spark.sql.shuffle.partitions", "80")
    try:
        index = digests.open_index(spark)
        got = index.absorb(documents(spark, [(k, f"text {k % 400}") for k in range(800)])).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    files = [f for _, _, names in os.walk(index.path.removeprefix("file:")) for f in names if f.endswith(".parquet")]
    assert len(got) == 800 and sorted(r.doc_id for r in got if r.kept) == list(range(400))
    assert 0 < len(files) <= 81  # the empty table may have a file
    assert spark.table(index.table).count() == 400


def test_many_removed_runs_in_one_text(spark):
    shared = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(60))
    n = 40_000
    text = "".join(f"{i:06d}{shared}" for i in range(n))
    got = {r.doc_id: r for r in repeats.remove_repeats(documents(spark, [(1, shared), (2, text)])).collect()}
    assert (got[2].n_spans, got[2].n_removed, got[2].n_bytes) == (n, 60 * n, 66 * n)
    assert bytes(got[2].kept).decode() == "".join(f"{i:06d}" for i in range(n)) and got[1].n_removed == 0
