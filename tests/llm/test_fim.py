"""Fill-in-middle against a regular expression, and its wavelet matrix against counting."""

import hashlib
import random
import re

import numpy as np
import pytest
from helpers import awkward, documents
from pyspark.sql import functions as F

from tidewater.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_regex(doc_id, text, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (n, "plain", text, None, None)
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (n, form, out, len(p), len(m))


def cases():
    r = random.Random(4)
    out = awkward()
    for i in range(20, 400):
        out.append((i, "".join(r.choice([" ", " ", "\n", "\t", "\x0b", "a", "bc", "é", "漢", " ", "<", "S", ">", "<M", "😀", "\x00"]) for _ in range(r.randrange(0, 60)))))
    return out + [(500 + i, t) for i, t in enumerate(["<P>", "a <S> b", "<M", "<<P", "S>", "\r\n", "x", " x", "x ", "  "])]


def test_every_form_and_its_inverse(spark):
    rows = cases()
    out = fim.transform(documents(spark, rows)).withColumn("back", fim.restored()).collect()
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    got = [(r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars, r.back) for r in out]
    want = [(i, *by_regex(i, t), t or "") for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_rates(spark):
    docs = documents(spark, [(i, "one two three") for i in range(60)])
    assert fim.transform(docs, rate=0).where("form <> 'plain'").count() == 0
    assert {r.form for r in fim.transform(docs, rate=100, spm_rate=0).collect()} == {"psm"}
    assert fim.transform(documents(spark, [])).collect() == []


def test_lines_are_units(spark):
    text = "ab\n\n cd \nef"
    got = fim.transform(documents(spark, [(i, text) for i in range(80)]), rate=100, unit="line").withColumn("back", fim.restored())
    edges = {0, 3, 4, 9, 11}
    for r in got.collect():
        assert r.n == 4 and r.back == text and r.prefix_chars in edges and r.prefix_chars + r.middle_chars in edges


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_ranks(n):
    symbols = np.random.default_rng(n).integers(0, 16, n).astype(np.uint8)
    matrix = fim.WaveletMatrix(symbols)
    places = np.arange(n + 1)
    for value, care in [(0, 15), (9, 15), (8, 8), (1, 1), (12, 12), (2, 6), (0, 0)]:
        hit = (symbols & care) == (value & care)
        assert matrix.rank(places, value, care).tolist() == np.concatenate([[0], np.cumsum(hit)]).tolist()


def test_a_long_text_without_blanks_and_one_of_blanks(spark):
    rows = [(i, t) for i in range(700, 706) for t in ("é" * 700_000, " \n" * 600_000)]
    got = fim.transform(documents(spark, rows), rate=100).select("doc_id", "n", F.length("output").alias("size"), "prefix_chars", "middle_chars").collect()
    want = [(i, n, len(o), a, b) for i, t in rows for n, _, o, a, b in [by_regex(i, t, 100)]]
    assert sorted(tuple(r) for r in got) == sorted(want)
