"""Token ids, packing and the separator scan, against the tokenizer itself."""

import zlib

import numpy as np
import pytest
from helpers import awkward, documents, prose
from tokenizers import Tokenizer

from tidewater.llm import packing, token_files, tokens
from tidewater.llm.common import open_folder, qualified, shared_folder

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.public_path(NAME))


TEXTS = ["", "Hello, WORLD!! it's we're 12.5 <|endoftext|> x", "a<|endoftext|>b", "ǅ İstanbul ﬁn Ǆ", "é ñ", "tab\tnl\nnbsp\xa0x\x1cy\x85z", "漢字 かな 🙂🙂",
         "don't'll 's'S 'RE ²½ ª º × ÷ ß ÿ", "x" * 500, "...,,,!!!", "Σας ΟΔΟΣ", "a \x00 b\x00c — “quoted” e\u0301 \u0301x", "x" * 70 + " — " * 40, prose(3, 400)]


def test_ids_are_the_tokenizers(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "PIECE_CHARS", 64)
    enc = tokens.WordEncoder(tokens.public_path(NAME))
    for got, text in zip(enc.encode(TEXTS * 2), TEXTS * 2, strict=True):
        assert np.frombuffer(got, np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_are_used_as_they_are():
    path = tokens.public_path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    for got, text in zip(tokens.WordEncoder(path).encode(TEXTS), TEXTS, strict=True):
        assert np.frombuffer(got, np.uint32).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_binary_lengths():
    for n in range(1, 300):
        lengths = packing.binary_lengths(n, 64)
        assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 64 for x in lengths) and lengths == sorted(lengths, reverse=True)


def test_packing_covers_every_id_once(spark, tokenizer):
    rows = awkward()
    got = packing.digests(packing.pack(documents(spark, rows), longest=64)).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert all(r.offset == 0 and r.length == 1 << r.bucket <= 64 for r in got)
    want = []
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], np.uint32)
        at = 0
        for n in packing.binary_lengths(len(ids), 64):
            want.append((i is None, i or 0, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
            at += n
    assert sorted((r.doc_id is None, r.doc_id or 0, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)


def test_buckets_are_written_by_length(spark):
    path = shared_folder(spark, "buckets")
    packing.write_buckets(packing.pack(documents(spark, awkward()[:6]), longest=16), path)
    back = spark.read.parquet(path)
    assert all(len(r.ids) == 4 << r.bucket for r in back.collect())


def test_token_counts(spark):
    rows = awkward() + [(50, "a<|endoftext|>b")]
    whole = Tokenizer.from_file(tokens.public_path(NAME))
    whole.encode_special_tokens = True
    got = token_files.token_counts(spark, documents(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == sorted(
        (i is None, i or 0, len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_documents_run_over_blocks(spark, tmp_path, block):
    r = np.random.default_rng(block)
    files, want = [], []
    for k in range(4):
        ids = r.integers(1, 6, int(r.integers(0, 200))).astype("<u2")
        if k == 3:
            ids = np.full(90, 3, "<u2")  # no separator at all
        (tmp_path / f"f{k}").write_bytes(ids.tobytes())
        files.append((f"f{k}", ids.nbytes))
        cuts = np.flatnonzero(ids == 1)
        sizes = np.diff(np.concatenate([[-1], cuts])) - 1
        want += [(f"f{k}", n, int(s), True) for n, s in enumerate(sizes)]
        rest = len(ids) - (cuts[-1] + 1 if len(cuts) else 0)
        want += [(f"f{k}", len(cuts), int(rest), False)] if rest else []
    blocks = token_files.scan_blocks(spark.createDataFrame(files, "file string, n_bytes long"), str(tmp_path), 1, 2, block)
    got = token_files.count_documents(blocks).collect()
    assert sorted((x.file, x.ordinal, x.n_tokens, x.terminated) for x in got) == sorted(want)


def test_empty_tables(spark):
    none = documents(spark, [])
    assert packing.pack(none).count() == 0 and token_files.token_counts(spark, none).count() == 0


def test_paths_without_a_scheme_lie_in_the_default_file_system(spark, tmp_path):
    assert qualified(spark, str(tmp_path)) == f"file:{tmp_path}" and qualified(spark, f"file://{tmp_path}").startswith("file:/")
    system, path = open_folder(qualified(spark, str(tmp_path)))
    assert path == str(tmp_path) and system.type_name == "local"
    assert shared_folder(spark, "x").startswith("file:/")


def test_ids_that_do_not_fit_are_an_error():
    assert token_files._narrow(np.array([0, 65_535], "<u4").tobytes(), 2) == np.array([0, 65_535], "<u2").tobytes()
    with pytest.raises(ValueError, match="2 bytes"):
        token_files._narrow(np.array([7, 65_536], "<u4").tobytes(), 2)
    assert token_files._narrow(b"", 2) == b""
