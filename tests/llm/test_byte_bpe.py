"""Byte-level BPE against the tokenizer library and by round trip."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import awkward, documents, prose

from tidewater.llm import byte_bpe

FILES = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]
LETTERS = ["a", "b", " ", " ", "\n", "é", "漢", "字", "1", "²", "'s", "　", "\x1c", "\x85", "\xa0", "-", "ก", "م", "٣", "😀", "é", "\r", "\x00", "I'll", "'T"]


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    code = byte_bpe.coder(request.param)
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=code.ranks, special_tokens={})
    return code, lambda text: np.array(whole.encode_ordinary(text), "<u4").tobytes()


def test_ids_of_random_texts(pair):
    code, want = pair
    r = random.Random(1)
    texts = ["".join(r.choice(LETTERS[: r.randint(2, len(LETTERS))]) for _ in range(n)) for n in [0, 1, 2, 5, 30, 300, 3000] for _ in range(40)]
    texts += ["".join(chr(r.choice([r.randrange(32, 0x250), r.randrange(0x250, 0xD800), r.randrange(0xE000, 0x20000)])) for _ in range(80)) for _ in range(200)]
    texts += [prose(k, 200) for k in range(20)]
    got = code.encode(texts)
    assert got == [want(t) for t in texts]
    assert code.decode(got) == [t.encode() for t in texts]


@pytest.mark.parametrize("n", [7, 8, 9, 255, 256, 257, 258, 20_000])
def test_stretches_without_a_cut(pair, n):
    code, want = pair
    r = random.Random(n)
    for text in ("a" * n, "ab" * (n // 2), "".join(r.choice("abcdefghij") for _ in range(n)), "".join(chr(r.randrange(0x4E00, 0x5500)) for _ in range(n // 3)), " " * n):
        assert code.encode([text]) == [want(text)]
        raw = text.encode()
        assert code.merge([raw, raw[: len(raw) // 2 + 1]])[0] == code.merge_long(raw)


def test_long_texts_are_parted_where_no_piece_crosses(pair, monkeypatch):
    code, want = pair
    monkeypatch.setattr(byte_bpe, "SPAN_CHARS", 7)
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice(LETTERS) for _ in range(60))
        assert code.encode([text]) == [want(text)]


def test_pairs_that_share_a_place_in_the_table(pair):
    code, _ = pair
    r = np.random.default_rng(5)
    left, right = r.integers(0, len(code.ranks), (2, 40, 500))
    names = {v: k for k, v in code.ranks.items()}
    want = [[code.ranks.get(names[a] + names[b], int(byte_bpe.PairTable.NONE)) for a, b in zip(x, y, strict=True)] for x, y in zip(left.tolist(), right.tolist(), strict=True)]
    assert code.pairs.rank(left, right).tolist() == want


def test_documents(spark, pair):
    _, want = pair
    name = next(f for f in FILES if byte_bpe.coder(f) is pair[0])
    rows = awkward()
    got = byte_bpe.decode(byte_bpe.encode(documents(spark, rows), name), name).collect()
    order = sorted(((i, len(want(t or "")) // 4, want(t or ""), (t or "").encode()) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in got), key=str) == order
    assert byte_bpe.decode(byte_bpe.encode(documents(spark, []))).collect() == []


def test_an_incomplete_rank_file_is_an_error(tmp_path):
    (tmp_path / "some.tiktoken").write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="single bytes"):
        byte_bpe.coder(str(tmp_path / "some.tiktoken"))
