"""Token ids of texts, by a public tokenizer, with a bounded memory of the words seen."""

from __future__ import annotations

import json
import re

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

#: Words that a worker remembers before it starts anew.
REMEMBERED = 700_000
#: Characters handled at once; a longer text is cut at white space, where no token crosses.
PIECE_CHARS = 1 << 19
#: A stretch without blanks that has any character beyond plain ASCII and the Latin-1 letters goes to the tokenizer as it is.
_ODD = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]")
_BLANK = re.compile(r"[ \n]")
_BLANKS = re.compile(r"[ \t\n\r]+")
#: How the lower-case word tokenizer cuts a text of the other characters before its merges.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def public_path(name: str) -> str:
    """Where the public tokenizer file ``name`` lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of a lower-casing word tokenizer whose merges stay within words.

    Every id comes from the tokenizer. A word is encoded once and remembered, as texts repeat their words; words that
    are new are encoded many at a time, and their ids are told apart by the marks of word ends in the vocabulary.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = spec["model"].get("end_of_word_suffix") == "</w>" and any(
            x.get("type") == "Lowercase" for x in (spec.get("normalizer") or {}).get("normalizers", []))
        self.special = [] if special_as_text else [x["content"] for x in spec["added_tokens"]]
        self.words = Tokenizer.from_file(path)
        self.words.encode_special_tokens = True
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 2, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        groups = [words[i : i + 64] for i in range(0, len(words), 64)]
        for group, got in zip(groups, self.words.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.uint32)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(group):
                for w in group:
                    self.known[w] = np.array(self.words.encode(w, add_special_tokens=False).ids, np.uint32).tobytes()
                continue
            raw, first = ids.tobytes(), 0
            for w, end in zip(group, (last * 4).tolist(), strict=True):
                self.known[w] = raw[first:end]
                first = end

    def _cut(self, piece: str) -> list[str]:
        """The words of a piece as they are remembered; odd stretches are kept whole behind a zero character."""
        if not _ODD.search(piece) and not any(s in piece for s in self.special):
            return _WORDS.findall(piece.lower())
        out = []
        for stretch in _BLANKS.split(piece):
            if _ODD.search(stretch) or any(s in stretch for s in self.special):
                out.append("\0" + stretch)
            else:
                out += _WORDS.findall(stretch.lower())
        return out

    def _pieces(self, text: str) -> list[str]:
        out, first = [], 0
        while len(text) - first > PIECE_CHARS:
            cut = _BLANK.search(text, first + PIECE_CHARS)
            if not cut:
                break
            out.append(text[first : cut.start()])
            first = cut.end()
        out.append(text[first:])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found: list[list] = []
        new: set[str] = set()
        for text in texts:
            parts = []
            for piece in self._pieces(text) if len(text) > PIECE_CHARS else (text,):
                if self.by_word:
                    parts.append(words := self._cut(piece))
                    new.update(words)
                else:
                    parts.append(np.array(self.whole.encode(piece, add_special_tokens=False).ids, np.uint32).tobytes())
            found.append(parts)
        new.difference_update(self.known)
        if odd := [w for w in new if w[0] == "\0"]:
            for w, got in zip(odd, self.whole.encode_batch_fast([w[1:] for w in odd], add_special_tokens=False), strict=True):
                self.known[w] = np.array(got.ids, np.uint32).tobytes()
            new.difference_update(odd)
        if new:
            self._learn(list(new))
        get = self.known.__getitem__
        return [b"".join([p if type(p) is bytes else b"".join(map(get, p)) for p in parts]) for parts in found]


_encoders: dict[tuple, WordEncoder] = {}


def encoder(name: str, special_as_text: bool = False) -> WordEncoder:
    """This worker's encoder for the tokenizer file ``name`` (a path, or a name among the public tokenizers)."""
    key = (name, special_as_text)
    if key not in _encoders:
        _encoders[key] = WordEncoder(name if "/" in name else public_path(name), special_as_text)
    return _encoders[key]
