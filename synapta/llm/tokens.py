"""Whole texts to token ids, with the ``tokenizers`` library and a bounded memo of words.

A byte-level BPE joins no non-space character with a space or line feed after it, so a text
can be cut there without changing its ids (as long as no white space stands beside the
cut's own), and a letter never joins a punctuation mark after it. Words recur: each worker keeps
the ids of the words it met last and sends only new ones to the tokenizer. ``tests/llm``
holds this against encoding whole texts in one piece.
"""

from __future__ import annotations

import os
import re
from array import array

from synapta.llm.memos import claim

#: A worker keeps the ids of the words of at most so many characters that it met last: up to twice so many.
MEMO_CHARS, MEMO = 64, 400_000
_CUT = re.compile(r"(?<=\S)(?= )")
_AWKWARD = re.compile(r"\s\s|\0")
_encoders: dict[str, Encoder] = {}


#: Bytes as the characters that stand for them in a byte-level vocabulary: printable ones stand
#: for themselves, the others are numbered from 256.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_AS_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


class _Memo(dict):
    """Ids of words, as bytes of 32-bit integers; words not met lately go to the tokenizer."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.merge, self.older = tokenizer, tokenizer.model.tokenize, {}

    def whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            stem = word.rstrip(_MARKS)
            if len(stem) < len(word) and stem.removeprefix(" ").isalpha():  # a letter and a mark never join
                ids = self[stem] + self[word[len(stem) :]]
            elif word.removeprefix(" ").isalpha():  # one piece: it needs the merges alone
                ids = array("I", [x.id for x in self.merge(word.encode().decode("latin-1").translate(_AS_CHARS))]).tobytes()
            else:
                ids = self.whole(word)
        if len(word) <= MEMO_CHARS:
            self[word] = ids
        return ids

    def age(self) -> None:
        if len(self) > MEMO:
            self.older = dict(self)
            self.clear()


class Encoder:
    """Ids of texts as little-endian bytes of unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.memo = _Memo(self.tokenizer)

    @staticmethod
    def cut(text: str | None) -> list[str]:
        if not text:
            return []
        if _AWKWARD.search(text):
            return _CUT.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null is empty."""
        out = []
        for text in texts:
            self.memo.age()
            out.append(b"".join(map(self.memo.__getitem__, self.cut(text))))
        return out


def _forget() -> None:
    for e in _encoders.values():  # an encoder that is still in use begins anew
        e.memo.clear()
        e.memo.older = {}
    _encoders.clear()


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    claim("tokens", _forget)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def text_groups(column, most_bytes: int = 1_000_000):
    """Row ranges of an Arrow string column whose texts have at most ``most_bytes`` together (one text at least)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most_bytes:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)
