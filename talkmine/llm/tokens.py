"""Exact and fast use of a tokenizer file inside Spark tasks.

The word BPE normalises every white-space run to one blank and its pieces never
hold white space, so the ids of a text are the ids of its blank-separated words,
one after another (blanks compose with no other character, and the special
strings hold none).  A text of Latin letters, digits and signs is cut into the
pieces that the file's pattern gives there, and the library's BPE model encodes each
piece that is not remembered.  Other texts go word by word: words of that kind by pieces,
all others through the whole library.  A file of another kind is used through the library
alone.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from operator import attrgetter

#: Words and pieces kept by an encoder, and the longest one kept.
MEMO_WORDS = 100_000
MEMO_PIECES = 400_000
MEMO_CHARS = 48
#: Fixed values of the word BPE file: its steps and its pattern.
STEPS = ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts whose characters normalisation only lower-cases, one by one, and the file's pattern
#: for their characters once they are lower-cased.
PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ \\n]*")
PIECES = re.compile("[a-zß-öø-ſ]+|[!-&(-/:-`{-~][!-/:-`{-~]*|[0-9]|'(?:s|t|re|ve|m|ll|d)|'[!-/:-`{-~]*")
_ID = attrgetter("id")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizer, once for each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _is_word_bpe(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    if not (kind.get("normalizer") or {}).get("normalizers") or not (kind.get("pre_tokenizer") or {}).get("pretokenizers"):
        return False
    steps = [*kind["normalizer"]["normalizers"], *kind["pre_tokenizer"]["pretokenizers"]]
    return [x["type"] for x in steps] == STEPS and steps[3]["pattern"].get("Regex") == PATTERN


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in own)}


def _is_plain(text: str) -> bool:
    return "<|" not in text and PLAIN.fullmatch(text) is not None


class Memo(dict):
    """Results of `make` by key, in two generations: when the young one is full it
    becomes the old one, and keys that are asked for again move back."""

    def __init__(self, make, at_most: int):
        self.make, self.half, self.old = make, at_most // 2, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Texts to packed little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        self.library, self.plain, self.letters = library(path), _is_word_bpe(path), _byte_letters()
        self.model = self.library.model
        self.words, self.pieces = Memo(self._word, MEMO_WORDS), Memo(self._piece, MEMO_PIECES)

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", map(_ID, self.model.tokenize(letters))).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        return self._pieces(word) if _is_plain(word) else self._whole(word)

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(text.lower())))

    def packed(self, text: str) -> bytes:
        if not self.plain:
            return self._whole(text)
        if _is_plain(text):
            return self._pieces(text)
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of this worker process; its memory outlives a task."""
    return Encoder(path)
