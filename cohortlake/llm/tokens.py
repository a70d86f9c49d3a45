"""Ids of the word-piece vocabulary, by way of remembered words.

In that tokenizer no token crosses white space, so a text's ids are those of its white-space chunks in a row, and a
chunk's ids those of its pre-tokens. Both are remembered; the library's merges are asked for each new pre-token only.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import regex

#: Chunks that a worker remembers before it starts anew, and characters of the longest one (others are encoded each time).
CACHE_ENTRIES, CACHE_CHARS = 600_000, 64
#: Characters of a part of a long text.
PART_CHARS = 1 << 20
#: The id that ends a document.
END_ID = 1

#: The pre-token pattern of word_bpe_49k.json.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Parts with these are left to the library whole: str.split() cuts at them, the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
#: Up to here letters, lower case and composition need no care; chunks beyond go to the library whole.
_BEYOND = re.compile("[^\0-ɏ]")


def parts(text: str) -> Iterator[str]:
    """A text in parts of about PART_CHARS, cut at spaces, so that a long one is never taken apart at once."""
    start = 0
    while len(text) - start > PART_CHARS:
        end = text.rfind(" ", start + 1, start + PART_CHARS)
        end = end if end > 0 else text.find(" ", start + PART_CHARS)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in such vocabularies: itself where it is printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class WordIds:
    """Encodes texts to little-endian unsigned 32-bit ids, without an end."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of a pre-token, by the library's merges alone."""
        mapped = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        found = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        if len(word) <= CACHE_CHARS:
            self.words[word] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        if _BEYOND.search(chunk):
            return self.direct(chunk)
        chunk, look = chunk.lower(), self.words.get
        if chunk.isalpha():
            return look(chunk) or self._word(chunk)
        if chunk[:-1].isalpha() and chunk[-1] in ",.;:!?":
            return (look(chunk[:-1]) or self._word(chunk[:-1])) + (look(chunk[-1]) or self._word(chunk[-1]))
        return b"".join([look(w) or self._word(w) for w in PRE_TOKEN.findall(chunk)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text (of PART_CHARS or so at most)."""
        split = [None if _ODD.search(t) else (t if _BEYOND.search(t) else t.lower()).split() for t in texts]
        for held in (self.known, self.words):
            if len(held) >= CACHE_ENTRIES:
                held.clear()
        known, met, long = self.known, set(), {}
        for words in split:
            met.update(words or ())
        for w in met:
            if w not in known:
                (known if len(w) <= CACHE_CHARS else long)[w] = self._chunk(w)
        look = known.__getitem__ if not long else (lambda w: long[w] if w in long else known[w])
        return [self.direct(t) if words is None else b"".join(map(look, words)) for t, words in zip(texts, split, strict=True)]


_encoders: dict[str, WordIds] = {}


def forget() -> None:
    """Drops what the encoders remember."""
    for e in _encoders.values():
        e.known.clear()
        e.words.clear()


def word_ids(path: str | None = None) -> WordIds:
    """The worker's encoder for a vocabulary file; one for each file."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]
