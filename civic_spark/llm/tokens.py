"""Token ids of texts by a tokenizer file of the ``tokenizers`` library.

Texts are cut at white space and each different word is encoded once per worker: the tokenizer's own pre-tokenizer never
joins characters across white space, so the ids of a text are the ids of its words in order. Of a plain word, letters of
Latin-1 with signs of ASCII behind, the letters and the signs are pieces of their own to the pre-tokenizer; each is looked
up as a word, and the library's model is asked for letters once: its normaliser only lowers their case. Any other word is
encoded by the library as a whole. Strings of special tokens in a text are those tokens, as the library has it.

Letters of ASCII are lowered in the whole text first, so that a word has one entry however it is written. That is left out
where case may count: special strings are looked for before the normaliser lowers them, and it joins letters with the
combining marks behind them first, some of them (h and a line below) in lower case only.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

#: Words kept per worker, with the signs behind them. The table is emptied when it is full.
CACHE_WORDS, CACHE_BYTES = 400_000, 64

#: What special strings begin with, and the lead bytes of combining marks (U+0300 to U+037F) in UTF-8.
_CASE_COUNTS = (b"<|", b"\xcc", b"\xcd")

_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'")
#: Letters of Latin-1, then signs of ASCII without the apostrophe (which may start a piece with the letters behind it).
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class Words(dict):
    """Ids of words, worked out when a word is first asked for."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # this table stands in front of it
        self.letters = _byte_letters()
        self.packs = [struct.Struct(f"<{n}I").pack for n in range(64)]

    def _packed(self, ids: list[int]) -> bytes:
        return self.packs[len(ids)](*ids) if len(ids) < len(self.packs) else struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, letters: str) -> bytes:
        """Ids of a run of lower-case letters."""
        plain = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.letters)
        return self._packed([token.id for token in self.model.tokenize(plain)])

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: bytes) -> bytes:
        letters = word.rstrip(_SIGNS)
        if letters.isalpha():  # of ASCII
            alone = letters.lower()
        elif found := _PLAIN.match(word.decode("utf-8", "replace")):
            alone, letters = found[1].lower().encode(), found[1].encode()
        else:
            return self._kept(word, self._whole(word.decode("utf-8", "replace")))
        if alone == word:
            return self._kept(word, self._piece(word.decode()))
        return self._kept(word, self[alone] + self[word[len(letters) :]] if len(letters) < len(word) else self[alone])

    def _kept(self, word: bytes, raw: bytes) -> bytes:
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = raw
        return raw


class Encoder:
    """Little-endian unsigned 32-bit ids of UTF-8 texts, without special tokens around them."""

    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        self.words = Words(path)

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One per worker and file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Ids of each text as bytes, four for each id."""
        ids = self.words.__getitem__
        for text in texts:
            text = text or b""
            if not any(mark in text for mark in _CASE_COUNTS):
                text = text.lower()
            yield b"".join(map(ids, text.split()))
