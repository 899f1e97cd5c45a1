"""Token ids of whole texts, word by word.

The tokenizer lower-cases, drops white space and never joins across it, so the
ids of a text are those of its words in turn. Words repeat, so each is encoded
once per worker and looked up afterwards.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex

SLICE = 1 << 22
PLAIN_BELOW = "ɐ"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the rest from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class WordTokenizer:
    """Ids by word of a word-end BPE tokenizer file, with a bounded memory of words."""

    _kept: dict[str, WordTokenizer] = {}

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str, memory: int = 600_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            self.pieces = regex.compile(json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.memory, self.known = memory, {}

    def forget(self) -> None:
        """Drop the remembered words, so that a worker's next task starts small."""
        self.known = {}

    def encode_word(self, word: bytes) -> bytes:
        """Ids of one word, as little-endian 16-bit integers.

        Words of plain Latin letters and marks go straight to the model; any
        other (other scripts, control characters, reserved words) goes through
        the whole tokenizer.
        """
        text = word.decode("utf-8", "replace")
        if b"<|" in word or max(text) >= PLAIN_BELOW or not text.isprintable():
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            low = text.lower()
            parts = [low] if low.isalpha() else self.pieces.findall(low)
            ids = []
            for part in parts:
                if not part.isascii():
                    part = "".join(map(self.letters.__getitem__, part.encode()))
                ids += [t.id for t in self.model.tokenize(part)]
        return np.array(ids, "<u2").tobytes()

    def ids(self, text: bytes) -> Iterator[np.ndarray]:
        """Ids of a UTF-8 text, slice by slice."""
        known, start = self.known, 0
        while start < len(text):
            stop = start + SLICE
            while stop < len(text) and text[stop] not in b" \t\n\r\x0b\x0c":
                stop += 1
            words = (text if not start and stop >= len(text) else text[start:stop]).split()
            start = stop
            got = list(map(known.get, words))
            if None in got:
                if len(known) > self.memory:
                    known.clear()
                for i, ids in enumerate(got):
                    if ids is None:
                        word = words[i]
                        ids = known.get(word)
                        if ids is None:
                            ids = known[word] = self.encode_word(word)
                        got[i] = ids
            yield np.frombuffer(b"".join(got), "<u2")
