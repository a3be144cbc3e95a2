"""Ids of a word-level BPE tokenizer, each different word looked up once per batch and encoded once per worker.

The tokenizer splits at white space before anything else and no rule of it looks
across a gap, so a text's ids are those of its words one after the other.  Words
that consist of plain letters, digits and punctuation are lower-cased and split further into the
units the tokenizer merges within; everything else goes through the tokenizer whole.
"""

from __future__ import annotations

import re
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words and units remembered, and the characters of the words; beyond that all of them are forgotten.
WORDS = 300_000
UNITS = 300_000
CHARACTERS = 16_000_000
# Characters of texts that are looked up together.
TOGETHER = 1 << 21
# Python's split() takes these for gaps, the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
# Within these letters, lower-casing and composing work letter by letter.
_LETTERS = "!-~¡-¬®-±´-¸º»¿-ÖØ-öø-ÿŒœ–—‘’“”…€"
_PLAIN = re.compile(f"[{_LETTERS}]+")
_PLAIN_TEXT = re.compile(f"[\t-\r {_LETTERS}]*")
# The tokenizer's own units of plain words in lower case: runs of letters, single digits, contractions, runs of the rest.
_LOWER = "a-zªµºß-öø-ÿœ"
_UNIT = re.compile(rf"[{_LOWER}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^{_LOWER}0-9\s]+")
# Stands before a word that is not plain; a gap is in no word.
_MARK = "\n"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class WordBpe:
    """``encode_all`` gives the ids of texts as arrays, equal to the tokenizer's own without special tokens."""

    def __init__(self, path: str, words: int = WORDS, units: int = UNITS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.most_words, self.most_units = words, units
        self.units: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.characters = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)  # word i has flat[starts[i] : starts[i + 1]]
        self.used = 0

    def _unit(self, unit: str) -> bytes:
        found = self.units.get(unit)
        if found is None:
            # Plain letters of ASCII stand for themselves.
            spelled = unit if unit.isascii() else "".join(map(self.letters.__getitem__, unit.encode()))
            found = self.units[unit] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return found

    def _word(self, word: str) -> bytes:
        if word.startswith(_MARK):
            return array("I", self.tokenizer.encode(word[1:], add_special_tokens=False).ids).tobytes()
        return b"".join(map(self._unit, _UNIT.findall(word)))

    def _learn(self, words: list[str]) -> None:
        if len(self.units) > self.most_units:
            self.units = {}
        coded = list(map(self._word, words))
        ids = np.frombuffer(b"".join(coded), np.uint32)
        first, used = len(self.index), self.used
        while first + len(words) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[used : used + len(ids)] = ids
        ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) // 4)
        self.starts[first + 1 : first + len(words) + 1] = ends + used
        self.used = used + len(ids)
        self.characters += sum(map(len, words))
        self.index.update(zip(words, range(first, first + len(words))))

    def _places(self, words: list[str]) -> np.ndarray:
        """The numbers of words, new ones learned."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            unknown = [words[i] for i in missing.tolist()]
            new = list(dict.fromkeys(unknown))
            if len(self.index) + len(new) > self.most_words or self.characters > CHARACTERS:
                self._forget()
                new, missing, unknown = list(dict.fromkeys(words)), np.arange(len(words)), words
            self._learn(new)
            at[missing] = np.fromiter(map(self.index.__getitem__, unknown), np.int64, len(unknown))
        return at

    def _joined(self, at: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
        """The ids of the words ``at``, cut into texts where ``edges`` say."""
        first, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        behind = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(behind[-1]) + np.repeat(first - behind[:-1], size)]
        cuts = behind[edges].tolist()
        return [ids[start:end] for start, end in zip(cuts, cuts[1:])]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of plain texts in lower case."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        words = split.flatten().dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = self._places(different)[words.indices.to_numpy()]
        return self._joined(at, split.offsets.to_numpy())

    def _other(self, text: str) -> np.ndarray:
        if _ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        words = [w.lower() if _PLAIN.fullmatch(w) and "<|" not in w else _MARK + w for w in text.split()]
        return self._joined(self._places(words), np.array([0, len(words)]))[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        found: list[np.ndarray] = []
        together: list[str] = []
        size = 0
        for text in texts:
            plain = "<|" not in text and _PLAIN_TEXT.fullmatch(text)
            if plain:
                together.append(text.lower())
                size += len(text)
            if together and (not plain or size >= TOGETHER):
                found += self._plain(together)
                together, size = [], 0
            if not plain:
                found.append(self._other(text))
        return found + self._plain(together) if together else found
