"""Token ids of a word-splitting vocabulary, with a bounded cache of words.

The vocabulary drops white space, so no token spans it and every word between two runs
of white space is encoded alike wherever it stands. Words seen before are looked up, with
ASCII capitals lowered as the vocabulary does; of new ones, plain Latin words go to the
library's model piece by piece and all others through its whole chain. Texts that may
hold special strings are given to the library whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from vintry.llm.segments import SegmentTable, piece_ranges

# Words kept by one Python worker before the cache starts again; about 0.1 kB each.
CACHE_WORDS = 1_000_000
# Bytes looked up at once. Longer texts are cut between words and put together again.
BATCH_BYTES = 200_000

_NONE = np.zeros(0, np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

# Printable ASCII and the letters of Latin-1 and Latin Extended-A. Each is one code point
# under NFC and keeps that under lower-casing (but for U+0130, which is left out).
_PLAIN_WORD = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
# The split of the vocabulary's own configuration, for lower-cased plain words.
_PLAIN_PIECES = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+"
)


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: printable bytes themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class _Kept(dict):
    """A dictionary that makes missing values, and starts again when it is full."""

    def __init__(self, make, limit: int):
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Encodes whole texts to ids, without begin, end or added special tokens."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self._model = self.tokenizer.model
        self._pieces = _Kept(self._piece, cache_words // 4)
        self._table = SegmentTable(lambda words: [self._word(w) for w in words], cache_words)

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _piece(self, piece: str) -> list[int]:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(_LETTERS)
        return [token.id for token in self._model.tokenize(piece)]

    def _word(self, data: bytes) -> list[int]:
        word = data.decode()
        if not _PLAIN_WORD.fullmatch(word):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        lowered = word.lower()
        if lowered.isalpha():
            return self._pieces[lowered]
        return [i for piece in _PLAIN_PIECES.findall(lowered) for i in self._pieces[piece]]

    def _run(self, batch: list[bytes]) -> list[np.ndarray]:
        units = _LOWER[np.frombuffer(b" ".join(batch) + b" ", np.uint8)]
        blank = _BLANK[units]
        starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        ends = np.flatnonzero(blank & np.concatenate(([False], ~blank[:-1])))
        ids, counts = self._table.ids(units, starts, ends)
        after = np.concatenate(([0], np.cumsum(counts)))
        text_ends = np.cumsum([len(data) + 1 for data in batch])
        bounds = after[np.searchsorted(starts, text_ends)]
        return np.split(ids, bounds[:-1])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text; null counts as empty."""
        results: list[list[np.ndarray]] = [[] for _ in texts]
        batch, owners, held = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if "<|" in text:
                results[i].append(self.library(text))
                continue
            data = text.encode()
            for start, end in piece_ranges(data, BATCH_BYTES):
                batch.append(data[start:end])
                owners.append(i)
                held += end - start
                if held >= BATCH_BYTES:
                    for owner, ids in zip(owners, self._run(batch)):
                        results[owner].append(ids)
                    batch, owners, held = [], [], 0
        if batch:
            for owner, ids in zip(owners, self._run(batch)):
                results[owner].append(ids)
        return [
            some[0] if len(some) == 1 else np.concatenate(some) if some else _NONE
            for some in results
        ]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder, with its cache, per Python worker and vocabulary."""
    return WordEncoder(path)
