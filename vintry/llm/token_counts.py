"""Exact token counts, with huge documents encoded in overlapping chunks.

A document longer than ``chunk`` characters is cut into chunks that overlap. Each chunk is
encoded with offsets by the tokenizers library. Two neighbours are spliced at a boundary
both of them prove stable: a token of either begins there, white space stands before it
(the vocabulary drops white space and decides words only from their own characters, so
what lies left of it cannot change what lies right of it), and from there to the end of
the overlap's last whole word both give the same ids at the same offsets. Where no such
boundary exists the overlap is doubled and the next chunk encoded again; where none exists
since the last boundary, the chunk itself is encoded again from there, twice as long.

Documents up to ``chunk`` characters are encoded at once.

Defined results: a null or empty text has no tokens and no bytes; special strings inside a
text count as the library's default has it; repeated rows are counted each for itself; an
empty table gives no rows. One pass, no shuffle; a worker holds one batch of texts and one
chunk's offsets.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from vintry.llm.columns import append
from vintry.llm.words import WordEncoder, word_encoder

CHUNK = 32_768
OVERLAP = 256

# White space for every library; other separators are never taken for boundaries.
_BLANK = frozenset(" \t\n\r\x0b\x0c")

class _Chunk:
    """Tokens of ``text[start:end]``, by ascending places in the text."""

    def __init__(self, encoder: WordEncoder, text: str, start: int, end: int):
        found = encoder.tokenizer.encode(text[start:end], add_special_tokens=False)
        self.start, self.ids, self.offsets = start, found.ids, found.offsets

    def before(self, at: int) -> int:
        """How many tokens begin before a place."""
        return bisect_left(self.offsets, (at - self.start, -1))

    def between(self, first: int, last: int) -> list[tuple[int, int, int]]:
        i, j, s = self.before(first), self.before(last), self.start
        return [(s + a, s + b, k) for (a, b), k in zip(self.offsets[i:j], self.ids[i:j])]


def _stable(text: str, left: _Chunk, right: _Chunk, start: int, end: int) -> int | None:
    """The first proven boundary in ``text[start:end]``, the part both chunks hold."""
    # The last word of the left chunk may be cut, as may the first of the right one.
    last = end
    while last > start and text[last - 1] not in _BLANK:
        last -= 1
    mine, other = left.between(start + 1, last), right.between(start + 1, last)
    n = 0
    while n < min(len(mine), len(other)) and mine[-1 - n] == other[-1 - n]:
        n += 1
    alike = mine[len(mine) - n :]
    return next((a for a, _, _ in alike if text[a - 1] in _BLANK), None)


def count_tokens(
    encoder: WordEncoder, text: str | None, chunk: int = CHUNK, overlap: int = OVERLAP
) -> int:
    """The number of ids the library gives the whole text."""
    if not text:
        return 0
    if len(text) <= chunk:
        return len(encoder.encode_batch([text])[0])
    total, taken_from = 0, 0  # tokens counted so far, and where the uncounted ones begin
    end = chunk
    left = _Chunk(encoder, text, 0, end)
    while end < len(text):
        width, at = overlap, None
        while at is None and end - width > taken_from:
            begin = end - width
            stop = min(len(text), begin + max(chunk, 2 * width))
            right = _Chunk(encoder, text, begin, stop)
            at = _stable(text, left, right, begin, end)
            width *= 2
        if at is None:
            # Nothing to splice at since the last boundary: encode on from there, twice as far.
            stop = min(len(text), taken_from + 2 * (end - taken_from))
            left, end = _Chunk(encoder, text, taken_from, stop), stop
            continue
        total += left.before(at) - left.before(taken_from)
        left, end, taken_from = right, stop, at
    return total + len(left.ids) - left.before(taken_from)


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 2048,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    text_column: str = "text",
) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``; such columns are replaced."""

    def counted(texts: pa.Array) -> pa.Array:
        encoder = word_encoder(tokenizer_path)
        values = texts.to_pylist()
        counts = [0] * len(values)
        short = [i for i, t in enumerate(values) if t and len(t) <= chunk]
        for i, ids in zip(short, encoder.encode_batch([values[i] for i in short])):
            counts[i] = len(ids)
        for i, text in enumerate(values):
            if text and len(text) > chunk:
                counts[i] = count_tokens(encoder, text, chunk, overlap)
        sizes = [len(t.encode()) if t else 0 for t in values]
        return pa.StructArray.from_arrays(
            [
                pa.array(sizes, pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array([n > limit for n in counts], pa.bool_()),
            ],
            ["n_bytes", "n_tokens", "over_limit"],
        )

    return append(docs, counted, [text_column], "n_bytes bigint, n_tokens bigint, over_limit boolean")
