"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is a doubly linked list of byte pieces; the lists of a batch lie in one array
with gaps between them. A bucket per merge rank holds the positions whose pair has that
rank; a bitmap over the ranks, with two smaller bitmaps over its words, names the lowest
rank in use by three find-first-set steps. A bucket is worked off leftmost first; an entry
whose position is gone or whose pair has changed is stale and skipped. A pre-token of n
bytes costs O(n log n), however long it is.

Pre-tokens recur, so a bounded table keeps the ids of segments (an optional blank and what
follows up to the next one) that were met before; it never changes a result.

Defined results: a null text is an empty text and has no ids; null ids decode to no bytes;
an id outside the vocabulary stops the job; repeated rows are handled each for itself; an
empty table gives no rows. One pass, no shuffle.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vintry.llm.columns import append
from vintry.llm.segments import SegmentTable, piece_ranges

# Bytes looked up at once. Longer texts are cut between segments and put together again.
BATCH_BYTES = 1_000_000
# Segments kept by one Python worker before the table starts again.
CACHE_SEGMENTS = 1_000_000

_WIDTH = 6  # a bitmap word has 64 bits
_LOW = (1 << _WIDTH) - 1
_SENTINEL = 255  # in no UTF-8 text
# White space beyond ASCII: there a segment's surroundings matter to the pattern.
_WIDE_BLANK = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_KIND = np.zeros(256, np.uint8)  # 0 other, 1 ASCII white space, 2 between texts
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[_SENTINEL] = 2
_NONE = np.zeros(0, np.uint32)


class RankQueue:
    """Positions in buckets by rank, with three levels of bitmaps over the ranks."""

    def __init__(self, ranks: int):
        words = (ranks >> _WIDTH) + 1
        self.low = [0] * words
        self.middle = [0] * ((words >> _WIDTH) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def open(self, rank: int, positions: list[int]) -> None:
        """Start the bucket of a rank that has none."""
        self.buckets[rank] = positions
        word = rank >> _WIDTH
        if not self.low[word]:
            self.middle[word >> _WIDTH] |= 1 << (word & _LOW)
            self.top |= 1 << (word >> _WIDTH)
        self.low[word] |= 1 << (rank & _LOW)

    def take(self) -> tuple[int, list[int]]:
        """Remove the bucket of the lowest rank; its positions ascend."""
        top = self.top
        upper = (top & -top).bit_length() - 1
        bits = self.middle[upper]
        word = (upper << _WIDTH) + (bits & -bits).bit_length() - 1
        bits = self.low[word]
        rank = (word << _WIDTH) + (bits & -bits).bit_length() - 1
        self.low[word] = bits & (bits - 1)
        if not self.low[word]:
            self.middle[upper] &= ~(1 << (word & _LOW))
            if not self.middle[upper]:
                self.top &= ~(1 << upper)
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


class ByteBpe:
    """A vocabulary of ranked byte strings; the id of a string is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_segments: int = CACHE_SEGMENTS):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self._queue = RankQueue(max(ranks.values()) + 1)
        self._table = SegmentTable(self._segments, cache_segments)
        self._kept: dict[str, list[int]] = {}
        self._kept_limit = cache_segments // 4
        strings = {rank: data for data, rank in ranks.items()}
        held = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.known = np.array([i in strings for i in range(len(held))])
        self._lengths = np.array([len(h) for h in held], np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._bytes = np.frombuffer(b"".join(held), np.uint8)
        # The rank of two adjacent pieces is that of their joint bytes.
        self._shift = len(held).bit_length()
        self._pairs = {
            ranks[data[:i]] << self._shift | ranks[data[i:]]: rank
            for data, rank in ranks.items()
            for i in range(1, len(data))
            if data[:i] in ranks and data[i:] in ranks
        }
        self._single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self._two = np.array(
            [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64
        )

    def merge(self, pre_tokens: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token. All share one queue, as one list with gaps."""
        sizes = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        data = np.frombuffer(b"".join(pre_tokens), np.uint8).astype(np.int64)
        n = len(data)
        if not n:
            return [[] for _ in pre_tokens]
        last = (np.cumsum(sizes) - 1)[sizes > 0]
        first = np.concatenate(([0], last[:-1] + 1))
        ranks = np.full(n, -1, np.int64)
        ranks[:-1] = self._two[data[:-1] << 8 | data[1:]]
        ranks[last] = -1
        links = np.arange(1, n + 1)
        links[last] = n
        after = links.tolist()
        links = np.arange(-1, n - 1)
        links[first] = -1
        before = links.tolist()
        ids, pair_rank = self._single[data].tolist(), ranks.tolist()

        queue, buckets, pairs, shift = self._queue, self._queue.buckets, self._pairs.get, self._shift
        places = np.flatnonzero(ranks >= 0)
        places = places[np.argsort(ranks[places], kind="stable")]
        used, at = np.unique(ranks[places], return_index=True)
        for rank, positions in zip(used.tolist(), np.split(places, at[1:])):
            queue.open(rank, positions.tolist())

        while queue.top:
            rank, positions = queue.take()
            for entry, i in enumerate(positions):
                if pair_rank[i] != rank:
                    continue  # stale: gone, or paired anew
                j = after[i]
                k = after[j]
                ids[i], ids[j], pair_rank[j] = rank, -1, -1
                after[i] = k
                lowest = rank
                if k < n:
                    before[k] = i
                    new = pair_rank[i] = pairs(rank << shift | ids[k], -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            queue.open(new, [i])
                        if new < lowest:
                            lowest = new
                else:
                    pair_rank[i] = -1
                h = before[i]
                if h >= 0:
                    new = pairs(ids[h] << shift | rank, -1)
                    if new != pair_rank[h]:
                        pair_rank[h] = new
                        if new >= 0:
                            if new in buckets:
                                buckets[new].append(h)
                            else:
                                queue.open(new, [h])
                            if new < lowest:
                                lowest = new
                if lowest < rank:
                    # A lower rank came up; it goes before the rest of this bucket.
                    if entry + 1 < len(positions):
                        queue.open(rank, positions[entry + 1 :])
                    break
        merged = np.array(ids)
        left = merged >= 0
        ends = np.concatenate(([0], np.cumsum(left)))[np.cumsum(sizes)].tolist()
        flat = merged[left].tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def _pre_tokens(self, texts: list[list[str]]) -> None:
        """See that all pre-tokens are held."""
        kept, new = self._kept, {}
        for some in texts:
            for text in some:
                if text not in kept and text not in new:
                    new[text] = text.encode()
        if len(kept) + len(new) > self._kept_limit:
            kept.clear()
            new = {text: text.encode() for some in texts for text in some}
        parts = []
        for text, data in new.items():
            whole = self.ranks.get(data)
            if whole is None:
                parts.append(text)
            else:
                kept[text] = [whole]
        kept.update(zip(parts, self.merge([new[text] for text in parts])))

    def _segments(self, segments: list[bytes]) -> list[list[int]]:
        find, kept = self.pattern.findall, self._kept
        found = [find(data.decode()) for data in segments]
        self._pre_tokens(found)
        return [
            kept[some[0]] if len(some) == 1 else [i for text in some for i in kept[text]]
            for some in found
        ]

    def plain(self, text: str) -> np.ndarray:
        """The ids of a text, by the pattern over the whole of it."""
        return np.array(self._segments([text.encode()])[0], np.uint32)

    def _run(self, batch: list[bytes]) -> list[np.ndarray]:
        joint = bytes([_SENTINEL])
        units = np.frombuffer(joint + joint.join(batch) + joint, np.uint8)
        kind = _KIND[units]
        same_before = kind[1:] == kind[:-1]
        begins = np.concatenate(([True], ~same_before))
        # In a run of white space followed by a word the last character stands apart;
        # a blank there goes with the word.
        to_word = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 0))
        begins[to_word] = True
        begins[to_word[units[to_word] == 32] + 1] = False
        begins &= kind != 2
        starts = np.flatnonzero(begins)
        stops = np.flatnonzero(begins | (kind == 2))
        ends = stops[np.searchsorted(stops, starts, side="right")]
        ids, counts = self._table.ids(units, starts, ends)
        after = np.concatenate(([0], np.cumsum(counts)))
        text_ends = np.cumsum([len(data) + 1 for data in batch])
        return np.split(ids, after[np.searchsorted(starts, text_ends)][:-1])

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of every text, without special tokens."""
        results: list[list[np.ndarray]] = [[] for _ in texts]
        batch, owners, held = [], [], 0

        def run() -> None:
            for owner, ids in zip(owners, self._run(batch)):
                results[owner].append(ids)
            batch.clear()
            owners.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if not text.isascii() and _WIDE_BLANK.search(text):
                results[i].append(self.plain(text))
                continue
            data = text.encode()
            for start, end in piece_ranges(data, BATCH_BYTES):
                batch.append(data[start:end])
                owners.append(i)
                held += end - start
                if held >= BATCH_BYTES:
                    run()
                    held = 0
        if batch:
            run()
        return [
            some[0] if len(some) == 1 else np.concatenate(some) if some else _NONE
            for some in results
        ]

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and where each id's bytes end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        lengths = self._lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        out = np.empty(total, np.uint8)
        step = 1 << 18
        for a in range(0, len(ids), step):  # so that the places take little memory
            part = slice(a, a + step)
            first = int(ends[a] - lengths[a])
            places = np.repeat(self._starts[ids[part]] - (ends[part] - lengths[part]), lengths[part])
            places += np.arange(first, first + len(places))
            out[first : first + len(places)] = self._bytes[places]
        return out, ends


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of base64 strings and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One encoder, with its table, per Python worker and vocabulary."""
    return ByteBpe(read_ranks(path), pattern)


def _row_slices(array: pa.Array, values: int) -> list[pa.Array]:
    """An array in slices of rows, so that a worker unpacks only a few at once."""
    return [array.slice(at, values) for at in range(0, max(len(array), 1), values)]


ROWS = 256  # unpacked at once


def _encoded(texts: pa.Array, ranks_path: str, pattern: str) -> pa.Array:
    coder, flat, sizes = byte_bpe(ranks_path, pattern), [], []
    for part in _row_slices(texts, ROWS):
        found = coder.encode_batch(part.to_pylist())
        sizes += map(len, found)
        flat += [np.concatenate(found).astype(np.int32)] if found else []
    bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    joint = np.concatenate(flat) if flat else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(joint))


def _decoded(arrays: pa.Array, ranks_path: str, pattern: str) -> pa.Array:
    coder, data, sizes = byte_bpe(ranks_path, pattern), [], []
    for part in _row_slices(arrays, ROWS):
        counts = np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        out, ends = coder.decode_flat(part.flatten().to_numpy(zero_copy_only=False))
        sizes.append(np.diff(np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]))
        data.append(out.tobytes())
    bounds = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
    buffers = [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(b"".join(data))]
    return pa.Array.from_buffers(pa.binary(), len(arrays), buffers)


def encode(
    df: DataFrame, ranks_path: str, pattern: str, text_column: str = "text", ids_column: str = "ids"
) -> DataFrame:
    """Add an array of ids; a column of its name is replaced."""

    def encoded(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([_encoded(texts, ranks_path, pattern)], [ids_column])

    return append(df, encoded, [text_column], f"`{ids_column}` array<int>")


def decode(
    df: DataFrame, ranks_path: str, pattern: str, ids_column: str = "ids", bytes_column: str = "decoded"
) -> DataFrame:
    """Add the bytes that the ids stand for; a column of its name is replaced."""

    def decoded(arrays: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([_decoded(arrays, ranks_path, pattern)], [bytes_column])

    return append(df, decoded, [ids_column], f"`{bytes_column}` binary")


def round_trip(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    text_column: str = "text",
    ids_column: str = "ids",
    bytes_column: str = "decoded",
) -> DataFrame:
    """``encode`` and ``decode`` in turn, in one Python worker instead of two."""

    def both(texts: pa.Array) -> pa.Array:
        ids = _encoded(texts, ranks_path, pattern)
        return pa.StructArray.from_arrays(
            [ids, _decoded(ids, ranks_path, pattern)], [ids_column, bytes_column]
        )

    return append(df, both, [text_column], f"`{ids_column}` array<int>, `{bytes_column}` binary")
