"""BPE encoding as a streaming transducer with bounded lookahead, and incremental decoding.

A merge list whose tokens each come from one merge, later than the merges of its halves, has
a *sufficient lookahead*: what lies further right than that can never change which tokens
stand here. It is computed once from the list. A difference at the right end starts at the
last symbol; a merge carries it on only if one of its halves is in doubt when its turn comes,
so one pass over the merges in order bounds how far left each token in doubt can begin.

The encoder is fed a text in pieces of any size. It splits off special strings, normalises
up to a place where normal forms cannot reach across, splits words and their pieces where no
later character can change the split, and gives the symbols of a piece to the transducer.
That holds a window of a few lookaheads, merges it, emits the tokens that end before the
lookahead and keeps the rest; a piece of any length takes the same memory. Short words met
before are looked up in a bounded table, which is a cache and never changes a result.

The decoder is a state machine over bytes: it holds at most the three bytes of an unfinished
character, and gives the text so far. Tokens become bytes as the vocabulary's own decoder
says: without one, their printed forms with a blank between them.

Defined results: a null text is an empty one, with no ids and an empty decoded text; null or
unknown ids decode to nothing; null ids columns decode to an empty text. A run of combining
marks is held whole, as normalising sorts it. A merge list without a sufficient lookahead
(not proper, in the above sense) is refused, as are vocabularies of another make.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from vintry.llm.columns import append
from vintry.llm.segments import SegmentTable

FEED = 1 << 16  # characters, or ids, given to a machine at once
CACHE_WORDS = 600_000
CACHED_BYTES = 128  # longer words are streamed, never kept
ROWS = 128  # unpacked at once
JOINED = 1 << 18  # characters of whole texts looked up together

_BLANK = re.compile(r"[\t-\r ]")
_REPLACED = "�"


def sufficient_lookahead(merges: list[tuple[str, str]], base: set[str]) -> int:
    """How many symbols to the right can have a say in where a token ends.

    ``reach`` bounds how far left of a change a token can begin whose presence depends on
    that change. Symbols at the change itself reach 0. Merges take their turns in order of
    rank, each after those that make its halves.
    """
    length = dict.fromkeys(base, 1)
    reach = dict.fromkeys(base, 0)
    for left, right in merges:
        if left not in length or right not in length or left + right in length:
            raise ValueError(f"not a proper merge list at {left!r} {right!r}")
        far = max(reach[left], reach[right] + length[left])
        made = left + right
        length[made] = length[left] + length[right]
        reach[made] = far
        # Where the merge did not happen, its halves are left.
        reach[left] = max(reach[left], far)
        reach[right] = max(reach[right], far - length[left])
    return max(reach.values(), default=0)


class Merges:
    """The merge list over symbol ids, with its lookahead."""

    def __init__(self, pairs: list[tuple[str, str]], ids: dict[str, int]):
        made = {a + b for a, b in pairs}
        self.lookahead = sufficient_lookahead(pairs, set(ids) - made)
        self.longest = max(map(len, made), default=1)
        self.ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.made_array = np.array(self.made, np.int64)
        self.pairs = PairTable(self.ranks)

    def run(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """Tokens of a window, and where each ends: lowest rank first, leftmost of equals."""
        n = len(symbols)
        ranks, names = self.ranks, self.made
        token, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [
            (rank, i) for i in range(n - 1) if (rank := ranks.get((token[i], token[i + 1]))) is not None
        ]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if token[i] < 0 or j >= n or ranks.get((token[i], token[j])) != rank:
                continue
            made = names[rank]
            token[i], token[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = ranks.get((made, token[k]))
                if found is not None:
                    heapq.heappush(queue, (found, i))
            h = before[i]
            if h >= 0:
                found = ranks.get((token[h], made))
                if found is not None:
                    heapq.heappush(queue, (found, h))
        places = [i for i in range(n) if token[i] >= 0]
        return [token[i] for i in places], [after[i] for i in places]

    def run_many(self, pieces: list[list[int]]) -> list[list[int]]:
        """The same tokens for many short pieces, one merge of each at a time, in step."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        found: list[list[int]] = [[]] * len(pieces)
        # Like lengths together, so that little of each block is padding.
        order = np.argsort(sizes, kind="stable")
        for block in np.array_split(order, max(1, len(order) // 256)):
            width = int(sizes[block].max(initial=0))
            tokens = np.full((len(block), width + 1), -1, np.int64)
            for row, i in enumerate(block.tolist()):
                tokens[row, : len(pieces[i])] = pieces[i]
            self._in_step(tokens)
            ends = (tokens >= 0).sum(1).tolist()
            for i, row, end in zip(block.tolist(), tokens.tolist(), ends):
                found[i] = row[:end]
        return found

    def _in_step(self, tokens: np.ndarray) -> None:
        """Merge every row of ``tokens``, padded with -1, as far as it goes."""
        near = self.pairs.ranks(tokens[:, :-1], tokens[:, 1:])
        rows, width = np.arange(len(tokens)), tokens.shape[1]
        columns = np.arange(width)
        while width > 1 and len(rows):
            part = near[rows]
            at = part.argmin(1)
            rank = part[np.arange(len(rows)), at]
            open_ = rank < _NONE
            rows, at, rank = rows[open_], at[open_], rank[open_]
            if not len(rows):
                break
            # Drop the right half of each pair, and what was known of it.
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            moved = np.take_along_axis(tokens[rows], source, 1)
            moved[:, -1] = -1
            one = np.arange(len(rows))
            moved[one, at] = self.made_array[rank]
            known = np.take_along_axis(near[rows], np.minimum(source[:, :-1], width - 2), 1)
            known[:, -1] = _NONE
            known[one, at] = self.pairs.ranks(moved[one, at], moved[one, np.minimum(at + 1, width - 1)])
            left = at > 0
            one, before = one[left], at[left] - 1
            known[one, before] = self.pairs.ranks(moved[one, before], moved[one, before + 1])
            tokens[rows], near[rows] = moved, known


_NONE = 1 << 60


class PairTable:
    """Ranks of pairs of ids, looked up for whole arrays: open addressing in one array."""

    def __init__(self, ranks: dict[tuple[int, int], int]):
        self.bits = max(4, (8 * len(ranks)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int64)
        keys = np.array([a << 32 | b for a, b in ranks], np.int64)
        values = np.fromiter(ranks.values(), np.int64, len(ranks))
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            target, first = np.unique(slots[free], return_index=True)
            taken = np.flatnonzero(free)[first]
            self.keys[target], self.values[target] = keys[taken], values[taken]
            left = np.ones(len(keys), bool)
            left[taken] = False
            keys, values, slots = keys[left], values[left], (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; no rank where it is none, or either is padding."""
        keys = ((left << 32) | right).ravel()
        result = np.full(keys.shape, _NONE, np.int64)
        open_ = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slots = self._slots(keys[open_])
        while len(open_):
            held = self.keys[slots]
            same = held == keys[open_]
            result[open_[same]] = self.values[slots[same]]
            go_on = ~same & (held >= 0)
            open_, slots = open_[go_on], (slots[go_on] + 1) & ((1 << self.bits) - 1)
        return result.reshape(left.shape)


@cache
def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes themselves, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class PieceTransducer:
    """Tokens of one piece, emitted as soon as they are stable."""

    def __init__(self, vocabulary: "Vocabulary", window: int | None = None):
        # One symbol more than the lookahead: only the last one of a piece has its own form.
        self.inner, self.last = vocabulary.inner, vocabulary.last
        self.merges = merges = vocabulary.merges
        self.held = merges.lookahead + 1
        self.window = max(window or 0, 4 * self.held, self.held + merges.longest + 1)
        self.symbols: list[int] = []
        self.end: str | None = None  # its form is known when the next letter, or none, comes

    def feed(self, letters: str) -> list[int]:
        found, inner = [], self.inner
        for start in range(0, len(letters), self.window):
            part = letters[start : start + self.window]
            if self.end is not None:
                self.symbols.append(inner[self.end])
            self.symbols += map(inner.__getitem__, part[:-1])
            self.end = part[-1]
            if len(self.symbols) >= self.window:
                tokens, ends = self.merges.run(self.symbols)
                stable = len(self.symbols) - self.held
                n = sum(end <= stable for end in ends)
                found += tokens[:n]
                del self.symbols[: ends[n - 1] if n else 0]
        return found

    def finish(self) -> list[int]:
        if self.end is not None:
            self.symbols.append(self.last[self.end])
        found, _ = self.merges.run(self.symbols)
        self.symbols, self.end = [], None
        return found


@cache
def _joins_back() -> frozenset[str]:
    """Characters that normal forms may join to the one before."""
    seconds = {
        parts[1]
        for c in map(chr, range(0x110000))
        if (d := unicodedata.decomposition(c)) and not d.startswith("<")
        and len(parts := [chr(int(p, 16)) for p in d.split()]) == 2
    }
    hangul = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    return frozenset(seconds | hangul)


def _starts_anew(c: str) -> bool:
    """No normal form reaches from before this character to it or beyond."""
    return c.isascii() or not (
        unicodedata.combining(c) or unicodedata.category(c) == "Cn" or c in _joins_back()
    )


class Vocabulary:
    """A word-splitting vocabulary file, with all that the machines share."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as lines:
            made = json.load(lines)
        self.library = Tokenizer.from_file(path)  # its normaliser and splitter are used
        model = made["model"]
        splits = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        if (
            model["type"] != "BPE" or model["continuing_subword_prefix"] or model["byte_fallback"]
            or model["ignore_merges"] or splits[0].get("behavior") != "Removed"
            or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"])
        ):
            raise ValueError(f"{path} is not a word-splitting byte-level vocabulary")
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(pairs, ids)
        self.inner = {c: ids[c] for c in byte_letters()}
        self.last = {c: ids[c + suffix] for c in byte_letters()}
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        whole = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("|".join(map(re.escape, whole))) if whole else None
        self.openings = {s[:n] for s in whole for n in range(1, len(s))}
        self.table = SegmentTable(self._made, cache_words)
        self.pieces: dict[str, list[int]] = {}  # as the table, a bounded cache
        self.kept_pieces = cache_words // 2

    def normal(self, text: str) -> str:
        return self.library.normalizer.normalize_str(text)

    def split(self, plain: str) -> list[tuple[str, tuple[int, int]]]:
        """Pieces of normalised text, as byte letters, with their places."""
        return self.library.pre_tokenizer.pre_tokenize_str(plain)

    def symbols(self, letters: str) -> list[int]:
        return [*map(self.inner.__getitem__, letters[:-1]), self.last[letters[-1]]]

    def _made(self, words: list[bytes]) -> list[list[int]]:
        """The ids of short words without blanks, which the table has not met."""
        owners, pieces = [], []
        for i, data in enumerate(words):
            text = data.decode()
            if text.isascii() and text.isprintable():
                # Normal as it is, and split by the vocabulary's own rule for such characters.
                split = _ASCII_PIECES.findall(text.lower())
            else:
                split = [letters for letters, _ in self.split(self.normal(text))]
            pieces += split
            owners += [i] * len(split)
        # A piece of fewer symbols than the lookahead waits for its end in any case.
        new = [p for p in dict.fromkeys(pieces) if p not in self.pieces]
        if len(self.pieces) + len(new) > self.kept_pieces:
            self.pieces, new = {}, list(dict.fromkeys(pieces))
        self.pieces.update(zip(new, self.merges.run_many([self.symbols(p) for p in new])))
        found: list[list[int]] = [[] for _ in words]
        for i, piece in zip(owners, pieces):
            found[i] += self.pieces[piece]
        return found

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids of each word, where each word begins) of text cut at blanks."""
        units = np.frombuffer(data + b" ", np.uint8)
        blank = _BLANKS[units]
        starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        ends = np.flatnonzero(blank & np.concatenate(([False], ~blank[:-1])))
        long = np.flatnonzero(ends - starts > CACHED_BYTES)
        found, counts, first = [_NO_IDS], [np.zeros(0, np.int64)], 0
        lowered = _LOWER[units]
        for i in (*long.tolist(), len(starts)):
            if i > first:
                ids, each = self.table.ids(lowered, starts[first:i], ends[first:i])
                found.append(ids)
                counts.append(each)
            if i < len(starts):
                ids = Encoder(self).word(data[starts[i] : ends[i]].decode())
                found.append(ids)
                counts.append(np.array([len(ids)]))
            first = i + 1
        return np.concatenate(found), np.concatenate(counts), starts


# The split of the vocabulary's own configuration, for lower-cased ASCII words.
_ASCII_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class Encoder:
    """Feed a text in pieces of any size; ids come out as soon as they are stable."""

    def __init__(self, vocabulary: Vocabulary, window: int | None = None):
        self.vocabulary, self.window = vocabulary, window
        self.raw = ""  # may begin a special string
        self.text = ""  # no blank in it: a word that may go on
        self.plain = ""  # normalised, from the first piece that may change
        self.machine = PieceTransducer(vocabulary, window)

    def feed(self, text: str) -> np.ndarray:
        raw, pattern, found = self.raw + text, self.vocabulary.special_pattern, []
        at = 0
        if pattern:
            for match in pattern.finditer(raw):
                found.append(self._words(raw[at : match.start()], True))
                found.append(np.array([self.vocabulary.special[match[0]]], np.uint32))
                at = match.end()
        keep = max(
            (n for n in range(1, 1 + min(len(raw) - at, max(map(len, self.vocabulary.openings), default=0)))
             if raw[len(raw) - n :] in self.vocabulary.openings), default=0,
        )
        found.append(self._words(raw[at : len(raw) - keep], False))
        self.raw = raw[len(raw) - keep :]
        return np.concatenate(found)

    def finish(self) -> np.ndarray:
        last = self._words(self.raw, True)
        self.raw = ""
        return last

    def _words(self, text: str, ends: bool) -> np.ndarray:
        """Whole words are looked up; what follows the last blank stays open."""
        found = []
        if self.text or self.plain:
            blank = _BLANK.search(text)
            stop = blank.start() if blank else len(text)
            found.append(self._open(text[:stop], bool(blank) or ends))
            text = text[stop:]
        if text:
            cut = len(text) if ends else max(map(text.rfind, " \t\n\r\v\f")) + 1
            found.append(self._closed(text[:cut]))
            if cut < len(text):
                found.append(self._open(text[cut:], False))
        return np.concatenate(found) if found else _NO_IDS

    def _closed(self, text: str) -> np.ndarray:
        return self.vocabulary.words(text.encode())[0]

    def word(self, text: str) -> np.ndarray:
        """The ids of one long word, streamed."""
        return self._open(text, True)

    def _open(self, text: str, ends: bool) -> np.ndarray:
        """One word, in parts: normalise and split as far as that is settled."""
        found: list[int] = []
        for start in range(0, len(text), FEED):
            self.text += text[start : start + FEED]
            cut = len(self.text) - 1
            while cut > 0 and not _starts_anew(self.text[cut]):
                cut -= 1
            if cut > 0:
                self._split(self.text[:cut], False, found)
                self.text = self.text[cut:]
        if ends:
            self._split(self.text, True, found)
            self.text = ""
        return np.array(found, np.uint32)

    def _split(self, text: str, ends: bool, found: list[int]) -> None:
        """Give settled pieces to the transducer.

        Text is split again from the first piece that may still change: the last one, and
        one before it that may be the apostrophe of a contraction.
        """
        plain = self.plain + self.vocabulary.normal(text)
        pieces = self.vocabulary.split(plain)
        n = len(pieces)
        if not ends and n:
            n -= 1
            if n and pieces[n - 1][0] == "'":
                n -= 1
        for letters, _ in pieces[:n]:
            found += self.machine.feed(letters)
            found += self.machine.finish()
        self.plain = plain[pieces[n][1][0] :] if n < len(pieces) else ""
        if len(pieces) - n == 1 and pieces[n][1][1] == len(plain):
            self._advance(found)

    def _advance(self, found: list[int]) -> None:
        """Let the transducer have the sure part of one long open piece, and forget it.

        A run of letters or of signs goes on as it began, and its last characters are
        enough to split on from: two signs of one run never begin a contraction.
        """
        cut = len(self.plain) - _TAIL
        if cut > 0:
            found += self.machine.feed(in_letters(self.plain[:cut]))
            self.plain = self.plain[cut:]


_NO_IDS = np.zeros(0, np.uint32)
_BLANKS = np.zeros(256, bool)
_BLANKS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TAIL = 64


@cache
def _letter_bytes() -> dict[str, int]:
    return {letter: b for b, letter in enumerate(byte_letters())}


def in_letters(text: str) -> str:
    return "".join(map(byte_letters().__getitem__, text.encode()))


class Decoder:
    """Feed ids; text comes out as soon as its characters are complete."""

    def __init__(self, token_bytes: list[bytes | None], separator: bytes):
        self.token_bytes, self.separator = token_bytes, separator
        self.begun, self.pending = False, b""

    def feed(self, ids: list[int]) -> str:
        table, n = self.token_bytes, len(self.token_bytes)
        parts = [table[i] for i in ids if 0 <= i < n and table[i] is not None]
        if not parts:
            return ""
        data = self.separator.join(parts)
        if self.begun:
            data = self.separator + data
        self.begun = True
        return self._text(data)

    def finish(self) -> str:
        """What is left can only be an unfinished character."""
        left, self.pending = self.pending, b""
        return _REPLACED if left else ""

    def _text(self, data: bytes) -> str:
        data = self.pending + data
        cut = len(data) - _unfinished(data)
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")


def _unfinished(data: bytes) -> int:
    """How many last bytes begin a character that more bytes could complete."""
    for n in range(1, min(3, len(data)) + 1):
        lead = data[-n]
        if lead & 0xC0 == 0x80:
            continue
        if lead < 0xC2 or lead > 0xF4:
            return 0
        width = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        if n >= width:
            return 0
        if n > 1:
            low, high = _SECOND.get(lead, (0x80, 0xBF))
            if not low <= data[1 - n] <= high:
                return 0
        return n
    return 0


# Lead bytes whose second byte has a narrower range in UTF-8.
_SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}


def token_table(path: str) -> tuple[list[bytes | None], bytes]:
    """Bytes of every id, and what stands between two tokens, as the file's decoder says."""
    with open(path, encoding="utf-8") as lines:
        made = json.load(lines)
    decoder = (made["decoder"] or {}).get("type")
    if decoder not in (None, "ByteLevel"):
        raise ValueError(f"{path} has the decoder {decoder}")
    tokens = dict(made["model"]["vocab"]) | {t["content"]: t["id"] for t in made["added_tokens"]}
    table: list[bytes | None] = [None] * (max(tokens.values(), default=-1) + 1)
    letters = _letter_bytes()
    for token, i in tokens.items():
        raw = decoder == "ByteLevel" and all(c in letters for c in token)
        table[i] = bytes(map(letters.__getitem__, token)) if raw else token.encode()
    return table, b"" if decoder else b" "


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary, with its table of words, per Python worker."""
    return Vocabulary(path)


@lru_cache(maxsize=2)
def _tokens(path: str) -> tuple[list[bytes | None], bytes]:
    return token_table(path)


def encode_text(shared: Vocabulary, text: str | None, feed: int = FEED) -> np.ndarray:
    if not text:
        return _NO_IDS
    machine = Encoder(shared)
    parts = [machine.feed(text[at : at + feed]) for at in range(0, len(text), feed)]
    return np.concatenate([*parts, machine.finish()])


def decode_ids(path: str, ids: list[int], feed: int = FEED) -> str:
    machine = Decoder(*_tokens(path))
    parts = [machine.feed(ids[at : at + feed]) for at in range(0, len(ids), feed)]
    return "".join(parts) + machine.finish()


def encode_texts(shared: Vocabulary, texts: list[str | None]) -> list[np.ndarray]:
    """Many texts. Those without special strings are cut at blanks, and looked up together."""
    found: list[np.ndarray] = [_NO_IDS] * len(texts)
    held, size = [], 0

    def look_up() -> None:
        data = [texts[i].encode() for i in held]
        ids, counts, starts = shared.words(b" ".join(data))
        after = np.concatenate(([0], np.cumsum(counts)))
        ends = np.cumsum([len(d) + 1 for d in data])
        for i, part in zip(held, np.split(ids, after[np.searchsorted(starts, ends[:-1])])):
            found[i] = part

    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) > JOINED or (shared.special_pattern and shared.special_pattern.search(text)):
            found[i] = encode_text(shared, text)
            continue
        held.append(i)
        size += len(text)
        if size > JOINED:
            look_up()
            held, size = [], 0
    if held:
        look_up()
    return found


def _encoded(texts: pa.Array, path: str) -> pa.Array:
    shared, chunks = vocabulary(path), []
    for at in range(0, max(len(texts), 1), ROWS):
        found = encode_texts(shared, texts.slice(at, ROWS).to_pylist())
        bounds = np.concatenate(([0], np.cumsum([len(ids) for ids in found]))).astype(np.int32)
        flat = np.concatenate([_NO_IDS, *found]).astype(np.int32)
        chunks.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)))
    return pa.concat_arrays(chunks)


def _decoded(arrays: pa.Array, path: str) -> pa.Array:
    chunks = []
    for at in range(0, max(len(arrays), 1), ROWS):
        part = arrays.slice(at, ROWS)
        counts = np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        # Null ids become -1, which no vocabulary has.
        flat = pc.fill_null(part.flatten(), -1).to_numpy(zero_copy_only=False)
        rows = np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else []
        chunks.append(pa.array([decode_ids(path, row.tolist()) for row in rows], pa.string()))
    return pa.concat_arrays(chunks)


def encode(
    df: DataFrame, path: str, text_column: str = "text", ids_column: str = "ids"
) -> DataFrame:
    """Add the ids of each text; a column of that name is replaced."""

    def encoded(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([_encoded(texts, path)], [ids_column])

    return append(df, encoded, [text_column], f"`{ids_column}` array<int>")


def decode(
    df: DataFrame, path: str, ids_column: str = "ids", decoded_column: str = "decoded"
) -> DataFrame:
    """Add the text of each array of ids; a column of that name is replaced."""

    def decoded(arrays: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([_decoded(arrays, path)], [decoded_column])

    return append(df, decoded, [ids_column], f"`{decoded_column}` string")


def round_trip(
    df: DataFrame, path: str, text_column: str = "text",
    ids_column: str = "ids", decoded_column: str = "decoded",
) -> DataFrame:
    """``encode`` and ``decode`` in turn, in one Python worker instead of two."""

    def both(texts: pa.Array) -> pa.Array:
        ids = _encoded(texts, path)
        return pa.StructArray.from_arrays([ids, _decoded(ids, path)], [ids_column, decoded_column])

    return append(df, both, [text_column], f"`{ids_column}` array<int>, `{decoded_column}` string")
