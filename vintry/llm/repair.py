"""Repair of conversation structure: cheapest edits that give alternating roles.

A conversation should read ``(s?(ua)+)?`` in role initials. Rows are kept, given another
role, deleted or inserted at a cost. The repaired roles of one length are one fixed string,
so every feasible length is a target, and turns are aligned to it by Wagner and Fischer's
recurrence. Alternating strings of all lengths are suffixes of one another: one table of
costs from (row, letters left) to the end serves all of them. Ukkonen's band leaves out cells
that the incumbent, the cost of one greedy repair, cannot reach. All alignments of the least
cost are traced back and the least audit, as text, is taken.

Conversations are dealt by range of (conversation, turn), so none has to fit into one task,
and cut into segments of at most ``segment_rows`` rows, which are aligned where they lie. What
a segment needs of the others is small: of the later ones the cost to the end from each of
four places in the grammar, of the earlier ones the place where they stopped, and which of
its rows they have seen. These are passed along a conversation's segments by streams over
rows of a few numbers. Most conversations are one segment and need none of this.

Defined results: a null id, role or text counts as one space, a null turn comes first and is
no gap; rows of one turn are ordered by role and text; repeated rows are duplicates of the
first; texts are taken whole; a conversation whose rows are all gone has zero counts and an
empty audit; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintry.llm.columns import map_batches, named, stored
from vintry.llm.positions import sorted_ranges

SEGMENT_ROWS = 1024
SEGMENT_CHARACTERS = 8_000_000  # of text in one segment, or one row

REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
_FAR = 1 << 40

# Places in the grammar: nothing yet; after s; a is next; u is next, or the end.
START, AFTER_S, WANTS_A, DONE = range(4)
_AT_END = (0, _FAR, _FAR, 0)
_NEXT = {AFTER_S: "u", WANTS_A: "a", DONE: "u", START: "u"}
_LONG_ROLE = {"u": "user", "a": "assistant"}

_SEEN = re.compile(r"[^\x20\x09-\x0d]")
_BLANKS = " \t\n\v\f\r"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text), each damaged as the digest of its place says.

    A dropped row stays as a row without a role, so that its conversation is not lost.
    """
    rows = conversations.select(*[named(c).alias(c) for c in ("conv_id", "turn", "role", "text")])
    place = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), F.lit(" ")),
    )
    kind = F.crc32(place.cast("binary")) % 20
    role = F.coalesce("role", F.lit(" "))
    text = F.coalesce("text", F.lit(" "))
    role = F.when(kind == 0, F.lit(None)).when(kind == 4, F.lit("user")).otherwise(role)
    text = F.when(kind.isin(0, 1), F.lit("")).when(
        kind == 2, F.regexp_replace(text, "[.!?]", "")
    ).otherwise(text)
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")
    ).drop("copy")


# Segments


def _cuts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple]:
    """(conversation, its consecutive rows), cut at ``rows`` of them or very long texts."""
    held: list = []
    conv, characters = None, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for row in zip(*[c.slice(at, 256).to_pylist() for c in batch.columns]):
                full = len(held) >= rows or characters > SEGMENT_CHARACTERS
                if held and (row[0] != conv or full):
                    yield conv, held
                    held, characters = [], 0
                conv = row[0]
                held.append(row)
                characters += len(row[3])
    if held:
        yield conv, held


def _pack(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    ready, size = [], 0
    for conv, held in _cuts(batches, rows):
        real = [r for r in held if r[2] is not None]
        ready.append({
            "conv_id": conv, "turns": [r[1] for r in real],
            "roles": [r[2] for r in real], "texts": [r[3] for r in real],
        })
        size += sum(len(r[3]) for r in real) + 100
        if size > SEGMENT_CHARACTERS:
            yield pa.RecordBatch.from_pylist(ready, _PACKED)
            ready, size = [], 0
    if ready:
        yield pa.RecordBatch.from_pylist(ready, _PACKED)


_PACKED = pa.schema([
    ("conv_id", pa.int64()), ("turns", pa.list_(pa.int64())),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
])


def segments(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(conv_id, segment, turns, roles, texts): ``segment`` rises along a conversation."""
    dealt = sorted_ranges(rows, ["conv_id", "turn", "role", "text"])
    packed = map_batches(
        dealt, partial(_pack, rows=segment_rows), "conv_id bigint, turns array<bigint>, roles array<string>, texts array<string>"
    )
    return stored(packed.withColumn("segment", F.monotonically_increasing_id()))


# Faults and costs of one segment


class Turns(NamedTuple):
    """One segment as the alignment sees it."""

    roles: list[str]
    texts: list[str]
    forced: list[bool]  # rows that have to go
    short: list[bool]  # rows cut short
    blank: int
    duplicate: int

    @classmethod
    def of(cls, roles: list[str], texts: list[str], earlier: set[int]) -> "Turns":
        """``earlier`` holds the rows that an earlier segment has seen."""
        seen, forced, short = set(), [], []
        blank = duplicate = 0
        for i, row in enumerate(zip(roles, texts)):
            is_blank = not _SEEN.search(row[1])
            is_copy = not is_blank and (row in seen or i in earlier)
            blank += is_blank
            duplicate += is_copy
            seen.add(row)
            forced.append(is_blank or is_copy)
            short.append(not forced[-1] and row[1].rstrip(_BLANKS)[-1] not in ".!?")
        return cls(roles, texts, forced, short, blank, duplicate)


def _keep_cost(initial: str, letter: str) -> int:
    return 0 if initial == letter else REROLE if letter != "s" else _FAR


def _greedy(initials: list[str], short: list[bool], start: int, ends: tuple) -> int:
    """The cost of one repair: keep what fits and is whole, and delete the rest."""
    place, cost, best = start, 0, _FAR
    for initial, cut in zip(initials, short):
        if not cut and place == START and initial == "s":
            place = AFTER_S
        elif not cut and initial == _NEXT[place]:
            place = WANTS_A if initial == "u" else DONE
        else:
            cost += DELETE
    for end in range(4):
        best = min(best, cost + ends[end] + (0 if end == place else _FAR))
    # Deleting all rows leaves the place as it was.
    return min(best, DELETE * len(initials) + ends[start])


class Alignment:
    """Costs from every (row, letters left) to the segment's end, within the band.

    ``tail`` is the last letter of the target: WANTS_A after u, DONE after a. ``last`` tells
    that the conversation ends here, where letters may be inserted after the last row.
    """

    def __init__(self, initials, short, tail: int, last: bool, limit: int):
        n = len(initials)
        self.n, self.initials, self.short, self.tail = n, initials, short, tail
        # Fewer letters than rows need deletions, more letters insertions; either beyond
        # the limit cannot be the cheapest.
        self.fewer, self.more = limit // DELETE, limit // INSERT
        self.width = n + self.more + 1
        end_letter = "u" if tail == WANTS_A else "a"
        letters = np.arange(self.width)
        self.is_u = (letters % 2 == 1) == (end_letter == "u")
        self.table = np.full((n + 1, self.width), _FAR, np.int64)
        steps = INSERT * letters
        self.table[n] = steps if last else np.where(letters == 0, 0, _FAR)
        for i in range(n - 1, -1, -1):
            low, high = max(0, n - i - self.fewer), min(self.width, n - i + self.more + 1)
            below = self.table[i + 1]
            row = below[low:high] + DELETE
            keep = np.where(self.is_u[low:high], _keep_cost(initials[i], "u"), _keep_cost(initials[i], "a"))
            keep = keep + CUT_SHORT * short[i]
            first = max(low, 1)
            row[first - low :] = np.minimum(row[first - low :], below[first - 1 : high - 1] + keep[first - low :])
            # Insertions: the least of a row's cells to the left, each letter on the way paid.
            row = np.minimum.accumulate(row - steps[low:high]) + steps[low:high]
            self.table[i, low:high] = np.minimum(row, _FAR)

    def beginning(self, letter: str, nothing: bool) -> np.ndarray:
        """Lengths whose target begins with a letter, and no letters where that may be."""
        fits = self.is_u == (letter == "u")
        fits[0] = nothing
        return np.flatnonzero(fits)

    def cheapest(self, i: int, lengths: np.ndarray, besides: int, how: tuple) -> list[tuple[int, tuple]]:
        """The targets of least cost from row ``i``, each with its length after ``how``."""
        costs = self.table[i, lengths]
        if not len(costs) or costs.min() >= _FAR:
            return []
        least = lengths[costs == costs.min()].tolist()
        return [(int(costs.min()) + besides, (*how, left)) for left in least]

    def letter(self, left: int) -> str:
        return "u" if self.is_u[left] else "a"

    def trace(self, i: int, left: int) -> list[tuple[str, str]]:
        """The least audit from a cell: (edit, letter) in order, D before I before K and R."""
        edits, table = [], self.table
        while i < self.n or left:
            cost = table[i, left]
            if i < self.n and table[i + 1, left] + DELETE == cost:
                edits.append(("D", ""))
                i += 1
            elif left and table[i, left - 1] + INSERT == cost:
                edits.append(("I", self.letter(left)))
                left -= 1
            else:
                letter = self.letter(left)
                edits.append(("K" if self.initials[i] == letter else "R", letter))
                i, left = i + 1, left - 1
        return edits


class Repair(NamedTuple):
    cost: int  # to the end of the conversation
    audit: str
    letters: list[str]  # one per edit; nothing for a deletion
    place: int  # where the grammar stands after the segment


def repair(turns: Turns, start: int, ends: tuple, last: bool) -> Repair | None:
    """The cheapest repair of a segment entered at ``start``; of equals the least audit.

    ``ends`` is the cost to the conversation's end from each place after the segment. None
    where no repair leads on.
    """
    free = [i for i, forced in enumerate(turns.forced) if not forced]
    initials = [turns.roles[i][:1] for i in free]
    short = [turns.short[i] for i in free]
    limit = _greedy(initials, short, start, ends)
    least = min(ends)
    if least >= _FAR:
        return None
    limit = min(limit, DELETE * len(free) + 4 * INSERT + max(e for e in ends if e < _FAR)) - least
    n, found = len(free), []

    # Candidates: the cost, and how to trace the edits if it is the least.
    options: list[tuple[int, tuple]] = []
    if ends[start] < _FAR and start in (START, AFTER_S):
        options.append((DELETE * n + ends[start], ("none", start)))
    systems = [p for p, initial in enumerate(initials) if initial == "s"] if start == START else []
    if ends[AFTER_S] < _FAR:
        for p in systems:
            cost = DELETE * (n - 1) + CUT_SHORT * short[p] + ends[AFTER_S]
            options.append((cost, ("lone", AFTER_S, p)))
    for tail in (WANTS_A, DONE):
        if ends[tail] >= _FAR:
            continue
        table = Alignment(initials, short, tail, last, limit)
        # From START, or after u a, the next letter is u; the one after u is a.
        lengths = table.beginning("a" if start == WANTS_A else "u", start == tail)
        options += table.cheapest(0, lengths, ends[tail], ("plain", tail, table))
        for p in systems:
            before = DELETE * p + CUT_SHORT * short[p] + ends[tail]
            options += table.cheapest(p + 1, table.beginning("u", False), before, ("system", tail, table, p))
    best = min((cost for cost, _ in options), default=_FAR)
    if best >= _FAR:
        return None
    for cost, how in options:
        if cost != best:
            continue
        if how[0] == "none":
            found.append(([("D", "")] * n, how[1]))
        elif how[0] == "lone":
            edits = [("D", "")] * how[2] + [("K", "s")] + [("D", "")] * (n - 1 - how[2])
            found.append((edits, how[1]))
        elif how[0] == "plain":
            _, tail, table, left = how
            found.append((table.trace(0, left), tail))
        else:
            _, tail, table, p, left = how
            found.append(([("D", "")] * p + [("K", "s")] + table.trace(p + 1, left), tail))
    forced = DELETE * (len(turns.forced) - n)
    return _least(turns, found, best + forced)


def _least(turns: Turns, found: list, cost: int) -> Repair:
    """Put deletions that had to be back where they were; take the least audit of all.

    A forced deletion and an insertion before the next row may change places at no cost,
    and D is less than I: forced deletions come first.
    """
    best = None
    for edits, place in found:
        audit, letters, at = [], [], 0
        todo = iter(edits)
        edit = next(todo, None)
        while at < len(turns.forced) or edit:
            if at < len(turns.forced) and turns.forced[at]:
                audit.append("D")
                letters.append("")
                at += 1
                continue
            audit.append(edit[0])
            letters.append(edit[1])
            at += edit[0] != "I"
            edit = next(todo, None)
        joined = "".join(audit)
        if best is None or joined < best.audit:
            best = Repair(cost, joined, letters, place)
    return best


def repaired_turns(turns: Turns, done: Repair) -> list[tuple[str, str]]:
    """(role, text) of the repaired segment."""
    rows, at = [], 0
    for edit, letter in zip(done.audit, done.letters):
        if edit == "I":
            rows.append((_LONG_ROLE[letter], ""))
            continue
        if edit == "K":
            rows.append((turns.roles[at], turns.texts[at]))
        elif edit == "R":
            rows.append((_LONG_ROLE[letter], turns.texts[at]))
        at += 1
    return rows


# What segments of one conversation tell each other


def _each(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from batch.slice(at, rows).to_pylist()


def _emit(found: Iterator[dict], schema: pa.Schema, rows: int = 64) -> Iterator[pa.RecordBatch]:
    held = []
    for row in found:
        held.append(row)
        if len(held) == rows:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _streamed(df: DataFrame, order: list[Column], step, schema: str, arrow: pa.Schema) -> DataFrame:
    """Rows of a conversation in order, one at a time, through ``step(state, row)``."""

    def run(batches):
        def rows():
            conv = state = None
            for row in _each(batches):
                if row["conv_id"] != conv or state is None:
                    conv, state = row["conv_id"], None
                state, made = step(state, row)
                if made:
                    yield made

        return _emit(rows(), arrow)

    dealt = df.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), *order)
    return map_batches(dealt, run, schema)


def _known_earlier(split: DataFrame) -> DataFrame:
    """(segment, earlier): rows whose role and text an earlier segment holds."""
    keys = split.select(
        "conv_id", "segment", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row")
    ).select(
        "segment", "at",
        F.sha2(F.concat_ws("\0", F.col("conv_id").cast("string"), "row.roles", "row.texts"), 256)
        .alias("content"),
    )
    # One row per segment and content before the exchange, however often it is repeated.
    held = keys.groupBy("content", "segment").agg(F.collect_list("at").alias("places"))
    first = held.groupBy("content").agg(
        F.min("segment").alias("first"), F.max("segment").alias("final")
    ).where("final > first")
    later = held.join(first.drop("final"), "content").where("segment > first")
    return later.groupBy("segment").agg(F.flatten(F.collect_list("places")).alias("earlier"))


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost through each segment from every place to every place."""

    def rows():
        for row in _each(batches):
            turns = Turns.of(row["roles"], row["texts"], set(row["earlier"] or ()))
            costs = []
            for start in range(4):
                for end in range(4):
                    ends = tuple(0 if e == end else _FAR for e in range(4))
                    done = repair(turns, start, ends, row["last"])
                    costs.append(done.cost if done else _FAR)
            yield {"conv_id": row["conv_id"], "segment": row["segment"], "costs": costs}

    return _emit(rows(), pa.schema([
        ("conv_id", pa.int64()), ("segment", pa.int64()), ("costs", pa.list_(pa.int64())),
    ]))


def _to_the_end(ends: tuple | None, row: dict) -> tuple[tuple, dict]:
    """From the last segment backwards: the cost to the end after each segment."""
    after = ends or _AT_END
    costs = row["costs"]
    before = tuple(
        min(_FAR, min(costs[4 * start + end] + after[end] for end in range(4))) for start in range(4)
    )
    return before, {"conv_id": row["conv_id"], "segment": row["segment"], "ends": list(after)}


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each segment leads from every place, given the costs after it."""

    def rows():
        for row in _each(batches):
            turns = Turns.of(row["roles"], row["texts"], set(row["earlier"] or ()))
            places = []
            for start in range(4):
                done = repair(turns, start, tuple(row["ends"]), row["last"])
                places.append(done.place if done else -1)
            yield {"conv_id": row["conv_id"], "segment": row["segment"], "places": places}

    return _emit(rows(), pa.schema([
        ("conv_id", pa.int64()), ("segment", pa.int64()), ("places", pa.list_(pa.int64())),
    ]))


def _entry(state: tuple | None, row: dict) -> tuple[tuple, dict]:
    start = state[0] if state else START
    made = {"conv_id": row["conv_id"], "segment": row["segment"], "start": start}
    return (row["places"][start],), made


def _entered(split: DataFrame) -> DataFrame:
    """(segment, earlier, ends, last, start) of the segments of conversations that have several."""
    known = split.join(_known_earlier(split), "segment", "left")
    pair = [("conv_id", pa.int64()), ("segment", pa.int64())]
    through = stored(map_batches(
        known.select("conv_id", "segment", "roles", "texts", "earlier", "last"), _transfers,
        "conv_id bigint, segment bigint, costs array<bigint>",
    ))
    ends = stored(_streamed(
        through, [F.col("segment").desc()], _to_the_end,
        "conv_id bigint, segment bigint, ends array<bigint>",
        pa.schema([*pair, ("ends", pa.list_(pa.int64()))]),
    ))
    priced = stored(known.join(ends.drop("conv_id"), "segment"))
    exits = map_batches(
        priced.select("conv_id", "segment", "roles", "texts", "earlier", "last", "ends"), _exits,
        "conv_id bigint, segment bigint, places array<bigint>",
    )
    starts = _streamed(
        exits, [F.col("segment")], _entry, "conv_id bigint, segment bigint, start bigint",
        pa.schema([*pair, ("start", pa.int64())]),
    )
    return priced.select("segment", "earlier", "ends", "last").join(starts.drop("conv_id"), "segment")


# Results


_REPAIRED = """
    conv_id bigint, segment bigint, first string, final string, blank bigint, duplicate bigint,
    truncated bigint, illegal bigint, cost bigint, audit string, digest string,
    roles array<string>, texts array<string>
"""
_REPAIRED_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("segment", pa.int64()), ("first", pa.string()), ("final", pa.string()),
    *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
    ("audit", pa.string()), ("digest", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
])


def _lines(rows: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in rows).encode()


def _cost_here(turns: Turns, done: Repair) -> int:
    prices, at, cost = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}, 0, 0
    for edit in done.audit:
        cost += prices[edit]
        if edit != "I":
            cost += CUT_SHORT * (edit != "D" and turns.short[at])
            at += 1
    return cost


def _repair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for row in _each(batches):
            turns = Turns.of(row["roles"], row["texts"], set(row["earlier"] or ()))
            whole = row["start"] is None
            if whole:
                done = repair(turns, START, _AT_END, True)
            else:
                done = repair(turns, row["start"], tuple(row["ends"]), row["last"])
            fixed = repaired_turns(turns, done)
            digest = hashlib.sha256(_lines(fixed)).hexdigest() if whole else None
            initials = [role[:1] for role in turns.roles]
            yield {
                "conv_id": row["conv_id"], "segment": row["segment"],
                "first": initials[0] if initials else None,
                "final": initials[-1] if initials else None,
                "blank": turns.blank, "duplicate": turns.duplicate, "truncated": sum(turns.short),
                "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                "cost": _cost_here(turns, done), "audit": done.audit,
                "digest": digest, "roles": [r for r, _ in fixed], "texts": [t for _, t in fixed],
            }

    return _emit(rows(), _REPAIRED_ARROW)


def repaired_segments(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Every segment of ``damaged`` rows with its counts, its edits and its repaired turns.

    ``roles`` and ``texts`` are the repaired turns, ``digest`` that of a conversation which
    is one segment; ``first`` and ``final`` the initials of
    the rows as they were; ``cost`` what this segment's edits cost.
    """
    cut = segments(rows, segment_rows)
    several = cut.groupBy("conv_id").agg(
        F.count("*").alias("parts"), F.max("segment").alias("final_segment")
    ).where("parts > 1").select(F.col("conv_id").alias("__c"), "final_segment")
    # Keys first: texts meet the others by segment, which no conversation crowds.
    parts = cut.select("conv_id", "segment").join(
        several, F.col("conv_id").eqNullSafe(F.col("__c"))
    ).select("segment", (F.col("segment") == F.col("final_segment")).alias("last"))
    told = _entered(stored(cut.drop("turns").join(parts, "segment")))
    whole = cut.drop("turns").join(told, "segment", "left")
    return map_batches(
        whole.select("conv_id", "segment", "roles", "texts", "earlier", "ends", "last", "start"),
        _repair_rows, _REPAIRED,
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of every conversation's lines, one segment in memory at a time."""

    def rows():
        conv, digest, begun, some = None, None, False, False
        for row in _each(batches, 8):
            if not some or row["conv_id"] != conv:
                if some:
                    yield {"conv_id": conv, "streamed": digest.hexdigest()}
                conv, digest, begun, some = row["conv_id"], hashlib.sha256(), False, True
            lines = list(zip(row["roles"], row["texts"]))
            if lines:
                digest.update(b"\n" * begun + _lines(lines))
                begun = True
        if some:
            yield {"conv_id": conv, "streamed": digest.hexdigest()}

    return _emit(rows(), pa.schema([("conv_id", pa.int64()), ("streamed", pa.string())]))


def conversations_summary(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per conversation: faults, cost, audit and digest of the repaired turns.

    A digest of one text is made by one task by its nature; that task streams segments.
    """
    found = repaired_segments(rows, segment_rows)
    parted = F.col("digest").isNull()
    done = stored(found.withColumns({
        c: F.when(parted, F.col(c)).alias(c) for c in ("roles", "texts")
    }))
    steps = F.array_sort(F.collect_list(F.struct("segment", "first", "final", "audit")))
    totals = done.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        steps.alias("steps"), F.max("digest").alias("digest"),
    )
    met = F.filter("steps", lambda s: s["first"].isNotNull())
    across = F.aggregate(
        met, F.struct(F.lit(None).cast("string").alias("final"), F.lit(0).cast("bigint").alias("n")),
        lambda a, s: F.struct(
            s["final"].alias("final"),
            (a["n"] + F.when(
                a["final"].isNotNull() & ~F.concat(a["final"], s["first"]).isin("su", "ua", "au"), 1
            ).otherwise(0)).cast("bigint").alias("n"),
        ),
        lambda a: a["n"],
    )
    present = rows.where(F.col("role").isNotNull())
    span = present.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps")
    )
    lines = done.where(parted).select("conv_id", "segment", "roles", "texts").repartition("conv_id")
    digests = map_batches(
        lines.sortWithinPartitions("conv_id", "segment"), _digests,
        "conv_id bigint, streamed string",
    )

    def same(other: DataFrame, name: str) -> tuple[DataFrame, Column]:
        renamed = other.withColumnRenamed("conv_id", name)
        return renamed, F.col("conv_id").eqNullSafe(F.col(name))

    joined = totals.withColumn("illegal", F.col("illegal") + across).withColumn(
        "audit", F.array_join("steps.audit", "")
    )
    for other, name in ((span, "__s"), (digests, "__d")):
        renamed, condition = same(other, name)
        joined = joined.join(renamed, condition, "left")
    return joined.select(
        "conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated",
        "illegal", "cost", "audit", F.coalesce("digest", "streamed").alias("repaired_sha256"),
    )
