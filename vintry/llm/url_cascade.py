"""URL rules by Bloom filter cascades.

A rule is a host and a path; it fits its host and all subdomains where the URL's path
begins with the rule's. The keys a URL could be listed under are the pairs of a suffix of
its host and a beginning of its path, of those path lengths that rules have. All keys of
the corpus are known beforehand, so a cascade can tell listed keys from all others without
an error (suffixes of more labels than any rule's host has are no keys at all): level 0 encodes the listed keys, level 1 the corpus keys that level 0 passes
wrongly, level 2 the listed keys that level 1 passes wrongly, and so on until none is left.
Judging a URL is a few bit look-ups per key; no join and no shuffle.

There is one cascade for allowed and one for blocked keys. Filters have so many bits that
level 1 gets about as many keys as are listed (bits grow with the list, and with the
logarithm of the corpus over the list), so what is broadcast is bounded by the list.

Defined results: where no rule fits, the cascades list the URL nowhere, and it is allowed;
of rules that fit the longest (host and path together, then the longer host) wins; a rule
listed both ways blocks; a null URL, or one without ``://``, has an empty host and path;
repeated rows are judged each for itself; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintry.llm.columns import append, checkpointed, map_batches, named, others

ALLOW, BLOCK = "allow", "block"
MOST_LEVELS = 64

_KEYS, _HASHES = "__vintry_keys", "__vintry_hashes"
_SECOND = 0x5851F42D4C957F2D


def split_url(url: Column) -> tuple[Column, Column]:
    """Lower-case host and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, path


def candidate_keys(host: Column, path: Column, lengths: list[int], labels: int) -> Column:
    """Pairs of a host suffix and a path beginning, joined, in the order they win.

    No rule's host has more than ``labels`` labels, so longer suffixes are listed nowhere.
    """
    held = F.length(host) - F.length(F.replace(host, F.lit("."))) + 1
    counts = F.sequence(F.lit(1), F.least(held, F.lit(max(labels, 1))))
    suffixes = F.transform(counts, lambda i: F.call_function("substring_index", host, F.lit("."), -i))
    starts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda n: F.struct(
        (-F.length(s) - n).alias("order"), (-F.length(s)).alias("host_order"),
        F.concat(s, F.substring(path, F.lit(1), n)).alias("key"),
    ))))
    found = F.transform(F.array_sort(keys), lambda k: k["key"])
    return F.when(host == "", F.array().cast("array<string>")).otherwise(found)


def key_hashes(key: Column) -> Column:
    """Two hashes of a key, from which all bit places follow."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit(_SECOND)).alias("b"))


@dataclass
class Bloom:
    bits: np.ndarray
    size: int
    probes: int
    salt: int

    def places(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """Bit places of keys, one array per probe; levels use places of their own."""
        a, b = a.view(np.uint64), b.view(np.uint64)
        salted = a + np.uint64(self.salt) * (b | np.uint64(1))
        salted = (salted ^ (salted >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        step = (b ^ (b >> np.uint64(33))) | np.uint64(1)
        return [(salted + np.uint64(i) * step) % np.uint64(self.size) for i in range(self.probes)]

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.ones(len(a), bool)
        for places in self.places(a, b):
            found &= (self.bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def _empty(n: int, rate: float, salt: int) -> Bloom:
    size = max(64, ceil(n * -log(rate) / log(2) ** 2))
    probes = max(1, round(size / max(n, 1) * log(2))) if n else 1
    return Bloom(np.zeros(-(-size // 8), np.uint8), size, min(probes, 24), salt)


def _filled(keys: DataFrame, n: int, rate: float, level: int) -> Bloom:
    """Each task sets the bits of its keys; the parts are put together by or."""
    bloom = _empty(n, rate, level)
    width = len(bloom.bits)
    chunk = 1 << 16  # bytes of the filter in a row

    def set_bits(batches):
        part = np.zeros(width, np.uint8)
        for batch in batches:
            a, b = (np.ascontiguousarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
            for places in bloom.places(a, b):
                bits = np.uint8(1) << (places & np.uint64(7)).astype(np.uint8)
                np.bitwise_or.at(part, (places >> np.uint64(3)).astype(np.int64), bits)
        for at in range(0, width, chunk):
            piece = part[at : at + chunk]
            if piece.any():
                words = np.zeros(-(-len(piece) // 8) * 8, np.uint8)
                words[: len(piece)] = piece
                words = words.view(np.int64)
                used = np.flatnonzero(words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used + at // 8), pa.array(words[used])], ["word", "bits"]
                )

    parts = map_batches(keys.select("a", "b"), set_bits, "word bigint, bits bigint")
    table = parts.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(-(-width // 8), np.int64)
    words[table["word"].to_numpy()] = table["bits"].to_numpy()
    bloom.bits = words.view(np.uint8)[:width].copy()
    return bloom


@dataclass
class Cascade:
    """Levels in turn: listed keys, others that pass, listed ones that pass those, ..."""

    levels: list[Bloom] = field(default_factory=list)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which keys are listed; exact for every key of the universe."""
        result = np.zeros(len(a), bool)
        going = np.arange(len(a))
        for number, level in enumerate(self.levels):
            passed = level.holds(a[going], b[going])
            # The side a key leaves on decides: failing level 0 means not listed, failing
            # level 1 listed, and so on.
            result[going[~passed]] = number % 2 == 1
            going = going[passed]
        result[going] = len(self.levels) % 2 == 1
        return result


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade for the keys (columns ``a``, ``b``) of ``listed`` among ``universe``."""
    # Listed or not is a flag of each key, put together where equal keys meet anyway.
    flagged = checkpointed(
        universe.select("a", "b", F.lit(0).alias("listed"))
        .unionByName(listed.select("a", "b", F.lit(1).alias("listed")))
        .groupBy("a", "b").agg(F.max("listed").alias("listed"))
    )
    inside, outside = (flagged.where(F.col("listed") == flag).select("a", "b") for flag in (1, 0))
    n, total = flagged.agg(F.coalesce(F.sum("listed"), F.lit(0)), F.count("*")).first()
    if not n:
        return Cascade()
    cascade = Cascade()
    rate = min(0.5, max(n / max(total, 1) / 2, 2.0**-30))
    keys, against = inside, outside
    while True:
        number = len(cascade.levels)
        if number == MOST_LEVELS:
            raise RuntimeError("two keys share all hashes")
        level = _filled(keys, n, rate if number == 0 else 0.5, number)
        cascade.levels.append(level)

        def passing(batches, level=level):
            for batch in batches:
                a, b = (np.ascontiguousarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
                yield batch.filter(pa.array(level.holds(a, b)))

        wrong = checkpointed(map_batches(against.select("a", "b"), passing, "a bigint, b bigint"))
        n = wrong.count()
        if not n:
            return cascade
        keys, against = wrong, keys


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    url_column: str = "url",
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced.

    ``rules`` holds (verdict, host, path). The rule shown is host and path, joined.
    """
    spark = pages.sparkSession
    lengths = sorted({len(path) for _, _, path in rules})
    labels = max((host.count(".") + 1 for _, host, _ in rules), default=1)
    host, path = split_url(named(url_column))
    kept = others(pages, ["host", "path", "rule", "verdict"])
    keyed = pages.select(*kept, host.alias("host"), path.alias("path"))
    keyed = keyed.withColumn(_KEYS, candidate_keys(F.col("host"), F.col("path"), lengths, labels))
    universe = checkpointed(
        keyed.select(F.explode(_KEYS).alias("key")).distinct().select(key_hashes(F.col("key")).alias("h")).select("h.*")
    )
    listed = spark.createDataFrame(
        [(v, h.lower() + p) for v, h, p in rules] or [(ALLOW, "")], "verdict string, key string"
    ).select("verdict", key_hashes(F.col("key")).alias("h"))
    cascades = {
        verdict: build(listed.where(F.col("verdict") == verdict).select("h.*"), universe)
        for verdict in ((ALLOW, BLOCK) if rules else ())
    }

    def found(hashes: pa.Array) -> pa.Array:
        sizes = hashes.value_lengths().to_numpy(zero_copy_only=False)
        flat = hashes.flatten()
        a, b = (np.ascontiguousarray(flat.field(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
        state = np.zeros(len(a), np.int8)
        for mark, verdict in ((1, ALLOW), (2, BLOCK)):
            if verdict in cascades:
                state[cascades[verdict].holds(a, b)] = mark
        ends = np.cumsum(sizes)
        hits = np.flatnonzero(state)
        first = np.searchsorted(hits, ends - sizes)
        place = hits[np.minimum(first, len(hits) - 1)] if len(hits) else np.zeros(len(sizes), np.int64)
        fits = (first < len(hits)) & (place < ends)
        index = np.where(fits, place - (ends - sizes) + 1, 0)
        blocked = fits & (state[np.minimum(place, len(state) - 1)] == 2) if len(state) else fits
        return pa.StructArray.from_arrays(
            [pa.array(index.astype(np.int32)), pa.array(blocked)], ["__vintry_at", "__vintry_blocked"]
        )

    hashed = keyed.withColumn(_HASHES, F.transform(_KEYS, key_hashes))
    judged = append(hashed, found, [_HASHES], "__vintry_at int, __vintry_blocked boolean")
    at = F.col("__vintry_at")
    return judged.select(
        *kept, "host", "path",
        F.when(at > 0, F.try_element_at(_KEYS, at)).alias("rule"),
        F.when(F.col("__vintry_blocked"), BLOCK).otherwise(ALLOW).alias("verdict"),
    )
