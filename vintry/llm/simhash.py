"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of ``BITS`` bits link at ``distance`` or fewer differing bits. The bits are
grouped into a few partitions, bits that correlate together. For every fingerprint each
partition i gets a threshold t_i >= -1 with sum(t_i + 1) = distance + 1: were every
partition to differ in more than t_i bits, the whole would differ in more than
``distance``, so probing partition i for all values within t_i misses nothing (-1: the
partition is not probed). Which thresholds cost least depends on how crowded the
fingerprint's values are; dynamic programming picks them from estimated candidate counts.
Candidates found are verified on the whole fingerprint.

Equal fingerprints are one node from the start, so groups of copies cost one probe. Of the
links a task verifies it passes on a forest, so a group of slightly edited copies does not
become all its pairs.

Defined results: a text without words, or null, has fingerprint zero, which links like
any other; repeated rows share a fingerprint; a null id takes part in linking but never
names a component (that of a group of null ids alone is null); an empty table gives no
rows; columns of the names written are replaced.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintry.llm.columns import append, checkpointed, map_batches, named, others, stored
from vintry.llm.components import components, spanning

BITS = 64
SHINGLE = 4
SEED = 42
DISTANCE = 4
# A partition's histogram counts its values by so many leading bits.
COARSE = 12
# Hashes counted at once.
BLOCK = 1 << 15

_FP, _ROW = "__vintry_fp", "__vintry_row"


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of all shingle hashes, repeats included."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        parts = [words[i : len(words) - shingle + 1 + i] for i in range(shingle)]
        shingles = map(b" ".join, zip(*parts))
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64)
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int32)
    over = np.packbits(set_bits * 2 > len(hashes), bitorder="little")
    return int(over.view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, text_column: str = "text", column: str = "fp", shingle: int = SHINGLE
) -> DataFrame:
    """Add the fingerprint as a signed 64-bit number."""

    def computed(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
        return pa.StructArray.from_arrays([pa.array(found.view(np.int64))], [column])

    return append(docs, computed, [text_column], f"`{column}` bigint")


def bits_of(values: np.ndarray) -> np.ndarray:
    """One row of 0/1 per fingerprint, lowest bit first."""
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def joint_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many each pair of bits is set.

    Every task sends its 64 x 64 sums, so the driver gets the same amount at any size
    once they are added up.
    """

    def summed(batches):
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), BLOCK):
                bits = bits_of(np.ascontiguousarray(values[at : at + BLOCK])).astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
            n += len(values)
        places = np.arange(BITS * BITS + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(places), pa.array(np.append(total.ravel(), n))], ["place", "n"]
        )

    rows = (
        map_batches(distinct.select("fp"), summed, "place int, n bigint")
        .groupBy("place").agg(F.sum("n").alias("n")).collect()
    )
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for row in rows:
        flat[row["place"]] = row["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def partition_count(n: int, distance: int = DISTANCE) -> int:
    """Two or three partitions, whichever cost less if values were spread evenly.

    Two are for tens of millions of distinct fingerprints and more. With more partitions
    the number of probes would be smaller for small tables only, and then rise with size.
    """

    def cost(parts: int) -> float:
        width = BITS / parts
        shares = [(distance + 1) // parts + (i < (distance + 1) % parts) for i in range(parts)]
        probes = sum(sum(comb(round(width), j) for j in range(s)) for s in shares)
        return probes * (1 + n / 2**width)

    return min((3, 2), key=cost)


def correlated_groups(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of nearly equal size; each takes in the bit it correlates with most."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(correlation, 0)
    left, groups = list(range(BITS)), []
    for part in range(parts):
        size = len(left) // (parts - part)
        # Start from the bit with the strongest tie to those left.
        group = [max(left, key=lambda b: (correlation[b, left].max(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (correlation[b, group].mean(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def projected(values: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a group, as one number per fingerprint."""
    unsigned = values.view(np.uint64)
    out = np.zeros(len(values), np.int64)
    for place, bit in enumerate(group):
        out |= ((unsigned >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << place
    return out


def histograms(distinct: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """Per partition, how many fingerprints have each value of the coarse bits."""

    def counted(batches):
        sums = [np.zeros(1 << min(COARSE, len(g)), np.int64) for g in groups]
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            for total, group in zip(sums, groups):
                coarse = projected(values, group) & (len(total) - 1)
                total += np.bincount(coarse, minlength=len(total))
        for part, total in enumerate(sums):
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), part, np.int32)), pa.array(used), pa.array(total[used])],
                ["part", "value", "n"],
            )

    rows = (
        map_batches(distinct.select("fp"), counted, "part int, value bigint, n bigint")
        .groupBy("part", "value").agg(F.sum("n").alias("n")).collect()
    )
    sums = [np.zeros(1 << min(COARSE, len(g)), np.int64) for g in groups]
    for row in rows:
        sums[row["part"]][row["value"]] = row["n"]
    return sums


def flips(width: int, most: int) -> np.ndarray:
    """All masks of up to ``most`` bits, fewest first."""
    return np.array(
        [sum(1 << b for b in some) for k in range(most + 1) for some in combinations(range(width), k)],
        np.int64,
    )


def probe_costs(histogram: np.ndarray, width: int, distance: int) -> np.ndarray:
    """Cost of thresholds -1 .. distance by coarse value: probes and expected candidates."""
    coarse = len(histogram).bit_length() - 1
    fine = width - coarse
    values = np.arange(len(histogram))
    at_distance = [
        sum(histogram[values ^ sum(1 << b for b in some)] for some in combinations(range(coarse), k))
        if k <= coarse else np.zeros(len(histogram))
        for k in range(distance + 1)
    ]
    costs = np.zeros((distance + 2, len(histogram)))
    for t in range(distance + 1):
        probes = sum(comb(width, k) for k in range(min(t, width) + 1))
        found = sum(
            at_distance[k] * sum(comb(fine, j) for j in range(t - k + 1)) / 2**fine
            for k in range(t + 1)
        )
        costs[t + 1] = probes + found
    return costs


def allocate(costs: list[np.ndarray], distance: int = DISTANCE) -> np.ndarray:
    """Thresholds (one row per partition) that cost each fingerprint least.

    ``costs[i][u]`` is what u units (a threshold of u - 1) cost in partition i. Dynamic
    programming over partitions and units spent so far.
    """
    units, n = distance + 1, costs[0].shape[1]
    best = np.full((units + 1, n), np.inf)
    best[0] = 0
    choices = []
    for cost in costs:
        options = np.full((units + 1, units + 1, n), np.inf)  # by units so far and spent here
        for total in range(units + 1):
            for here in range(total + 1):
                options[total, here] = best[total - here] + cost[here]
        choices.append(options.argmin(axis=1))
        best = options.min(axis=1)
    thresholds = np.empty((len(costs), n), np.int64)
    left, every = np.full(n, units), np.arange(n)
    for part in range(len(costs) - 1, -1, -1):
        here = choices[part][left, every]
        thresholds[part] = here - 1
        left = left - here
    return thresholds


def near_links(distinct: DataFrame, distance: int = DISTANCE, parts: int | None = None) -> DataFrame:
    """All links (a, b) of the distinct ``fp`` values within ``distance`` bits, each found
    from one or both ends, once per partition that finds it.

    ``parts``, the number of partitions, is chosen by cost; it never changes what links.
    """
    n, both = joint_counts(distinct)
    groups = correlated_groups(n, both, parts or partition_count(n, distance))
    costs = [
        probe_costs(h, len(g), distance) for h, g in zip(histograms(distinct, groups), groups)
    ]

    def probes(batches):
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            for at in range(0, len(values), 4096):
                part_values = values[at : at + 4096]
                own = [projected(part_values, g) for g in groups]
                thresholds = allocate(
                    [c[:, v & (c.shape[1] - 1)] for c, v in zip(costs, own)], distance
                )
                for part, (group, value) in enumerate(zip(groups, own)):
                    for t in np.unique(thresholds[part]):
                        chosen = np.flatnonzero(thresholds[part] == t)
                        if t < 0:
                            continue
                        masks = flips(len(group), min(int(t), len(group)))
                        probed = (value[chosen, None] ^ masks[None, :]).ravel()
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(probed << 3 | part),
                                pa.array(np.repeat(part_values[chosen], len(masks))),
                            ],
                            ["key", "a"],
                        )

    def indexed(batches):
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            for part, group in enumerate(groups):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(projected(values, group) << 3 | part), pa.array(values)], ["key", "b"]
                )

    queries = map_batches(distinct.select("fp"), probes, "key bigint, a bigint")
    index = map_batches(distinct.select("fp"), indexed, "key bigint, b bigint")
    within = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return queries.join(index, "key").where((F.col("a") != F.col("b")) & within).select("a", "b")


def near_pairs(distinct: DataFrame, distance: int = DISTANCE, parts: int | None = None) -> DataFrame:
    """All pairs (a < b) of the distinct ``fp`` values within ``distance`` bits, once each."""
    return near_links(distinct, distance, parts).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()


def grouped(ids: DataFrame, id_column: str, distance: int = DISTANCE) -> DataFrame:
    """(fp, component, component_id) for every distinct ``__vintry_fp`` of ``ids``."""
    nodes = checkpointed(
        ids.groupBy(F.col(_FP).alias("fp")).agg(F.min(named(id_column)).alias("lowest"))
    )
    # Of a key's verified links only a forest leaves the task that found them.
    links = spanning(near_links(nodes.select("fp"), distance), "a", "b")
    reached = components(links, "a", "b")
    members = nodes.join(reached, F.col("fp") == F.col("node"), "left").select(
        "fp", "lowest", F.coalesce("component", "fp").alias("component")
    )
    lowest = members.groupBy("component").agg(F.min("lowest").alias("component_id"))
    return members.join(lowest, "component").select("fp", "component", "component_id")


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    distance: int = DISTANCE,
    shingle: int = SHINGLE,
) -> DataFrame:
    """One row per document, its text replaced by ``fingerprint`` (16 hexadecimal digits)
    and ``component_id``, the smallest id among all documents reachable by links.
    """
    kept = others(docs, [text_column, "fingerprint", "component_id"])
    # The texts are hashed once; what follows reads the checkpoint.
    ids = checkpointed(fingerprints(docs, text_column, _FP, shingle).select(*kept, _FP))
    groups = grouped(ids, id_column, distance).select(F.col("fp").alias(_FP), "component_id")
    return ids.join(groups, _FP).select(
        *kept, F.lower(F.lpad(F.hex(_FP), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    distance: int = DISTANCE,
    shingle: int = SHINGLE,
) -> DataFrame:
    """Of every group of near-duplicates one row, with the columns of ``docs`` unchanged.

    It is the row with the smallest id (null last), of several such rows any one.
    """
    numbered = fingerprints(docs, text_column, _FP, shingle)
    rows = stored(numbered.withColumn(_ROW, F.monotonically_increasing_id()))
    ids = rows.select(named(id_column), _ROW, _FP)
    groups = grouped(ids, id_column, distance).select(F.col("fp").alias(_FP), "component")
    order = F.struct(named(id_column).isNull(), named(id_column), F.col(_ROW).alias("row"))
    kept = ids.join(groups, _FP).groupBy("component").agg(F.min(order)["row"].alias(_ROW))
    return rows.join(kept.select(_ROW), _ROW, "left_semi").select(*map(named, docs.columns))
