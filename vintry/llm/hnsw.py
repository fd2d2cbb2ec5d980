"""Near-duplicate embeddings by hierarchical navigable small-world graphs per shard.

Vectors are dealt to shards of bounded size within their label. Each shard builds a graph:
every vector is linked to diverse near ones, a few vectors also on higher, sparser levels.
Every shard queries itself and every other shard of its label: down the levels, a beam
search at the bottom, then from what lies within the threshold on to linked vectors within
it, until no more turn up. The graph answers every query; searches are audited at a bounded
cost. When a shard is built, near copies of some of its vectors are made, each just within
the threshold, so that true links exist whatever the table holds, and the beam is doubled
until all of these are found. Of the queries that another shard asks, ``AUDITED_QUERIES`` are
compared with all vectors, and the beam is doubled while their links are missed.

Found links are verified by cosine in double precision. A task takes a pair of shards in
both directions; what one direction finds counts for both ends. It reports per vector how
many links it has and, of all links, only a spanning forest: the same components with at
most one edge per vector instead of every pair of a large group.

Equal vectors of a label are one node from the start, with their number.

Defined results: vectors that are null, zero, or hold null or non-finite components, and
those whose label is null, link with nothing and are components of their own; so are
vectors of different length; null ids come back linked to nothing, their component null;
rows that repeat an id are counted each; an empty table gives no rows; columns of the
names written are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintry.llm.columns import checkpointed, map_batches, named, others, ship
from vintry.llm.components import components
from vintry.llm.topk import usable

THRESHOLD = 0.98
# Vectors of a shard, about; the graph and vectors of one shard are in a task's memory.
SHARD_ROWS = 16_384
LINKS = 12  # per vector and level; twice as many at the bottom
BUILD_BEAM = 48
BEAM = 24
AUDITED = 128  # vectors of a shard from which near copies are made
AUDITED_NEAR = 0.05  # how far above the threshold these are, of what is left to 1
AUDITED_QUERIES = 128  # real queries compared with a whole shard
RECALL = 1.0  # of the audited links
# The search takes in a little below the threshold, as it works in single precision.
SLACK = 1e-4


class Graph:
    """A hierarchical navigable small world over unit vectors, single precision."""

    def __init__(self, vectors: np.ndarray, bottom: np.ndarray, upper: list[dict[int, np.ndarray]], entry: int):
        self.vectors, self.bottom, self.upper, self.entry = vectors, bottom, upper, entry
        self.seen = np.zeros(len(vectors), np.int64)
        self.mark = 0

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        n = len(vectors)
        graph = cls(vectors, np.full((n, 2 * LINKS), -1, np.int32), [], 0)
        # Levels fall off exponentially; a fixed seed builds the same graph again.
        draws = np.random.default_rng(n).random(n)
        levels = np.minimum((-np.log(np.maximum(draws, 1e-12)) / log(LINKS)).astype(int), 8)
        for i in range(n):
            graph._insert(i, int(levels[i]))
        return graph

    def _near(self, node: int, level: int) -> np.ndarray:
        if level == 0:
            row = self.bottom[node]
            return row[row >= 0]
        return self.upper[level - 1].get(node, _NO_LINKS)

    def _greedy(self, q: np.ndarray, start: int, level: int) -> int:
        best, at = float(self.vectors[start] @ q), start
        while True:
            near = self._near(at, level)
            if not len(near):
                return at
            found = self.vectors[near] @ q
            i = int(found.argmax())
            if found[i] <= best:
                return at
            best, at = float(found[i]), int(near[i])

    def _beam(self, q: np.ndarray, starts: list[int], beam: int, level: int) -> list[tuple[float, int]]:
        """The nodes nearest to ``q`` that a best-first search finds, nearest first."""
        self.mark += 1
        seen, mark, vectors = self.seen, self.mark, self.vectors
        seen[starts] = mark
        found = [(float(s), i) for s, i in zip(vectors[starts] @ q, starts)]
        frontier = [(-s, i) for s, i in found]
        heapq.heapify(frontier)
        heapq.heapify(found)
        while frontier:
            s, node = heapq.heappop(frontier)
            if len(found) >= beam and -s < found[0][0]:
                break
            near = self._near(node, level)
            near = near[seen[near] != mark]
            if not len(near):
                continue
            seen[near] = mark
            scores = vectors[near] @ q
            if len(found) >= beam:
                better = scores > found[0][0]
                near, scores = near[better], scores[better]
            for score, i in zip(scores.tolist(), near.tolist()):
                if len(found) < beam:
                    heapq.heappush(found, (score, i))
                elif score > found[0][0]:
                    heapq.heapreplace(found, (score, i))
                else:
                    continue
                heapq.heappush(frontier, (-score, i))
        return sorted(found, reverse=True)

    def _diverse(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Near nodes, leaving out those nearer to one already taken; then the nearest."""
        ids = [i for _, i in found]
        if len(ids) <= most:
            return ids
        among = self.vectors[ids] @ self.vectors[ids].T
        taken: list[int] = []
        for place, (score, _) in enumerate(found):
            if not taken or among[place, taken].max() < score:
                taken.append(place)
                if len(taken) == most:
                    break
        rest = [p for p in range(len(ids)) if p not in set(taken)]
        return [ids[p] for p in taken + rest[: most - len(taken)]]

    def _link(self, node: int, other: int, level: int) -> None:
        most = 2 * LINKS if level == 0 else LINKS
        near = self._near(node, level)
        if len(near) < most:
            if level == 0:
                self.bottom[node, len(near)] = other
            else:
                self.upper[level - 1][node] = np.append(near, np.int32(other))
            return
        ids = np.append(near, np.int32(other))
        scores = self.vectors[ids] @ self.vectors[node]
        order = np.argsort(-scores, kind="stable")
        kept = self._diverse([(float(scores[o]), int(ids[o])) for o in order], most)
        if level == 0:
            self.bottom[node] = kept
        else:
            self.upper[level - 1][node] = np.array(kept, np.int32)

    def _insert(self, node: int, level: int) -> None:
        old = len(self.upper)
        while len(self.upper) < level:
            self.upper.append({})
        for k in range(1, level + 1):
            self.upper[k - 1].setdefault(node, _NO_LINKS)
        if node == 0:
            return
        q, at = self.vectors[node], self.entry
        for k in range(old, level, -1):
            at = self._greedy(q, at, k)
        starts = [at]
        for k in range(min(level, old), -1, -1):
            found = self._beam(q, starts, BUILD_BEAM, k)
            for other in self._diverse(found, LINKS):
                self._link(node, other, k)
                self._link(other, node, k)
            starts = [i for _, i in found]
        if level > old:
            self.entry = node

    def within(self, q: np.ndarray, threshold: float, beam: int) -> np.ndarray:
        """Nodes whose product with ``q`` reaches the threshold, as far as the search finds."""
        if beam >= len(self.vectors):
            return np.flatnonzero(self.vectors @ q >= threshold)
        at = self.entry
        for k in range(len(self.upper), 0, -1):
            at = self._greedy(q, at, k)
        found = [i for s, i in self._beam(q, [at], beam, 0) if s >= threshold]
        if not found:
            return _NO_LINKS
        # From all that is near enough on to what is linked with it, until nothing is new.
        self.mark += 1
        frontier = np.array(found, np.int64)
        self.seen[frontier] = self.mark
        every = [frontier]
        while len(frontier):
            near = np.unique(self.bottom[frontier])
            near = near[near >= 0]
            near = near[self.seen[near] != self.mark]
            self.seen[near] = self.mark
            frontier = near[self.vectors[near] @ q >= threshold].astype(np.int64)
            every.append(frontier)
        return np.concatenate(every)

    def to_bytes(self) -> dict[str, bytes]:
        triples = [
            (level, node, other)
            for level, links in enumerate(self.upper) for node, some in links.items()
            for other in (some.tolist() or [-1])
        ]
        return {
            "bottom": self.bottom.tobytes(),
            "upper": np.array([(self.entry, len(self.upper), 0), *triples], np.int32).tobytes(),
        }

    @classmethod
    def from_bytes(cls, vectors: np.ndarray, bottom: bytes, upper: bytes) -> Graph:
        rows = np.frombuffer(upper, np.int32).reshape(-1, 3)
        entry, depth, _ = rows[0].tolist()
        links: list[dict[int, list[int]]] = [{} for _ in range(depth)]
        for level, node, other in rows[1:].tolist():
            links[level].setdefault(node, []).extend([other] if other >= 0 else [])
        return cls(
            vectors, np.frombuffer(bottom, np.int32).reshape(len(vectors), 2 * LINKS),
            [{n: np.array(o, np.int32) for n, o in some.items()} for some in links], entry,
        )


_NO_LINKS = np.zeros(0, np.int32)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, safe for very large and very small components."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _truth(exact: np.ndarray, queries: np.ndarray, some: np.ndarray, threshold: float) -> dict[int, np.ndarray]:
    """All links of some queries."""
    near = exact @ queries[some].T >= threshold
    return {int(i): np.flatnonzero(near[:, k]) for k, i in enumerate(some)}


def _passing(graph: Graph, single: np.ndarray, truth: dict[int, np.ndarray], threshold: float, beam: int) -> int:
    """The beam, doubled until the search misses none of the true links."""
    expected = sum(map(len, truth.values()))
    while beam < len(graph.vectors):
        hit = sum(
            len(np.intersect1d(graph.within(single[i], threshold - SLACK, beam), links)) for i, links in truth.items()
        )
        if hit >= RECALL * expected:
            break
        beam *= 2
    return beam


def _own_beam(graph: Graph, exact: np.ndarray, threshold: float, beam: int) -> int:
    """The beam with which the shard's graph finds near copies made for this audit.

    Some of its vectors are turned until their cosine with the original is just above the
    threshold. The original is a true link by construction, also where the table has none.
    """
    some = np.unique(np.linspace(0, len(exact) - 1, AUDITED).astype(int))
    draw = np.random.default_rng(len(exact)).normal(size=(len(some), exact.shape[1]))
    across = draw - (draw * exact[some]).sum(1, keepdims=True) * exact[some]
    length = np.sqrt((across * across).sum(1, keepdims=True))
    near = threshold + AUDITED_NEAR * (1 - threshold)
    turned = exact[some]
    if exact.shape[1] > 1:
        turned = near * exact[some] + np.sqrt(1 - near * near) * across / length
    made = np.concatenate([turned, exact[some]])
    truth = _truth(exact, made, np.arange(len(made)), threshold)
    return _passing(graph, made.astype(np.float32), truth, threshold, beam)


def _searched(
    graph: Graph, exact: np.ndarray, queries: np.ndarray, threshold: float, beam: int, audit: np.ndarray
) -> Iterator[np.ndarray]:
    """Verified links of every query, as the graph finds them.

    ``audit`` is the order in which queries are drawn. At most ``AUDITED_QUERIES`` of them are
    compared with all vectors, to widen the beam while it misses links of theirs; their own
    results come from the graph as well.
    """
    single = queries.astype(np.float32)
    truth = _truth(exact, queries, audit[:AUDITED_QUERIES], threshold)
    beam = _passing(graph, single, truth, threshold, beam)
    for i in range(len(queries)):
        found = graph.within(single[i], threshold - SLACK, beam)
        yield np.sort(found[exact[found] @ queries[i] >= threshold])


def _drawn(n: int) -> np.ndarray:
    """All queries in the order of a fixed draw."""
    return np.random.default_rng(n).permutation(n)


def _linked(a: tuple[Graph, np.ndarray, int], b: tuple[Graph, np.ndarray, int], threshold: float, own: bool) -> np.ndarray:
    """The links between two shards (graph, vectors, beam), as found from either side: a row
    of bits for every vector of ``a``, a bit for every one of ``b``."""
    (graph_a, exact_a, beam_a), (graph_b, exact_b, beam_b) = a, b
    bits = np.zeros((len(exact_a), -(-len(exact_b) // 8)), np.uint8)
    for i, near in enumerate(_searched(graph_b, exact_b, exact_a, threshold, beam_b, _drawn(len(exact_a)))):
        np.bitwise_or.at(bits[i], near >> 3, (128 >> (near & 7)).astype(np.uint8))
        if own:
            bits[near, i >> 3] |= np.uint8(128 >> (i & 7))
    if own:
        every = np.arange(len(exact_a))
        bits[every, every >> 3] &= (255 ^ (128 >> (every & 7))).astype(np.uint8)
    else:
        for j, near in enumerate(_searched(graph_a, exact_a, exact_b, threshold, beam_a, _drawn(len(exact_b)))):
            bits[near, j >> 3] |= np.uint8(128 >> (j & 7))
    return bits


def _reduced(
    bits: np.ndarray, times_a: np.ndarray, times_b: np.ndarray, own: bool
) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """A spanning forest of the links (row, column), and how many rows of the table each
    vector of either side is linked with."""
    n, m = len(times_a), len(times_b)
    at_b = 0 if own else n
    group = np.arange(n + (0 if own else m))
    kept, count_a, count_b = [], np.zeros(n, np.int64), np.zeros(m, np.int64)
    for i in np.flatnonzero(bits.any(axis=1)).tolist():
        near = np.flatnonzero(np.unpackbits(bits[i], count=m))
        count_a[i] = times_b[near].sum()
        count_b[near] += times_a[i]
        groups, first = np.unique(group[near + at_b], return_index=True)
        for g, k in zip(groups.tolist(), first.tolist()):
            if g != group[i]:
                kept.append((i, int(near[k])))
                group[group == g] = group[i]
    return kept, count_a, count_b


def _shards(nodes: DataFrame, shard_rows: int) -> DataFrame:
    """Shard number and count for every node, shards of a label and length alike."""
    groups = nodes.groupBy("label", "dim").agg(
        F.greatest(F.lit(1), F.ceil(F.count("*") / shard_rows)).cast("int").alias("shards")
    )
    return nodes.join(groups, ["label", "dim"]).withColumn(
        "shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")
    )


_BLOCKS = (
    "label string, dim int, shard int, shards int, nodes binary, times binary, vectors binary, "
    "beam int, bottom binary, upper binary"
)


def _built(nodes: DataFrame, shard_rows: int, threshold: float, beam: int) -> DataFrame:
    """One row per shard: its nodes, how many rows each stands for, vectors, graph and beam."""

    def build(pdf):
        import pandas as pd

        pdf = pdf.sort_values("node")
        vectors = _unit(np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), -1))
        first = pdf.iloc[0]
        graph = Graph.build(vectors.astype(np.float32))
        return pd.DataFrame([{
            "label": first["label"], "dim": first["dim"], "shard": first["shard"],
            "shards": first["shards"],
            "nodes": pdf["node"].to_numpy(np.int64).tobytes(),
            "times": pdf["times"].to_numpy(np.int64).tobytes(),
            "vectors": vectors.tobytes(),
            "beam": _own_beam(graph, vectors, threshold, beam),
            **graph.to_bytes(),
        }])

    ship(nodes.sparkSession)
    tasks = max(2, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = _shards(nodes, shard_rows).select("label", "dim", "shard", "shards", "node", "times", "v")
    return dealt.repartition(tasks, "label", "dim", "shard").groupBy("label", "dim", "shard").applyInPandas(build, _BLOCKS)


def _found(blocks: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): spanning links (n null), and per node its number of linked rows (b null)."""

    def shard(r, side):
        nodes, times = (np.frombuffer(r[side + c], np.int64) for c in ("nodes", "times"))
        exact = np.frombuffer(r[side + "vectors"]).reshape(len(nodes), r["dim"])
        graph = Graph.from_bytes(exact.astype(np.float32), r[side + "bottom"], r[side + "upper"])
        return nodes, times, (graph, exact, r[side + "beam"])

    def search(batches):
        for batch in batches:
            for r in batch.to_pylist():
                own = r["shard"] == r["q_shard"]
                nodes_a, times_a, a = shard(r, "q_")
                nodes_b, times_b, b = (nodes_a, times_a, a) if own else shard(r, "")
                kept, count_a, count_b = _reduced(_linked(a, b, threshold, own), times_a, times_b, own)
                counts = [(nodes_a, count_a)] if own else [(nodes_a, count_a), (nodes_b, count_b)]
                some = [(n[c > 0], c[c > 0]) for n, c in counts]
                ends = np.concatenate([n for n, _ in some]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*[int(nodes_a[i]) for i, _ in kept], *ends], pa.int64()),
                        pa.array([*[int(nodes_b[j]) for _, j in kept], *[None] * len(ends)], pa.int64()),
                        pa.array([*[None] * len(kept), *np.concatenate([c for _, c in some]).tolist()], pa.int64()),
                    ],
                    ["a", "b", "n"],
                )

    # Each pair of shards once.
    each = F.explode(F.sequence(F.col("shard"), F.col("shards") - 1))
    sides = ["nodes", "times", "vectors", "beam", "bottom", "upper"]
    asking = blocks.select(
        "label", "dim", each.alias("shard"), F.col("shard").alias("q_shard"),
        *[F.col(c).alias(f"q_{c}") for c in sides],
    )
    # Few rows, much work each: dealt by key to as many tasks as the session has.
    tasks = max(2, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    joined = asking.join(blocks.drop("shards"), ["label", "dim", "shard"]).repartition(
        tasks, "label", "dim", "shard", "q_shard"
    )
    return map_batches(joined, search, "a bigint, b bigint, n bigint")


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    shard_rows: int = SHARD_ROWS,
    beam: int = BEAM,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """Add ``n_links``, ``component_id`` and ``kept`` to every row, without its vector.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id
    reachable, and ``kept`` marks the row that has it.
    """
    v, own = named(vector_column), named(id_column).cast("bigint")
    kept = others(vectors, [vector_column, "n_links", "component_id", "kept"])
    fit = usable(v) & F.exists(v, lambda x: x != 0) & named(label_column).isNotNull() & own.isNotNull()
    doubles = F.when(fit, F.transform(v, lambda x: x.cast("double")))
    rows = checkpointed(vectors.select(
        *kept, own.alias("__vintry_id"), named(label_column).cast("string").alias("__vintry_label"),
        doubles.alias("__vintry_v"),
    ))
    # Equal vectors of a label are one node, named by their smallest id.
    nodes = checkpointed(
        rows.where(F.col("__vintry_v").isNotNull())
        .groupBy(F.col("__vintry_label").alias("label"), F.col("__vintry_v").alias("v"))
        .agg(F.min("__vintry_id").alias("node"), F.count("*").alias("times"))
        .withColumn("dim", F.size("v"))
    )
    # Ids may repeat with other vectors or labels, so nodes are numbered apart from them.
    nodes = checkpointed(
        nodes.withColumn("lowest", F.col("node")).withColumn("node", F.monotonically_increasing_id())
    )
    blocks = checkpointed(_built(nodes, shard_rows, threshold, beam))
    found = checkpointed(_found(blocks, threshold))
    linked = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    reached = components(found.where("b is not null"), "a", "b")
    members = (
        nodes.join(linked, "node", "left").join(reached, "node", "left")
        .select("label", "v", "lowest", "times", F.coalesce("n", F.lit(0)).alias("n"),
                F.coalesce("component", "node").alias("component"))
    )
    lowest = members.groupBy("component").agg(F.min("lowest").alias("component_id"))
    named_nodes = members.join(lowest, "component").select(
        F.col("label").alias("__vintry_label"), F.col("v").alias("__vintry_v"),
        (F.col("n") + F.col("times") - 1).alias("n_links"), "component_id",
    )
    joined = rows.join(named_nodes, ["__vintry_label", "__vintry_v"], "left")
    component = F.coalesce("component_id", "__vintry_id")
    return joined.select(
        *kept,
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("__vintry_id"), F.lit(False)).alias("kept"),
    )
