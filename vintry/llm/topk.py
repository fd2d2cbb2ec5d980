"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, in blocks. A first pass counts the scores
of each query in equal bins over the range they can have; adding up the counts over all
blocks shows the bin that holds the k-th highest. Further passes split that bin until it
holds one score: the k-th, exactly. A last pass keeps what scores above it, and of the
ties just as many, by smallest id, as are missing.

A block only reports the bins that hold its own k highest scores of a query, since lower
ones cannot hold the k-th of all; likewise of ties only the smallest ids. So what leaves a
block is bounded by k per query, without leaving anything out.

Scores are integer inner products of vectors turned into floor(scale * x). Defined
results: vectors or ids that are null, and vectors with null or non-finite components,
take no part; only vectors of the same length are compared; candidates sharing the query's
id are its own row and left out; repeated query rows count once (the vector that sorts
first); repeated candidate rows count each; with fewer than k candidates all are returned;
an empty table gives no rows; vectors whose products might exceed 62 bits are refused.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintry.llm.columns import checkpointed, map_batches, named

K = 20
SCALE = 64
BINS = 1024
# Vectors in a block of queries or candidates.
QUERY_BLOCK = 2048
BLOCK = 8192


def usable(vector: Column) -> Column:
    """No null and no non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _integers(df: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    rows = df.where(named(id_column).isNotNull() & usable(named(vector_column)))
    floors = F.transform(named(vector_column), lambda x: F.floor(x.cast("double") * scale))
    return rows.select(named(id_column).cast("bigint").alias("id"), floors.alias("v")).select(
        "*", F.size("v").alias("dim")
    )


def _packed(rows: DataFrame, block: int) -> DataFrame:
    """Rows of each task in blocks of one dimension: ids and components as bytes."""

    def pack(batches):
        held: dict[int, list] = {}

        def row(dim):
            ids, vectors = zip(*held.pop(dim))
            return pa.RecordBatch.from_pylist([{
                "dim": dim, "ids": np.array(ids, np.int64).tobytes(),
                "vectors": np.array(vectors, np.int64).reshape(len(ids), dim).tobytes(),
            }], _BLOCK_SCHEMA)

        for batch in batches:
            flat = batch.column(1)
            vectors = flat.to_pylist()
            for i, v in zip(batch.column(0).to_pylist(), vectors):
                some = held.setdefault(len(v), [])
                some.append((i, v))
                if len(some) == block:
                    yield row(len(v))
        for dim in list(held):
            yield row(dim)

    return map_batches(rows.select("id", "v"), pack, "dim int, ids binary, vectors binary")


_BLOCK_SCHEMA = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])


def _products(candidates: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products, queries by candidates; floats where those are exact."""
    most = [int(max(abs(int(x.max())), abs(int(x.min())))) if x.size else 0 for x in (candidates, queries)]
    if candidates.shape[1] * most[0] * most[1] < 2**53:
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    return queries @ candidates.T


def _scored(batches, report):
    """Read joined blocks and hand (query ids, candidate ids, scores, state) to ``report``."""
    for batch in batches:
        for row in batch.to_pylist():
            dim = row["dim"]
            ids = np.frombuffer(row["ids"], np.int64)
            queries = np.frombuffer(row["q_ids"], np.int64)
            candidates = np.frombuffer(row["vectors"], np.int64).reshape(len(ids), dim)
            vectors = np.frombuffer(row["q_vectors"], np.int64).reshape(len(queries), dim)
            state = [np.frombuffer(row[c], np.int64) for c in ("low", "width", "span", "need")]
            step = 128
            for at in range(0, len(queries), step):
                part = slice(at, at + step)
                found = report(
                    queries[part], ids, _products(candidates, vectors[part]), [s[part] for s in state]
                )
                if found is not None:
                    yield found


def _joined(queries: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Every block of candidates with every block of queries of its dimension."""

    def pack(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                held.setdefault((r["block"], r["dim"]), []).append(r)
        for (number, dim), rows in held.items():
            rows.sort(key=lambda r: r["id"])
            columns = {"q_block": [number], "dim": [dim]}
            columns["q_ids"] = [np.array([r["id"] for r in rows], np.int64).tobytes()]
            columns["q_vectors"] = [np.array([r["v"] for r in rows], np.int64).tobytes()]
            for c in ("low", "width", "span", "need"):
                columns[c] = [np.array([r[c] for r in rows], np.int64).tobytes()]
            yield pa.RecordBatch.from_pydict(columns, _QUERY_SCHEMA)

    tasks = max(n_blocks, 1)
    dealt = queries.select("block", "dim", "id", "v", "low", "width", "span", "need").repartition(tasks, "block")
    packed = map_batches(dealt, pack, (
        "q_block int, dim int, q_ids binary, q_vectors binary, low binary, width binary, span binary, need binary"
    ))
    many = blocks.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(max(n_blocks, 1) - 1))))
    return many.join(packed, ["q_block", "dim"]).repartition(
        max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    )


_QUERY_SCHEMA = pa.schema(
    [("q_block", pa.int32()), ("dim", pa.int32())]
    + [(c, pa.binary()) for c in ("q_ids", "q_vectors", "low", "width", "span", "need")]
)


def _histogram(joined: DataFrame, k: int) -> DataFrame:
    """(id, bin, n): counts per query and bin, the bins of the block's k highest scores."""

    def report(queries, ids, scores, state):
        low, width, span, _ = state
        own = ids[None, :] == queries[:, None]
        over = scores - low[:, None]
        bins = over // width[:, None]
        # Scores above the range are settled already; those below it cannot matter.
        bins[own | (over < 0) | (over >= span[:, None])] = -1
        highest = min(k, bins.shape[1])
        top = np.partition(bins, bins.shape[1] - highest, axis=1)[:, -highest:].min(axis=1)
        rows, columns = np.nonzero((bins >= top[:, None]) & (bins >= 0))
        if not len(rows):
            return None
        key, n = np.unique(rows * BINS + bins[rows, columns], return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(queries[key // BINS]), pa.array((key % BINS).astype(np.int32)), pa.array(n)],
            ["id", "bin", "n"],
        )

    counts = map_batches(
        joined, lambda batches: _scored(batches, report), "id bigint, bin int, n bigint"
    )
    return counts.groupBy("id", "bin").agg(F.sum("n").alias("n"))


def _refined(queries: DataFrame, counts: DataFrame) -> DataFrame:
    """Queries with the bin of their k-th score as the new range, and what is still needed.

    ``need`` counts the rank within the range. Where a query has too few scores, its range
    stays below all of them, and everything is kept in the end.
    """
    down = Window.partitionBy("id").orderBy(F.col("bin").desc())
    reached = counts.withColumn("above", F.sum("n").over(down) - F.col("n"))
    reached = reached.join(queries.select("id", "need"), "id")
    chosen = reached.where((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need")))
    chosen = chosen.select("id", "bin", "above")
    narrower = F.greatest(F.lit(1), F.ceil(F.col("width") / BINS)).cast("bigint")
    return queries.join(chosen, "id", "left").select(
        "block", "dim", "id", "v",
        F.when(F.col("bin").isNull(), F.col("low"))
        .otherwise(F.col("low") + F.col("bin") * F.col("width")).alias("low"),
        F.when(F.col("bin").isNull(), F.col("width")).otherwise(narrower).alias("width"),
        F.when(F.col("bin").isNull(), F.col("span")).otherwise(F.col("width")).alias("span"),
        (F.col("need") - F.coalesce("above", F.lit(0))).alias("need"),
    )


def _selected(joined: DataFrame) -> DataFrame:
    """(query_id, vec_id, score): above the k-th score all, at it the smallest ids."""

    def report(queries, ids, scores, state):
        low, _, _, need = state
        scores = scores.copy()
        own = ids[None, :] == queries[:, None]
        over = (scores > low[:, None]) & ~own
        ties = (scores == low[:, None]) & ~own
        for q in np.flatnonzero(ties.sum(axis=1) > need):
            at = np.flatnonzero(ties[q])
            ties[q, at[np.argsort(ids[at], kind="stable")[int(need[q]):]]] = False
        rows, columns = np.nonzero(over | ties)
        return pa.RecordBatch.from_arrays(
            [pa.array(queries[rows]), pa.array(ids[columns]), pa.array(scores[rows, columns])],
            ["query_id", "vec_id", "score"],
        )

    return map_batches(
        joined, lambda batches: _scored(batches, report), "query_id bigint, vec_id bigint, score bigint"
    )


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    scale: int = SCALE,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best among ``vectors``."""
    own = _integers(queries, id_column, vector_column, scale)
    own = checkpointed(own.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    rows = _integers(vectors, id_column, vector_column, scale)
    largest = F.coalesce(F.max(F.greatest(F.array_max("v"), -F.array_min("v"))), F.lit(0))
    bound, n = own.agg(largest, F.count("*")).first()
    other, dim = rows.agg(largest, F.coalesce(F.max("dim"), F.lit(0))).first()
    reach = bound * other * dim
    if reach >= 2**62:
        raise ValueError("inner products may exceed 62 bits; use a smaller scale")
    n_blocks = max(1, ceil(n / QUERY_BLOCK))
    width = max(1, -(-(2 * reach + 1) // BINS))
    blocks = checkpointed(_packed(rows, BLOCK))
    state = own.select(
        F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"), "dim", "id", "v",
        F.lit(-reach).cast("bigint").alias("low"), F.lit(width).cast("bigint").alias("width"),
        F.lit(width * BINS).cast("bigint").alias("span"), F.lit(k).cast("bigint").alias("need"),
    )
    while True:
        counts = _histogram(_joined(state, blocks, n_blocks), k)
        state = checkpointed(_refined(state, counts))
        if width == 1:
            break
        width = max(1, -(-width // BINS))
    # The k-th score is now ``low``: its bin has width 1. With too few scores ``low`` is
    # below all of them.
    kept = _selected(_joined(state, blocks, n_blocks))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
