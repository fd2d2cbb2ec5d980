"""Packing by power-of-two decomposition.

A document's ids, closed by an end id, are cut at the powers of two of their number's
binary digits: full windows first, then one piece for each set bit, longest first. Every
piece is a sequence of its own in the bucket of its length, so sequences never mix
documents and need no padding; a training job draws batches bucket by bucket.

Defined results: a null text counts as empty (one piece holding the end id); repeated rows
are packed each for itself; a null id column is carried as it is; an empty table gives no
rows. Every stage is one pass without a shuffle, so nothing is ever gathered.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintry.llm.columns import append, named
from vintry.llm.words import word_encoder

WINDOW = 4096
END_ID = 2

_PIECES = "__vintry_pieces"


def binary_lengths(total: int, window: int = WINDOW) -> list[int]:
    """Whole windows, then the set bits of the rest from the highest to the lowest."""
    rest = total % window
    bits = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return [window] * (total // window) + bits


def _cut(ids: np.ndarray, window: int, with_ids: bool) -> list[dict]:
    packed = ids.astype("<u4").tobytes()
    pieces, start = [], 0
    for length in binary_lengths(len(ids), window):
        own = packed[4 * start : 4 * (start + length)]
        piece = {"start": start, "length": length, "crc": zlib.crc32(own)}
        if with_ids:
            piece["ids"] = np.frombuffer(own, "<u4").astype(np.int32)
        pieces.append(piece)
        start += length
    return pieces


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    with_ids: bool = True,
    text_column: str = "text",
) -> DataFrame:
    """One row per piece, with the columns of ``docs`` but its text.

    Adds ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``
    (always 0), ``bucket`` (the binary logarithm of the length) and, unless ``with_ids``
    is off, ``ids``. Columns of these names are replaced. Write the result partitioned by
    ``bucket`` to get one folder of equal sequences per length.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    fields = [("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if with_ids else []
    piece = pa.struct(fields)

    def cut(texts: pa.Array) -> pa.Array:
        encoder = word_encoder(tokenizer_path)
        pieces, totals = [], []
        for ids in encoder.encode_batch(texts.to_pylist()):
            ids = np.append(ids, np.uint32(end_id))
            totals.append(len(ids))
            pieces.append(_cut(ids, window, with_ids))
        return pa.StructArray.from_arrays(
            [pa.array(totals, pa.int64()), pa.array(pieces, pa.list_(piece))],
            ["doc_tokens", _PIECES],
        )

    inner = "start: bigint, length: bigint, crc: bigint" + (", ids: array<int>" if with_ids else "")
    cut_up = append(docs, cut, [text_column], f"doc_tokens bigint, {_PIECES} array<struct<{inner}>>")
    made = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "ids"]
    dropped = {*made, _PIECES, text_column.lower()}
    kept = [c for c in cut_up.columns if c.lower() not in dropped]
    one = cut_up.select(*[named(c) for c in kept], "doc_tokens", F.explode(_PIECES).alias(_PIECES))
    p = F.col(_PIECES)
    return one.select(
        *[named(c) for c in kept],
        p["start"].alias("start"),
        p["length"].alias("length"),
        p["crc"].alias("ids_crc32"),
        "doc_tokens",
        # Unique without a shuffle; the scan deals rows to partitions alike on a retry.
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
        F.round(F.log2(p["length"])).cast("int").alias("bucket"),
        *([p["ids"].alias("ids")] if with_ids else []),
    )
