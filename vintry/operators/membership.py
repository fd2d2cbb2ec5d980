"""Blocked Bloom filters over stored keys, as tables that Spark builds and asks.

A filter is cut into blocks of 32,768 bits, one row each; a key sets ``HASHES`` bits of one
block. Asking is one equi-join on (part, block): a few bytes a stored key are read instead
of the key. A filter never denies a key that it holds; of others it lets through about one
in twenty thousand, so what it lets through has to be looked up.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: how many bits one bitmap of Spark's aggregate holds.
BLOCK_BITS = 32_768
BITS_PER_KEY = 24
HASHES = 8


def blocks_for(rows: int) -> int:
    """Blocks of a filter over so many keys."""
    return max(1, math.ceil(rows * BITS_PER_KEY / BLOCK_BITS))


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks)


def _mixed(key: Column) -> Column:
    """The hash that a key's bits are made of."""
    return F.xxhash64(key, F.lit(1))


def _bits(mixed: Column) -> list[Column]:
    """The key's bits in its block: two halves of one hash, stepped through."""
    low = mixed.bitwiseAND(F.lit(0x7FFFFFFF))
    step = F.shiftrightunsigned(mixed, 33).bitwiseOR(F.lit(1))
    return [F.pmod(low + step * i, F.lit(BLOCK_BITS)) for i in range(HASHES)]


def bloom_blocks(keys: DataFrame, part: list[str], key: str, blocks: str) -> DataFrame:
    """(part columns, block, bits) of one filter per part; ``blocks`` is a column of ``keys``.

    Hashes are dealt out by block before they become bits: every task would else send a whole
    bitmap for each block it meets, which is nearly all of them.
    """
    placed = keys.select(
        *part, _block(F.col(key), F.col(blocks)).alias("block"), _mixed(F.col(key)).alias("mixed")
    ).repartition(*part, "block")
    bits = placed.select(*part, "block", F.explode(F.array(*_bits(F.col("mixed")))).alias("bit"))
    return bits.groupBy(*part, "block").agg(F.bitmap_construct_agg(F.col("bit")).alias("bits"))


def _holds(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def maybe_held(
    keys: DataFrame, parts: DataFrame, filters: DataFrame, by: list[str], part: list[str], key: str
) -> DataFrame:
    """(part columns, key): the keys that some filter does not deny.

    ``parts`` lists the filters, with ``by`` to meet the keys, and their number of ``blocks``.
    """
    asked = keys.select(*by, key).join(F.broadcast(parts), by).withColumn(
        "block", _block(F.col(key), F.col("blocks"))
    )
    met = asked.join(filters, [*part, "block"])
    held = [_holds(F.col("bits"), bit) for bit in _bits(_mixed(F.col(key)))]
    return met.where(reduce(Column.__and__, held)).select(*part, key)
