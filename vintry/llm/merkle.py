"""Merkle manifest of a dataset: checkpointed levels, proofs from recomputed subtrees.

Every row is a leaf: the digest of its fields, each with its length. Leaves of one language
form a binary tree in the order of their ids; the trees' roots, in the order of languages,
form one tree above them. A lone last node of a level is hashed alone.

Only every ``every``-th level is written. One block is the aligned subtree of 2^every nodes
of a written level: one group, bounded whatever the size of a language, gives one node of
the next written level. A proof asks each block on its way up: the block's levels are built
again from its written nodes, the siblings are taken, and the levels are dropped. The number
of passes is the number of written levels, log(rows) / every.

Defined results: nulls are hashed as ``-``; a null id comes first, and its row is never
tampered with; a null language has its own tree, the first; rows that share id and language
are ordered by their leaf, and rows alike in all fields take neighbouring places; empty and
long texts are hashed whole; an empty table gives no rows; other columns are ignored. A tree
of one leaf has that leaf as its root and nothing to prove.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintry.llm.columns import named, stored
from vintry.llm.positions import positions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
EVERY = 8

_NODES = "array<string>"


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of fields, each as byte count, colon and value, or ``-`` where null."""
    texts = [field.cast("string") for field in fields]
    framed = [
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
        for t in texts
    ]
    return F.sha2(F.concat(*framed), 256)


def _node(children: Column, i: Column) -> Column:
    pair = F.concat(F.get(children, 2 * i), F.coalesce(F.get(children, 2 * i + 1), F.lit("")))
    return F.sha2(pair, 256)


def _parents(children: Column) -> Column:
    last = F.ceil(F.size(children) / 2).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: _node(children, i))


def _depth(nodes: Column) -> Column:
    """Levels above ``nodes`` nodes until one is left."""
    return F.when(nodes > 1, F.length(F.bin(nodes - 1))).otherwise(0).cast("int")


def _levels(nodes: Column, steps: Column) -> Column:
    """The block's nodes and ``steps`` levels above them, lowest first."""
    counted = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        counted,
        F.array(nodes).cast(f"array<{_NODES}>"),
        lambda levels, _: F.concat(levels, F.array(_parents(F.element_at(levels, -1)))),
    )


def _siblings(levels: Column, place: Column) -> Column:
    """(left, sibling) from the place of a node in its block up to below the block's top."""
    steps = F.size(levels) - 1
    counted = F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(
        F.array().cast("array<int>")
    )

    def one(level: Column) -> Column:
        at = F.call_function("shiftright", place, level)
        return F.struct(
            (at % 2 == 1).alias("left"),
            F.get(F.get(levels, level), at.bitwiseXOR(F.lit(1))).alias("sibling"),
        )

    return F.transform(counted, one)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def step(node: Column, side: Column) -> Column:
        sibling = F.coalesce(side["sibling"], F.lit(""))
        pair = F.when(side["left"], F.concat(sibling, node)).otherwise(F.concat(node, sibling))
        return F.sha2(pair, 256)

    return F.aggregate(proof, leaf, step)


def _blocks(level: DataFrame, every: int, *carried: str) -> DataFrame:
    """One row per block: (tree, block, nodes, levels, items in order)."""
    item = F.struct("position", "node", *carried)
    grouped = level.groupBy(
        "tree", F.shiftright("position", every).alias("block"), F.col("group_rows")
    ).agg(F.array_sort(F.collect_list(item)).alias("items"))
    steps = F.least(F.lit(every), _depth(F.col("group_rows")))
    return grouped.withColumn("levels", _levels(F.col("items.node"), steps))


def _above(level: DataFrame, every: int) -> DataFrame:
    """The next written level: one node per block."""
    rows = F.ceil(F.col("group_rows") / (1 << every)).cast("bigint")
    return _blocks(level, every).select(
        "tree", F.col("block").alias("position"), rows.alias("group_rows"),
        F.get(F.element_at("levels", -1), F.lit(0)).alias("node"),
    )


@dataclasses.dataclass(frozen=True)
class Tree:
    """Written levels of a forest, lowest first; the last one holds each tree's root.

    Levels are (tree, position, group_rows, node), where ``group_rows`` is the number of the
    tree's nodes on that level.
    """

    levels: list[DataFrame]
    every: int

    @property
    def roots(self) -> DataFrame:
        return self.levels[-1].select("tree", F.col("node").alias("root"))

    def above(self, beyond: DataFrame) -> DataFrame:
        """(tree, block, path): what lies above each block of the lowest level.

        ``beyond`` is (tree, path): the path above each root.
        """
        upper = self.levels[-1].join(beyond, "tree").select(
            "tree", F.col("position").alias("block"), "path"
        )
        for level in reversed(self.levels[1:-1]):
            blocks = _blocks(level, self.every).join(upper, ["tree", "block"])
            upper = blocks.select("tree", "levels", "path", F.explode("items.position").alias("at")).select(
                "tree", F.col("at").alias("block"),
                F.concat(
                    _siblings(F.col("levels"), (F.col("at") % (1 << self.every)).cast("int")), "path"
                ).alias("path"),
            )
        return upper

    def proofs(self, beyond: DataFrame, *carried: str) -> DataFrame:
        """One row per leaf: (tree, position, node, carried columns, proof)."""
        blocks = _blocks(self.levels[0], self.every, *carried).join(
            self.above(beyond), ["tree", "block"]
        )
        rows = blocks.select("tree", "levels", "path", F.explode("items").alias("item"))
        place = (F.col("item.position") % (1 << self.every)).cast("int")
        return rows.select(
            "tree", *[F.col("item")[c].alias(c) for c in ("position", "node", *carried)],
            F.concat(_siblings(F.col("levels"), place), "path").alias("proof"),
        )


def build(leaves: DataFrame, order: list[str], every: int = EVERY) -> Tree:
    """Trees over (tree, node, ...): the leaves of each in the order of ``order``.

    There is always a level above the leaves, so that trees of one leaf have a root there.
    """
    level = stored(positions(leaves, ["tree"], order))
    most = level.agg(F.max("group_rows")).first()[0] or 1
    levels = [level]
    while True:
        level = stored(_above(level, every))
        levels.append(level)
        most = -(-most // (1 << every))
        if most <= 1:
            return Tree(levels, every)


def manifest(
    documents: DataFrame, claimed: dict[str, Column] | None = None, every: int = EVERY
) -> DataFrame:
    """Each row's leaf, roots, proof, and what the row as it is claimed now leads to.

    Returns (doc_id, lang, leaf, subroot, root, proof, claimed_root). ``proof`` lists the
    siblings from the leaf to the root; ``claimed`` gives fields new values (none: the rows
    as they are), whose leaf is folded through the original siblings.
    """
    own = documents.select(*[named(c).alias(c) for c in FIELDS])
    fields = {c: F.col(c) for c in FIELDS}
    leaves = own.select(
        "doc_id", "lang",
        # Never null, and ordered as languages are, null first.
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"),
        leaf_digest(list(fields.values())).alias("node"),
        leaf_digest(list({**fields, **(claimed or {})}.values())).alias("claim"),
    )
    trees = build(leaves, ["doc_id", "node"], every)
    tops = trees.roots.select(
        F.lit("").alias("tree"), F.col("root").alias("node"), F.col("tree").alias("below")
    )
    top = build(tops, ["below"], every)
    nothing = top.roots.select("tree", F.array().cast("array<struct<left:boolean,sibling:string>>").alias("path"))
    upper = stored(
        top.proofs(nothing, "below").join(top.roots, "tree").select(
            F.col("below").alias("tree"), F.col("node").alias("subroot"), "root",
            F.col("proof").alias("path"),
        )
    )
    # The roots go down with the path, in a first entry of it, never by a join on a language.
    marked = upper.select(
        "tree", F.concat("path", F.array(
            F.struct(F.lit(None).cast("boolean").alias("left"), F.col("subroot").alias("sibling")),
            F.struct(F.lit(None).cast("boolean").alias("left"), F.col("root").alias("sibling")),
        )).alias("path"),
    )
    rows = trees.proofs(marked, "doc_id", "lang", "claim")
    proof = F.slice("proof", F.lit(1), F.size("proof") - 2)
    return rows.select(
        "doc_id", "lang", F.col("node").alias("leaf"),
        F.element_at("proof", -2)["sibling"].alias("subroot"),
        F.element_at("proof", -1)["sibling"].alias("root"),
        proof.alias("proof"),
        fold(F.col("claim"), proof).alias("claimed_root"),
    )
