"""Labelled documents for training: a bounded sample that is the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintry.llm.columns import named


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a document is kept from all learning; false for a null id."""
    remainder = F.crc32(named(id_column).cast("string")) % 3
    return F.coalesce(remainder == 1, F.lit(False))


def usable_labels(labels: DataFrame, label: str, id_column: str = "doc_id") -> DataFrame:
    """(id, y) of labels open to learning. Ids whose rows disagree are left out, repeated
    rows count once, and so do only labels 0 and 1."""
    open_ = labels.where(named(id_column).isNotNull() & named(label).isin(0, 1) & ~held_out(id_column))
    return (
        open_.groupBy(named(id_column).alias("__id"))
        .agg(F.min(named(label)).alias("y"), F.max(named(label)).alias("most"))
        .where("y = most").select("__id", F.col("y").cast("int").alias("y"))
    )


def class_counts(usable: DataFrame) -> tuple[int, int]:
    """How many usable labels are 0, and how many 1."""
    found = {row["y"]: row["n"] for row in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    return found.get(0, 0), found.get(1, 0)


def labelled_sample(
    docs: DataFrame, usable: DataFrame, per_class: int, id_column: str, text_column: str
) -> DataFrame:
    """(id, y, text): up to ``per_class`` documents of each class, in the order of a hash.

    At most twice ``per_class`` ids are broadcast. Of repeated ids one text is taken.
    """
    order = [F.xxhash64("__id"), F.col("__id")]
    chosen = usable.where("y = 0").orderBy(*order).limit(per_class).unionByName(
        usable.where("y = 1").orderBy(*order).limit(per_class)
    )
    texts = docs.select(named(id_column).alias("__id"), named(text_column).alias("text"))
    return texts.join(F.broadcast(chosen), "__id").groupBy("__id", "y").agg(F.min("text").alias("text"))
