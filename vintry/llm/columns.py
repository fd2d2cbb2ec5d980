"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import vintry
from vintry.session import ensure_checkpoint_dir

_HIDDEN = "__vintry_computed"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application, by Spark's own means."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(vintry.__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="vintry-code-"), "vintry-code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(top.rglob("*.py")):
            archive.write(source, source.relative_to(top.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def named(name: str) -> Column:
    """A column by its exact name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, taken: list[str]) -> list[Column]:
    """All columns but those whose name (case does not count) is about to be written."""
    lowered = {name.lower() for name in taken}
    return [named(c) for c in df.columns if c.lower() not in lowered]


def append(df: DataFrame, function: Callable, inputs: list[str], schema: str) -> DataFrame:
    """Append the columns of ``schema``, computed batch by batch from Arrow arrays.

    ``function`` takes one Arrow array per input and returns a struct array. Columns of
    the same name are replaced; all others stay in the JVM and are not copied to Python.
    """
    ship(df.sparkSession)
    returned = T.StructType.fromDDL(schema)
    # Nondeterministic, so that no later filter makes Spark compute it twice.
    computed = F.arrow_udf(function, returned).asNondeterministic()
    return df.select("*", computed(*[named(c) for c in inputs]).alias(_HIDDEN)).select(
        *others(df, returned.names),
        *[F.col(_HIDDEN)[f.name].alias(f.name) for f in returned],
    )


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like ``checkpointed``, as a Parquet table, so that later reads take only their columns."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/vintry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(texts: list[str], characters: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts holding about ``characters``, one text at least."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if i > first and held + len(text) > characters:
            yield first, i
            first, held = i, 0
        held += len(text)
    if texts:
        yield first, len(texts)
