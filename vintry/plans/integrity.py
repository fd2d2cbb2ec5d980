"""Integrity of the archive: a two-level digest tree per bucket, checked where it is due.

A run that archives bodies records a leaf per file it wrote: its length, its time, and the
digest of the bodies' own digests. A bucket's root is the digest of its leaves. A check lists
files (no content is read), computes each bucket's root again from lengths, times and the
recorded digests, and hashes bodies only in buckets whose root differs, or whose turn it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintry import schemas
from vintry.schemas import optional, required
from vintry.sources.store import Store, read_if_present

LEAVES = T.StructType([
    required("cik_bucket", T.IntegerType()),
    required("file", T.StringType()),
    required("length", T.LongType()),
    required("modified", T.TimestampType()),
    required("bodies", T.LongType()),
    required("digest", T.StringType()),
])
FOUND = T.StructType([
    required("cik_bucket", T.IntegerType()), required("file", T.StringType()),
    optional("source_sha", T.StringType()), required("problem", T.StringType()),
])
_PLACE = r"(cik_bucket=\d+/run_id=[^/]+/[^/]+)$"


def _digest_of(shas: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(shas)), ""), 256)


def record_leaves(store: Store, own: DataFrame, run_id: str) -> None:
    """Keep the leaves of what one run archived. Digests only: no body is read."""
    place = F.regexp_extract(F.col("_metadata.file_path"), _PLACE, 1)
    leaves = own.select(
        store.bucket(F.col("cik")).alias("cik_bucket"), place.alias("file"),
        F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_modification_time").alias("modified"), "source_sha",
    ).groupBy("cik_bucket", "file", "length", "modified").agg(
        F.count("*").alias("bodies"), _digest_of(F.col("source_sha")).alias("digest")
    )
    leaves.coalesce(1).write.mode("overwrite").parquet(store.path("leaves", f"run_id={run_id}"))


def recorded_leaves(store: Store, spark: SparkSession) -> DataFrame:
    return read_if_present(spark, store.path("leaves"), LEAVES, "parquet").select(*LEAVES.names)


def present_files(store: Store, spark: SparkSession) -> DataFrame:
    """(cik_bucket, file, length, modified) of the archive, from listings alone."""
    held = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet").load(store.path("bronze"))
    )
    place = F.regexp_extract("path", _PLACE, 1)
    return held.select(
        F.regexp_extract(place, r"cik_bucket=(\d+)", 1).cast("int").alias("cik_bucket"),
        place.alias("file"), "length", F.col("modificationTime").alias("modified"),
    )


def bucket_roots(files: DataFrame) -> DataFrame:
    """(cik_bucket, root): one digest of all leaves, in the order of file names."""
    leaf = F.concat_ws("|", "file", "length", F.unix_micros("modified"), F.coalesce("digest", F.lit("-")))
    return files.groupBy("cik_bucket").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(leaf)), "\n"), 256).alias("root")
    )


def suspect_buckets(store: Store, spark: SparkSession) -> list[int]:
    """Buckets whose files are not those that were recorded. At most ``store.buckets``."""
    leaves = recorded_leaves(store, spark)
    known = leaves.select("file", "digest")
    now = bucket_roots(present_files(store, spark).join(known, "file", "left"))
    then = bucket_roots(leaves).withColumnRenamed("root", "recorded")
    differ = then.join(now, "cik_bucket", "full").where(~F.col("root").eqNullSafe(F.col("recorded")))
    return sorted(r["cik_bucket"] for r in differ.select("cik_bucket").collect())


def hashed_again(store: Store, spark: SparkSession, buckets: list[int]) -> DataFrame:
    """What is wrong in some buckets: every body of theirs is read and hashed."""
    leaves = recorded_leaves(store, spark).where(F.col("cik_bucket").isin(buckets))
    bodies = store.bronze(spark, buckets).select(
        "cik_bucket", F.regexp_extract(F.col("_metadata.file_path"), _PLACE, 1).alias("file"),
        "source_sha", (F.sha2("content", 256) == F.col("source_sha")).alias("intact"),
    )
    broken = bodies.where(~F.col("intact")).select(
        "cik_bucket", "file", "source_sha", F.lit("body_changed").alias("problem")
    )
    held = bodies.groupBy("file").agg(_digest_of(F.col("source_sha")).alias("now"))
    other = leaves.join(held, "file", "left").where(~F.col("now").eqNullSafe(F.col("digest"))).select(
        "cik_bucket", "file", F.lit(None).cast("string").alias("source_sha"),
        F.when(F.col("now").isNull(), F.lit("file_missing")).otherwise(F.lit("bodies_exchanged")).alias("problem"),
    )
    unknown = bodies.select("cik_bucket", "file").distinct().join(leaves.select("file"), "file", "left_anti")
    return broken.unionByName(other).unionByName(unknown.select(
        "cik_bucket", "file", F.lit(None).cast("string").alias("source_sha"),
        F.lit("file_not_recorded").alias("problem"),
    ))


def verify_archive(store: Store, spark: SparkSession, turn: int = 0, turns: int = 1) -> DataFrame:
    """Problems of the archive: (cik_bucket, file, source_sha, problem).

    Buckets whose root differs are hashed, and every ``turns``-th bucket in turn, so that
    each is hashed once in ``turns`` checks. With ``turns=1`` all are; 0 hashes only suspects.
    """
    if turns < 0 or (turns and not 0 <= turn < turns):
        raise ValueError("turn must be one of the turns")
    due = [b for b in range(store.buckets) if turns and b % turns == turn]
    buckets = sorted({*suspect_buckets(store, spark), *due})
    if not buckets:
        return spark.createDataFrame([], FOUND)
    return hashed_again(store, spark, buckets)
