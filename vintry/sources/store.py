"""Folder layout of one lake, and the generations by which readers find its parts.

Data is only ever added. A job writes pieces, ``<table>/run_id=<run>/cik_bucket=<bucket>``,
and a release names one *generation*: the list of pieces that make up every table. Jobs and
compactions replace pieces of the buckets they touch in a new generation; the others are
named again, not written again. Readers of an older generation keep what they had.

Manifests are numbered. The next number can be created once only, so of two writers that
began from one release exactly one commits. A manifest has the same size after any number of
runs; a generation grows with the buckets and, by compaction, the logarithm of the facts.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterable
from datetime import date, datetime
from functools import cached_property
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintry import schemas
from vintry.schemas import BUCKET, RUN, with_folders
from vintry.sources import commit

MARTS = ("dim_issuer", "canonical_facts", "annual_financials", "company_trends", "filing_revisions")
# Marts whose rows name the cutoff of their release; it is kept in the manifest only.
DATED_MARTS = ("annual_financials", "company_trends")


def read_if_present(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    """A stored table, or an empty one of the same schema before its first write."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Piece(NamedTuple):
    """One bucket's rows of a table, as one run wrote them."""

    table: str
    bucket: int
    run_id: str
    rows: int

    @property
    def path(self) -> str:
        return f"{self.table}/run_id={self.run_id}/cik_bucket={self.bucket}"


@dataclasses.dataclass(frozen=True)
class Generation:
    """Which pieces make up every table. At most buckets times a few pieces per table."""

    pieces: tuple[Piece, ...] = ()

    def of(self, table: str, buckets: Iterable[int] | None = None) -> list[Piece]:
        wanted = None if buckets is None else set(buckets)
        return [p for p in self.pieces if p.table == table and (wanted is None or p.bucket in wanted)]

    def rows(self, table: str) -> int:
        return sum(p.rows for p in self.of(table))

    def added(self, pieces: Iterable[Piece]) -> "Generation":
        return Generation((*self.pieces, *pieces))

    def without(self, pieces: Iterable[Piece]) -> "Generation":
        gone = set(pieces)
        return Generation(tuple(p for p in self.pieces if p not in gone))

    def replaced(self, table: str, buckets: Iterable[int] | None, pieces: Iterable[Piece]) -> "Generation":
        """The table's pieces in ``buckets`` (all, if None) give way to ``pieces``."""
        return self.without(self.of(table, buckets)).added(pieces)

    def text(self) -> str:
        return "".join(json.dumps(list(p)) + "\n" for p in self.pieces)

    @classmethod
    def parsed(cls, text: str) -> "Generation":
        return cls(tuple(Piece(*json.loads(line)) for line in text.splitlines()))


@dataclasses.dataclass(frozen=True)
class Store:
    """One lake under ``root``; ``buckets`` bounds the folders per run, not the issuers."""

    root: str
    buckets: int = 256

    def path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    def bucket(self, cik: Column) -> Column:
        return F.pmod(F.xxhash64(cik), F.lit(self.buckets)).cast("int")

    # Pieces

    def write_bucketed(self, df: DataFrame, *parts: str) -> None:
        """Write by issuer bucket. Rebalancing splits a bucket that one issuer fills."""
        bucketed = df.withColumn("cik_bucket", self.bucket(F.col("cik")))
        (
            bucketed.hint("rebalance", F.col("cik_bucket"))
            .write.mode("overwrite").option("compression", "zstd")
            .partitionBy("cik_bucket").parquet(self.path(*parts))
        )

    def write_pieces(self, df: DataFrame, table: str, run_id: str) -> list[Piece]:
        """Write one run's rows of a table; the pieces written, with their rows counted."""
        self.write_bucketed(df, table, f"run_id={run_id}")
        spark = df.sparkSession
        if not any(n.startswith("cik_bucket=") for n in commit.names(spark, self.path(table, f"run_id={run_id}"))):
            return []
        # Counts come from the files' footers.
        written = spark.read.parquet(self.path(table, f"run_id={run_id}"))
        counts = written.groupBy("cik_bucket").agg(F.count("*").alias("n")).collect()
        return [Piece(table, r["cik_bucket"], run_id, r["n"]) for r in sorted(counts)]

    def read_pieces(self, spark: SparkSession, pieces: list[Piece], schema: T.StructType) -> DataFrame:
        """The rows of some pieces: only their folders are listed and read."""
        if not pieces:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[self.path(p.path) for p in pieces])

    def written(self, spark: SparkSession, schema: T.StructType, *parts: str) -> DataFrame:
        """What ``write_bucketed`` wrote, which may be no file at all."""
        return read_if_present(spark, self.path(*parts), with_folders(schema, BUCKET), "parquet")

    # Tables of a generation

    def facts(self, spark: SparkSession, generation: Generation, buckets: list[int] | None = None) -> DataFrame:
        return self.read_pieces(spark, generation.of("facts", buckets), schemas.FACTS)

    def snapshots(self, spark: SparkSession, generation: Generation, buckets: list[int] | None = None) -> DataFrame:
        return self.read_pieces(spark, generation.of("snapshots", buckets), schemas.SNAPSHOTS)

    def history(self, spark: SparkSession, generation: Generation, buckets: list[int] | None = None) -> DataFrame:
        return self.read_pieces(spark, generation.of("history", buckets), schemas.ISSUER_HISTORY)

    def mart(
        self, spark: SparkSession, generation: Generation, name: str, schema: T.StructType,
        buckets: list[int] | None = None,
    ) -> DataFrame:
        return self.read_pieces(spark, generation.of(f"marts/{name}", buckets), schema)

    def keep_mart_schemas(self, spark: SparkSession, version: str, marts: dict[str, T.StructType]) -> None:
        """Marts are read by the schemas of the models that wrote them, also where empty."""
        text = json.dumps({name: schema.jsonValue() for name, schema in marts.items()})
        commit.create_if_absent(spark, self.path("mart_schemas", f"{version}.json"), text)

    def mart_schemas(self, spark: SparkSession, version: str) -> dict[str, T.StructType]:
        held = json.loads(commit.read_text(spark, self.path("mart_schemas", f"{version}.json")))
        return {name: T.StructType.fromJson(schema) for name, schema in held.items()}

    # The archive of bodies: content-addressed, so it needs no generation

    def archive(self, bodies: DataFrame, run_id: str) -> None:
        """Append (cik, source_sha, content) to the archive."""
        (
            bodies.withColumn("cik_bucket", self.bucket(F.col("cik"))).withColumn("run_id", F.lit(run_id))
            .write.mode("append").option("compression", "zstd")
            .partitionBy("cik_bucket", "run_id").parquet(self.path("bronze"))
        )

    def archived_by(self, spark: SparkSession, run_id: str, buckets: list[int]) -> DataFrame:
        """What one run archived in some buckets; no other folder is listed or read."""
        folders = [
            path for b in buckets
            if commit.exists(spark, path := self.path("bronze", f"cik_bucket={b}", f"run_id={run_id}"))
        ]
        if not folders:
            return spark.createDataFrame([], schemas.BRONZE)
        return spark.read.schema(schemas.BRONZE).parquet(*folders)

    def bronze(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """Archived bodies; of ``buckets``, only their folders are listed and read."""
        schema = with_folders(schemas.BRONZE, BUCKET)
        if buckets is None:
            stored = read_if_present(spark, self.path("bronze"), with_folders(schema, RUN), "parquet")
            return stored.drop("run_id")
        folders = [
            path for b in buckets if commit.exists(spark, path := self.path("bronze", f"cik_bucket={b}"))
        ]
        if not folders:
            return spark.createDataFrame([], schema)
        reader = spark.read.schema(with_folders(schema, RUN)).option("basePath", self.path("bronze"))
        return reader.parquet(*folders).drop("run_id")

    def bronze_folder(self, cik: Column) -> Column:
        """The folder, below the store, that holds an issuer's archived bodies."""
        return F.concat(F.lit("bronze/cik_bucket="), self.bucket(cik).cast("string"))

    def archived_sources(self, spark: SparkSession, facts: DataFrame) -> DataFrame:
        """The archived body of each fact's source, and whether its digest still holds.

        Meant for the facts of a look-up: their issuers' buckets, at most ``buckets``
        numbers, prune the archive.
        """
        wanted = facts.select("fact_id", "cik", "source_sha")
        rows = wanted.select(self.bucket(F.col("cik")).alias("b")).distinct().collect()
        bodies = self.bronze(spark, [r["b"] for r in rows]).drop("cik_bucket")
        found = wanted.join(bodies, ["cik", "source_sha"], "left")
        intact = F.coalesce(F.sha2("content", 256) == F.col("source_sha"), F.lit(False))
        return found.select("fact_id", "cik", "source_sha", intact.alias("intact"), "content")

    def quality(self, spark: SparkSession, run: str, name: str) -> DataFrame:
        return spark.read.parquet(self.path("releases", run, "quality", name))

    # Manifests

    def manifests(self, spark: SparkSession) -> DataFrame:
        return read_if_present(spark, self.path("manifests"), schemas.RELEASE_MANIFEST, "json")

    def generation(self, spark: SparkSession, manifest: Row | None) -> Generation:
        if manifest is None:
            return Generation()
        return Generation.parsed(commit.read_text(spark, self.path("generations", manifest["generation"])))

    def commit_manifest(self, spark: SparkSession, base: int, generation: Generation, manifest: dict) -> bool:
        """Publish as number ``base + 1``; False where another writer has that number."""
        name = f"{base + 1:012d}-{manifest['run_id']}"
        # Written first: a generation that no manifest names is invisible.
        commit.create_if_absent(spark, self.path("generations", name), generation.text())
        row = {**manifest, "number": base + 1, "generation": name}
        body = {
            f.name: v.isoformat() if isinstance(v := row.get(f.name), (date, datetime)) else v
            for f in schemas.RELEASE_MANIFEST
        }
        return commit.create_if_absent(
            spark, self.path("manifests", f"{base + 1:012d}.json"), json.dumps(body) + "\n"
        )

    def current_release(self, spark: SparkSession) -> Row | None:
        """The newest manifest, or None before the first release. Runs no job.

        Resolve it once and read everything through it, so that all reads of one
        request see the same release.
        """
        found = [n for n in commit.names(spark, self.path("manifests")) if n.endswith(".json")]
        return self.manifest(spark, found[-1]) if found else None

    def manifest(self, spark: SparkSession, name: str) -> Row:
        row = json.loads(commit.read_text(spark, self.path("manifests", name)))
        readers = {"date": date.fromisoformat, "timestamp": datetime.fromisoformat}
        return Row(**{
            f.name: readers.get(f.dataType.typeName(), lambda v: v)(row[f.name])
            if row[f.name] is not None else None
            for f in schemas.RELEASE_MANIFEST
        })

    def release(self, spark: SparkSession) -> "Release | None":
        manifest = self.current_release(spark)
        return None if manifest is None else Release(spark, self, manifest)


@dataclasses.dataclass(frozen=True)
class Release:
    """Read access to one published release."""

    spark: SparkSession
    store: Store
    manifest: Row

    @cached_property
    def generation(self) -> Generation:
        return self.store.generation(self.spark, self.manifest)

    @cached_property
    def facts(self) -> DataFrame:
        return self.store.facts(self.spark, self.generation)

    @cached_property
    def snapshots(self) -> DataFrame:
        return self.store.snapshots(self.spark, self.generation)

    @cached_property
    def history(self) -> DataFrame:
        return self.store.history(self.spark, self.generation)

    @cached_property
    def mart_schemas(self) -> dict[str, T.StructType]:
        return self.store.mart_schemas(self.spark, self.manifest["model_version"])

    def mart(self, name: str) -> DataFrame:
        held = self.store.mart(self.spark, self.generation, name, self.mart_schemas[name])
        return dated(name, held, self.manifest["filing_date_cutoff"])

    def quality(self, name: str) -> DataFrame:
        return self.store.quality(self.spark, self.manifest["run_id"], name)


def dated(name: str, mart: DataFrame, as_of: date) -> DataFrame:
    """A mart as readers see it, with the release's cutoff where it has one."""
    return mart.withColumn("filing_date_cutoff", F.lit(as_of)) if name in DATED_MARTS else mart
