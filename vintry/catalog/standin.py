"""Stand-in inputs: the given star-schema tables read as filings.

These are mappings, not financial data. Every relation scales with the tables, and
only the columns a query uses are read.
"""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintry.contract import DURATION, INSTANT, METRICS, Concept
from vintry.functions.identity import fact_identity, issuer_attribute_hash, issuer_key
from vintry.operators.validation import FACT_COLUMNS

AS_OF = date(2001, 1, 1)
EARLIER = date(1998, 6, 30)
SEEN = datetime(1999, 6, 30)
PERIOD = date(1997, 12, 31)

DURATIONS = 4  # the first four metrics in contract order are durations
STANDIN_CONCEPTS = tuple(
    Concept(f"c{i}_{alias}", metric, DURATION if i < DURATIONS else INSTANT, alias)
    for i, metric in enumerate(METRICS)
    for alias in (0, 1)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(spark: SparkSession, sf_dir: str, name: str, *names: str) -> DataFrame:
    return table(spark, sf_dir, name).select(*names)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per order line."""
    lines = columns(
        spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate",
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("y"), "o_custkey"
    )
    c = F.col
    mi = (c("l_partkey") % 10).cast("int")
    duration = c("mi") < DURATIONS
    price = c("l_extendedprice").cast("decimal(18,2)")
    signed = price * (c("l_discount").cast("decimal(4,2)") - F.lit(Decimal("0.05")))
    shifts = F.make_dt_interval(c("l_linenumber"))
    return (
        lines.join(orders, "l_orderkey", "inner")
        .withColumn("mi", mi)
        .select(
            c("l_suppkey").alias("cik"),
            F.element_at(F.array(*[F.lit(m) for m in METRICS]), c("mi") + 1).alias("metric"),
            F.concat(F.lit("c"), c("mi").cast("string"), F.lit("_"),
                     (c("l_linenumber") % 2).cast("string")).alias("concept"),
            F.when(duration, F.lit(DURATION)).otherwise(F.lit(INSTANT)).alias("kind"),
            (c("l_linenumber") % 2).cast("int").alias("alias_priority"),
            F.lit("USD").alias("unit"),
            F.when(
                duration,
                F.when(c("l_quantity") <= 35, F.make_date("y", F.lit(1), F.lit(1)))
                .otherwise(F.make_date("y", F.lit(10), F.lit(1))),
            ).alias("period_start"),
            F.make_date("y", F.lit(12), F.lit(31)).alias("period_end"),
            F.when(c("mi").between(1, 3), signed).otherwise(price).cast("decimal(38,4)").alias("value"),
            F.concat_ws(
                "-",
                F.lpad(c("l_suppkey").cast("string"), 10, "0"),
                F.lpad((c("y") % 100).cast("string"), 2, "0"),
                F.lpad((c("l_orderkey") % 1_000_000).cast("string"), 6, "0"),
            ).alias("accession"),
            F.when(c("l_returnflag") == "A", F.lit("10-K"))
            .when(c("l_returnflag") == "N", F.lit("10-K/A"))
            .otherwise(F.lit("10-Q")).alias("form"),
            c("l_shipdate").cast("date").alias("filed"),
            c("y").alias("fiscal_year_hint"),
            F.lit("FY").alias("fiscal_period_hint"),
            (c("l_shipdate").cast("timestamp_ntz") + shifts).alias("first_observed"),
            c("l_linenumber").alias("idx"),
            "l_orderkey", "l_tax", "y", "o_custkey",
        )
    )


def snapshot_id(cik: Column, year: Column) -> Column:
    return F.sha2(F.concat_ws(":", cik.cast("string"), year.cast("string")), 256)


def with_provenance(obs: DataFrame) -> DataFrame:
    year = F.year("period_end")
    source = F.sha2(F.concat_ws(":", F.lit("source"), F.col("cik").cast("string"), year.cast("string")), 256)
    return (
        obs.withColumn("source_sha", source)
        .withColumn("bronze_path", F.concat(F.lit("bronze/cik="), F.col("cik").cast("string"), F.lit("/"), source))
        .withColumn("snapshot_id", snapshot_id(F.col("cik"), year))
    )


def accepted_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations that were filed on or after their period end, as far as facts need them."""
    valid = observations(spark, sf_dir).where(F.col("filed") >= F.col("period_end"))
    return valid.select(*[c for c in FACT_COLUMNS if c != "fact_id"], "first_observed")


def identified(accepted: DataFrame) -> DataFrame:
    """Facts: accepted observations with provenance and identity, both made of their columns."""
    return with_provenance(accepted).withColumn("fact_id", fact_identity()).select(
        *FACT_COLUMNS, "first_observed", "source_sha", "bronze_path", "snapshot_id"
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(accepted_observations(spark, sf_dir))


def issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issuer configuration: supplier, its nation as sector, its region as headquarters."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
        .join(region, nation["n_regionkey"] == region["r_regionkey"])
        .select(
            F.col("s_suppkey").alias("cik"),
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("sector"),
            F.col("r_name").alias("headquarters"),
        )
    )


def _version(rows: DataFrame, valid_from: str, valid_to: str | None) -> DataFrame:
    start = F.lit(valid_from).cast("timestamp_ntz")
    hashed = rows.withColumn("attribute_hash", issuer_attribute_hash())
    return hashed.select(
        issuer_key(F.col("attribute_hash"), start).alias("issuer_key"),
        "cik", "name", "ticker", "sector", "headquarters", "attribute_hash",
        start.alias("valid_from"), F.lit(valid_to).cast("timestamp_ntz").alias("valid_to"),
    )


def issuer_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third issuer had another sector before 1996; all have one open version."""
    current = issuers(spark, sf_dir)
    moved = F.col("cik") % 3 == 0
    return (
        _version(current.where(~moved), "1992-01-01 00:00:00", None)
        .unionByName(_version(current.where(moved), "1996-01-01 00:00:00", None))
        .unionByName(
            _version(
                current.where(moved).withColumn("sector", F.lit("PENDING")),
                "1992-01-01 00:00:00", "1996-01-01 00:00:00",
            )
        )
    )


def snapshots(facts_df: DataFrame) -> DataFrame:
    """One ledger row per issuer and year of the facts."""
    return facts_df.groupBy("snapshot_id", "cik", "source_sha", "bronze_path").agg(
        F.count("*").alias("accepted_count")
    ).select(
        "snapshot_id", "cik", "source_sha",
        F.concat(F.lit("https://example.org/companyfacts/"), F.col("cik").cast("string")).alias("source_url"),
        "bronze_path",
        F.concat(F.lit("silver/cik="), F.col("cik").cast("string"), F.lit("/"), F.col("snapshot_id")).alias("silver_path"),
        "accepted_count",
    )


def row_number_column() -> Column:
    """A number per order line, used to vary the documents below."""
    return F.col("l_orderkey") * 8 + F.col("idx")


def documents(spark: SparkSession, sf_dir: str, faults: bool) -> DataFrame:
    """One nested JSON document per order, with the customer as issuer.

    Its lines are observations under their concepts and units, so a document holds several
    of each, seven observations at most. With ``faults`` the number of the order line,
    modulo 101, decides what is wrong with it: one case for each rule of the source
    contract. ``r`` is the order's number.
    """
    obs = observations(spark, sf_dir).withColumn("r", row_number_column())
    fault = (F.col("r") % 101).cast("int") if faults else F.lit(0)
    obs = obs.withColumn("fault", fault)
    f, c, lit = F.col("fault"), F.col, F.lit
    year = c("y").cast("string")

    def text(value: Column) -> Column:
        return F.concat(lit('"'), value, lit('"'))

    def pair(key: str, value: Column) -> Column:
        return F.concat(lit(f'"{key}":'), value)

    amount = c("value").cast("string")
    val = (
        F.when(f == 8, text(amount)).when(f == 9, lit("true")).when(f == 10, lit("1e30"))
        .when(f == 11, F.concat(amount, lit("1"))).when(f == 12, lit("-1.5"))
        .when(f == 16, lit("2e3")).when(f == 17, lit("12345678901234567890123.125"))
        .otherwise(amount)
    )
    start = (
        F.when(f == 5, F.make_date(c("y") + 1, lit(1), lit(1)))
        .otherwise(c("period_start")).cast("string")
    )
    members = F.concat_ws(
        ",",
        F.when(f != 13, pair("val", val)),
        pair("end", text(F.when(f == 2, F.concat(year, lit("-02-31"))).otherwise(c("period_end").cast("string")))),
        F.when((f != 4) & start.isNotNull(), pair("start", text(start))),
        F.when(f != 3, pair("filed", text(c("filed").cast("string")))),
        pair("accn", text(F.when(f == 6, lit("bad-id")).otherwise(c("accession")))),
        pair("form", F.when(f == 7, lit("10")).otherwise(text(c("form")))),
        pair("fy", year),
        pair("fp", text(lit("FY"))),
        F.when(f == 14, pair("note", text(lit("x")))),
    )
    observation = F.when(f == 1, text(lit("not an object"))).otherwise(
        F.concat(lit("{"), members, lit("}"))
    )
    concept = F.when(f == 15, F.concat(lit("Other"), c("concept"))).otherwise(c("concept"))
    unit = F.when(lit(faults) & (c("l_tax") >= 0.07), lit("EUR")).otherwise(lit("USD"))
    # One grouping by the order, by whose key the lines are dealt already. Its lines are sorted
    # by concept, unit and place; each then writes what opens and closes before it.
    line = F.struct(
        F.concat(lit('"'), concept, lit('":{"units":{')).alias("concept"),
        F.concat(lit('"'), unit, lit('":[')).alias("unit"),
        F.struct("idx", "cik", "value", "filed").alias("place"), observation.alias("observation"),
    )
    lines = obs.select("o_custkey", "l_orderkey", F.when(concept.isNotNull(), line).alias("line"))
    per_order = lines.groupBy("o_custkey", "l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))

    def written(o: Column, i: Column) -> Column:
        before = F.get("lines", i - 1)
        same_concept = before["concept"] == o["concept"]
        opening = (
            F.when(same_concept & (before["unit"] == o["unit"]), lit(","))
            .when(same_concept, F.concat(lit("],"), o["unit"]))
            .when(i > 0, F.concat(lit("]}},"), o["concept"], o["unit"]))
            .otherwise(F.concat(o["concept"], o["unit"]))
        )
        return F.concat(opening, o["observation"])

    concepts = F.concat(
        F.array_join(F.transform("lines", written), ""), F.when(F.size("lines") > 0, lit("]}}")).otherwise(lit(""))
    )
    customer = c("o_custkey").cast("string")
    content = F.concat(
        lit('{"cik":'), customer, lit(',"entityName":"Customer '), customer,
        lit('","facts":{"us-gaap":{'), concepts, lit("}}}"),
    )
    return per_order.select(
        c("o_custkey").alias("cik"), c("l_orderkey").alias("r"), content.alias("content")
    )
