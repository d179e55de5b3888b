"""Filing index: parallel arrays to rows, periods, and the filings of the wanted years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.fiscal import filing_period

RECENT = "cik string, name string, filings struct<recent: struct<accessionNumber: array<string>, form: array<string>, filingDate: array<string>, primaryDocument: array<string>>>"


def read_filing_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECENT).option("multiLine", True).json(path)


def filing_rows(index: DataFrame, end_month: int = 12) -> DataFrame:
    """10-K and 10-Q filings with the period each covers; ``place`` keeps the listed order."""
    r = "filings.recent"
    zipped = F.arrays_zip(F.col(f"{r}.accessionNumber").alias("accession_number"), F.col(f"{r}.form").alias("filing_type"),
                          F.col(f"{r}.filingDate").alias("filing_date"), F.col(f"{r}.primaryDocument").alias("document"))
    rows = index.select(F.lpad("cik", 10, "0").alias("cik"), F.col("name").alias("company_name"), F.posexplode(zipped).alias("place", "f"))
    rows = rows.select("cik", "company_name", "place", "f.*").filter(F.col("filing_type").isin("10-K", "10-Q"))
    return rows.withColumn("period", filing_period(F.col("filing_type"), F.col("filing_date"), end_month))


def filings_by_period(filings: DataFrame, years: list[int] | None = None, num_years: int = 3, annual: bool = True, quarterly: bool = True) -> DataFrame:
    """First listed filing per company and wanted period; by default the latest years with a 10-K."""
    year = F.regexp_extract("period", r"(\d{4})$", 1).try_cast("int")
    rows = filings.withColumn("year", year)
    if years is not None:
        rows = rows.filter(F.col("year").isin(*years))
    else:
        known = rows.filter("filing_type = '10-K'").groupBy("cik").agg(
            F.slice(F.sort_array(F.collect_set("year"), asc=False), 1, num_years).alias("wanted"))
        rows = rows.join(known, "cik").filter(F.array_contains("wanted", F.col("year"))).drop("wanted")
    forms = [f for f, on in (("10-K", annual), ("10-Q", quarterly)) if on]
    kept = rows.filter(F.col("filing_type").isin(*forms))
    firsts = kept.groupBy("cik", "filing_type", "period").agg(F.min("place").alias("place"))
    return kept.join(firsts, ["cik", "filing_type", "period", "place"], "left_semi").drop("year")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Downloaded pages from a landing folder: ``doc_id, html``."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("html"))
