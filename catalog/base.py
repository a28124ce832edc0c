"""Registration and the observation table the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seston.sources.csv_files import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The driver tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self._folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of ``Tables`` under a name."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def observations(t: Tables) -> DataFrame:
    """Line items as counts of taxa: a sample is a supplier nation in a quarter,
    so there are as many samples as sites and surveys, however large the
    tables are."""
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("taxon"))
    supplier = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    joined = t.lineitem.join(part, "l_partkey").join(supplier, "l_suppkey")
    site = F.concat(F.lit("S"), F.col("s_nationkey").cast("string"))
    survey = F.concat(
        F.year("l_shipdate").cast("string"), F.lit("Q"), F.quarter("l_shipdate").cast("string")
    )
    return joined.select(
        F.concat_ws("_", site, survey).alias("sample"),
        site.alias("site"),
        F.when(F.col("s_nationkey") % 2 == 0, "SAV").otherwise("WAT").alias("stratum"),
        survey.alias("survey"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_linenumber").alias("rep"),
        "taxon",
        F.split_part("taxon", F.lit(" "), F.lit(2)).alias("genus"),
        F.col("l_quantity").alias("density"),
        F.col("l_extendedprice").alias("volume"),
    )


OBS = """obs AS (
  SELECT 'S' || s_nationkey || '_' || year(l_shipdate) || 'Q' || quarter(l_shipdate) AS sample,
         'S' || s_nationkey AS site,
         CASE WHEN s_nationkey % 2 = 0 THEN 'SAV' ELSE 'WAT' END AS stratum,
         year(l_shipdate) || 'Q' || quarter(l_shipdate) AS survey,
         CAST(l_shipdate AS DATE) AS date, l_linenumber AS rep,
         p_name AS taxon, split_part(p_name, ' ', 2) AS genus,
         l_quantity AS density, l_extendedprice AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
