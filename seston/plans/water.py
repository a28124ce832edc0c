"""Phytoplankton totals against laboratory water quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seston.functions.text import relabel
from seston.operators.correlation import corr_matrix, corr_pvalues, mask_outliers
from seston.operators.filters import drop_keys, drop_nondetects
from seston.operators.joins import natural_join
from seston.operators.reshape import spread
from seston.operators.summary import sum_by
from seston.sources.small import small_table

# Names of sites and strata in the laboratory file, and the
# sample labelled wrongly there.
ISLANDS = {"French Island": "FI", "Little Hastings": "LH", "Decker Island": "DI"}
OTHER_ISLAND = "FC"
STRATA = {"Vegetation": "SAV"}
OTHER_STRATUM = "WAT"
MISLABELLED = [("LH", "WAT", "2017-05-23")]
MEASURES = ["tvol", "tden", "Chlorophyll a", "Pheophytin a"]
KEYS = ["island", "stratum", "date"]


def phyto_totals(genera: DataFrame, rep: str = "1") -> DataFrame:
    """Density and volume per site and date, of the replicate the laboratory
    samples go with."""
    sums = sum_by(genera, ["site", *KEYS, "rep"], ["density", "volume"])
    return sums.filter(F.col("rep") == rep).withColumnsRenamed({"density": "tden", "volume": "tvol"})


def analytes_wide(lab: DataFrame, analytes: Sequence[str] | None = None) -> DataFrame:
    """Detected results, one column per analyte."""
    found = drop_nondetects(lab, "ND", "Result")
    named = found.select(
        relabel("Site", ISLANDS, OTHER_ISLAND).alias("island"),
        relabel("Stratum", STRATA, OTHER_STRATUM).alias("stratum"),
        F.to_date("CollectionDatePST").alias("date"),
        F.col("Analyte").alias("analyte"),
        F.col("Result").alias("result"),
    )
    bad = small_table(lab.sparkSession, MISLABELLED, "island string, stratum string, date string")
    named = drop_keys(named, bad.withColumn("date", F.col("date").cast("date")))
    return spread(named, KEYS, "analyte", "result", analytes)


def combined(genera: DataFrame, lab: DataFrame, analytes: Sequence[str] | None = None) -> DataFrame:
    return natural_join(phyto_totals(genera), analytes_wide(lab, analytes), "full", KEYS)


def correlations(table: DataFrame, cols: Sequence[str] = tuple(MEASURES), screen: bool = True) -> tuple[DataFrame, DataFrame]:
    """Correlations and their p-values, with outliers removed unless told not to."""
    cols = list(cols)
    used = mask_outliers(table.select(*[F.col(f"`{c}`") for c in cols]), cols) if screen else table
    return corr_matrix(used, cols), corr_pvalues(used, cols)
