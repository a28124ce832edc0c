"""Net samples: count sheets and tow sheets to densities per taxon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seston.functions.dates import clock_seconds, parse_date
from seston.functions.measures import density, total_tow_volume
from seston.functions.text import matches, replace_each, sentence_case
from seston.operators.columns import relocate, separate
from seston.operators.filters import drop_keys, exclude_taxa
from seston.operators.joins import join_lookup, natural_join, reconcile
from seston.operators.taxa import normalise_station, normalise_taxon, split_stage
from seston.sources.csv_files import read_csv_dir
from seston.sources.small import small_table

# Column types of the count sheets and the repairs they need.
COUNT_SCHEMA = (
    "sample string, date string, time string, category string, taxon string, count double, "
    "subsamples double, subsample double, v1_ml double, sub1_ml double, v2_ml double, sub2_ml double"
)
STATION_REPAIRS = [("LH-SAV-02", "LH-SAV-2")]
CATEGORY_REPAIRS = [("MICROZOOPLANKTON & NAUPLII", "MICROZOOPLANKTON")]
TAXON_REPAIRS = [("Dunhevidia", "Dunhevedia"), ("HARPACTICOIDS", "Harpacticoids")]
CATEGORY_OF_TAXON = [("Monospilus", "CLADOCERA")]
NOT_A_TAXON = ["Immature Cladoceran"]
EXTRA_SAMPLES = [("FI-SAV-2", "2017-06-29")]
# The micro group is counted in the second subsample, all others in the first.
MICRO = {"MICROZOOPLANKTON": ("sub2_ml", "v2_ml")}
OTHERS = ("sub1_ml", "v1_ml")
TOWS = range(1, 5)


def read_counts(spark: SparkSession, glob: str) -> DataFrame:
    return read_csv_dir(spark, glob, COUNT_SCHEMA)


def repaired_counts(raw: DataFrame) -> DataFrame:
    """Dates parsed, stations, categories and names repaired."""
    category = replace_each("category", CATEGORY_REPAIRS)
    for pattern, right in CATEGORY_OF_TAXON:
        category = F.when(matches("taxon", pattern), F.lit(right)).otherwise(category)
    return raw.withColumns(
        {
            "sample": normalise_station("sample", "-", STATION_REPAIRS),
            "date": parse_date("date"),
            "seconds": clock_seconds("time"),
            "category": category,
            "taxon": replace_each("taxon", TAXON_REPAIRS),
        }
    )


def prepared_counts(raw: DataFrame) -> DataFrame:
    """Repaired counts with station parts, life stage, genus and species."""
    named = split_stage(repaired_counts(raw))
    named = named.withColumn("taxon", normalise_taxon("taxon"))
    named = separate(named, "taxon", ["genus", "sp"], keep=True)
    return separate(named, "sample", ["island", "stratum", "site"], keep=True)


def tow_volumes(tows: DataFrame, na: str = "propagate") -> DataFrame:
    """Water filtered per sample over its four tows, m3."""
    total = total_tow_volume(
        [f"tow{i}_sub_area_prop" for i in TOWS], [f"tow{i}_length_m" for i in TOWS], na=na
    )
    return tows.select(
        normalise_station("sample", "-").alias("sample"),
        parse_date("date", ["M/d/yyyy"]).alias("date"),
        "sample_month",
        total.alias("tot_vol_m3"),
    )


def missing_partners(counts: DataFrame, tows: DataFrame) -> DataFrame:
    """Sample dates with counts but no tow sheet, or the reverse."""
    return reconcile(counts, tows, ["sample", "date"]).filter("found_in <> 'both'")


def densities(counts: DataFrame, tows: DataFrame) -> DataFrame:
    """Individuals per mL for each sample, taxon and stage that was found."""
    found = exclude_taxa(counts.filter(F.col("count") > 0), NOT_A_TAXON)
    extra = small_table(counts.sparkSession, EXTRA_SAMPLES, "sample string, date string")
    found = drop_keys(found, extra.withColumn("date", F.col("date").cast("date")))
    joined = join_lookup(found, tows, ["sample", "date"])
    return joined.select(
        "sample",
        "island",
        "stratum",
        "site",
        "date",
        "seconds",
        "sample_month",
        "category",
        "taxon",
        "genus",
        "sp",
        "stage",
        "tot_vol_m3",
        density("count", "category", MICRO, OTHERS, "tot_vol_m3").alias("indiv_per_ml"),
    )


def with_environment(dens: DataFrame, env: DataFrame) -> DataFrame:
    """Densities with the conditions of their sample; samples of either side
    without a partner are kept."""
    env = env.withColumns(
        {"sample": normalise_station("sample", "-"), "date": parse_date("date", ["M/d/yyyy"])}
    )
    return natural_join(dens, env.drop("time_pdt"), "full")


def with_higher_taxa(counts: DataFrame, names: DataFrame, genera: DataFrame) -> DataFrame:
    """Genus and stage by category and taxon as written, then higher ranks by
    genus. ``names`` has category, taxon, genus, life_stage; ``genera`` has
    phylum, class, order, family, genus, where exact repeats are dropped."""
    written = counts.withColumn("category", sentence_case("category"))
    placed = join_lookup(
        written.drop("genus"), names.select("category", "taxon", "genus", "life_stage"), ["category", "taxon"], "distinct"
    )
    ranks = ["phylum", "class", "order", "family"]
    out = join_lookup(placed, genera.select(*ranks, "genus"), ["genus"], "distinct")
    return relocate(out, [*ranks, "genus"], after="taxon")
