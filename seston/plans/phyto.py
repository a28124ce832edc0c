"""Water samples: taxonomist sheets to concentrations with taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seston.functions.dates import clock_text, instant, local_text, spreadsheet_date, spreadsheet_seconds
from seston.functions.measures import biovolume, concentration
from seston.functions.numbers import with_row_mean
from seston.functions.text import debris_level, quality_class, relabel, replace_all, taxon_level
from seston.operators.columns import cast_columns, select_cols
from seston.operators.filters import drop_null, exclude_taxa
from seston.operators.joins import apply_corrections, natural_join
from seston.operators.ordering import sort_na_last
from seston.operators.summary import distinct_keys
from seston.operators.taxa import assign_survey, normalise_station, resolve_taxa
from seston.sources.small import small_table

# Numeric columns of the sheets, repairs, and taxa left out.
NUMERIC = [
    "volume_received_m_l",
    "volume_analyzed_m_l",
    "field_of_view_mm2",
    "slide_chamber_area_mm2",
    "number_of_fields_counted",
    "unit_abundance",
    "total_cells",
    *[f"biovolume_{i}" for i in range(1, 11)],
]
STATION_REPAIRS = [("DI_SAV_18", "DI_SAV_1")]
DATE_REPAIRS = [
    ("2018-03-13", "2018-03-14"),
    ("2018-04-16", "2018-04-17"),
    ("2018-10-10", "2018-10-16"),
]
NOT_PHOTOSYNTHETIC = ["cf. Amoeba sp.", "Strobilidium sp."]
ZONE = "America/Los_Angeles"
RANKS = ("kingdom", "phylum", "class", "algal_group", "current_name")


def measured(raw: DataFrame, mean_cell: str = "row") -> DataFrame:
    """Text sheets to dates, times, concentrations and biovolumes.

    ``mean_cell`` is how the mean volume of a cell is taken over the ten
    measured cells: of the "row", or "global" over all rows.
    """
    counted = drop_null(raw, ["taxon"]).withColumnRenamed("number_of_cells_per_unit", "total_cells")
    text_gald = F.coalesce("gald", "gald_1")
    counted = counted.withColumn("gald", text_gald).drop("gald_1")
    typed = cast_columns(counted, {c: "double" for c in [*NUMERIC, "gald"]})
    typed = with_row_mean(typed, "mean_cell_biovolume", [f"biovolume_{i}" for i in range(1, 11)], mean_cell)
    slide = ("slide_chamber_area_mm2", "volume_analyzed_m_l", "field_of_view_mm2", "number_of_fields_counted")
    timed = typed.withColumns(
        {
            "date": spreadsheet_date("sample_date"),
            "seconds": spreadsheet_seconds("sample_time"),
            "station": normalise_station("station_code", "_", STATION_REPAIRS),
            "organisms_per_ml": concentration("unit_abundance", *slide),
            "cells_per_ml": concentration("total_cells", *slide),
            "biovolume_cubic_micron_per_ml": biovolume("total_cells", "mean_cell_biovolume", *slide),
            "phyto_form": relabel("colony_filament_individual_group_code", {"f.": "f"}),
        }
    )
    return select_cols(
        timed, "station", "date", "seconds", "taxon", "genus", "species", "organisms_per_ml", "cells_per_ml",
        "biovolume_cubic_micron_per_ml", "gald", "phyto_form", "comments",
    )


def dated(samples: DataFrame, surveys: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Missing times filled in, wrong dates corrected, survey columns added.

    ``times`` has station, date and seconds for samples without a time;
    ``surveys`` has station, date and the survey columns.
    """
    if times is not None:
        filled = natural_join(samples, times.withColumnRenamed("seconds", "__seconds"), "left", ["station", "date"])
        samples = filled.withColumn("seconds", F.coalesce("seconds", "__seconds")).drop("__seconds")
    fixes = small_table(samples.sparkSession, DATE_REPAIRS, "date string, right string")
    fixes = fixes.select(*[F.col(c).cast("date").alias(c) for c in ("date", "right")])
    right = apply_corrections(samples, fixes, ["date"], "date")
    return assign_survey(right, surveys)


def unlisted_samples(samples: DataFrame, surveys: DataFrame) -> DataFrame:
    """Sample dates the survey list does not have: likely typing errors."""
    lost = natural_join(samples, surveys, "anti", ["station", "date"])
    return sort_na_last(distinct_keys(lost, ["date", "station"]), ["date", "station"])


def classified(samples: DataFrame) -> DataFrame:
    """Quality and debris classes from the comments, names made uniform."""
    named = samples.withColumns(
        {
            "name": replace_all("taxon", " spp.", " sp."),
            "species": relabel("species", {"spp.": "sp."}),
            "quality_check": quality_class("comments"),
            "debris": debris_level("comments"),
        }
    )
    return exclude_taxa(named, NOT_PHOTOSYNTHETIC, "name").drop("comments", "taxon")


def taxon_list(samples: DataFrame) -> DataFrame:
    taxa = distinct_keys(samples, ["name", "genus", "species"]).withColumn("taxon_level", taxon_level("species"))
    return sort_na_last(taxa, ["taxon_level", "genus", "species"])


def finished(samples: DataFrame, taxonomy: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """Higher taxonomy added and times written as local text, for export."""
    placed = resolve_taxa(samples, taxonomy, gaps, ranks=RANKS, steps=("name", "gaps"))
    at = local_text(instant("date", "seconds", ZONE), ZONE)
    written = placed.withColumns({"time": clock_text("seconds"), "date_time_pdt": at}).drop("seconds")
    return written.withColumnsRenamed({"name": "taxon_original", "current_name": "taxon_current"})


def prepare(
    raw: DataFrame,
    surveys: DataFrame,
    taxonomy: DataFrame,
    gaps: DataFrame | None = None,
    times: DataFrame | None = None,
) -> DataFrame:
    return finished(classified(dated(measured(raw), surveys, times)), taxonomy, gaps)
