"""The end-to-end plans on hand-made sheets, and on real ones where given.

SESTON_COUNTS may name a folder of count sheets, SESTON_COMMENTS a CSV of
comments, SESTON_NAMES and SESTON_GENERA the two lookup CSVs; the checks that
need them are skipped otherwise.
"""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from seston.functions.text import debris_level, quality_class
from seston.operators.columns import clean_names
from seston.operators.summary import count_by, fd_violations, mismatch_total
from seston.plans import community, phyto, water, zoop
from seston.sources.csv_files import read_csv_dir, read_table


def given(variable):
    path = os.environ.get(variable)
    return pytest.mark.skipif(not path, reason=f"{variable} is not set"), path


needs_counts, COUNTS = given("SESTON_COUNTS")
needs_comments, COMMENTS = given("SESTON_COMMENTS")
needs_names, NAMES = given("SESTON_NAMES")
needs_genera, GENERA = given("SESTON_GENERA")


@pytest.fixture
def sheets(spark):
    rows = [
        ("DI-SAV-1", "2017-08-30", "12:35", "MICROZOOPLANKTON", "Rotifers", 72.0, 1.0, None, 78.0, 10.0, 78.0, 0.25),
        ("DI-SAV-1", "2017-08-30", "12:35", "CALANOIDS", "Acartia copepodid", 8.0, 1.0, None, 78.0, 10.0, 78.0, 0.25),
        ("DI_SAV_1", "8/30/2017", "12:35", "MACROZOOPLANKTON", "Monospilus dispar", 4.0, None, 1.0, 78.0, 10.0, 78.0, 0.25),
        ("DI_SAV_1", "8/30/2017", "12:35", "MICROZOOPLANKTON & NAUPLII", "Copepod nauplii", 0.0, None, 1.0, 78.0, 10.0, 78.0, 0.25),
        ("LH_SAV_02", "3/14/2018", "9:05", "CLADOCERA", "Dunhevidia sp.", 2.0, None, 1.0, 40.0, 20.0, 41.0, 2.0),
        ("LH_SAV_02", "3/14/2018", "9:05", "CLADOCERA", "Immature Cladoceran", 1.0, None, 1.0, 40.0, 20.0, 41.0, 2.0),
        ("FI_SAV_2", "6/29/2017", "9:05", "CLADOCERA", "Bosmina", 3.0, None, 1.0, 40.0, 20.0, 40.0, 2.0),
    ]
    return spark.createDataFrame(rows, zoop.COUNT_SCHEMA)


@pytest.fixture
def tows(spark):
    names = "sample string, date string, time_pdt string, sample_month string"
    for i in range(1, 5):
        names += f", tow{i}_sub_area_prop double, tow{i}_length_m double"
    full = [1.0, 5.0] * 4
    return spark.createDataFrame(
        [("DI_SAV #1", "8/30/2017", "12:35", "August", *full), ("FC-WAT-1", "7/9/2018", "10:00", "July", *full)], names
    )


def test_zooplankton_densities(spark, sheets, tows, rows):
    counts = zoop.prepared_counts(sheets)
    volumes = zoop.tow_volumes(tows)
    assert rows(zoop.missing_partners(counts, volumes), "sample", "found_in") == [
        ("FC-WAT-1", "right"), ("FI-SAV-2", "left"), ("LH-SAV-2", "left"),
    ]
    found = {r["taxon"]: r for r in zoop.densities(counts, volumes).collect()}
    assert set(found) == {"Rotifers", "Acartia", "Monospilus dispar", "Dunhevedia"}
    tow = 4 * 5 * 0.0225 * 3.141592653589793
    assert found["Rotifers"]["tot_vol_m3"] == pytest.approx(tow)
    assert found["Rotifers"]["indiv_per_ml"] == pytest.approx(72 / (0.25 / 78) / (tow * 1e6))
    assert found["Acartia"]["indiv_per_ml"] == pytest.approx(8 / (10 / 78) / (tow * 1e6))
    assert found["Acartia"]["stage"] == "copepodid"
    assert found["Monospilus dispar"]["category"] == "CLADOCERA"
    assert (found["Monospilus dispar"]["genus"], found["Monospilus dispar"]["sp"]) == ("Monospilus", "dispar")
    assert found["Dunhevedia"]["indiv_per_ml"] is None and found["Dunhevedia"]["island"] == "LH"


def test_environment_keeps_both_sides(spark, sheets, tows):
    dens = zoop.densities(zoop.prepared_counts(sheets), zoop.tow_volumes(tows))
    env = spark.createDataFrame(
        [("DI_SAV_1", "8/30/2017", "12:35", 21.5), ("FC #1", "7/9/2018", "9:00", 20.0)],
        "sample string, date string, time_pdt string, temperature double",
    )
    out = zoop.with_environment(dens, env)
    assert "time_pdt" not in out.columns and out.count() == 5
    assert out.filter("taxon IS NULL").first()["sample"] == "FC-1"
    assert out.filter("temperature = 21.5").count() == 3


@pytest.fixture
def bench_sheet(spark):
    names = (
        "sample_date string, sample_time string, station_code string, volume_received_m_l string, "
        "volume_analyzed_m_l string, field_of_view_mm2 string, slide_chamber_area_mm2 string, "
        "number_of_fields_counted string, taxon string, genus string, species string, unit_abundance string, "
        "number_of_cells_per_unit string, gald string, gald_1 string, colony_filament_individual_group_code string, "
        "comments string"
    )
    names += "".join(f", biovolume_{i} string" for i in range(1, 11))
    none8 = [None] * 8
    rows = [
        ("43172", "0.375", "DI-SAV-18", "50", "5", "0.07", "300", "10", "Chroomonas spp.", "Chroomonas", "spp.", "30", "60",
         None, "12", "f.", "Degraded. High sediment.", "100", "300", *none8),
        ("43172", None, "LH_WAT_1", "50", "5", "0.07", "300", "10", "cf. Rhodomonas sp.", "Rhodomonas", "sp.", "10", "10",
         "8", None, "i", None, "50", None, *none8),
        ("43172", "0.4", "LH_WAT_1", "50", "5", "0.07", "300", "10", "cf. Amoeba sp.", "Amoeba", "sp.", "1", "1",
         "8", None, "i", None, "50", None, *none8),
        ("43172", "0.4", "LH_WAT_1", "50", "5", "0.07", "300", "10", None, None, None, None, None, None, None, None, None, "7", None, *none8),
    ]
    return spark.createDataFrame(rows, names)


def test_phytoplankton_preparation(spark, bench_sheet):
    day = lambda d: dt.date.fromisoformat(d)
    surveys = spark.createDataFrame(
        [("DI_SAV_1", day("2018-03-14"), "DI", "2018-03"), ("LH_WAT_1", day("2018-03-14"), "LH", "2018-03")],
        "station string, date date, island string, month_survey string",
    )
    assert phyto.unlisted_samples(phyto.measured(bench_sheet), surveys).count() == 2
    times = spark.createDataFrame([("LH_WAT_1", day("2018-03-13"), 31200)], "station string, date date, seconds long")
    taxonomy = spark.createDataFrame(
        [("Chroomonas sp.", "Chroomonas", "Chromista", "Cryptophyta")], "name string, genus string, kingdom string, phylum string"
    )
    gaps = spark.createDataFrame(
        [("cf. Rhodomonas sp.", "Rhodomonas", "Chromista", "Gap")], "name string, genus string, kingdom string, phylum string"
    )
    out = {r["genus"]: r for r in phyto.prepare(bench_sheet, surveys, taxonomy, gaps, times).collect()}
    assert set(out) == {"Chroomonas", "Rhodomonas"}
    a, b = out["Chroomonas"], out["Rhodomonas"]
    assert a["station"] == "DI_SAV_1" and a["date"] == day("2018-03-14") and a["island"] == "DI"
    assert a["date_time_pdt"] == "2018-03-14 09:00:00" and b["time"] == "08:40:00"
    assert a["organisms_per_ml"] == round(30 * 300 / (5 * 0.07 * 10), 1)
    assert a["cells_per_ml"] == round(60 * 300 / (5 * 0.07 * 10), 1)
    assert a["biovolume_cubic_micron_per_ml"] == round(60 * 200 * 300 / (5 * 0.07 * 10), 1)
    assert b["biovolume_cubic_micron_per_ml"] == round(10 * 50 * 300 / (5 * 0.07 * 10), 1)
    assert a["gald"] == 12.0 and a["phyto_form"] == "f" and a["species"] == "sp."
    assert (a["quality_check"], a["debris"], b["quality_check"], b["debris"]) == ("degraded", "high", "good", None)
    assert (a["phylum"], b["phylum"]) == ("Cryptophyta", "Gap") and a["taxon_original"] == "Chroomonas sp."
    grand = phyto.measured(bench_sheet, "global").filter("genus = 'Rhodomonas'").first()
    assert grand["biovolume_cubic_micron_per_ml"] == round(10 * 125 * 300 / (5 * 0.07 * 10), 1)


@pytest.fixture
def counts(spark):
    import random

    rng = random.Random(8)
    rows = []
    for month in range(6, 10):
        for island in ("DI", "LH"):
            for stratum in ("SAV", "WAT"):
                for rep in ("1", "2"):
                    site = f"{island}_{stratum}_{rep}"
                    for g in ["A", "B", "C", "D", "Amoeba"]:
                        if rng.random() < 0.8:
                            rows.append((f"2017-{month:02d}", dt.date(2017, month, 5), site, island, stratum, rep, g, float(rng.randint(1, 90)), 2.0))
    return spark.createDataFrame(
        rows, "survey string, date date, site string, island string, stratum string, rep string, genus string, density double, volume_avg double"
    )


def test_community_analysis(spark, counts):
    genera = community.genus_totals(counts)
    assert genera.filter("genus = 'Amoeba'").count() == 0
    assert genera.filter("site = 'DI_SAV_1'").first()["sample"].startswith("DIS1_2017-")
    assert genera.filter("abs(volume - 2 * density) > 1e-9").count() == 0
    means = community.site_means(genera)
    assert community.diversity(means).count() == 16
    totals = community.totals_over_time(means)
    assert totals.filter("abs(exp(log_density) - density) > 1e-6").count() == 0
    ranks = spark.createDataFrame([("A", "X"), ("B", "X"), ("C", "Y"), ("D", "Z")], "genus string, phylum string")
    layers = community.composition(means, ranks, "phylum", "density")
    sums = layers.groupBy(community.SITE).agg(F.sum("share").alias("s"), F.max("upper").alias("u"), F.sum("density").alias("d"))
    assert sums.filter("abs(s - 1) > 1e-9 OR abs(u - d) > 1e-9").count() == 0
    factors = community.sample_factors(genera)
    assert {r[0] for r in factors.select("season").distinct().collect()} == {"Su", "F"}
    found = community.group_tests(genera, ["island"], perms=19)["island"]
    assert found[0].first()["permutations"] == 19 and found[1].count() == 3
    result, taxa = community.ordinate(genera, k=2, starts=1, max_iter=2)
    assert result.scores.count() == factors.count() and taxa.count() == 4


def test_water_quality(spark, counts, rows):
    genera = community.genus_totals(counts)
    lab = [
        ("Decker Island", "Vegetation", f"2017-{m:02d}-05 10:00:00", a, r, nd)
        for m in range(6, 10)
        for a, r, nd in (("Chlorophyll a", f"{m * 1.5}", 0), ("Pheophytin a", "< RL" if m == 7 else f"{m * m}", int(m == 7)))
    ]
    lab += [("Little Hastings", "Open Water", "2017-05-23 09:00:00", "Chlorophyll a", "9", 0)]
    table = spark.createDataFrame(lab, "Site string, Stratum string, CollectionDatePST string, Analyte string, Result string, ND int")
    wide = water.analytes_wide(table, ["Chlorophyll a", "Pheophytin a"])
    assert rows(wide, "island", "Pheophytin a") == [("DI", None), ("DI", 36.0), ("DI", 64.0), ("DI", 81.0)]
    both = water.combined(genera, table, ["Chlorophyll a", "Pheophytin a"])
    assert both.filter("island = 'DI' AND stratum = 'SAV'").count() == 4
    matrix, tests = water.correlations(both)
    assert matrix.count() == 10 and tests.count() == 6


# ------------------------------------------------- checks against real sheets


@pytest.fixture(scope="module")
def real(spark):
    return zoop.read_counts(spark, f"{COUNTS}/*.csv").cache() if COUNTS else None


@needs_counts
def test_real_sheets_as_read(spark, real):
    assert real.count() == 7765
    files = read_csv_dir(spark, f"{COUNTS}/*.csv", "sample string", source="f")
    assert files.select("f").distinct().count() == 222
    assert real.filter("subsamples IS NULL").count() == 2132
    assert real.filter("subsample IS NULL").count() == 5651
    assert real.agg(F.sum("count")).first()[0] == 127574
    assert tuple(mismatch_total(real, "v1_ml", "v2_ml").first()) == (325, 921.0)


@needs_counts
def test_real_sheets_repaired(spark, real, rows):
    assert real.select("sample").distinct().count() == 30
    fixed = zoop.repaired_counts(real)
    assert fixed.filter("date IS NULL OR seconds IS NULL").count() == 0
    assert fixed.select("sample").distinct().count() == 18
    assert fixed.select("sample", "date").distinct().count() == 222
    merged = real.withColumn("category", F.regexp_replace("category", " & NAUPLII", ""))
    assert rows(fd_violations(merged, "taxon", "category"), "taxon") == [("Monospilus",), ("Monospilus dispar",)]
    sums = {r[0]: r[1] for r in merged.groupBy("category").agg(F.sum("count")).collect()}
    assert sums == {
        "MICROZOOPLANKTON": 80682, "CALANOIDS": 21348, "CYCLOPOIDS": 12900, "CLADOCERA": 11602, "HARPACTICOIDS": 1042,
        "MACROZOOPLANKTON": 0,
    }


@needs_counts
def test_real_sheets_named(spark, real):
    named = zoop.prepared_counts(real)
    stages = {r["stage"]: r["n"] for r in count_by(named, ["stage"]).collect()}
    assert stages == {"not_spec": 5793, "copepodid": 1195, "adult": 555, "nauplii": 222}
    assert named.filter("site IS NULL").count() == 210
    found = named.filter("count > 0")
    assert found.count() == 3031
    by = {r["category"]: r["n"] for r in count_by(found, ["category"]).collect()}
    assert by == {"CLADOCERA": 1179, "CYCLOPOIDS": 681, "MICROZOOPLANKTON": 617, "CALANOIDS": 441, "HARPACTICOIDS": 113}
    assert found.select("taxon").distinct().count() == 56
    kept = found.filter("taxon <> 'Immature Cladoceran'")
    assert kept.count() == 3030 and kept.select("genus").distinct().count() == 47


@needs_comments
def test_real_comments(spark):
    table = read_table(spark, COMMENTS)
    quality = {r[0]: r[1] for r in table.groupBy(quality_class("comments")).count().collect()}
    assert table.count() == 66 and quality == {"good": 45, "fragmented": 18, "degraded": 3}
    debris = {r[0]: r[1] for r in table.groupBy(debris_level("comments")).count().collect()}
    assert debris == {"moderate": 32, "high": 16, "low": 13, None: 5}


@needs_counts
@needs_names
@needs_genera
def test_real_lookups_do_not_multiply_rows(spark, real):
    names = clean_names(read_table(spark, NAMES))
    genera = clean_names(read_table(spark, GENERA))
    written = real.withColumn("taxon", F.regexp_replace("taxon", "HARPACTICOIDS", "Harpacticoids"))
    out = zoop.with_higher_taxa(written, names, genera)
    assert out.count() == 7765
    lost = names.filter("genus IS NOT NULL").join(genera, "genus", "left_anti").select("genus").distinct()
    assert [r[0] for r in lost.collect()] == ["Scaphloberis"]
