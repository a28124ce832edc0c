import datetime as dt

import pytest
from pyspark.sql import functions as F

from seston.functions import dates as D
from seston.functions import measures as M
from seston.functions import numbers as N
from seston.functions import text as X
from seston.operators import columns as C


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()[0]


@pytest.mark.parametrize(
    "text, number", [("3.5", 3.5), (" 7 ", 7.0), ("< RL", None), ("", None), ("NaN", None), (None, None)]
)
def test_text_to_number(spark, text, number):
    assert one(spark, text, N.to_number("x")) == number


def test_division_by_zero_is_missing(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(N.ratio("a", "b")).collect()] == [None, 0.25, None]


def test_rounding_ties(spark):
    df = spark.createDataFrame([(0.25,), (-0.25,), (0.35,)], "x double")
    up = [r[0] for r in df.select(N.round_to("x", 1)).collect()]
    even = [r[0] for r in df.select(N.round_to("x", 1, "even")).collect()]
    assert up == [0.3, -0.3, 0.4] and even == [0.2, -0.2, 0.4]
    with pytest.raises(ValueError):
        N.round_to("x", 1, "down")


def test_row_sum_and_mean(spark):
    df = spark.createDataFrame(
        [(1.0, None, 3.0), (None, None, None), (2.0, 4.0, 6.0)], "a double, b double, c double"
    )
    cols = ["a", "b", "c"]
    got = df.select(N.row_sum(cols), N.row_sum(cols, "propagate"), N.row_mean(cols)).collect()
    assert [tuple(r) for r in got] == [(4.0, None, 2.0), (0.0, None, None), (12.0, 12.0, 4.0)]
    whole = [r[0] for r in N.with_row_mean(df, "m", cols, "global").select("m").collect()]
    assert whole == [pytest.approx(16 / 5)] * 3
    with pytest.raises(ValueError):
        N.with_row_mean(df, "m", cols, "column")


def test_negated_pattern_keeps_missing(spark):
    df = spark.createDataFrame([("Acartia adult",), ("Bosmina",), (None,)], "x string")
    kept = [r[0] for r in df.filter(~X.matches("x", ["adult", "nauplii"])).collect()]
    assert kept == ["Bosmina", None]


def test_fixed_and_pattern_replacement(spark):
    assert one(spark, "Eudiaptomus sp. x", X.replace_all("x", " sp.", "", fixed=True)) == "Eudiaptomus x"
    assert one(spark, "a spp! b", X.replace_all("x", " spp.", " sp.")) == "a sp. b"
    assert one(spark, "abc", X.replace_each("x", [("a", "b"), ("b", "c")])) == "ccc"


def test_tidy_space(spark):
    assert one(spark, "cf.\u00a0Chroomonas \u00a0", X.tidy_space("x")) == "cf. Chroomonas"
    assert one(spark, " \u00a0", X.tidy_space("x")) is None


def test_sentence_case(spark):
    assert one(spark, "MICROZOOPLANKTON & NAUPLII", X.sentence_case("x")) == "Microzooplankton & nauplii"
    assert one(spark, "a", X.sentence_case("x")) == "A"


def test_text_from_end(spark):
    assert one(spark, "folder/AWS_2017-05.xlsx", X.from_end("x", -12, -6)) == "2017-05"
    assert one(spark, "abc", X.from_end("x", -12, -2)) == "ab"
    assert one(spark, "abc", X.from_end("x", -12, -6)) == ""


def test_split_last(spark):
    df = spark.createDataFrame([("Acartia copepodid",), ("a b c",), ("Rotifers",), (None,)], "x string")
    head, tail = X.split_last("x")
    got = [tuple(r) for r in df.select(head, tail).collect()]
    assert got == [("Acartia", "copepodid"), ("a b", "c"), ("Rotifers", "Rotifers"), (None, None)]


def test_text_classes(spark):
    df = spark.createDataFrame(
        [("Degraded. Fragments. Low",), ("FRAGMENTED, low then high",), ("Moderate",), (None,)], "x string"
    )
    got = [tuple(r) for r in df.select(X.quality_class("x"), X.debris_level("x")).collect()]
    assert got == [("degraded", "low"), ("fragmented", "high"), ("good", "moderate"), ("good", None)]


def test_taxon_level(spark):
    df = spark.createDataFrame([("sp.",), ("SPP. 2",), ("rosea",), (None,)], "x string")
    assert [r[0] for r in df.select(X.taxon_level("x")).collect()] == ["genus", "genus", "species", "species"]


def test_labels_and_levels(spark):
    df = spark.createDataFrame([("WAT",), ("SAV",), ("?",), (None,)], "x string")
    assert [r[0] for r in df.select(X.relabel("x", {"WAT": "Open Water"})).collect()] == ["Open Water", "SAV", "?", None]
    assert [r[0] for r in df.select(X.relabel("x", {"WAT": "a"}, "b")).collect()] == ["a", "b", "b", "b"]
    assert [r[0] for r in df.select(X.level_order("x", ["WAT", "SAV"])).collect()] == [1, 2, None, None]


@pytest.mark.parametrize(
    "text, date",
    [
        ("2017-08-30", dt.date(2017, 8, 30)),
        ("8/3/2017", dt.date(2017, 8, 3)),
        ("12/31/2018", dt.date(2018, 12, 31)),
        ("2017-02-30", None),
        ("soon", None),
        (None, None),
    ],
)
def test_dates_in_two_layouts(spark, text, date):
    assert one(spark, text, D.parse_date("x")) == date


def test_spreadsheet_numbers(spark):
    assert one(spark, "42878", D.spreadsheet_date("x")) == dt.date(2017, 5, 23)
    assert one(spark, "x", D.spreadsheet_date("x")) is None
    assert one(spark, "0.361111111111111", D.spreadsheet_seconds("x")) == 31200


@pytest.mark.parametrize(
    "text, seconds", [("8:40:00", 31200), ("14:05", 50700), ("9:03", 32580), ("25:00", None), ("x", None), (None, None)]
)
def test_clock(spark, text, seconds):
    assert one(spark, text, D.clock_seconds("x")) == seconds
    if seconds is not None:
        assert one(spark, seconds, D.clock_text("x"), "long").endswith(text.split(":")[1] + ":00")


@pytest.mark.parametrize(
    "date, clock, utc",
    [
        ("2018-01-10", "9:30", "2018-01-10 17:30:00"),
        ("2018-07-10", "9:30", "2018-07-10 16:30:00"),
        ("2018-03-11", "2:30", "2018-03-11 10:30:00"),  # inside the gap: moved on
        ("2018-11-04", "1:30", "2018-11-04 08:30:00"),  # occurs twice: the first
    ],
)
@pytest.mark.parametrize("session_zone", ["UTC", "Asia/Tokyo"])
def test_zoned_timestamps(spark, date, clock, utc, session_zone):
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        df = spark.createDataFrame([(date, clock)], "d string, c string")
        at = D.instant(F.col("d").cast("date"), D.clock_seconds("c"), "America/Los_Angeles")
        micros = df.select(F.unix_micros(at)).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    want = dt.datetime.fromisoformat(utc).replace(tzinfo=dt.timezone.utc)
    assert micros == int(want.timestamp()) * 1_000_000


def test_season(spark):
    df = spark.range(1, 13).select(D.season("id").alias("s"))
    assert [r[0] for r in df.collect()] == ["W"] * 2 + ["Sp"] * 3 + ["Su"] * 3 + ["F"] * 3 + ["W"]


def test_measures(spark):
    df = spark.createDataFrame(
        [("MICROZOOPLANKTON", 72.0, 0.25, 78.0, 1.0, 50.0), ("CALANOIDS", 10.0, 0.25, 78.0, 1.0, 50.0),
         ("CALANOIDS", 10.0, 0.25, 78.0, None, 50.0)],
        "cat string, n double, s2 double, v2 double, s1 double, v1 double",
    )
    made = M.density("n", "cat", {"MICROZOOPLANKTON": ("s2", "v2")}, ("s1", "v1"), F.lit(1.414))
    got = [r[0] for r in df.select(made).collect()]
    assert got[0] == pytest.approx(0.01588685, rel=1e-6)
    assert got[1] == pytest.approx(10 * 50 / 1.414e6) and got[2] is None
    tow = spark.createDataFrame([(0.5, 4.0), (None, 4.0)], "sub double, len double")
    vol = tow.select(
        M.total_tow_volume(["sub", "sub"], ["len", "len"]), M.total_tow_volume(["sub"], ["len"], na="skip")
    ).collect()
    assert vol[0][0] == pytest.approx(0.0225 * 3.14159265 * 4) and vol[1][0] is None and vol[1][1] == 0.0
    count = spark.createDataFrame([(30.0, 300.0, 5.0, 0.07, 10.0)], "u double, a double, v double, f double, n double")
    assert count.select(M.concentration("u", "a", "v", "f", "n")).first()[0] == 2571.4
    assert count.select(M.analysed_share("a", "v")).first()[0] == pytest.approx(5 / 300)


@pytest.mark.parametrize(
    "name, snake, camel",
    [
        ("Volume Received (mL)", "volume_received_m_l", "VolumeReceivedML"),
        ("v1_ml", "v1_ml", "V1Ml"),
        ("time_pdt", "time_pdt", "TimePdt"),
        ("Life Stage", "life_stage", "LifeStage"),
        ("% Covered", "percent_covered", "PercentCovered"),
        ("2nd", "x2nd", "X2nd"),
    ],
)
def test_clean_name(name, snake, camel):
    assert C.clean_name(name) == snake and C.clean_name(name, "big_camel") == camel


def test_clean_names_are_unique(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["GALD", "gald", "Gald "])
    assert C.clean_names(df).columns == ["gald", "gald_2", "gald_3"]


def test_separate_pads_and_drops(spark, rows):
    df = spark.createDataFrame([("DI-SAV-1",), ("USGS-5",), ("a-b-c-d",), (None,)], "sample string")
    got = C.separate(df, "sample", ["island", "stratum", "site"], keep=True)
    assert rows(got, "island", "stratum", "site") == [
        (None, None, None), ("DI", "SAV", "1"), ("USGS", "5", None), ("a", "b", "c"),
    ]
    assert C.separate(df, "sample", ["sample", "rest"]).columns == ["sample", "rest"]


def test_unite_skips_missing(spark):
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    assert C.unite(df, "id", ["x", "y", "z"], remove=True).collect()[0].asDict() == {"id": "a_c"}


def test_column_choice(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], ["a", "b", "c", "d", "e"])
    assert C.select_cols(df, "a:c", "-b", {"z": "e"}).columns == ["a", "c", "z"]
    assert C.select_cols(df, "-b:d").columns == ["a", "e"]
    assert C.select_at(df, [5, 1]).columns == ["e", "a"]
    assert C.relocate(df, ["d:e"], after="a").columns == ["a", "d", "e", "b", "c"]
    assert C.relocate(df, ["d"], before="b").columns == ["a", "d", "b", "c", "e"]
    assert C.relocate(df, ["e"]).columns == ["e", "a", "b", "c", "d"]
    with pytest.raises(KeyError):
        C.rename(df, {"q": "r"})
    with pytest.raises(IndexError):
        C.select_at(df, [0])
