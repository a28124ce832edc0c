import pytest

from seston.durable import Staged, drop_all, shared_folder, stage
from seston.operators import taxa as N
from seston.sources import csv_files as S
from seston.sources.small import small_table

SCHEMA = "sample string, date string, count double, subsamples double, subsample double"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a_2017-08.csv").write_text('﻿"sample","date","count","subsamples"\n"DI-SAV-1",2017-08-30,49,1\n"DI-SAV-1",2017-08-30,NA,2\n')
    (tmp_path / "b_2018-03.csv").write_text("sample,date,count,subsample,extra\nDI_SAV_1,3/14/2018,33.0,1.0,x\n,3/14/2018,< RL,NA,y\n")
    (tmp_path / "c.txt").write_text("sample\nignored\n")
    return tmp_path


def test_drifting_headers_are_matched_by_name(spark, folder, rows):
    df = S.read_csv_dir(spark, f"{folder}/*.csv", SCHEMA)
    assert df.columns == ["sample", "date", "count", "subsamples", "subsample"]
    assert rows(df) == sorted(
        [
            ("DI-SAV-1", "2017-08-30", 49.0, 1.0, None),
            ("DI-SAV-1", "2017-08-30", None, 2.0, None),
            ("DI_SAV_1", "3/14/2018", 33.0, None, 1.0),
            (None, "3/14/2018", None, None, None),
        ],
        key=lambda r: [(v is not None, str(v)) for v in r],
    )


def test_source_and_label(spark, folder, rows):
    df = S.read_csv_dir(spark, f"{folder}/*.csv", SCHEMA, source="source")
    label = S.source_label("source", -11, -5).alias("label")
    assert rows(df.select(label).distinct()) == [("2017-08",), ("2018-03",)]
    one = S.with_source(spark.read.text(f"{folder}/c.txt"))
    assert one.first()["source"].endswith("c.txt")


def test_column_no_file_has(spark, folder):
    df = S.read_csv_dir(spark, f"{folder}/a*.csv", "sample string, depth double")
    assert [r["depth"] for r in df.collect()] == [None, None]
    with pytest.raises(FileNotFoundError):
        S.read_csv_dir(spark, f"{folder}/none*.csv", SCHEMA)


def test_one_table(spark, folder, rows):
    assert rows(S.read_table(spark, f"{folder}/a_2017-08.csv"), "sample", "count") == [
        ("DI-SAV-1", None), ("DI-SAV-1", "49"),
    ]
    typed = S.read_table(spark, f"{folder}/a_2017-08.csv", "sample string, count double")
    assert rows(typed) == [("DI-SAV-1", None), ("DI-SAV-1", 49.0)]


def test_csv_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("a, b", 1.5), (None, None)], "name string, x double")
    S.write_csv(df, f"{tmp_path}/out")
    assert rows(S.read_table(spark, f"{tmp_path}/out", df.schema)) == rows(df)


def test_one_folder_per_key(spark, tmp_path, rows):
    df = spark.range(300).selectExpr("id", "CASE WHEN id < 290 THEN '2017-06' ELSE '2017-07' END AS survey")
    S.write_by(df, "survey", f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/survey=2017-06").count() == 290
    S.write_by(df, ["survey"], f"{tmp_path}/csv", format="csv")
    assert spark.read.csv(f"{tmp_path}/csv/survey=2017-07", header=True).count() == 10


def test_staged_tables(spark, rows):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    kept = Staged(df)
    assert rows(kept.df) == rows(df) and kept.path.startswith(shared_folder(spark))
    assert stage(df.filter("a > 5")).count() == 0
    kept.drop()
    with pytest.raises(Exception):
        spark.read.parquet(kept.path).count()


def test_all_staged_tables_can_be_dropped(spark):
    kept = Staged(spark.range(3))
    drop_all()
    with pytest.raises(Exception):
        spark.read.parquet(kept.path).count()


def test_small_table_types(spark):
    t = small_table(spark, [("a", 1, None), (None, 2, 0.5)], "k string, n long, x double")
    assert [f.dataType.simpleString() for f in t.schema] == ["string", "bigint", "double"]
    assert [tuple(r) for r in t.collect()] == [("a", 1, None), (None, 2, 0.5)]


def test_life_stages(spark, rows):
    df = spark.createDataFrame([("Acartia copepodid",), ("Copepod nauplii",), ("Rotifers",), (None,)], "taxon string")
    assert rows(N.split_stage(df)) == [
        (None, "not_spec"), ("Acartia", "copepodid"), ("Copepod", "nauplii"), ("Rotifers", "not_spec"),
    ]


def test_taxon_and_station_names(spark, rows):
    df = spark.createDataFrame([("Dunhevidia sp.", "DI-SAV_18"), ("Bosmina spp.", "LH_WAT #2")], "t string, s string")
    got = df.select(
        N.normalise_taxon("t", [("Dunhevidia", "Dunhevedia")]), N.normalise_station("s", "_", [("DI_SAV_18", "DI_SAV_1")])
    )
    assert rows(got) == [("Bosmina", "LH_WAT_2"), ("Dunhevedia", "DI_SAV_1")]
    known = spark.createDataFrame([("DI-SAV_18",)], "s string")
    assert rows(N.unknown_stations(df, known, "s")) == [("LH_WAT #2",)]


def test_resolution_order(spark, rows):
    df = spark.createDataFrame(
        [("cf. A b ", "A"), ("C d", "C"), ("A z", "A"), ("Q", "Q"), (None, None)], "name string, genus string"
    )
    taxonomy = spark.createDataFrame([("A y", "A", "p1"), ("C d", "C", "p2")], "name string, genus string, phylum string")
    gaps = spark.createDataFrame([("cf. A b", "A", "p3")], "name string, genus string, phylum string")
    got = N.resolve_taxa(df, taxonomy, gaps, ranks=["phylum"])
    assert rows(got, "genus", "phylum", "resolved_by") == [
        (None, None, "none"), ("A", "p1", "genus"), ("A", "p3", "gaps"), ("C", "p2", "name"), ("Q", None, "none"),
    ]
    assert rows(N.name_mismatches(df.na.drop(), taxonomy)) == [("A z",), ("Q",), ("cf. A b",)]


def test_nearest_names_against_brute_force(spark):
    import random

    rng = random.Random(2)
    ref = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(60)}
    obs = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(60)}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    a = spark.createDataFrame([(x,) for x in obs], "name string")
    b = spark.createDataFrame([(x,) for x in ref], "name string")
    for most in (1, 2):
        got = {r["name"]: (r["edits"], r["nearest"]) for r in N.nearest_name(a, b, max_edits=most).collect()}
        for x in obs:
            best = min((edits(x, y), y) for y in ref)
            assert got[x] == (best if best[0] <= most else (None, None))


def test_rare_taxa_and_rollup(spark, rows):
    df = spark.createDataFrame(
        [("s1", "A", 1.0), ("s2", "A", 2.0), ("s1", "B", 4.0), ("s1", "B", 1.0), ("s1", None, 9.0)], "s string, t string, v double"
    )
    assert rows(N.drop_rare(df, "s", "t", 2), "t").count(("A",)) == 2
    assert N.drop_rare(df, "s", "t", 2).count() == 2
    dim = spark.createDataFrame([("A", "X"), ("B", "X"), ("A", "Y")], "t string, phylum string")
    assert rows(N.rollup_taxon(df, dim, "t", "phylum", ["s"], ["v"])) == [("s1", "X", 6.0), ("s2", "X", 2.0)]
    kept = N.rollup_taxon(df, dim, "t", "phylum", ["s"], ["v"], drop_unknown=False)
    assert ("s1", None, 9.0) in rows(kept)


def test_headers_are_found_in_tasks(spark, folder):
    (folder / "d.csv").write_text("sample,date,count,subsample,extra\n")
    (folder / "empty.csv").write_text("")
    found = S.headers(spark, f"{folder}/*.csv")
    assert {k: len(v) for k, v in found.items()} == {
        ("sample", "date", "count", "subsamples"): 1, ("sample", "date", "count", "subsample", "extra"): 2,
    }


def test_line_breaks_inside_quotes(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text('name,x\n"one\ntwo",1\n"say ""hi""",2\n')
    (tmp_path / "b.csv").write_text("x,name\n3,plain\n")
    want = [("one\ntwo", 1), ("plain", 3), ('say "hi"', 2)]
    assert rows(S.read_csv_dir(spark, f"{tmp_path}/*.csv", "name string, x long", multiline=True)) == want
    assert rows(S.read_table(spark, f"{tmp_path}/a.csv", infer=True, multiline=True)) == [want[0], want[2]]
    df = spark.createDataFrame([('a "quoted"\nname', 1), (None, 2)], "name string, x long")
    S.write_csv(df, f"{tmp_path}/out")
    assert rows(S.read_table(spark, f"{tmp_path}/out", infer=True, multiline=True)) == rows(df)


def test_inferred_types(spark, tmp_path):
    columns = {
        "whole": (["1", "-20", "NA", " 3 "], "bigint"), "part": (["1", "2.5", "", "1e-3"], "double"),
        "code": (["007", "012", "3", "4"], "string"), "flag": (["TRUE", "f", "NA", "true"], "boolean"),
        "day": (["2017-08-30", "2018-02-28", "NA", ""], "date"), "no_day": (["2017-08-30", "2017-02-30", "", ""], "string"),
        "time": (["2017-08-30 10:00", "2017-08-30T10:00:59.5", "", "NA"], "timestamp"),
        "mixed": (["1", "2017-08-30", "", ""], "string"), "none": (["NA", "", "NA", ""], "string"),
        "huge": (["12345678901234567890", "1", "", ""], "double"), "text": (["a", "1", "T", ""], "string"),
    }
    names = list(columns)
    lines = [",".join(names)] + [",".join(columns[c][0][i] for c in names) for i in range(4)]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    df = S.read_table(spark, f"{tmp_path}/t.csv", infer=True)
    assert dict(df.dtypes) == {c: kind for c, (_, kind) in columns.items()}
    got = df.collect()
    assert [r["whole"] for r in got] == [1, -20, None, 3] and [r["flag"] for r in got] == [True, False, None, True]
    assert got[0]["code"] == "007" and str(got[1]["day"]) == "2018-02-28" and got[1]["time"].second == 59
    (tmp_path / "no_rows.csv").write_text("a,b\n")
    assert S.read_table(spark, f"{tmp_path}/no_rows.csv", infer=True).dtypes == [("a", "string"), ("b", "string")]
