import random

import pytest
from pyspark.sql import functions as F

from seston.operators import filters as R
from seston.operators import joins as J
from seston.operators import ordering as O
from seston.operators import ranks as K
from seston.operators import reshape as P
from seston.operators import summary as S
from seston.sources.small import small_table


@pytest.fixture
def sides(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    right = spark.createDataFrame([(None, 10), ("a", 20), ("c", 30)], "k string, w int")
    return left, right


def test_missing_keys_match(sides, rows):
    left, right = sides
    assert rows(J.natural_join(left, right)) == [(None, 1, 10), ("a", 2, 20), ("b", 3, None)]
    assert rows(J.natural_join(left, right, "inner")) == [(None, 1, 10), ("a", 2, 20)]
    assert rows(J.natural_join(left, right, "full"), "k", "v", "w") == [
        (None, 1, 10), ("a", 2, 20), ("b", 3, None), ("c", None, 30),
    ]
    assert rows(J.natural_join(left, right, "semi")) == [(None, 1), ("a", 2)]
    assert rows(J.natural_join(left, right, "anti")) == [("b", 3)]


def test_join_refuses_unclear_columns(spark, sides):
    left, right = sides
    with pytest.raises(ValueError):
        J.natural_join(left, right.withColumnRenamed("w", "v"), on=["k"])
    with pytest.raises(ValueError):
        J.natural_join(left, right.toDF("x", "y"))


def test_random_joins_against_dict(spark, rows):
    rng = random.Random(4)
    key = lambda: rng.choice([None, "a", "b", "c", "d"])
    left = [(key(), rng.randint(0, 1) or None, i) for i in range(60)]
    right = [(key(), rng.randint(0, 1) or None, i) for i in range(25)]
    l = spark.createDataFrame(left, "k string, m int, v int")
    r = spark.createDataFrame(right, "k string, m int, w int")
    want = sorted((v, w) for a, b, v in left for c, d, w in right if (a, b) == (c, d))
    got = sorted(tuple(x) for x in J.natural_join(l, r, "inner").select("v", "w").collect())
    assert got == want


@pytest.mark.parametrize("how", ["left", "inner", "full", "semi", "anti"])
def test_joins_stay_equi_joins(spark, sides, how):
    left, right = sides
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = J.natural_join(left, right, how)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("how", ["left", "inner", "full", "semi", "anti"])
def test_hot_keys_are_split_while_running(spark, how):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    key = F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id").cast("string"))
    facts = spark.range(0, 60_000, 1, 8).select(key.alias("k"), F.col("id").alias("v"))
    dim = spark.range(5000).select(key.alias("k"), (F.col("id") * 2).alias("w"))
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        lookup = J.unique_by(dim, ["k"], "first")
        df = J.natural_join(facts, lookup, how).select("v")
        n = len(df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in settings:
            spark.conf.unset(k)
    matched = 20_000 + sum(1 for i in range(5000) if i % 3)
    assert n == {"left": 60_000, "full": 60_000, "inner": matched, "semi": matched, "anti": 60_000 - matched}[how]
    assert "skew=true" in plan


def test_small_tables_are_shipped_whole_by_size(spark):
    big = spark.range(1000).select((F.col("id") % 3).cast("string").alias("k"))
    patch = small_table(spark, [("1", "x")], "k string, v string")
    plan = J.natural_join(big, patch)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_duplicate_lookup_keys(spark, rows):
    df = spark.createDataFrame([("Acartia",), ("Bosmina",)], "genus string")
    dim = spark.createDataFrame([("Acartia", "b"), ("Acartia", "a")], "genus string, family string")
    assert rows(J.join_lookup(df, dim, on_dup="first")) == [("Acartia", "a"), ("Bosmina", None)]
    with pytest.raises(Exception, match="duplicate lookup key"):
        J.join_lookup(df, dim).collect()
    with pytest.raises(Exception, match="duplicate lookup key"):
        J.join_lookup(df, dim, on_dup="distinct").collect()
    same = spark.createDataFrame([("Acartia", "a"), ("Acartia", "a")], "genus string, family string")
    assert rows(J.join_lookup(df, same, on_dup="distinct")) == [("Acartia", "a"), ("Bosmina", None)]
    with pytest.raises(Exception, match="duplicate lookup key"):
        J.join_lookup(df, same).collect()


def test_reconcile(sides, rows):
    assert rows(J.reconcile(*sides, ["k"])) == [(None, "both"), ("a", "both"), ("b", "left"), ("c", "right")]


def test_corrections_may_change_the_key(spark, rows):
    df = spark.createDataFrame([("2018-03-13", 1), ("2018-03-14", 2), (None, 3)], "d string, v int")
    patch = small_table(spark, [("2018-03-13", "2018-03-14")], "d string, right string")
    assert rows(J.apply_corrections(df, patch, ["d"], "d")) == [
        (None, 3), ("2018-03-14", 1), ("2018-03-14", 2),
    ]


def test_fallback_takes_a_row_from_one_source(spark, rows):
    df = spark.createDataFrame([("x y", "x"), ("z w", "z"), ("q r", "q")], "name string, genus string")
    first = spark.createDataFrame([("x y", None, "c1")], "name string, phylum string, class string")
    second = spark.createDataFrame([("x", "p2", "c2"), ("z", "p3", "c3")], "genus string, phylum string, class string")
    got = J.enrich_with_fallback(df, first, second, ["name"], ["genus"])
    assert rows(got, "name", "phylum", "class", "matched") == [
        ("q r", None, None, "none"), ("x y", None, "c1", "primary"), ("z w", "p3", "c3", "fallback"),
    ]


def test_periods(spark, rows):
    df = spark.createDataFrame([("DI", "2017-06-06"), ("DI", "2017-12-01"), ("FC", "2017-06-06")], "i string, d string")
    periods = small_table(
        spark,
        [("DI", "2017-06-06", "2017-09-18", "one"), ("DI", "2017-05-01", "2017-07-01", "two"), ("FC", None, None, "one")],
        "i string, start string, end string, name string",
    )
    assert rows(J.in_period(df, periods, "i", "d")) == [
        ("DI", "2017-06-06", True), ("DI", "2017-12-01", False), ("FC", "2017-06-06", False),
    ]
    assert rows(J.in_period(df, periods, "i", "d", label="name")) == [
        ("DI", "2017-06-06", "one"), ("DI", "2017-06-06", "two"), ("DI", "2017-12-01", None), ("FC", "2017-06-06", None),
    ]


def test_filters(spark, rows):
    df = spark.createDataFrame([("a", 1.0, "5"), (None, 2.0, "< RL"), ("b", None, "7")], "t string, f double, r string")
    assert rows(R.exclude_taxa(df, ["a"], "t"), "t") == [(None,), ("b",)]
    assert R.any_null(df).count() == 2 and R.filter_null(df, "t").count() == 1
    assert R.drop_null(df, ["t"]).count() == 2
    keys = spark.createDataFrame([("a",), (None,)], "t string")
    assert rows(R.keep_in(df, keys), "t") == [(None,), ("a",)]
    assert rows(R.keep_not_in(df, keys), "t") == [("b",)]
    flagged = spark.createDataFrame([(0, "1.5"), (1, "< RL"), (None, "2")], "nd int, r string")
    assert rows(R.drop_nondetects(flagged, "nd", "r")) == [(0, 1.5)]


@pytest.fixture
def gaps(spark):
    return spark.createDataFrame(
        [("some", 1.0), ("some", None), ("all", None), (None, 5.0), ("full", 2.0), ("full", 3.0)], "g string, x double"
    )


def test_missing_values_in_groups(gaps, rows):
    assert rows(S.sum_by(gaps, ["g"], ["x"])) == [(None, 5.0), ("all", 0.0), ("full", 5.0), ("some", 1.0)]
    assert rows(S.sum_by(gaps, ["g"], ["x"], "propagate")) == [
        (None, 5.0), ("all", None), ("full", 5.0), ("some", None),
    ]
    assert rows(S.mean_by(gaps, ["g"], ["x"], drop_null_keys=True)) == [("all", None), ("full", 2.5), ("some", 1.0)]
    assert rows(S.count_by(gaps, ["g"])) == [(None, 1), ("all", 1), ("full", 2), ("some", 2)]
    assert rows(S.null_counts(gaps)) == [("g", 1), ("x", 2)]


def test_replicate_mean(spark, rows):
    df = spark.createDataFrame(
        [("s", "1", "A", 4.0), ("s", "2", "A", 2.0), ("s", "1", "B", 6.0)], "site string, rep string, t string, d double"
    )
    assert rows(S.replicate_mean(df, ["site"], "t", "rep", ["d"])) == [("s", "A", 3.0), ("s", "B", 6.0)]
    assert rows(S.replicate_mean(df, ["site"], "t", "rep", ["d"], "zero")) == [("s", "A", 3.0), ("s", "B", 3.0)]


def test_dependency_audit(spark, rows):
    df = spark.createDataFrame([("m", "A"), ("m", "B"), ("m", "B"), ("n", "A"), ("o", None)], "t string, c string")
    assert rows(S.fd_violations(df, "t", "c")) == [("m", 2, "A", "B")]
    assert rows(S.fd_violation_pairs(df, "t", "c")) == [("m", "A", 1), ("m", "B", 2)]
    assert rows(S.distinct_counts(df, ["t", "c"])) == [("c", 2), ("t", 3)]
    assert rows(S.distinct_counts(df, ["t"], approx=True)) == [("t", 3)]


def test_mismatches(spark, rows):
    df = spark.createDataFrame([(33.0, 50.0), (1.0, 1.0), (None, 2.0)], "a double, b double")
    assert rows(S.mismatch_total(df, "a", "b")) == [(2, -17.0)]
    assert S.mismatch_rows(df, "a", "b").count() == 2


def test_matrix_identities(spark):
    rng = random.Random(1)
    data = [(f"s{rng.randint(0, 9)}", f"t{rng.randint(0, 19)}", float(rng.randint(0, 3))) for _ in range(150)]
    df = spark.createDataFrame(data, "s string, t string, v double")
    fill = S.matrix_fill(df, "s", "t", "v").first()
    cells = len({(s, t) for s, t, v in data if v})
    assert fill["filled"] == cells
    assert S.richness(df, "s", "t", "v").agg(F.sum("richness")).first()[0] == cells
    assert S.occupancy(df, "s", "t", "v").agg(F.sum("n_samples")).first()[0] == cells


@pytest.mark.parametrize(
    "low, high, cells, first, step, last",
    [(1, 50, 10, 0, 5, 50), (0, 1, 5, 0.0, 0.2, 1.0), (3, 97, 4, 0, 20, 100), (5, 5, 5, 2, 1, 8)],
)
def test_round_edges(low, high, cells, first, step, last):
    from seston.functions.numbers import power_of_ten_steps

    edges = power_of_ten_steps(low, high, cells)
    assert edges[0] == pytest.approx(first) and edges[-1] == pytest.approx(last)
    assert edges[1] - edges[0] == pytest.approx(step)


@pytest.mark.parametrize("cells", [3, 100])
def test_histogram_counts_every_value_once(spark, cells):
    values = [float(v) for v in range(0, 101)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    edges = [100.0 * i / cells for i in range(cells + 1)]
    out = S.histogram(df, "x", edges).orderBy("low").collect()
    assert sum(r["n"] for r in out) == 101 and len(out) == cells
    first = out[0]
    assert first["n"] == len([v for v in values if v is not None and v <= first["high"]])


def test_histogram_refuses_values_outside_its_cells(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    with pytest.raises(Exception, match="no cell of the histogram"):
        S.histogram(df, "x", [0.0, 1.0, 2.0]).collect()


def test_samples_where_nothing_was_found_have_richness_zero(spark, rows):
    df = spark.createDataFrame([("a", "x", 0.0), ("a", "y", None), ("b", "x", 2.0)], "s string, t string, v double")
    assert rows(S.richness(df, "s", "t", "v")) == [("a", 0), ("b", 1)]


def test_signed_zeros_are_one_value(spark, rows):
    df = spark.createDataFrame([(0.0, "a"), (-0.0, None), (None, "a")], "x double, `t.u` string")
    assert rows(S.distinct_counts(df, ["x", "t.u"])) == [("t.u", 1), ("x", 1)]


def test_sorting_puts_missing_last(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "x int")
    assert [r[0] for r in O.sort_na_last(df, ["x"]).collect()] == [1, 2, None]
    assert [r[0] for r in O.sort_na_last(df, ["x"], True).collect()] == [2, 1, None]
    assert [r[0] for r in O.sorted_distinct(df.union(df), ["x"]).collect()] == [1, 2, None]


def test_stacking(spark, rows):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([("y", 2)], "v string, k int")
    assert rows(O.rbind(a, b)) == [(1, "x"), (2, "y")]
    assert rows(O.bind_rows(a, b.drop("v")), "k", "v") == [(1, "x"), (2, None)]
    with pytest.raises(ValueError):
        O.rbind(a, b.drop("v"))


def test_first_per_key(spark, rows):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 3), ("a", 5, 2), (None, 1, 9)], "k string, o int, v int")
    assert rows(O.first_per(df, ["k"], ["o"])) == [(None, 1, 9), ("a", 5, 2)]


def test_spread_refuses_two_values_for_a_cell(spark, rows):
    df = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 2.0), ("t", "a", 3.0)], "s string, t string, v double")
    wide = P.spread(df, ["s"], "t", "v")
    assert rows(P.fill_zero(wide, ["a", "b"])) == [("s", 1.0, 2.0), ("t", 3.0, 0.0)]
    twice = df.union(df)
    with pytest.raises(Exception, match="more than one value"):
        P.spread(twice, ["s"], "t", "v").collect()
    assert rows(P.spread(twice, ["s"], "t", "v", on_dup="sum"), "s", "a") == [("s", 2.0), ("t", 6.0)]
    back = P.gather(wide, ["s"], "t", "v").filter("v IS NOT NULL")
    assert rows(back) == rows(df)
    assert rows(P.complete(df, "s", "t", "v")) == [
        ("s", "a", 1.0), ("s", "b", 2.0), ("t", "a", 3.0), ("t", "b", 0.0),
    ]


def five(values):
    x = sorted(values)
    n = len(x)
    depth = ((n + 3) // 2) / 2
    at = lambda p: (x[int(p // 1) - 1] + x[int(-(-p // 1)) - 1]) / 2
    return x[0], at(depth), at((n + 1) / 2), at(n + 1 - depth), x[-1]


@pytest.mark.parametrize(
    "values", [list(range(1, 9)), [3.0], [2, 2, 2, 2], [1, 1, 2, 5, 5, 5, 9], [random.Random(3).gauss(0, 1) for _ in range(501)]]
)
def test_hinges(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    got = K.tukey_five(df, "x", ranges=8).first()
    assert got["n"] == len(values)
    assert tuple(got)[1:] == pytest.approx(five([float(v) for v in values]))


def test_ranks_and_hinges_by_group_with_a_hot_key(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.7 else f"g{rng.randint(0, 20)}", float(rng.randint(0, 40))) for _ in range(2000)]
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(data)], "g string, x double, i int")
    got = {r["i"]: r["rank"] for r in K.avg_rank(df, "x", by=["g"], ranges=16).collect()}
    for i, (g, v) in enumerate(data):
        mine = [x for h, x in data if h == g]
        want = sum(x < v for x in mine) + (sum(x == v for x in mine) + 1) / 2
        assert got[i] == want
    hinges = {r["g"]: tuple(r)[2:] for r in K.tukey_five(df, "x", ["g"], ranges=16).collect()}
    for g in {g for g, _ in data}:
        assert hinges[g] == pytest.approx(five([x for h, x in data if h == g]))


def test_ranges_have_no_single_task_window(spark):
    df = spark.range(1000).select(F.rand(1).alias("x"))
    plan = K.value_positions(df, "x")._jdf.queryExecution().executedPlan().toString()
    assert "__range" in plan and "CartesianProduct" not in plan


def test_shares_and_bounds(spark, rows):
    df = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 3.0), ("z", "a", 0.0)], "s string, p string, v double")
    assert rows(K.share_of(df, "v", ["s"])) == [("s", "a", 1.0, 0.25), ("s", "b", 3.0, 0.75), ("z", "a", 0.0, None)]
    assert rows(K.stack_bounds(df, "v", ["s"], "p"), "s", "p", "lower", "upper") == [
        ("s", "a", 0.0, 1.0), ("s", "b", 1.0, 4.0), ("z", "a", 0.0, 0.0),
    ]


def test_complete_keeps_missing_keys(spark, rows):
    df = spark.createDataFrame([("a", "x", 1), (None, "x", 5), ("a", None, 7)], "s string, t string, v int")
    assert rows(P.complete(df, "s", "t", "v")) == [(None, None, 0), (None, "x", 5), ("a", None, 7), ("a", "x", 1)]


def test_sums_keep_every_digit(spark, rows):
    big = 2**53
    data = [("a", big, "0.1", 1e16), ("a", 1, "0.2", 1.0), ("a", 1, None, -1e16), ("b", None, None, None)]
    df = spark.createDataFrame(data, "k string, n long, d string, x double").withColumn("d", F.col("d").cast("decimal(10,1)"))
    out = S.sum_by(df, ["k"], ["n", "d", "x"], decimals=2)
    assert dict(out.dtypes)["n"] == "bigint" and dict(out.dtypes)["d"].startswith("decimal") and dict(out.dtypes)["x"] == "double"
    got = {r["k"]: (r["n"], float(r["d"]), r["x"]) for r in out.collect()}
    assert got == {"a": (big + 2, 0.3, 1.0), "b": (0, 0.0, 0.0)}
    missing = {r["k"]: r["n"] for r in S.sum_by(df, ["k"], ["n"], na="propagate").collect()}
    assert missing == {"a": big + 2, "b": None}


def test_wide_sums_go_beyond_longs(spark):
    most = 2**63 - 1
    df = spark.createDataFrame([("a", most), ("a", most), ("a", 5), ("b", None), ("c", -most), ("c", -most), ("c", None)], "k string, n long")
    got = {r["k"]: r["n"] for r in S.sum_by(df, ["k"], ["n"], wide=True).collect()}
    assert got == {"a": 2 * most + 5, "b": 0, "c": -2 * most}
    missing = {r["k"]: r["n"] for r in S.sum_by(df, ["k"], ["n"], na="propagate", wide=True).collect()}
    assert missing == {"a": 2 * most + 5, "b": None, "c": None}


def test_exact_sums_of_large_keys(spark, tmp_path):
    import duckdb

    from catalog import ORACLE, QUERIES

    rows = [(1, 9 * 10**8, 7, 10.25), (1, 9 * 10**8, 8, 0.1), (2, 3, 4, 1.005), (None, 9 * 10**8, 9, 2.5)]
    table = str(tmp_path / "lineitem.parquet")
    kinds = "l_suppkey long, l_orderkey long, l_partkey long, l_extendedprice double"
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(table)
    ours = {tuple(r) for r in QUERIES["exact_sums"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{table}/*.parquet'")
        assert ours == set(con.execute(ORACLE["exact_sums"]).fetchall())
