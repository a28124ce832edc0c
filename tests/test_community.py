import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seston.operators import correlation as C
from seston.operators import distance as D
from seston.operators import monotone as M
from seston.operators import ordination as N
from seston.operators import permutation as P
from seston.operators import ranks as K


def matrix(cells):
    samples = sorted({s for s, _, _ in cells})
    taxa = sorted({t for _, t, _ in cells})
    m = np.zeros((len(samples), len(taxa)))
    for s, t, v in cells:
        m[samples.index(s), taxa.index(t)] += v
    return samples, m


def frame(spark, cells):
    return spark.createDataFrame(cells, "sample string, taxon string, v double")


@pytest.fixture(scope="module")
def cells():
    rng = random.Random(7)
    out = []
    for i in range(90):
        for t in range(25):
            if rng.random() < (0.97 if t == 0 else 0.15):
                out.append((f"s{i:02d}", f"t{t}", float(rng.randint(1, 30))))
    return out


@pytest.mark.parametrize("block", [512, 20])
def test_distances_match_the_dense_matrix(spark, cells, block):
    samples, m = matrix(cells)
    df = frame(spark, cells)
    bray = {(r[0], r[1]): r[2] for r in D.bray_curtis(df, "sample", "taxon", "v", block=block).collect()}
    eucl = {(r[0], r[1]): r[2] for r in D.euclidean(df, "sample", "taxon", "v", block=block).collect()}
    assert len(bray) == len(eucl) == len(samples) * (len(samples) - 1) // 2
    for i, j in itertools.combinations(range(len(samples)), 2):
        key = (samples[i], samples[j])
        assert bray[key] == pytest.approx(np.abs(m[i] - m[j]).sum() / (m[i] + m[j]).sum(), abs=1e-12)
        assert eucl[key] == pytest.approx(np.linalg.norm(m[i] - m[j]), abs=1e-9)


def test_samples_sharing_nothing_and_empty_samples(spark, rows):
    df = frame(spark, [("a", "x", 2.0), ("b", "y", 3.0), ("c", "x", 1.0), ("d", "x", 0.0), ("e", "y", 0.0)])
    assert rows(D.bray_curtis(df, "sample", "taxon", "v"), "sample_1", "sample_2", "distance") == [
        ("a", "b", 1.0), ("a", "c", pytest.approx(1 / 3)), ("a", "d", 1.0), ("a", "e", 1.0), ("b", "c", 1.0),
        ("b", "d", 1.0), ("b", "e", 1.0), ("c", "d", 1.0), ("c", "e", 1.0), ("d", "e", None),
    ]
    assert rows(D.bray_curtis(df, "sample", "taxon", "v", only_sharing=True)) == [("a", "c", pytest.approx(1 / 3))]


@pytest.mark.parametrize("taxa", [20, 2000])
def test_a_block_keeps_as_many_numbers_as_cells(taxa):
    rng = np.random.default_rng(3)
    cells = pd.DataFrame({"sample": rng.integers(0, 64, 4000), "taxon": rng.integers(0, taxa, 4000)})
    cells = cells.drop_duplicates(ignore_index=True).assign(value=1.0)
    _, by_taxon = D._rows(cells)
    assert sum(len(v) for _, v in by_taxon.values()) == len(cells)


def test_equal_samples_are_no_distance_apart(spark, rows):
    data = [(s, f"t{i}", 0.1 * i + 1e6) for s in "ab" for i in range(9)] + [("c", f"t{i}", 0.1 * i + 1e6) for i in range(8)]
    data.append(("c", "t8", 0.8 + 1e6 + 0.25))
    out = D.euclidean(spark.createDataFrame(data, "s string, t string, v double"), "s", "t", "v").sort("sample_1", "sample_2")
    assert [r["distance"] for r in out.collect()] == [0.0, pytest.approx(0.25), pytest.approx(0.25)]


def test_blocks_bound_a_task():
    assert D.block_count(700, 8) == 4 and D.block_count(10, 8) == 1
    assert D.block_count(100_000, 8) == math.ceil(100_000 / D.BLOCK)


def test_taxa_are_never_a_shuffle_key(spark, cells):
    plan = D.bray_curtis(frame(spark, cells), "sample", "taxon", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
    assert "hashpartitioning(low_block" in plan


def test_standardisation(spark, cells):
    samples, m = matrix(cells)
    want = m / m.max(axis=0)
    want = want / want.sum(axis=1, keepdims=True)
    taxa = sorted({t for _, t, _ in cells})
    for r in D.wisconsin(frame(spark, cells), "sample", "taxon", "v").collect():
        assert r["v"] == pytest.approx(want[samples.index(r["sample"]), taxa.index(r["taxon"])])
    small = frame(spark, [("a", "x", 4.0), ("b", "x", 9.0)])
    assert sorted(r["v"] for r in D.ordination_input(small, "sample", "taxon", "v").collect()) == [4.0, 9.0]


def planted(spread):
    rng = random.Random(11)
    return [
        (f"s{i}", f"t{t}", max(0.0, (40 if (t < 4) == (i < 6) else 40 - spread) + rng.gauss(0, 4)))
        for i in range(12)
        for t in range(8)
    ]


def dense_tests(cells, group, euclid=False):
    """R2, F of the analysis of variance and R of the similarities, by matrix."""
    samples, m = matrix(cells)
    n = len(samples)
    pairs = list(itertools.combinations(range(n), 2))
    d = np.array([np.linalg.norm(m[i] - m[j]) if euclid else np.abs(m[i] - m[j]).sum() / (m[i] + m[j]).sum() for i, j in pairs])
    g = [group[s] for s in samples]
    sst = (d**2).sum() / n
    ssw = sum(x**2 / g.count(g[i]) for x, (i, j) in zip(d, pairs) if g[i] == g[j])
    k = len(set(g))
    rank = np.array([(d < x).sum() + ((d == x).sum() + 1) / 2 for x in d])
    same = np.array([g[i] == g[j] for i, j in pairs])
    r = (rank[~same].mean() - rank[same].mean()) / (len(d) / 2)
    return 1 - ssw / sst, ((sst - ssw) / (k - 1)) / (ssw / (n - k)), r


@pytest.mark.parametrize("spread, small", [(30, True), (0, False)])
def test_group_tests(spark, spread, small):
    cells = planted(spread)
    group = {f"s{i}": "one" if i < 6 else "two" for i in range(12)}
    pairs = D.bray_curtis(frame(spark, cells), "sample", "taxon", "v")
    groups = spark.createDataFrame(list(group.items()), "sample string, grp string")
    r2, f, r = dense_tests(cells, group)
    a = P.anosim(pairs, groups, "sample", "grp", 199).first()
    assert a["r"] == pytest.approx(r) and a["permutations"] == 199
    t = {x["term"]: x for x in P.permanova(pairs, groups, "sample", "grp", 199).collect()}
    assert t["group"]["r2"] == pytest.approx(r2) and t["group"]["f"] == pytest.approx(f)
    assert t["group"]["df"] == 1 and t["residual"]["df"] == 10 and t["total"]["df"] == 11
    assert t["group"]["sum_sq"] + t["residual"]["sum_sq"] == pytest.approx(t["total"]["sum_sq"])
    for p in (a["p"], t["group"]["p"]):
        assert (p < 0.02) if small else (p > 0.05)


def test_unlisted_pairs_count_as_one(spark):
    rng = random.Random(3)
    cells = [(f"s{i:02d}", f"t{(i * 3 + k * rng.randint(1, 5)) % 30}", float(rng.randint(1, 9))) for i in range(24) for k in range(3)]
    df = frame(spark, cells)
    groups = spark.createDataFrame([(f"s{i:02d}", "abc"[i % 3]) for i in range(24)], "sample string, grp string")
    whole = D.bray_curtis(df, "sample", "taxon", "v")
    part = D.bray_curtis(df, "sample", "taxon", "v", only_sharing=True)
    assert part.count() < whole.count()
    a = P.permanova_series(whole, groups, "sample", "grp", 20).orderBy("perm").collect()
    b = P.permanova_series(part, groups, "sample", "grp", 20, absent=1.0).orderBy("perm").collect()
    assert [x["r2"] for x in a] == pytest.approx([x["r2"] for x in b])
    a = P.anosim_series(whole, groups, "sample", "grp", 20).orderBy("perm").collect()
    b = P.anosim_series(part, groups, "sample", "grp", 20, absent=True).orderBy("perm").collect()
    assert [x["r"] for x in a] == pytest.approx([x["r"] for x in b])


def test_one_group_has_no_statistic(spark):
    pairs = D.bray_curtis(frame(spark, planted(0)), "sample", "taxon", "v")
    groups = spark.createDataFrame([(f"s{i}", "all") for i in range(12)], "sample string, grp string")
    assert tuple(P.anosim(pairs, groups, "sample", "grp", 5).first())[:2] == (None, None)
    t = {x["term"]: x for x in P.permanova(pairs, groups, "sample", "grp", 5).collect()}
    assert t["group"]["f"] is None and t["group"]["p"] is None


def test_published_table_arithmetic():
    assert (0.8076 / 3) / (27.0258 / 238) == pytest.approx(2.3706, abs=1e-3)
    assert 0.8076 / (0.8076 + 27.0258) == pytest.approx(0.02901, abs=1e-4)


def test_free_labels_keep_group_sizes(spark):
    groups = spark.createDataFrame([(f"s{i}", "a" if i < 4 else "b") for i in range(9)], "sample string, grp string")
    labels = P.free_labels(groups, "sample", "grp", 50)
    counts = {(r["perm"], r["group"]): r["count"] for r in labels.groupBy("perm", "group").count().collect()}
    assert all(counts[(p, "a")] == 4 and counts[(p, "b")] == 5 for p in range(51))
    as_drawn = {r["perm"]: tuple(r["l"]) for r in labels.orderBy("perm", "sample").groupBy("perm").agg(F.sort_array(F.collect_list(F.concat("sample", "group"))).alias("l")).collect()}
    assert len(set(as_drawn.values())) > 30


def series(spark, effect):
    rng = random.Random(1)
    bump = [rng.gauss(10, 1) * effect for _ in range(20)]
    cells, rows = [], []
    for b in range(6):
        for t in (1, 2, 3):
            s = f"b{b}t{t}"
            rows.append((s, f"b{b}", t, str(t)))
            cells += [(s, f"sp{k}", rng.gauss(50, 10) + (bump[k] if t == 3 else 0)) for k in range(20)]
    return cells, spark.createDataFrame(rows, "sample string, block string, pos int, time string")


def test_series_labels_only_move_along(spark):
    _, samples = series(spark, 0)
    labels = P.series_labels(samples, "sample", "time", "block", "pos", 40)
    seen = {}
    for r in labels.collect():
        seen.setdefault((r["perm"], r["sample"][:2]), {})[r["sample"][-1]] = r["group"]
    moves = {tuple(v[k] for k in "123") for v in seen.values()}
    assert moves == {("1", "2", "3"), ("2", "3", "1"), ("3", "1", "2")}
    assert all(tuple(seen[(0, f"b{b}")][k] for k in "123") == ("1", "2", "3") for b in range(6))


@pytest.mark.parametrize("effect, small", [(2.0, True), (0.0, False)])
def test_repeated_measures(spark, effect, small):
    cells, samples = series(spark, effect)
    pairs = D.euclidean(frame(spark, cells), "sample", "taxon", "v")
    found = P.permanova_series(pairs, samples, "sample", "time", 299, block_by="block", order="pos")
    r2, f, _ = dense_tests(cells, {r["sample"]: r["time"] for r in samples.collect()}, euclid=True)
    first = found.filter("perm = 0").first()
    assert first["r2"] == pytest.approx(r2) and first["f"] == pytest.approx(f)
    p = P.series_pvalue(found, "r2").first()["p"]
    assert (p < 0.02) if small else (p > 0.05)
    with pytest.raises(ValueError):
        P.permanova_series(pairs, samples, "sample", "time", 9, block_by="block")


def monotone(values):
    """The curve by its definition: the largest, over beginnings, of the smallest mean up to an end."""
    n = len(values)
    return [max(min(sum(values[a : b + 1]) / (b - a + 1) for b in range(x, n)) for a in range(x + 1)) for x in range(n)]


@pytest.mark.parametrize("values", [[1.0, 3.0, 2.0, 4.0, 4.0], [3.0, 2.0, 1.0], [1.0, 2.0, 3.0, -9.0], [5.0], [2.0, 2.0]])
def test_monotone_curve(values):
    sums, weights, first = M.pooled(np.array(values), np.ones(len(values)))
    assert np.repeat(sums / weights, np.diff(np.r_[first, len(values)])) == pytest.approx(monotone(values))


def test_monotone_curve_of_long_slopes():
    values = np.r_[np.arange(500.0), -1e6, np.arange(50.0)]
    sums, weights, first = M.pooled(values, np.ones(len(values)))
    assert len(sums) == 51 and weights[0] == 501 and first[1] == 501


def scattered(spark, rng, n=16):
    at = {f"p{i:02d}": (rng.random(), rng.random()) for i in range(n)}
    pairs = [(a, b, round(math.dist(at[a], at[b]) + rng.choice([0.0, 0.3]) * rng.random(), 1)) for a, b in itertools.combinations(sorted(at), 2)]
    return at, pairs, spark.createDataFrame(pairs, "sample_1 string, sample_2 string, distance double")


@pytest.mark.parametrize("chunk", [None, 12, 1])
def test_shepard_on_single_pairs(spark, chunk):
    """Chunks of a few pairs give the same curve as one; ties follow their distance."""
    at, pairs, df = scattered(spark, random.Random(4))
    scores = spark.createDataFrame([(s, *xy) for s, xy in at.items()], "sample string, axis1 double, axis2 double")
    order = sorted((d, math.dist(at[a], at[b]), a, b) for a, b, d in pairs)
    curve = monotone([e for _, e, _, _ in order])
    want = {(a, b): (d, e, f) for (d, e, a, b), f in zip(order, curve, strict=True)}
    got = N.shepard(df, scores, ["axis1", "axis2"], chunk).collect()
    assert {(r["sample_1"], r["sample_2"]): pytest.approx((r["dissimilarity"], r["distance"], r["fitted"])) for r in got} == want
    total = math.sqrt(sum((e - f) ** 2 for _, e, f in want.values()) / sum(e * e for _, e, _ in want.values()))
    assert N.stress(df, scores, ["axis1", "axis2"], chunk).first()[0] == pytest.approx(total)


def test_incomplete_pairs_are_refused(spark):
    _, pairs, df = scattered(spark, random.Random(4))
    for bad in (df.where("sample_1 <> 'p00' OR sample_2 <> 'p01'"), df.withColumn("distance", F.expr("nullif(distance, 0.5)"))):
        with pytest.raises(ValueError, match="every pair"):
            N.nmds(bad)


def test_procrustes(spark):
    rng = np.random.default_rng(3)
    one = rng.normal(size=(30, 2))
    turn = np.array([[0.6, 0.8], [0.8, -0.6]])
    two = 3.0 * one @ turn + 5.0
    assert N.apart(one, two) == pytest.approx((0.0, 0.0), abs=1e-9)
    two[7] += 1.0
    frame_of = lambda x: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "sample int, axis1 double, axis2 double")
    row = N.procrustes(frame_of(one), frame_of(two), ["axis1", "axis2"]).first()
    assert (row["rmse"], row["largest"]) == pytest.approx(N.apart(one, two)) and row["largest"] > 0.01


def test_ordination_recovers_a_planted_layout(spark):
    rng = random.Random(9)
    at = {f"p{i:02d}": (rng.random(), rng.random()) for i in range(20)}
    pairs = spark.createDataFrame(
        [(a, b, math.dist(at[a], at[b]) ** 1.5) for a, b in itertools.combinations(sorted(at), 2)],
        "sample_1 string, sample_2 string, distance double",
    )
    result = N.nmds(pairs, k=2, at_once=4, tolerance=1e-3)
    table = {r["start"]: r for r in result.stress.collect()}
    lowest = min(r["stress"] for r in table.values())
    assert result.converged and result.agreed and lowest < 0.03
    assert all(r["ended"] and r["stress"] == pytest.approx(min(v for _, s, v in result.history if s == i)) for i, r in table.items())
    got = {r["sample"]: (r["axis1"], r["axis2"]) for r in result.scores.collect()}
    keys = list(itertools.combinations(sorted(at), 2))
    placed = [math.dist(got[a], got[b]) for a, b in keys]
    true = [math.dist(at[a], at[b]) for a, b in keys]
    assert np.corrcoef(placed, true)[0, 1] > 0.98
    assert N.stress(pairs, result.scores, ["axis1", "axis2"]).first()[0] == pytest.approx(lowest, rel=1e-6)
    assert N.site_scores(result, ["a"], "x").columns == ["sample", "axis1", "axis2", "a"]
    short = N.nmds(pairs, k=2, starts=1, max_iter=2)
    assert not short.converged and not short.stress.first()["ended"]


def test_species_scores(spark, rows):
    df = frame(spark, [("a", "x", 1.0), ("b", "x", 3.0), ("a", "y", 2.0), ("b", "z", 0.0)])
    scores = spark.createDataFrame([("a", 0.0), ("b", 4.0)], "sample string, axis1 double")
    assert rows(D.species_scores(scores, df, "sample", "taxon", "v", ["axis1"])) == [("x", 3.0), ("y", 0.0), ("z", None)]


def test_correlation_modes(spark):
    data = [(1.0, 2.0, None), (2.0, 4.1, 1.0), (3.0, 5.9, 5.0), (4.0, 8.2, 2.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    full = {(r["x"], r["y"]): r for r in C.corr_matrix(df, ["a", "b", "c"]).collect()}
    pair = {(r["x"], r["y"]): r for r in C.corr_matrix(df, ["a", "b", "c"], "pairwise").collect()}
    assert full[("a", "b")]["n"] == 3 and pair[("a", "b")]["n"] == 4
    assert full[("a", "a")]["r"] == pytest.approx(1)
    rows_ab = [(x, y) for x, y, _ in data if x is not None]
    assert pair[("a", "b")]["r"] == pytest.approx(np.corrcoef(*zip(*rows_ab))[0, 1])
    same = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, b double")
    assert C.corr_matrix(same, ["a", "b"]).filter("x = 'a' AND y = 'b'").first()["r"] is None


@pytest.mark.parametrize(
    "t, df, p", [(12.706, 1, 0.05), (2.228, 10, 0.05), (2.042, 30, 0.05), (3.169, 10, 0.01), (1.96, 1e6, 0.05), (0.0, 5, 1.0)]
)
def test_t_table(spark, t, df, p):
    row = spark.range(1).select(C.t_two_sided(F.lit(t), F.lit(float(df))).alias("p"), C.t_two_sided(F.lit(-t), F.lit(float(df))).alias("q")).first()
    assert row["p"] == pytest.approx(p, rel=2e-3) and row["q"] == row["p"]


def test_p_of_one_degree_of_freedom(spark):
    """With one degree of freedom p = 1 - 2 atan(t) / pi."""
    df = spark.createDataFrame([(x,) for x in (0.01, 0.5, 1.0, 30.0, 1e6)], "t double")
    for r in df.select("t", C.t_two_sided(F.col("t"), F.lit(1)).alias("p"), C.t_two_sided(F.col("t"), F.lit(0)).alias("none")).collect():
        assert r["p"] == pytest.approx(1 - 2 * math.atan(r["t"]) / math.pi, rel=1e-9, abs=1e-12) and r["none"] is None


@pytest.mark.parametrize("z", [0.5, 1.0, 2.5, 10.0, 171.5, 5e5])
def test_log_gamma(spark, z):
    assert spark.range(1).select(C.log_gamma(F.lit(z))).first()[0] == pytest.approx(math.lgamma(z), rel=1e-12, abs=1e-12)


def test_correlation_p_values(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(float(i), i + rng.gauss(0, 5), rng.gauss(0, 1)) for i in range(40)], "a double, b double, c double")
    got = {(r["x"], r["y"]): r["p"] for r in C.corr_pvalues(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] < 1e-9 and got[("a", "c")] > 0.05


def test_outliers(spark, rows):
    df = spark.createDataFrame([(float(v), 1.0) for v in [1, 2, 3, 4, 5, 6, 7, 8, 30]] + [(None, 1.0)], "x double, y double")
    assert rows(C.outliers(df, "x"), "x") == [(30.0,)]
    masked = C.mask_outliers(df, ["x", "y"])
    assert masked.agg(F.count("x"), F.count("y")).first()[:] == (8, 10)


def test_ellipse_lies_at_the_stated_radius(spark):
    rng = random.Random(6)
    points = [("g", rng.gauss(3, 2), rng.gauss(-1, 1)) for _ in range(40)] + [("few", 1.0, 2.0)] * 3
    df = spark.createDataFrame(points, "g string, x double, y double")
    out = C.group_ellipse(df, "x", "y", ["g"], vertices=20).collect()
    assert {r["g"] for r in out} == {"g"} and len(out) == 20
    data = np.array([p[1:] for p in points if p[0] == "g"])
    inv = np.linalg.inv(np.cov(data.T))
    radius = 39 * (0.05 ** (-2 / 39) - 1)
    for r in out:
        gap = np.array([r["x"], r["y"]]) - data.mean(axis=0)
        assert gap @ inv @ gap == pytest.approx(radius)


def t_fit(data, df_t=5.0, tol=0.01, rounds=25):
    """Reweighting with a weight per point."""
    w, centre = np.ones(len(data)), data.mean(axis=0)
    for k in range(1, rounds + 1):
        gap = data - centre
        scatter = (gap * w[:, None]).T @ gap / w.sum()
        new = (df_t + 2) / (df_t + np.einsum("ij,jk,ik->i", gap, np.linalg.inv(scatter), gap))
        moved, w = np.abs(new - w).max(), new
        centre = w @ data / w.sum()
        if moved < tol:
            break
    return centre, (gap * w[:, None]).T @ gap / len(data), k, moved < tol


def robust_points(spark):
    rng = random.Random(11)
    points = [("g", rng.gauss(3, 2), rng.gauss(-1, 1)) for _ in range(60)] + [("g", 90.0, 70.0)] * 4
    points += [(None, 1e6 + rng.gauss(0, 1), rng.gauss(0, 5)) for _ in range(30)]
    points += [("few", 1.0, 2.0), ("few", 2.0, 1.0), ("line", 1.0, 1.0)]
    points += [("line", float(i), 2.0 * i - 1) for i in range(9)] + [("same", 4.0, 4.0)] * 7
    holes = [("g", None, 1.0), ("g", 1.0, None), ("g", math.nan, 1.0)]
    return points, spark.createDataFrame(points + holes, "g string, x double, y double")


def test_robust_moments_withstand_outliers(spark):
    points, df = robust_points(spark)
    got = {r["g"]: r for r in C.robust_moments(df, "x", "y", ["g"]).collect()}
    assert set(got) == {"g", None}
    for g, r in got.items():
        data = np.array([p[1:] for p in points if p[0] == g])
        centre, scatter, k, converged = t_fit(data)
        assert (r["n"], r["rounds"], r["converged"]) == (len(data), k, converged)
        assert (r["centre_x"], r["centre_y"]) == pytest.approx(tuple(centre), rel=1e-9)
        assert (r["var_x"], r["var_y"], r["cov_xy"]) == pytest.approx((scatter[0, 0], scatter[1, 1], scatter[0, 1]), rel=1e-6)
    plain = {r["g"]: r for r in C.group_moments(df.where("NOT isnan(x)"), "x", "y", ["g"]).collect()}
    assert abs(got["g"]["centre_x"] - 3) < 1 < plain["g"]["centre_x"] - 3
    assert got["g"]["var_x"] < plain["g"]["var_x"] / 10


def test_robust_moments_stop_unsettled(spark):
    points, df = robust_points(spark)
    got = {r["g"]: r for r in C.robust_moments(df, "x", "y", ["g"], rounds=2).collect()}
    assert not got["g"]["converged"] and got["g"]["rounds"] == 2
    whole = C.robust_moments(df.where("g = 'g'"), "x", "y", []).collect()
    assert len(whole) == 1 and whole[0]["n"] == 64 and whole[0]["converged"]
    assert C.robust_moments(df.limit(0), "x", "y", ["g"]).count() == 0


def test_t_ellipse_lies_at_the_stated_radius(spark):
    points, df = robust_points(spark)
    out = [r for r in C.group_t_ellipse(df, "x", "y", ["g"], vertices=20).collect() if r["g"] == "g"]
    centre, scatter, *_ = t_fit(np.array([p[1:] for p in points if p[0] == "g"]))
    assert len(out) == 20
    for r in out:
        gap = np.array([r["x"], r["y"]]) - centre
        assert gap @ np.linalg.inv(scatter) @ gap == pytest.approx(63 * (0.05 ** (-2 / 63) - 1))


def test_summary_of_anosim(spark):
    rng = random.Random(5)
    names = {f"s{i}": "ab"[i % 2] if i < 9 else ("lone" if i == 9 else None) for i in range(11)}
    pairs = [(a, b, rng.randint(1, 20) / 20) for a, b in itertools.combinations(sorted(names), 2)]
    table = spark.createDataFrame(pairs, "sample_1 string, sample_2 string, distance double")
    groups = spark.createDataFrame(list(names.items()), "sample string, g string")
    known = pd.DataFrame([p for p in pairs if names[p[0]] and names[p[1]]], columns=["a", "b", "d"])
    known["rank"] = known["d"].rank()
    known["cls"] = [names[a] if names[a] == names[b] else None for a, b in zip(known["a"], known["b"], strict=True)]
    got = P.anosim_ranks(table, groups, "sample", "g").collect()
    assert {(r["between"], r["g"]) for r in got} == {(True, None), (False, "a"), (False, "b")} and len(got) == 15
    for r in got:
        ranks = known["rank"][known["cls"].isna() if r["between"] else known["cls"] == r["g"]]
        assert r["n"] == len(ranks) and r["rank"] == pytest.approx(np.quantile(ranks, r["prob"]))
    series = P.anosim_series(table, groups, "sample", "g", 49)
    drawn = [r["r"] for r in series.where("perm > 0").collect()]
    for r in P.null_quantiles(series, "r").collect():
        assert r["n"] == 49 and r["r"] == pytest.approx(np.quantile(drawn, r["prob"]))


@pytest.mark.parametrize("n", [1, 2, 7, 1001])
def test_quantiles(spark, n):
    rng = random.Random(n)
    values = [("g", float(rng.randint(1, 60))) for _ in range(n)]
    df = spark.createDataFrame([*values, ("none", None), (None, 2.0), (None, None)], "g string, v double")
    probs = [0.0, 0.1, 0.333, 0.5, 0.975, 1.0]
    got = {(r["g"], r["prob"]): (r["n"], r["v"]) for r in K.quantiles(df, "v", probs, ["g"], 8).collect()}
    assert len(got) == 12 and got[(None, 0.333)] == (1, 2.0)
    for p in probs:
        # a place is kept to a millionth of a row
        assert got[("g", p)] == (n, pytest.approx(np.quantile([v for _, v in values], p), abs=1e-4))
    assert K.quantiles(df.where("g = 'none'"), "v", probs).count() == 0
    with pytest.raises(ValueError, match="probabilities"):
        K.quantiles(df, "v", [1.5])


def test_missing_pairs_are_refused(spark):
    """Labelled samples without distances, and close pairs only."""
    pairs = [(f"s{i}", f"s{j}", abs(i - j) / 10) for i in range(6) for j in range(i + 1, 6)]
    table = spark.createDataFrame(pairs, "sample_1 string, sample_2 string, distance double")
    labels = [(f"s{i}", "a" if i % 2 else "b") for i in range(6)]
    groups = spark.createDataFrame(labels, "sample string, grp string")
    more = spark.createDataFrame([*labels, ("s8", "a"), ("s9", "b")], "sample string, grp string")
    for test in (P.permanova_series, P.anosim_series):
        assert test(table, groups, "sample", "grp", 3).count() == 4
        with pytest.raises(Exception, match="pairs of labelled samples are missing"):
            test(table, more, "sample", "grp", 3).collect()
        with pytest.raises(Exception, match="pairs of labelled samples are missing"):
            test(table.where("distance < 0.4"), groups, "sample", "grp", 3).collect()


def test_perfect_correlation_has_p_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0, -1.0), (2.0, 4.0, -2.0), (3.0, 6.0, -3.0)], "a double, b double, c double")
    assert [r["p"] for r in C.corr_pvalues(df, ["a", "b", "c"]).collect()] == [0.0] * 3


@pytest.mark.parametrize(("measure", "block"), [("bray_curtis", 512), ("euclidean", 512), ("bray_curtis", 4)])
def test_permanova_without_a_pair_table(spark, rows, measure, block):
    rng = random.Random(7)
    cells = [(f"s{i}", f"t{j}", float(rng.randint(1, 9))) for i in range(15) for j in range(6) if j == i % 3 or rng.random() < 0.6]
    df = frame(spark, cells)
    groups = spark.createDataFrame([(f"s{i}", "abc"[i % 3] if i < 13 else None) for i in range(15)], "sample string, g string")
    known = df.where("sample NOT IN ('s13', 's14')")
    pairs = {"bray_curtis": D.bray_curtis, "euclidean": D.euclidean}[measure](known, "sample", "taxon", "v")
    want = P.permanova(pairs, groups, "sample", "g", 49)
    got = P.permanova_of(df, "sample", "taxon", "v", groups, "g", 49, measure=measure, block=block)
    for a, b in zip(rows(want), rows(got), strict=True):
        assert a == pytest.approx(b)
    series = P.permanova_series_of(df, "sample", "taxon", "v", groups, "g", 9, measure=measure, block=block)
    assert "sample_1" not in series._jdf.queryExecution().executedPlan().toString()


def test_labelled_sample_without_cells_is_refused(spark):
    df = frame(spark, [("a", "x", 1.0), ("b", "x", 3.0), ("c", "x", 3.0)])
    groups = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "h"), ("d", "h")], "sample string, g string")
    with pytest.raises(Exception, match="missing"):
        P.permanova_of(df, "sample", "taxon", "v", groups, "g", 9).collect()
