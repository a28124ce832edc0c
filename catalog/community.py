"""Distances, ordination, permutation tests, correlation and outliers.

Samples are sites by surveys, so their number and that of their pairs is set
by the monitoring design; the line items behind each sample grow with the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import OBS, observations, query
from catalog.columns import GAPPY, gappy
from seston.durable import stage
from seston.operators import correlation as C
from seston.operators import distance as D
from seston.operators import ordination as N
from seston.operators import permutation as P
from seston.operators import ranks as K
from seston.operators import summary as S
from seston.operators.taxa import rollup_taxon

PERMS = 999
# repeated measures
SHIFTS = 1999
CELLS = f"""{OBS},
cells AS (SELECT sample, taxon, sum(density) AS v FROM obs GROUP BY ALL),
tot AS (SELECT sample, sum(v) AS s FROM cells GROUP BY ALL)"""
BRAY = f"""{CELLS},
shared AS (SELECT a.sample AS s1, b.sample AS s2, sum(least(a.v, b.v)) AS m
  FROM cells a JOIN cells b ON a.taxon = b.taxon AND a.sample < b.sample GROUP BY ALL),
pairs AS (SELECT a.sample AS s1, b.sample AS s2, 1 - 2 * coalesce(m, 0) / (a.s + b.s) AS d
  FROM tot a JOIN tot b ON a.sample < b.sample LEFT JOIN shared ON s1 = a.sample AND s2 = b.sample)"""
GROUPS = "grp AS (SELECT DISTINCT sample, site, survey, substr(survey, 5) AS season, stratum FROM obs)"
FREE = f"""drawn AS (SELECT perm, sample, stratum FROM grp, generate_series(1, {PERMS}) g(perm)),
dealt AS (SELECT perm, sample, row_number() OVER (PARTITION BY perm ORDER BY md5(perm || '|' || sample), sample) AS k FROM drawn),
deck AS (SELECT perm, stratum, row_number() OVER (PARTITION BY perm ORDER BY stratum, sample) AS k FROM drawn),
labels AS (SELECT 0 AS perm, sample, stratum AS g FROM grp
  UNION ALL SELECT perm, sample, stratum FROM dealt JOIN deck USING (perm, k))"""
SERIES = f"""placed AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY survey, sample) - 1 AS k,
    count(*) OVER (PARTITION BY site) AS n FROM grp),
moved AS (SELECT perm, sample, site, (k + CASE WHEN perm = 0 THEN 0 ELSE
    CAST('0x' || substr(md5(perm || '|' || site), 1, 8) AS BIGINT) % n END) % n AS k
  FROM placed, generate_series(0, {SHIFTS}) g(perm)),
labels AS (SELECT perm, m.sample, p.season AS g FROM moved m JOIN placed p ON p.site = m.site AND p.k = m.k)"""
SQUARES = """sizes AS (SELECT g, count(*) AS m FROM labels WHERE perm = 0 GROUP BY g),
design AS (SELECT sum(m) AS n, count(*) AS k FROM sizes),
total AS (SELECT sum(d * d) / any_value(n) AS sst FROM pairs, design),
inside AS (SELECT a.perm, sum(d * d / m) AS ssw FROM pairs JOIN labels a ON a.sample = s1
  JOIN labels b ON b.sample = s2 AND b.perm = a.perm AND b.g = a.g JOIN sizes ON sizes.g = a.g GROUP BY a.perm),
series AS (SELECT perm, ssw, sst, 1 - ssw / sst AS r2, ((sst - ssw) / (k - 1)) / (ssw / (n - k)) AS f, k, n
  FROM inside, total, design)"""
TABLE = """one AS (SELECT *, (SELECT count(*) FROM series s WHERE s.r2 >= o.r2 - 1.5e-8) / (SELECT count(*) FROM series) AS p
  FROM series o WHERE perm = 0)
SELECT 'group' AS term, CAST(k - 1 AS BIGINT) AS df, round(sst - ssw, 6) AS sum_sq, round(r2, 6) AS r2, round(f, 5) AS f,
  round(p, 6) AS p FROM one
UNION ALL SELECT 'residual', CAST(n - k AS BIGINT), round(ssw, 6), round(1 - r2, 6), NULL, NULL FROM one
UNION ALL SELECT 'total', CAST(n - 1 AS BIGINT), round(sst, 6), 1.0, NULL, NULL FROM one"""


def cells(t):
    return observations(t), "sample", "taxon", "density"


def bray(t):
    return D.bray_curtis(*cells(t))


def groups(t):
    return (
        observations(t)
        .select("sample", "site", "survey", F.substring("survey", 5, 2).alias("season"), "stratum")
        .distinct()
    )


@query("bray_curtis", f"WITH {BRAY} SELECT s1 AS sample_1, s2 AS sample_2, round(d, 9) AS distance FROM pairs")
def _(t):
    return bray(t).withColumn("distance", F.round("distance", 9))


EUCLID = f"""{CELLS}, taxa AS (SELECT DISTINCT taxon FROM cells),
wide AS (SELECT tot.sample, list(coalesce(v, 0) ORDER BY taxa.taxon) AS x FROM tot CROSS JOIN taxa
  LEFT JOIN cells ON cells.sample = tot.sample AND cells.taxon = taxa.taxon GROUP BY tot.sample),
pairs AS (SELECT a.sample AS s1, b.sample AS s2, list_distance(a.x, b.x) AS d FROM wide a JOIN wide b ON a.sample < b.sample)"""


@query(
    "euclidean_distance",
    f"WITH {EUCLID} SELECT s1 AS sample_1, s2 AS sample_2, round(d, 6) AS distance FROM pairs",
)
def _(t):
    return D.euclidean(*cells(t)).withColumn("distance", F.round("distance", 6))


WISCONSIN = """, top AS (SELECT taxon, max(v) AS t FROM base GROUP BY taxon),
  scaled AS (SELECT sample, taxon, v / t AS v FROM base JOIN top USING (taxon)),
  mass AS (SELECT sample, sum(v) AS m FROM scaled GROUP BY sample)
  SELECT sample, taxon, round(v / m, 9) AS density FROM scaled JOIN mass USING (sample)"""


@query("wisconsin", f"WITH {CELLS}, base AS (SELECT * FROM cells)" + WISCONSIN)
def _(t):
    return D.wisconsin(*cells(t)).withColumn("density", F.round("density", 9))


@query(
    "square_root",
    f"WITH {CELLS} SELECT sample, taxon, round(sqrt(v), 9) AS density FROM cells",
)
def _(t):
    return D.sqrt_transform(D.community(*cells(t)), "density").withColumn("density", F.round("density", 9))


@query(
    "ordination_input",
    f"""WITH {CELLS}, top0 AS (SELECT max(v) AS m FROM cells),
    base AS (SELECT sample, taxon, CASE WHEN m > 50 THEN sqrt(v) ELSE v END AS v FROM cells, top0)"""
    + WISCONSIN,
)
def _(t):
    return D.ordination_input(*cells(t)).withColumn("density", F.round("density", 9))


# sites by seasons: few enough samples that SQL can look at every run of pairs
SEASONS = BRAY.replace(
    "cells AS (", "seasons AS (SELECT * REPLACE (site || '_' || substr(survey, 5) AS sample) FROM obs),\ncells AS (", 1
).replace("FROM obs GROUP BY ALL),\ntot", "FROM seasons GROUP BY ALL),\ntot", 1)


def seasons(t):
    return observations(t).withColumn("sample", F.concat_ws("_", "site", F.substring("survey", 5, 2)))


def season_pairs(t):
    pairs = D.bray_curtis(seasons(t), "sample", "taxon", "density")
    return stage(pairs.withColumn("distance", F.round("distance", 9)))


def season_ordination(t):
    pairs = season_pairs(t)
    return pairs, N.nmds(pairs, k=3, starts=6, at_once=6, max_iter=300, tolerance=1e-3)


@query("nmds_scores")
def _(t):
    _, result = season_ordination(t)
    lowest = result.stress.agg(F.min("stress")).scalar()
    scores = N.site_scores(result, ["site", "season"]).withColumn("stress", lowest)
    return scores.withColumn("converged", F.lit(result.converged))


@query(
    "nmds_facts",
    f"""WITH {SEASONS} SELECT count(DISTINCT sample) AS samples, 0.0 AS centre, 1.0 AS mean_square, true AS ended,
      true AS same_stress, true AS lowest, true AS ordered FROM cells""",
)
def _(t):
    """What must hold of any finished ordination: its scores are centred and of
    unit mean square, every start ended by itself, the stress told is that of
    the scores and the lowest of all starts, and the axes are ordered by spread."""
    pairs, result = season_ordination(t)
    axes = ["axis1", "axis2", "axis3"]
    facts = result.scores.agg(
        F.count(F.lit(1)).alias("samples"),
        F.round(F.greatest(*[F.abs(F.avg(a)) for a in axes]), 6).alias("centre"),
        F.round(sum((F.avg(F.col(a) * F.col(a)) for a in axes), F.lit(0.0)) / 3, 6).alias("mean_square"),
        ((F.var_pop("axis1") >= F.var_pop("axis2")) & (F.var_pop("axis2") >= F.var_pop("axis3"))).alias("ordered"),
    )
    told = result.stress.agg(F.bool_and("ended").alias("ended"), F.min("stress").alias("least"))
    again = N.stress(pairs, result.scores, axes)
    first = min(v for step, _, v in result.history if step == 0)
    return facts.crossJoin(told).crossJoin(again).select(
        "samples", "centre", "mean_square", "ended", (F.abs(F.col("stress") - F.col("least")) < 1e-9).alias("same_stress"),
        (F.col("least") < F.lit(first)).alias("lowest"), "ordered",
    )


def _config(source: str) -> str:
    return f"config AS (SELECT sample, avg(volume) / 1000 AS axis1, sum(density) / 100 AS axis2 FROM {source} GROUP BY sample)"


CONFIG = _config("obs")


def configuration(observed):
    return observed.groupBy("sample").agg((F.avg("volume") / 1000).alias("axis1"), (F.sum("density") / 100).alias("axis2"))


# the curve by its definition: the largest, over beginnings, of the smallest mean up to an end
CURVE = f"""{SEASONS}, {_config("seasons")},
apart AS (SELECT s1, s2, round(d, 9) AS d, sqrt(pow(a.axis1 - b.axis1, 2) + pow(a.axis2 - b.axis2, 2)) AS e
  FROM pairs JOIN config a ON a.sample = s1 JOIN config b ON b.sample = s2),
placed AS (SELECT *, row_number() OVER o AS x, sum(e) OVER (o ROWS UNBOUNDED PRECEDING) AS upto FROM apart WINDOW o AS (ORDER BY d, e, s1, s2)),
runs AS (SELECT a.x AS lo, b.x AS hi, (b.upto - a.upto + a.e) / (b.x - a.x + 1) AS m FROM placed a JOIN placed b ON a.x <= b.x),
ends AS (SELECT lo, hi, min(m) OVER (PARTITION BY lo ORDER BY hi DESC ROWS UNBOUNDED PRECEDING) AS m FROM runs),
fit AS (SELECT hi AS x, max(m) AS fitted FROM ends GROUP BY hi)"""


@query(
    "stress_of_configuration",
    f"WITH {CURVE} SELECT round(sqrt(sum(pow(e - fitted, 2)) / sum(e * e)), 6) AS stress FROM placed JOIN fit USING (x)",
)
def _(t):
    out = N.stress(season_pairs(t), configuration(seasons(t)), ["axis1", "axis2"])
    return out.select(F.round("stress", 6).alias("stress"))


@query(
    "shepard_table",
    f"""WITH {CURVE} SELECT s1 AS sample_1, s2 AS sample_2, d AS dissimilarity, round(e, 6) AS distance,
      round(fitted, 6) AS fitted FROM placed JOIN fit USING (x)""",
)
def _(t):
    out = N.shepard(season_pairs(t), configuration(seasons(t)), ["axis1", "axis2"])
    return out.select(
        "sample_1",
        "sample_2",
        "dissimilarity",
        F.round("distance", 6).alias("distance"),
        F.round("fitted", 6).alias("fitted"),
    )


@query(
    "species_scores",
    f"""WITH {CELLS}, {CONFIG} SELECT taxon, round(sum(v * axis1) / sum(v), 6) AS axis1,
      round(sum(v * axis2) / sum(v), 6) AS axis2 FROM cells JOIN config USING (sample) GROUP BY taxon""",
)
def _(t):
    out = D.species_scores(configuration(observations(t)), *cells(t), ["axis1", "axis2"])
    return out.select("taxon", F.round("axis1", 6).alias("axis1"), F.round("axis2", 6).alias("axis2"))


@query("free_permutations", f"WITH {OBS}, {GROUPS}, {FREE} SELECT perm, sample, g AS \"group\" FROM labels")
def _(t):
    return P.free_labels(groups(t), "sample", "stratum", PERMS)


@query("series_permutations", f"WITH {OBS}, {GROUPS}, {SERIES} SELECT perm, sample, g AS \"group\" FROM labels")
def _(t):
    return P.series_labels(groups(t), "sample", "season", "site", "survey", SHIFTS)


ANOSIM = f"""WITH {BRAY}, {GROUPS}, {FREE},
ranked AS (SELECT s1, s2, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS r FROM pairs),
whole AS (SELECT sum(r) AS w, count(*) AS m FROM ranked),
inside AS (SELECT a.perm, sum(r) AS w, count(*) AS m FROM ranked JOIN labels a ON a.sample = s1
  JOIN labels b ON b.sample = s2 AND b.perm = a.perm AND b.g = a.g GROUP BY a.perm),
series AS (SELECT perm, ((whole.w - i.w) / (whole.m - i.m) - i.w / i.m) / (whole.m / 2.0) AS r FROM inside i, whole)"""


@query("anosim_series", f"{ANOSIM} SELECT perm, round(r, 8) AS r FROM series")
def _(t):
    out = P.anosim_series(stage(bray(t)), stage(groups(t)), "sample", "stratum", PERMS)
    return out.select("perm", F.round("r", 8).alias("r"))


@query(
    "anosim",
    f"""{ANOSIM} SELECT round(o.r, 8) AS r, (SELECT count(*) FROM series s WHERE s.r >= o.r - 1.5e-8)
      / (SELECT count(*) FROM series) AS p, CAST({PERMS} AS BIGINT) AS permutations FROM series o WHERE perm = 0""",
)
def _(t):
    out = P.anosim(stage(bray(t)), stage(groups(t)), "sample", "stratum", PERMS)
    return out.withColumn("r", F.round("r", 8))


@query(
    "anosim_ranks",
    f"""{ANOSIM}, cls AS (SELECT a.stratum <> b.stratum AS between, CASE WHEN a.stratum = b.stratum THEN a.stratum END AS stratum, r
      FROM ranked JOIN grp a ON a.sample = s1 JOIN grp b ON b.sample = s2)
    SELECT between, stratum, CAST(p AS DOUBLE) AS prob, count(*) AS n, round(CASE p WHEN 0 THEN quantile_cont(r, 0)
        WHEN 0.25 THEN quantile_cont(r, 0.25) WHEN 0.5 THEN quantile_cont(r, 0.5) WHEN 0.75 THEN quantile_cont(r, 0.75)
        ELSE quantile_cont(r, 1) END, 4) AS rank
    FROM cls, (VALUES (0), (0.25), (0.5), (0.75), (1)) v(p) GROUP BY between, stratum, p""",
)
def _(t):
    out = P.anosim_ranks(stage(bray(t)), stage(groups(t)), "sample", "stratum")
    return out.withColumn("rank", F.round("rank", 4))


@query(
    "anosim_null_quantiles",
    f"""{ANOSIM} SELECT CAST(p AS DOUBLE) AS prob, count(*) AS n, round(CASE p WHEN 0.9 THEN quantile_cont(r, 0.9)
      WHEN 0.95 THEN quantile_cont(r, 0.95) WHEN 0.975 THEN quantile_cont(r, 0.975) ELSE quantile_cont(r, 0.99) END, 7) AS r
    FROM series, (VALUES (0.9), (0.95), (0.975), (0.99)) v(p) WHERE perm > 0 GROUP BY p""",
)
def _(t):
    series = stage(P.anosim_series(stage(bray(t)), stage(groups(t)), "sample", "stratum", PERMS))
    return P.null_quantiles(series, "r").withColumn("r", F.round("r", 7))


def rounded_table(table):
    return table.select(
        "term",
        "df",
        F.round("sum_sq", 6).alias("sum_sq"),
        F.round("r2", 6).alias("r2"),
        F.round("f", 5).alias("f"),
        F.round("p", 6).alias("p"),
    )


@query("permanova", f"WITH {BRAY}, {GROUPS}, {FREE}, {SQUARES}, {TABLE}")
def _(t):
    return rounded_table(P.permanova_of(*cells(t), stage(groups(t)), "stratum", PERMS))


@query("repeated_measures_permanova", f"WITH {BRAY}, {GROUPS}, {SERIES}, {SQUARES}, {TABLE}")
def _(t):
    return rounded_table(
        P.permanova_of(*cells(t), stage(groups(t)), "season", SHIFTS, block_by="site", order="survey")
    )


@query(
    "repeated_measures_euclidean",
    f"""WITH {EUCLID}, {GROUPS}, {SERIES}, {SQUARES}, result AS (WITH {TABLE})
    SELECT term, df, r2, f, p FROM result""",
)
def _(t):
    test = P.permanova_of(
        *cells(t), stage(groups(t)), "season", SHIFTS, block_by="site", order="survey", measure="euclidean"
    )
    # sums of squares of raw densities are too large for a fixed number of decimals
    return rounded_table(test).select("term", "df", "r2", "f", "p")


@query(
    "repeated_measures_series",
    f"WITH {BRAY}, {GROUPS}, {SERIES}, {SQUARES} SELECT perm, round(r2, 8) AS r2, round(f, 5) AS f FROM series",
)
def _(t):
    out = P.permanova_series(
        bray(t), stage(groups(t)), "sample", "season", SHIFTS, block_by="site", order="survey"
    )
    return out.select("perm", F.round("r2", 8).alias("r2"), F.round("f", 5).alias("f"))


@query(
    "null_distribution",
    # steps of 1, 2, 5 or 10 powers of ten: the coarser ones while they are preferred
    f"""WITH {BRAY}, {GROUPS}, {SERIES}, {SQUARES},
    span AS (SELECT min(r2) AS lo, max(r2) AS hi, (max(r2) - min(r2)) / ceil(log2(count(r2)) + 1) AS c FROM series),
    base AS (SELECT *, pow(10, floor(log10(c))) AS b FROM span),
    step AS (SELECT *, b * CASE WHEN 2 * b - c >= 1.5 * (c - b) THEN 1 WHEN 5 * b - c >= 2.75 * (c - 2 * b) THEN 2
      WHEN 10 * b - c >= 1.5 * (c - 5 * b) THEN 5 ELSE 10 END AS s FROM base),
    cell AS (SELECT unnest(generate_series(CAST(floor(lo / s + 1e-7) AS BIGINT),
      CAST(ceil(hi / s - 1e-7) AS BIGINT) - 1)) AS i, s FROM step)
    SELECT round(i * s, 9) AS low, round((i + 1) * s, 9) AS high, count(r2) AS n FROM cell
      LEFT JOIN series ON r2 > i * s + 1e-7 * s AND r2 <= (i + 1) * s + 1e-7 * s GROUP BY ALL""",
)
def _(t):
    series = stage(
        P.permanova_series(bray(t), stage(groups(t)), "sample", "season", SHIFTS, block_by="site", order="survey")
    )
    out = S.histogram(series, "r2")
    return out.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "n")


MEASURED = ["a", "b", "c"]
CORR = "UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) AS n, "
    f"round(corr({x}, {y}), 6) AS r FROM {{}} "
    for i, x in enumerate(MEASURED)
    for y in MEASURED[i:]
)


@query(
    "correlation_complete",
    f"WITH {GAPPY}, k AS (SELECT * FROM gappy WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL) "
    + CORR.replace("{}", "k"),
)
def _(t):
    return C.corr_matrix(gappy(t), MEASURED).withColumn("r", F.round("r", 6))


@query("correlation_pairwise", f"WITH {GAPPY} " + CORR.replace("{}", "gappy"))
def _(t):
    return C.corr_matrix(gappy(t), MEASURED, "pairwise").withColumn("r", F.round("r", 6))


@query(
    "correlation_tests",
    f"""WITH {GAPPY}, k AS (SELECT 'a' AS x, 'b' AS y, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n,
        corr(a, b) AS r FROM gappy
      UNION ALL SELECT 'a', 'c', count(*) FILTER (a IS NOT NULL AND c IS NOT NULL), corr(a, c) FROM gappy
      UNION ALL SELECT 'b', 'c', count(*) FILTER (b IS NOT NULL AND c IS NOT NULL), corr(b, c) FROM gappy)
    SELECT x, y, n, round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 5) AS t FROM k""",
)
def _(t):
    out = C.corr_tests(gappy(t), MEASURED)
    return out.select("x", "y", "n", F.round("r", 6).alias("r"), F.round("t", 5).alias("t"))


# two-sided p: the part of the area under cos^(df - 1) beyond the angle of t, by Simpson's rule
@query(
    "correlation_p_values",
    f"""WITH {GAPPY}, k AS (SELECT 'a' AS x, 'b' AS y, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n,
        corr(a, b) AS r FROM gappy
      UNION ALL SELECT 'a', 'c', count(*) FILTER (a IS NOT NULL AND c IS NOT NULL), corr(a, c) FROM gappy
      UNION ALL SELECT 'b', 'c', count(*) FILTER (b IS NOT NULL AND c IS NOT NULL), corr(b, c) FROM gappy),
    ts AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM k),
    points AS (SELECT *, CASE WHEN i IN (0, 100000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w, atan(abs(t) / sqrt(n - 2)) AS from_
      FROM ts, generate_series(0, 100000) g(i)),
    areas AS (SELECT x, y, (pi() / 2 - any_value(from_)) * sum(w * pow(greatest(cos(from_ + (pi() / 2 - from_) * i / 100000), 0), n - 3)) AS beyond,
      pi() / 2 * sum(w * pow(greatest(cos(pi() / 2 * i / 100000), 0), n - 3)) AS whole FROM points GROUP BY x, y)
    SELECT x, y, n, round(r, 6) AS r, round(t, 5) AS t, round(beyond / whole, 6) AS p FROM ts JOIN areas USING (x, y)""",
)
def _(t):
    out = C.corr_pvalues(gappy(t), MEASURED)
    return out.select("x", "y", "n", *[F.round(c, d).alias(c) for c, d in (("r", 6), ("t", 5), ("p", 6))])


FENCE = """f AS (SELECT lh - 1.5 * (uh - lh) AS lo, uh + 1.5 * (uh - lh) AS hi FROM (
  SELECT (max(x) FILTER (r = floor(d)) + max(x) FILTER (r = ceil(d))) / 2 AS lh,
    (max(x) FILTER (r = floor(n + 1 - d)) + max(x) FILTER (r = ceil(n + 1 - d))) / 2 AS uh FROM (
    SELECT value AS x, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n,
      floor((count(*) OVER () + 3) / 2) / 2 AS d FROM events)))"""


@query(
    "outliers",
    f"WITH {FENCE} SELECT event_id, value FROM events, f WHERE value < lo OR value > hi",
)
def _(t):
    return C.outliers(t.events.select("event_id", "value"), "value")


@query(
    "masked_outliers",
    f"WITH {FENCE} SELECT event_id, CASE WHEN value BETWEEN lo AND hi THEN value END AS value FROM events, f",
)
def _(t):
    return C.mask_outliers(t.events.select("event_id", "value"), ["value"])


MOMENTS = """m AS (SELECT event_type, count(*) AS n, avg(user_id) AS cx, avg(value) AS cy, var_samp(user_id) AS vx,
  var_samp(value) AS vy, covar_samp(user_id, value) AS c FROM events GROUP BY event_type)"""


@query(
    "group_moments",
    f"""WITH {MOMENTS} SELECT event_type, n, round(cx, 5) AS centre_x, round(cy, 5) AS centre_y, round(vx, 4) AS var_x,
      round(vy, 4) AS var_y, round(c, 4) AS cov_xy FROM m""",
)
def _(t):
    out = C.group_moments(t.events, "user_id", "value", ["event_type"])
    return out.select(
        "event_type",
        "n",
        F.round("centre_x", 5).alias("centre_x"),
        F.round("centre_y", 5).alias("centre_y"),
        *[F.round(c, 4).alias(c) for c in ("var_x", "var_y", "cov_xy")],
    )


@query(
    "group_ellipse",
    f"""WITH {MOMENTS}, r AS (SELECT *, sqrt((n - 1.0) * (pow(0.05, -2.0 / (n - 1)) - 1)) AS r, sqrt(vx) AS a,
        c / sqrt(vx) AS b, sqrt(vy - c * c / vx) AS e FROM m)
    SELECT event_type, CAST(k AS INT) AS vertex, round(cx + r * a * cos(k * 2 * pi() / 51), 4) AS user_id,
      round(cy + r * (b * cos(k * 2 * pi() / 51) + e * sin(k * 2 * pi() / 51)), 4) AS value
    FROM r, generate_series(0, 51) g(k)""",
)
def _(t):
    out = C.group_ellipse(t.events, "user_id", "value", ["event_type"])
    return out.select(
        "event_type", "vertex", F.round("user_id", 4).alias("user_id"), F.round("value", 4).alias("value")
    )


def _t_rounds(rounds: int) -> str:
    """Robust centre and scatter, unrolled: every point carries its weight."""
    ctes = ["""p0 AS MATERIALIZED (SELECT event_type AS g, CAST(user_id AS DOUBLE) AS x, CAST(value AS DOUBLE) AS y,
  CAST(1 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS cx, CAST(0 AS DOUBLE) AS cy, CAST(0 AS DOUBLE) AS lx,
  CAST(0 AS DOUBLE) AS ly, false AS done, 0 AS k FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL)""",
    """a0 AS MATERIALIZED (SELECT g, avg(x) AS cx, avg(y) AS cy FROM p0 GROUP BY g),
b0 AS MATERIALIZED (SELECT g, x, y, w, a0.cx, a0.cy, a0.cx AS lx, a0.cy AS ly, done, k FROM p0 JOIN a0 USING (g))"""]
    for k in range(1, rounds + 1):
        ctes.append(f"""s{k} AS MATERIALIZED (SELECT g, sum(w * (x - cx) * (x - cx)) / sum(w) AS sxx,
  sum(w * (y - cy) * (y - cy)) / sum(w) AS syy, sum(w * (x - cx) * (y - cy)) / sum(w) AS sxy FROM b{k - 1} GROUP BY g),
w{k} AS MATERIALIZED (SELECT b.*, CASE WHEN done THEN w ELSE 7 / (5 + (syy * (x - cx) ** 2 - 2 * sxy * (x - cx) * (y - cy)
  + sxx * (y - cy) ** 2) / (sxx * syy - sxy * sxy)) END AS v FROM b{k - 1} b JOIN s{k} USING (g)),
c{k} AS MATERIALIZED (SELECT g, sum(v * x) / sum(v) AS nx, sum(v * y) / sum(v) AS ny, max(abs(v - w)) < 0.01 AS ok FROM w{k} GROUP BY g),
b{k} AS MATERIALIZED (SELECT g, x, y, v AS w, CASE WHEN done THEN cx ELSE nx END AS cx, CASE WHEN done THEN cy ELSE ny END AS cy,
  CASE WHEN done THEN lx ELSE cx END AS lx, CASE WHEN done THEN ly ELSE cy END AS ly, done OR ok AS done,
  CASE WHEN done THEN k ELSE {k} END AS k FROM w{k} JOIN c{k} USING (g))""")
    ctes.append(f"""fit AS MATERIALIZED (SELECT g AS event_type, count(*) AS n, any_value(cx) AS cx, any_value(cy) AS cy,
  sum(w * (x - lx) ** 2) / count(*) AS vx, sum(w * (y - ly) ** 2) / count(*) AS vy, sum(w * (x - lx) * (y - ly)) / count(*) AS c,
  any_value(k) AS rounds, any_value(done) AS converged FROM b{rounds} GROUP BY g)""")
    return ",\n".join(ctes)


T_ROUNDS = 25


@query(
    "robust_moments",
    f"""WITH {_t_rounds(T_ROUNDS)} SELECT event_type, n, round(cx, 4) AS centre_x, round(cy, 4) AS centre_y, round(vx, 3) AS var_x,
      round(vy, 3) AS var_y, round(c, 3) AS cov_xy, rounds, converged FROM fit""",
)
def _(t):
    out = C.robust_moments(t.events, "user_id", "value", ["event_type"], rounds=T_ROUNDS)
    return out.select(
        "event_type",
        "n",
        *[F.round(c, 4).alias(c) for c in ("centre_x", "centre_y")],
        *[F.round(c, 3).alias(c) for c in ("var_x", "var_y", "cov_xy")],
        "rounds",
        "converged",
    )


@query(
    "group_t_ellipse",
    f"""WITH {_t_rounds(T_ROUNDS)}, r AS (SELECT *, sqrt((n - 1.0) * (pow(0.05, -2.0 / (n - 1)) - 1)) AS r, sqrt(vx) AS a,
        c / sqrt(vx) AS b, sqrt(vy - c * c / vx) AS e FROM fit)
    SELECT event_type, CAST(k AS INT) AS vertex, round(cx + r * a * cos(k * 2 * pi() / 51), 3) AS user_id,
      round(cy + r * (b * cos(k * 2 * pi() / 51) + e * sin(k * 2 * pi() / 51)), 3) AS value
    FROM r, generate_series(0, 51) g(k)""",
)
def _(t):
    out = C.group_t_ellipse(t.events, "user_id", "value", ["event_type"], rounds=T_ROUNDS)
    return out.select(
        "event_type", "vertex", F.round("user_id", 3).alias("user_id"), F.round("value", 3).alias("value")
    )


@query(
    "time_series",
    f"""WITH {OBS} SELECT survey, stratum, count(DISTINCT taxon) AS richness, round(ln(sum(density)), 6) AS log_density,
      round(ln(sum(volume)), 6) AS log_volume FROM obs GROUP BY survey, stratum""",
)
def _(t):
    cell = S.sum_by(observations(t), ["survey", "stratum", "taxon"], ["density", "volume"])
    return cell.groupBy("survey", "stratum").agg(
        F.count("taxon").alias("richness"),
        F.round(F.log(F.sum("density")), 6).alias("log_density"),
        F.round(F.log(F.sum("volume")), 6).alias("log_volume"),
    )


@query(
    "survey_composition",
    f"""WITH {OBS}, dim AS (SELECT p_name AS taxon, min(p_type) AS phylum FROM part GROUP BY 1),
    s AS (SELECT survey, stratum, phylum, sum(density) AS density FROM obs JOIN dim USING (taxon) GROUP BY ALL)
    SELECT survey, stratum, phylum, density, sum(density) OVER w AS upper, sum(density) OVER w - density AS lower,
      round(density / sum(density) OVER (PARTITION BY survey, stratum), 6) AS share
    FROM s WINDOW w AS (PARTITION BY survey, stratum ORDER BY phylum ROWS UNBOUNDED PRECEDING)""",
)
def _(t):
    dim = t.part.selectExpr("p_name AS taxon", "p_type AS phylum")
    keys = ["survey", "stratum"]
    phyla = rollup_taxon(observations(t), dim, "taxon", "phylum", keys, ["density"])
    stacked = K.stack_bounds(phyla, "density", keys, "phylum")
    return K.share_of(stacked, "density", keys).withColumn("share", F.round("share", 6))
