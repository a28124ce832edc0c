"""Correlation, outliers by hinges, and ellipses of groups."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seston.durable import Staged, stage
from seston.operators.joins import natural_join
from seston.operators.ranks import tukey_five
from seston.operators.summary import complete_rows


def _pair_stats(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    rows = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
        spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
        rows.append(
            F.struct(
                F.lit(a).alias("x"),
                F.lit(b).alias("y"),
                F.count_if(both).alias("n"),
                # a constant side has no correlation
                (F.covar_pop(x, y) / F.when(spread > 0, spread)).alias("r"),
            )
        )
    return df.agg(F.array(*rows).alias("p")).select(F.inline("p"))


def corr_matrix(df: DataFrame, cols: Sequence[str], use: str = "complete") -> DataFrame:
    """Pearson correlation of each pair of columns (x, y, n, r), x before y,
    each column with itself included.

    "complete" uses the rows that miss none of the columns, "pairwise" the rows
    that miss neither of the two.
    """
    if use not in ("complete", "pairwise"):
        raise ValueError(f"use must be 'complete' or 'pairwise', not {use!r}")
    rows = complete_rows(df, cols) if use == "complete" else df
    return _pair_stats(rows, list(combinations_with_replacement(cols, 2)))


# fixed values: Lanczos approximation of the gamma function, g = 7
LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]
FRACTION_TERMS = 300


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function of z >= 1/2."""
    x = z - 1
    series = sum((F.lit(c) / (x + i) for i, c in enumerate(LANCZOS) if i), F.lit(LANCZOS[0]))
    t = x + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (x + 0.5) * F.log(t) - t + F.log(series)


def _beta_fraction(x: Column, a: Column, b: Column) -> Column:
    """Continued fraction of the incomplete beta function (modified Lentz),
    folded over the numbers of its terms."""
    safe = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))
    start = 1 / safe(1 - (a + b) * x / (a + 1))

    def term(s: Column, by: Column) -> Column:
        d, c = 1 / safe(1 + by * s["d"]), safe(1 + by / s["c"])
        return state(c, d, s["h"] * d * c)

    def both(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        # a list of one or two terms is folded too, so that the first is computed once
        return F.aggregate(F.array(even, odd), s, term)

    steps = F.transform(F.sequence(F.lit(1), F.lit(FRACTION_TERMS - 1)), lambda m: m.cast("double"))
    return F.aggregate(steps, state(F.lit(1.0), start, start), both, lambda s: s["h"])


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t, NULL without degrees of freedom."""
    df = df.cast("double")
    a, b = df / 2, F.lit(0.5)
    x = df / (df + t * t)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - F.lit(math.lgamma(0.5)) + a * F.log(x) + b * F.log1p(-x))
    near = front * _beta_fraction(x, a, b) / a
    far = 1 - front * _beta_fraction(1 - x, b, a) / b
    p = F.when(x < (a + 1) / (a + b + 2), near).otherwise(far)
    inside = F.when(t == 0, 1.0).when(x <= 0, 0.0).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))
    return F.when((df > 0) & t.isNotNull(), inside)


def corr_tests(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each pair of different columns with n, r and t = r sqrt((n-2)/(1-r^2)),
    over the rows that miss neither."""
    found = _pair_stats(df, list(combinations(cols, 2)))
    r, n = F.col("r"), F.col("n")
    spare = 1 - r * r
    t = F.when((n > 2) & (spare > 0), r * F.sqrt((n - 2) / spare))
    return found.withColumn("t", t)


def corr_pvalues(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``corr_tests`` with two-sided p-values, 0 for a perfect correlation of
    more than two rows, whose t is infinite and left NULL."""
    perfect = (F.col("n") > 2) & (1 - F.col("r") * F.col("r") <= 0)
    p = t_two_sided(F.col("t"), F.col("n") - 2)
    return corr_tests(df, cols).withColumn("p", F.when(perfect, F.lit(0.0)).otherwise(p))


def fences(df: DataFrame, col: str, by: Sequence[str] = (), coef: float = 1.5) -> DataFrame:
    """Limits ``coef`` hinge spreads beyond the hinges."""
    five = tukey_five(df, col, by)
    spread = F.col("upper_hinge") - F.col("lower_hinge")
    return five.select(
        *by,
        (F.col("lower_hinge") - coef * spread).alias("low_fence"),
        (F.col("upper_hinge") + coef * spread).alias("high_fence"),
    )


def _with_fences(df: DataFrame, cols: Sequence[str], coef: float) -> DataFrame:
    """Add one struct of limits per column, each computed once."""
    limits = {f"__{c}": fences(df, c, (), coef).select(F.struct("*").alias("f")).scalar() for c in cols}
    return df.withColumns(limits)


def _outside(col: str) -> Column:
    x, limits = F.col(f"`{col}`"), F.col(f"`__{col}`")
    return (x < limits["low_fence"]) | (x > limits["high_fence"])


def outliers(df: DataFrame, col: str, coef: float = 1.5) -> DataFrame:
    """Rows whose value lies beyond the fences of the column."""
    return _with_fences(df, [col], coef).filter(_outside(col)).drop(f"__{col}")


def mask_outliers(df: DataFrame, cols: Sequence[str], coef: float = 1.5) -> DataFrame:
    """Outlying values to NULL, each column by its own fences."""
    fenced = _with_fences(df, cols, coef)
    masked = fenced.withColumns({c: F.when(~_outside(c), F.col(f"`{c}`")) for c in cols})
    return masked.drop(*[f"__{c}" for c in cols])


def group_moments(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Centre, variances and covariance of the points of each group."""
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("centre_x"),
        F.avg(y).alias("centre_y"),
        F.var_samp(x).alias("var_x"),
        F.var_samp(y).alias("var_y"),
        F.covar_samp(x, y).alias("cov_xy"),
    )


def group_ellipse(
    df: DataFrame, x: str, y: str, by: Sequence[str], level: float = 0.95, vertices: int = 52
) -> DataFrame:
    """Outline of the normal confidence ellipse of each group (vertex, x, y).

    The squared radius is 2 F(level; 2, n - 1); for two numerator degrees of
    freedom that quantile is (m/2)((1-level)^(-2/m) - 1) with m = n - 1. Groups
    of fewer than four points have no outline.
    """
    return _outline(group_moments(df, x, y, by), x, y, by, level, vertices)


def _outline(moments: DataFrame, x: str, y: str, by: Sequence[str], level: float, vertices: int) -> DataFrame:
    m = (F.col("n") - 1).cast("double")
    radius = F.sqrt(m * (F.pow(F.lit(1.0 - level), -2.0 / m) - 1.0))
    a = F.sqrt("var_x")
    b = F.col("cov_xy") / F.when(a != 0, a)
    c = F.sqrt(F.greatest(F.col("var_y") - b * b, F.lit(0.0)))
    ring = moments.filter(F.col("n") >= 4).withColumns({"r": radius, "a": a, "b": b, "c": c}).withColumn(
        "vertex", F.explode(F.sequence(F.lit(0), F.lit(vertices - 1)))
    )
    angle = F.col("vertex") * F.lit(2 * math.pi / (vertices - 1))
    return ring.select(
        *by,
        "vertex",
        (F.col("centre_x") + F.col("r") * F.col("a") * F.cos(angle)).alias(x),
        (F.col("centre_y") + F.col("r") * (F.col("b") * F.cos(angle) + F.col("c") * F.sin(angle))).alias(y),
    )


def _t_weight(x: Column, y: Column, s: Column, df_t: float) -> Column:
    """Weight of a point under a fit ``s`` (centre and scatter) of two columns."""
    dx, dy = x - s["x"], y - s["y"]
    det = s["xx"] * s["yy"] - s["xy"] * s["xy"]
    far = (s["yy"] * dx * dx - 2 * s["xy"] * dx * dy + s["xx"] * dy * dy) / F.when(det > 0, det)
    return F.lit(df_t + 2) / (df_t + far)


def robust_moments(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str],
    df_t: float = 5.0,
    tol: float = 0.01,
    rounds: int = 25,
) -> DataFrame:
    """Centre and scatter of the points of each group under a bivariate t of
    ``df_t`` degrees of freedom: ``by``, n, centre_x, centre_y, var_x, var_y,
    cov_xy, rounds, converged.

    Points far from the centre weigh less. Weights are a function of the last
    fit, so no row carries state: a round is one aggregation of the points of all
    groups that are not settled, joined to one row per group. A group settles when no
    weight moved by ``tol``; one that has not after ``rounds`` says so in
    ``converged``. Points with a missing or NaN side are left out, a missing key is a group
    of its own. Groups of fewer than three points, or with all points on a line,
    are not there.
    """
    if not by:
        one = robust_moments(df.withColumn("__all", F.lit(0)), x, y, ["__all"], df_t, tol, rounds)
        return one.drop("__all")
    px, py = F.col("__px"), F.col("__py")
    sides = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in (x, y)]
    points = Staged(
        df.select(*[F.col(f"`{c}`") for c in by], sides[0].alias("__px"), sides[1].alias("__py"))
        .where(px.isNotNull() & py.isNotNull())
    )
    keys = [F.col(f"`{c}`") for c in by]
    # sums are taken about the plain mean of the group, which loses no digits
    first = points.df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.struct(F.avg(px).alias("x"), F.avg(py).alias("y")).alias("__mean"),
        F.struct(
            F.lit(0.0).alias("x"), F.lit(0.0).alias("y"),
            F.var_pop(px).alias("xx"), F.var_pop(py).alias("yy"), F.covar_pop(px, py).alias("xy"),
        ).alias("__fit"),
    )
    fit = F.col("__fit")
    plane = fit["xx"] * fit["yy"] - fit["xy"] * fit["xy"] > 1e-12 * fit["xx"] * fit["yy"]
    known = ["x", "y", "xx", "yy", "xy"]
    none = F.lit(None).cast(first.schema["__fit"].dataType)
    active = Staged(first.where((F.col("__n") > 2) & plane).withColumn("__last", none)).df
    done = []
    for k in range(1, rounds + 1):
        rows = natural_join(points.df, active, "inner", list(by))
        dx, dy = px - F.col("__mean")["x"], py - F.col("__mean")["y"]
        w, last = _t_weight(dx, dy, fit, df_t), F.col("__last")
        was = F.when(last.isNull(), F.lit(1.0)).otherwise(_t_weight(dx, dy, last, df_t))
        weighed = rows.select(
            *keys, "__n", "__mean", "__fit", dx.alias("__dx"), dy.alias("__dy"), w.alias("__w"),
            F.abs(w - was).alias("__moved"),
        )
        a, b, w = F.col("__dx"), F.col("__dy"), F.col("__w")
        sums = weighed.groupBy(*keys).agg(
            *[F.any_value(c).alias(c) for c in ("__n", "__mean", "__fit")],
            F.max("__moved").alias("__moved"),
            *[F.sum(v).alias(f"__{c}") for c, v in
              (("w", w), ("x", w * a), ("y", w * b), ("xx", w * a * a), ("yy", w * b * b), ("xy", w * a * b))],
        )
        total = F.col("__w")
        new = {c: F.col(f"__{c}") / total for c in known}
        spread = {c: new[c] - new[c[0]] * new[c[1]] for c in known[2:]}
        settled = F.col("__moved") < tol
        table = stage(sums.select(
            *keys, "__n", "__mean", fit.alias("__last"), total.alias("__w"), settled.alias("__settled"),
            F.struct(new["x"].alias("x"), new["y"].alias("y"), *[spread[c].alias(c) for c in known[2:]]).alias("__fit"),
        ))
        ended = table if k == rounds else table.where("__settled")
        step = {c: fit[c] - F.col("__last")[c] for c in "xy"}
        done.append(ended.select(
            *keys, F.col("__n").alias("n"),
            (F.col("__mean")["x"] + fit["x"]).alias("centre_x"), (F.col("__mean")["y"] + fit["y"]).alias("centre_y"),
            # the scatter is about the centre that the weights were taken from
            *[(F.col("__w") / F.col("__n") * (fit[c] + step[c[0]] * step[c[1]])).alias(name)
              for c, name in (("xx", "var_x"), ("yy", "var_y"), ("xy", "cov_xy"))],
            F.lit(k).alias("rounds"), F.col("__settled").alias("converged"),
        ))
        active = table.where("NOT __settled").drop("__settled", "__w")
        if active.isEmpty():
            break
    points.drop()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def group_t_ellipse(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str],
    level: float = 0.95,
    vertices: int = 52,
    df_t: float = 5.0,
    tol: float = 0.01,
    rounds: int = 25,
) -> DataFrame:
    """Outline of the robust t ellipse of each group (vertex, x, y): that of
    ``group_ellipse`` with centre and scatter of ``robust_moments``. Groups of
    fewer than four points, or with all points on a line, have none."""
    return _outline(robust_moments(df, x, y, by, df_t, tol, rounds), x, y, by, level, vertices)
