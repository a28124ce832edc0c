"""Group tests on distances: ANOSIM and PERMANOVA with permuted labels.

Every permutation is a column of labels per sample. Pairs and labels meet per
pair of blocks of samples, where one pass over the pairs serves all
permutations, so pairs are never multiplied by permutations. Permutations
follow from md5 sums and are the same on every run and every engine.

``permanova_of`` starts from the community itself: the task that has two blocks
of samples computes their distances and adds them to the sums of all
permutations at once, so there is no table of pairs to write or to shuffle. The
others take any table of distances.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seston.durable import stage
from seston.operators.distance import (
    BLOCK,
    MEASURES,
    block_count,
    block_of,
    community,
    gather_block_pairs,
    of_blocks,
    to_block_pairs,
)
from seston.operators.joins import natural_join
from seston.operators.ranks import avg_rank, quantiles

# Two statistics closer than this are the same; sums are taken in any order.
TIE = 1.5e-8


def free_labels(groups: DataFrame, sample: str, group: str, perms: int) -> DataFrame:
    """(perm, sample, group): labels dealt anew in each permutation, 0 is the
    labels as observed. Group sizes stay as they are."""
    known = groups.na.drop(subset=[group]).select(
        F.col(sample).alias("sample"), F.col(group).alias("group")
    )
    drawn = known.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(perms))))
    by_perm = W.partitionBy("perm")
    mark = F.md5(F.concat_ws("|", F.col("perm").cast("string"), F.col("sample").cast("string")))
    dealt = drawn.select("perm", "sample", F.row_number().over(by_perm.orderBy(mark, "sample")).alias("at"))
    deck = drawn.select("perm", "group", F.row_number().over(by_perm.orderBy("group", "sample")).alias("at"))
    shuffled = dealt.join(deck, ["perm", "at"]).select("perm", "sample", "group")
    return known.select(F.lit(0).alias("perm"), "sample", "group").unionByName(shuffled)


def series_labels(
    samples: DataFrame, sample: str, group: str, block: str, order: str, perms: int
) -> DataFrame:
    """(perm, sample, group) for repeated measures: in each permutation the
    labels of a block move on along its order by a number of places drawn for
    that block, the end joining the start. The direction is never reversed."""
    series = W.partitionBy("__block")
    placed = (
        samples.na.drop(subset=[group])
        .select(
            F.col(sample).alias("sample"),
            F.col(group).alias("group"),
            F.col(block).cast("string").alias("__block"),
            F.col(order).alias("__order"),
        )
        .select(
            "sample",
            "group",
            "__block",
            (F.row_number().over(series.orderBy("__order", "sample")) - 1).alias("__at"),
            F.count(F.lit(1)).over(series).alias("__size"),
        )
    )
    drawn = placed.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(perms))))
    mark = F.md5(F.concat_ws("|", F.col("perm").cast("string"), "__block"))
    places = F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") % F.col("__size")
    places = F.when(F.col("perm") == 0, F.lit(0)).otherwise(places)
    moved = drawn.select(
        "perm", "sample", "__block", ((F.col("__at") + places) % F.col("__size")).cast("int").alias("__at")
    )
    source = placed.select("__block", "__at", "group")
    return natural_join(moved, source, "inner", ["__block", "__at"]).select("perm", "sample", "group")


def _known(distance: str) -> Column:
    """The distance; two empty samples have none, and then no test exists."""
    missing = F.raise_error(F.lit("a distance is missing"))
    return F.when(F.col(distance).isNotNull(), F.col(distance)).otherwise(missing)


def _sizes(groups: DataFrame, group: str) -> DataFrame:
    return groups.na.drop(subset=[group]).groupBy(F.col(group).alias("group")).agg(
        F.count(F.lit(1)).alias("size")
    )


def label_columns(labels: DataFrame, sizes: DataFrame, by_size: bool) -> DataFrame:
    """Per sample one array of group numbers and, if asked for, one of group
    sizes, over perms. The window numbers the groups, one row each."""
    numbered = sizes.select(
        "group",
        F.row_number().over(W.partitionBy(F.lit(0)).orderBy("group")).alias("code"),
        F.col("size").cast("int").alias("size"),
    )
    coded = natural_join(labels, numbered, "inner", ["group"])
    packed = coded.groupBy("sample").agg(
        F.array_sort(F.collect_list(F.struct("perm", "code", "size"))).alias("p")
    )
    codes = packed.select("sample", F.transform("p", lambda e: e["code"]).alias("codes"), "p")
    if by_size:
        codes = codes.withColumn("sizes", F.transform("p", lambda e: e["size"]))
    return codes.drop("p")


def within_totals(
    pairs: DataFrame, packed: DataFrame, value: str, block: int = BLOCK
) -> DataFrame:
    """(perm, total, pairs): per permutation the weighted sum of ``value`` over
    the pairs inside a group and the weighted number of those pairs. Row -1
    holds the plain sum and number of all pairs."""
    n = packed.count()
    blocks = block_count(n, packed.sparkSession.sparkContext.defaultParallelism, block)
    sent = to_block_pairs(packed.withColumn("block", block_of("sample", blocks)), blocks)
    one, two = block_of("sample_1", blocks), block_of("sample_2", blocks)
    grouped = pairs.select(
        F.least(one, two).alias("low_block"),
        F.greatest(one, two).alias("high_block"),
        "sample_1",
        "sample_2",
        F.col(value).alias("value"),
    )

    def summed(pairs: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        if pairs.empty or labels.empty:
            return pd.DataFrame({"perm": [], "total": [], "pairs": []})
        at = pd.Series(np.arange(len(labels)), index=labels["sample"])
        i, j = at.reindex(pairs["sample_1"]), at.reindex(pairs["sample_2"])
        known = i.notna().to_numpy() & j.notna().to_numpy()
        i, j = i.to_numpy()[known].astype(int), j.to_numpy()[known].astype(int)
        v = pairs["value"].to_numpy()[known]
        codes = np.array(labels["codes"].tolist())
        sized = "sizes" in labels.columns
        weights = 1.0 / np.array(labels["sizes"].tolist()) if sized else None
        total, number = np.zeros(codes.shape[1]), np.zeros(codes.shape[1])
        step = max(1, 4_000_000 // codes.shape[1])
        for s in range(0, len(v), step):
            a, b = i[s : s + step], j[s : s + step]
            share = (codes[a] == codes[b]).astype(float)
            if sized:
                share *= weights[a]
            total += v[s : s + step] @ share
            number += share.sum(axis=0)
        perm = np.arange(-1, codes.shape[1])
        return pd.DataFrame(
            {
                "perm": perm,
                "total": np.concatenate([[v.sum()], total]),
                "pairs": np.concatenate([[float(len(v))], number]),
            }
        )

    parts = (
        gather_block_pairs(grouped, blocks)
        .groupBy("low_block", "high_block")
        .cogroup(gather_block_pairs(sent, blocks).groupBy("low_block", "high_block"))
        .applyInPandas(summed, "perm int, total double, pairs double")
    )
    return parts.groupBy("perm").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))


def within_totals_of(
    df: DataFrame, sample: str, taxon: str, value: str, packed: DataFrame, measure: str = "bray_curtis", block: int = BLOCK
) -> DataFrame:
    """``within_totals`` of squared distances, which only exist in the tasks.

    Of two blocks of samples a task holds the cells, one number per pair and the
    labels of all permutations; what leaves it is one row per permutation.
    """
    cells = community(df, sample, taxon, value).select(
        F.col(sample).alias("sample"), F.col(taxon).alias("taxon"), F.col(value).alias("value")
    )
    n = packed.count()
    blocks = block_count(n, packed.sparkSession.sparkContext.defaultParallelism, block)
    placed = lambda t: to_block_pairs(t.withColumn("block", block_of("sample", blocks)), blocks)
    distances = MEASURES[measure]

    def summed(cells: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"perm": [], "total": [], "pairs": []})
        if cells.empty or labels.empty:
            return empty
        cells = cells[cells["sample"].isin(labels["sample"])]
        low, high = int(labels["low_block"].iat[0]), int(labels["high_block"].iat[0])
        ids_a, ids_b, d, _ = of_blocks(cells, low, high, distances)
        if not d.size:
            return empty
        if np.isnan(d).any():
            raise ValueError("a distance is missing: two samples are empty")
        square = np.triu(d * d, 1) if low == high else d * d
        listed = len(ids_a) * (len(ids_a) - 1) / 2 if low == high else d.size
        at = labels.set_index("sample")
        codes = [np.array(at.loc[ids, "codes"].tolist()) for ids in (ids_a, ids_b)]
        weights = 1.0 / np.array(at.loc[ids_a, "sizes"].tolist())
        upper = np.triu(np.ones(d.shape, bool), 1) if low == high else np.ones(d.shape, bool)
        total, number = np.zeros(codes[0].shape[1]), np.zeros(codes[0].shape[1])
        for p in range(len(total)):
            share = (codes[0][:, p][:, None] == codes[1][:, p]) & upper
            total[p] = weights[:, p] @ np.where(share, square, 0.0).sum(1)
            number[p] = weights[:, p] @ share.sum(1)
        return pd.DataFrame({
            "perm": np.arange(-1, len(total)), "total": np.r_[square.sum(), total], "pairs": np.r_[listed, number],
        })

    parts = (
        gather_block_pairs(placed(cells), blocks)
        .groupBy("low_block", "high_block")
        .cogroup(gather_block_pairs(placed(packed), blocks).groupBy("low_block", "high_block"))
        .applyInPandas(summed, "perm int, total double, pairs double")
    )
    return parts.groupBy("perm").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))


def _design(sizes: DataFrame) -> DataFrame:
    """One row: samples, groups, pairs inside groups plain and by group size."""
    m = F.col("size").cast("double")
    return sizes.agg(
        F.sum(m).alias("n"),
        F.count(F.lit(1)).cast("double").alias("g"),
        F.sum(m * (m - 1) / 2).alias("inside"),
        F.sum((m - 1) / 2).alias("inside_by_size"),
    )


def _labels(
    groups: DataFrame,
    sample: str,
    group: str,
    perms: int,
    block_by: str | None,
    order: str | None,
    by_size: bool,
) -> DataFrame:
    if (block_by is None) != (order is None):
        raise ValueError("give both block_by and order, or neither")
    if block_by is None:
        labels = free_labels(groups, sample, group, perms)
    else:
        labels = series_labels(groups, sample, group, block_by, order, perms)
    return stage(label_columns(labels, _sizes(groups, group), by_size))


def _with_whole(series: DataFrame, design: DataFrame) -> DataFrame:
    """Permutation rows with the row of all pairs and the design beside them."""
    whole = series.agg(
        F.max(F.when(F.col("perm") == -1, F.col("total"))).alias("all_total"),
        F.max(F.when(F.col("perm") == -1, F.col("pairs"))).alias("all_pairs"),
    )
    both = whole.select(F.struct("*").alias("w")).scalar()
    plan = design.select(F.struct("*").alias("d")).scalar()
    return (
        series.filter("perm >= 0").withColumns({"w": both, "d": plan}).select("*", "w.*", "d.*").drop("w", "d")
    )


def _complete(listed: Column, n: Column) -> Column:
    """``listed``, or an error unless all pairs of n samples are listed."""
    message = F.concat(
        F.lit("pairs of labelled samples are missing: "), listed.cast("string"), F.lit(" listed for "),
        n.cast("string"), F.lit(" samples; give absent= for pairs that are left out"),
    )
    return F.when(listed == n * (n - 1) / 2, listed).otherwise(F.raise_error(message).cast("double"))


def permanova_series(
    pairs: DataFrame,
    groups: DataFrame,
    sample: str,
    group: str,
    perms: int = 999,
    block_by: str | None = None,
    order: str | None = None,
    absent: float | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """(perm, ss_within, ss_total, r2, f, ...) with the observed one as perm 0.

    ``pairs`` has sample_1, sample_2 and distance. With ``absent``, pairs that
    are not listed have that distance; without, every pair of labelled samples
    has to be listed.
    """
    packed = _labels(groups, sample, group, perms, block_by, order, True)
    squares = pairs.withColumn("square", _known("distance") * F.col("distance"))
    return _variance_series(within_totals(squares, packed, "square", block), groups, group, absent)


def _variance_series(totals: DataFrame, groups: DataFrame, group: str, absent: float | None) -> DataFrame:
    x = _with_whole(stage(totals), _design(_sizes(groups, group)))
    gone = F.lit(0.0 if absent is None else float(absent) ** 2)
    n, g = F.col("n"), F.col("g")
    listed = F.col("all_pairs") if absent is not None else _complete(F.col("all_pairs"), n)
    ss_total = (F.col("all_total") + gone * (n * (n - 1) / 2 - listed)) / n
    ss_within = F.col("total") + gone * (F.col("inside_by_size") - F.col("pairs"))
    x = x.withColumns({"ss_total": ss_total, "ss_within": ss_within})
    between, within = F.col("ss_total") - F.col("ss_within"), F.col("ss_within")
    testable = (g > 1) & (n > g)
    f = (between / (g - 1)) / (F.when(within != 0, within) / (n - g))
    return x.select(
        "perm",
        "ss_within",
        "ss_total",
        F.when(testable & (F.col("ss_total") != 0), between / F.col("ss_total")).alias("r2"),
        F.when(testable, f).alias("f"),
        (g - 1).cast("long").alias("df_group"),
        (n - g).cast("long").alias("df_residual"),
    )


def _p_value() -> Column:
    """Share of the statistics ``__v``, the observed ``__o`` included, that are
    at least as large as it."""
    as_large = F.size(F.filter("__v", lambda v: v >= F.col("__o") - TIE))
    return F.when(F.col("__o").isNotNull(), as_large / F.size("__v"))


def permanova(
    pairs: DataFrame,
    groups: DataFrame,
    sample: str,
    group: str,
    perms: int = 999,
    block_by: str | None = None,
    order: str | None = None,
    absent: float | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Analysis of variance on distances: rows group, residual and total with
    df, sum of squares, r2, and for the group f and the permutation p.

    With ``block_by`` and ``order`` the labels only move along the series of
    each block (repeated measures).
    """
    return _variance_table(permanova_series(pairs, groups, sample, group, perms, block_by, order, absent, block))


def permanova_series_of(
    df: DataFrame,
    sample: str,
    taxon: str,
    value: str,
    groups: DataFrame,
    group: str,
    perms: int = 999,
    block_by: str | None = None,
    order: str | None = None,
    measure: str = "bray_curtis",
    block: int = BLOCK,
) -> DataFrame:
    """``permanova_series`` of the community ``df`` by a measure of ``MEASURES``.
    Samples without a label take no part; a labelled sample without cells raises
    an error, as an empty pair does."""
    packed = _labels(groups, sample, group, perms, block_by, order, True)
    return _variance_series(within_totals_of(df, sample, taxon, value, packed, measure, block), groups, group, None)


def permanova_of(
    df: DataFrame,
    sample: str,
    taxon: str,
    value: str,
    groups: DataFrame,
    group: str,
    perms: int = 999,
    block_by: str | None = None,
    order: str | None = None,
    measure: str = "bray_curtis",
    block: int = BLOCK,
) -> DataFrame:
    """``permanova`` of the community ``df``, without a table of pairs."""
    return _variance_table(
        permanova_series_of(df, sample, taxon, value, groups, group, perms, block_by, order, measure, block)
    )


def _variance_table(series: DataFrame) -> DataFrame:
    one = series.agg(
        F.max(F.when(F.col("perm") == 0, F.struct("*"))).alias("o"),
        F.max(F.when(F.col("perm") == 0, F.col("r2"))).alias("__o"),
        F.collect_list("r2").alias("__v"),
    ).withColumn("p", _p_value())
    none = F.lit(None).cast("double")

    def line(term: str, df: Column, ss: Column, r2: Column, f: Column, p: Column) -> Column:
        return F.struct(
            F.lit(term).alias("term"), df.alias("df"), ss.alias("sum_sq"),
            r2.alias("r2"), f.alias("f"), p.alias("p"),
        )

    o = F.col("o")
    rows = F.array(
        line("group", o["df_group"], o["ss_total"] - o["ss_within"], o["r2"], o["f"], F.col("p")),
        line("residual", o["df_residual"], o["ss_within"], 1 - o["r2"], none, none),
        line("total", o["df_group"] + o["df_residual"], o["ss_total"], F.lit(1.0), none, none),
    )
    return one.select(F.inline(rows))


def _ranked(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of known samples with the rank of their distance, ties sharing their mean rank."""
    listed = natural_join(pairs, known.withColumnRenamed("sample", "sample_1"), "semi", ["sample_1"])
    listed = natural_join(listed, known.withColumnRenamed("sample", "sample_2"), "semi", ["sample_2"])
    kept = stage(listed.select("sample_1", "sample_2", _known("distance").alias("distance")))
    return avg_rank(kept, "distance")


def anosim_series(
    pairs: DataFrame,
    groups: DataFrame,
    sample: str,
    group: str,
    perms: int = 999,
    block_by: str | None = None,
    order: str | None = None,
    absent: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """(perm, r) with the observed statistic as perm 0.

    Distances are ranked over all pairs, ties sharing their mean rank. With
    ``absent``, pairs not listed tie at the top; without, every pair of labelled
    samples has to be listed. One group, or groups of one
    sample only, leave r NULL.
    """
    packed = _labels(groups, sample, group, perms, block_by, order, False)
    ranked = _ranked(pairs, packed.select("sample"))
    sums = stage(within_totals(ranked, packed, "rank", block))
    x = _with_whole(sums, _design(_sizes(groups, group)))
    n = F.col("n")
    every = n * (n - 1) / 2
    missing = every - (F.col("all_pairs") if absent else _complete(F.col("all_pairs"), n))
    top = F.col("all_pairs") + (missing + 1) / 2
    inside = F.col("total") + (F.col("inside") - F.col("pairs")) * top if absent else F.col("total")
    number = F.col("inside")
    outside = every - number
    mean_in = inside / F.when(number > 0, number)
    mean_out = (F.col("all_total") + missing * top - inside) / F.when(outside > 0, outside)
    return x.select("perm", ((mean_out - mean_in) / (every / 2)).alias("r"))


def anosim(
    pairs: DataFrame,
    groups: DataFrame,
    sample: str,
    group: str,
    perms: int = 999,
    absent: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """Analysis of similarities: one row with r, its permutation p and the
    number of permutations."""
    series = anosim_series(pairs, groups, sample, group, perms, None, None, absent, block)
    one = series.agg(
        F.max(F.when(F.col("perm") == 0, F.col("r"))).alias("__o"), F.collect_list("r").alias("__v")
    )
    return one.select(
        F.col("__o").alias("r"), _p_value().alias("p"), F.lit(perms).cast("long").alias("permutations")
    )


#: probabilities of the quantiles of a summary: ranks of classes, null statistics
RANK_PROBS = (0.0, 0.25, 0.5, 0.75, 1.0)
NULL_PROBS = (0.9, 0.95, 0.975, 0.99)


def anosim_ranks(
    pairs: DataFrame, groups: DataFrame, sample: str, group: str, probs: Sequence[float] = RANK_PROBS
) -> DataFrame:
    """Ranks of the distances by class of pair: those between groups (``between``
    true, ``group`` NULL) and those within each group: (between, ``group``, prob,
    n, rank).

    Ranks are those of ``anosim``, over all pairs of labelled samples. A group of
    one sample has no pairs and no rows.
    """
    known = groups.na.drop(subset=[group]).select(F.col(sample).alias("sample"), F.col(group).alias("group"))
    ranked = _ranked(pairs, known.select("sample"))
    for side in ("1", "2"):
        ends = known.select(F.col("sample").alias(f"sample_{side}"), F.col("group").alias(f"group_{side}"))
        ranked = natural_join(ranked, ends, "inner", [f"sample_{side}"])
    between = F.col("group_1") != F.col("group_2")
    classes = ranked.select(
        between.alias("between"), F.when(~between, F.col("group_1")).alias(group), F.col("rank")
    )
    return quantiles(classes, "rank", probs, ["between", group])


def null_quantiles(series: DataFrame, statistic: str, probs: Sequence[float] = NULL_PROBS) -> DataFrame:
    """Quantiles (prob, n, ``statistic``) of the permuted statistics of a series
    (perm, statistic), the observed one left out."""
    return quantiles(series.where("perm > 0"), statistic, probs)


def series_pvalue(series: DataFrame, statistic: str) -> DataFrame:
    """Observed statistic and p of any permutation series (perm, statistic)."""
    one = series.agg(
        F.max(F.when(F.col("perm") == 0, F.col(statistic))).alias("__o"),
        F.collect_list(statistic).alias("__v"),
    )
    return one.select(F.col("__o").alias("observed"), _p_value().alias("p"))


__all__: Sequence[str] = (
    "anosim",
    "anosim_ranks",
    "anosim_series",
    "free_labels",
    "null_quantiles",
    "permanova",
    "permanova_of",
    "permanova_series",
    "permanova_series_of",
    "series_labels",
    "series_pvalue",
    "within_totals",
    "within_totals_of",
)
