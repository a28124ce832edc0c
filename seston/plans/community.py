"""Genus totals per sample, and what is computed from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seston.durable import stage
from seston.functions.dates import season
from seston.functions.text import replace_each
from seston.operators.columns import unite
from seston.operators.distance import bray_curtis, ordination_input, species_scores
from seston.operators.filters import exclude_taxa
from seston.operators.ordination import Ordination, nmds
from seston.operators.permutation import anosim, permanova
from seston.operators.ranks import share_of, stack_bounds
from seston.operators.summary import mean_by, richness, sum_by
from seston.operators.taxa import rollup_taxon

# The taxon left out, and the short forms used in sample ids.
HETEROTROPHS = ["Amoeba"]
SHORT = [("_SAV_", "S"), ("_WAT_", "W"), ("_SAV", "S"), ("_WAT", "W")]
SAMPLE = ["survey", "date", "site", "island", "stratum", "rep"]
SITE = ["survey", "date", "island", "stratum"]


def genus_totals(counts: DataFrame) -> DataFrame:
    """Density and volume per sample and genus, with an id for each sample."""
    sized = counts.withColumn("volume", F.col("density") * F.col("volume_avg"))
    totals = sum_by(sized, [*SAMPLE, "genus"], ["density", "volume"], drop_null_keys=True)
    kept = exclude_taxa(totals, HETEROTROPHS, "genus")
    short = kept.withColumn("__short", replace_each("site", SHORT))
    return unite(short, "sample", ["__short", "survey"]).drop("__short")


def site_means(genera: DataFrame) -> DataFrame:
    """Mean over the replicates in which a genus was found, per island and stratum."""
    return mean_by(genera, [*SITE, "genus"], ["density", "volume"], na="propagate", drop_null_keys=True)


def diversity(means: DataFrame) -> DataFrame:
    return richness(means, SITE, "genus", name="genera")


def totals_over_time(means: DataFrame) -> DataFrame:
    """Total and natural log of density and volume per date and stratum."""
    sums = sum_by(means, ["date", "island", "stratum"], ["density", "volume"], na="propagate")
    return sums.withColumns({f"log_{c}": F.log(F.when(F.col(c) > 0, F.col(c))) for c in ("density", "volume")})


def sample_factors(genera: DataFrame) -> DataFrame:
    """One row per sample with the factors that samples are compared by."""
    factors = genera.select("sample", *SAMPLE).distinct()
    return factors.withColumn("season", season(F.substring("survey", 6, 2)))


def composition(means: DataFrame, ranks: DataFrame, level: str, value: str, within: Sequence[str] = tuple(SITE)) -> DataFrame:
    """Layers of a stacked chart: totals, bounds and shares per higher taxon."""
    keys = list(within)
    groups = rollup_taxon(means, ranks, "genus", level, keys, [value])
    return share_of(stack_bounds(groups, value, keys, level), value, keys)


def sample_distances(genera: DataFrame, value: str = "density", prepared: bool = True) -> DataFrame:
    """Bray-Curtis distances, after the usual preparation unless told not to."""
    table = ordination_input(genera, "sample", "genus", value) if prepared else genera
    return stage(bray_curtis(table, "sample", "genus", value))


def ordinate(genera: DataFrame, value: str = "density", k: int = 3, starts: int = 100, **more) -> tuple[Ordination, DataFrame]:
    """Ordination of the samples, and the genus scores in it."""
    result = nmds(sample_distances(genera, value), k=k, starts=starts, **more)
    axes = [f"axis{i}" for i in range(1, k + 1)]
    return result, species_scores(result.scores, genera, "sample", "genus", value, axes)


def group_tests(genera: DataFrame, factors: Sequence[str], value: str = "density", perms: int = 999) -> dict[str, tuple[DataFrame, DataFrame]]:
    """ANOSIM and PERMANOVA of the samples by each factor."""
    distances = sample_distances(genera, value, prepared=False)
    groups = stage(sample_factors(genera))
    return {
        f: (anosim(distances, groups, "sample", f, perms), permanova(distances, groups, "sample", f, perms))
        for f in factors
    }
