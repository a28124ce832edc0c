"""Names of taxa and stations: repair, split, resolve, match, filter, roll up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seston.durable import stage
from seston.functions.text import matches, replace_each, split_last, tidy_space
from seston.operators.joins import join_lookup, natural_join, unique_by
from seston.operators.summary import occupancy, present_cells, sum_by

# Name endings that say the species was not determined, and the
# life stages that can follow a name.
UNRESOLVED = (" sp.", " spp.", " SPP.")
STAGES = ("adult", "copepodid", "nauplii")


def normalise_taxon(
    c: Column | str,
    repairs: Sequence[tuple[str, str]] | Mapping[str, str] = (),
    endings: Sequence[str] = UNRESOLVED,
) -> Column:
    """Apply spelling repairs in order, then remove the endings, as plain text."""
    return replace_each(replace_each(c, repairs), [(e, "") for e in endings])


def split_stage(
    df: DataFrame,
    taxon: str = "taxon",
    new: str = "stage",
    stages: Sequence[str] = STAGES,
    missing: str = "not_spec",
) -> DataFrame:
    """Move a life stage from the end of the name to a column of its own."""
    staged = matches(taxon, list(stages))
    head, tail = split_last(taxon)
    return df.withColumns(
        {
            new: F.when(staged, tail).otherwise(F.lit(missing)),
            taxon: F.when(staged, head).otherwise(F.col(taxon)),
        }
    )


def normalise_station(
    c: Column | str, separator: str = "_", repairs: Sequence[tuple[str, str]] = ()
) -> Column:
    """One separator in station names ("-", "_" or " #"), then repairs of whole
    names."""
    out = F.regexp_replace(F.col(c) if isinstance(c, str) else c, " #|[-_]", separator)
    plain = out
    for wrong, right in repairs:
        out = F.when(plain == wrong, F.lit(right)).otherwise(out)
    return out


def unknown_stations(df: DataFrame, stations: DataFrame, col: str = "station") -> DataFrame:
    """Distinct station names that the station list does not have."""
    return natural_join(df.select(col).distinct(), stations, "anti", [col])


def assign_survey(
    df: DataFrame, surveys: DataFrame, keys: Sequence[str] = ("station", "date")
) -> DataFrame:
    """Add the survey each sample belongs to. Samples are often taken outside
    the calendar month they stand for, so the survey comes from a list."""
    return join_lookup(df, surveys, list(keys))


def name_mismatches(df: DataFrame, taxonomy: DataFrame, name: str = "name") -> DataFrame:
    """Distinct names that the taxonomy does not have."""
    clean = df.select(tidy_space(name).alias(name)).distinct()
    known = taxonomy.select(tidy_space(name).alias(name)).distinct()
    return natural_join(clean, known, "anti", [name])


def resolve_taxa(
    df: DataFrame,
    taxonomy: DataFrame,
    gaps: DataFrame | None = None,
    name: str = "name",
    genus: str = "genus",
    ranks: Sequence[str] = ("kingdom", "phylum", "class", "algal_group"),
    steps: Sequence[str] = ("name", "gaps", "genus"),
) -> DataFrame:
    """Add higher ranks from the first source that knows the taxon.

    "name" looks the full name up in the taxonomy, "gaps" in a hand-made list,
    and "genus" uses the ranks of the genus. ``resolved_by`` tells which one
    answered, or "none". Names are compared after blanks are tidied. A row
    takes all ranks from one source, and no source can multiply rows.
    """
    key = "__name"
    out = df.withColumn(key, tidy_space(name))

    def source(table: DataFrame, on: str, tag: str) -> DataFrame:
        clean = table.select(
            tidy_space(name if on == key else genus).alias(on),
            F.struct(*[F.col(r) if r in table.columns else F.lit(None).cast("string").alias(r) for r in ranks]).alias(tag),
        ).filter(F.col(on).isNotNull())
        return unique_by(clean, [on], "first")

    picked: list[tuple[str, str]] = []
    for step in steps:
        tag = f"__from_{step}"
        if step == "name":
            out = natural_join(out, source(taxonomy, key, tag), "left", [key])
        elif step == "gaps":
            if gaps is None:
                continue
            out = natural_join(out, source(gaps, key, tag), "left", [key])
        elif step == "genus":
            out = out.withColumn("__genus_key", tidy_space(genus))
            out = natural_join(out, source(taxonomy, "__genus_key", tag), "left", ["__genus_key"])
        else:
            raise ValueError(f"unknown step {step!r}")
        picked.append((step, tag))

    best = F.coalesce(*[F.col(tag) for _, tag in picked])
    how = F.coalesce(*[F.when(F.col(tag).isNotNull(), F.lit(step)) for step, tag in picked], F.lit("none"))
    out = out.withColumns({"__best": best, "resolved_by": how})
    return out.withColumns({r: F.col("__best")[r] for r in ranks}).drop(
        key, "__genus_key", "__best", *[tag for _, tag in picked]
    )


def _deletions(c: Column, times: int) -> Column:
    """The text and every text left after deleting up to ``times`` letters."""

    def drop_one(s: Column) -> Column:
        letters = F.sequence(F.lit(1), F.length(s))
        cut = F.transform(
            letters,
            lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.length(s))),
        )
        return F.when(F.length(s) > 0, cut).otherwise(F.array().cast("array<string>"))

    layer = F.array(c)
    found = layer
    for _ in range(times):
        layer = F.array_distinct(F.flatten(F.transform(layer, drop_one)))
        found = F.array_union(found, layer)
    return found


def nearest_name(
    names: DataFrame,
    reference: DataFrame,
    name: str = "name",
    max_edits: int = 2,
) -> DataFrame:
    """Closest reference name within ``max_edits`` letter edits of each name.

    Two texts that few edits apart share a text obtainable from both by as
    many deletions, so an equality join on those finds every candidate; the
    edit distance then decides. Ties take the name that sorts first.
    """
    left = names.select(name).distinct()
    right = reference.select(F.col(name).alias("nearest")).distinct()
    a = left.select(name, F.explode(_deletions(F.col(name), max_edits)).alias("__key"))
    b = right.select("nearest", F.explode(_deletions(F.col("nearest"), max_edits)).alias("__key"))
    pairs = a.join(b, "__key").select(name, "nearest").distinct()
    edits = F.levenshtein(F.col(name), F.col("nearest"))
    close = pairs.withColumn("edits", edits).filter(F.col("edits") <= max_edits)
    best = close.groupBy(name).agg(F.min(F.struct("edits", "nearest")).alias("__b"))
    return natural_join(
        left, best.select(name, F.col("__b.nearest").alias("nearest"), F.col("__b.edits").alias("edits")),
        "left", [name],
    )


def drop_rare(
    df: DataFrame,
    sample: str | Sequence[str],
    taxon: str,
    min_samples: int = 3,
    value: str | None = None,
) -> DataFrame:
    """Keep the taxa found in at least ``min_samples`` samples.

    The list of those taxa is written when this is called: with its size known,
    a short list filters the rows where they are, without a shuffle.
    """
    samples = [sample] if isinstance(sample, str) else list(sample)
    found = present_cells(df, samples, taxon, value)
    often = found.groupBy(taxon).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_samples)
    return natural_join(df, stage(often.select(taxon)), "semi", [taxon])


def rollup_taxon(
    df: DataFrame,
    dim: DataFrame,
    taxon: str,
    level: str,
    keys: Sequence[str],
    cols: Sequence[str],
    on_dup: str = "first",
    drop_unknown: bool = True,
) -> DataFrame:
    """Sum measures per sample and higher taxon.

    The measures are summed per taxon first, so the lookup join sees one row
    for each sample and taxon. ``drop_unknown`` leaves out taxa the lookup
    does not place.
    """
    per_taxon = sum_by(df, [*keys, taxon], cols)
    placed = join_lookup(per_taxon, dim.select(taxon, level), [taxon], on_dup)
    if drop_unknown:
        placed = placed.filter(F.col(level).isNotNull())
    return sum_by(placed, [*keys, level], cols)


def taxon_frequency(
    df: DataFrame, dim: DataFrame, sample: str | Sequence[str], taxon: str
) -> DataFrame:
    """Occupancy of each taxon with its higher ranks."""
    return join_lookup(occupancy(df, sample, taxon), dim, [taxon], "first")

