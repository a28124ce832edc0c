"""Mixing sources to target weights by weighted sampling without replacement.

Every source gets a budget of words from its weight (``targets``). A document
draws the exponential key ``-ln(u) / quality``, where ``u`` comes from a hash of
its id, so better documents tend to come first. A source is first taken whole as
often as its budget allows; the rest of the budget goes to the documents with
the smallest keys, added up to the budget. The document at the edge of the
budget is taken in part, or in whole if half of it fits (``whole=True``).

No source is put in order by one task: keys are counted in ranges, the ranges of
a source are added up, and only the range with the edge of the budget is sorted.

* NULL and empty texts have size 0 and quality 1 and are taken 0 words.
* The NULL source is a source like any other, last in order; sources without
  words have target 0.
* Equal keys (repeated rows) at the edge share what is left in proportion to
  their sizes, rounded down. NULL ids share one key.
* Reruns agree; an empty table gives an empty result. Columns of the input named
  like working columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seston.durable import Staged
from seston.llm.common import unused

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: characters that are neither letters nor usual punctuation
SYMBOLS = "!#$%&*|@^~<>{}[]=+_0123456789"
LOWEST_QUALITY = 0.05
RANGE_ROWS = 1024
WORD = "[^\\x20\\x09-\\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality(text: Column) -> Column:
    """Share of characters that are not symbols, at least ``LOWEST_QUALITY``."""
    kept = F.length(F.translate(text, SYMBOLS, "")) / F.length(text)
    return F.greatest(F.coalesce(F.when(F.length(text) > 0, kept), F.lit(1.0)), F.lit(LOWEST_QUALITY))


def key(doc_id: Column, weight: Column, seed: str = "mix") -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + 1) / float(2**52 + 1)
    return -F.log(u) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Budget of every source: ``share`` of all words dealt by weight, at most
    ``most`` times the source's words, what is above dealt out again.

    ``sizes`` has one row per source (source, source_size, n). Sources are put in
    the order of words per weight; before each stands what all smaller ones take
    at most. The first that need not stop at its limit fixes the words per
    weight of all that follow. One row per source passes one task.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(w) for w in weights])
    named = sizes.withColumn("weight", F.element_at(pattern, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    limit = most * F.col("source_size")
    by_limit = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(by_limit), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_limit), F.lit(0))
    )
    dealt = named.withColumn("_level", level)
    fits = F.col("_level") * F.col("weight") <= limit
    dealt = dealt.withColumn("_level", F.max(F.when(fits, F.col("_level"))).over(everything))
    return dealt.withColumn(
        "target", F.least(limit.cast("double"), F.coalesce(F.col("_level") * F.col("weight"), limit.cast("double")))
    ).drop("_level")


def plan(docs: DataFrame, doc_id: str, text: str, source: str, whole: bool = False, **options) -> tuple[Staged, DataFrame]:
    """Sizes and keys of all documents (written once), and one row per source
    with its size, target, whole ``epochs`` and the edge of the rest:
    ``cut`` key, words ``left`` for it and words ``at_cut``."""
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"),
        key(F.col(doc_id), quality(F.col(text))).alias("key"),
    )
    sized = Staged(narrow)
    sizes = sized.df.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    table = targets(sizes, **options)
    words = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("int")
    table = table.withColumn("epochs", epochs).withColumn("budget", words - F.col("epochs") * F.col("source_size"))
    table = Staged(table.withColumn("ranges", F.ceil(F.col("n") / RANGE_ROWS).cast("int"))).df
    ranged = joined(sized.df, table.select("source", "ranges", "budget")).withColumn(
        "_range", F.floor((1 - F.exp(-F.col("key"))) * F.col("ranges")).cast("int")
    )
    by_range = ranged.groupBy("source", "_range", "budget").agg(F.sum("size").alias("_words"))
    running = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    edge = by_range.withColumn("_to", F.sum("_words").over(running)).where(
        (F.col("_to") > F.col("budget")) & (F.col("_to") - F.col("_words") <= F.col("budget"))
    )
    edge = edge.select("source", "_range", (F.col("_to") - F.col("_words")).alias("_from"))
    inside = joined(ranged, edge, "_range").groupBy("source", "budget", "_from", "key").agg(F.sum("size").alias("at_cut"))
    running = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_to", F.col("_from") + F.sum("at_cut").over(running)).where(
        (F.col("_to") > F.col("budget")) & (F.col("_to") - F.col("at_cut") <= F.col("budget"))
    )
    cut = inside.select(
        "source", F.col("key").alias("cut"), (F.col("budget") - F.col("_to") + F.col("at_cut")).alias("left"), "at_cut"
    )
    if whole:
        cut = cut.withColumn("left", F.when(2 * F.col("left") >= F.col("at_cut"), F.col("at_cut")).otherwise(0))
    # a small table of known size, so that documents are not dealt by source to meet it
    return sized, Staged(joined(table, cut, how="left")).df


def joined(left: DataFrame, right: DataFrame, also: str | None = None, how: str = "inner") -> DataFrame:
    """Join on source, where NULL meets NULL."""
    same = left["source"].eqNullSafe(right["source"])
    right_source = right["source"]
    if also:
        same = same & (left[also] == right[also])
        return left.join(right, same, how).drop(right_source).drop(right[also])
    return left.join(right, same, how).drop(right_source)


def share_of(size: Column, its_key: Column) -> Column:
    """Words of the fractional epoch that a document gives."""
    at = F.when(F.col("at_cut") > 0, F.floor(F.col("left") * size / F.col("at_cut"))).otherwise(0)
    return F.when(its_key < F.col("cut"), size).when(its_key == F.col("cut"), at).otherwise(0).cast("bigint")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted)."""
    sized, table = plan(docs, doc_id, text, source, **options)
    rows = joined(sized.df, table)
    taken = F.col("epochs") * F.col("size") + share_of(F.col("size"), F.col("key"))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` themselves, each as often as the mix takes it whole.

    Whether a document is taken follows from its own key and its source's row,
    a table of one row per source whose size is known when it is joined, so texts
    are not shuffled while that table is small. Documents without words are kept
    once. Columns of any name stay as they are.
    """
    _, table = plan(docs, doc_id, text, source, whole=True, **options)
    mix = unused("_mix", docs)
    told = F.struct("source", "epochs", "cut", "left")
    rows = docs.join(table.select(told.alias(mix)), F.col(source).eqNullSafe(F.col(mix)["source"]))
    size, its_key, of = words_in(F.col(text)), key(F.col(doc_id), quality(F.col(text))), F.col(mix)
    more = its_key < of["cut"]
    edge = (its_key == of["cut"]) & (of["left"] > 0)
    copies = F.when(size == 0, 1).otherwise(of["epochs"] + F.coalesce((more | edge).cast("int"), F.lit(0)))
    rows = rows.withColumn(mix, F.explode(F.array_repeat(F.lit(True), copies)))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


#: the same rows in SQL, with one plain window per source
SQL = f"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size,
         -ln((('0x' || substr(md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT + 1) / {float(2**52 + 1)!r})
           / greatest({LOWEST_QUALITY}, CASE WHEN length(text) > 0
               THEN length(translate(text, '{SYMBOLS}', '')) / length(text) ELSE 1.0 END) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
l AS (SELECT *, ({SHARE} * sum(source_size) OVER () - coalesce(sum({MOST} * source_size) OVER b, 0))
                / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY {MOST} * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST({MOST} * source_size AS DOUBLE), coalesce(weight *
        (SELECT max(level) FROM l WHERE level * weight <= {MOST} * source_size), CAST({MOST} * source_size AS DOUBLE))) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
g AS (SELECT source, k, sum(size) AS here, sum(sum(size)) OVER (PARTITION BY source ORDER BY k) - sum(size) AS before FROM d GROUP BY source, k)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, e.source_size, e.target,
       CAST(epochs * d.size + CASE WHEN here = 0 THEN 0 ELSE
         floor(greatest(0, least(here, CAST(round(target) AS BIGINT) - epochs * source_size - before)) * d.size / here) END AS BIGINT) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.k = g.k"""
