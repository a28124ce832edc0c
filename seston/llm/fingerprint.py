"""Document fingerprints: threshold-scaled sketches in built-in functions only.

A text's sketch is the sorted set of those hashes of its five-word shingles
that lie below a fixed fraction of the hash range. The threshold does not
depend on the text, so sketches of parts can be merged by a union, and the
share of one sketch found in another estimates containment even between texts
of very unequal length.

* NULL texts count as empty. A text without words has an empty sketch.
* A text of fewer words than a shingle has its whole word sequence as its one
  shingle. A text with words none of whose hashes is below the threshold keeps
  its smallest hash, so equal texts, and only texts without words, agree on
  nothing by being empty. This one hash tells nothing of the text's share in a
  text that has hashes below the threshold: containment there is NULL.
* Equal texts have equal sketches; repeated shingles count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
FRACTION = 1 / 8
LOWEST = -(2**63)


def words(text: Column) -> Column:
    """Lower-cased words between blanks, tabs and line ends."""
    return F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingle_hashes(tokens: Column, size: int = WORDS) -> Column:
    """Hashes of all shingles of an array of words; pass a plain column, since
    the array is looked at once for every word of a shingle."""
    each = F.transform(
        F.sequence(F.lit(0), F.size(tokens) - size), lambda i: F.xxhash64(*[tokens[i + k] for k in range(size)])
    )
    whole = F.array(F.xxhash64(F.concat_ws(" ", tokens)))
    none = F.array().cast("array<bigint>")
    return F.when(F.size(tokens) >= size, each).when(F.size(tokens) > 0, whole).otherwise(none)


def limit(fraction: float) -> Column:
    return F.lit(LOWEST + int(fraction * 2**64)).cast("bigint")


def keep_below(hashes: Column, fraction: float = FRACTION) -> Column:
    """The sorted distinct hashes below the threshold, or the smallest one."""
    below = F.filter(hashes, lambda h: h < limit(fraction))
    some = F.exists(hashes, lambda h: h < limit(fraction))
    return F.when(F.size(hashes) == 0, hashes).when(some, F.array_sort(F.array_distinct(below))).otherwise(
        F.array(F.array_min(hashes))
    )


def with_sketch(df: DataFrame, text: str, name: str, size: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """Add the sketch of ``text`` as ``name``. Each step is a projection of its
    own: the optimizer does not merge projections whose result is used often."""
    w, h = f"_{name}_words", f"_{name}_hashes"
    return (
        df.withColumn(w, words(F.coalesce(F.col(text), F.lit(""))))
        .withColumn(h, shingle_hashes(F.col(w), size))
        .withColumn(name, keep_below(F.col(h), fraction))
        .drop(w, h)
    )


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Sketch of the shingles of two texts taken together."""
    return keep_below(F.array_union(a, b), fraction)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate from 0 to 1; two empty sketches are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimate of the share of ``a`` that lies in ``b``; 1 for an empty ``a``,
    NULL if ``a`` has no hash below the threshold and its smallest one is not
    that of ``b``."""
    shared = F.size(F.array_intersect(a, b))
    unknown = (shared == 0) & (F.size(b) > 0) & (F.array_min(a) >= limit(fraction))
    return F.when(F.size(a) == 0, F.lit(1.0)).when(~unknown, shared / F.size(a))


def as_text(sketch: Column) -> Column:
    return F.concat_ws(".", F.transform(sketch, lambda h: F.lower(F.hex(h))))


def next_rows(df: DataFrame, doc_id: str, text: str, carried: list[str], ranges: int) -> DataFrame:
    """Add ``_next``, a struct of ``carried`` columns of the next row in the
    order of descending id (NULL last, equal ids by text); the last row is
    followed by the first.

    Ids are cut into ranges by approximate quantiles, each range is put in
    order by itself, and only the first row of each range is handed to the
    range before it. No task orders all rows and texts are shuffled once. The
    table that is broadcast has one row of two numbers per range.
    """
    spark = df.sparkSession
    ids = df.select(F.col(doc_id).alias("_id"))
    points = [i / ranges for i in range(1, ranges)]
    bounds = ids.agg(F.percentile_approx("_id", points, 10 * ranges)).first()[0] if points else None
    bounds = sorted(set(bounds or []))
    if bounds:
        known = F.array(*[F.lit(b).cast("bigint") for b in bounds])
        number = lambda c: F.size(F.filter(known, lambda b: b <= c))
    else:
        number = lambda c: F.lit(0)
    order = lambda c: F.coalesce(F.bitwise_not(c.cast("bigint")), F.lit(2**63 - 1))

    # the first id of every range, and the range each is followed by: one row per range
    tops = ids.groupBy(number(F.col("_id")).alias("_range")).agg(F.min(order(F.col("_id"))).alias("_order"))
    by_range = Window.orderBy(F.desc("_range"))
    everything = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = tops.select(
        "_order", F.coalesce(F.lag("_range").over(by_range), F.last("_range").over(everything)).alias("_range")
    )
    rows = df.withColumn("_range", number(F.col(doc_id))).withColumn("_order", order(F.col(doc_id)))
    heads = (
        rows.drop("_range").join(F.broadcast(before), "_order")
        .withColumn("_n", F.row_number().over(Window.partitionBy("_order").orderBy(F.col(text).asc_nulls_first())))
        .where("_n = 1")
        .select("_range", F.struct(*carried).alias("_head"))
    )
    inside = Window.partitionBy("_range").orderBy("_order", F.col(text).asc_nulls_first())
    found = rows.withColumn("_after", F.lead(F.struct(*carried)).over(inside))
    joined = found.join(heads, "_range", "left")
    return joined.withColumn("_next", F.coalesce("_after", "_head")).drop("_range", "_order", "_after", "_head")


def edited_fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, fraction: float = FRACTION,
    ranges: int | None = None,
) -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness.

    The edited text has its last third (whole code points, rounded down)
    replaced by as many first code points of the next text, or all of it if it
    is shorter. Returns one row per input row: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, inside_next (the
    estimated share of the text found in the next, NULL where the sketch of a
    short text cannot tell). Columns of ``docs`` other
    than id and text are ignored. An empty table gives an empty result; a
    single row is its own next.
    """
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = with_sketch(base, "text", "sketch", size, fraction)
    rows = next_rows(base, "doc_id", "text", ["text", "sketch"], ranges)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = (
        rows.withColumn("n_chars", n.cast("bigint"))
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("_next.text", F.lit(1), third)))
        .withColumn("next_sketch", F.col("_next.sketch"))
        .drop("_next", "text")
    )
    rows = with_sketch(rows, "edited", "edited_sketch", size, fraction)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("next_sketch"), fraction).alias("inside_next"),
    )
