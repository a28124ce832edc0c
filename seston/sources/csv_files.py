"""CSV inputs whose headers drift from file to file, and CSV/partitioned outputs."""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seston.functions.numbers import to_number
from seston.functions.text import from_end

MISSING = ("", "NA")


def _as_schema(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def headers(spark: SparkSession, glob: str) -> dict[tuple[str, ...], list[str]]:
    """Files that match ``glob`` by their column names. Lines are read in tasks
    and only the first of each file is returned, so no file is opened on the
    driver; a file without lines has no header and is left out."""
    try:
        lines = spark.read.text(glob)
        first = (
            lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
            .where("at = 0")
            .withColumn("line", F.monotonically_increasing_id())
            .groupBy("file")
            .agg(F.min_by("value", "line").alias("head"))
        )
        alike = first.groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no file matches {glob}") from None
        raise
    found: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for row in sorted(alike, key=lambda r: r["head"]):
        found[tuple(next(csv.reader([row["head"].lstrip("\ufeff")]), []))] += row["files"]
    if not found:
        raise FileNotFoundError(f"no file with a header matches {glob}")
    return dict(found)


def _typed(name: str, kind: T.DataType, missing: Sequence[str]) -> Column:
    raw = F.col(f"`{name}`")
    present = F.when(~F.trim(raw).isin(*missing), raw)
    if isinstance(kind, T.StringType):
        return present.alias(name)
    return to_number(present, kind.simpleString()).alias(name)


def read_csv_dir(
    spark: SparkSession,
    glob: str,
    schema: T.StructType | str,
    missing: Sequence[str] = MISSING,
    source: str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Union of every CSV matching ``glob``, columns matched by name.

    One scan reads all files that share a header; a column a file lacks is
    NULL, a column not in ``schema`` is left out. Values are read as text and
    cast, so a bad value is NULL. ``source`` names a column for the file path.

    ``multiline`` allows line breaks inside quotes; a file is then one task.

    The files are grouped by header in a job of its own when this is called.
    """
    wanted = _as_schema(schema)
    groups = headers(spark, glob)

    parts = []
    for header, paths in sorted(groups.items()):
        text = T.StructType([T.StructField(n, T.StringType()) for n in header])
        raw = spark.read.schema(text).csv(paths, header=True, multiLine=multiline, escape='"')
        cols = [_typed(f.name, f.dataType, missing) for f in wanted if f.name in header]
        if source:
            cols.append(F.col("_metadata.file_path").alias(source))
        parts.append(raw.select(*cols))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    order = wanted.names + ([source] if source else [])
    have = set(both.columns)
    return both.select(
        *[
            F.col(f"`{n}`") if n in have else F.lit(None).cast(wanted[n].dataType).alias(n)
            for n in order
        ]
    )


#: what a text can be read as, the narrowest first; a value fits a type if its
#: pattern matches, so the types that fit all values are the common bits. A
#: number with leading zeros is a code and stays text.
PATTERNS = [
    ("boolean", "^(?i:true|false|t|f)$"),
    ("bigint", "^[+-]?(0|[1-9][0-9]{0,17})$"),
    ("double", "^[+-]?((0|[1-9][0-9]*)([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"),
    ("date", "^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"),
    ("timestamp", "^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"),
]


def inferred_types(df: DataFrame, missing: Sequence[str] = MISSING) -> dict[str, str]:
    """The narrowest type of each text column that fits all its values.

    Every value is turned into the set of types it fits, and the sets are
    intersected in one aggregation, whatever the number of columns. Values in
    ``missing`` fit every type; a column without other values is text.
    """
    each = []
    for c in df.columns:
        raw = F.trim(F.col(f"`{c}`"))
        fits = sum((F.when(raw.rlike(p), 1 << k).otherwise(0) for k, (_, p) in enumerate(PATTERNS)), F.lit(0))
        # a date that the calendar does not have is text
        dated = F.when(fits.bitwiseAND(1 << 3) > 0, F.try_to_date(raw, "yyyy-MM-dd").isNotNull()).otherwise(True)
        each.append(F.bit_and(F.when(~raw.isin(*missing), F.when(dated, fits).otherwise(0))))
    if not each:
        return {}
    found = df.agg(F.array(*each)).first()[0]
    kinds = [next((name for k, (name, _) in enumerate(PATTERNS) if bits and bits >> k & 1), "string") for bits in found]
    return dict(zip(df.columns, kinds, strict=True))


def _read_as(name: str, kind: str, missing: Sequence[str]) -> Column:
    raw = F.col(f"`{name}`")
    present = F.when(~F.trim(raw).isin(*missing), raw)
    if kind == "string":
        return present.alias(name)
    value = F.trim(present)
    if kind == "boolean":
        return (F.lower(F.substring(value, 1, 1)) == "t").alias(name)
    return value.try_cast(kind).alias(name)


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    missing: Sequence[str] = MISSING,
    infer: bool = False,
    multiline: bool = False,
) -> DataFrame:
    """One table: a parquet path, or a CSV with a header. With no schema a CSV
    keeps its columns as text, or with ``infer`` gets the narrowest types that
    fit all values, found in one pass when this is called. ``multiline`` allows
    line breaks inside quotes. Any path the cluster can reach will do, so a
    remote table is read the same way as a local one."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=multiline, escape='"')
    if schema is None and infer:
        return raw.select(*[_read_as(c, kind, missing) for c, kind in inferred_types(raw, missing).items()])
    wanted = _as_schema(schema) if schema else raw.schema
    return raw.select(*[_typed(f.name, f.dataType, missing) for f in wanted])


def with_source(df: DataFrame, name: str = "source") -> DataFrame:
    """Add the path of the file each row came from. Call it right on a scan."""
    return df.withColumn(name, F.col("_metadata.file_path"))


def source_label(path: Column | str, start: int = -12, end: int = -6) -> Column:
    """Label cut from a path, by positions counted from its end."""
    return from_end(path, start, end)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write CSV part files with headers; missing values are written as NA,
    quotes inside values are doubled."""
    df.write.mode(mode).option("header", True).option("nullValue", "NA").option("escape", '"').csv(path)


def write_by(
    df: DataFrame, key: str | Sequence[str], path: str, format: str = "parquet", mode: str = "error"
) -> None:
    """One output folder per key value.

    Rows are rebalanced by key first: small keys share a task and get one file,
    and a key holding much of the data is split over several tasks.
    """
    keys = [key] if isinstance(key, str) else list(key)
    writer = df.hint("rebalance", *[F.col(k) for k in keys]).write.mode(mode).partitionBy(*keys)
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)
