"""Small tables written in code: corrections, label maps, periods."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def small_table(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """A DataFrame of literal rows.

    It is built from an Arrow table, so the optimizer knows its true size and
    its own threshold decides whether a join ships it whole.
    """
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    fields = to_arrow_schema(kind)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields), schema=kind)
