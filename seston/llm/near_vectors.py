"""Embedding near-dedup: an exact range join of unit vectors in a metric space.

Pivots (a bounded sample of the vectors) cut space into cells; a vector is at
home in the cell of its nearest pivot. A vector at distance s from the plane
between two pivots is at least s from everything beyond it, by the triangle
inequality, so a vector is sent as well to every earlier cell whose plane is
within the search radius. Every linked pair then meets in the cell of the
earlier of its two homes, and cells are joined independently.

A cell is cut into blocks of home vectors and blocks of members; a task holds
one block of each and works in strips. Of the links it finds it keeps, per
vector, their number, and a spanning forest, never the pairs.

* Equal vectors are one class with a count. Vectors that are NULL, empty, zero
  or have NULL, NaN or infinite components link with nothing. Vectors of
  different length do not link.
* Cosines are computed in double precision; single precision only sorts out
  pairs that are clearly below the threshold.
* Repeated ids each give a row. A NULL id counts as a link of others, has the
  component of its class, and is not kept if its component has an id.
* An empty table gives an empty result; other columns are ignored.

In many dimensions planes are near every vector, and the join comes close to
comparing all pairs of blocks: the cost is then that of all pairs, halved.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seston.durable import Staged
from seston.llm.common import components

COSINE = 0.95
CELL = 4096
MOST_PIVOTS = 256
STRIP = 512
SLACK = 1e-4


def unit_rows(values: np.ndarray) -> np.ndarray:
    values = np.asarray(values, np.float64)
    # a power of two brings the largest component near 1, so that squares neither overflow nor vanish
    values = np.ldexp(values, -np.frexp(np.abs(values).max(1, initial=0.0))[1][:, None])
    return values / np.sqrt((values * values).sum(1))[:, None]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(whole)
    return unit_rows(whole.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)) if n else np.zeros((0, 1))


def cells_of(vectors: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, list[list[int]]]:
    """Home of every vector, and the cells it is sent to (the home first)."""
    near = vectors @ pivots.T
    home = near.argmax(1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    rows = np.arange(len(vectors))
    above = near[rows, home][:, None] - near
    beyond = above <= (radius + 1e-9) * gap[home]
    beyond &= np.arange(len(pivots))[None, :] < home[:, None]
    return home, [[int(h), *np.flatnonzero(b).tolist()] for h, b in zip(home, beyond, strict=True)]


def block_links(table: pa.Table, cosine: float) -> pa.Table:
    """id, links, other: counts of links (weighted) and a spanning forest of one
    block of home vectors and one block of members."""
    ids = table.column("id").to_numpy()
    weight = table.column("n").to_numpy()
    is_row = table.column("row_side").to_numpy(zero_copy_only=False)
    at_home = table.column("at_home").to_numpy(zero_copy_only=False)
    all_vectors = matrix(table.column("v"))
    rows, cols = np.flatnonzero(is_row), np.flatnonzero(~is_row)
    single = all_vectors.astype(np.float32)
    counts = np.zeros(len(ids), np.int64)
    to: dict[int, int] = {}

    def root(x: int) -> int:
        while to.setdefault(x, x) != x:
            to[x] = to[to[x]]
            x = to[x]
        return x

    a, b = [], []
    for start in range(0, len(rows), STRIP):
        part = rows[start : start + STRIP]
        i, j = np.nonzero(single[part] @ single[cols].T >= cosine - SLACK)
        i, j = part[i], cols[j]
        for cut in range(0, len(i), 100_000):
            x, y = i[cut : cut + 100_000], j[cut : cut + 100_000]
            # one order of the two vectors for either direction of the pair
            good = (all_vectors[x] * all_vectors[y]).sum(1) >= cosine
            good |= ids[x] == ids[y]
            x, y = x[good], y[good]
            np.add.at(counts, x, weight[y])
            sent = ~at_home[y]
            np.add.at(counts, y[sent], weight[x[sent]])
            for p, q in zip(ids[x].tolist(), ids[y].tolist(), strict=True):
                if p != q and (r := root(p)) != (s := root(q)):
                    to[r] = s
                    a.append(p)
                    b.append(q)
    some = np.flatnonzero(counts)
    return pa.table({
        "id": pa.array(np.concatenate([ids[some], np.array(a, np.int64)]), pa.int64()),
        "links": pa.array(np.concatenate([counts[some], np.zeros(len(a), np.int64)]), pa.int64()),
        "other": pa.array([None] * len(some) + b, pa.int64()),
    })


def near_duplicates(
    table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, cell: int = CELL
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row (see the module)."""
    rows = table.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    nonzero = F.exists("v", lambda x: x.cast("double") != 0)
    usable = F.coalesce(finite & nonzero, F.lit(False))
    good = rows.where(usable)
    classes = Staged(
        good.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id())
    )
    total = classes.df.count()
    radius = math.sqrt(2 - 2 * cosine)
    wanted = min(MOST_PIVOTS, max(1, math.ceil(total / cell)))
    # pivots: a bounded sample in hash order, per length of vectors
    sizes = [r[0] for r in classes.df.select(F.size("v").alias("d")).distinct().collect()]
    pivots = {}
    for d in sizes:
        some = classes.df.where(F.size("v") == d).orderBy(F.xxhash64("v")).limit(wanted).select("v").collect()
        pivots[d] = unit_rows(np.array([r[0] for r in some]))

    def place(batches):
        for batch in batches:
            v = batch.column("v")
            lengths = np.array([len(x) for x in v])
            for d in np.unique(lengths):
                part = batch.filter(pa.array(lengths == d))
                home, cells = cells_of(matrix(part.column("v")), pivots[int(d)], radius)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("n"), part.column("v"),
                     pa.array(np.full(len(home), d), pa.int32()), pa.array(home, pa.int32()), pa.array(cells, pa.list_(pa.int32()))],
                    ["id", "n", "v", "d", "home", "cells"],
                )

    kind = classes.df.schema["v"].dataType.simpleString()
    placed = classes.df.select("id", "n", "v").mapInArrow(place, f"id bigint, n bigint, v {kind}, d int, home int, cells array<int>")
    placed = Staged(placed)
    # blocks of each cell; there are at most MOST_PIVOTS cells for each length
    members = placed.df.select("d", "home", F.explode("cells").alias("cell")).groupBy("d", "cell").agg(
        F.ceil(F.count("*") / cell).cast("int").alias("col_blocks"),
        F.greatest(F.lit(1), F.ceil(F.count_if(F.col("home") == F.col("cell")) / cell)).cast("int").alias("row_blocks"),
    )
    spread = placed.df.select("id", "n", "v", "d", "home", F.explode("cells").alias("cell")).join(F.broadcast(members), ["d", "cell"])
    mine = lambda c: F.pmod(F.xxhash64("id"), c).cast("int")
    as_row = spread.where("home = cell").withColumn("i", mine(F.col("row_blocks"))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("col_blocks") - 1))
    )
    as_col = spread.withColumn("j", mine(F.col("col_blocks"))).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1))
    )
    columns = ["d", "cell", "i", "j", "id", "n", "v"]
    both = as_row.select(*columns, F.lit(True).alias("row_side"), F.lit(True).alias("at_home")).unionByName(
        as_col.select(*columns, F.lit(False).alias("row_side"), (F.col("home") == F.col("cell")).alias("at_home"))
    )
    found = both.groupBy("d", "cell", "i", "j").applyInArrow(
        lambda t: block_links(t, cosine), "id bigint, links bigint, other bigint"
    )
    found = Staged(found)
    counts = found.df.groupBy("id").agg(F.sum("links").alias("links"))
    part = components(found.df.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = classes.df.join(part, "id", "left").join(counts, "id", "left").withColumn("c", F.coalesce("component", "id"))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    answer = named.join(least, "c").select("v", "component_id", (F.col("links") - 1).alias("n_links"))
    linked = good.join(answer, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
