"""Grouped sums, audits, ranks and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import OBS, observations, query
from catalog.columns import GAPPY, gappy
from seston.operators import ranks as K
from seston.operators import reshape as P
from seston.operators import summary as S
from seston.operators.ordering import first_per

KEYED = """keyed AS (SELECT nullif(l_returnflag, 'A') AS k, l_linestatus AS s, nullif(l_quantity, 7) AS q,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_tax END AS x FROM lineitem)"""


def keyed(t):
    return t.lineitem.select(
        F.nullif("l_returnflag", F.lit("A")).alias("k"),
        F.col("l_linestatus").alias("s"),
        F.nullif("l_quantity", F.lit(7.0)).alias("q"),
        F.when(F.col("l_returnflag") != "N", F.col("l_tax")).alias("x"),
    )


@query("count_by_key", f"WITH {KEYED} SELECT k, s, count(*) AS n FROM keyed GROUP BY ALL")
def _(t):
    return S.count_by(keyed(t), ["k", "s"])


@query(
    "sum_by_key",
    f"WITH {KEYED} SELECT k, s, round(coalesce(sum(q), 0), 4) AS q, round(coalesce(sum(x), 0), 4) AS x FROM keyed GROUP BY k, s",
)
def _(t):
    out = S.sum_by(keyed(t), ["k", "s"], ["q", "x"])
    return out.select("k", "s", F.round("q", 4).alias("q"), F.round("x", 4).alias("x"))


@query(
    "exact_sums",
    """SELECT l_suppkey, CAST(sum(l_orderkey * 10000000000 + l_partkey) AS VARCHAR) AS whole,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(20, 4)) * 100000000000) AS VARCHAR) AS price,
      CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS rounded FROM lineitem GROUP BY l_suppkey""",
)
def _(t):
    """Sums beyond the whole numbers that a double or a long can hold, and one of doubles that no order of rows changes."""
    rows = t.lineitem.select(
        "l_suppkey",
        (F.col("l_orderkey") * F.lit(10_000_000_000) + F.col("l_partkey")).alias("whole"),
        (F.col("l_extendedprice").cast("decimal(20,4)") * F.lit(100_000_000_000).cast("decimal(12,0)")).alias("price"),
        F.col("l_extendedprice").alias("rounded"),
    )
    out = S.sum_by(rows, ["l_suppkey"], ["whole", "price", "rounded"], decimals=2, wide=True)
    return out.select("l_suppkey", F.col("whole").cast("string"), F.col("price").cast("string"), "rounded")


@query(
    "sum_by_complete_keys",
    f"WITH {KEYED} SELECT k, round(coalesce(sum(q), 0), 4) AS q FROM keyed WHERE k IS NOT NULL GROUP BY k",
)
def _(t):
    out = S.sum_by(keyed(t), ["k"], ["q"], drop_null_keys=True)
    return out.select("k", F.round("q", 4).alias("q"))


PROPAGATED = """SELECT l_suppkey, CASE WHEN count(nullif(l_tax, 0.08)) = count(*) THEN
   round({}(nullif(l_tax, 0.08)), 9) END AS tax FROM lineitem GROUP BY l_suppkey, l_linenumber, l_returnflag"""


def by_supplier(t):
    return t.lineitem.select(
        "l_suppkey", "l_linenumber", "l_returnflag", F.nullif("l_tax", F.lit(0.08)).alias("tax")
    )


GROUPED = ["l_suppkey", "l_linenumber", "l_returnflag"]


@query("sum_propagating_missing", PROPAGATED.format("sum"))
def _(t):
    out = S.sum_by(by_supplier(t), GROUPED, ["tax"], na="propagate")
    return out.select("l_suppkey", F.round("tax", 9).alias("tax"))


@query("mean_propagating_missing", PROPAGATED.format("avg"))
def _(t):
    out = S.mean_by(by_supplier(t), GROUPED, ["tax"], na="propagate")
    return out.select("l_suppkey", F.round("tax", 9).alias("tax"))


REPS = f"""WITH {OBS}, per AS (SELECT site, survey, taxon, rep, sum(density) AS d FROM obs GROUP BY ALL)"""


@query(
    "replicate_mean_present",
    f"{REPS} SELECT site, survey, taxon, round(avg(d), 6) AS density FROM per GROUP BY site, survey, taxon",
)
def _(t):
    out = S.replicate_mean(observations(t), ["site", "survey"], "taxon", "rep", ["density"])
    return out.withColumn("density", F.round("density", 6))


@query(
    "replicate_mean_all",
    f"""{REPS}, taken AS (SELECT site, survey, count(DISTINCT rep) AS m FROM per GROUP BY ALL)
    SELECT site, survey, taxon, round(sum(d) / any_value(m), 6) AS density
    FROM per JOIN taken USING (site, survey) GROUP BY site, survey, taxon""",
)
def _(t):
    out = S.replicate_mean(observations(t), ["site", "survey"], "taxon", "rep", ["density"], absent="zero")
    return out.withColumn("density", F.round("density", 6))


@query(
    "mean_and_deviation",
    """SELECT 'l_quantity' AS variable, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean,
         round(stddev_samp(l_quantity), 6) AS sd FROM lineitem
       UNION ALL SELECT 'l_extendedprice', count(l_extendedprice), round(avg(l_extendedprice), 6),
         round(stddev_samp(l_extendedprice), 6) FROM lineitem""",
)
def _(t):
    out = S.summary_stats(t.lineitem, ["l_quantity", "l_extendedprice"])
    return out.select("variable", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(
    "column_ranges",
    """SELECT 'l_quantity' AS variable, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem
       UNION ALL SELECT 'l_linenumber', CAST(min(l_linenumber) AS DOUBLE), CAST(max(l_linenumber) AS DOUBLE) FROM lineitem
       UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice) FROM lineitem""",
)
def _(t):
    return S.col_ranges(t.lineitem, ["l_quantity", "l_linenumber", "l_extendedprice"])


@query(
    "missing_counts",
    f"""WITH {GAPPY} SELECT 'a' AS variable, count(*) - count(a) AS missing FROM gappy
      UNION ALL SELECT 'b', count(*) - count(b) FROM gappy UNION ALL SELECT 'c', count(*) - count(c) FROM gappy""",
)
def _(t):
    return S.null_counts(gappy(t), ["a", "b", "c"])


@query("distinct_combinations", f"WITH {OBS} SELECT DISTINCT site, survey FROM obs")
def _(t):
    return S.distinct_keys(observations(t), ["site", "survey"])


@query(
    "distinct_value_counts",
    """SELECT 'p_name' AS variable, count(DISTINCT p_name) AS n FROM part
       UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part
       UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part""",
)
def _(t):
    return S.distinct_counts(t.part, ["p_name", "p_brand", "p_size"])


@query("crosstab", "SELECT p_type, p_brand, p_size, count(*) AS n FROM part GROUP BY ALL")
def _(t):
    return S.crosstab_long(t.part, ["p_type", "p_brand", "p_size"])


@query(
    "keys_with_two_parents",
    """SELECT o_custkey, o_orderstatus, count(DISTINCT o_orderpriority) AS n_values,
         min(o_orderpriority) AS first_value, max(o_orderpriority) AS last_value
       FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderpriority) > 1""",
)
def _(t):
    return S.fd_violations(t.orders, ["o_custkey", "o_orderstatus"], "o_orderpriority")


@query(
    "two_parent_combinations",
    """SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (
         SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1) GROUP BY ALL""",
)
def _(t):
    return S.fd_violation_pairs(t.orders, "o_custkey", "o_orderstatus")


@query(
    "mismatched_rows",
    """SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_discount IS DISTINCT FROM l_tax""",
)
def _(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return S.mismatch_rows(x, "l_discount", "l_tax")


@query(
    "mismatch_total",
    """SELECT count(*) FILTER (l_discount IS DISTINCT FROM l_tax) AS rows,
         round(sum(l_discount - l_tax), 4) AS difference FROM lineitem""",
)
def _(t):
    out = S.mismatch_total(t.lineitem, "l_discount", "l_tax")
    return out.select("rows", F.round("difference", 4).alias("difference"))


@query(
    "occupancy",
    f"""WITH {OBS}, n AS (SELECT count(DISTINCT sample) AS n FROM obs)
    SELECT taxon, count(DISTINCT sample) AS n_samples, round(count(DISTINCT sample) / any_value(n), 3) AS share
    FROM obs, n GROUP BY taxon""",
)
def _(t):
    return S.occupancy(observations(t), "sample", "taxon")


@query("richness", f"WITH {OBS} SELECT sample, count(DISTINCT taxon) AS richness FROM obs GROUP BY sample")
def _(t):
    return S.richness(observations(t), "sample", "taxon")


@query(
    "matrix_fill",
    f"""WITH {OBS} SELECT count(DISTINCT sample) AS samples, count(DISTINCT taxon) AS taxa,
      count(DISTINCT (sample, taxon)) AS filled,
      round(count(DISTINCT (sample, taxon)) / (count(DISTINCT sample) * count(DISTINCT taxon)), 6) AS fill FROM obs""",
)
def _(t):
    return S.matrix_fill(observations(t), "sample", "taxon").withColumn("fill", F.round("fill", 6))


@query(
    "histogram",
    """SELECT CAST(b AS DOUBLE) AS low, CAST(b + 5 AS DOUBLE) AS high,
         count(l_quantity) AS n FROM generate_series(0, 45, 5) g(b)
       LEFT JOIN lineitem ON (l_quantity > b OR (b = 0 AND l_quantity = 0)) AND l_quantity <= b + 5 GROUP BY b""",
)
def _(t):
    return S.histogram(t.lineitem, "l_quantity", 10)


@query(
    "share_of_total",
    """WITH s AS (SELECT o_orderpriority AS p, o_orderstatus AS s, sum(o_totalprice) AS v FROM orders GROUP BY ALL)
       SELECT p, s, round(v, 2) AS v, round(v / sum(v) OVER (PARTITION BY p), 6) AS share FROM s""",
)
def _(t):
    x = t.orders.groupBy(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s")).agg(
        F.sum("o_totalprice").alias("v")
    )
    out = K.share_of(x, "v", ["p"])
    return out.select("p", "s", F.round("v", 2).alias("v"), F.round("share", 6).alias("share"))


@query(
    "stacked_bounds",
    """WITH s AS (SELECT o_orderpriority AS p, o_orderstatus AS s, sum(o_totalprice) AS v FROM orders GROUP BY ALL)
       SELECT p, s, round(v, 2) AS v, round(sum(v) OVER w, 2) AS upper, round(sum(v) OVER w - v, 2) AS lower
       FROM s WINDOW w AS (PARTITION BY p ORDER BY s ROWS UNBOUNDED PRECEDING)""",
)
def _(t):
    x = t.orders.selectExpr("o_orderpriority AS p", "o_orderstatus AS s", "o_totalprice AS v")
    out = K.stack_bounds(x, "v", ["p"], "s")
    return out.select("p", "s", *[F.round(c, 2).alias(c) for c in ("v", "upper", "lower")])


@query(
    "average_rank",
    """SELECT event_id, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rank
       FROM events""",
)
def _(t):
    return K.avg_rank(t.events.select("event_id", "value"), "value")


@query(
    "average_rank_by_group",
    """SELECT event_id, event_type, value, rank() OVER (PARTITION BY event_type ORDER BY value)
         + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rank FROM events""",
)
def _(t):
    return K.avg_rank(t.events.select("event_id", "event_type", "value"), "value", by=["event_type"])


FIVE = """, n AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY x) AS r,
    floor((count(*) OVER (PARTITION BY g) + 3) / 2) / 2 AS d FROM v)
  SELECT {} n, round(max(x) FILTER (r = 1), 6) AS low,
    round((max(x) FILTER (r = floor(d)) + max(x) FILTER (r = ceil(d))) / 2, 6) AS lower_hinge,
    round((max(x) FILTER (r = floor((n + 1) / 2)) + max(x) FILTER (r = ceil((n + 1) / 2))) / 2, 6) AS median,
    round((max(x) FILTER (r = floor(n + 1 - d)) + max(x) FILTER (r = ceil(n + 1 - d))) / 2, 6) AS upper_hinge,
    round(max(x) FILTER (r = n), 6) AS high FROM n GROUP BY g, n"""


def rounded_five(df, *keys):
    cols = ["low", "lower_hinge", "median", "upper_hinge", "high"]
    return df.select(*keys, "n", *[F.round(c, 6).alias(c) for c in cols])


@query("five_numbers", "WITH v AS (SELECT 1 AS g, l_extendedprice AS x FROM lineitem)" + FIVE.format(""))
def _(t):
    return rounded_five(K.tukey_five(t.lineitem, "l_extendedprice"))


@query(
    "five_numbers_by_group",
    "WITH v AS (SELECT event_type AS g, value AS x FROM events)" + FIVE.format("g AS event_type,"),
)
def _(t):
    return rounded_five(K.tukey_five(t.events, "value", ["event_type"]), "event_type")


@query(
    "first_row_per_key",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (
         PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice, o_orderkey) AS k FROM orders) WHERE k = 1""",
)
def _(t):
    x = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return first_per(x, ["o_custkey"], ["o_orderdate", "o_totalprice", "o_orderkey"])


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
WIDE = ", ".join(f"max(n) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in PRIORITIES)
WIDE0 = ", ".join(f"coalesce(max(n) FILTER (o_orderpriority = '{p}'), 0) AS \"{p}\"" for p in PRIORITIES)
COUNTS = "c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)"


def counts(t):
    return S.count_by(t.orders, ["o_custkey", "o_orderpriority"])


@query("long_to_wide", f"WITH {COUNTS} SELECT o_custkey, {WIDE} FROM c GROUP BY o_custkey")
def _(t):
    return P.spread(counts(t), ["o_custkey"], "o_orderpriority", "n", PRIORITIES)


@query("long_to_wide_zeros", f"WITH {COUNTS} SELECT o_custkey, {WIDE0} FROM c GROUP BY o_custkey")
def _(t):
    return P.fill_zero(P.spread(counts(t), ["o_custkey"], "o_orderpriority", "n", PRIORITIES), PRIORITIES)


@query(
    "analytes_to_columns",
    """SELECT user_id, CAST(ts AS DATE) AS date, round(sum(value) FILTER (event_type = 'click'), 2) AS click,
         round(sum(value) FILTER (event_type = 'purchase'), 2) AS purchase,
         round(sum(value) FILTER (event_type = 'view'), 2) AS view FROM events GROUP BY ALL""",
)
def _(t):
    names = ["click", "purchase", "view"]
    x = t.events.select("user_id", F.to_date("ts").alias("date"), "event_type", "value")
    wide = P.spread(x, ["user_id", "date"], "event_type", "value", names, on_dup="sum")
    return wide.select("user_id", "date", *[F.round(n, 2).alias(n) for n in names])


@query(
    "wide_to_long",
    """SELECT l_orderkey, l_linenumber, 'l_discount' AS measure, l_discount AS rate FROM lineitem
       UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""",
)
def _(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return P.gather(x, ["l_orderkey", "l_linenumber"], "measure", "rate")


@query(
    "explicit_zeros",
    f"""WITH {OBS}, f AS (SELECT sample, taxon, sum(density) AS density FROM obs GROUP BY ALL)
    SELECT s.sample, x.taxon, coalesce(f.density, 0) AS density FROM (SELECT DISTINCT sample FROM obs) s
    CROSS JOIN (SELECT DISTINCT taxon FROM obs) x LEFT JOIN f ON f.sample = s.sample AND f.taxon = x.taxon""",
)
def _(t):
    return P.complete(observations(t), "sample", "taxon", "density")
