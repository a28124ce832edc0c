"""Null-safe joins, lookups, corrections and periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import OBS, observations, query
from seston.operators import joins as J
from seston.sources.small import small_table

# The key is missing for one order status, on both sides.
LEFT = """l AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, o_custkey % 5 AS grp FROM orders)"""
RIGHT = """r AS (SELECT nullif(o_orderstatus, 'P') AS status, o_custkey % 5 AS grp,
  count(*) AS orders, round(sum(o_totalprice), 2) AS spent FROM orders
  WHERE o_custkey % 5 < 3 GROUP BY 1, 2)"""


def left(t):
    return t.orders.select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        (F.col("o_custkey") % 5).alias("grp"),
    )


def right(t):
    keyed = t.orders.select(
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        (F.col("o_custkey") % 5).alias("grp"),
        "o_totalprice",
    )
    return keyed.filter("grp < 3").groupBy("status", "grp").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent")
    )


ON = "l.status IS NOT DISTINCT FROM r.status AND l.grp IS NOT DISTINCT FROM r.grp"


@query("natural_left_join", f"WITH {LEFT}, {RIGHT} SELECT l.*, orders, spent FROM l LEFT JOIN r ON {ON}")
def _(t):
    return J.natural_join(left(t), right(t), "left")


@query(
    "natural_full_join",
    f"""WITH {LEFT}, {RIGHT}, k AS (SELECT * FROM l WHERE grp > 1)
    SELECT coalesce(l.status, r.status) AS status, coalesce(l.grp, r.grp) AS grp, o_orderkey, orders, spent
    FROM k l FULL JOIN r ON {ON}""",
)
def _(t):
    return J.natural_join(left(t).filter("grp > 1"), right(t), "full")


@query(
    "anti_join",
    f"WITH {LEFT}, {RIGHT} SELECT l.* FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE {ON})",
)
def _(t):
    return J.natural_join(left(t), right(t), "anti")


@query(
    "semi_join",
    f"WITH {LEFT}, {RIGHT} SELECT l.* FROM l WHERE EXISTS (SELECT 1 FROM r WHERE {ON})",
)
def _(t):
    return J.natural_join(left(t), right(t), "semi")


@query(
    "lookup_join_first",
    """WITH d AS (SELECT p_name AS taxon, p_type AS category, p_brand AS brand FROM part),
      f AS (SELECT taxon, category, brand FROM (
        SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY category, brand) AS k FROM d) WHERE k = 1)
    SELECT p_partkey, p_name AS taxon, category, brand FROM part LEFT JOIN f ON p_name = taxon""",
)
def _(t):
    dim = t.part.selectExpr("p_name AS taxon", "p_type AS category", "p_brand AS brand")
    return J.join_lookup(t.part.selectExpr("p_partkey", "p_name AS taxon"), dim, ["taxon"], "first")


@query(
    "lookup_join_unique",
    """SELECT l_orderkey, l_linenumber, l_suppkey, s_nationkey, n_name FROM lineitem
       LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey""",
)
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey")
    sites = t.supplier.selectExpr("s_suppkey AS l_suppkey", "s_nationkey")
    names = t.nation.selectExpr("n_nationkey AS s_nationkey", "n_name")
    return J.join_lookup(J.join_lookup(lines, sites), names)


@query(
    "reconcile_keys",
    """WITH a AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'F'),
       b AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'right'
      WHEN b.key IS NULL THEN 'left' ELSE 'both' END AS found_in FROM a FULL JOIN b ON a.key = b.key""",
)
def _(t):
    o = t.orders.withColumnRenamed("o_custkey", "key")
    return J.reconcile(o.filter("o_orderstatus = 'F'"), o.filter("o_orderpriority = '1-URGENT'"), ["key"])


@query(
    "keyed_corrections",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag,
         CASE WHEN l_suppkey = 1 AND l_returnflag = 'A' THEN 0.5
              WHEN l_suppkey = 2 AND l_returnflag = 'N' THEN 0.25 ELSE l_discount END AS l_discount
       FROM lineitem""",
)
def _(t):
    patch = small_table(
        t.spark, [(1, "A", 0.5), (2, "N", 0.25)], "l_suppkey long, l_returnflag string, fixed double"
    )
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_discount")
    return J.apply_corrections(x, patch, ["l_suppkey", "l_returnflag"], "l_discount")


@query(
    "enrich_with_fallback",
    """WITH a AS (SELECT p_name AS name, min(p_brand) AS brand, min(p_size) AS size FROM part
                  WHERE p_name LIKE 'b%' OR p_name LIKE 'c%' OR p_name LIKE '%rod' GROUP BY 1),
       b AS (SELECT split_part(p_name, ' ', 2) AS genus, max(p_brand) AS brand, max(p_size) AS size FROM part
             WHERE p_name NOT LIKE '%anvil' GROUP BY 1)
    SELECT p_partkey, p_name AS name, split_part(p_name, ' ', 2) AS genus,
      CASE WHEN a.name IS NOT NULL THEN a.brand ELSE b.brand END AS brand,
      CASE WHEN a.name IS NOT NULL THEN a.size ELSE b.size END AS size,
      CASE WHEN a.name IS NOT NULL THEN 'primary' WHEN b.genus IS NOT NULL THEN 'fallback' ELSE 'none' END AS matched
    FROM part p LEFT JOIN a ON p.p_name = a.name LEFT JOIN b ON split_part(p.p_name, ' ', 2) = b.genus""",
)
def _(t):
    named = t.part.withColumns({"name": F.col("p_name"), "genus": F.split_part("p_name", F.lit(" "), F.lit(2))})
    a = named.filter(F.col("name").rlike("^[bc]|rod$")).groupBy("name").agg(
        F.min("p_brand").alias("brand"), F.min("p_size").alias("size")
    )
    b = named.filter("genus <> 'anvil'").groupBy("genus").agg(
        F.max("p_brand").alias("brand"), F.max("p_size").alias("size")
    )
    return J.enrich_with_fallback(named.select("p_partkey", "name", "genus"), a, b, ["name"], ["genus"])


#: half years and quarters; two overlap, one has no dates
PERIODS = [
    ("S1", "1996-01-01", "1996-06-30", "first"),
    ("S1", "1997-07-01", "1997-12-31", "second"),
    ("S4", "1995-04-01", "1996-03-31", "first"),
    ("S4", "1996-01-01", "1996-09-30", "second"),
    ("S9", None, None, "first"),
]


def periods(t):
    rows = small_table(t.spark, PERIODS, "site string, a string, b string, treatment string")
    return rows.select(
        "site", F.col("a").cast("date").alias("start"), F.col("b").cast("date").alias("end"), "treatment"
    )


PERIOD_SQL = """periods AS (SELECT * FROM (VALUES
  ('S1', DATE '1996-01-01', DATE '1996-06-30', 'first'), ('S1', DATE '1997-07-01', DATE '1997-12-31', 'second'),
  ('S4', DATE '1995-04-01', DATE '1996-03-31', 'first'), ('S4', DATE '1996-01-01', DATE '1996-09-30', 'second'))
  v(site, a, b, treatment))"""


@query(
    "in_treatment_period",
    f"""WITH {OBS}, {PERIOD_SQL} SELECT o.site, o.date, o.taxon, o.density, EXISTS (SELECT 1 FROM periods p
      WHERE p.site = o.site AND o.date BETWEEN p.a AND p.b) AS in_period FROM obs o""",
)
def _(t):
    x = observations(t).select("site", "date", "taxon", "density")
    return J.in_period(x, periods(t), "site", "date")


@query(
    "treatment_period_label",
    f"""WITH {OBS}, {PERIOD_SQL} SELECT o.site, o.date, o.taxon, o.density, p.treatment FROM obs o
      LEFT JOIN periods p ON p.site = o.site AND o.date BETWEEN p.a AND p.b""",
)
def _(t):
    x = observations(t).select("site", "date", "taxon", "density")
    return J.in_period(x, periods(t), "site", "date", label="treatment")
