"""Scans, columns, filters, sorting and stacking."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import query
from seston.durable import shared_folder
from seston.functions.numbers import row_mean, row_sum, with_row_mean
from seston.functions.text import matches
from seston.operators import columns as C
from seston.operators import filters as R
from seston.operators import ordering as O
from seston.sources.csv_files import read_csv_dir, read_table, write_by, write_csv


@query("scan_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def scratch(t, name):
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "csv_folder_by_name",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS o_totalprice, o_orderstatus,
         CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority FROM orders""",
)
def _(t):
    folder = scratch(t, "sheets")
    # an order without a status is in the second sheet, without its priority
    is_done = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    done, rest = t.orders.filter(is_done), t.orders.filter(~is_done)
    rest = rest.withColumn("o_orderpriority", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")))
    write_csv(done.select("o_orderkey", "o_totalprice", "o_orderstatus"), f"{folder}/done")
    write_csv(rest.select("o_orderstatus", "o_orderpriority", "o_orderkey"), f"{folder}/rest")
    schema = "o_orderkey long, o_totalprice double, o_orderstatus string, o_orderpriority string"
    return read_csv_dir(t.spark, f"{folder}/*/*.csv", schema)


# an order's note: two lines, with quotes and a comma
NOTE = "o_orderpriority || chr(10) || '\"' || o_orderstatus || '\", ' || o_orderkey"


@query(
    "single_csv_inferred",
    f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS price, CAST(o_orderdate AS DATE) AS day,
      o_orderstatus = 'O' AS open, '0' || o_custkey AS code, {NOTE} AS note FROM orders""",
)
def _(t):
    """A table of orders through a CSV file and back, its types found from the text."""
    folder = scratch(t, "orders")
    write_csv(
        t.orders.select(
            "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("price"),
            F.to_date("o_orderdate").alias("day"), (F.col("o_orderstatus") == "O").alias("open"),
            F.concat(F.lit("0"), F.col("o_custkey").cast("string")).alias("code"), F.expr(NOTE).alias("note"),
        ),
        folder,
    )
    return read_table(t.spark, folder, infer=True, multiline=True)


@query("csv_folder_line_breaks", f"SELECT o_orderkey, {NOTE} AS note, o_custkey FROM orders")
def _(t):
    folder = scratch(t, "notes")
    noted = t.orders.withColumn("note", F.expr(NOTE))
    even = F.col("o_orderkey") % 2 == 0
    write_csv(noted.where(even).select("o_orderkey", "note", "o_custkey"), f"{folder}/even")
    write_csv(noted.where(~even).select("note", "o_custkey", "o_orderkey"), f"{folder}/odd")
    return read_csv_dir(t.spark, f"{folder}/*/*.csv", "o_orderkey long, note string, o_custkey long", multiline=True)


@query("source_labels", "SELECT s_suppkey, s_name, CAST(s_nationkey % 2 AS VARCHAR) AS half FROM supplier")
def _(t):
    folder = scratch(t, "halves")
    for half in (0, 1):
        write_csv(t.supplier.filter(F.col("s_nationkey") % 2 == half), f"{folder}/half{half}")
    read = read_csv_dir(t.spark, f"{folder}/*/*.csv", "s_suppkey long, s_name string", source="source")
    label = F.regexp_extract("source", "half([01])/[^/]+$", 1)
    return read.select("s_suppkey", "s_name", label.alias("half"))


@query("output_by_key", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def _(t):
    folder = scratch(t, "by_key")
    write_by(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderpriority", folder)
    return t.spark.read.parquet(folder)


@query(
    "cast_text_columns",
    """SELECT event_id, TRY_CAST(event_type AS DOUBLE) AS event_type,
              TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k FROM events""",
)
def _(t):
    text = t.events.select(
        "event_id", "event_type", F.regexp_extract("props", "[0-9]+", 0).alias("k")
    )
    return C.cast_columns(text, {"event_type": "double", "k": "double"})


@query(
    "clean_column_names",
    """SELECT o_orderkey AS order_key, o_totalprice AS total_price_usd,
              o_orderstatus AS percent_status, o_custkey AS order_key_2 FROM orders""",
)
def _(t):
    messy = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey").toDF(
        "Order Key", "totalPrice (USD)", "% Status", "order-key"
    )
    return C.clean_names(messy)


@query(
    "select_columns",
    """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity AS units FROM lineitem""",
)
def _(t):
    return C.select_cols(t.lineitem, "l_orderkey:l_linenumber", "-l_suppkey", {"units": "l_quantity"})


@query("select_by_position", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def _(t):
    return C.select_at(t.customer, [1, 3, 5])


@query("rename_columns", "SELECT p_partkey AS id, p_name AS taxon, p_brand FROM part")
def _(t):
    return C.rename(t.part.select("p_partkey", "p_name", "p_brand"), {"p_partkey": "id", "p_name": "taxon"})


@query("relocate_columns", "SELECT s_suppkey, s_acctbal, s_name, s_nationkey FROM supplier")
def _(t):
    return C.relocate(t.supplier, ["s_acctbal"], after="s_suppkey")


@query(
    "derive_columns",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
              l_quantity * 2 AS doubled FROM lineitem""",
)
def _(t):
    return t.lineitem.withColumns(
        {
            "net": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4),
            "doubled": F.col("l_quantity") * 2,
        }
    ).select("l_orderkey", "l_linenumber", "net", "doubled")


@query(
    "map_column_list",
    "SELECT o_orderkey, lower(o_orderstatus) AS o_orderstatus, lower(o_orderpriority) AS o_orderpriority FROM orders",
)
def _(t):
    cols = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return C.map_columns(cols, ["o_orderstatus:o_orderpriority"], F.lower)


GAPPY = """gappy AS (SELECT l_orderkey, l_linenumber, nullif(l_quantity, 7) AS a, nullif(l_tax, 0) AS b,
  nullif(l_discount, 0.05) AS c FROM lineitem)"""


def gappy(t):
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.nullif("l_quantity", F.lit(7.0)).alias("a"),
        F.nullif("l_tax", F.lit(0.0)).alias("b"),
        F.nullif("l_discount", F.lit(0.05)).alias("c"),
    )


@query(
    "row_sums",
    f"""WITH {GAPPY} SELECT l_orderkey, l_linenumber,
      round(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0), 4) AS skipped,
      round(a + b + c, 4) AS propagated,
      round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0))
        / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0), 6) AS mean
    FROM gappy""",
)
def _(t):
    cols = ["a", "b", "c"]
    return gappy(t).select(
        "l_orderkey",
        "l_linenumber",
        F.round(row_sum(cols), 4).alias("skipped"),
        F.round(row_sum(cols, "propagate"), 4).alias("propagated"),
        F.round(row_mean(cols), 6).alias("mean"),
    )


@query(
    "global_mean_column",
    f"""WITH {GAPPY}, m AS (SELECT (coalesce(sum(a), 0) + coalesce(sum(b), 0) + coalesce(sum(c), 0))
        / (count(a) + count(b) + count(c)) AS m FROM gappy)
    SELECT l_orderkey, l_linenumber, round(m, 6) AS m FROM gappy, m""",
)
def _(t):
    out = with_row_mean(gappy(t), "m", ["a", "b", "c"], mode="global")
    return out.select("l_orderkey", "l_linenumber", F.round("m", 6).alias("m"))


@query(
    "unite_columns",
    """SELECT l_orderkey, l_linenumber,
        concat_ws('_', nullif(l_returnflag, 'A'), l_linestatus, CAST(l_linenumber AS VARCHAR)) AS id FROM lineitem""",
)
def _(t):
    x = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.nullif("l_returnflag", F.lit("A")).alias("flag"), "l_linestatus"
    )
    return C.unite(x, "id", ["flag", "l_linestatus", "l_linenumber"]).select("l_orderkey", "l_linenumber", "id")


@query(
    "separate_column",
    """SELECT o_orderkey, nullif(split_part(p, '-', 1), '') AS rank, nullif(split_part(p, '-', 2), '') AS label,
              nullif(split_part(p, '-', 3), '') AS extra
       FROM (SELECT o_orderkey, regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '-', 'g') AS p FROM orders)""",
)
def _(t):
    x = t.orders.select("o_orderkey", "o_orderpriority")
    return C.separate(x, "o_orderpriority", ["rank", "label", "extra"])


@query("literal_column", "SELECT n_nationkey, 'CLADOCERA' AS category, n_name FROM nation")
def _(t):
    return t.nation.select("n_nationkey", F.lit("CLADOCERA").alias("category"), "n_name")


@query(
    "filter_conditions",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
       WHERE l_quantity > 20 AND (l_returnflag = 'R' OR l_discount <= 0.02) AND l_linestatus <> 'F'""",
)
def _(t):
    keep = (
        (F.col("l_quantity") > 20)
        & ((F.col("l_returnflag") == "R") | (F.col("l_discount") <= 0.02))
        & (F.col("l_linestatus") != "F")
    )
    return t.lineitem.filter(keep).select("l_orderkey", "l_linenumber", "l_quantity")


@query("drop_missing", f"WITH {GAPPY} SELECT * FROM gappy WHERE a IS NOT NULL AND b IS NOT NULL")
def _(t):
    return R.drop_null(gappy(t), ["a", "b"])


@query("keep_missing", f"WITH {GAPPY} SELECT * FROM gappy WHERE c IS NULL")
def _(t):
    return R.filter_null(gappy(t), "c")


@query("keep_any_missing", f"WITH {GAPPY} SELECT * FROM gappy WHERE a IS NULL OR b IS NULL OR c IS NULL")
def _(t):
    return R.any_null(gappy(t))


@query(
    "pattern_filter",
    "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '(?i)copyright|licen[sc]e|warranty')",
)
def _(t):
    return t.documents.filter(matches("text", ["copyright", "licen[sc]e", "warranty"], ignore_case=True)).select(
        "doc_id", "lang"
    )


@query(
    "pattern_filter_negated",
    """SELECT p_partkey, name FROM (SELECT p_partkey, nullif(p_name, 'blue bolt') AS name FROM part)
       WHERE NOT coalesce(regexp_matches(name, 'ring|rod'), false)""",
)
def _(t):
    x = t.part.select("p_partkey", F.nullif("p_name", F.lit("blue bolt")).alias("name"))
    return x.filter(~matches("name", ["ring", "rod"]))


BIG = "big AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 2500000)"


def big_customers(t):
    spent = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"))
    return spent.filter("spent > 2500000").select("o_custkey")


@query(
    "keep_in_list",
    f"WITH {BIG} SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM big)",
)
def _(t):
    return R.keep_in(t.orders.select("o_orderkey", "o_custkey"), big_customers(t))


@query(
    "keep_not_in_list",
    f"WITH {BIG} SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM big)",
)
def _(t):
    return R.keep_not_in(t.orders.select("o_orderkey", "o_custkey"), big_customers(t))


@query(
    "drop_bad_samples",
    """SELECT l_orderkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem
       WHERE NOT (l_suppkey = 3 AND l_returnflag = 'A') AND NOT (l_suppkey = 5 AND l_returnflag = 'N')""",
)
def _(t):
    from seston.sources.small import small_table

    bad = small_table(t.spark, [(3, "A"), (5, "N")], "l_suppkey long, l_returnflag string")
    return R.drop_keys(t.lineitem.select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus"), bad)


@query(
    "sort_ascending",
    f"WITH {GAPPY} SELECT l_orderkey, l_linenumber, a, b FROM gappy ORDER BY a NULLS LAST, b NULLS LAST",
)
def _(t):
    return O.sort_na_last(gappy(t).select("l_orderkey", "l_linenumber", "a", "b"), ["a", "b"])


@query("sort_descending", f"WITH {GAPPY} SELECT l_orderkey, a FROM gappy ORDER BY a DESC NULLS LAST")
def _(t):
    return O.sort_na_last(gappy(t).select("l_orderkey", "a"), ["a"], descending=True)


@query("sorted_distinct", f"WITH {GAPPY} SELECT DISTINCT a, c FROM gappy ORDER BY a NULLS LAST, c NULLS LAST")
def _(t):
    return O.sorted_distinct(gappy(t), ["a", "c"])


@query(
    "bind_rows",
    """SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""",
)
def _(t):
    a = t.customer.selectExpr("c_custkey AS key", "c_acctbal AS balance", "c_mktsegment AS segment")
    b = t.supplier.selectExpr("s_acctbal AS balance", "s_suppkey AS key")
    return O.bind_rows(a, b)


@query(
    "stack_same_columns",
    """SELECT c_custkey AS key, c_nationkey AS nation FROM customer
       UNION ALL SELECT s_suppkey, s_nationkey FROM supplier""",
)
def _(t):
    a = t.customer.selectExpr("c_custkey AS key", "c_nationkey AS nation")
    b = t.supplier.selectExpr("s_nationkey AS nation", "s_suppkey AS key")
    return O.rbind(a, b)


@query("distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def _(t):
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus").distinct()
