"""Text, number and date functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from seston.functions import dates as D
from seston.functions import text as X
from seston.functions.numbers import ratio, round_to, to_number
from seston.operators.joins import code_labels
from seston.operators.taxa import assign_survey


@query(
    "replace_all_text",
    r"""SELECT event_id, regexp_replace(props, '[{}"]+', '~', 'g') AS by_pattern,
               replace(props, '": ', '=') AS by_text FROM events""",
)
def _(t):
    return t.events.select(
        "event_id",
        X.replace_all("props", r'[{}"]+', "~").alias("by_pattern"),
        X.replace_all("props", '": ', "=", fixed=True).alias("by_text"),
    )


@query(
    "replace_in_order",
    """SELECT p_partkey, replace(replace(replace(p_name, 'rod', 'ring'), 'ring', 'gear'), 'old ', '') AS name
       FROM part""",
)
def _(t):
    pairs = [("rod", "ring"), ("ring", "gear"), ("old ", "")]
    return t.part.select("p_partkey", X.replace_each("p_name", pairs).alias("name"))


STAGED = """staged AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name || ' adult'
   WHEN p_size % 3 = 1 THEN replace(p_name, ' ', '') ELSE p_name END AS taxon FROM part)"""


def staged(t):
    size = F.col("p_size") % 3
    return t.part.select(
        "p_partkey",
        F.when(size == 0, F.concat("p_name", F.lit(" adult")))
        .when(size == 1, F.replace("p_name", F.lit(" "), F.lit("")))
        .otherwise(F.col("p_name"))
        .alias("taxon"),
    )


@query(
    "split_at_last_space",
    f"""WITH {STAGED} SELECT p_partkey,
      CASE WHEN taxon LIKE '% %' THEN regexp_extract(taxon, '^(.*) (.*)$', 1) ELSE taxon END AS head,
      CASE WHEN taxon LIKE '% %' THEN regexp_extract(taxon, '^(.*) (.*)$', 2) ELSE taxon END AS tail FROM staged""",
)
def _(t):
    head, tail = X.split_last("taxon")
    return staged(t).select("p_partkey", head.alias("head"), tail.alias("tail"))


@query("text_from_end", "SELECT page_id, substr(url, greatest(length(url) - 11, 1), greatest(least(length(url) - 5, 7), 0)) AS label FROM pages")
def _(t):
    return t.pages.select("page_id", X.from_end("url", -12, -6).alias("label"))


@query(
    "sentence_case",
    "SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS segment FROM customer",
)
def _(t):
    return t.customer.select("c_custkey", X.sentence_case("c_mktsegment").alias("segment"))


@query(
    "conditional_values",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium'
        ELSE 'small' END AS size, CASE WHEN o_orderstatus = 'F' THEN 'done'
        WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS state FROM orders""",
)
def _(t):
    size = F.when(F.col("o_totalprice") > 300000, "large").when(F.col("o_totalprice") > 100000, "medium")
    return t.orders.select(
        "o_orderkey",
        size.otherwise("small").alias("size"),
        X.relabel("o_orderstatus", {"F": "done", "O": "open"}, "other").alias("state"),
    )


@query(
    "coalesce_columns",
    "SELECT l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0.05), l_tax) AS rate FROM lineitem",
)
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.coalesce(F.nullif("l_discount", F.lit(0.05)), "l_tax").alias("rate")
    )


@query(
    "text_to_number",
    """SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN '< RL'
         ELSE regexp_extract(props, '[0-9]+') END AS DOUBLE) AS result FROM events""",
)
def _(t):
    text = F.when(F.col("event_id") % 5 == 0, "< RL").otherwise(F.regexp_extract("props", "[0-9]+", 0))
    return t.events.select("event_id", to_number(text).alias("result"))


@query(
    "spreadsheet_dates",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date,
         CAST(round((o_orderkey % 1440) / 1440.0 * 86400) AS BIGINT) AS seconds FROM orders""",
)
def _(t):
    days = F.datediff("o_orderdate", F.lit("1899-12-30").cast("date")).cast("string")
    part = ((F.col("o_orderkey") % 1440) / 1440.0).cast("string")
    return t.orders.select(
        "o_orderkey", D.spreadsheet_date(days).alias("date"), D.spreadsheet_seconds(part).alias("seconds")
    )


@query(
    "dates_in_two_layouts",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS date FROM orders",
)
def _(t):
    key = F.col("o_orderkey")
    text = (
        F.when(key % 7 == 0, "not a date")
        .when(key % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    )
    return t.orders.select("o_orderkey", text.alias("t")).select("o_orderkey", D.parse_date("t").alias("date"))


@query(
    "zoned_timestamps",
    """SELECT o_orderkey, strftime(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)
         + to_seconds(CAST(o_orderkey % 1440 AS BIGINT) * 60) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS utc
       FROM orders""",
)
def _(t):
    minute = F.col("o_orderkey") % 1440
    clock = F.concat_ws(":", F.floor(minute / 60).cast("string"), F.lpad((minute % 60).cast("string"), 2, "0"))
    at = D.instant(F.to_date("o_orderdate"), D.clock_seconds(clock), "Etc/GMT+8")
    return t.orders.select("o_orderkey", D.local_text(at, "UTC").alias("utc"))


@query(
    "daylight_saving_timestamps",
    # the rule of the years of the orders: first Sunday of April to last Sunday of October
    """WITH o AS (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)
           + to_seconds(CAST(o_orderkey % 1440 AS BIGINT) * 60) AS wall, year(o_orderdate) AS y FROM orders),
         r AS (SELECT *, make_date(y, 4, 1) + CAST((7 - dayofweek(make_date(y, 4, 1))) % 7 AS INT) AS spring,
           make_date(y, 10, 31) - CAST(dayofweek(make_date(y, 10, 31)) AS INT) AS fall FROM o),
         z AS (SELECT *, wall >= spring + INTERVAL 3 HOUR AND wall < fall + INTERVAL 2 HOUR AS summer FROM r)
       SELECT o_orderkey, strftime(wall + CASE WHEN summer THEN INTERVAL 7 HOUR ELSE INTERVAL 8 HOUR END, '%Y-%m-%d %H:%M:%S') AS utc,
         strftime(wall + CASE WHEN NOT summer AND wall >= spring + INTERVAL 2 HOUR AND wall < spring + INTERVAL 3 HOUR
           THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M:%S') AS local FROM z""",
)
def _(t):
    zone = "America/Los_Angeles"
    at = D.instant(F.to_date("o_orderdate"), F.col("o_orderkey") % 1440 * 60, zone)
    return t.orders.select(
        "o_orderkey", D.local_text(at, "UTC").alias("utc"), D.local_text(at, zone).alias("local")
    )


@query("timestamp_to_date", "SELECT event_id, CAST(ts AS DATE) AS date FROM events")
def _(t):
    return t.events.select("event_id", F.to_date("ts").alias("date"))


@query(
    "timestamp_to_text",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS written,
         strftime(ts, '%H:%M:%S') AS clock FROM events""",
)
def _(t):
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return t.events.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("written"),
        D.clock_text(seconds).alias("clock"),
    )


@query(
    "season_of_month",
    """SELECT l_orderkey, l_linenumber, CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'W'
         WHEN month(l_shipdate) <= 5 THEN 'Sp' WHEN month(l_shipdate) <= 8 THEN 'Su' ELSE 'F' END AS season
       FROM lineitem""",
)
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", D.season(F.month("l_shipdate")).alias("season"))


@query(
    "survey_month_of_sample",
    """SELECT l_orderkey, l_linenumber, s_nationkey AS station, CAST(l_shipdate AS DATE) AS date,
         CASE WHEN day(l_shipdate) <> 31 THEN strftime(l_shipdate + INTERVAL 4 DAY, '%Y-%m') END AS survey
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
)
def _(t):
    # A survey list in which samples of the last days belong to the next month.
    sites = t.supplier.selectExpr("s_suppkey AS l_suppkey", "s_nationkey AS station")
    x = t.lineitem.join(sites, "l_suppkey").select(
        "l_orderkey", "l_linenumber", "station", F.to_date("l_shipdate").alias("date")
    )
    days = x.select("station", "date").distinct().filter(F.dayofmonth("date") != 31)
    surveys = days.withColumn("survey", F.date_format(F.date_add("date", 4), "yyyy-MM"))
    return assign_survey(x, surveys)


@query(
    "round_numbers",
    "SELECT l_orderkey, l_linenumber, round(l_extendedprice / 3.7, 1) AS tenth FROM lineitem",
)
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", round_to(F.col("l_extendedprice") / 3.7, 1).alias("tenth")
    )


@query(
    "arithmetic",
    """SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice), 6) AS logged,
         round(pow(0.15, 2) * pi() * l_quantity, 6) AS area, round(l_quantity / nullif(l_tax, 0), 6) AS rate
       FROM lineitem""",
)
def _(t):
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.round(F.log("l_extendedprice"), 6).alias("logged"),
        F.round(F.pow(F.lit(0.15), F.lit(2)) * F.pi() * F.col("l_quantity"), 6).alias("area"),
        F.round(ratio("l_quantity", "l_tax"), 6).alias("rate"),
    )


@query(
    "level_order",
    """SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2
         WHEN '1-URGENT' THEN 3 END AS BIGINT) AS place FROM orders""",
)
def _(t):
    levels = ["5-LOW", "3-MEDIUM", "1-URGENT"]
    return t.orders.select("o_orderkey", X.level_order("o_orderpriority", levels).cast("long").alias("place"))


@query(
    "code_labels",
    """SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'Open Water'
         WHEN 'O' THEN 'Vegetation' END AS stratum FROM orders""",
)
def _(t):
    x = t.orders.select("o_orderkey", "o_orderstatus")
    return code_labels(x, "o_orderstatus", {"F": "Open Water", "O": "Vegetation"}, "stratum")
