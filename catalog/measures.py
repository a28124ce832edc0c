"""Concentrations, densities, name repair, taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import OBS, observations, query
from catalog.scalars import STAGED, staged
from seston.functions import measures as M
from seston.functions import text as X
from seston.operators import filters as R
from seston.operators import summary as S
from seston.operators import taxa as N

LINES = ["l_orderkey", "l_linenumber"]


@query(
    "organisms_per_ml",
    """SELECT l_orderkey, l_linenumber, round(l_quantity * 314.159
         / nullif(l_linenumber * 0.0683 * (l_suppkey % 9), 0), 1) AS organisms_per_ml FROM lineitem""",
)
def _(t):
    fields = F.col("l_suppkey") % 9
    made = M.concentration("l_quantity", F.lit(314.159), "l_linenumber", F.lit(0.0683), fields)
    return t.lineitem.select(*LINES, made.alias("organisms_per_ml"))


@query(
    "biovolume_per_ml",
    """SELECT l_orderkey, l_linenumber, round((l_quantity * l_extendedprice) * 0.314159
         / nullif(l_linenumber * 0.0683 * (l_suppkey % 9), 0), 1) AS biovolume_per_ml FROM lineitem""",
)
def _(t):
    fields = F.col("l_suppkey") % 9
    made = M.biovolume(
        "l_quantity", "l_extendedprice", F.lit(0.314159), "l_linenumber", F.lit(0.0683), fields
    )
    return t.lineitem.select(*LINES, made.alias("biovolume_per_ml"))


@query(
    "tow_volumes",
    """SELECT l_orderkey, l_linenumber, round(a + b, 6) AS strict, round(coalesce(a, 0) + b, 6) AS lenient
       FROM (SELECT l_orderkey, l_linenumber, 0.0225 * pi() * nullif(l_discount, 0.03) * l_quantity AS a,
               0.0225 * pi() * l_tax * l_linenumber AS b FROM lineitem)""",
)
def _(t):
    x = t.lineitem.withColumn("sub1", F.nullif("l_discount", F.lit(0.03)))
    sub, length = ["sub1", "l_tax"], ["l_quantity", "l_linenumber"]
    return x.select(
        *LINES,
        F.round(M.total_tow_volume(sub, length), 6).alias("strict"),
        F.round(M.total_tow_volume(sub, length, na="skip"), 6).alias("lenient"),
    )


@query(
    "individuals_per_ml",
    """SELECT l_orderkey, l_linenumber, l_returnflag, round(CASE WHEN l_returnflag = 'R'
         THEN l_quantity / nullif(l_discount / nullif(l_extendedprice, 0), 0)
         ELSE l_quantity / nullif(l_tax / nullif(l_suppkey, 0), 0) END / nullif(l_linenumber * 0.70685 * 1000000, 0), 6)
         AS indiv_per_ml FROM lineitem""",
)
def _(t):
    made = M.density(
        "l_quantity",
        "l_returnflag",
        {"R": ("l_discount", "l_extendedprice")},
        ("l_tax", "l_suppkey"),
        F.col("l_linenumber") * F.lit(0.70685),
    )
    return t.lineitem.select(*LINES, "l_returnflag", F.round(made, 6).alias("indiv_per_ml"))


@query(
    "quality_from_text",
    """SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)degraded') THEN 'degraded'
         WHEN regexp_matches(text, '(?i)fragment') THEN 'fragmented' ELSE 'good' END AS quality FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", X.quality_class("text").alias("quality"))


@query(
    "debris_from_text",
    """SELECT p_partkey, CASE WHEN regexp_matches(note, '(?i)high') THEN 'high'
         WHEN regexp_matches(note, '(?i)moderate') THEN 'moderate'
         WHEN regexp_matches(note, '(?i)low') THEN 'low' END AS debris
       FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Low sediment, HIGH detritus'
         WHEN 1 THEN 'Moderate ' || p_name WHEN 2 THEN 'some ' || p_type END AS note FROM part)""",
)
def _(t):
    size = F.col("p_size") % 4
    note = (
        F.when(size == 0, "Low sediment, HIGH detritus")
        .when(size == 1, F.concat(F.lit("Moderate "), "p_name"))
        .when(size == 2, F.concat(F.lit("some "), "p_type"))
    )
    return t.part.select("p_partkey", note.alias("note")).select("p_partkey", X.debris_level("note").alias("debris"))


SPECIES = """species AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN split_part(p_name, ' ', 1) || ' sp.'
  WHEN 1 THEN split_part(p_name, ' ', 1) || ' SPP.' ELSE p_name END AS species FROM part)"""


def species(t):
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    size = F.col("p_size") % 3
    return t.part.select(
        "p_partkey",
        F.when(size == 0, F.concat(first, F.lit(" sp.")))
        .when(size == 1, F.concat(first, F.lit(" SPP.")))
        .otherwise(F.col("p_name"))
        .alias("species"),
    )


@query(
    "identification_level",
    f"""WITH {SPECIES} SELECT p_partkey, CASE WHEN regexp_matches(species, '(?i)spp?\\.') THEN 'genus'
      ELSE 'species' END AS level FROM species""",
)
def _(t):
    return species(t).select("p_partkey", X.taxon_level("species").alias("level"))


@query(
    "normalised_taxa",
    f"""WITH {SPECIES} SELECT p_partkey, replace(replace(replace(replace(replace(species, 'widgat', 'widget'),
      'anvil', 'Anvil'), ' sp.', ''), ' spp.', ''), ' SPP.', '') AS taxon FROM species""",
)
def _(t):
    repaired = N.normalise_taxon("species", [("widgat", "widget"), ("anvil", "Anvil")])
    return species(t).select("p_partkey", repaired.alias("taxon"))


@query(
    "life_stage_split",
    f"""WITH {STAGED} SELECT p_partkey, CASE WHEN taxon LIKE '%adult%' THEN regexp_extract(taxon, '^(.*) (.*)$', 1)
        ELSE taxon END AS taxon,
      CASE WHEN taxon LIKE '%adult%' THEN regexp_extract(taxon, '^(.*) (.*)$', 2) ELSE 'not_spec' END AS stage
    FROM staged""",
)
def _(t):
    return N.split_stage(staged(t))


@query(
    "genus_species_split",
    f"""WITH {STAGED} SELECT p_partkey, split_part(taxon, ' ', 1) AS genus,
      nullif(split_part(taxon, ' ', 2), '') AS sp FROM staged""",
)
def _(t):
    from seston.operators.columns import separate

    return separate(staged(t), "taxon", ["genus", "sp"])


@query(
    "station_names",
    """SELECT s_suppkey, CASE WHEN s_nationkey = 18 THEN 'DI_SAV_1' ELSE 'DI_SAV_' || s_nationkey END AS station
       FROM supplier""",
)
def _(t):
    odd = F.when(F.col("s_suppkey") % 3 == 0, "-").when(F.col("s_suppkey") % 3 == 1, " #").otherwise("_")
    raw = F.concat(F.lit("DI"), odd, F.lit("SAV"), odd, F.col("s_nationkey").cast("string"))
    fixed = N.normalise_station("station", "_", [("DI_SAV_18", "DI_SAV_1")])
    return t.supplier.select("s_suppkey", raw.alias("station")).withColumn("station", fixed)


@query(
    "unknown_stations",
    """SELECT DISTINCT 'NATION_' || (s_nationkey + 5) AS station FROM supplier
       WHERE s_nationkey + 5 NOT IN (SELECT n_nationkey FROM nation)""",
)
def _(t):
    x = t.supplier.select(F.concat(F.lit("NATION_"), (F.col("s_nationkey") + 5).cast("string")).alias("station"))
    return N.unknown_stations(x, t.nation.select(F.col("n_name").alias("station")))


TAXONOMY = """names AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 1) AS genus FROM part),
  known AS (SELECT name, genus, upper(genus) AS phylum, upper(name) AS class FROM names
    WHERE name NOT LIKE '%anvil' AND genus NOT IN ('hot', 'old')),
  gaps AS (SELECT name, genus, 'GAP' AS phylum, upper(name) AS class FROM names
    WHERE name LIKE 'blue%' OR name LIKE 'old r%'),
  by_genus AS (SELECT genus, phylum, min(class) AS class FROM known GROUP BY ALL)"""


def taxonomy(t):
    names = t.part.select(
        F.col("p_name").alias("name"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("genus")
    ).distinct()
    known = names.filter(~F.col("name").endswith("anvil") & ~F.col("genus").isin("hot", "old"))
    gaps = names.filter(F.col("name").rlike("^blue|^old r"))
    return (
        known.withColumns({"phylum": F.upper("genus"), "class": F.upper("name")}),
        gaps.withColumns({"phylum": F.lit("GAP"), "class": F.upper("name")}),
    )


@query(
    "resolved_taxa",
    f"""WITH {TAXONOMY} SELECT p_partkey, p_name AS name, split_part(p_name, ' ', 1) AS genus,
      coalesce(k.phylum, g.phylum, b.phylum) AS phylum, coalesce(k.class, g.class, b.class) AS class,
      CASE WHEN k.name IS NOT NULL THEN 'name' WHEN g.name IS NOT NULL THEN 'gaps'
        WHEN b.genus IS NOT NULL THEN 'genus' ELSE 'none' END AS resolved_by
    FROM part LEFT JOIN known k ON k.name = p_name LEFT JOIN gaps g ON g.name = p_name
      LEFT JOIN by_genus b ON b.genus = split_part(p_name, ' ', 1)""",
)
def _(t):
    known, gaps = taxonomy(t)
    # a name seen with a non-breaking space has to match all the same
    x = t.part.select(
        "p_partkey",
        F.concat(F.replace("p_name", F.lit(" "), F.lit("\u00a0")), F.lit("\u00a0")).alias("raw"),
        F.col("p_name").alias("name"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("genus"),
    )
    out = N.resolve_taxa(
        x.withColumn("name", F.col("raw")).drop("raw"), known, gaps, ranks=("phylum", "class")
    )
    return out.withColumn("name", X.tidy_space("name"))


@query(
    "taxonomy_mismatches",
    f"WITH {TAXONOMY} SELECT name FROM names WHERE name NOT IN (SELECT name FROM known)",
)
def _(t):
    known, _ = taxonomy(t)
    return N.name_mismatches(t.part.select(F.col("p_name").alias("name")), known)


@query(
    "nearest_names",
    """WITH typo AS (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN p_name
           WHEN 1 THEN substr(p_name, 1, p_size % 6 + 1) || substr(p_name, p_size % 6 + 3)
           ELSE substr(p_name, 1, 3) || 'xx' || substr(p_name, 4 + p_size % 2) END AS name FROM part),
       ref AS (SELECT DISTINCT p_name AS nearest FROM part),
       near AS (SELECT name, nearest, levenshtein(name, nearest) AS edits FROM typo, ref),
       best AS (SELECT name, nearest, edits, row_number() OVER (PARTITION BY name ORDER BY edits, nearest) AS k
                FROM near WHERE edits <= 2)
       SELECT typo.name, nearest, CAST(edits AS INT) AS edits FROM typo LEFT JOIN best ON best.name = typo.name AND k = 1""",
)
def _(t):
    size = F.col("p_size")
    name = F.col("p_name")
    at = size % 6 + 1
    typo = (
        F.when(size % 3 == 0, name)
        .when(size % 3 == 1, F.concat(name.substr(F.lit(1), at), name.substr(at + 2, F.length(name))))
        .otherwise(F.concat(name.substr(1, 3), F.lit("xx"), name.substr(4 + size % 2, F.length(name))))
    )
    return N.nearest_name(t.part.select(typo.alias("name")), t.part.select(name.alias("name")))


@query(
    "drop_rare_taxa",
    """WITH c AS (SELECT o_custkey AS taxon, count(DISTINCT CAST(o_orderdate AS DATE)) AS n FROM orders GROUP BY 1)
       SELECT o_orderkey, o_custkey AS taxon, CAST(o_orderdate AS DATE) AS sample FROM orders
       WHERE o_custkey IN (SELECT taxon FROM c WHERE n >= 10)""",
)
def _(t):
    x = t.orders.select(
        "o_orderkey", F.col("o_custkey").alias("taxon"), F.to_date("o_orderdate").alias("sample")
    )
    return N.drop_rare(x, "sample", "taxon", 10)


@query(
    "genus_totals",
    f"""WITH {OBS} SELECT sample, genus, sum(density) AS density, round(sum(volume), 2) AS volume
        FROM obs GROUP BY sample, genus""",
)
def _(t):
    out = S.sum_by(observations(t), ["sample", "genus"], ["density", "volume"])
    return out.withColumn("volume", F.round("volume", 2))


@query(
    "rollup_to_higher_taxon",
    f"""WITH {OBS}, dim AS (SELECT p_name AS taxon, min(p_type) AS phylum FROM part
        WHERE p_name NOT LIKE 'old%' GROUP BY 1)
    SELECT sample, phylum, sum(density) AS density FROM obs JOIN dim USING (taxon) GROUP BY ALL""",
)
def _(t):
    dim = t.part.filter(~F.col("p_name").startswith("old")).selectExpr("p_name AS taxon", "p_type AS phylum")
    return N.rollup_taxon(observations(t), dim, "taxon", "phylum", ["sample"], ["density"])


@query(
    "taxon_frequency",
    f"""WITH {OBS}, n AS (SELECT count(DISTINCT sample) AS n FROM obs),
      dim AS (SELECT p_name AS taxon, min(p_type) AS phylum FROM part GROUP BY 1)
    SELECT taxon, phylum, count(DISTINCT sample) AS n_samples, round(count(DISTINCT sample) / any_value(n), 3) AS share
    FROM obs JOIN dim USING (taxon), n GROUP BY ALL""",
)
def _(t):
    dim = t.part.selectExpr("p_name AS taxon", "p_type AS phylum")
    return N.taxon_frequency(observations(t), dim, "sample", "taxon")


@query(
    "drop_nondetects",
    """SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS result FROM events
       WHERE event_type <> 'error'""",
)
def _(t):
    flag = F.when(F.col("event_type") == "error", 1).otherwise(0)
    text = F.when(flag == 1, "< RL").otherwise(F.regexp_extract("props", "[0-9]+", 0))
    x = t.events.select("event_id", flag.alias("nd"), text.alias("result"))
    return R.drop_nondetects(x, "nd", "result").drop("nd")


@query(
    "taxa_per_genus",
    "SELECT split_part(p_name, ' ', 2) AS genus, count(DISTINCT p_name) AS n FROM part GROUP BY 1",
)
def _(t):
    x = t.part.select("p_name", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("genus"))
    return S.children_per(x, "genus", "p_name")


@query(
    "exclude_taxa",
    """SELECT p_partkey, taxon FROM (SELECT p_partkey, nullif(p_name, 'old rod') AS taxon FROM part)
       WHERE taxon IS NULL OR taxon NOT IN ('red ring', 'blue bolt')""",
)
def _(t):
    x = t.part.select("p_partkey", F.nullif("p_name", F.lit("old rod")).alias("taxon"))
    return R.exclude_taxa(x, ["red ring", "blue bolt"])
