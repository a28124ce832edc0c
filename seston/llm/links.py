"""URL filters: rules first, then trust and distrust along links of hosts.

A rule names a host and the start of a path; it fits that host and its
subdomains, and the longest rule that fits decides. Every other url gets its
host's verdict. Trust starts at the pages that rules allow and follows links;
distrust starts at the pages that rules block and follows links backwards, to
those who link there. Both are personalised PageRank over the edges between
hosts. A score is scaled so that it is 1 where all pages of a host are such
starting pages and no links exist; a host is blocked if its distrust exceeds its
trust by ``THRESHOLD``.

* A NULL url or one without ``://`` has the empty host and path and fits no
  rule; the empty host is a host like any other.
* NULL html has no links. Links within a host do not count; repeated links add up.
* Propagation runs until scores are known to ``SAFE`` times the threshold.
* Repeated rows count as pages of their own; html of any length is searched whole.
* Hosts without links out give their rank back to the starting pages. Without
  starting pages of a kind its scores are 0. An empty table gives an empty result.
* Rules are part of the query plan; their number should stay in the hundreds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seston.durable import Staged

DAMPING = 0.85
#: a graph that needs more rounds than this is an error, not a result
ROUNDS = 500
#: error of a rank, of all pages that a propagation starts from
ENOUGH = 1e-9
#: error of a score, of the threshold of a verdict
SAFE = 1e-3
THRESHOLD = 0.5
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = "(?s)://([^/?#]*)([^?#]*)"
LINK = "(?is)\\b(?:href|src)\\s*=\\s*[\"']?\\s*([^\"'\\s>]+)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), CAPITALS, SMALL)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def matched_rule(rules: list[tuple[str, str]], its_host: Column, its_path: Column) -> tuple[Column, Column]:
    """The longest rule (verdict, ``host/path``) that fits, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((its_host == name) | its_host.endswith("." + name)) & its_path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """``a, b, n``: links from pages of host a to host b, counted."""
    found = pages.select(host(F.col(url)).alias("a"), F.explode(F.regexp_extract_all(html, F.lit(LINK), 1)).alias("_to"))
    absolute = F.when(F.col("_to").startswith("//"), F.concat(F.lit("http:"), F.col("_to"))).otherwise(F.col("_to"))
    found = found.select("a", host(absolute).alias("b")).where("a <> b AND b <> ''")
    return found.groupBy("a", "b").agg(F.count("*").alias("n"))


def propagate(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, enough: float = ENOUGH) -> Staged:
    """Personalised PageRank for every ``kind`` at once.

    ``nodes``: kind, host, seed (sums to 1 or 0 within a kind); ``edges``: kind,
    a, b, n. Returns kind, host, rank, written to the shared folder; so is each
    round, which ends its lineage. The sums sent back to the session are one
    row per kind. Rounds go on until no sum of ranks can change by ``enough``
    any more: what is left to come is at most the last change times
    ``damping / (1 - damping)``. If ``rounds`` do not suffice it raises.
    """
    out = edges.groupBy("kind", "a").agg(F.sum("n").alias("_all"))
    shares = Staged(edges.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("_all")).alias("share")))
    ends = shares.df.select("kind", F.col("a").alias("host")).distinct().withColumn("_out", F.lit(True))
    start = nodes.join(ends, ["kind", "host"], "left").select(
        "kind", "host", "seed", F.coalesce("_out", F.lit(False)).alias("out"), F.col("seed").alias("rank")
    )
    current = Staged(start)
    for _ in range(rounds):
        ranks = current.df
        lost = {r[0]: r[1] for r in ranks.where("NOT out").groupBy("kind").agg(F.sum("rank")).collect()}
        back = F.lit(0.0)
        for kind, mass in lost.items():
            back = F.when(F.col("kind") == kind, F.lit(float(mass))).otherwise(back)
        sent = (
            shares.df.join(ranks.select("kind", F.col("host").alias("a"), "rank"), ["kind", "a"])
            .groupBy("kind", F.col("b").alias("host"))
            .agg(F.sum(F.col("share") * F.col("rank")).alias("_sent"))
        )
        fresh = ranks.join(sent, ["kind", "host"], "left").select(
            "kind", "host", "seed", "out",
            ((1 - damping) * F.col("seed") + damping * (F.coalesce("_sent", F.lit(0.0)) + back * F.col("seed"))).alias("rank"),
            F.col("rank").alias("_before"),
        )
        after = Staged(fresh)
        change = after.df.agg(F.sum(F.abs(F.col("rank") - F.col("_before")))).first()[0] or 0.0
        current.drop()
        current = after
        if change * damping <= enough * (1 - damping):
            break
    else:
        raise RuntimeError(f"ranks still change by {change} after {rounds} rounds")
    shares.drop()
    return current


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url", html: str = "html",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust."""
    parts = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    rule, verdict = matched_rule(rules, F.col("host"), F.col("path"))
    judged = parts.withColumn("rule", rule).withColumn("_said", verdict)
    counts = Staged(
        judged.groupBy("host").agg(
            F.count("*").alias("pages"),
            F.count_if(F.col("_said") == "allow").alias("trust"),
            F.count_if(F.col("_said") == "block").alias("distrust"),
        )
    )
    links = Staged(host_links(pages, url, html))
    total = counts.df.agg(F.sum("trust"), F.sum("distrust")).first()
    kinds = [("trust", float(total[0] or 0)), ("distrust", float(total[1] or 0))]
    linked = links.df.select(F.col("a").alias("host")).union(links.df.select("b")).distinct()
    every = counts.df.join(linked, "host", "full").na.fill(0)
    nodes = edges = None
    for kind, n in kinds:
        part = every.select(F.lit(kind).alias("kind"), "host", (F.col(kind) / max(n, 1.0)).alias("seed"))
        nodes = part if nodes is None else nodes.unionByName(part)
    forward = links.df.select(F.lit("trust").alias("kind"), "a", "b", "n")
    backward = links.df.select(F.lit("distrust").alias("kind"), F.col("b").alias("a"), F.col("a").alias("b"), "n")
    edges = forward.unionByName(backward)
    # in pages, as the threshold is
    ranks = propagate(nodes, edges, enough=SAFE * threshold / max(1.0, *[n for _, n in kinds])).df
    wide = ranks.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("rank") * n)).alias(f"_{k}") for k, n in kinds])
    scored = counts.df.join(wide, "host").select(
        "host", (F.col("_trust") / F.col("pages")).alias("trust"), (F.col("_distrust") / F.col("pages")).alias("distrust")
    )
    by_host = F.when(F.col("distrust") - F.col("trust") >= threshold, "block").otherwise("allow")
    return judged.join(scored, "host").select(
        "page_id", "host", "path", "rule", F.coalesce("_said", by_host).alias("verdict"), "trust", "distrust"
    )
