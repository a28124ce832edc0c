"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seston.durable import Staged
from seston.llm import align, bpe, fingerprint, jaccard, language, licenses, links, mixing, near_vectors, pieces, quality, spelling, toxicity
from seston.llm.common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(folds: int, part: int):
    return F.coalesce(fold("doc_id", folds) == part, F.lit(False))


@query
def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op1_mixing"] = mixing.SQL

@query
def op2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(table(spark, folder, "documents").select("doc_id", "text"))


#: fixed values of the contract
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


@query
def op3_links(spark: SparkSession, folder: str) -> DataFrame:
    return links.filter_urls(table(spark, folder, "pages"), RULES)


@query
def op4_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents"))


@query
def op5_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, folder, "embeddings"))


@query
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.learn(docs, fold("doc_id", 3) != 1)
    found = language.identify(docs.select("doc_id", "text", held_out(3, 1).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.learn(docs, table(spark, folder, "labels"), fold("doc_id", 3) != 1)
    found = toxicity.score(docs.select("doc_id", "text", held_out(3, 1).alias("held_out")), model)
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


@query
def op9_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, folder, "documents"))


@query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.learn(docs, table(spark, folder, "labels"), fold("doc_id", 4) != 2)
    found = quality.score(docs.select("doc_id", "text", held_out(4, 2).alias("held_out")), model)
    return found.select("doc_id", "held_out", "score", "predicted")


@query
def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


ORACLE["op11_spelling"] = spelling.SQL


def digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


@query
def op12_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return bpe.encode(docs).select(
        "doc_id",
        "n_tokens",
        digest(F.concat_ws(" ", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
    )


@query
def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    sha = F.when(F.col("groups") == "", "").otherwise(digest(F.col("groups"))).alias("groups_sha256")
    numbers = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    found = Staged(align.align(docs).select(*numbers, sha, "block", "pairs", "times")).df
    return align.counted(found, align.SIZE_B).select(*numbers, "n_best", "count_sum", "groups_sha256")
