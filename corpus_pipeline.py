"""From raw documents to token ids: five stages, each on all that the one
before it kept.

1. toxicity: documents whose score reaches the threshold go
2. quality: documents whose score is below ``QUALITY`` go
3. near_duplicates: one document of each group of like texts stays (five-word
   shingles, a similarity of 0.8)
4. mixing: sources are brought to their target weights; a document taken twice
   is there twice
5. pieces: token ids

A model of stage 1 or 2 is learned from that stage's own documents and the
labels of the folder, outside the held-out fold. Columns besides ``doc_id``,
``source`` and ``text`` are carried as they are, whatever their names, up to the
last stage, which returns ids, sources and tokens. NULL and empty texts are
scored like others, linked with nothing and mixed once; their tokens are NULL or
none. Of rows alike in id and text one stays. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seston.durable import Staged
from seston.llm import jaccard, mixing, pieces, quality, toxicity
from seston.llm.common import fold, unused_prefix

#: lower than the threshold of a prediction: what is in doubt stays
QUALITY = 0.5
WORDS = 5
PERCENT = 80


def own_columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels, fold("doc_id", 3) != 1)
    mark = unused_prefix(("score", "predicted", "passages"), docs)
    scored = toxicity.score(docs, model, prefix=mark, keep_text=True)
    return scored.where(F.col(f"{mark}predicted") == 0).select(*own_columns(docs))


def remove_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(docs, labels, fold("doc_id", 4) != 2)
    mark = unused_prefix(("score", "predicted"), docs)
    scored = quality.score(docs, model, prefix=mark, keep_text=True)
    return scored.where(F.col(f"{mark}score") >= QUALITY).select(*own_columns(docs))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_per_component(docs, words=WORDS, percent=PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs.select("doc_id", "source", "text"))


STAGES = [
    ("toxicity", remove_toxic),
    ("quality", remove_poor),
    ("near_duplicates", remove_near_duplicates),
    ("mixing", mix_sources),
    ("pieces", encode_texts),
]

#: scores of trained models cannot be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the documents of a folder; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = Staged(stage(spark, docs, sf_dir)).df
    return docs
