"""The corpus pipeline: documents without toxic ones, one of each group of near-duplicate fingerprints, live secrets masked, sources mixed
to their weights, texts as token ids. Each stage takes what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparsefold.llm import bktree, mixing, pieces, secrets, toxicity
from sparsefold.llm.shared import stored, table

SCORE = "toxicity score"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return scorer.score(docs, "text", SCORE).where(F.col(SCORE) < toxicity.THRESHOLD).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bktree.keep_one(docs).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, owner="source", repo="lang").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, pieces.load()).drop("text").withColumnRenamed("ids_decoded", "decoded")


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("pieces", encoded),
]

#: Trees, fingerprints and tokens are beyond SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES):
            docs = stored(docs)
    return docs
