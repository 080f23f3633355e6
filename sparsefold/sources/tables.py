"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparsefold.session import BROADCAST_ROW_LIMIT, small_side, spread


def table(spark: SparkSession, base: str, name: str, spread_by: str | None = None) -> DataFrame:
    """One input table; ``spread_by`` names a key for inputs whose rows are costly to process."""
    scan = spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
    return spread(scan, spread_by) if spread_by else scan


def labels(spark: SparkSession, base: str, label: str = "quality") -> DataFrame:
    return table(spark, base, "labels").select("doc_id", F.col(label).alias("y"))


def labelled_texts(spark: SparkSession, base: str) -> DataFrame:
    """documents that may have a label, texts included and unshuffled: those whose id is on the label list where it is short enough to be sent
    along, all of them otherwise. What is worked out of their texts meets the labels by ``with_label``."""
    return table(spark, base, "documents", "doc_id").join(small_side(labels(spark, base).select("doc_id").distinct()), "doc_id", "left_semi") \
        if labels(spark, base).count() <= BROADCAST_ROW_LIMIT else table(spark, base, "documents", "doc_id")


def with_label(rows: DataFrame, spark: SparkSession, base: str, label: str = "quality") -> DataFrame:
    """Rows of documents joined to their label ``y``; those without drop out. Compact rows, as they are shuffled."""
    return rows.join(labels(spark, base, label), "doc_id")


def labelled_records(spark: SparkSession, base: str, label: str = "quality") -> DataFrame:
    """documents joined to their label ``y``. Rows without a label drop out. Select no text from it: see ``labelled_texts``."""
    return with_label(table(spark, base, "documents", "doc_id"), spark, base, label)
