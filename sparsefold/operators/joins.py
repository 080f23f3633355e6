"""Joins on record ids. Nothing is ever aligned by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def outer_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right, on, "full_outer")


def assemble_long(*families: DataFrame) -> DataFrame:
    """Stack long feature tables (row_id, family, feature, value): no shuffle at all."""
    return reduce(DataFrame.unionByName, families)


def restrict_to(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Keep rows whose id is listed; duplicates on the left stay."""
    return df.join(ids, on, "left_semi")


def without(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(ids, on, "left_anti")


def align_predictions(preds: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """One row per key, one probability column per model."""
    return preds.groupBy(*keys).pivot("model", models).agg(F.first("prob"))
