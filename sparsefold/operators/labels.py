"""Label encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparsefold.session import small_side

POSITIVE, NEGATIVE = "Permeable", "Non_permeable"


def to_class_name(y: Column) -> Column:
    return F.when(y == 1, POSITIVE).when(y == 0, NEGATIVE)


def from_class_name(name: Column) -> Column:
    return F.when(name == POSITIVE, 1).when(name == NEGATIVE, 0)


def fit_label_codes(df: DataFrame, col: str) -> DataFrame:
    """(col, code): dense codes in alphabetical order.

    The window runs over the distinct classes only, never over rows.
    """
    classes = df.select(col).where(F.col(col).isNotNull()).distinct()
    return classes.select(col, (F.row_number().over(Window.orderBy(col)) - 1).alias("code"))


def apply_label_codes(df: DataFrame, codes: DataFrame, col: str) -> DataFrame:
    """Codes fitted on train; a class unseen there gets a NULL code."""
    return df.join(small_side(codes), col, "left")


def invert_label_codes(df: DataFrame, codes: DataFrame) -> DataFrame:
    return df.join(small_side(codes), "code", "left")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, w) with w = n / (k * n_label)."""
    counts = class_counts(df, label)
    total = counts.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k")).alias("t")).scalar()
    return counts.select(label, (total["n"] / (total["k"] * F.col("n"))).alias("w"))
