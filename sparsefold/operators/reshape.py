"""Wide/long reshaping and column-list operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparsefold.session import small_side


def melt(df: DataFrame, row_id: str, cols: list[str]) -> DataFrame:
    """(row_id, feature, value); map-only."""
    return df.select(row_id, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        row_id, cols, "feature", "value")


def drop_listed(long: DataFrame, names: DataFrame, col: str = "feature") -> DataFrame:
    """Remove the features of a one-column list."""
    return long.join(small_side(names), col, "left_anti")


def feature_chunks(long: DataFrame, row_id: str, chunk_rows: int = 256) -> DataFrame:
    """(feature, chunk, n, values): every feature's whole column as arrays of rows whose ids share id div ``chunk_rows``,
    in row order. A feature has one value per record, so an array holds ``chunk_rows`` values at most and none is unbounded.
    """
    rows = long.withColumn("chunk", F.floor(F.col(row_id) / chunk_rows))
    cells = F.sort_array(F.collect_list(F.struct(F.col(row_id).alias("i"), F.col("value").alias("v"))))
    return (rows.groupBy("feature", "chunk").agg(F.count("*").alias("n"), cells.alias("_c"))
            .select("feature", "chunk", "n", F.transform("_c", lambda c: c["v"]).alias("values")))


def pivot_square(pairs: DataFrame, row: str, col: str, value: str, order: list[int], prefix: str) -> DataFrame:
    """Pairs (row, col, value) as a square matrix with the given row and column order, NULL where absent."""
    wide = pairs.groupBy(row).pivot(col, order).agg(F.first(value))
    wide = wide.select(row, *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in order])
    index = pairs.sparkSession.range(len(order)).select(F.array(*map(F.lit, order))[F.col("id").cast("int")].alias(row))
    return index.join(wide, row, "left")


def count_listed(bits: Column, listed: DataFrame) -> Column:
    """How many of a row's bits are on a list. The list is at most the fingerprint width, and enters the
    plan as a scalar subquery, so rows are not shuffled and rows without a hit keep their 0."""
    col = listed.columns[0]
    wanted = listed.agg(F.collect_list(col).alias(col)).scalar()
    return F.size(F.array_intersect(bits, F.coalesce(wanted, F.array().cast("array<int>"))))


def missing_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_missing, n_rows), plus a row '*' counting rows with any missing value."""
    gone = {c: F.col(c).isNull() for c in cols}
    anywhere = F.lit(False)
    for c in cols:
        anywhere = anywhere | gone[c]
    sums = [F.sum(cond.cast("bigint")).alias(c) for c, cond in (gone | {"*": anywhere}).items()]
    one = df.agg(F.count("*").alias("n_rows"), *sums)
    return one.unpivot("n_rows", [F.col(f"`{c}`") for c in [*cols, "*"]], "column", "n_missing").select(
        "column", "n_missing", "n_rows")


def rank_by_abs(df: DataFrame, name: str, coef: str) -> DataFrame:
    """Non-zero coefficients ranked 1..k by size; ties by name. One row per feature goes in."""
    w = Window.orderBy(F.abs(F.col(coef)).desc(), F.col(name))
    return df.where(F.col(coef) != 0).select(name, coef, F.row_number().over(w).alias("rank"))
