"""Covariance, principal moments and leverage per group, from one partial aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sparsefold.session import for_matrices, small_side


GROUPS_HELD = 256


def group_products(df: DataFrame, group: str, vector: str, dims: int) -> DataFrame:
    """(group, i, j, v) for i <= j: sums of products of (1, x_1 .. x_dims), so v at (0, 0) counts the group's rows.

    Each task multiplies the matrices of the groups it meets and emits their sums, so a hot group is spread over all tasks.
    Rows whose vector is NULL take no part.
    """
    kind = df.schema[group].dataType.simpleString()
    rows = for_matrices(df.where(F.col(vector).isNotNull()).select(F.col(group).alias("g"), F.col(vector).cast("array<double>").alias("x")))
    i, j = np.triu_indices(dims + 1)

    def cells(held: dict) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({"g": g, "i": i.astype("int32"), "j": j.astype("int32"), "v": m[i, j]}) for g, m in held.items()])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in frames:
            for g, part in pdf.groupby("g", dropna=False):
                x = np.concatenate([np.ones((len(part), 1)), np.stack(part["x"].to_numpy())], axis=1)
                g = None if pd.isna(g) else g
                held[g] = held.get(g, 0) + x.T @ x
                if len(held) >= GROUPS_HELD:
                    yield cells(held)
                    held = {}
        if held:
            yield cells(held)

    sums = rows.mapInPandas(partial, f"g {kind}, i int, j int, v double").groupBy("g", "i", "j").agg(F.sum("v").alias("v"))
    return sums.withColumnRenamed("g", group)


def group_covariance(df: DataFrame, group: str, vector: str, dims: int) -> DataFrame:
    """(group, i, j, cov) for i <= j, from 0: population covariance of the vector's coordinates."""
    sums = group_products(df, group, vector, dims)
    first = F.map_from_entries(F.collect_list(F.when(F.col("i") == 0, F.struct("j", "v"))))
    means = sums.where("i = 0").groupBy(F.col(group).alias("_g")).agg(first.alias("_s"))
    n = F.col("_s")[0]
    cov = F.col("v") / n - F.col("_s")[F.col("i")] / n * F.col("_s")[F.col("j")] / n
    both = sums.where("i > 0").join(means, F.col(group).eqNullSafe(F.col("_g")))
    return both.select(group, (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), cov.alias("cov"))


def group_principal_moments(cov: DataFrame, group: str, dims: int) -> DataFrame:
    """(group, component, moment): eigenvalues of each group's covariance, largest first.

    Python sees one dims x dims matrix per group, never the rows; a group with a missing entry gets NULLs.
    """
    kind = cov.schema[group].dataType.simpleString()

    def eigen(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((dims, dims))
        m[pdf["i"], pdf["j"]] = pdf["cov"]
        m[pdf["j"], pdf["i"]] = pdf["cov"]
        lam = np.linalg.eigvalsh(m)[::-1] if np.isfinite(m).all() else np.full(dims, np.nan)
        return pd.DataFrame({group: pdf[group].iloc[0], "component": np.arange(dims, dtype="int32"),
                             "moment": np.where(np.isnan(lam), None, lam)})

    return cov.groupBy(group).applyInPandas(eigen, f"`{group}` {kind}, component int, moment double")


def group_leverage(df: DataFrame, row_id: str, group: str, xs: str | list[str]) -> DataFrame:
    """(row_id, h): the hat diagonal of a regression on ``xs`` with an intercept within the row's group, that is
    1/n + (x - mean)' S^-1 (x - mean); directions without spread add nothing. NULL where a regressor is missing.

    A group's mean and inverse come from partial sums and are joined back, so a hot group is never gathered for a window.
    """
    xs = [xs] if isinstance(xs, str) else xs
    d = len(xs)
    known = F.array(*[F.col(x).cast("double") for x in xs])
    rows = df.select(row_id, group, F.when(F.forall(known, lambda v: v.isNotNull()), known).alias("_x"))
    shift = df.agg(*[F.avg(x).alias(str(k)) for k, x in enumerate(xs)]).head()
    rows = rows.withColumn("_x", F.zip_with("_x", F.array(*[F.lit(float(v or 0.0)) for v in shift]), lambda a, b: a - b))
    kind = df.schema[group].dataType.simpleString()

    def inverse(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((d + 1, d + 1))
        m[pdf["i"], pdf["j"]] = m[pdf["j"], pdf["i"]] = pdf["v"]
        n, mean = m[0, 0], m[0, 1:] / m[0, 0]
        spread = m[1:, 1:] - n * np.outer(mean, mean)
        return pd.DataFrame({"_g": [pdf[group].iloc[0]], "_n": [n], "_m": [mean.tolist()],
                             "_s": [np.linalg.pinv(spread, rcond=1e-10, hermitian=True).ravel().tolist()]})

    stats = small_side(group_products(rows, group, "_x", d).groupBy(group).applyInPandas(inverse, f"_g {kind}, _n double, _m array<double>, _s array<double>"))
    gap = F.zip_with("_x", "_m", lambda a, b: a - b)
    joined = rows.join(stats, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("_d", gap)
    tail = sum((F.col("_s")[a * d + b] * F.col("_d")[a] * F.col("_d")[b] for a in range(d) for b in range(d)), F.lit(0.0))
    return joined.select(row_id, F.when(F.col("_x").isNotNull(), 1 / F.col("_n") + tail).alias("h"))
