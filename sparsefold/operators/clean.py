"""Outlier masking, mean imputation and scaling. Fitting and applying are separate steps, so that what
was learnt from training rows is a table one can look at, store and reuse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sparsefold.functions.numeric import mask_outlier

SCALERS = ("standard", "minmax", "maxabs", "none")


def mask_outliers(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: mask_outlier(F.col(c).cast("double")) for c in cols})


def _one_row(df: DataFrame, per_column: dict[str, Column]) -> DataFrame:
    """A wide one-row aggregate as (feature, params)."""
    wide = df.agg(*[p.alias(c) for c, p in per_column.items()])
    return wide.unpivot([], [F.col(f"`{c}`") for c in per_column], "feature", "params")


def _fitted(params: DataFrame, cols: list[str]) -> dict[str, dict]:
    """Fitted numbers by column, as literals for the plan: one row per named column reaches the driver."""
    return {r["feature"]: r.asDict() for r in params.where(F.col("feature").isin(cols)).collect()}


def fit_imputer(train: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, mean) over the non-missing training values. A column with none keeps a NULL mean."""
    return _one_row(train, {c: F.avg(c) for c in cols}).withColumnRenamed("params", "mean")


def apply_imputer(df: DataFrame, params: DataFrame, cols: list[str]) -> DataFrame:
    p = _fitted(params, cols)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(p[c]["mean"])) for c in cols})


def fit_scaler(train: DataFrame, cols: list[str], kind: str = "standard") -> DataFrame:
    """(feature, center, scale). Standard uses the population deviation; a zero scale becomes 1."""
    if kind not in SCALERS:
        raise ValueError(f"unknown scaler {kind!r}; one of {SCALERS}, or row_sum_scale()")
    center = {"standard": F.avg, "minmax": F.min}.get(kind, lambda c: F.lit(0.0))
    spreads = {"standard": F.stddev_pop, "minmax": lambda c: F.max(c) - F.min(c), "maxabs": lambda c: F.max(F.abs(c))}
    width = spreads.get(kind, lambda c: F.lit(1.0))

    def pair(c):
        w = width(c)
        return F.struct(center(c).cast("double").alias("center"),
                        F.when(w == 0, 1.0).otherwise(w).cast("double").alias("scale"))

    return _one_row(train, {c: pair(c) for c in cols}).select("feature", "params.center", "params.scale")


def apply_scaler(df: DataFrame, params: DataFrame, cols: list[str]) -> DataFrame:
    p = _fitted(params, cols)
    return df.withColumns({c: (F.col(c) - F.lit(p[c]["center"])) / F.lit(p[c]["scale"]) for c in cols})


def fold_scalers(df: DataFrame, fold: str, cols: list[str], folds: int) -> list[dict[str, tuple[float, float]]]:
    """For each fold: column -> (mean, deviation) of the rows outside it, missing ones taken as the mean; one scan for all folds.

    Every fold's count, mean and squared deviation is aggregated once, and those of the others are merged, so what a fold is
    scaled by owes nothing to its own rows. A column without a value outside the fold has mean 0, one without spread scale 1.
    """
    cells = {c: F.struct(F.count(c).alias("n"), F.coalesce(F.avg(c), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(c), F.lit(0.0)).alias("var")) for c in cols}
    found = {r[fold]: r for r in df.groupBy(fold).agg(F.count("*").alias("_rows"), *[v.alias(c) for c, v in cells.items()]).collect()}
    out = []
    for k in range(folds):
        others = [r for f, r in found.items() if f != k]
        rows = sum(r["_rows"] for r in others)
        params = {}
        for c in cols:
            n = sum(r[c]["n"] for r in others)
            mean = sum(r[c]["n"] * r[c]["mean"] for r in others) / n if n else 0.0
            square = sum(r[c]["n"] * (r[c]["var"] + (r[c]["mean"] - mean) ** 2) for r in others)
            deviation = (square / rows) ** 0.5 if rows else 0.0
            params[c] = (mean, deviation if deviation > 0 else 1.0)
        out.append(params)
    return out


def scaled_by(df: DataFrame, params: dict[str, tuple[float, float]], out: str = "x") -> DataFrame:
    """Adds the array ``out`` of the columns, centred and scaled; missing ones are 0, which is their mean."""
    return df.withColumn(out, F.array(*[F.coalesce((F.col(c) - F.lit(m)) / F.lit(s), F.lit(0.0)) for c, (m, s) in params.items()]))


def row_sum_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """Divide by the signed row sum; a zero sum gives NULL. Needs no fitting."""
    total = reduce(lambda a, b: a + b, [F.col(c) for c in cols])
    total = F.when(total != 0, total)
    return df.withColumns({c: F.col(c) / total for c in cols})
