"""Autocorrelation of sequences (by lag) and of point clouds (by distance)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparsefold.session import small_side


SAMPLED = 64


def _lagged_products(df: DataFrame, window, value: str, max_lag: int, accept=None) -> list[Column]:
    cols = []
    for k in range(1, max_lag + 1):
        pair = F.col(value) * F.lead(value, k).over(window)
        if accept is not None:
            pair = F.when(accept(k, window), pair)
        cols.append(pair.alias(f"_p{k}"))
    return cols


def lag_autocorrelation(df: DataFrame, group: str, order: list[str], value: str, max_lag: int = 8,
                        rows_per_chunk: int = 1_000_000) -> DataFrame:
    """(group, lag, ac): sum of x[t] * x[t+lag] over each group's sequence; ``order`` is a timestamp and a bigint that tells
    rows of one time apart.

    A group larger than ``rows_per_chunk`` is cut into as many chunks as its count asks for: at quantiles of its own time
    axis, and rows of one time by quantiles of their numbers, so that no task sorts an unbounded group. Products inside a chunk come from a window per chunk. Products across a
    cut need only the first and last ``max_lag`` rows of each chunk: between two such rows the others
    are all present too, so a second window over those few rows gives exactly the missing products.
    """
    time = F.unix_micros(F.col(order[0]).cast("timestamp"))
    rows = df.select(group, *order, value)
    sizes = df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > rows_per_chunk).persist()
    any_hot = not sizes.isEmpty()
    if any_hot:
        # A sample of rows by hash holds some 64 of each chunk; every 64th in order is a cut. Only sampled rows are sorted.
        sampled = (df.join(small_side(sizes.select(F.col(group).alias("_g"))), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
                   .where(F.pmod(F.xxhash64(*order), F.lit(max(1, rows_per_chunk // SAMPLED))) == 0))
        place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
        cut = (sampled.select(group, time.alias("_t"), F.col(order[1]).alias("_i"), place.alias("_rn")).where(F.col("_rn") % SAMPLED == 0))
        cuts = cut.groupBy(F.col(group).alias("_g")).agg(F.array_sort(F.collect_list(F.struct("_t", "_i"))).alias("_cuts"))
        late = F.size(F.filter("_cuts", lambda c: (c["_t"] < time) | ((c["_t"] == time) & (c["_i"] < F.col(order[1])))))
        rows = rows.join(small_side(cuts), F.col(group).eqNullSafe(F.col("_g")), "left").withColumn(
            "_chunk", F.when(F.col("_cuts").isNotNull(), late).otherwise(-1)).drop("_cuts", "_g")
    else:
        rows = rows.withColumn("_chunk", F.lit(-1))

    chunk = Window.partitionBy(group, "_chunk").orderBy(*order)
    whole = chunk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inner = rows.select(group, *order, value, "_chunk",
                        F.row_number().over(chunk).alias("_rn"), F.count("*").over(whole).alias("_size"),
                        *_lagged_products(rows, chunk, value, max_lag))
    sums = [F.sum(f"_p{k}").alias(f"_p{k}") for k in range(1, max_lag + 1)]
    parts = inner.groupBy(group).agg(*sums)

    if any_hot:
        edge = (F.col("_rn") <= max_lag) | (F.col("_rn") > F.col("_size") - max_lag)
        rim = inner.where((F.col("_chunk") >= 0) & edge).select(group, *order, value, "_chunk")
        along = Window.partitionBy(group).orderBy("_chunk", *order)
        crosses = lambda k, w: F.lead("_chunk", k).over(w) != F.col("_chunk")
        across = rim.select(group, *_lagged_products(rim, along, value, max_lag, crosses))
        parts = parts.unionByName(across.groupBy(group).agg(*sums))
    total = parts.groupBy(group).agg(*[F.sum(f"_p{k}").alias(str(k)) for k in range(1, max_lag + 1)])
    long = total.unpivot(group, [F.col(f"`{k}`") for k in range(1, max_lag + 1)], "lag", "ac")
    return long.where(F.col("ac").isNotNull()).select(group, F.col("lag").cast("int").alias("lag"), "ac")


def distance_autocorrelation(df: DataFrame, row_id: str, points: Column, n_points: int, width: float = 0.1,
                             n_bins: int = 10) -> DataFrame:
    """(row_id, bin, ac): per record, sum of property products of its point pairs by distance bin.

    ``points`` is an array of ``n_points`` arrays [x, y, z, property] belonging to one record. The pairs are those
    of one record's fixed set of points and stay inside the row, without a shuffle; only the binned sums come out. The
    last bin takes all longer distances, an empty bin is 0.
    """
    pairs = F.array(*[F.array(F.lit(i), F.lit(j)) for i in range(n_points) for j in range(i + 1, n_points)])
    cloud = df.select(row_id, points.alias("_pts"))
    p = F.col("_pts")

    def measured(ij):
        a, b = p[ij[0]], p[ij[1]]
        gap = F.sqrt(sum(((a[k] - b[k]) * (a[k] - b[k]) for k in range(3)), F.lit(0.0)))
        return F.struct(F.least(F.floor(gap / width), F.lit(n_bins - 1)).cast("int").alias("bin"),
                        (a[3] * b[3]).alias("w"))

    near = cloud.select(row_id, F.transform(pairs, measured).alias("_near"))

    def bin_sum(b):
        return F.aggregate("_near", F.lit(0.0), lambda acc, m: acc + F.when(m["bin"] == b, m["w"]).otherwise(0.0))

    sums = F.array(*[F.struct(F.lit(b).alias("bin"), bin_sum(b).alias("ac")) for b in range(n_bins)])
    return near.select(row_id, F.inline_outer(sums))
