"""Ranks and running totals over a whole table without sorting it in one task.

The order key is cut into buckets whose totals are few; only inside a bucket are rows ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparsefold.session import small_side


def running_total(df: DataFrame, by: list[str], bucket: str, order: list[str], values: list[str]) -> DataFrame:
    """Adds ``{v}_before``: the sum of v over all earlier rows of the same ``by`` group.

    ``bucket`` must be monotone in ``order``. The outer window sees one row per bucket.
    """
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, bucket).agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, bucket, *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}") for v in values])
    rows = df.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{v}") for v in values])
    joined = rows.join(starts, [*by, bucket])
    return joined.select(*df.columns, *[(F.col(f"_{v}") + F.col(f"_in_{v}")).alias(f"{v}_before") for v in values])


def quantile_bucket(df: DataFrame, col: str, n: int = 256) -> Column:
    """A bucket number monotone in ``col``, from n quantiles of it (at most n numbers reach the driver)."""
    cuts = sorted(set(df.approxQuantile(col, [i / n for i in range(1, n)], 1 / (4 * n))))
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(col)))


def rank_cuts(keyed: DataFrame, strata: list[str], hashed: str, row_id: str, ranks) -> DataFrame:
    """(strata..., cuts): the hash and id found at given ranks of each stratum's hash order.

    ``keyed`` holds strata, a hex hash and an id per row. ``ranks`` maps the stratum size column to an
    array of ranks. Buckets are counted by hash prefix (65,536 per stratum), and only the few buckets that
    contain a wanted rank are sorted. Rank 0 gives no cut, as no row lies at or below it.
    """
    prefix = F.substring(hashed, 1, 4)
    sizes = keyed.groupBy(*strata, prefix.alias("_b")).agg(F.count("*").alias("_n"))
    run = Window.partitionBy(*strata).orderBy("_b")
    whole = Window.partitionBy(*strata)
    wanted = (sizes.select(*strata, "_b", F.sum("_n").over(run).alias("_hi"), "_n",
                           F.sum("_n").over(whole).alias("_total"))
              .select(*strata, "_b", (F.col("_hi") - F.col("_n")).alias("_lo"), "_hi",
                      F.posexplode(ranks(F.col("_total"))).alias("_cut", "_rank"))
              .where((F.col("_lo") < F.col("_rank")) & (F.col("_rank") <= F.col("_hi")))
              .select(*strata, "_b", "_cut", (F.col("_rank") - F.col("_lo")).alias("_want")))
    near = keyed.select(*strata, hashed, row_id, prefix.alias("_b")).join(small_side(wanted), [*strata, "_b"])
    inside = Window.partitionBy(*strata, "_cut").orderBy(hashed, row_id)
    found = near.withColumn("_rn", F.row_number().over(inside)).where(F.col("_rn") == F.col("_want"))
    return found.groupBy(*strata).agg(
        F.collect_list(F.struct("_cut", F.col(hashed).alias("h"), F.col(row_id).alias("id"))).alias("cuts"))


def cuts_passed(cuts: Column, hashed: str, row_id: str) -> Column:
    """How many cut points lie strictly before the row."""
    h, i = F.col(hashed), F.col(row_id)
    return F.coalesce(F.size(F.filter(cuts, lambda c: (c["h"] < h) | ((c["h"] == h) & (c["id"] < i)))), F.lit(0))
