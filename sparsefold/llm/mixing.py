"""Mixing sources to target weights by Poisson replication, then a global shuffle.

A source's repetition rate is its target weight's share of the output over its own size. Each row draws its count from a
Poisson distribution of that mean, by inverting the distribution at a uniform number that a seeded hash of the row gives;
rates above ``PART`` are sums of equal parts, each with a draw of its own. Rows are then exploded by their counts and
spread by a hash that orders the output. DataFrame functions only.

Rows without a source form a source of their own; rows without an id draw by their text. Null texts have size 0 and draw
like others; a source of empty texts alone keeps its rows at the rate of the whole. Rows that agree in id and text draw the same count and order key each. A weight for a source that has no
rows takes part in the shares of nobody; sources without a weight are left out only if weights are given. An empty table
gives an empty one. All input columns are kept; ``copy`` and ``position`` replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from sparsefold.llm.shared import broadcast_if_small, let, stored, whole

SEED = 17
#: Without given weights a source's share grows as this power of its characters: below 1 favours small sources.
ALPHA = 0.7
PART = 16.0
#: Terms of the distribution that inversion may need: past them a part of mean ``PART`` leaves less than 2^-53.
TERMS = 80
MAX_SPREAD = 52


def unit(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of the parts, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << MAX_SPREAD)


def place(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def rates(docs: DataFrame, source: str, text: str, weights: Mapping[str, float] | None, alpha: float, epochs: float) -> DataFrame:
    """(source, rate), stored: output characters over own characters. The sums are partial before the shuffle, so a
    large source is no hot key."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.length(whole(text))).cast("double").alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("size", F.lit(alpha)))
    else:
        listed = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        sizes = sizes.join(listed, F.col("source").eqNullSafe(F.col("name")))
    sizes = stored(sizes.select("source", "size", "weight").where("size = 0 or weight > 0"))
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight")).first()
    share = F.col("weight") / F.lit(total["all_weight"] or 1.0) * F.lit((total["all_size"] or 0.0) * epochs)
    return sizes.select("source", F.when(F.col("size") > 0, share / F.col("size")).otherwise(F.lit(float(epochs))).alias("rate"))


def inverted(u: Column, mean: Column) -> Column:
    """The least k whose cumulated probability exceeds u."""
    def step(acc: Column, k: Column) -> Column:
        more = acc["below"] <= u
        p = acc["p"] * mean / k
        return F.struct(F.when(more, p).otherwise(acc["p"]).alias("p"), F.when(more, acc["below"] + p).otherwise(acc["below"]).alias("below"),
                        F.when(more, k.cast("int")).otherwise(acc["k"]).alias("k"))

    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("below"), F.lit(0).alias("k"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["k"])


def drawn(identity: Column, rate: Column, seed: int) -> Column:
    parts = F.greatest(F.ceil(rate / PART).cast("int"), F.lit(1))

    def total(x: Column) -> Column:
        draws = F.transform(F.sequence(F.lit(1), x["n"]), lambda j: let(F.struct(unit(F.lit(f"count{seed}"), x["id"], j.cast("string")).alias("u"), x["mean"].alias("m")),
                                                                    lambda y: inverted(y["u"], y["m"])))
        return F.aggregate(draws, F.lit(0), lambda a, b: a + b)

    return let(F.struct(identity.alias("id"), (rate / parts).alias("mean"), parts.alias("n")), total)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Mapping[str, float] | None = None,
        alpha: float = ALPHA, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """``docs`` replicated, with ``copy`` (from 1) and ``position``, the key of the global order.

    Rates meet rows by a broadcast where the counted sources are few; beyond that the rows of a source are dealt over
    salted copies of its rate, so a source that holds a third of all rows is no hot key.
    """
    by_source = rates(docs, source, text, weights, alpha, epochs)
    names = [c for c in docs.columns if c not in ("copy", "position")]
    identity = F.coalesce(F.col(doc_id).cast("string"), F.md5(whole(text)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), identity.alias("identity"), F.col(source).alias("source_key"))
    few = broadcast_if_small(by_source, 256)
    if few is by_source:
        salts = 64
        salt = F.pmod(F.xxhash64("identity"), F.lit(salts)).cast("int")
        few = by_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = rows.withColumn("row_salt", salt).join(few, (F.col("row_salt") == F.col("salt")) & F.col("source_key").eqNullSafe(F.col("source")))
    else:
        met = rows.join(few, F.col("source_key").eqNullSafe(F.col("source")))
    counted = met.select("row", "identity", drawn(F.col("identity"), F.col("rate"), seed).alias("n")).where("n > 0")
    copies = counted.select("row", "identity", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    spread = copies.withColumn("position", place(F.lit(f"place{seed}"), F.col("identity"), F.col("copy").cast("string")))
    return spread.repartition("position").sortWithinPartitions("position").select("row.*", "copy", "position")
