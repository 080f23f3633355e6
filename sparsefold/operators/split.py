"""Exact-size, reproducible splits in hash order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from sparsefold.functions.hashing import hash_prefix, seeded_hash
from sparsefold.operators.ordering import cuts_passed, rank_cuts, running_total
from sparsefold.session import settle, small_side


def split_fractions(df: DataFrame, row_id: str, fractions: list[float], names: list[str], seed: int,
                    out: str = "part") -> DataFrame:
    """Adds ``out``: disjoint covering parts with rounded cumulative sizes."""
    if not math.isclose(sum(fractions), 1.0, abs_tol=1e-9):
        raise ValueError(f"fractions sum to {sum(fractions)}, not 1")
    if len(names) != len(fractions):
        raise ValueError("one name per fraction")
    edges = [round(sum(fractions[:i + 1]), 12) for i in range(len(fractions) - 1)]
    keyed = df.withColumn("_h", seeded_hash(F.col(row_id), seed)).withColumn("_all", F.lit(0))
    if not edges:
        return df.withColumn(out, F.lit(names[0]))

    def ranks(n: Column) -> Column:
        return F.array(*[F.round(n * F.lit(e)).cast("bigint") for e in edges])

    # One cut per edge, as literals. Cuts at rank 0 are missing, hence counted as passed.
    found = rank_cuts(keyed.select("_all", "_h", row_id), ["_all"], "_h", row_id, ranks).head()
    cuts = found["cuts"] if found else []
    h, i = F.col("_h"), F.col(row_id)
    passed = F.lit(len(edges) - len(cuts))
    for cut in cuts:
        passed = passed + ((h > cut["h"]) | ((h == cut["h"]) & (i > cut["id"]))).cast("int")
    name = F.array(*map(F.lit, names))
    return keyed.select(*df.columns, name[passed].alias(out))


def with_test_part(df: DataFrame, row_id: str, seed: int = 1, test: float = 0.2) -> DataFrame:
    """Adds ``part``: 'test' for the last share of rows, 'train' before it."""
    return split_fractions(df, row_id, [1 - test, test], ["train", "test"], seed)


def stratified_shuffle_split(df: DataFrame, row_id: str, label: str, repeats: int = 20, test: float = 0.125,
                             first_seed: int = 1) -> DataFrame:
    """(rep, row_id, label, is_test): per repeat and class, the first round(test * n) rows in hash order."""
    reps = F.sequence(F.lit(first_seed), F.lit(first_seed + repeats - 1))
    keyed = df.select(row_id, label, F.explode(reps).alias("rep"))
    keyed = keyed.withColumn("_h", seeded_hash(F.col(row_id), F.col("rep")))
    cuts = rank_cuts(keyed, ["rep", label], "_h", row_id, lambda n: F.array(F.round(n * F.lit(test)).cast("bigint")))
    assigned = keyed.join(small_side(cuts), ["rep", label], "left")
    in_test = F.col("cuts").isNotNull() & (cuts_passed(F.col("cuts"), "_h", row_id) == 0)
    return assigned.select("rep", row_id, label, in_test.alias("is_test"))


def split_by_group(df: DataFrame, group: str, seed: int = 1, train: float = 0.7, valid: float = 0.1) -> DataFrame:
    """(group, part): whole groups in hash order; train while the running size stays within its share.

    Group sizes are aggregated first, so a group of any size is one row here.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).withColumn("_h", seeded_hash(F.col(group), seed))
    sizes = sizes.withColumn("_b", hash_prefix(F.col("_h")))
    total = sizes.agg(F.sum("n")).scalar()
    upto = F.col("n_before") + F.col("n")
    placed = running_total(sizes, [], "_b", ["_h", group], ["n"])
    part = (F.when(upto <= total * F.lit(train), "train")
            .when(upto <= total * F.lit(round(train + valid, 12)), "valid").otherwise("test"))
    return placed.select(group, part.alias("part"))


def seeded_group_splits(df: DataFrame, row_id: str, group: str, seeds: list[int], train: float = 0.7,
                        valid: float = 0.1) -> DataFrame:
    """(seed, row_id, part): predefined splits for several seeds. Test groups are those of the first seed
    for all of them; the other groups change sides by seed.

    Groups' sides are stored seed by seed: one plan of all seeds' orders would fill the driver."""
    df = settle(df.select(row_id, group))
    fixed = split_by_group(df, group, seeds[0], train, valid)
    held = settle(fixed.where(F.col("part") == "test").select(group))
    rest = settle(df.join(small_side(held), group, "left_anti"))
    share = train / (train + valid)
    test = settle(df.join(small_side(held), group, "left_semi").select(row_id))
    out = None
    for seed in seeds:
        sides = settle(split_by_group(rest, group, seed, share, 1 - share).replace("test", "valid", subset=["part"]))
        rows = rest.join(small_side(sides), group).select(F.lit(seed).alias("seed"), row_id, "part")
        rows = rows.unionByName(test.select(F.lit(seed).alias("seed"), row_id, F.lit("test").alias("part")))
        out = rows if out is None else out.unionByName(rows)
    return out
