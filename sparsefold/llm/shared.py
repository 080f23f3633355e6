"""What several operators here need: stored tables, row keys, small expression helpers."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparsefold.session import shared_dir


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` under the shared folder named by ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage at a table that every executor can reach, so a lost executor costs no recomputation. Results read the
    tables lazily; ``sparsefold.session.drop_stored`` deletes them once nothing is left to compute.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def row_key(*cols: Column) -> Column:
    """A 16 byte key of a row's values, nulls told apart; rows that agree in all of them share it."""
    marked = [F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit("-")) for c in cols]
    return F.unhex(F.md5(F.concat_ws("\x1f", *marked)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """Hint a broadcast of a stored table only if its counted rows, at ``row_bytes`` each, stay below ``limit`` bytes."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def numbered(items: list[str]) -> tuple[np.ndarray, list[str]]:
    """(number of each item, distinct items in order of first sight). Unlike pandas' factorize it reads past NUL characters."""
    seen: dict[str, int] = {}
    first = np.fromiter(map(seen.setdefault, items, count()), dtype=np.int64, count=len(items))
    dense = np.zeros(len(items), dtype=np.int64)
    dense[np.fromiter(seen.values(), dtype=np.int64, count=len(seen))] = np.arange(len(seen))
    return dense[first], list(seen)
