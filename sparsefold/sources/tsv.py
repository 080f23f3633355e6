"""Tab-separated files with a header, with or without a leading index column.

Line breaks, tabs, quotes and backslashes inside strings are escaped, so that a row is always one line and files stay
splittable; nulls, empty strings and blanks at the ends come back as they were.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

INDEX_COLUMN = "index"
# Fixed format: what stands in a file for each character, backslash first.
ESCAPES = {"\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", '"': "\\q"}
EMPTY, NULL = "\\e", "\\N"


def _escaped(col: Column) -> Column:
    plain = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), ESCAPES.items(), col)
    return F.when(col == "", EMPTY).otherwise(plain)


def _restored(col: Column) -> Column:
    """Split at escaped backslashes first: what is left of a backslash in a piece starts another escape."""
    others = [(v, k) for k, v in ESCAPES.items() if k != "\\"]
    piece = lambda c: reduce(lambda p, pair: F.replace(p, F.lit(pair[0]), F.lit(pair[1])), others, c)
    whole = F.array_join(F.transform(F.split(col, r"\\\\", -1), piece), "\\")
    return F.when(col == EMPTY, "").otherwise(whole)


def _mapped(df: DataFrame, fn) -> DataFrame:
    return df.select(*[fn(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`") for f in df.schema])


def write_tsv(df: DataFrame, path: str, index: bool = False, mode: str = "errorifexists") -> None:
    """Every task writes its own file. The index is unique and increasing within each file, not dense:
    a dense one would force all rows through one ordering step, and readers drop the column anyway."""
    out = _mapped(df, _escaped)
    if index:
        out = out.select(F.monotonically_increasing_id().alias(INDEX_COLUMN), "*")
    (out.write.mode(mode).option("sep", "\t").option("header", True).option("nullValue", NULL)
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .option("quote", "").option("escape", "\u0000").csv(path))


def read_tsv(spark: SparkSession, path: str, schema: StructType, index: bool = False) -> DataFrame:
    """Read with an explicit schema; drop the first column when it is an index."""
    full = StructType([StructField(INDEX_COLUMN, LongType())] + schema.fields) if index else schema
    df = (spark.read.option("sep", "\t").option("header", True).option("nullValue", NULL)
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .option("quote", "").option("escape", "\u0000").schema(full).csv(path))
    return _mapped(df.drop(INDEX_COLUMN) if index else df, _restored)
