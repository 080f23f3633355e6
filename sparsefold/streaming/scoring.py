"""Row-wise featurisation and scoring of arriving records.

Only operators without state across rows are used, so a stream needs no watermark and a restart resumes from the
checkpoint of the caller's sink.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from sparsefold.functions.text import tokens, ngram_bits
from sparsefold.operators.descriptors import scalar_descriptors
from sparsefold.operators.evaluate import to_class
from sparsefold.operators.fingerprint import TEXT_KEYS, key_array


def arriving_records(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """New parquet files under ``path`` as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def featurise(records: DataFrame, row_id: str, text: str, n_bits: int = 1024) -> DataFrame:
    """(row_id, bits, keys, descriptors...) for batch or streaming records with ``lang``."""
    kept = records.select(row_id, F.col(text).alias("text"), "lang")
    first = kept.select("*", tokens(F.col("text")).alias("_tok"))
    with_bits = first.select(row_id, "text", ngram_bits(F.col("_tok"), n_bits).alias("bits"), key_array(TEXT_KEYS).alias("keys"))
    return scalar_descriptors(with_bits, row_id, "text", keep=("bits", "keys"))


def score(records: DataFrame, model: PipelineModel, row_id: str) -> DataFrame:
    """(row_id, prob, cls) from a fitted pipeline with a probability column."""
    from pyspark.ml.functions import vector_to_array

    prob = vector_to_array("probability")[1]
    return model.transform(records).select(row_id, prob.alias("prob"), to_class(prob).alias("cls"))
