"""Column functions, and their registration as SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import lexical


def register_all(spark: SparkSession) -> list[str]:
    """Make the lexical metrics callable from SQL; the names that were registered."""
    found = {"bleu": lexical.bleu_column, "rouge_1": lexical.rouge_1_column, "rouge_2": lexical.rouge_2_column, "rouge_l": lexical.rouge_l_column, "meteor": lexical.meteor_column}
    for name, f in found.items():
        spark.udf.register(name, f)
    return list(found)
