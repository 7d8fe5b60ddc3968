"""Bounded samples of labelled rows, and the split into learned and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import text_of


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def sample(labels: DataFrame, label_col: str, folds: int, held: int, bound: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of at most `bound` learnable rows, in the order of a hash of the id.

    Rows of the held-out fold, null ids and labels other than 0 and 1 are left out; an id with both labels
    counts as 1. The bound is a parameter, so the sample can be sent to every executor.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(id_col, folds) != held))
    rows = rows.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(bound)


def labelled_texts(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> list[Row]:
    """(id, text, label) by id, one row for each id of `chosen` that `docs` has; of several texts under one id the least."""
    found = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    return found.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label")).orderBy("id").collect()
