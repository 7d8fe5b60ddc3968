"""Stratified samples by a hash order, blind sheets and adjudication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stratified(df: DataFrame, strata: list[str], key: str, quota: Column, seed: int = 42) -> DataFrame:
    """`quota` rows of each stratum in the order of a hash of the seed and the key.

    The largest quota is looked up first. As a constant it lets every task drop what is beyond it in a stratum before the shuffle, and
    again after it, so a large stratum reaches its task as that many rows from each of the others.
    """
    most = df.select(F.max(quota.cast("bigint"))).first()[0] or 0
    order = Window.partitionBy(*strata).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    return df.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= F.lit(int(most))).where(F.col("pick") <= quota)


def disjoint(df: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    return df.join(taken.select(key), key, "left_anti")


def item_ids(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Opaque ids H001, H002 and on, in hash order; a sample is small, so one ordering of it is one task."""
    w = Window.orderBy(F.md5(F.concat(F.lit(f"{seed}#"), F.col(key).cast("string"))), key)
    return df.withColumn("item_id", F.concat(F.lit("H"), F.lpad(F.row_number().over(w).cast("string"), 3, "0")))


def scaled_quotas(cells: DataFrame, total: int) -> DataFrame:
    """Quotas of cells (cell, n) in proportion, rounded half to even; what rounding leaves over goes to the largest cell."""
    n = cells.agg(F.sum("n").alias("all"))
    rows = cells.crossJoin(n).withColumn("quota", F.bround(total * F.col("n") / F.col("all")).cast("bigint"))
    drift = rows.agg((F.lit(total) - F.sum("quota")).alias("drift"), F.min(F.struct((-F.col("n")).alias("m"), "cell")).alias("big"))
    return rows.crossJoin(drift).select("cell", "n", (F.col("quota") + F.when(F.col("cell") == F.col("big.cell"), F.col("drift")).otherwise(0)).alias("quota"))


def adjudicated(first: Column, second: Column, final: Column) -> Column:
    """The label both gave, else the adjudicator's; null while that is missing."""
    return F.when(first.eqNullSafe(second), first).otherwise(final)
