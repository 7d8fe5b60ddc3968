"""A ledger in buckets of its key: a micro-batch rewrites the buckets that it touches, and nothing else.

Rows live in `data/batch=<id>/bucket=<b>`; `manifest/<id>` says for every bucket which batch wrote what it holds now, and whether
anything does. A batch starts from the last manifest before its own number, merges what the touched buckets hold with its rows, writes
them anew under its number, and then puts its manifest in place by one rename. So a batch that runs again after a failure makes
the same version again, a stream that starts again from its checkpoint goes on from where it was, and readers see whole versions only.
`vacuum` deletes what no manifest of the last versions names.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ledger import keep_last

BUCKETS = 16

Merge = Callable[[DataFrame], DataFrame]


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, where = _path(spark, f"{path}/manifest/*")
    return sorted(int(f.getPath().getName()) for f in fs.globStatus(where) or [] if f.getPath().getName().isdigit())


def manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """The batch that wrote each bucket's rows."""
    fs, where = _path(spark, f"{path}/manifest/{version}")
    stream = fs.open(where)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {int(b): n for b, n in json.loads(text).items()}


def _publish(spark: SparkSession, path: str, version: int, of: dict[int, int]) -> None:
    fs, draft = _path(spark, f"{path}/manifest/.{version}.draft")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(json.dumps({str(b): of[b] for b in sorted(of)}).encode()))
    finally:
        stream.close()
    _, final = _path(spark, f"{path}/manifest/{version}")
    fs.delete(final, False)
    if not fs.rename(draft, final):
        raise OSError(f"manifest {version} of {path} could not be put in place")


def _rows(spark: SparkSession, path: str, of: dict[int, int], schema: StructType | str) -> DataFrame:
    folders = [f"{path}/data/batch={n}/bucket={b}" for b, n in sorted(of.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def ledger(spark: SparkSession, path: str, schema: StructType | str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last one if none is named; without versions an empty table."""
    found = versions(spark, path)
    if version is None and not found:
        return spark.createDataFrame([], schema)
    return _rows(spark, path, manifest(spark, path, found[-1] if version is None else version), schema)


def apply(batch: DataFrame, number: int, keys: list[str], merge: Merge, path: str, buckets: int = BUCKETS) -> None:
    """Make version `number` from the one before it; `merge` turns old rows and new ones together into one row a key."""
    spark = batch.sparkSession
    before = [v for v in versions(spark, path) if v < number]
    of = manifest(spark, path, before[-1]) if before else {}
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    batch = batch.persist()
    try:
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # at most `buckets` numbers
        if touched:
            old = _rows(spark, path, {b: of[b] for b in touched if b in of}, batch.schema)
            rows = merge(old.unionByName(batch)).withColumn("bucket", bucket)
            rows.repartition("bucket", *keys).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={number}")
        _publish(spark, path, number, of | dict.fromkeys(touched, number))
    finally:
        batch.unpersist()


def merge_stream(source: DataFrame, keys: list[str], merge: Merge, path: str, buckets: int = BUCKETS) -> None:
    """Drain `source` into the ledger at `path`; called again, it goes on after what was drained."""
    run = source.writeStream.foreachBatch(lambda batch, number: apply(batch, number, keys, merge, path, buckets))
    run.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def upsert(keys: list[str], place: str) -> Merge:
    """The last row of each key by `place`."""
    return lambda rows: keep_last(rows, keys, place)


def summed(keys: list[str]) -> Merge:
    """Sums of all other columns by key: running counts and totals."""

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in rows.columns if c not in keys))

    return merge


def running_means(source: DataFrame, by: str, value: str, path: str) -> DataFrame:
    """(by, mean, n) of all rows so far, from sums that every micro-batch adds to; kept in a ledger, so they outlive the session."""

    def merge(number: int, batch: DataFrame) -> None:
        parts = batch.groupBy(by).agg(F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0)).alias("total"), F.count(value).alias("filled"), F.count(F.lit(1)).alias("n"))
        apply(parts, number, [by], summed([by]), path)

    run = source.writeStream.foreachBatch(lambda batch, number: merge(number, batch)).option("checkpointLocation", f"{path}/checkpoint")
    run.trigger(availableNow=True).start().awaitTermination()
    schema = f"`{by}` {source.schema[by].dataType.simpleString()}, total double, filled bigint, n bigint"
    rows = ledger(source.sparkSession, path, schema)
    return rows.select(by, F.round(F.try_divide("total", "filled"), 4).alias("mean"), "n")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the last `keep` versions, and the bucket folders that none of these names; returns how many folders went."""
    found = versions(spark, path)
    named = reduce(set.union, (set((n, b) for b, n in manifest(spark, path, v).items()) for v in found[-keep:]), set())
    fs, where = _path(spark, f"{path}/data/batch=*/bucket=*")
    gone = 0
    for f in fs.globStatus(where) or []:
        batch, bucket = (int(x.getName().partition("=")[2]) for x in (f.getPath().getParent(), f.getPath()))
        if found and batch <= found[-1] and (batch, bucket) not in named:
            fs.delete(f.getPath(), True)
            gone += 1
    for v in found[:-keep]:
        fs.delete(_path(spark, f"{path}/manifest/{v}")[1], False)
    return gone
