"""Incremental ledgers with Structured Streaming: micro-batches of files, upserted by key, with versions for recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.ledger import keep_last


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the complete versions in a folder, in order."""
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version_*/_SUCCESS")
    files = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found) or []
    return sorted(int(f.getPath().getParent().getName().removeprefix("version_")) for f in files)


def upsert_stream(spark: SparkSession, source: DataFrame, keys: list[str], place: str, path: str) -> str:
    """Drain `source` and keep the last row of each key; returns the path of the final version, or `path` before the first one.

    Every batch reads the last complete version before it, found in the folder, and writes its own. So a batch that runs again
    after a failure overwrites what it wrote and changes nothing else, and a stream that starts again from its checkpoint goes
    on from the ledger it left.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        before = [v for v in versions(s, path) if v < batch_id]
        rows = s.read.parquet(f"{path}/version_{before[-1]}").unionByName(batch) if before else batch
        keep_last(rows, keys, place).write.mode("overwrite").parquet(f"{path}/version_{batch_id}")

    run = source.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    found = versions(spark, path)
    return f"{path}/version_{found[-1]}" if found else path


def file_stream(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A stream over a parquet table's files; written as a pattern, the path may be one file or a folder."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(pattern).select(*columns)


def running_means(source: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """The live aggregate: group means of all rows so far, read from memory after the stream is drained."""
    from pyspark.sql import functions as F

    means = source.groupBy(by).agg(F.round(F.avg(value), 4).alias("mean"), F.count(F.lit(1)).alias("n"))
    run = means.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return source.sparkSession.table(name)
