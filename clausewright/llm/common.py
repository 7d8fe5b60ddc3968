"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 8

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text of a row; a null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; nulls become empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [t if t is not None else "" for t in column.to_pylist()]


def unused(columns: list[str], n: int) -> list[str]:
    """n names that no column has, in any case of letters."""
    taken = {c.lower() for c in columns}
    free = (name for k in range(len(taken) + n) if (name := f"_x{k}") not in taken)
    return list(islice(free, n))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or the context's own; a local session that has neither uses its warehouse."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named or own.isDefined():
        return named or own.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the reliable checkpoint folder and read it back."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


_KEPT: list[tuple[str, str | None]] = []


def to_discard(path: str, name: str | None = None) -> None:
    """Note a folder, and the table over it, that `discard` may delete."""
    _KEPT.append((path, name))


def discard(spark: SparkSession) -> None:
    """Delete the tables that operators have kept in the shared folder; for when their results have been written or read."""
    while _KEPT:
        path, name = _KEPT.pop()
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def kept_table(df: DataFrame) -> DataFrame:
    """Like `cut_lineage`, as a compressed columnar table in the same folder: for what is large."""
    path = f"{shared_folder(df.sparkSession)}/table_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    to_discard(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """`new`, kept as a table, in place of the kept table `old` that it is made from and that nothing else needs."""
    spark = old.sparkSession
    folders = {f.rpartition("/")[0] for f in old.inputFiles()}
    kept = kept_table(new)
    for folder in folders:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    release(spark)
    return kept


def release(spark: SparkSession) -> None:
    """Let the driver notice which shuffles nothing refers to any more, so that executors delete their files now."""
    gc.collect()
    spark._jvm.System.gc()


def salted_join(large: DataFrame, small: DataFrame, key: str | list[str], spread: str, salts: int = SALTS) -> DataFrame:
    """Inner merge join in which one key may hold a large share of `large`; `small` has one row a key.

    The rows of a key in `large` go to `salts` tasks by a hash of `spread`; `small` is repeated for each.
    """
    (name,) = unused([*large.columns, *small.columns], 1)
    keys = [key] if isinstance(key, str) else key
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    each = small.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return large.withColumn(name, salt).join(each.hint("merge"), [*keys, name]).drop(name)
