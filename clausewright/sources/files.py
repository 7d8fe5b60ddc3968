"""File sources and sinks: CSV ledgers as text, JSON lines, paged text, and discovery of files by name."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

YEARS = r"(?:19|20)\d{2}\s*[-–]\s*(?:19|20)\d{2}"


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir; a local session that names none uses its warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base or spark.conf.get('spark.sql.warehouse.dir')}/scratch_{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: what several plans read is made once, and lost executors cost no more than a file."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Every column as text, blanks as the empty text; malformed lines are left out."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "DROPMALFORMED")
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    return reader.csv(path).na.fill("")


def header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).schema.names


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; what does not parse becomes nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def find(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Paths under `root` of files with exactly that name, without backups."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select("path")
    return files.where(~F.lower("path").contains("bak")).distinct().orderBy("path")


def pages(text: Column) -> Column:
    """Pages of a text, split on form feeds, as structs of number (from 1) and text."""
    return F.transform(F.split(text, "\f"), lambda p, i: F.struct((i + 1).alias("page_no"), p.alias("text")))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.inline(pages(F.col("value"))))


def with_footer(page: Column, name: Column, number: Column) -> Column:
    """The last line stays if it has a range of years; else `name Page n` takes its place."""
    lines = F.split(page, "\n")
    last = F.element_at(lines, -1)
    footer = F.when(last.rlike(YEARS), last).otherwise(F.concat(name, F.lit(" Page "), number))
    return F.array_join(F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(footer)), "\n")


def needs_ocr(page_texts: Column, least: int = 50) -> Column:
    """Whether the first three pages hold less than `least` characters."""
    return F.length(F.array_join(F.slice(page_texts, 1, 3), "")) < least


def marked(page_structs: Column) -> Column:
    """Pages joined, each behind its mark."""
    return F.array_join(F.transform(page_structs, lambda p: F.concat(F.lit("<<page_"), p["page_no"], F.lit(">>\n"), p["text"])), "\n")
