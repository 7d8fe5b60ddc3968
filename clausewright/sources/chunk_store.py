"""A chunk store in files: chunks with their recency weights and embeddings, by language and by a hash of the id.

Folders `language=<l>/part=<p>`; a chunk's folder follows from its language and id, so a look-up by id opens one part of each language. In
a folder rows are sorted by article, so that a filter on articles skips row groups. Writing replaces the folders that the new rows fall in and leaves the others
as they are (dynamic overwrite); `upsert` first takes along what these hold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import end_year, file_stem, recency_weight, token_count
from ..operators import chunking
from .files import kept

PARTS = 16
COLUMNS = "chunk_id string, language string, article_number string, clause_id string, section_title string, page_no int, text string, token_count int, recency_weight double, embedding array<float>"
_COLUMNS = [c.split()[0] for c in COLUMNS.split(", ")]
_SCHEMA = f"{COLUMNS}, part int"


def _part(parts: int, chunk_id: Column) -> Column:
    return F.pmod(F.xxhash64(chunk_id), F.lit(parts)).cast("int")


def canonical(chunks: DataFrame) -> DataFrame:
    """The store's columns in order, missing ones as nulls, others left out; rows without an id or a language are no chunks."""
    kinds = dict(c.split(" ", 1) for c in COLUMNS.split(", "))
    rows = chunks.select(*((F.col(c) if c in chunks.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))
    return rows.where("chunk_id IS NOT NULL AND language IS NOT NULL")


def write(chunks: DataFrame, path: str, parts: int = PARTS) -> None:
    """Replace the folders that `chunks` fall in; of rows with one language and id the last by text stays."""
    one = Window.partitionBy("language", "chunk_id").orderBy(F.desc("text"), F.desc("page_no"))
    rows = canonical(chunks).withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n").withColumn("part", _part(parts, F.col("chunk_id")))
    ordered = rows.repartition("language", "part").sortWithinPartitions("language", "part", "article_number", "chunk_id")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("language", "part").parquet(path)


def read(spark: SparkSession, path: str, languages: Sequence[str] | None = None, articles: Sequence[str] | None = None, ids: Sequence[str] | None = None, parts: int = PARTS) -> DataFrame:
    """The chunks that pass the filters: languages and ids choose folders, articles are pushed to the scan."""
    rows = spark.read.schema(_SCHEMA).parquet(path)
    if languages is not None:
        rows = rows.where(F.col("language").isin(*languages))
    if ids is not None:
        places = spark.range(1).select(F.array_distinct(F.array(*(_part(parts, F.lit(i)) for i in ids))).alias("p")).first()["p"] if ids else []
        rows = rows.where(F.col("part").isin(*places) & F.col("chunk_id").isin(*ids))
    if articles is not None:
        rows = rows.where(F.col("article_number").isin(*articles))
    return rows.select(*_COLUMNS)


def upsert(spark: SparkSession, chunks: DataFrame, path: str, parts: int = PARTS) -> None:
    """Replace chunks by language and id, and add new ones; folders without such a chunk are not touched."""
    new = canonical(chunks).withColumn("part", _part(parts, F.col("chunk_id")))
    folders = new.select("language", "part").distinct()
    held = spark.read.schema(_SCHEMA).parquet(path).join(folders, ["language", "part"], "left_semi").join(new.select("language", "chunk_id"), ["language", "chunk_id"], "left_anti")
    write(kept(held.select(*_COLUMNS).unionByName(new.select(*_COLUMNS))), path, parts)  # the path is read before it is written


def ingest(documents: DataFrame, embed: Callable[[Column], Column] | None = None, least: int = 30, most: int = 512) -> DataFrame:
    """Chunks of documents (source, language, text): clauses, short ones merged and long ones split, with the recency of the source's name.

    `embed` makes a column of vectors from one of texts, such as a pandas UDF over a model; without it vectors are null.
    """
    stem = file_stem(F.col("source"))
    docs = documents.select(F.struct("language", stem.alias("doc_id")).alias("doc_id"), "text")
    clauses = chunking.segmented(chunking.lines_of(docs)).withColumn("tokens", token_count(F.col("text")))
    merged = chunking.merge_short(clauses.select("doc_id", "ord", "text", "page", "tokens", F.struct("article", "clause", "title").alias("clause")), least=least)
    parts = chunking.split_long(F.col("text"), most)
    rows = merged.select("doc_id", "gid", "clause", "page", F.posexplode(F.arrays_zip(parts.alias("text"), chunking.part_ids(F.col("clause.clause"), parts).alias("clause_id"))).alias("n", "p"))
    year = end_year(F.col("doc_id.doc_id"))
    out = rows.select(
        F.concat_ws("_", "doc_id.doc_id", "doc_id.language", F.concat(F.lit("chunk"), F.col("gid").cast("string")), (F.col("n") + 1).cast("string")).alias("chunk_id"), F.col("doc_id.language").alias("language"), F.col("clause.article").alias("article_number"),
        "p.clause_id", F.col("clause.title").alias("section_title"), F.col("page").alias("page_no"), "p.text", token_count(F.col("p.text")).alias("token_count"), F.coalesce(recency_weight(year), F.lit(1.0)).alias("recency_weight"),
    )
    return out if embed is None else out.withColumn("embedding", embed(F.col("text")))


def summary(store: DataFrame) -> DataFrame:
    """(language, chunks, avg_tokens, weight): what a run of ingestion reports."""
    return store.groupBy("language").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("token_count"), 1).alias("avg_tokens"), F.max("recency_weight").alias("weight"))
