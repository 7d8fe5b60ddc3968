"""A stored inverted index: BM25 without reading the documents again, and without the common terms' lists.

Three tables under one path, each in generations, so that documents are added without touching what is there:

* `forward` (doc_id, dl, tf: a map of terms to counts), a document a row;
* `terms` (term, df, and the bound's max_tf and min_dl), a term a row and generation;
* `lists` (bucket, term, level, block, docs, max_tf, min_dl), a term's documents in blocks of about BLOCK, grouped by how much a document can
  score (`level`), in folders by a hash of the term. No block grows with a term's documents.

A search is exact and stops early, by bounds. The score of a term grows with tf and falls with dl, so max_tf and min_dl bound it, for a
term and for a block. The documents of a question's rarest terms are scored first, and the k-th best of them is a floor for its
results. The terms with the least bounds whose sum stays below the floor cannot bring a document in alone, so their lists are not read; blocks of the others are
read only where the block's bound, with the other terms' bounds, reaches the floor. The documents left for any question are scored from `forward`, by blocks of questions.

Scores and their order are those of `retrieval.bm25`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.files import kept
from . import blocks
from .retrieval import B, FLOOR, K1, scorer, top

BLOCK = 1024
BUCKETS = 16
LEVELS = 8
SEED = 4  # documents scored first, times k, at least where there are so many
NEAR = 2e-6  # scores are rounded to six places


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def exists(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/forward")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def append(index: Index, docs: DataFrame, block: int = BLOCK) -> int:
    """Index the documents (doc_id, text) whose ids the index doesn't have; returns how many there were. A generation is written once, whole."""
    spark = index.spark
    new = docs.where(F.col("doc_id").isNotNull())
    generation = 0
    if index.exists():
        new = new.join(index.table("forward").select("doc_id"), "doc_id", "left_anti")
        generation = index.table("forward").agg(F.max("generation")).first()[0] + 1
    words = new.select("doc_id", tokens(F.col("text")).alias("w"))
    into = lambda name: f"{index.path}/{name}/generation={generation}"
    words.mapInArrow(_counted, "doc_id bigint, dl int, tf map<string,bigint>").write.mode("overwrite").parquet(into("forward"))
    stored = spark.read.parquet(into("forward"))
    counted = stored.select("doc_id", "dl", F.explode("tf").alias("term", "tf"))
    mean = stored.agg(F.avg("dl").alias("avgdl"), F.count(F.lit(1)).alias("n")).first()
    if not mean["n"]:
        return 0
    terms = kept(counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl")))
    terms.write.mode("overwrite").parquet(into("terms"))
    level = F.least(F.lit(LEVELS - 1), F.floor(LEVELS * weight(F.col("tf"), F.col("dl"), F.lit(mean["avgdl"])) / (K1 + 1))).cast("int")
    parts = F.ceil(F.col("df") / block)
    rows = counted.join(terms.select("term", "df"), "term").withColumns({"level": level, "block": F.pmod(F.xxhash64("doc_id"), parts).cast("int"), "bucket": bucket(index.buckets)})
    lists = rows.groupBy("bucket", "term", "level", "block").agg(F.collect_list("doc_id").alias("docs"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    lists = lists.repartitionByRange("bucket", "term", "level", "block").sortWithinPartitions("bucket", "term", "level")
    lists.write.mode("overwrite").partitionBy("bucket").parquet(into("lists"))
    return mean["n"]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, w) with the number of their words and how often they have each: no shuffle."""
    for batch in batches:
        lists = batch.column(1)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        n = max(1, len(words.dictionary))
        pairs, times = np.unique(np.repeat(np.arange(len(lengths)), lengths) * n + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
        ends = np.searchsorted(pairs, np.arange(len(lengths) + 1) * n)
        tf = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), words.dictionary.take(pa.array(pairs % n)), pa.array(times, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int32()), tf], names=["doc_id", "dl", "tf"])


def asked_terms(index: Index, questions: DataFrame) -> DataFrame:
    """(item_id, term, qf, df, w, bound, avgdl) of the terms that the index has; w: qf times idf."""
    corpus = index.table("forward").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))  # one row
    terms = index.table("terms").groupBy("term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))
    raw = terms.crossJoin(F.broadcast(corpus)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    q = questions.select("item_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    own = q.join(raw, "term").crossJoin(F.broadcast(mean))
    w = F.col("qf") * F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw"))
    own = own.withColumn("w", w)
    bound = F.greatest(F.lit(0.0), F.col("w")) * weight(F.col("max_tf"), F.col("min_dl"), F.col("avgdl"))
    return kept(own.select("item_id", "term", "qf", "df", "w", bound.alias("bound"), "avgdl"))


def _lists(index: Index, terms: DataFrame) -> DataFrame:
    """The lists of `terms` (column term), of their folders only."""
    folders = [r[0] for r in terms.select(bucket(index.buckets).alias("b")).distinct().collect()]  # at most `buckets` numbers
    return index.table("lists").where(F.col("bucket").isin(folders)) if folders else index.table("lists").where(F.lit(False))


def scored(index: Index, pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """(item_id, doc_id, score) of distinct pairs (item_id, doc_id), from the documents' own counts."""
    asked = terms.groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("terms"), F.first("avgdl").alias("avgdl"))  # one question's terms
    rows = pairs.join(index.table("forward").select("doc_id", "dl", "tf"), "doc_id").join(asked, "item_id")
    each = F.transform("terms", lambda t: F.coalesce(t["w"] * weight(F.try_element_at(F.col("tf"), t["term"]), F.col("dl"), F.col("avgdl")), F.lit(0.0)))
    return rows.select("item_id", "doc_id", F.round(F.aggregate(each, F.lit(0.0), lambda s, x: s + x), 6).alias("score"))


def needed_blocks(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """(item_id, generation, term, level, block, docs): blocks of lists with a document that may be among the k best of a question with these `asked_terms`."""
    by_df = Window.partitionBy("item_id").orderBy("df", "term")  # of one question's terms
    before = F.coalesce(F.sum("df").over(by_df.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rare = terms.withColumn("before", before).where(F.col("before") < SEED * k).select("item_id", "term")
    held = lambda some: _lists(index, some).join(some, "term")
    first = held(rare).select("item_id", F.explode("docs").alias("doc_id")).distinct()
    seed = top(scored(index, first, terms), "score", k)
    floors = kept(seed.groupBy("item_id").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("floor")))

    by_bound = Window.partitionBy("item_id").orderBy("bound", "term")
    every = Window.partitionBy("item_id")
    left = terms.join(floors, "item_id", "left").withColumns({"upto": F.sum("bound").over(by_bound), "all": F.sum("bound").over(every)})
    needed = left.where(F.col("floor").isNull() | (F.col("upto") >= F.col("floor") - NEAR))
    needed = kept(needed.select("item_id", "term", "w", "avgdl", "floor", (F.col("all") - F.col("bound")).alias("others")))
    blocks = held(needed)
    reach = F.greatest(F.lit(0.0), F.col("w")) * weight(F.col("max_tf"), F.col("min_dl"), F.col("avgdl")) + F.col("others")
    return blocks.where(F.col("floor").isNull() | (reach >= F.col("floor") - NEAR)).select("item_id", "generation", "term", "level", "block", "docs")


def candidates(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id): the documents that may be among the k best of a question with these `asked_terms`."""
    return needed_blocks(index, terms, k).select("item_id", F.explode("docs").alias("doc_id")).distinct()


def search(index: Index, questions: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, score, rank): the k best documents of each question (item_id, text) among those that share a term with it."""
    terms = asked_terms(index, questions)
    some = terms.agg(F.first("avgdl")).first()[0]
    need = needed_blocks(index, terms, k).groupBy("generation", "term", "level", "block").agg(F.first("docs").alias("docs"))
    size = need.agg(F.coalesce(F.sum(F.size("docs")), F.lit(0))).first()[0]
    forward = index.table("forward")
    if size < forward.count():  # else the lists name about every document
        forward = forward.join(need.select(F.explode("docs").alias("doc_id")).distinct(), "doc_id", "left_semi")
    asked = terms.groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("x")).select("item_id", F.col("x.term").alias("terms"), F.col("x.w").alias("weights"))  # one question's terms
    docs = forward.select("doc_id", F.map_keys("tf").alias("words"), F.map_values("tf").alias("times"))
    return top(blocks.best(docs, asked, scorer(some), k), "score", k)


def resumed(questions: DataFrame, stored: DataFrame, find) -> DataFrame:
    """Stored rows (with item_id and rrf) and those that `find` gives for the questions without a stored score."""
    done = stored.where(F.col("rrf").isNotNull())
    new = find(questions.join(done.select("item_id").distinct(), "item_id", "left_anti"))
    return done.unionByName(new.select(*stored.columns))
