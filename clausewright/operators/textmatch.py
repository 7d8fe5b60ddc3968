"""Joins of texts with texts: containment and token overlap, without a nested loop over texts.

Both count the queries' words in the chunks by blocks of queries (`blocks`): one pass over the chunks for a block, and no row for a pair that only shares words.

Containment. Words that stand between other characters of a query are whole words of every text that contains it. So only chunks with all of a query's
inner words are looked into; a query that has none is held against every chunk.

Overlap: the share of a query's token set that a chunk has. `overlap_candidates` finds pairs by an equi-join instead, where only rare tokens matter: to reach
`need` of n tokens a chunk has to have one of any n - need + 1 of them, so the n - need + 1 tokens that the fewest chunks hold are joined.

Texts are compared in lower case, queries without the white space around them; null, empty and blank queries match nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WORD, token_set
from ..sources.files import kept
from . import blocks

SALTS = 8
_INNER = rf"(?<=[^\p{{L}}\p{{N}}_]){WORD}(?=[^\p{{L}}\p{{N}}_])"


def plain(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def bare(text: Column) -> Column:
    return F.regexp_replace(plain(text), r"^\s+|\s+$", "")


def _words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _salted(large: DataFrame, small: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join in which one key may hold a large share of `large`."""
    each = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return large.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(each, [key, "_salt"]).drop("_salt")


def _held(chunks: DataFrame, keys: Column, asked: DataFrame) -> DataFrame:
    """(doc_id, key) of the keys that are asked for."""
    return chunks.select("doc_id", F.explode(keys).alias("key")).join(asked, "key", "left_semi")


def containing(queries: DataFrame, chunks: DataFrame, exact: bool = False) -> DataFrame:
    """(item_id, doc_id) of every chunk (doc_id, text) that contains the text of a query (item_id, text); `exact`: as they are written."""
    q, c = (F.coalesce("text", F.lit("")),) * 2 if exact else (bare(F.col("text")), plain(F.col("text")))
    q, c = queries.select("item_id", q.alias("text")), chunks.select("doc_id", c.alias("text"))
    asked = q.where("text <> ''").select("item_id", F.array_distinct(_words(F.col("text"), _INNER)).alias("terms"), "text")
    return blocks.containing(c.select("doc_id", _words(F.col("text"), WORD).alias("words"), "text"), asked)


def overlap_candidates(queries: DataFrame, chunks: DataFrame, least: float, strict: bool = False) -> DataFrame:
    """(item_id, doc_id) of chunks with one of the rare tokens of a query; queries and chunks have a token set `s`."""
    tokens = queries.select("item_id", F.size("s").alias("n"), F.explode("s").alias("key"))
    held = _held(chunks, F.col("s"), tokens.select("key").distinct())
    counts = held.groupBy("key").agg(F.count(F.lit(1)).alias("chunks"))
    share = F.col("n") * F.lit(float(least))
    need = F.greatest(F.lit(1), (F.floor(share + 1e-9) + 1) if strict else F.ceil(share - 1e-9))
    rarest = Window.partitionBy("item_id").orderBy("chunks", "key")  # of one query's tokens
    # a token that no chunk has is the rarest of all, and still one that a chunk lacks
    ranked = tokens.join(counts, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0))).withColumn("r", F.row_number().over(rarest))
    rare = ranked.where((F.col("r") <= F.col("n") - need + 1) & (F.col("chunks") > 0)).select("item_id", "key")
    return _salted(held, rare, "key", "doc_id").select("item_id", "doc_id").distinct()


def _share(counts: np.ndarray, weights: np.ndarray, lengths: np.ndarray, block: blocks.Block) -> tuple[np.ndarray, np.ndarray]:
    """The share of a question's tokens that a document has, and whether it has any."""
    common = (counts > 0).astype(np.float64) @ weights
    return common / np.maximum(block.sizes, 1), common > 0


def _sets(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.coalesce("s", F.array().cast("array<string>")).alias("terms"))


def overlapping(queries: DataFrame, chunks: DataFrame, least: float, strict: bool = False) -> DataFrame:
    """(item_id, doc_id, overlap) of all chunks (doc_id, s) that have at least (`strict`: more than) the share `least` of a query's tokens (item_id, s), and any."""

    def score(counts: np.ndarray, weights: np.ndarray, lengths: np.ndarray, block: blocks.Block) -> tuple[np.ndarray, np.ndarray]:
        share, some = _share(counts, weights, lengths, block)
        return share, some & ((share > least) if strict else (share >= least))

    return blocks.every(_sets(chunks, "doc_id"), _sets(queries, "item_id"), score).withColumnRenamed("score", "overlap")


def first(scored: DataFrame) -> DataFrame:
    """The largest overlap of each query, the first chunk on ties."""
    w = Window.partitionBy("item_id").orderBy(F.desc("overlap"), "doc_id")
    return scored.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def best(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_id, doc_id, overlap): the chunk with the largest overlap above zero."""
    return first(blocks.best(_sets(chunks, "doc_id"), _sets(queries, "item_id"), _share, 1).withColumnRenamed("score", "overlap"))


def resolved(queries: DataFrame, chunks: DataFrame, least: float = 0.3) -> DataFrame:
    """(item_id, doc_id, overlap, rank): all chunks from `least` on; where there is none, the single best above zero."""
    found = overlapping(queries, chunks, least)
    left = kept(queries.select("item_id", "s").join(found.select("item_id").distinct(), "item_id", "left_anti"))
    both = found if left.isEmpty() else found.unionByName(best(left, chunks))
    w = Window.partitionBy("item_id").orderBy(F.desc("overlap"), "doc_id")
    return both.withColumn("rank", F.row_number().over(w))


def repaired(queries: DataFrame, chunks: DataFrame, least: float = 0.5) -> DataFrame:
    """(item_id, doc_id, how, overlap): the first chunk that contains the text of a query; where none does, the best overlap above `least`."""
    whole = kept(containing(queries, chunks).groupBy("item_id").agg(F.min("doc_id").alias("doc_id")))
    left = queries.where(bare(F.col("text")) != "").join(whole, "item_id", "left_anti").select("item_id", token_set(bare(F.col("text"))).alias("s")).where(F.size("s") > 0)
    near = best(kept(left), chunks.select("doc_id", token_set(F.col("text")).alias("s"))).where(F.col("overlap") > least)
    exact = whole.select("item_id", "doc_id", F.lit("contained").alias("how"), F.lit(1.0).alias("overlap"))
    return exact.unionByName(near.select("item_id", "doc_id", F.lit("overlap").alias("how"), "overlap"))


def rescued(questions: DataFrame, sources: DataFrame, chunks: DataFrame, lost: Column) -> DataFrame:
    """`questions` (item_id, got) with their retrieved ids resolved anew by the sources' texts (item_id, rank, text) where `lost` is true.

    Sources that resolve to no chunk leave the list; a question none of whose sources does keeps what it had.
    """
    wanted = sources.join(questions.where(lost).select("item_id"), "item_id", "left_semi")
    wanted = kept(wanted.select("item_id", "rank", "text", F.monotonically_increasing_id().alias("n")))
    ids = repaired(wanted.select(F.col("n").alias("item_id"), "text"), chunks).select(F.col("item_id").alias("n"), "doc_id").join(wanted.select("n", "item_id", "rank"), "n")
    lists = ids.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("x")).select("item_id", F.transform("x", lambda v: v["doc_id"]).alias("_new"))
    rows = questions.join(lists, "item_id", "left")
    return rows.withColumn("got", F.coalesce("_new", "got")).drop("_new")
