"""Gold passages: resolving texts to chunks by containment or token overlap, and widening to neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_set
from . import retrieval


def overlaps(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_id, doc_id, overlap): share of a question's token set (column s) in a chunk's, by an equi-join on tokens."""
    q = questions.select("item_id", F.size("s").alias("n"), F.explode("s").alias("t"))
    c = chunks.select("doc_id", F.explode("s").alias("t"))
    return q.join(c, "t").groupBy("item_id", "doc_id", "n").agg(F.count(F.lit(1)).alias("c")).select("item_id", "doc_id", (F.col("c") / F.col("n")).alias("overlap"))


def best_chunk(scored: DataFrame, least: float = 0.0) -> DataFrame:
    """The chunk with the largest overlap above `least`, first on ties."""
    w = Window.partitionBy("item_id").orderBy(F.desc("overlap"), "doc_id")
    return scored.where(F.col("overlap") > least).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def resolved(scored: DataFrame, least: float = 0.3) -> DataFrame:
    """All chunks from `least` on; where there is none, the single best above zero."""
    w = Window.partitionBy("item_id").orderBy(F.desc("overlap"), "doc_id")
    rows = scored.where("overlap > 0").withColumn("rank", F.row_number().over(w))
    return rows.where((F.col("overlap") >= least) | (F.col("rank") == 1))


def expanded(best: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Score of the best chunk alone, with its next, its previous, and both: the highest wins, the shorter on ties.

    chunks: doc_id, s (token set), prev_id, next_id. A chunk that covers everything is not widened.
    """
    c = chunks.select("doc_id", "s", "prev_id", "next_id")
    side = lambda name: chunks.select(F.col("doc_id").alias(f"{name}_id"), F.col("s").alias(f"{name}_s"))
    rows = best.select("item_id", "doc_id").join(questions.select("item_id", F.col("s").alias("q")), "item_id").join(c, "doc_id")
    rows = rows.join(side("prev"), "prev_id", "left").join(side("next"), "next_id", "left")
    empty = F.array().cast("array<string>")
    p, n = F.coalesce("prev_s", empty), F.coalesce("next_s", empty)
    share = lambda s: F.round(F.size(F.array_intersect("q", s)) / F.size("q"), 6)
    option = lambda name, s, order: F.struct((-share(s)).alias("score"), F.lit(order).alias("order"), F.lit(name).alias("name"))
    single = share(F.col("s"))
    options = F.array(option("single", F.col("s"), 0), option("forward", F.array_union("s", n), 1), option("backward", F.array_union("s", p), 2), option("both", F.array_union(F.array_union("s", n), p), 3))
    choice = F.when(single >= 1, option("single", F.col("s"), 0)).otherwise(F.array_min(options))
    out = rows.select("item_id", "doc_id", choice.alias("x"))
    score = -F.col("x.score")
    return out.select("item_id", "doc_id", F.col("x.name").alias("how"), score.alias("score"), (F.round(100 * score) >= 80).alias("accepted"))


def finder(questions: DataFrame, chunks: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, doc_id, overlap, accepted): the chunk that holds most of an expected answer's tokens, the first on ties.

    questions: item_id, expected, language, article, embedding; chunks: doc_id, language, article_number, text, embedding. A question
    with an article is held against the chunks of that article and language, one without against the k nearest of its language.
    """
    named = F.trim(F.coalesce(F.col("article").cast("string"), F.lit(""))) != ""
    q = questions.withColumn("named", named)
    by_article = q.where("named").select("item_id", "language", F.trim(F.col("article").cast("string")).alias("article_number")).join(chunks.select("doc_id", "language", "article_number"), ["language", "article_number"])
    pairs = by_article.select("item_id", "doc_id")
    rest = q.where(~F.col("named"))
    for row in rest.select("language").distinct().collect():  # languages
        mine = F.col("language") == row["language"]
        pairs = pairs.unionByName(retrieval.dense(chunks, rest.where(mine), k, mine, same=True).select("item_id", "doc_id"))
    expected = questions.select("item_id", token_set(F.col("expected")).alias("_e"))
    scored = pairs.join(chunks.select("doc_id", token_set(F.col("text")).alias("_c")), "doc_id").join(expected, "item_id")
    share = F.when(F.size("_e") > 0, F.round(F.size(F.array_intersect("_e", "_c")) / F.size("_e"), 6)).otherwise(0.0)
    w = Window.partitionBy("item_id").orderBy(F.desc("overlap"), "doc_id")
    best = scored.select("item_id", "doc_id", share.alias("overlap")).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return best.withColumn("accepted", F.round(100 * F.col("overlap")) >= 80)
