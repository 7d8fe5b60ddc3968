"""Summaries: grouped means, system blocks, matched pairs, agreement, corpus statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import blank

PHRASE_BYTES = 1 << 25  # characters of an automaton's phrases


def exact_mean(value: Column) -> Column:
    """The mean from an exact sum of up to ten decimal places, so that it doesn't depend on the order of the rows; values that have no such form are summed as they are."""
    decimal = value.try_cast("decimal(28,10)")
    return F.when(F.count(decimal) == F.count(value), F.sum(decimal).cast("double") / F.count(value)).otherwise(F.avg(value))


def group_means(df: DataFrame, by: str, metric: str) -> DataFrame:
    """Mean by group without blank groups and empty means."""
    rows = df.where(~blank(F.col(by))).groupBy(by).agg(F.round(F.avg(metric), 4).alias("mean"))
    return rows.where("mean IS NOT NULL")


def group_means_labelled(df: DataFrame, by: str, metric: str) -> DataFrame:
    """Mean by group; blank groups are Unknown, empty means 0."""
    name = F.when(blank(F.col(by)), "Unknown").otherwise(F.col(by))
    return df.groupBy(name.alias(by)).agg(F.coalesce(F.round(F.avg(metric), 4), F.lit(0.0)).alias("mean"))


def unjudged(*scores: Column) -> list[Column]:
    """All judge scores null where every one is zero or missing."""
    none = F.lit(True)
    for s in scores:
        none = none & (F.coalesce(s, F.lit(0.0)) == 0)
    return [F.when(~none, s) for s in scores]


def latency_block(df: DataFrame, by: str, latency: str, limit: float = 60.0) -> DataFrame:
    """Rows, mean, exact median and 95th percentile, peak, and the share strictly under `limit` in percent."""
    x = F.col(latency)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(x), 2).alias("mean"),
        F.round(F.percentile(x, 0.5), 2).alias("median"),
        F.round(F.percentile(x, 0.95), 2).alias("p95"),
        F.max(x).alias("peak"),
        F.round(100 * F.avg((x < limit).cast("double")), 1).alias("under"),
    )


def box(df: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles and the upper whisker: the largest value within 1.5 interquartile ranges of the third quartile."""
    from .systems import quantiles  # which takes `unjudged` from here

    quartiles = quantiles(df, [by], value, {"q1": 0.25, "q3": 0.75}).drop("n")  # one row a group
    near = df.join(F.broadcast(quartiles), by).where(F.col(value) <= F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return near.groupBy(by, "q1", "q3").agg(F.max(value).alias("whisker")).select(by, F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3"), "whisker")


def matched(df: DataFrame, key: str, system: str, a: str, b: str, value: str) -> DataFrame:
    """(key, a, b): keys that both systems have a value for."""
    side = lambda s, name: df.where((F.col(system) == s) & F.col(value).isNotNull()).select(key, F.col(value).alias(name))
    return side(a, "a").join(side(b, "b"), key)


def paired(df: DataFrame, total: int) -> DataFrame:
    """Means of both sides of matched pairs, their difference, median difference and coverage in percent of `total`."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("a"), 4).alias("mean_a"),
        F.round(F.avg("b"), 4).alias("mean_b"),
        F.round(F.avg(F.col("b") - F.col("a")), 4).alias("delta"),
        F.round(F.percentile(F.col("b") - F.col("a"), 0.5), 4).alias("median_delta"),
        F.round(100 * F.count(F.lit(1)) / F.lit(float(total)), 1).alias("coverage"),
    )


def guarded(df: DataFrame, by: str, value: str, least: float = 0.9) -> DataFrame:
    """Mean by group where at least `least` of the rows have a value; else PARTIAL."""
    rows = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("scored"), F.round(F.avg(value), 4).alias("mean"))
    enough = F.col("scored") >= least * F.col("n")
    return rows.select(by, "n", "scored", F.when(enough, F.col("mean")).alias("mean"), F.when(enough, "OK").otherwise("PARTIAL").alias("status"))


def agreement(df: DataFrame, a: str, b: str, threshold: float = 0.75) -> DataFrame:
    """Exact agreement and Cohen's kappa of two label columns: null without pairs, 1 where chance alone agrees fully."""
    counts = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("c"))  # labels x labels
    total = counts.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    left = counts.groupBy(F.col("a").alias("l")).agg(F.sum("c").alias("x"))
    right = counts.groupBy(F.col("b").alias("l")).agg(F.sum("c").alias("y"))
    chance = left.join(right, "l").agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("xy"))
    rows = total.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("xy") / (F.col("n").cast("double") * F.col("n"))
    kappa = F.when(F.col("n").isNull(), None).when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe))
    return rows.select(F.coalesce("n", F.lit(0)).alias("n"), F.round(po, 4).alias("exact"), F.round(kappa, 4).alias("kappa"), F.coalesce(kappa >= threshold, F.lit(False)).alias("acceptable"))


def corpus_stats(chunks: DataFrame, by: str) -> DataFrame:
    """Distinct articles and clauses (the unidentified 0 left out), chunks, tokens and appendix chunks."""
    named = lambda c: F.countDistinct(F.when(F.col(c) != "0", F.col(c)))
    n = F.col("tokens")
    return chunks.groupBy(by).agg(
        named("article").alias("articles"),
        named("clause").alias("clauses"),
        F.count(F.lit(1)).alias("chunks"),
        F.round(F.avg(n)).cast("bigint").alias("avg_tokens"),
        F.min(n).cast("bigint").alias("min_tokens"),
        F.max(n).cast("bigint").alias("max_tokens"),
        F.sum(n).cast("bigint").alias("total_tokens"),
        F.count_if(F.col("text").rlike("(?i)appendix|annexe|license")).alias("appendix"),
    )


def transposed(stats: DataFrame, by: str, values: list[str]) -> DataFrame:
    """One row a property, one column a value of `by`."""
    long = stats.unpivot([by], [c for c in stats.columns if c != by], "property", "value")
    return long.groupBy("property").pivot(by, values).agg(F.first("value"))


def error_class(cited: Column, same_edition: Column, other_edition: Column) -> Column:
    """Exclusive classes of unscored answers; a match in the same edition wins."""
    return F.when(F.size(cited) == 0, "none").when(F.arrays_overlap(cited, same_edition), "same").when(F.arrays_overlap(cited, other_edition), "other").otherwise("unknown")


def phrase_hits(texts: DataFrame, phrases: DataFrame, limit: int = PHRASE_BYTES) -> DataFrame:
    """(doc_id, word) for each of the phrases (word) that a text (doc_id, text) contains, any number of them.

    Phrases are one pattern automaton, which a task lays over its texts character by character, once; where they have more than `limit` characters they are
    dealt to several automata by hash, each with a pass of its own.
    """
    phrases = phrases.select("word").where("word <> ''").distinct()
    size = phrases.agg(F.sum(F.length("word"))).first()[0] or 0
    blocks = max(1, -(-size // limit))
    sc = texts.sparkSession.sparkContext

    def found(block: int) -> DataFrame:
        words = [r["word"] for r in phrases.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == block).collect()]  # of about `limit` characters
        sent = sc.broadcast(words)
        kind = texts.schema["doc_id"].dataType.simpleString()
        return texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lambda it: _phrases(it, sent), f"doc_id {kind}, word string")

    out = found(0)
    for block in range(1, blocks):
        out = out.unionByName(found(block))
    return out


def _phrases(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    import ahocorasick

    words = ahocorasick.Automaton()
    for w in sent.value:
        words.add_word(w, w)
    if sent.value:
        words.make_automaton()
    for batch in batches:
        hits = [sorted({w for _, w in words.iter(t)}) if sent.value else [] for t in batch.column(1).to_pylist()]
        at = np.repeat(np.arange(batch.num_rows), [len(h) for h in hits])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([w for h in hits for w in h], pa.string())], names=["doc_id", "word"])


def keyword_category(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(doc_id, category, score): phrases count 2, words 1; the highest sum wins, ties alphabetically.

    Single words meet texts by token; phrases are found in the text by `phrase_hits`, and meet their categories by a join.
    """
    single, phrases = keywords.where("NOT contains(word, ' ')"), keywords.where("contains(word, ' ')")
    hits = texts.select("doc_id", F.explode(F.array_distinct("tokens")).alias("word")).join(single, "word").select("doc_id", "category", F.lit(1).alias("w"))
    hits = hits.unionByName(phrase_hits(texts, phrases).join(phrases, "word").select("doc_id", "category", F.lit(2).alias("w")))
    sums = hits.groupBy("doc_id", "category").agg(F.sum("w").alias("score"))
    best = sums.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "category")).alias("b"))
    return best.select("doc_id", F.col("b.category").alias("category"), (-F.col("b.s")).alias("score"))
