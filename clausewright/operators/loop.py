"""The question loop as a shrinking table: retrieve, answer, reflect, rewrite, and again for what is not grounded.

Answering, reflecting and rewriting are Column functions that a caller may replace by UDFs around a model; the ones here
are deterministic stand-ins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import share_of_first
from ..functions.text import tokens
from ..sources.files import kept


def reflected(reply: Column) -> Column:
    """Grounded only if the first word of the reply is exactly that; anything else, also an error, is not."""
    first = F.get(F.split(F.upper(F.trim(F.coalesce(reply, F.lit("")))), r"\s+"), F.lit(0))
    return F.coalesce(first == "GROUNDED", F.lit(False))


def rewritten(query: Column, proposal: Column, attempt: Column, headers: Column) -> Column:
    """A proposal counts from the second attempt on, with context, and with 1 to 399 characters."""
    n = F.length(F.coalesce(proposal, F.lit("")))
    return F.when((attempt > 1) & (F.size(headers) > 0) & n.between(1, 399), proposal).otherwise(query)


def stand_in_answer(question: Column, chunk: Column) -> Column:
    return F.substr(chunk, F.lit(1), F.lit(400))


def stand_in_reply(question: Column, answer: Column) -> Column:
    return F.when(share_of_first(question, answer) >= 0.5, "GROUNDED").otherwise("UNGROUNDED")


def stand_in_proposal(question: Column) -> Column:
    """The question without its last word."""
    return F.regexp_replace(question, r"\s*\S+\s*$", "")


def run(
    questions: DataFrame,
    retrieve: Callable[[DataFrame], DataFrame],
    max_attempts: int = 3,
    answer: Callable[[Column, Column], Column] = stand_in_answer,
    reply: Callable[[Column, Column], Column] = stand_in_reply,
    propose: Callable[[Column], Column] = stand_in_proposal,
) -> DataFrame:
    """(item_id, question, doc_id, answer, attempts, grounded). `retrieve` maps (item_id, text) to its best (item_id, doc_id, chunk)."""
    open_ = questions.select("item_id", F.col("text").alias("question"), F.col("text"))
    done = None
    for attempt in range(1, max_attempts + 1):
        found = open_.join(retrieve(open_.select("item_id", "text")), "item_id", "left")
        said = answer(F.col("question"), F.coalesce("chunk", F.lit("")))
        tried = found.withColumn("answer", said).withColumn("grounded", F.col("chunk").isNotNull() & reflected(reply(F.col("question"), F.col("answer"))))
        tried = tried.withColumn("attempts", F.lit(attempt))
        if attempt < max_attempts:
            tried = kept(tried)  # read by the results and by the next attempt
        out = tried if attempt == max_attempts else tried.where("grounded")
        out = out.select("item_id", "question", "doc_id", "answer", "attempts", "grounded")
        done = out if done is None else done.unionByName(out)
        headers = F.array(F.col("doc_id").cast("string"))
        text = rewritten(F.col("text"), propose(F.col("text")), F.lit(attempt + 1), headers)
        open_ = tried.where("NOT grounded").select("item_id", "question", text.alias("text"))
    return done


def batches(questions: DataFrame, size: int = 10) -> DataFrame:
    """(batch, prompt) of up to `size` questions, numbered, for a rewriting model."""
    from pyspark.sql import Window

    # numbered within hash buckets, so no task holds all questions
    bucket = F.pmod(F.xxhash64("item_id"), F.lit(64))
    n = F.row_number().over(Window.partitionBy("bucket").orderBy("item_id")) - 1
    rows = questions.withColumn("bucket", bucket).withColumn("n", n)
    rows = rows.withColumn("batch", F.concat_ws("-", "bucket", F.floor(F.col("n") / size)))
    line = F.concat((F.col("n") % size + 1).cast("string"), F.lit(". "), F.substr("text", F.lit(1), F.lit(500)))
    return rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("x")).select("batch", F.size("x").alias("n_questions"), F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias("prompt"))


def needs_translation(lang: Column) -> Column:
    return ~lang.isin("en", "fr")


def scored_text(answer: Column, translated: Column) -> Column:
    """Lexical metrics read the translation where there is one."""
    return F.coalesce(F.nullif(translated, F.lit("")), answer)


def term_count(c: Column) -> Column:
    return F.size(tokens(c))
