"""Evaluation rows: gold resolution, context, cross-lingual scoring, selective recomputation and question synthesis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.predicates import answered, blank, filled, zero_or_blank


def answered_pairs(gold: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Gold rows that have a usable answer, in the gold table's columns and the ledger's."""
    return gold.join(ledger.where(answered(F.col("answer"))), key)


def gold_ids(first: Column, second: Column, by_text: Column) -> Column:
    """The first list that is not empty: the id column, another id column, ids found by text."""
    return F.when(F.size(first) > 0, first).when(F.size(second) > 0, second).otherwise(F.coalesce(by_text, F.array().cast("array<string>")))


def recomputed(previous: Column, fresh: Column, force: bool = False) -> Column:
    """A stored metric stays unless it is missing or zero, or all are to be made anew."""
    return fresh if force else F.when(zero_or_blank(previous), fresh).otherwise(previous.try_cast("double"))


def cross_lingual(answer: Column, translated: Column, native_citation: Column, translated_citation: Column) -> tuple[Column, Column]:
    """The text that lexical metrics read, and the better of both citation scores."""
    return filled(translated, answer), F.greatest(native_citation, translated_citation)


def seeded(target: DataFrame, single: DataFrame, other: DataFrame, key: str, judge: list[str]) -> DataFrame:
    """Rows of a single-pass arm; judge cells are emptied where two ledgers disagree on the answer but for white space."""
    a = single.select(key, F.col("answer").alias("_a"), *judge)
    b = other.select(key, F.col("answer").alias("_b"))
    rows = target.select(key).join(a, key).join(b, key, "left")
    same = text.collapsed(F.col("_a")) == text.collapsed(F.col("_b"))
    return rows.select(key, F.col("_a").alias("answer"), *(F.when(same, F.col(c)).alias(c) for c in judge), F.coalesce(same, F.lit(False)).alias("same"))


def dashboard_rows(df: DataFrame, equal: dict[str, str], contains: dict[str, str]) -> DataFrame:
    """Rows that pass every filter: categories by equality, other columns by substring, both without regard to case."""
    for c, v in equal.items():
        df = df.where(F.lower(F.col(c).cast("string")) == v.lower())
    for c, v in contains.items():
        df = df.where(F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(v.lower())))
    return df


def pick_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate that is a column, whatever its case."""
    names = {c.lower(): c for c in df.columns}
    return next((names[c.lower()] for c in candidates if c.lower() in names), None)


def normalised(answer: Column, top_id: Column, recall: Column, rank: Column) -> Column:
    """Whether a row counts: an answer, and a retrieved source (or, without its id, a hit)."""
    return ~blank(answer) & (~blank(top_id) | (F.coalesce(recall, F.lit(0.0)) > 0) | (F.coalesce(rank, F.lit(0.0)) > 0))


def routed(key: DataFrame, sheets: DataFrame) -> DataFrame:
    """Annotations (item_id, annotator, judgment, value) as one row for a question and system, a column for each judgment and annotator."""
    rows = sheets.join(key, "item_id").withColumn("name", F.concat_ws("_", "judgment", "annotator"))
    return rows.groupBy("question_id", "system").pivot("name").agg(F.first("value"))


def citing_chunks(chunks: DataFrame, citations: DataFrame) -> DataFrame:
    """(edition, n_chunks, n_questions) of chunks that hold a cited clause; chunks have an array of clauses, citations one each."""
    index = chunks.select("chunk_id", "edition", F.explode(F.array_distinct("clauses")).alias("clause"))
    return index.join(citations, "clause").groupBy("edition").agg(F.countDistinct("chunk_id").alias("n_chunks"), F.countDistinct("question_id").alias("n_questions"))


def question_candidates(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n question and answer pairs a language: sentences, or pairs of adjacent ones, of fitting length, in hash order and without repeats."""
    parts = docs.select("doc_id", "lang", text.sentences(F.col("text")).alias("s"))
    singles = F.filter("s", lambda x: F.length(x).between(50, 300))
    pairs = F.filter(text.adjacent(F.col("s")), lambda x: F.length(x).between(60, 420))
    rows = parts.select("doc_id", "lang", F.explode(F.array_distinct(F.concat(singles, pairs))).alias("answer"))
    w = Window.partitionBy("lang").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "answer")), "doc_id")
    unique = rows.groupBy("lang", "answer").agg(F.min("doc_id").alias("doc_id"))
    kept = unique.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    question = F.concat(F.when(F.col("lang") == "fr", "Que dit le texte sur ").otherwise("What does the text say about "), F.lower(F.substring_index("answer", " ", 3)), F.lit("?"))
    return kept.select("doc_id", "lang", question.alias("question"), "answer", text.difficulty(F.col("answer")).alias("difficulty"))


def paragraphs(lines: Column, most: int = 8, least: int = 80) -> Column:
    """Paragraphs of an array of lines: a blank line, a heading or `most` lines end one; those over `least` characters stay."""
    state = "struct<cur:array<string>,out:array<string>>"
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("cur"), none.alias("out")).cast(state)

    def done(acc: Column) -> Column:
        whole = F.array_join(acc["cur"], " ")
        return F.when(F.length(whole) > least, F.concat(acc["out"], F.array(whole))).otherwise(acc["out"])

    def step(acc: Column, line: Column) -> Column:
        bare = F.trim(line)
        stop = (bare == "") | bare.rlike(r"^(?:ARTICLE|Article)\s+\d+")
        grown = F.concat(acc["cur"], F.array(bare))
        full = F.struct(none.alias("cur"), done(F.struct(grown.alias("cur"), acc["out"].alias("out"))).alias("out")).cast(state)
        return F.when(stop, F.struct(none.alias("cur"), done(acc).alias("out")).cast(state)).when(F.size(grown) >= most, full).otherwise(F.struct(grown.alias("cur"), acc["out"].alias("out")).cast(state))

    return F.aggregate(lines, start, step, done)


def telemetry(latency: Column, first: Column, mode: Column) -> Column:
    """The telemetry struct of a row; a failed row has zeros and the mode."""
    return F.struct(F.coalesce(F.round(latency, 2), F.lit(0.0)).alias("e2e_latency_s"), F.coalesce(F.round(first, 2), F.lit(0.0)).alias("ttft_s"), mode.alias("mode"), latency.isNull().alias("failed"))
