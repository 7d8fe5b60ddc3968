"""Which rows of a ledger an interrupted run may leave out: the gates of generation, regeneration and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import TRUE_ONLY, number, truthy

#: What telemetry cells hold where nothing was measured, and the answer of a failed row.
UNMEASURED = ("", "nan", "none", "nat")
FAILED = "ERROR"
GENERATION, REGENERATION, EVALUATION = "generation", "regeneration", "evaluation"


def _bare(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def usable(answer: Column) -> Column:
    """An answer that is there and isn't the mark of a failure, in that spelling."""
    return ~_bare(answer).isin("", FAILED)


def generated(answer: Column, grounded: Column, mode: str = "local", max_retries: int = 3) -> Column:
    """A usable answer; where a local run may retry, one that its check found grounded."""
    checked = mode == "local" and max_retries >= 2
    return usable(answer) & truthy(grounded, TRUE_ONLY) if checked else usable(answer)


def regenerated(answer: Column, first_token: Column) -> Column:
    """A usable answer that this run measured: the time to its first token is filled in."""
    return usable(answer) & ~F.lower(_bare(first_token)).isin(*UNMEASURED)


def evaluated(mrr: Column, ndcg: Column) -> Column:
    """A retrieval metric above zero; what is no number counts as zero."""
    above = lambda c: F.coalesce(number(c), F.lit(0.0)) > 0
    return above(mrr) | above(ndcg)


def gate(df: DataFrame, phase: str, mode: str = "local", max_retries: int = 3) -> Column:
    """The gate of `phase` over the ledger's own columns; a column that is missing counts as empty."""
    of = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("string")
    if phase == GENERATION:
        return generated(of("answer"), of("grounded"), mode, max_retries)
    if phase == REGENERATION:
        return regenerated(of("answer"), of("ttft_s"))
    if phase == EVALUATION:
        return evaluated(of("mrr"), of("ndcg_at_k"))
    raise ValueError(f"no such phase: {phase}")


def pending(questions: DataFrame, ledger: DataFrame, phase: str, key: str = "question_id", force: bool = False, mode: str = "local", max_retries: int = 3) -> DataFrame:
    """The questions that a run has yet to do: those without a row that passes the gate of `phase`.

    A question is done if any of its rows passes. Keys meet as trimmed text; questions with a null or empty key are never done and stay.
    `force` does every question again, except in regeneration, whose gate tells what the forced run did already.
    """
    if force and phase != REGENERATION:
        return questions
    done = ledger.where(gate(ledger, phase, mode, max_retries)).select(_bare(F.col(key)).alias("_done")).where("_done <> ''").distinct()
    return questions.join(done, _bare(questions[key]) == F.col("_done"), "left_anti")
