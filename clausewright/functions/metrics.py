"""Retrieval and overlap metrics on Columns of token sets and ranked ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import token_set


def _common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def _ratio(x: Column, n: Column) -> Column:
    return F.when(n == 0, 0.0).otherwise(x / n)


def token_f1(prediction: Column, reference: Column) -> Column:
    p, r = token_set(prediction), token_set(reference)
    both = _common(p, r)
    return F.when(both == 0, 0.0).otherwise(2 * both / (F.size(p) + F.size(r)))


def share_of_second(a: Column, b: Column) -> Column:
    return _ratio(_common(token_set(a), token_set(b)), F.size(token_set(b)))


def share_of_first(a: Column, b: Column) -> Column:
    return _ratio(_common(token_set(a), token_set(b)), F.size(token_set(a)))


def coverage_accepted(expected: Column, document: Column, least: int = 80) -> Column:
    return F.round(100 * share_of_first(expected, document)) >= least


def recall_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Distinct hits in the first k over the length of the gold list."""
    return _ratio(_common(F.slice(retrieved, 1, k), gold), F.size(gold))


def precision_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Hits over the ranks that exist."""
    top = F.slice(retrieved, 1, k)
    return _ratio(F.size(F.filter(top, lambda x: F.array_contains(gold, x))).cast("double"), F.size(top))


def reciprocal_rank(retrieved: Column, gold: Column) -> Column:
    at = F.array_min(F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda i: i.isNotNull()))
    return F.coalesce(F.lit(1.0) / at, F.lit(0.0))


def ndcg_at(retrieved: Column, gold: Column, k: int) -> Column:
    def gain(n: Column) -> Column:
        return F.lit(1.0) / F.log2(n + F.lit(1.0))

    hits = F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(gold, x), gain(i + 1)).otherwise(0.0))
    dcg = F.aggregate(hits, F.lit(0.0), lambda acc, x: acc + x)
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(F.array_distinct(gold)), F.lit(k)))), F.lit(0.0), lambda acc, n: acc + gain(n))
    return F.when(F.size(gold) == 0, 0.0).otherwise(F.round(dcg / best, 4))


def context(texts: Column, joiner: str = " ", most: int | None = 3000) -> Column:
    whole = F.array_join(F.filter(texts, lambda t: F.trim(F.coalesce(t, F.lit(""))) != ""), joiner)
    return whole if most is None else F.substr(whole, F.lit(1), F.lit(most))
