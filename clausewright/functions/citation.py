"""Citations of articles and clauses, and their deterministic score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How articles and clauses are written in the three languages.
ARTICLE = r"(?i)\b(?:article[s]?|artikel|art)\.?\s*(?:no\.?|n[o°]\.?|nr\.?|#)?\s*(\d{1,3})\b"
CLAUSE_WORD = r"(?i)\b(?:clause|section|paragraph[e]?|abschnitt|absatz|ziffer)\s*(\d{1,3}(?:\.\d+)*)\b"
DOTTED = r"\b(\d{1,3}(?:\.\d+)+(?:\s*\([a-zA-Z0-9]+\))?)"
FIRST_ARTICLE = r"(?i)(?:article|clause)\s+(\d{1,3})"


def first_article(c: Column) -> Column:
    return F.regexp_extract(c, FIRST_ARTICLE, 1)


def dotted_id(c: Column) -> Column:
    """7.20(a) as 7.20.a."""
    return F.regexp_replace(F.regexp_replace(c, r"\(([^)]*)\)", ".$1"), r"^[ .]+|[ .]+$", "")


def clause_id(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"\s+", "")), r"^[ .]+|[ .]+$", "")


def clauses(text: Column) -> Column:
    dotted = F.transform(F.regexp_extract_all(text, F.lit(DOTTED), F.lit(1)), clause_id)
    named = F.filter(F.transform(F.regexp_extract_all(text, F.lit(CLAUSE_WORD), F.lit(1)), clause_id), lambda x: x.contains("."))
    return F.array_sort(F.array_union(dotted, named))


def articles(text: Column) -> Column:
    plain = F.regexp_extract_all(text, F.lit(ARTICLE), F.lit(1))
    named = F.filter(F.transform(F.regexp_extract_all(text, F.lit(CLAUSE_WORD), F.lit(1)), clause_id), lambda x: ~x.contains("."))
    heads = F.transform(clauses(text), lambda x: F.split(x, r"\.")[0])
    return F.array_sort(F.array_union(F.array_union(plain, named), heads))


def _least(items: Column, key) -> Column:
    ranked = F.array_sort(F.transform(items, lambda x: F.struct(*key(x), x.alias("v"))))
    return F.coalesce(F.get(ranked, F.lit(0))["v"], F.lit(""))


def gold_article(text: Column) -> Column:
    return _least(articles(text), lambda x: (F.length(x).alias("n"),))


def gold_clause(text: Column) -> Column:
    """Most parts, then longest; ties go to the first in order."""
    return _least(clauses(text), lambda x: ((-F.size(F.split(x, r"\."))).alias("p"), (-F.length(x)).alias("n")))


def accuracy(answer: Column, gold: Column) -> Column:
    """1 for a shared clause, 0.5 for the article, else 0; null without a gold citation."""
    a, c = gold_article(gold), gold_clause(gold)
    clause_hit = (c != "") & F.array_contains(clauses(answer), c)
    article_hit = (a != "") & F.array_contains(articles(answer), a)
    return F.when((a == "") & (c == ""), F.lit(None)).when(clause_hit, 1.0).when(article_hit, 0.5).otherwise(0.0)
