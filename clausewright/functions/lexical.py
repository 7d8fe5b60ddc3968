"""BLEU, ROUGE and METEOR from their published formulas.

ROUGE-N on token arrays is Column expressions (`rouge`). What needs stems or alignments is Arrow-batched pandas UDFs. ROUGE stems words of more than three
letters, METEOR all; METEOR matches exact words and stems only, as no synonym lexicon is at hand.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .porter import stem

_ASCII = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"\w+")


def _grams(words: list[str], n: int) -> Counter:
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def bleu(prediction: str, reference: str) -> float:
    """Sentence BLEU-4; an order without a match counts as 1 / (2^k * 5 / ln(length)), smaller with every such order."""
    p, r = _WORD.findall((prediction or "").lower()), _WORD.findall((reference or "").lower())
    if not p or not r:
        return 0.0
    total, k = 0.0, 0
    for n in range(1, 5):
        grams = _grams(p, n)
        hits = sum((grams & _grams(r, n)).values())
        if n == 1 and not hits:
            return 0.0
        tries = max(1, sum(grams.values()))
        if hits:
            share = hits / tries
        elif len(p) > 1:
            k += 1
            share = math.log(len(p)) / (2**k * 5) / tries
        else:
            return 0.0
        total += math.log(share) / 4
    return min(1.0, math.exp(min(0.0, 1 - len(r) / len(p))) * math.exp(total))


def ascii_stems(text: str | None) -> list[str]:
    """ASCII words and numbers in lower case; those of more than three letters as stems."""
    return [stem(w) if len(w) > 3 else w for w in _ASCII.findall((text or "").lower())]


def _f(hits: float, p: int, r: int) -> float:
    return 2 * hits / (p + r) if hits else 0.0


def rouge_n(prediction: str, reference: str, n: int) -> float:
    p, r = (_grams(ascii_stems(t), n) for t in (prediction, reference))
    return _f(sum((p & r).values()), sum(p.values()), sum(r.values()))


def rouge_l(prediction: str, reference: str) -> float:
    p, r = (ascii_stems(t) for t in (prediction, reference))
    row = [0] * (len(r) + 1)
    for a in p:
        diagonal = 0
        for j, b in enumerate(r, 1):
            diagonal, row[j] = row[j], diagonal + 1 if a == b else max(row[j], row[j - 1])
    return _f(row[-1], len(p), len(r))


def meteor(prediction: str, reference: str) -> float:
    p, r = _WORD.findall((prediction or "").lower()), _WORD.findall((reference or "").lower())
    free, pairs = set(range(len(r))), {}
    for form in (lambda w: w, stem):
        places: dict[str, list[int]] = {}
        for j in sorted(free):
            places.setdefault(form(r[j]), []).append(j)
        for i, w in reversed(list(enumerate(p))):  # the last of a word goes with the last of the other side
            if i not in pairs and places.get(form(w)):
                pairs[i] = places[form(w)].pop()
                free.discard(pairs[i])
    m = len(pairs)
    if not m:
        return 0.0
    order = sorted(pairs.items())
    chunks = 1 + sum(1 for (a, b), (c, d) in zip(order, order[1:]) if c != a + 1 or d != b + 1)
    precision, recall = m / len(p), m / len(r)
    return (precision * recall / (0.9 * precision + 0.1 * recall)) * (1 - 0.5 * (chunks / m) ** 3)


def _column(f):
    @F.pandas_udf(DoubleType())
    def of(p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([round(f(a, b), 4) for a, b in zip(p, r)])

    return of


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def _bound(value: Column, f) -> Column:
    """f of a variable that holds `value`, which is then computed once a row and not in every step of f."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _occurrences(tokens: Column, n: int) -> Column:
    """The n-grams of an array, each with how many equal ones came before it, so that sets of them are multisets."""

    def grams(t: Column) -> Column:
        count = F.size(t) - (n - 1)
        return F.when(count > 0, F.array_sort(F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(t, i, n), " ")))).otherwise(F.array().cast("array<string>"))

    # equal grams stand together when sorted: an occurrence's number is its distance from the first of them
    numbered = lambda o: F.transform(o, lambda g, i: F.concat(g, F.lit("#"), (i + 1 - F.array_position(o, g)).cast("string")))
    return _bound(_bound(tokens, grams), numbered)


def rouge(prediction: Column, reference: Column, n: int) -> Column:
    """ROUGE-N of two arrays of tokens: the F-measure of their multisets of n-grams, to four places."""
    both = F.struct(_occurrences(prediction, n).alias("p"), _occurrences(reference, n).alias("r"))
    share = lambda x: F.size(F.array_intersect(x["p"], x["r"])) * 2 / F.greatest(F.lit(1), F.size(x["p"]) + F.size(x["r"]))
    return F.round(_bound(both, share), 4)


bleu_column = _column(bleu)
rouge_1_column = _column(lambda p, r: rouge_n(p, r, 1))
rouge_2_column = _column(lambda p, r: rouge_n(p, r, 2))
rouge_l_column = _column(rouge_l)
meteor_column = _column(meteor)
