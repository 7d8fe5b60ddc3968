"""Stems against the published examples, and scores against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from clausewright.functions import lexical
from clausewright.functions.porter import measure, stem

STEMS = """caresses caress ponies poni ties tie caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formality formal sensitivity sensit sensibility sensibl triplicate triplic
formative form formalize formal electricity electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust
defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ angularity angular homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas control control roll roll dying die news news is is by by say say enjoy enjoy cries cri died die tied tie generalizations gener oscillators oscil hopefully hope
geology geolog radically radic""".split()


@pytest.mark.parametrize("word, want", list(zip(STEMS[::2], STEMS[1::2], strict=True)))
def test_stem(word, want):
    assert stem(word) == want


def test_measure():
    words = {0: ["tr", "ee", "tree", "y", "by"], 1: ["trouble", "oats", "trees", "ivy"], 2: ["troubles", "private", "oaten", "orrery"]}
    assert all(measure(w) == m for m, some in words.items() for w in some)


def test_rouge_and_meteor():
    assert lexical.rouge_n("The cats were running", "a cat was running by", 1) == pytest.approx(2 * 2 / 9) and lexical.ascii_stems("The cats' Running ÉTÉ") == ["the", "cat", "run", "t"]
    assert lexical.rouge_n("", "a", 1) == lexical.rouge_l(None, "a") == lexical.meteor("x", "y") == 0
    assert lexical.rouge_l("one two three four", "one three four five") == pytest.approx(0.75)
    # three matches of four words each side in two runs
    assert lexical.meteor("one two three six", "one four two three") == pytest.approx(0.75 * (1 - 0.5 * (2 / 3) ** 3))
    assert lexical.meteor("agreed terms", "agree terms") == pytest.approx(1 - 0.5 * (1 / 2) ** 3)
    assert lexical.meteor("a x a", "a") == lexical.meteor("x a a", "a")  # the last of a word is matched


def test_rouge_columns_equal_the_counts(spark):
    texts = ["a b a b a", "b a b", "", None, "x", "a a a a", "the cat sat on the cat", "the the cat cat sat"]
    rows = [(p, r) for p in texts for r in texts]
    df = spark.createDataFrame(rows, "p string, r string")
    p, r = lexical.ascii_tokens(F.col("p")), lexical.ascii_tokens(F.col("r"))
    for row in df.select("p", "r", lexical.rouge(p, r, 1).alias("one"), lexical.rouge(p, r, 2).alias("two")).collect():
        for n, got in ((1, row.one), (2, row.two)):
            x, y = (lexical._grams((t or "").split(), n) for t in (row.p, row.r))
            assert got == round(lexical._f(sum((x & y).values()), sum(x.values()), sum(y.values())), 4)
