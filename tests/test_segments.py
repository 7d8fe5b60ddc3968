"""The linear segmenter against the fold over one text, and the anchored variant against its rules."""

import time

import numpy as np
from pyspark.sql import functions as F

from clausewright.operators import chunking

LINES = ["ARTICLE 1 Terms", "Article 2 – PAY", "ARTICLE 3", "1.1 First", "1.2(a) Sub", "2.1 Second", "3.4.5(ii) Deep", "9.9 none", "PART IV", "Annexe 2", "<<page_7>>", "page 12", "Page", "", "  ", "plain words", "  ARTICLE 4: lower", "12.1", "ARTICLE 5 5.1"]


def texts(n):
    rng = np.random.default_rng(21)
    return [str(rng.choice(["\n", "\r\n"])).join(LINES[k] for k in rng.integers(0, len(LINES), int(rng.integers(0, 40)))) for _ in range(n)]


def test_linear_form_equals_the_fold(spark):
    docs = spark.createDataFrame([*enumerate(texts(80)), (80, ""), (81, None)], "doc_id bigint, text string")
    fold = docs.select("doc_id", F.posexplode(chunking.segment(F.col("text"))).alias("ord", "c")).select("doc_id", "ord", "c.*")
    names = ["doc_id", "ord", "article", "clause", "title", "page", "text"]
    want = sorted(tuple(r) for r in fold.select(*names).collect())
    assert len(want) > 300 and sorted(tuple(r) for r in chunking.segmented(chunking.lines_of(docs)).select(*names).collect()) == want


def test_anchored_variant(spark):
    text = "intro\n<<<PAGE:3>>>\nARTICLE 7 Leave of absence\n\nfirst <<<PAGE:9>>> inside\narticle 8: more\n8.1(a)x sub\n8.2(b) sub\n7.1 other\nSECTION II\n<<<PAGE:4>>>\nend"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = [tuple(r)[1:] for r in chunking.segmented(chunking.lines_of(docs), anchored=True).orderBy("ord").collect()]
    assert got == [
        (0, "0", "0", "PREAMBLE", 3, "intro"),
        (1, "7", "7", "PREAMBLE", 3, "ARTICLE 7 Leave of absence\n\nfirst  inside"),
        (2, "8", "8", "PREAMBLE", 3, "article 8: more"),
        (3, "8", "8.1.a", "PREAMBLE", 3, "8.1(a)x sub"),
        (4, "8", "8.2", "SECTION II", 4, "8.2(b) sub\n7.1 other\nSECTION II\n\nend"),
    ]


def test_a_text_of_a_megabyte(spark):
    text = "\n".join(f"ARTICLE {k % 900} Title\n" + "some words of a line\n" * 4 + f"{k % 900}.1 sub" for k in range(10_000))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    began = time.time()
    assert len(text) > 1_000_000 and chunking.segmented(chunking.lines_of(docs)).count() == 20_000
    assert time.time() - began < 120
