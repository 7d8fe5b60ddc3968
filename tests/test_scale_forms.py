"""Forms that do not put a whole group in one task, against the plain ones."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from clausewright.operators import analysis, chunking, ledger, sampling


def test_neighbours_equal_lag_and_lead(spark):
    rng = np.random.default_rng(6)
    rows = [(k, *(None if x == 3 else f"g{x}" for x in rng.integers(0, 4, 2)), int(rng.integers(0, 9))) for k in range(400)] + [(k, "hot", "hot", k % 50) for k in range(400, 900)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, chunk_index int")
    w = Window.partitionBy("lang", "source").orderBy("chunk_index", "doc_id")
    want = df.select("doc_id", F.lag("doc_id").over(w), F.lead("doc_id").over(w)).collect()
    got = chunking.neighbours(df)
    assert got.columns == [*df.columns, "prev_id", "next_id"]
    assert sorted(map(tuple, want)) == sorted(map(tuple, got.select("doc_id", "prev_id", "next_id").collect()))
    assert chunking.neighbours(df.where("false")).count() == 0


def test_ten_thousand_phrases(spark):
    texts = spark.createDataFrame([(1, "thunder the moon, phrase 7 and phrase 77", ["the"]), (2, "nothing", []), (3, None, None), (4, "phrase 9999", [])], "doc_id bigint, text string, tokens array<string>")
    words = [f"phrase {k}" for k in range(10_000)] + ["under the", "e m", ""]
    phrases = spark.createDataFrame([(w,) for w in words], "word string")
    want = {(d, w) for d, t in ((1, "thunder the moon, phrase 7 and phrase 77"), (4, "phrase 9999")) for w in words if w and w in t}
    for limit in (1 << 25, 40_000):
        got = [tuple(r) for r in analysis.phrase_hits(texts, phrases, limit).collect()]
        assert sorted(got) == sorted(want)
    keywords = spark.createDataFrame([*((f"c{k % 7}", f"phrase {k}") for k in range(10_000)), ("a", "under the"), ("a", "the"), ("b", "e m")], "category string, word string")
    best = {r.doc_id: r.score for r in analysis.keyword_category(texts, keywords).collect()}
    sums = {d: {} for d in (1, 4)}
    for d, t in ((1, "thunder the moon, phrase 7 and phrase 77"), (4, "phrase 9999")):
        for c, w in [*((f"c{k % 7}", f"phrase {k}") for k in range(10_000)), ("a", "under the"), ("b", "e m")]:
            if w in t:
                sums[d][c] = sums[d].get(c, 0) + 2
    sums[1]["a"] += 1
    assert best == {d: max(x.values()) for d, x in sums.items()}


def test_samples_keep_few_rows_of_a_stratum(spark):
    df = spark.createDataFrame([(k, "hot" if k % 10 else "cold") for k in range(3000)], "doc_id bigint, s string")
    quota = F.when(F.col("s") == "hot", 5).otherwise(2)
    got = sampling.stratified(df, ["s"], "doc_id", quota)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    order = Window.partitionBy("s").orderBy(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))), "doc_id")
    want = df.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= quota)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sampling.stratified(df.where("false"), ["s"], "doc_id", quota).count() == 0


def test_two_way_sync(spark):
    left = spark.createDataFrame([("q1_fr", "a", "", "x"), ("q2", "nan", "English", "x"), ("q3", "only", "de", "x")], "question_id string, answer string, language string, own string")
    right = spark.createDataFrame([("q1_fr", "b", "French", None), ("q2", "c", "none", "kept"), ("q4", "", "EN", "")], "question_id string, answer string, language string, copy string")
    rows, counters = ledger.two_way(left, right, ["question_id"], ["answer", "language"], {"copy": "answer"})
    got = {r.question_id: tuple(r)[1:] for r in rows.collect()}
    assert got == {
        "q1_fr": ("a", "fr", "b", "fr", "b", "both"),
        "q2": ("c", "en", "c", "en", "kept", "both"),
        "q3": ("only", "de", "only", "de", "only", "left"),
        "q4": ("", "en", "", "en", "", "right"),
    }
    assert counters.get == {"filled_left": 2, "filled_right": 1, "added_left": 1, "added_right": 1, "language_fixed": 3, "rows": 4}
