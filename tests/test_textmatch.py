"""Text joins against all pairs, and hybrid retrieval on real vectors against its definition."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.functions.text import token_set
from clausewright.operators import retrieval, textmatch

WORDS = ["the", "of", "and", "clause", "wage", "leave", "été", "日本", "x_1", "a"]
ODD_QUERIES = ["", None, "  ", "Clause", "laus", "the of", "e", "日", "的", "of\tand  ", "(wage)", "wage, leave; the", ".", "..", "zzz not there"]


def texts(rng, n, size):
    return [rng.choice(["", " ", ". "]).join(["", ""]) + "".join(str(rng.choice(WORDS)) + str(rng.choice([" ", " ", ", ", ". ", "-", "\n"])) for _ in range(int(rng.integers(0, size)))) for _ in range(n)]


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(12)
    chunks = [*texts(rng, 60, 40), None, "", "Clause (WAGE) x", "..", "的"]
    queries = [*ODD_QUERIES, *texts(rng, 25, 7)]
    for k in range(30):  # slices of chunks, cut within words too
        c = chunks[int(rng.integers(0, 60))]
        at = int(rng.integers(0, max(1, len(c))))
        queries.append(("  " if k % 3 == 0 else "") + c[at : at + int(rng.integers(1, 40))].upper())
    q = list(enumerate(queries))
    c = [(int(n), t) for n, t in zip(rng.permutation(len(chunks)), chunks, strict=True)]
    return q, c, spark.createDataFrame(q, "item_id bigint, text string"), spark.createDataFrame([(*r, "z") for r in c], "doc_id bigint, text string, s string")


def bare(t):
    return re.sub(r"^\s+|\s+$", "", (t or "").lower(), flags=re.ASCII)


def words(t):
    return set(re.findall(r"\w+", (t or "").lower()))


def test_containment(pairs):
    q, c, dq, dc = pairs
    want = {(i, d) for i, a in q for d, b in c if bare(a) and bare(a) in (b or "").lower()}
    got = [tuple(r) for r in textmatch.containing(dq, dc).select("item_id", "doc_id").collect()]
    assert len(want) > 200 and sorted(got) == sorted(want)
    exact = {(i, d) for i, a in q for d, b in c if a and a in (b or "")}
    assert {tuple(r) for r in textmatch.containing(dq, dc, exact=True).collect()} == exact


@pytest.mark.parametrize("least, strict", [(0.0, False), (0.3, False), (0.5, True), (0.5, False), (1.0, False)])
def test_overlap(pairs, least, strict):
    q, c, dq, dc = pairs
    sets = lambda df, key: df.select(key, token_set(F.col("text")).alias("s"))
    share = {(i, d): len(words(a) & words(b)) / len(words(a)) for i, a in q for d, b in c if words(a) & words(b)}
    want = {k: v for k, v in share.items() if (v > least if strict else v >= least)}
    got = {(r.item_id, r.doc_id): r.overlap for r in textmatch.overlapping(sets(dq, "item_id"), sets(dc, "doc_id"), least, strict).collect()}
    assert got == want


def test_best_and_resolved_and_repaired(pairs):
    q, c, dq, dc = pairs
    dq_s, dc_s = dq.select("item_id", token_set(F.col("text")).alias("s")), dc.select("doc_id", token_set(F.col("text")).alias("s"))
    share = {}
    for i, a in q:
        own = sorted((-len(words(a) & words(b)) / len(words(a)), d) for d, b in c if words(a) & words(b))
        share[i] = [(d, -o) for o, d in own]
    assert {r.item_id: (r.doc_id, r.overlap) for r in textmatch.best(dq_s, dc_s).collect()} == {i: x[0] for i, x in share.items() if x}
    want = {(i, d, o, n) for i, x in share.items() for n, (d, o) in enumerate(x, 1) if o >= 0.3 or n == 1}
    assert {(r.item_id, r.doc_id, r.overlap, r["rank"]) for r in textmatch.resolved(dq_s, dc_s).collect()} == want
    repaired = {}
    for i, a in q:
        inside = [d for d, b in c if bare(a) and bare(a) in (b or "").lower()]
        if inside:
            repaired[i] = (min(inside), "contained", 1.0)
        elif share[i] and share[i][0][1] > 0.5:
            repaired[i] = (share[i][0][0], "overlap", share[i][0][1])
    assert {r.item_id: (r.doc_id, r.how, r.overlap) for r in textmatch.repaired(dq, dc).collect()} == repaired


def test_rare_tokens_keep_candidates_few(spark):
    rng = np.random.default_rng(3)
    chunks = [(k, ["the", "of", *(f"w{x}" for x in rng.integers(0, 4000, 20))]) for k in range(400)]
    queries = [(k, chunks[k][1][:12] + ["gone"]) for k in range(100)]
    dq, dc = spark.createDataFrame(queries, "item_id bigint, s array<string>"), spark.createDataFrame(chunks, "doc_id bigint, s array<string>")
    assert textmatch.overlap_candidates(dq, dc, 0.5).count() < 0.05 * 100 * 400
    assert textmatch.overlapping(dq, dc, 0.5).where("item_id = doc_id").count() == 100


def test_rescue_keeps_what_cannot_be_resolved(spark):
    questions = spark.createDataFrame([(1, [91, 92]), (2, [93]), (3, [5])], "item_id bigint, got array<bigint>")
    sources = spark.createDataFrame([(1, 1, "beta text"), (1, 2, "nowhere at all"), (2, 1, ""), (3, 1, "alpha")], "item_id bigint, rank int, text string")
    chunks = spark.createDataFrame([(5, "some Alpha here"), (6, "the beta text")], "doc_id bigint, text string")
    got = {r.item_id: r.got for r in textmatch.rescued(questions, sources, chunks, F.col("item_id") < 3).collect()}
    assert got == {1: [6], 2: [93], 3: [5]}


@pytest.mark.parametrize("kinds", [{}, {"components": 40, "group": 2}])
def test_dense_equals_all_pairs(spark, kinds):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(70, 4)).round(1)
    x[10:20] = x[0]
    odd = [(100, None), (101, [0.0] * 4), (102, [1.0, None, 0.0, 0.0]), (103, [math.nan] * 4), (104, [1.0] * 3), (None, [1.0] * 4)]
    rows = [*((k, v.tolist()) for k, v in enumerate(x)), *odd]
    df = spark.createDataFrame(rows, "doc_id bigint, embedding array<double>")
    q = df.where("doc_id < 9 OR doc_id > 99").withColumnRenamed("doc_id", "item_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for same in (False, True):
        want = set()
        for i in range(9):
            order = sorted((-round(float(unit[i] @ unit[j]), 6), j) for j in range(70) if (same or j != i) and j % 3)
            want |= {(i, j, n) for n, (_, j) in enumerate(order[:6], 1)}
        got = retrieval.dense(df, q, 6, F.col("doc_id") % 3 != 0, same, **kinds).collect()
        assert {(r.item_id, r.doc_id, r["rank"]) for r in got} == want
    assert retrieval.dense(df.where("false"), q, 6).count() == 0
    assert retrieval.dense(df, q.where("false"), 6).count() == 0


def test_filters_reach_the_scan(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    q = v.where("doc_id < 3").withColumnRenamed("doc_id", "item_id")
    plan = retrieval.dense(v, q, 3, F.col("label") == 4)._jdf.queryExecution().toString()
    assert "EqualTo(label,4)" in plan and "BroadcastNestedLoop" not in plan and "CartesianProduct" not in plan
