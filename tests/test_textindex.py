"""The stored index against scoring every document."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.operators import retrieval, textindex


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    p = 1 / np.arange(1, 201)
    p /= p.sum()
    word = lambda n: " ".join(f"w{x}" for x in rng.choice(200, n, p=p))
    docs = [(k, word(int(rng.integers(1, 60)))) for k in range(500)] + [(500, ""), (501, None), (502, "w0 " * 90)]
    questions = [(k, word(int(rng.integers(1, 9)))) for k in range(40)] + [(40, "w0 w0 w0"), (41, "none such"), (42, ""), (43, None), (44, docs[3][1])]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(questions, "item_id bigint, text string")


def rows(df):
    return sorted((r.item_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())


def test_index_gives_the_same_lists(spark, corpus, tmp_path):
    docs, questions = corpus
    index = textindex.Index(spark, f"{tmp_path}/a", 4)
    assert textindex.append(index, docs, block=16) == 503
    for k in (1, 5, 600):
        assert rows(textindex.search(index, questions, k)) == rows(retrieval.bm25(docs, questions, k))


def test_generations_add_up(spark, corpus, tmp_path):
    docs, questions = corpus
    index = textindex.Index(spark, f"{tmp_path}/b", 4)
    assert [textindex.append(index, d, block=16) for d in (docs.where("doc_id < 200"), docs, docs)] == [200, 303, 0]
    assert rows(textindex.search(index, questions, 5)) == rows(retrieval.bm25(docs, questions, 5))


def test_bounds_leave_few_candidates(spark, corpus, tmp_path):
    docs, questions = corpus
    index = textindex.Index(spark, f"{tmp_path}/c", 8)
    textindex.append(index, docs, block=16)
    terms = textindex.asked_terms(index, questions)
    every = index.table("lists").join(terms.select("item_id", "term"), "term").select("item_id", F.explode("docs")).distinct().count()
    assert textindex.candidates(index, terms, 1).count() < 0.4 * every
    plan = textindex._lists(index, spark.createDataFrame([("w150",)], "term string"))._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_resume_asks_only_what_is_missing(spark):
    questions = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "item_id bigint, text string")
    stored = spark.createDataFrame([(1, 7, 0.5), (2, 8, None)], "item_id bigint, doc_id bigint, rrf double")
    asked = []

    def find(q):
        asked.extend(r.item_id for r in q.collect())
        return q.select("item_id", F.lit(9).cast("bigint").alias("doc_id"), F.lit(0.1).alias("rrf"))

    got = sorted(tuple(r) for r in textindex.resumed(questions, stored, find).collect())
    assert sorted(asked) == [2, 3] and got == [(1, 7, 0.5), (2, 9, 0.1), (3, 9, 0.1)]


def test_search_makes_no_row_for_a_pair(spark, corpus, tmp_path, monkeypatch):
    """Only the seeds are scored as pairs; documents are counted once, when they are stored."""
    docs, questions = corpus
    index = textindex.Index(spark, f"{tmp_path}/d", 4)
    textindex.append(index, docs, block=16)
    assert {r.doc_id: r.tf for r in index.table("forward").where("doc_id > 499").collect()} == {500: {}, 501: {}, 502: {"w0": 90}}
    made, plain = [], textindex.scored
    monkeypatch.setattr(textindex, "scored", lambda *a: made.append(1) or plain(*a))
    assert rows(textindex.search(index, questions, 3)) == rows(retrieval.bm25(docs, questions, 3)) and len(made) == 1
