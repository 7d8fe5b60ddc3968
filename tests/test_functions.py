"""Hand-checked values of the functions and operators."""

import pytest
from pyspark.sql import functions as F

from clausewright.functions import citation, lexical, metrics, predicates, register_all, text
from clausewright.operators import analysis, chunking, ledger, loop, retrieval, sampling
from clausewright.sources import files


def one(spark, column, **values):
    cells = [F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()]
    return spark.range(1).select(*cells).select(column.alias("x")).first().x


GOLD = "ARTICLE 7.20 – ABSENCE - GENERAL\n7.20.1 The University as a community of scholars ..."


@pytest.mark.parametrize(
    ("answer", "score"),
    [("Per clause 7.20.1 of Article 7, ...", 1.0), ("Article 7 covers this.", 0.5), ("See Article 12.3.4.", 0.0), ("The university bears the cost.", 0.0), ("Gemäß Artikel 7, Absatz 7.20.1", 1.0)],
)
def test_citation_scores(spark, answer, score):
    assert one(spark, citation.accuracy(F.col("a"), F.col("g")), a=answer, g=GOLD) == score


def test_citations_of_gold(spark):
    assert one(spark, citation.gold_article(F.col("g")), g=GOLD) == "7" and one(spark, citation.gold_clause(F.col("g")), g=GOLD) == "7.20.1"
    assert one(spark, citation.accuracy(F.lit("Article 7"), F.col("g")), g="nothing cited") is None


@pytest.mark.parametrize(
    ("question", "lang", "more"),
    [("What is the vacation policy?", "en", " collective agreement 2020 - 2025"), ("Quelle est la politique de vacances?", "fr", " convention collective 2020 - 2025"), ("What changed in 2022 for sick leave?", "en", ""), ("Article 1234 about benefits", "en", " collective agreement 2020 - 2025")],
)
def test_years_are_added_where_none_is(spark, question, lang, more):
    assert one(spark, text.augment_with_year(F.col("q"), F.col("l")), q=question, l=lang) == question + more


def test_recency_and_years(spark):
    w = lambda y, *b: one(spark, text.recency_weight(F.lit(y).cast("int"), *b))
    assert [w(2018, 2005, 2025), w(2021, 2005, 2025), w(None), w(1998), w(2026), w(2012), w(1990)] == [0.755, 0.86, 1.0, 0.3, 1.0, 0.65, 0.3]
    assert one(spark, text.end_year(F.col("s")), s="agreement 2015-2018") == 2018 and one(spark, text.end_year(F.col("s")), s="ca_2015_2018") is None


def test_metrics(spark):
    r, g = F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "ad"))
    assert one(spark, metrics.recall_at(r, g, 2)) == 0.5 and one(spark, metrics.reciprocal_rank(r, g)) == 1.0 and one(spark, metrics.ndcg_at(r, g, 2)) == 0.6131
    none = F.array().cast("array<string>")
    assert [one(spark, f(r, none, 2)) for f in (metrics.recall_at, metrics.precision_at, metrics.ndcg_at)] == [0, 0, 0]
    assert one(spark, metrics.token_f1(F.lit("hello world"), F.lit("hello there"))) == 0.5
    assert one(spark, text.token_set(F.lit("L'été déjà l'été"))) == ["l", "été", "déjà"]


def test_lexical_metrics(spark):
    same = "the cat sat on the mat today"
    assert lexical.bleu(same, same) == pytest.approx(1) and lexical.rouge_l(same, same) == 1 and lexical.rouge_n(same, same, 2) == 1
    assert lexical.meteor(same, same) == pytest.approx(1 - 0.5 / 7**3) and lexical.bleu("", "a") == lexical.meteor("x", "y") == 0
    assert lexical.rouge_n("cats sat", "cat sits", 1) == 0.5 and lexical.rouge_l("a b c d", "a c d") == pytest.approx(6 / 7)
    assert set(register_all(spark)) == {"bleu", "rouge_1", "rouge_2", "rouge_l", "meteor"}
    assert spark.sql("SELECT rouge_l('a b c d', 'a c d') AS x").first().x == 0.8571


def test_null_model(spark):
    p = predicates
    rows = [(None, True), ("", True), (" NaN ", True), ("none", True), ("0", False), ("x", False)]
    assert [one(spark, p.blank(F.col("c")), c=v) for v, _ in rows] == [b for _, b in rows]
    assert one(spark, p.number(F.col("c")), c="nan") is None and one(spark, p.zero_or_blank(F.col("c")), c="0.00") is True
    assert [one(spark, p.truthy(F.lit("Yes"), s)) for s in (p.TRUE_ONLY, p.TRUE_ONE, p.TRUE_YES)] == [False, False, True]


def test_language_resolution(spark):
    r = lambda a, q: one(spark, text.resolve_language(F.col("a"), F.col("q")), a=a, q=q)
    assert [r("français", "x"), r("", "test_fr_216"), r("chunk text", "test_en_004"), r("chunk", "x"), r(None, "x")] == ["fr", "fr", "en", "chunk", ""]


def test_context_window(spark):
    got = [one(spark, f) for f in (text.context_window(F.repeat(F.lit("x"), F.lit(3200))), text.estimated_tokens(F.repeat(F.lit("x"), F.lit(3200))), text.predicted_output(F.lit(1001)))]
    assert got == [12288, 1001, 768]


def test_reflection(spark):
    said = ["GROUNDED", "grounded ", "UNGROUNDED", "UNGROUNDED.", "GROUNDEDNESS", None, ""]
    assert [one(spark, loop.reflected(F.col("c")), c=s) for s in said] == [True, True, False, False, False, False, False]
    w = lambda attempt, proposal, n: one(spark, loop.rewritten(F.lit("q"), F.lit(proposal), F.lit(attempt), F.array_repeat(F.lit("h"), n)))
    assert [w(1, "p", 1), w(2, "p", 1), w(2, "p", 0), w(2, "", 1), w(2, "p" * 400, 1)] == ["q", "p", "q", "q", "q"]


def test_tie_buckets(spark):
    rows = [(1, k, s, w) for k, (s, w) in enumerate([(0.80, 0.1), (0.79, 0.9), (0.781, 0.5), (0.77, 1.0), (0.70, 1.0)])]
    df = spark.createDataFrame(rows, "item_id int, doc_id bigint, score double, weight double")
    assert [r.doc_id for r in retrieval.rerank(df, 5).orderBy("rank").collect()] == [1, 2, 0, 3, 4]


def test_fusion_does_not_depend_on_input_order(spark):
    a = spark.createDataFrame([(1, d, r) for r, d in enumerate([5, 3, 8], 1)], "item_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, d, r) for r, d in enumerate([3, 9, 5], 1)], "item_id int, doc_id int, rank int")
    first = [r.doc_id for r in retrieval.fuse(a, b, 4).orderBy("rank").collect()]
    again = [r.doc_id for r in retrieval.fuse(a.orderBy("doc_id"), b.orderBy(F.desc("doc_id")), 4).orderBy("rank").collect()]
    assert first == again == [3, 5, 9, 8]


def test_upsert_twice_is_once(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (2, "c", "z")], "k int, own string, other string")
    new = spark.createDataFrame([(2, "new", "no"), (3, "add", "yes")], "k int, own string, other string")
    once = ledger.upsert(base, new, ["k"], ["own"])
    want = [(1, "a", "x"), (2, "new", "y"), (2, "new", "z"), (3, "add", "yes")]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, ledger.upsert(once, new, ["k"], ["own"]).collect()))


def test_kappa(spark):
    df = spark.createDataFrame([(1, 1)] * 5, "a int, b int")
    assert analysis.agreement(df, "a", "b").first().kappa == 1.0
    assert analysis.agreement(df.limit(0), "a", "b").first().kappa is None


def test_segments(spark):
    body = "Preface\nARTICLE 7 – LEAVE\n<<page_3>>\n7.1 Sick\ntext\n8.1 not mine\nPART II Other\n7.2(a) More\npage 9\nARTICLE 7.20 – NOT A HEADER"
    got = one(spark, chunking.segment(F.col("t")), t=body)
    assert [(c.article, c.clause, c.title, c.page) for c in got] == [("0", "0", "PREAMBLE", 1), ("7", "7", "LEAVE", 3), ("7", "7.1", "PART II Other", 3), ("7", "7.2.a", "PART II Other", 9)]
    assert got[2].text.startswith("7.1 Sick") and "8.1 not mine" in got[2].text and "page" not in got[3].text


def test_merging_and_splitting(spark):
    rows = [(1, 0, "a", 1, "s", 5), (1, 1, "b", 2, "long", 40), (1, 2, "c", 3, "t", 5), (2, 0, "d", 1, "s", 3)]
    df = spark.createDataFrame(rows, "doc_id int, ord int, clause string, page int, text string, tokens int")
    assert [tuple(r) for r in chunking.merge_short(df).collect()] == [(1, 0, "b", 1, "s\nlong\nt")]
    parts = one(spark, chunking.split_long(F.col("t"), 4), t="One two three. Four five. Six seven eight nine ten. Eleven.")
    assert parts == ["One two three.", "Four five.", "Six seven eight nine ten.", "Eleven."]


def test_samples(spark):
    df = spark.range(100).selectExpr("id", "id % 4 AS s")
    a = sampling.stratified(df, ["s"], "id", F.lit(3))
    assert a.count() == 12 and sorted(r.id for r in a.collect()) == sorted(r.id for r in sampling.stratified(df.repartition(5), ["s"], "id", F.lit(3)).collect())
    assert sampling.disjoint(df, a, "id").count() == 88
    cells = spark.createDataFrame([("x", 50), ("y", 25), ("z", 25)], "cell string, n int")
    assert {r.cell: r.quota for r in sampling.scaled_quotas(cells, 30).collect()} == {"x": 14, "y": 8, "z": 8}


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.csv").write_text('id,note\n1,"two\nlines, ""quoted"""\n2,\n')
    (tmp_path / "a/x.csv.bak").write_text("id\n")
    rows = files.read_csv(spark, str(tmp_path / "a/x.csv")).collect()
    assert [tuple(r) for r in rows] == [("1", 'two\nlines, "quoted"'), ("2", "")]
    assert files.find(spark, str(tmp_path), "x.csv").count() == 1
    (tmp_path / "t.txt").write_text("one\ffoot 2015 - 2018\ftwo")
    assert [r.page_no for r in files.read_pages(spark, str(tmp_path / "t.txt")).collect()] == [1, 2, 3]
    (tmp_path / "bad.json").write_text('"total": 3}\n{"total": 4}\n')
    assert [r.total for r in files.read_json(spark, str(tmp_path / "bad.json"), "total int").collect()] == [None, 4]
    assert one(spark, files.needs_ocr(F.array(F.lit("x"), F.lit("y")))) is True


def test_upsert_stream_goes_on_after_a_restart(spark, tmp_path):
    from clausewright.streaming import incremental

    def add(rows, name):
        spark.createDataFrame(rows, "k bigint, n bigint").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        source = spark.readStream.schema("k bigint, n bigint").parquet(str(tmp_path / "in" / "*"))
        path = incremental.upsert_stream(spark, source, ["k"], "n", str(tmp_path / "ledger"))
        return sorted(tuple(r) for r in spark.read.parquet(path).collect())

    add([(1, 1), (2, 1)], "a")
    assert run() == [(1, 1), (2, 1)]
    add([(2, 2), (3, 2)], "b")
    assert run() == [(1, 1), (2, 2), (3, 2)] == run()


def test_score_class_and_language_of_nothing(spark):
    from clausewright.functions import text

    df = spark.createDataFrame([(None, None), (float("nan"), ""), (0.7, "la fin de the"), (0.4, "le the")], "x double, s string")
    rows = df.select(text.score_class(F.col("x")).alias("c"), text.english_or_french(F.col("s")).alias("l")).collect()
    assert [tuple(r) for r in rows] == [("", "English"), ("", "English"), ("high", "French"), ("mid", "English")]


def test_more_phrases_than_a_block(spark):
    from clausewright.operators import analysis

    texts = spark.createDataFrame([(1, "see phrase 1150 here", ["see"])], "doc_id bigint, text string, tokens array<string>")
    keywords = spark.createDataFrame([(f"c{k}", f"phrase {k}") for k in range(1001, 1203)], "category string, word string")
    assert [tuple(r) for r in analysis.keyword_category(texts, keywords).collect()] == [(1, "c1150", 2)]
