"""Resume gates, preserved retrievals, reconciliation, annotation sheets and judge parsing over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import analysis, ledger, retrieval, sampling
from .ledger_queries import LEDGER, led
from .registry import query
from .retrieval_queries import BM25


@query("SELECT DISTINCT 'q' || (event_id % 700) AS qid FROM events WHERE event_id % 4 <> 0")
def completed_ids(t):
    k = F.col("event_id")
    return ledger.completed_ids(t("events").select(F.when(k % 4 != 0, F.concat(F.lit(" q"), k % 700)).when(k % 8 == 0, " ").alias("qid")), "qid")


@query("SELECT event_id, event_id % 4 <> 0 OR event_id % 3 <> 0 AS retrieval, event_id % 5 <> 0 AND event_id % 5 <> 1 AS judged, event_id % 2 = 0 AS stored FROM events")
def group_completeness(t):
    k = F.col("event_id")
    rows = t("events").select(k, (k % 4).cast("string").alias("mrr"), (k % 3).cast("string").alias("ndcg"), F.when(k % 5 == 0, "nan").when(k % 5 == 1, "").otherwise("0.4").alias("faith"))
    sources = F.array(F.struct(F.when(k % 2 == 0, 0.1).alias("rrf")))
    return rows.select("event_id", *ledger.group_complete(rows, {"retrieval": ["mrr", "ndcg"], "judged": ["faith"]}), ledger.has_retrieval(sources).alias("stored"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'old' WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END AS source1_id FROM events")
def preserved_retrieval(t):
    k = F.col("event_id")
    return t("events").select("event_id", ledger.preserved(F.lit("old"), F.when(k % 2 == 0, "new"), F.when(k % 3 == 0, "0.5").otherwise("0.01")).alias("source1_id"))


@query(f"""WITH {LEDGER}, flagged AS (SELECT DISTINCT qid, model FROM led WHERE mrr > 0 AND f1 = 0), keep AS (SELECT qid, model, ord, f1 FROM led ANTI JOIN flagged USING (qid, model)),
healed AS (SELECT qid, model, max(ord) + 1000000 AS ord, 1.0::DOUBLE AS f1 FROM led WHERE mrr > 0 AND f1 = 0 GROUP BY qid, model), u AS (SELECT * FROM keep UNION ALL SELECT * FROM healed)
SELECT qid, model, ord, f1 FROM u QUALIFY row_number() OVER (PARTITION BY qid, model ORDER BY ord DESC) = 1""")
def reconcile_regenerated(t):
    rows = led(t).select("qid", "model", "ord", "f1", "mrr")
    bad = rows.where("mrr > 0 AND f1 = 0")
    healed = bad.groupBy("qid", "model").agg((F.max("ord") + 1000000).alias("ord"), F.lit(1.0).alias("f1"))
    return ledger.reconciled(rows.drop("mrr"), healed, bad, ["qid", "model"], "ord")


@query("""SELECT row_number() OVER (ORDER BY try_cast(v AS DOUBLE) NULLS LAST, lower(v), part) AS place, part, v FROM (SELECT p_partkey AS part, CASE WHEN p_partkey % 3 = 0 THEN 'X' || p_partkey ELSE (p_partkey * 37 % 101)::VARCHAR END AS v FROM part) QUALIFY place <= 50""")
def click_sort_top(t):
    p = F.col("p_partkey")
    rows = t("part").select(p.alias("part"), F.when(p % 3 == 0, F.concat(F.lit("X"), p)).otherwise((p * 37 % 101).cast("string")).alias("v"))
    first = ledger.click_order(rows.orderBy("part"), "v")
    first = first.orderBy(ledger.number(F.col("v")).asc_nulls_last(), F.lower("v"), "part").limit(50)
    w = Window.orderBy(ledger.number(F.col("v")).asc_nulls_last(), F.lower("v"), "part")  # of fifty rows
    return first.select(F.row_number().over(w).alias("place"), "part", "v")


@query("""WITH j AS (SELECT 'quality' AS judgment, quality AS a, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS b FROM labels UNION ALL SELECT 'toxic', toxic, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE toxic END FROM labels),
s AS (SELECT judgment, count(*)::DOUBLE AS n, avg((a = b)::INT) AS po, avg(a::DOUBLE) AS pa, avg(b::DOUBLE) AS pb FROM j GROUP BY judgment), k AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM s)
SELECT judgment, n::BIGINT AS n, round(po, 4) AS exact, round((po - pe) / (1 - pe), 4) AS kappa, (po - pe) / (1 - pe) >= 0.75 AS acceptable FROM k""")
def iaa_summary(t):
    d, k = F.col("doc_id"), t("labels")
    pairs = {"quality": k.select(F.col("quality").alias("a"), F.when(d % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("b")), "toxic": k.select(F.col("toxic").alias("a"), F.when(d % 7 == 0, 0).otherwise(F.col("toxic")).alias("b"))}
    return reduce(DataFrame.unionByName, (analysis.agreement(p, "a", "b").withColumn("judgment", F.lit(name)) for name, p in pairs.items()))


@query(f"WITH {BM25} SELECT item_id, doc_id, score, rank FROM bm WHERE item_id NOT IN (SELECT doc_id FROM labels)")
def retrieve_with_resume(t):
    done = t("labels").select(F.col("doc_id").alias("item_id"))  # stands in for the ids that have stored results
    return retrieval.bm25(t("documents"), t("benchmark").join(done, "item_id", "left_anti"), 10).select("item_id", "doc_id", "score", "rank")


@query("""WITH s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS p FROM documents QUALIFY p <= 10), i AS (SELECT doc_id, lang, 'H' || lpad(row_number() OVER (ORDER BY md5('42#' || doc_id), doc_id)::VARCHAR, 3, '0') AS item_id FROM s)
SELECT item_id, doc_id, substr(text, 1, 300) AS shown, lang AS hidden FROM i JOIN documents USING (doc_id, lang)""")
def blind_annotation_sheets(t):
    sample = sampling.stratified(t("documents"), ["lang"], "doc_id", F.lit(10)).select("doc_id", F.substr("text", F.lit(1), F.lit(300)).alias("shown"), F.col("lang").alias("hidden"))
    sheet, key = ledger.blind_sheets(sampling.item_ids(sample, "doc_id"), ["hidden"])
    return sheet.join(key, "item_id").select("item_id", "doc_id", "shown", "hidden")


@query("""WITH r AS (SELECT conv_id, turn, length(text) % 6 AS s FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, CASE WHEN s = 0 THEN 0.5::DOUBLE ELSE s / 5.0::DOUBLE END AS relevance, substr(lower('x'), 1, 0) || round(CASE WHEN s = 0 THEN 0.5::DOUBLE ELSE s / 5.0::DOUBLE END, 1)::VARCHAR AS shown FROM r""")
def judge_stand_in(t):
    n = F.length("text") % 6
    score = text.judge_score(F.concat(F.lit("I give "), n, F.lit(" points")))
    return t("conversations").where("role = 'assistant'").select("conv_id", "turn", score.alias("relevance"), F.round(score, 1).cast("string").alias("shown"))
