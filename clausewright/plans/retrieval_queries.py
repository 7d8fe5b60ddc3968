"""Retrieval and its metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexical, metrics, text
from ..operators import blocks, textmatch
from ..operators import retrieval as r
from .registry import query

TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
T = TOK.format("text")

BM25 = f"""
words AS (SELECT doc_id, {T} AS w FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words),
each AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM words),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM each GROUP BY ALL),
rawidf AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, corpus GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM rawidf) ELSE raw END AS idf FROM rawidf),
q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({T}) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM post JOIN q USING (term) JOIN idf USING (term), corpus GROUP BY item_id, doc_id),
bm AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10)"""

OVERLAP = """
sets AS (SELECT doc_id, list_distinct({d}) AS s FROM documents),
qsets AS (SELECT item_id, list_distinct({q}) AS s FROM benchmark),
shared AS (SELECT item_id, doc_id, count(*) AS c FROM (SELECT item_id, unnest(s) AS t FROM qsets) JOIN (SELECT doc_id, unnest(s) AS t FROM sets) USING (t) GROUP BY ALL),
f1 AS (SELECT item_id, doc_id, round(2.0 * c / (len(qsets.s) + len(sets.s)), 6) AS score FROM shared JOIN sets USING (doc_id) JOIN qsets USING (item_id)),
dn AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f1 QUALIFY rank <= 10)""".format(d=T, q=T)

FUSED = """
fusedall AS (
  SELECT coalesce(dn.item_id, bm.item_id) AS item_id, coalesce(dn.doc_id, bm.doc_id) AS doc_id, dn.rank AS ra, bm.rank AS rb,
         round(coalesce(1.0::DOUBLE / (60 + dn.rank), 0) + coalesce(1.0::DOUBLE / (60 + bm.rank), 0), 8) AS rrf
  FROM dn FULL JOIN bm ON dn.item_id = bm.item_id AND dn.doc_id = bm.doc_id),
fused AS (SELECT item_id, doc_id, rrf, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, ra NULLS LAST, rb NULLS LAST) AS rank FROM fusedall QUALIFY rank <= 5)"""

GOLD = "gold AS (SELECT item_id, list(doc_id ORDER BY doc_id) AS gold FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id)"


@query(f"WITH {BM25} SELECT item_id, doc_id, score, rank FROM bm")
def bm25_topk(t):
    return r.bm25(t("documents"), t("benchmark"), 10).select("item_id", "doc_id", "score", "rank")


@query(f"""WITH {BM25}, hits AS (SELECT item_id, doc_id, score FROM scored QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20),
first AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 40),
fill AS (SELECT item_id, doc_id, 0.0::DOUBLE AS score FROM benchmark CROSS JOIN first ANTI JOIN hits USING (item_id, doc_id)),
everything AS (SELECT * FROM hits UNION ALL SELECT * FROM fill)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM everything QUALIFY rank <= 20""")
def bm25_zero_fill(t):
    """Every hit of the list stays; only the places without one are filled."""
    hits = r.bm25(t("documents"), t("benchmark"), 20)
    return r.zero_filled(hits, t("documents"), t("benchmark"), 20).select("item_id", "doc_id", "score", "rank")


def overlap_rank(t, k: int = 10):
    """Documents by token F1 with a question, counted by blocks of questions; no row is made of a pair that only shares a token."""
    sets = t("documents").select("doc_id", text.token_set(F.col("text")).alias("terms"))
    qsets = t("benchmark").select("item_id", text.token_set(F.col("text")).alias("terms"))

    def f1(counts, weights, lengths, block):
        common = (counts > 0).astype(float) @ weights
        return blocks.rounded(2.0 * common / (block.sizes + lengths[:, None]).clip(1)), common > 0

    return r.top(blocks.best(sets, qsets, f1, k), "score", k)


NEAR = """
base AS (SELECT b.item_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score, round(0.3 + 0.7 * ((v.vec_id % 29) / 28.0::DOUBLE), 4) AS weight
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings v WHERE v.vec_id IN (SELECT doc_id FROM documents)),
ord AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM base QUALIFY n <= 10),
walk AS (SELECT item_id, n, doc_id, score, weight, score AS anchor FROM ord WHERE n = 1
 UNION ALL SELECT o.item_id, o.n, o.doc_id, o.score, o.weight, CASE WHEN w.anchor - o.score < 0.02::DOUBLE THEN w.anchor ELSE o.score END FROM walk w JOIN ord o ON o.item_id = w.item_id AND o.n = w.n + 1),
dn AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY anchor DESC, weight DESC, score DESC, doc_id) AS rank FROM walk)"""
INDEXED = BM25.replace("FROM documents", "FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")


def chunk_store(t):
    """Documents with their vectors and recency weights, and the benchmark's passages with theirs as questions."""
    v = t("embeddings").select("vec_id", "embedding")
    chunks = t("documents").select("doc_id", "text", text.recency_weight(F.lit(1998) + F.col("doc_id") % 29).alias("weight")).join(v.withColumnRenamed("vec_id", "doc_id"), "doc_id")
    return chunks, t("benchmark").select("item_id", "text").join(v.withColumnRenamed("vec_id", "item_id"), "item_id", "left")


@query(f"WITH RECURSIVE {INDEXED}, {NEAR}, {FUSED} SELECT item_id, doc_id, rrf, rank FROM fused")
def rrf_fusion(t):
    """Neighbours by cosine, newest first among near ties, fused with BM25 hits."""
    return r.hybrid(*chunk_store(t), 5).select("item_id", "doc_id", "rrf", "rank")


@query(f"""WITH RECURSIVE {INDEXED}, {NEAR}, {FUSED}
SELECT item_id, doc_id, fused.rank AS rank, round(dn.score, 4) AS cosine, round(round(dn.score * round(0.3 + 0.7 * ((doc_id % 29) / 28.0::DOUBLE), 4), 6), 4) AS recency_adj, rrf
FROM fused LEFT JOIN dn USING (item_id, doc_id)""")
def score_triple(t):
    return r.hybrid(*chunk_store(t), 5)


@query("""WITH q AS (SELECT vec_id AS item_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
p AS (SELECT item_id, vec_id AS doc_id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) AS cosine FROM embeddings, q WHERE vec_id <> item_id AND label IN (1, 4, 7))
SELECT item_id, doc_id, cosine, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, doc_id) AS rank FROM p QUALIFY rank <= 20""")
def filtered_neighbours(t):
    """The 20 nearest among the labels asked for, which are filtered at the scan."""
    v = t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return r.dense(v, t("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("item_id"), "embedding"), 20, F.col("label").isin(1, 4, 7))


@query("""WITH q AS (SELECT vec_id AS item_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
p AS (SELECT item_id, vec_id AS doc_id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) AS cosine FROM embeddings, q WHERE vec_id <> item_id)
SELECT item_id, doc_id, cosine, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, doc_id) AS rank FROM p QUALIFY rank <= 10""")
def dense_knn_cosine(t):
    v = t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return r.dense(v, t("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("item_id"), "embedding"), 10)


@query("SELECT vec_id, round(greatest(0.0, 1.0 - label / 7.0::DOUBLE), 6) AS similarity FROM embeddings")
def distance_similarity(t):
    return t("embeddings").select("vec_id", r.similarity(F.col("label") / F.lit(7.0)).alias("similarity"))


@query("""WITH RECURSIVE base AS (SELECT doc_id % 37 AS item_id, doc_id, round((doc_id * 7919 % 1000) / 1000.0::DOUBLE, 3) AS score, round(0.3 + 0.7 * ((doc_id % 29) / 28.0::DOUBLE), 4) AS weight FROM documents),
ord AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM base QUALIFY n <= 20),
walk AS (SELECT item_id, n, doc_id, score, weight, score AS anchor FROM ord WHERE n = 1
 UNION ALL SELECT o.item_id, o.n, o.doc_id, o.score, o.weight, CASE WHEN w.anchor - o.score < 0.02::DOUBLE THEN w.anchor ELSE o.score END FROM walk w JOIN ord o ON o.item_id = w.item_id AND o.n = w.n + 1)
SELECT item_id, doc_id, score, weight, row_number() OVER (PARTITION BY item_id ORDER BY anchor DESC, weight DESC, score DESC, doc_id) AS rank FROM walk QUALIFY rank <= 5""")
def tie_bucket_rerank(t):
    d = t("documents").select((F.col("doc_id") % 37).alias("item_id"), "doc_id", F.round(F.col("doc_id") * 7919 % 1000 / F.lit(1000.0), 3).alias("score"), text.recency_weight(F.lit(1998) + F.col("doc_id") % 29).alias("weight"))
    return r.rerank(r.top(d, "score", 20), 5).select("item_id", "doc_id", "score", "weight", "rank")


def gold(t):
    """Documents that contain a question's passage."""
    found = textmatch.containing(t("benchmark").select("item_id", "text"), t("documents").select("doc_id", "text"), exact=True)
    return found.groupBy("item_id").agg(F.array_sort(F.collect_list("doc_id")).alias("gold"))


@query(f"""WITH {BM25}, {GOLD}, got AS (SELECT item_id, list(doc_id ORDER BY rank) AS got FROM bm GROUP BY item_id),
hit AS (SELECT item_id, unnest(got) AS doc_id, generate_subscripts(got, 1) AS i, gold FROM got JOIN gold USING (item_id)),
s AS (SELECT item_id, any_value(gold) AS gold, count(*) FILTER (list_contains(gold, doc_id) AND i <= 5) AS h5, count(*) FILTER (i <= 5) AS n5, min(i) FILTER (list_contains(gold, doc_id)) AS f,
 sum(CASE WHEN list_contains(gold, doc_id) AND i <= 5 THEN 1.0::DOUBLE / log2(i + 1) ELSE 0 END) AS dcg FROM hit GROUP BY item_id)
SELECT item_id, h5::DOUBLE / len(gold) AS recall_5, h5::DOUBLE / n5 AS precision_5, coalesce(1.0::DOUBLE / f, 0) AS mrr,
 round(dcg / list_sum(list_transform(range(1, least(len(gold), 5) + 1), lambda n: 1.0::DOUBLE / log2(n + 1))), 4) AS ndcg_5 FROM s""")
def retrieval_metrics(t):
    got = r.bm25(t("documents"), t("benchmark"), 10).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("g"))
    rows = got.select("item_id", F.transform("g", lambda x: x["doc_id"]).alias("got")).join(gold(t), "item_id")
    g, k = F.col("got"), F.col("gold")
    return rows.select("item_id", metrics.recall_at(g, k, 5).alias("recall_5"), metrics.precision_at(g, k, 5).alias("precision_5"), metrics.reciprocal_rank(g, k).alias("mrr"), metrics.ndcg_at(g, k, 5).alias("ndcg_5"))


PAIRS = "pairs AS (SELECT u.conv_id, u.turn, u.text AS p, a.text AS r FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)"
PSETS = f"{PAIRS}, sets AS (SELECT conv_id, turn, list_distinct({TOK.format('p')}) AS a, list_distinct({TOK.format('r')}) AS b FROM pairs), n AS (SELECT *, len(list_intersect(a, b))::DOUBLE AS c FROM sets)"


def pairs(t):
    u, a = t("conversations"), t("conversations")
    a = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r"))
    return u.select("conv_id", "turn", F.col("text").alias("p")).join(a, ["conv_id", "turn"])


@query(f"""WITH {PSETS} SELECT conv_id, turn, round(CASE WHEN c = 0 THEN 0 ELSE 2 * c / (len(a) + len(b)) END, 6) AS f1,
round(CASE WHEN len(b) = 0 THEN 0 ELSE c / len(b) END, 6) AS overlap_a, round(CASE WHEN len(a) = 0 THEN 0 ELSE c / len(a) END, 6) AS overlap_b,
round(100 * CASE WHEN len(a) = 0 THEN 0 ELSE c / len(a) END) >= 80 AS accepted FROM n""")
def token_overlaps(t):
    p, q = F.col("p"), F.col("r")
    return pairs(t).select("conv_id", "turn", F.round(metrics.token_f1(p, q), 6).alias("f1"), F.round(metrics.share_of_second(p, q), 6).alias("overlap_a"), F.round(metrics.share_of_first(p, q), 6).alias("overlap_b"), metrics.coverage_accepted(p, q).alias("accepted"))


@query()
def lexical_metrics(t):
    p = [F.col("p"), F.col("r")]
    return pairs(t).select("conv_id", "turn", lexical.bleu_column(*p).alias("bleu"), lexical.rouge_1_column(*p).alias("rouge_1"), lexical.rouge_2_column(*p).alias("rouge_2"), lexical.rouge_l_column(*p).alias("rouge_l"), lexical.meteor_column(*p).alias("meteor"))


@query("""SELECT conv_id, substr(string_agg(text, ' ' ORDER BY turn) FILTER (trim(text) <> ''), 1, 3000) AS context FROM conversations GROUP BY conv_id HAVING count(*) FILTER (trim(text) <> '') > 0""")
def context_build(t):
    rows = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    out = rows.select("conv_id", metrics.context(F.transform("x", lambda x: x["text"])).alias("context"))
    return out.where("context <> ''")


@query(f"""WITH {BM25}, {OVERLAP}, a AS (SELECT item_id, doc_id, rank FROM bm WHERE rank <= 5 UNION ALL SELECT item_id, doc_id, rank FROM dn WHERE rank <= 5)
SELECT item_id, doc_id, min(rank) AS first_rank, count(*) AS systems FROM a GROUP BY item_id, doc_id""")
def pooled_candidates(t):
    both = r.bm25(t("documents"), t("benchmark"), 5).select("item_id", "doc_id", "rank").unionByName(overlap_rank(t, 5).select("item_id", "doc_id", "rank"))
    return both.groupBy("item_id", "doc_id").agg(F.min("rank").alias("first_rank"), F.count(F.lit(1)).alias("systems"))


@query(f"""WITH {BM25}, {GOLD}, got AS (SELECT item_id, min(rank) FILTER (list_contains(gold, doc_id)) AS f FROM bm JOIN gold USING (item_id) GROUP BY item_id)
SELECT count(*) AS questions, round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) AS mean_mrr, round(avg(CASE WHEN f <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_5 FROM got""")
def flagship_mean_mrr(t):
    hits = r.bm25(t("documents"), t("benchmark"), 10).join(gold(t), "item_id")
    first = hits.groupBy("item_id").agg(F.min(F.when(F.array_contains("gold", F.col("doc_id")), F.col("rank"))).alias("f"))
    return first.agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("f"), F.lit(0.0))), 6).alias("mean_mrr"), F.round(F.avg(F.when(F.col("f") <= 5, 1.0).otherwise(0.0)), 6).alias("hit_5"))
