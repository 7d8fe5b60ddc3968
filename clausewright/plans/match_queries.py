"""Resolving texts to chunks and rescoring what was lost, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexical, metrics
from ..functions.text import recency_weight
from ..operators import gold as g
from ..operators import retrieval, textindex, textmatch
from ..sources import chunk_store as store
from ..sources.files import kept, scratch
from .registry import query
from .retrieval_queries import BM25, FUSED, GOLD, INDEXED, NEAR, PAIRS, TOK, chunk_store, gold, pairs

BARE = "regexp_replace(lower({}), '^\\s+|\\s+$', '', 'g')"
CHUNKS = "chunks AS (SELECT doc_id, lower(text) AS c FROM documents)"


@query(f"""WITH q AS (SELECT item_id, {BARE.format('text')} AS q FROM benchmark), {CHUNKS},
whole AS (SELECT item_id, min(doc_id) AS doc_id FROM q JOIN chunks ON contains(c, q) WHERE q <> '' GROUP BY item_id),
qs AS (SELECT item_id, list_distinct({TOK.format('q')}) AS s FROM q ANTI JOIN whole USING (item_id)), cs AS (SELECT doc_id, list_distinct({TOK.format('c')}) AS s FROM chunks),
o AS (SELECT item_id, doc_id, count(*)::DOUBLE / any_value(n) AS overlap FROM (SELECT item_id, len(s) AS n, unnest(s) AS t FROM qs) JOIN (SELECT doc_id, unnest(s) AS t FROM cs) USING (t) GROUP BY ALL)
SELECT item_id, doc_id, 'contained' AS how, 1.0::DOUBLE AS overlap FROM whole UNION ALL
SELECT item_id, doc_id, 'overlap', round(overlap, 6) FROM o WHERE overlap > 0.5 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) = 1""")
def repair_by_text(t):
    """The first document that contains a passage, else the one with the best overlap above one half."""
    found = textmatch.repaired(t("benchmark").select("item_id", "text"), t("documents").select("doc_id", "text"))
    return found.withColumn("overlap", F.round("overlap", 6))


@query(f"""WITH {BM25}, {GOLD}, {CHUNKS}, old AS (SELECT item_id, rank, CASE WHEN item_id % 2 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS id, doc_id FROM bm WHERE rank <= 5),
got AS (SELECT item_id, list(id ORDER BY rank) AS got, any_value(gold) AS gold FROM old JOIN gold USING (item_id) GROUP BY item_id),
src AS (SELECT item_id, rank, {BARE.format('substr(text, 1, 500)')} AS q FROM old JOIN documents USING (doc_id) JOIN got USING (item_id) WHERE NOT list_has_any(got, gold)),
whole AS (SELECT item_id, rank, min(doc_id) AS doc_id FROM src JOIN chunks ON contains(c, q) WHERE q <> '' GROUP BY ALL),
new AS (SELECT item_id, list(doc_id ORDER BY rank) AS got FROM whole GROUP BY item_id),
final AS (SELECT got.item_id, coalesce(new.got, got.got) AS got, gold, new.item_id IS NOT NULL AS repaired FROM got LEFT JOIN new USING (item_id)),
hit AS (SELECT item_id, repaired, gold, unnest(got) AS id, generate_subscripts(got, 1) AS i FROM final)
SELECT item_id, any_value(repaired) AS repaired, coalesce(1.0::DOUBLE / min(i) FILTER (list_contains(gold, id)), 0) AS mrr, count(DISTINCT id) FILTER (list_contains(gold, id) AND i <= 5)::DOUBLE / len(any_value(gold)) AS recall_5 FROM hit GROUP BY item_id""")
def zero_metric_repair(t):
    """Ids of a former store score zero; the texts beside them are resolved against the documents, and scored again."""
    hits = retrieval.bm25(t("documents"), t("benchmark"), 5).select("item_id", "rank", "doc_id")
    stale = F.when(F.col("item_id") % 2 == 0, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id"))
    lists = hits.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", stale.alias("id")))).alias("x"))
    rows = lists.select("item_id", F.transform("x", lambda v: v["id"]).alias("got")).join(gold(t), "item_id")
    sources = hits.join(t("documents").select("doc_id", F.substr("text", F.lit(1), F.lit(500)).alias("text")), "doc_id").select("item_id", "rank", "text")
    got, want = F.col("got"), F.col("gold")
    lost = (metrics.reciprocal_rank(got, want) == 0) & (metrics.ndcg_at(got, want, 5) == 0)
    new = textmatch.rescued(rows.withColumn("before", got), sources, t("documents").select("doc_id", "text"), lost)
    return new.select("item_id", (got != F.col("before")).alias("repaired"), metrics.reciprocal_rank(got, want).alias("mrr"), metrics.recall_at(got, want, 5).alias("recall_5"))


@query(f"WITH {BM25} SELECT item_id, doc_id, score, rank FROM bm")
def bm25_index_topk(t):
    """The lists of `bm25_topk` from a stored index."""
    spark = t("documents").sparkSession
    index = textindex.Index(spark, scratch(spark))
    textindex.append(index, t("documents"))
    return textindex.search(index, t("benchmark"), 10)


@query(f"WITH {BM25} SELECT item_id, doc_id, score, rank FROM bm")
def bm25_index_append(t):
    """The same from an index to which every source was added in turn, the last one twice."""
    docs = t("documents")
    index = textindex.Index(docs.sparkSession, scratch(docs.sparkSession))
    kind = F.pmod(F.xxhash64("source"), F.lit(2))
    for part in (docs.where(kind == 0), docs.where((kind != 0) | F.col("source").isNull()), docs):
        textindex.append(index, part)
    return textindex.search(index, t("benchmark"), 10)


@query(f"WITH RECURSIVE {INDEXED}, {NEAR}, {FUSED} SELECT item_id, doc_id, rrf, rank FROM fused")
def hybrid_resume(t):
    """Retrieval that stopped after the even questions, taken up again."""
    chunks, questions = chunk_store(t)
    find = lambda q: retrieval.hybrid(chunks, q, 5).select("item_id", "doc_id", "rrf", "rank")
    stored = kept(find(questions.where("item_id % 2 = 0")))
    return textindex.resumed(questions, stored, find)


def _stored(t):
    """Documents and their vectors written to a chunk store, French ones then again with another text."""
    d = t("documents")
    path = scratch(d.sparkSession)
    rows = d.join(t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("lang").alias("language"), (F.col("doc_id") % 7).cast("string").alias("article_number"), "text", "embedding",
        recency_weight(F.lit(1998) + F.col("doc_id") % 29).alias("recency_weight"), F.col("n_chars").cast("int").alias("token_count"),
    )
    store.write(rows, path)
    store.write(rows.where("language = 'fr'").withColumn("text", F.concat(F.lit("fr: "), "text")), path)
    store.upsert(d.sparkSession, rows.where("chunk_id = '3'").withColumn("text", F.lit("three")), path)
    return path


@query("""SELECT doc_id::VARCHAR AS chunk_id, lang AS language, (doc_id % 7)::VARCHAR AS article_number, md5(CASE WHEN doc_id = 3 THEN 'three' WHEN lang = 'fr' THEN 'fr: ' || text ELSE text END) AS body,
round(0.3 + 0.7 * ((doc_id % 29) / 28.0::DOUBLE), 4) AS recency_weight, coalesce(len(embedding), 0)::INTEGER AS dim FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE lang IS NOT NULL""")
def chunk_store_round_trip(t):
    rows = store.read(t("documents").sparkSession, _stored(t))
    return rows.select("chunk_id", "language", "article_number", F.md5("text").alias("body"), "recency_weight", F.greatest(F.size("embedding"), F.lit(0)).alias("dim"))


@query("SELECT lang AS language, count(*) AS n, min(doc_id) AS first FROM documents WHERE lang IN ('fr', 'en') AND doc_id % 7 IN (2, 5) GROUP BY lang")
def chunk_store_filters(t):
    rows = store.read(t("documents").sparkSession, _stored(t), languages=["fr", "en"], articles=["2", "5"])
    return rows.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("chunk_id").cast("bigint")).alias("first"))


@query(f"""WITH q AS (SELECT b.item_id, b.text, CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'fr' END AS lang, CASE WHEN item_id % 3 = 0 THEN item_id % 7 END AS article, embedding AS v FROM benchmark b JOIN embeddings ON vec_id = item_id),
c AS (SELECT doc_id, lang, doc_id % 7 AS article, text, embedding AS v FROM documents JOIN embeddings ON vec_id = doc_id),
near AS (SELECT item_id, doc_id FROM q JOIN c USING (lang) WHERE q.article IS NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(list_cosine_similarity(q.v::DOUBLE[], c.v::DOUBLE[]), 6) DESC, doc_id) <= 20),
pairs AS (SELECT item_id, doc_id FROM near UNION ALL SELECT item_id, doc_id FROM q JOIN c USING (lang, article)),
o AS (SELECT item_id, doc_id, round(len(list_intersect({TOK.format('q.text')}, {TOK.format('c.text')}))::DOUBLE / len(list_distinct({TOK.format('q.text')})), 6) AS overlap FROM pairs JOIN q USING (item_id) JOIN c USING (doc_id))
SELECT item_id, doc_id, overlap, round(100 * overlap) >= 80 AS accepted FROM o QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) = 1""")
def gold_finder_routes(t):
    """By article and language where a question names an article, else among the 20 nearest of its language."""
    v = t("embeddings").select("vec_id", "embedding")
    i = F.col("item_id")
    q = t("benchmark").join(v, i == F.col("vec_id")).select("item_id", F.col("text").alias("expected"), F.when(i % 2 == 0, "en").otherwise("fr").alias("language"), F.when(i % 3 == 0, i % 7).alias("article"), "embedding")
    c = t("documents").join(v, F.col("doc_id") == F.col("vec_id")).select("doc_id", F.col("lang").alias("language"), (F.col("doc_id") % 7).cast("string").alias("article_number"), "text", "embedding")
    return g.finder(q, c)


ASCII = "regexp_extract_all(lower({}), '[a-z0-9]+')"

def _rouge_sql() -> str:
    """Counts of n-grams a side, and twice what both share over what they have."""
    parts = []
    for n in (1, 2):
        m = n - 1
        parts.append(f"g{n} AS (SELECT conv_id, turn, side, g, count(*) AS c FROM (SELECT conv_id, turn, side, unnest(list_transform(range(1, len(w) - {m} + 1), lambda i: array_to_string(w[i:i + {m}], ' '))) AS g FROM sides WHERE len(w) > {m}) GROUP BY ALL)")
        parts.append(f"t{n} AS (SELECT conv_id, turn, sum(c) AS total FROM g{n} GROUP BY ALL)")
        parts.append(f"h{n} AS (SELECT conv_id, turn, sum(least(a.c, b.c)) AS hits FROM g{n} a JOIN g{n} b USING (conv_id, turn, g) WHERE a.side = 0 AND b.side = 1 GROUP BY ALL)")
    joins = " ".join(f"LEFT JOIN t{n} USING (conv_id, turn) LEFT JOIN h{n} USING (conv_id, turn)" for n in (1, 2))
    columns = ", ".join(f"coalesce(round(2.0::DOUBLE * hits / total, 4), 0) AS rouge_{n}".replace("hits", f"h{n}.hits").replace("total", f"t{n}.total") for n in (1, 2))
    sides = f"sides AS (SELECT conv_id, turn, 0 AS side, {ASCII.format('p')} AS w FROM pairs UNION ALL SELECT conv_id, turn, 1, {ASCII.format('r')} FROM pairs)"
    return f"WITH {PAIRS}, {sides}, {', '.join(parts)} SELECT conv_id, turn, {columns} FROM pairs {joins}"


@query(_rouge_sql())
def rouge_overlap(t):
    """ROUGE-1 and ROUGE-2 of a turn and the next one, without stems, in Column expressions."""
    p, q = lexical.ascii_tokens(F.col("p")), lexical.ascii_tokens(F.col("r"))
    return pairs(t).select("conv_id", "turn", lexical.rouge(p, q, 1).alias("rouge_1"), lexical.rouge(p, q, 2).alias("rouge_2"))
