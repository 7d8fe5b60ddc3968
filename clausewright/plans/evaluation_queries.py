"""Evaluation rows, layout and question synthesis over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics, text
from ..functions.predicates import blank
from ..operators import evaluation as e
from ..operators import gold as g
from ..operators import layout, retrieval
from .registry import query
from .retrieval_queries import BM25, GOLD, TOK, gold


@query("""SELECT l.doc_id, l.quality, md5(d.text) AS answer FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic = 0 AND trim(d.text) <> ''""")
def gold_join(t):
    answers = t("documents").join(t("labels").select("doc_id", "toxic"), "doc_id").select("doc_id", F.when(F.col("toxic") == 0, F.col("text")).otherwise(" Error ").alias("answer"))
    return e.answered_pairs(t("labels").select("doc_id", "quality"), answers, "doc_id").withColumn("answer", F.md5("answer"))


@query(f"""WITH {GOLD} SELECT item_id, array_to_string(CASE WHEN item_id % 3 = 0 THEN ['c' || item_id] WHEN item_id % 3 = 1 THEN ['d', 'e'] ELSE coalesce(list_transform(gold, lambda x: x::VARCHAR), []) END, ',') AS ids FROM benchmark LEFT JOIN gold USING (item_id)""")
def gold_id_order(t):
    k, none = F.col("item_id") % 3, F.array().cast("array<string>")
    rows = t("benchmark").select("item_id").join(gold(t), "item_id", "left")
    first, second = F.when(k == 0, F.array(F.concat(F.lit("c"), "item_id"))).otherwise(none), F.when(k == 1, F.array(F.lit("d"), F.lit("e"))).otherwise(none)
    return rows.select("item_id", F.array_join(e.gold_ids(first, second, F.col("gold").cast("array<string>")), ",").alias("ids"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN value WHEN 2 THEN value ELSE 0.5 END AS kept FROM events""")
def selective_recompute(t):
    k = F.col("event_id") % 4
    previous = F.when(k == 0, "").when(k == 1, "0.0").when(k == 2, F.lit(None)).otherwise("0.5")
    return t("events").select("event_id", e.recomputed(previous, F.col("value")).alias("kept"))


@query(f"""WITH p AS (SELECT doc_id, text AS answer, CASE WHEN doc_id % 2 = 0 THEN ' none ' ELSE lang || ' ' || source END AS translated FROM documents)
SELECT doc_id, len(list_distinct({TOK.format("CASE WHEN doc_id % 2 = 0 THEN answer ELSE translated END")})) AS n, greatest((doc_id % 3) / 2.0::DOUBLE, (doc_id % 2) / 2.0::DOUBLE) AS citation FROM p""")
def cross_lingual_scoring(t):
    d = F.col("doc_id")
    read, cite = e.cross_lingual(F.col("text"), F.when(d % 2 == 0, " none ").otherwise(F.concat_ws(" ", "lang", "source")), d % 3 / F.lit(2.0), d % 2 / F.lit(2.0))
    return t("documents").select("doc_id", F.size(text.token_set(read)).alias("n"), cite.alias("citation"))


@query("""SELECT l.doc_id, d.source || '  ' || d.lang AS answer, CASE WHEN l.quality = 1 THEN l.toxic END AS judged, l.quality = 1 AS same FROM labels l JOIN documents d USING (doc_id)""")
def naive_seed(t):
    k = t("labels")
    single = t("documents").join(k, "doc_id").select("doc_id", F.concat("source", F.lit("  "), "lang").alias("answer"), F.col("toxic").alias("judged"))
    other = t("documents").join(k, "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit(" "), "source", F.lit("\n"), "lang")).otherwise("else").alias("answer"))
    return e.seeded(k, single, other, "doc_id", ["judged"])


@query("SELECT doc_id, source FROM documents WHERE lang = 'fr' AND contains(source, 'rc1')")
def dashboard_filter(t):
    d = t("documents")
    return e.dashboard_rows(d, {e.pick_column(d, ["language", "LANG"]): "FR"}, {"source": "RC1"}).select("doc_id", "source")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 3 <> 0) AS with_answer, count(*) FILTER (event_id % 3 <> 0 AND (event_id % 5 <> 0 OR value > 50)) AS normalised FROM events GROUP BY event_type")
def completeness_counts(t):
    k = F.col("event_id")
    answer, top = F.when(k % 3 != 0, "x").otherwise("nan"), F.when(k % 5 != 0, "c")
    ok = e.normalised(answer, top, F.lit(0.0), F.when(F.col("value") > 50, 1.0))
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(~blank(answer)).alias("with_answer"), F.count_if(ok).alias("normalised"))


@query("""SELECT 'q' || (doc_id % 50) AS question_id, (doc_id // 50)::VARCHAR AS system, quality::VARCHAR AS fit_1, toxic::VARCHAR AS fit_2 FROM labels""")
def annotation_routing(t):
    k = t("labels")
    key = k.select(F.concat(F.lit("H"), "doc_id").alias("item_id"), F.concat(F.lit("q"), F.col("doc_id") % 50).alias("question_id"), F.floor(F.col("doc_id") / 50).cast("string").alias("system"))
    sheets = k.select(F.concat(F.lit("H"), "doc_id").alias("item_id"), F.explode(F.array(F.struct(F.lit(1).alias("annotator"), F.col("quality").cast("string").alias("value")), F.struct(F.lit(2).alias("annotator"), F.col("toxic").cast("string").alias("value")))).alias("x"))
    return e.routed(key, sheets.select("item_id", "x.annotator", F.lit("fit").alias("judgment"), "x.value"))


@query("""WITH c AS (SELECT doc_id, lang, unnest([doc_id % 17, doc_id % 23]) AS clause FROM documents), q AS (SELECT item_id, item_id % 19 AS clause FROM benchmark)
SELECT lang AS edition, count(DISTINCT doc_id) AS n_chunks, count(DISTINCT item_id) AS n_questions FROM c JOIN q USING (clause) GROUP BY lang""")
def clause_chunk_index(t):
    chunks = t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("edition"), F.array(F.col("doc_id") % 17, F.col("doc_id") % 23).alias("clauses"))
    return e.citing_chunks(chunks, t("benchmark").select(F.col("item_id").alias("question_id"), (F.col("item_id") % 19).alias("clause")))


@query()
def qa_candidates(t):
    return e.question_candidates(t("documents"), 40)


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
s AS (SELECT doc_id, k, trim(x) AS line, trim(x) = '' OR regexp_matches(trim(x), '^(?:ARTICLE|Article)\s+\d+') AS stop FROM p),
r AS (SELECT *, count(*) FILTER (stop) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM s),
b AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, run ORDER BY k) - 1) // 8 AS part FROM r WHERE NOT stop),
whole AS (SELECT doc_id, string_agg(line, ' ' ORDER BY k) AS paragraph FROM b GROUP BY doc_id, run, part)
SELECT doc_id, count(*) FILTER (length(paragraph) > 80) AS n, coalesce(sum(length(paragraph)) FILTER (length(paragraph) > 80), 0)::BIGINT AS n_chars
FROM documents LEFT JOIN whole USING (doc_id) GROUP BY doc_id""")
def paragraph_reconstruction(t):
    """Paragraphs of up to eight lines; a blank line or a heading ends one."""
    rows = t("documents").select("doc_id", e.paragraphs(F.split("text", "\n")).alias("p"))
    chars = F.aggregate("p", F.lit(0).cast("bigint"), lambda n, p: n + F.length(p))
    return rows.select("doc_id", F.greatest(F.size("p"), F.lit(0)).cast("bigint").alias("n"), F.coalesce(chars, F.lit(0).cast("bigint")).alias("n_chars"))


@query("SELECT event_id, round(value, 2) AS latency, event_id % 7 = 0 AS failed FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE value END AS value FROM events)")
def telemetry_columns(t):
    x = e.telemetry(F.when(F.col("event_id") % 7 != 0, F.col("value")), F.col("value"), F.lit("local"))
    return t("events").select("event_id", x.alias("x")).select("event_id", F.col("x.e2e_latency_s").alias("latency"), "x.failed")


ASKED = BM25.replace("FROM documents", "FROM documents WHERE lang IN ('en', 'fr')")


@query(f"""WITH {ASKED}, near AS (SELECT item_id, doc_id FROM scored QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20),
sets AS (SELECT doc_id, list_distinct({TOK.format('text')}) AS s FROM documents), qs AS (SELECT item_id, list_distinct({TOK.format('text')}) AS s FROM benchmark),
o AS (SELECT item_id, doc_id, round(len(list_intersect(qs.s, sets.s))::DOUBLE / len(qs.s), 6) AS overlap FROM near JOIN qs USING (item_id) JOIN sets USING (doc_id))
SELECT item_id, doc_id, overlap, round(100 * overlap) >= 80 AS accepted FROM o WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) = 1""")
def gold_finder(t):
    """The best of the 20 nearest among the languages asked for, which are filtered first."""
    return _gold_chunks(t, retrieval.bm25(t("documents").where(F.col("lang").isin("en", "fr")), t("benchmark"), 20))


def _gold_chunks(t, hits):
    near = hits.select("item_id", "doc_id")
    d = t("documents").where(F.col("lang").isin("en", "fr")).select("doc_id", text.token_set(F.col("text")).alias("c"))
    q = t("benchmark").select("item_id", text.token_set(F.col("text")).alias("q"))
    share = F.round(F.size(F.array_intersect("q", "c")) / F.size("q"), 6)
    best = g.best_chunk(near.join(d, "doc_id").join(q, "item_id").select("item_id", "doc_id", share.alias("overlap")))
    return best.withColumn("accepted", F.round(100 * F.col("overlap")) >= 80)


@query(f"""WITH {BM25}, {GOLD}, w AS (SELECT item_id, list(doc_id ORDER BY rank) FILTER (rank <= 2) AS got FROM bm GROUP BY item_id), r AS (SELECT item_id, CASE WHEN list_has_any(w.got, gold) THEN w.got ELSE (SELECT list(doc_id ORDER BY rank) FROM bm WHERE bm.item_id = w.item_id) END AS got, gold FROM w JOIN gold USING (item_id))
SELECT item_id, len(list_intersect(list_slice(got, 1, 5), gold))::DOUBLE / len(gold) AS recall_5 FROM r""")
def zero_metric_rescue(t):
    hits = retrieval.bm25(t("documents"), t("benchmark"), 10)
    ids = lambda k, name: hits.where(F.col("rank") <= k).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("x")).select("item_id", F.transform("x", lambda v: v["doc_id"]).alias(name))
    rows = ids(2, "few").join(gold(t), "item_id")
    lost = rows.where(metrics.reciprocal_rank(F.col("few"), F.col("gold")) == 0).join(ids(10, "got"), "item_id").select("item_id", "got", "gold")
    found = rows.where(metrics.reciprocal_rank(F.col("few"), F.col("gold")) > 0).select("item_id", F.col("few").alias("got"), "gold")
    return found.unionByName(lost).select("item_id", metrics.recall_at(F.col("got"), F.col("gold"), 5).alias("recall_5"))


@query()
def side_by_side_columns(t):
    words = t("documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("n", "word"))
    row, slot = F.floor(F.col("n") / 8) % 40, F.col("n") % 8
    placed = words.select("doc_id", (F.floor(F.col("n") / 320) + 1).cast("int").alias("page_no"), "word", (slot * 60.0).alias("x0"), (slot * 60.0 + 50).alias("x1"), (row * 12.0 + slot % 3).alias("y"), F.lit(480.0).alias("width"))
    return layout.paired_columns(layout.column_lines(placed))
