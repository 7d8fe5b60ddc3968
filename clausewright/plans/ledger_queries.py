"""Ledger upkeep over ledgers that the test tables stand in for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import truthy
from ..operators import ledger as g
from ..sources.files import kept
from .registry import query

LEDGER = """led AS (SELECT event_id AS ord, 'q' || (event_id % 400) AS qid, event_type AS model, (event_id * 13 % 5)::VARCHAR AS attempts,
CASE event_id % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'false' ELSE '' END AS grounded, CASE WHEN event_id % 7 = 0 THEN '' ELSE (event_id % 11 / 10.0::DOUBLE)::VARCHAR END AS faith,
CASE WHEN event_id % 5 = 0 THEN 'nan' ELSE (event_id % 9 / 8.0::DOUBLE)::VARCHAR END AS relevance, (event_id % 4 / 4.0::DOUBLE) AS f1, (event_id % 3 / 2.0::DOUBLE) AS mrr FROM events)"""


def led(t):
    e = F.col("event_id")
    return t("events").select(
        e.alias("ord"),
        F.concat(F.lit("q"), e % 400).alias("qid"),
        F.col("event_type").alias("model"),
        (e * 13 % 5).cast("string").alias("attempts"),
        F.when(e % 3 == 0, "True").when(e % 3 == 1, "false").otherwise("").alias("grounded"),
        F.when(e % 7 == 0, "").otherwise((e % 11 / F.lit(10.0)).cast("string")).alias("faith"),
        F.when(e % 5 == 0, "nan").otherwise((e % 9 / F.lit(8.0)).cast("string")).alias("relevance"),
        (e % 4 / F.lit(4.0)).alias("f1"),
        (e % 3 / F.lit(2.0)).alias("mrr"),
    )


def _args():
    return [F.col(c) for c in ("attempts", "grounded", "faith", "relevance", "f1", "mrr")]


N = "CASE WHEN NOT isnan(try_cast({0} AS DOUBLE)) THEN try_cast({0} AS DOUBLE) END"
SURE = "coalesce(lower(trim(grounded)) = 'true', false)"
ATT, FA, RE = (f"({N.format(c)})" for c in ("attempts", "faith", "relevance"))
REASON = f"""CASE WHEN coalesce({ATT}, 0) > 2 AND NOT {SURE} THEN 'ungrounded after retries' WHEN {SURE} AND coalesce({FA}, 1) < 0.4::DOUBLE THEN 'grounded but unfaithful' WHEN mrr > 0 AND f1 = 0 THEN 'retrieved but no overlap'
WHEN coalesce({ATT}, 0) >= 2 AND coalesce({RE}, 1) < 0.4::DOUBLE THEN 'irrelevant after retry' END"""
ANY = f"((coalesce({ATT}, 0) > 2 AND NOT {SURE}) OR ({SURE} AND coalesce({FA}, 0) < 0.4::DOUBLE) OR (mrr > 0 AND f1 = 0) OR (coalesce({ATT}, 0) >= 2 AND coalesce({RE}, 0) < 0.4::DOUBLE))"


@query(f"WITH {LEDGER} SELECT ord, {REASON} AS reason, {ANY} AS any_rule FROM led")
def invalidation_rules(t):
    return led(t).select("ord", g.invalid_reason(*_args()).alias("reason"), g.invalid_any(*_args()).alias("any_rule"))


@query(f"WITH {LEDGER} SELECT qid, model, ord, f1, mrr FROM led QUALIFY row_number() OVER (PARTITION BY qid, model ORDER BY ord DESC) = 1")
def dedup_keep_last(t):
    return g.keep_last(led(t), ["qid", "model"], "ord").select("qid", "model", "ord", "f1", "mrr")


@query(f"WITH {LEDGER}, x AS (SELECT *, {ANY} AS invalid, coalesce({FA}, 0) AS fa FROM led) SELECT qid, model, ord FROM x QUALIFY row_number() OVER (PARTITION BY qid, model ORDER BY invalid, f1 DESC, mrr DESC, fa DESC, ord DESC) = 1")
def dedup_keep_best(t):
    rows = led(t).withColumn("invalid", g.invalid_any(*_args())).withColumn("faith", F.coalesce(g.number(F.col("faith")), F.lit(0.0)))
    return g.keep_best(rows, ["qid", "model"], "ord").select("qid", "model", "ord")


@query(f"""WITH {LEDGER}, a AS (SELECT * FROM led QUALIFY row_number() OVER (PARTITION BY qid, model ORDER BY ord) = 1)
SELECT qid, model, ord FROM a QUALIFY row_number() OVER (PARTITION BY model, attempts, f1 ORDER BY ord) = 1""")
def dedup_keep_first(t):
    return g.keep_first(led(t), [["qid", "model"], ["model", "attempts", "f1"]], "ord").select("qid", "model", "ord")


@query("SELECT text, lang FROM (SELECT DISTINCT md5(text) AS text, lang FROM documents)")
def dedup_exact(t):
    return t("documents").select(F.md5("text").alias("text"), "lang").dropDuplicates()


@query("""SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def semi_filter(t):
    return t("documents").select("doc_id", "source").join(t("labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def anti_filter(t):
    return t("documents").select("doc_id", "source").join(t("labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("SELECT flag, count(*) AS n FROM (SELECT CASE WHEN doc_id % 5 IN (0, 1) THEN 'keep' WHEN doc_id % 5 = 2 THEN 'drop' ELSE 'undecided' END AS flag FROM documents) GROUP BY flag")
def three_way_flag(t):
    k = F.col("doc_id") % 5
    raw = F.when(k == 0, " Yes ").when(k == 1, "1.0").when(k == 2, "FALSE").when(k == 3, "").otherwise("maybe")
    return t("documents").select(g.flag_split(raw).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH base AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS note FROM documents), new AS (SELECT doc_id + 500 AS doc_id, 'xx' AS lang, CASE WHEN doc_id % 2 = 0 THEN 'new' END AS note FROM documents WHERE doc_id < 1000000)
SELECT coalesce(b.doc_id, n.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN n.lang ELSE b.lang END AS lang, coalesce(n.note, b.note) AS note FROM base b FULL JOIN new n ON b.doc_id = n.doc_id""")
def ledger_upsert(t):
    d = t("documents")
    base = d.select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("note"))
    new = d.select((F.col("doc_id") + 500).alias("doc_id"), F.lit("xx").alias("lang"), F.when(F.col("doc_id") % 2 == 0, "new").alias("note"))
    return g.upsert(base, new, ["doc_id"], ["note"])


LEFT = "l AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'nan' ELSE source END AS a, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS b FROM documents)"
RIGHT = "r AS (SELECT doc_id + 100 AS doc_id, 'q' || quality AS a, CASE WHEN toxic = 1 THEN NULL ELSE 't' END AS b FROM labels)"
FILL = "CASE WHEN l.{0} IS NULL OR l.{0} IN ('', 'nan') THEN r.{0} ELSE l.{0} END AS {0}"


def sides(t):
    d, k = F.col("doc_id"), t("labels")
    left = t("documents").select("doc_id", F.when(d % 3 == 0, "nan").otherwise(F.col("source")).alias("a"), F.when(d % 4 == 0, "").otherwise(F.col("lang")).alias("b"))
    right = k.select((d + 100).alias("doc_id"), F.concat(F.lit("q"), "quality").alias("a"), F.when(F.col("toxic") != 1, "t").alias("b"))
    return left, right


@query(f"WITH {LEFT}, {RIGHT} SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, {FILL.format('a')}, {FILL.format('b')}, CASE WHEN l.doc_id IS NULL THEN 'right' WHEN r.doc_id IS NULL THEN 'left' ELSE 'both' END AS origin FROM l FULL JOIN r ON l.doc_id = r.doc_id")
def ledger_sync(t):
    return g.sync(*sides(t), ["doc_id"], ["a", "b"])


@query(f"WITH {LEFT}, {RIGHT} SELECT l.doc_id, coalesce(r.a, l.a) AS a, coalesce(r.b, l.b) AS b FROM l LEFT JOIN r USING (doc_id)")
def ledger_reuse(t):
    left, right = sides(t)
    return g.reuse(left, right, ["doc_id"], ["a", "b"])


@query(f"WITH {LEFT}, {RIGHT} SELECT l.doc_id, {FILL.format('a')}, {FILL.format('b')} FROM l LEFT JOIN r USING (doc_id)")
def left_enrich(t):
    left, right = sides(t)
    return g.enrich(left, right, ["doc_id"], ["a", "b"])


@query("SELECT doc_id::VARCHAR AS qid, source AS model, '' AS added FROM documents UNION ALL SELECT conv_id::VARCHAR, '', role FROM conversations")
def align_and_append(t):
    ledger = t("documents").select(F.col("source").alias("model"), F.col("doc_id").cast("string").alias("qid"), F.col("lang").alias("stale"))
    rows = t("conversations").select(F.col("conv_id").cast("string").alias("qid"), F.col("role").alias("added"))
    return g.append(ledger, rows, ["qid", "model", "added"])


@query("SELECT vec_id, label::DOUBLE AS source1_cosine_score, '' AS extra FROM embeddings")
def schema_migration(t):
    old = t("embeddings").select("vec_id", F.col("label").cast("double").alias("source1_score"))
    return g.migrate(g.rename_legacy(old) if g.has_old_schema(old) else old, ["vec_id", "source1_cosine_score", "extra"])


@query("""WITH a AS (SELECT DISTINCT 'judge/' || o_orderpriority AS model, o_orderstatus AS status, o_custkey FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus <> 'F') SELECT model, status, count(*) AS n FROM a GROUP BY ALL""")
def union_reports(t):
    o = t("orders").select("o_orderpriority", "o_orderstatus", "o_custkey")
    parts = [o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus = 'F'")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).dropDuplicates()
    return every.select(F.concat_ws("/", F.lit("judge"), "o_orderpriority").alias("model"), F.col("o_orderstatus").alias("status")).groupBy("model", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LEDGER}, ids AS (SELECT DISTINCT qid FROM led), done AS (SELECT DISTINCT qid FROM led WHERE mrr > 0 OR f1 > 0), retried AS (SELECT DISTINCT qid FROM led WHERE {ATT} > 1)
SELECT 'both' AS what, count(*) AS n FROM (SELECT * FROM done INTERSECT SELECT * FROM retried) UNION ALL SELECT 'missing', count(*) FROM (SELECT * FROM ids EXCEPT SELECT * FROM done) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM done UNION SELECT * FROM retried)""")
def id_sets(t):
    x = led(t)
    ids, done, retried = x.select("qid").distinct(), x.where("mrr > 0 OR f1 > 0").select("qid").distinct(), x.where(g.number(F.col("attempts")) > 1).select("qid").distinct()
    count = lambda d, what: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return count(done.intersect(retried), "both").unionByName(count(ids.subtract(done), "missing")).unionByName(count(done.union(retried).distinct(), "either"))


@query(f"WITH {LEDGER} SELECT ord, CASE WHEN coalesce({ATT}, 0) > 1 THEN '' ELSE faith END AS faith, CASE WHEN coalesce({ATT}, 0) > 1 THEN '' ELSE relevance END AS relevance FROM led")
def retry_blanking(t):
    return g.blank_cells(led(t), F.coalesce(g.number(F.col("attempts")), F.lit(0.0)) > 1, ["faith", "relevance"]).select("ord", "faith", "relevance")


@query(f"WITH {LEDGER} SELECT ord, f1 > 0 AND ({ATT} < 2 OR {SURE}) AS generated, mrr > 0 OR f1 > 0 AS evaluated FROM led")
def resume_gates(t):
    a = g.number(F.col("attempts"))
    return led(t).select("ord", ((F.col("f1") > 0) & ((a < 2) | truthy(F.col("grounded"), ("true",)))).alias("generated"), ((F.col("mrr") > 0) | (F.col("f1") > 0)).alias("evaluated"))


@query("""SELECT vec_id, 'c' || label AS source1_id, round(embedding[1]::DOUBLE, 4) AS s1, 'c' || (label + 1) AS source2_id, round(embedding[2]::DOUBLE, 4) AS s2, CASE WHEN label % 2 = 0 THEN 2 ELSE 1 END AS n_back FROM embeddings""")
def sources_round_trip(t):
    node = lambda k: F.struct(F.concat(F.lit("c"), F.col("label") + k).alias("id"), F.get("embedding", F.lit(k)).cast("double").alias("cosine"), F.lit("text").alias("text"))
    flat = t("embeddings").select("vec_id", "label", *g.flat_sources(F.array(node(0), node(1)), 2))
    back = flat.withColumn("source2_id", F.when(F.col("label") % 2 == 0, F.col("source2_id")).otherwise("nan")).withColumns({"source1_adj": F.col("source1_cosine_score"), "source2_adj": F.col("source2_cosine_score")})
    n = F.size(g.nested_sources(back, 2))
    return back.select("vec_id", "source1_id", F.col("source1_cosine_score").alias("s1"), F.concat(F.lit("c"), F.col("label") + 1).alias("source2_id"), F.col("source2_cosine_score").alias("s2"), n.alias("n_back"))


@query("""SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type
ORDER BY CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 3 END DESC, event_id % 2 DESC, (event_id % 5 < 2) DESC, (event_id % 7 < 4) DESC, CASE WHEN event_id % 6 > 0 THEN event_id % 6 END ASC NULLS LAST, event_id) = 1""")
def dedup_best_retrieval(t):
    i = F.col("event_id")
    rows = t("events").select("event_id", "user_id", "event_type", F.when(i % 4 == 0, "").otherwise((i % 3).cast("string")).alias("source1_rrf_score"), (i % 2).alias("source2_recency_adjusted_cosine_score"))
    rows = rows.withColumns({"grounded": F.when(i % 5 == 0, " True").when(i % 5 == 1, "1").otherwise("no"), "answer": F.when(i % 7 < 4, "text").when(i % 7 == 4, "Error").when(i % 7 == 5, "nan"), "attempts": F.when(i % 6 > 0, (i % 6).cast("string")).otherwise("?")})
    return g.keep_best_retrieval(rows, ["user_id", "event_type"], "event_id").select("event_id", "user_id", "event_type")


TWO_WAY = """l AS (SELECT doc_id, 'test_' || lang || '_' || doc_id AS question_id, CASE WHEN doc_id % 3 = 0 THEN 'nan' ELSE source END AS answer, CASE doc_id % 4 WHEN 0 THEN 'English' WHEN 1 THEN '' ELSE lang END AS language FROM documents),
r AS (SELECT doc_id + 100 AS doc_id, 'test_en_' || (doc_id + 100) AS question_id, CASE WHEN quality = 1 THEN 'q' ELSE '' END AS answer, CASE WHEN toxic = 1 THEN 'FR' END AS language, CASE WHEN doc_id % 2 = 0 THEN 'own' ELSE ' none ' END AS reply FROM labels),
b AS (SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, coalesce(l.question_id, r.question_id) AS question_id, CASE WHEN l.doc_id IS NULL THEN 'right' WHEN r.doc_id IS NULL THEN 'left' ELSE 'both' END AS origin,
 l.answer AS la, r.answer AS ra, l.language AS ll, r.language AS rl, r.reply AS rr, coalesce(lower(trim(l.answer)), '') IN ('', 'nan', 'none') AS bla, coalesce(lower(trim(r.answer)), '') IN ('', 'nan', 'none') AS bra,
 coalesce(lower(trim(l.language)), '') IN ('', 'nan', 'none') AS bll, coalesce(lower(trim(r.language)), '') IN ('', 'nan', 'none') AS brl FROM l FULL JOIN r ON l.doc_id = r.doc_id),
f AS (SELECT *, CASE WHEN origin = 'right' OR (bla AND NOT bra) THEN ra ELSE la END AS answer, CASE WHEN origin = 'left' OR (bra AND NOT bla) THEN la ELSE ra END AS r_answer, CASE WHEN origin = 'right' OR (bll AND NOT brl) THEN rl ELSE ll END AS lang1, CASE WHEN origin = 'left' OR (brl AND NOT bll) THEN ll ELSE rl END AS lang2 FROM b)"""
FOLDED = "CASE WHEN lower(trim(coalesce({0}, ''))) IN ('en', 'english', 'eng') THEN 'en' WHEN lower(trim(coalesce({0}, ''))) IN ('fr', 'french', 'français', 'francais', 'fra') THEN 'fr' WHEN contains(question_id, '_fr') THEN 'fr' WHEN contains(question_id, '_en') THEN 'en' WHEN coalesce({0}, '') = '' THEN '' ELSE {0} END"


def two_way(t):
    d = F.col("doc_id")
    left = t("documents").select("doc_id", F.concat_ws("_", F.lit("test"), "lang", d.cast("string")).alias("question_id"), F.when(d % 3 == 0, "nan").otherwise(F.col("source")).alias("answer"), F.when(d % 4 == 0, "English").when(d % 4 == 1, "").otherwise(F.col("lang")).alias("language"))
    right = t("labels").select((d + 100).alias("doc_id"), F.concat(F.lit("test_en_"), d + 100).alias("question_id"), F.when(F.col("quality") == 1, "q").otherwise("").alias("answer"), F.when(F.col("toxic") == 1, "FR").alias("language"), F.when(d % 2 == 0, "own").otherwise(" none ").alias("reply"))
    left, right = left.withColumn("q", F.col("question_id")), right.withColumn("q", F.col("question_id"))
    rows, counters = g.two_way(left.drop("question_id"), right.drop("question_id"), ["doc_id"], ["q", "answer", "language"], {"reply": "answer"}, question="q")
    return kept(rows), counters


@query(f"""WITH {TWO_WAY} SELECT doc_id, origin, answer, r_answer, {FOLDED.format('lang1')} AS language, {FOLDED.format('lang2')} AS r_language, CASE WHEN coalesce(lower(trim(rr)), '') IN ('', 'nan', 'none') AND coalesce(lower(trim(r_answer)), '') NOT IN ('', 'nan', 'none') THEN r_answer ELSE rr END AS r_reply FROM f""")
def ledger_two_way(t):
    """Both ledgers filled from each other, languages normalised, mirrors filled."""
    return two_way(t)[0].select("doc_id", "origin", "answer", "r_answer", "language", "r_language", "r_reply")


@query(f"""WITH {TWO_WAY} SELECT sum((origin = 'both' AND bla AND NOT bra)::INT + (origin = 'both' AND bll AND NOT brl)::INT)::BIGINT AS filled_left, sum((origin = 'both' AND bra AND NOT bla)::INT + (origin = 'both' AND brl AND NOT bll)::INT)::BIGINT AS filled_right,
count(*) FILTER (origin = 'right') AS added_left, count(*) FILTER (origin = 'left') AS added_right, count(*) FILTER (coalesce(lang1, '') <> {FOLDED.format('lang1')}) AS language_fixed, count(*) AS rows FROM f""")
def ledger_two_way_counters(t):
    """What the synchronisation did, observed in the pass that wrote its rows."""
    rows, counters = two_way(t)
    names = ["filled_left", "filled_right", "added_left", "added_right", "language_fixed", "rows"]
    return rows.sparkSession.createDataFrame([tuple(int(counters.get[n]) for n in names)], ", ".join(f"{n} bigint" for n in names))
