"""Summaries, chunking, gold passages and samples over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import analysis as a
from ..operators import chunking, gold, sampling, textmatch
from .registry import query

TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


@query("SELECT event_type, round(avg(value), 4) AS mean FROM events WHERE event_type <> '' GROUP BY event_type")
def group_means_v1(t):
    return a.group_means(t("events"), "event_type", "value")


@query("SELECT CASE WHEN event_id % 9 = 0 THEN 'Unknown' ELSE event_type END AS grp, coalesce(round(avg(CASE WHEN event_id % 9 <> 1 THEN value END), 4), 0) AS mean FROM events GROUP BY 1")
def group_means_v2(t):
    e = t("events").select(F.when(F.col("event_id") % 9 == 0, " nan").otherwise(F.col("event_type")).alias("grp"), F.when(F.col("event_id") % 9 != 1, F.col("value")).alias("value"))
    return a.group_means_labelled(e, "grp", "value")


@query("""SELECT count(*) AS n, count(v) AS scored, round(avg(coalesce(v, 0)), 4) AS blank_as_zero, round(avg(v), 4) AS blank_left_out, count(*) FILTER (v > 50) AS high, round(avg((event_id % 3 = 0)::INT), 4) AS grounded
FROM (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS v FROM events)""")
def overall_means(t):
    e = t("events").withColumn("v", F.when(F.col("event_id") % 4 != 0, F.col("value")))
    return e.agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("scored"), F.round(F.avg(F.coalesce("v", F.lit(0.0))), 4).alias("blank_as_zero"), F.round(F.avg("v"), 4).alias("blank_left_out"), F.count_if(F.col("v") > 50).alias("high"), F.round(F.avg((F.col("event_id") % 3 == 0).cast("int")), 4).alias("grounded"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 2) AS mean, round(quantile_cont(value, 0.5), 2) AS median, round(quantile_cont(value, 0.95), 2) AS p95, max(value) AS peak, round(100 * avg((value < 60)::INT), 1) AS under FROM events GROUP BY event_type""")
def system_block(t):
    return a.latency_block(t("events"), "event_type", "value")


@query("""SELECT event_type, round(avg(value) FILTER (user_id % 2 = 0), 4) AS even_users, round(avg(value) FILTER (user_id % 2 = 1), 4) AS odd_users FROM events GROUP BY event_type""")
def conditional_means(t):
    when = lambda k: F.round(F.avg(F.when(F.col("user_id") % 2 == k, F.col("value"))), 4)
    return t("events").groupBy("event_type").agg(when(0).alias("even_users"), when(1).alias("odd_users"))


@query("""SELECT event_id, CASE WHEN NOT (j1 = 0 AND j2 = 0) THEN j1 END AS j1, CASE WHEN NOT (j1 = 0 AND j2 = 0) THEN j2 END AS j2 FROM (SELECT event_id, (event_id % 3)::DOUBLE AS j1, (event_id % 2)::DOUBLE AS j2 FROM events)""")
def unjudged_mask(t):
    j = (F.col("event_id") % 3).cast("double"), (F.col("event_id") % 2).cast("double")
    x, y = a.unjudged(*j)
    return t("events").select("event_id", x.alias("j1"), y.alias("j2"))




def users(t):
    return t("events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("v"))


@query("""WITH u AS (SELECT user_id, event_type, round(avg(value), 6) AS v FROM events GROUP BY ALL), p AS (SELECT x.v AS a, y.v AS b FROM u x JOIN u y USING (user_id) WHERE x.event_type = 'click' AND y.event_type = 'view')
SELECT count(*) AS n, round(avg(a), 4) AS mean_a, round(avg(b), 4) AS mean_b, round(avg(b - a), 4) AS delta, round(quantile_cont(b - a, 0.5), 4) AS median_delta, round(100 * count(*) / 426.0::DOUBLE, 1) AS coverage FROM p""")
def paired_delta(t):
    return a.paired(a.matched(users(t), "user_id", "event_type", "click", "view", "v"), 426)


@query("""WITH g AS (SELECT event_type, count(*) AS n, count(CASE WHEN user_id % 10 <> 0 THEN value END) AS scored, round(avg(CASE WHEN user_id % 10 <> 0 THEN value END), 4) AS mean FROM events GROUP BY event_type)
SELECT event_type, n, scored, CASE WHEN scored >= 0.9::DOUBLE * n THEN mean END AS mean, CASE WHEN scored >= 0.9::DOUBLE * n THEN 'OK' ELSE 'PARTIAL' END AS status FROM g""")
def retry_guard(t):
    e = t("events").select("event_type", F.when(F.col("user_id") % 10 != 0, F.col("value")).alias("value"))
    return a.guarded(e, "event_type", "value")


@query("""WITH c AS (SELECT quality AS a, 1 - toxic AS b, count(*) AS c FROM labels GROUP BY ALL), n AS (SELECT sum(c)::DOUBLE AS n, sum(CASE WHEN a = b THEN c ELSE 0 END)::DOUBLE AS same FROM c),
e AS (SELECT sum(x::DOUBLE * y) AS xy FROM (SELECT a AS l, sum(c) AS x FROM c GROUP BY a) JOIN (SELECT b AS l, sum(c) AS y FROM c GROUP BY b) USING (l)), k AS (SELECT n, same / n AS po, xy / (n * n) AS pe FROM n, e)
SELECT n::BIGINT AS n, round(po, 4) AS exact, round((po - pe) / (1 - pe), 4) AS kappa, (po - pe) / (1 - pe) >= 0.75 AS acceptable FROM k""")
def kappa_agreement(t):
    return a.agreement(t("labels").select("quality", (1 - F.col("toxic")).alias("b")), "quality", "b")


@query("""SELECT count(*) AS n, round(avg((quality = 1 - toxic)::INT), 4) AS exact, round(avg((quality < 1 - toxic)::INT), 4) AS harsher FROM labels""")
def metric_validation(t):
    q, h = F.col("quality"), 1 - F.col("toxic")
    return t("labels").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((q == h).cast("int")), 4).alias("exact"), F.round(F.avg((q < h).cast("int")), 4).alias("harsher"))


CHUNKS = "ch AS (SELECT lang, (doc_id % 43)::VARCHAR AS article, CASE WHEN doc_id % 3 = 0 THEN '0' ELSE source END AS clause, text, len(regexp_extract_all(text, '[^\\s]+')) AS tokens FROM documents)"
STATS = f"""WITH {CHUNKS}, s AS (SELECT lang, count(DISTINCT CASE WHEN article <> '0' THEN article END) AS articles, count(DISTINCT CASE WHEN clause <> '0' THEN clause END) AS clauses, count(*) AS chunks, round(avg(tokens))::BIGINT AS avg_tokens, min(tokens)::BIGINT AS min_tokens,
max(tokens)::BIGINT AS max_tokens, sum(tokens)::BIGINT AS total_tokens, count(*) FILTER (regexp_matches(text, '(?i)appendix|annexe|license')) AS appendix FROM ch GROUP BY lang)"""


def stats(t):
    d = F.col("doc_id")
    return a.corpus_stats(t("documents").select("lang", (d % 43).cast("string").alias("article"), F.when(d % 3 == 0, "0").otherwise(F.col("source")).alias("clause"), "text", text.token_count(F.col("text")).alias("tokens")), "lang")


@query(f"{STATS} SELECT * FROM s")
def corpus_stats_by_lang(t):
    return stats(t)


@query(f"""{STATS}, l AS (UNPIVOT s ON articles, clauses, chunks, avg_tokens, min_tokens, max_tokens, total_tokens, appendix INTO NAME property VALUE value)
SELECT property, max(value) FILTER (lang = 'en') AS en, max(value) FILTER (lang = 'fr') AS fr FROM l GROUP BY property""")
def corpus_stats_transposed(t):
    return a.transposed(stats(t), "lang", ["en", "fr"])


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice::DOUBLE, 0.25) AS q1, quantile_cont(l_extendedprice::DOUBLE, 0.75) AS q3 FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(q1, 4) AS q1, round(q3, 4) AS q3, max(l_extendedprice::DOUBLE) FILTER (l_extendedprice <= q3 + 1.5 * (q3 - q1)) AS whisker FROM lineitem JOIN q USING (l_returnflag) GROUP BY ALL""")
def boxplot_stats(t):
    return a.box(t("lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("price")), "l_returnflag", "price")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def strata_counts(t):
    return t("documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT doc_id, (doc_id % 3) / 2.0::DOUBLE AS s FROM documents) SELECT round(100.0 * count(*) FILTER (s = 1) / count(*), 2)::DOUBLE AS full_pct, round(100.0 * count(*) FILTER (s = 0.5) / count(*), 2)::DOUBLE AS partial_pct, round(100.0 * count(*) FILTER (s = 0) / count(*), 2)::DOUBLE AS none_pct FROM x""")
def citation_bands(t):
    s = F.col("doc_id") % 3 / F.lit(2.0)
    share = lambda v: F.round(100.0 * F.count_if(s == v) / F.count(F.lit(1)), 2)
    return t("documents").agg(share(1.0).alias("full_pct"), share(0.5).alias("partial_pct"), share(0.0).alias("none_pct"))


@query("SELECT user_id, round(avg(value), 1) AS mean_load, round(max(value), 1) AS peak_load, count(*) AS samples FROM events GROUP BY user_id")
def resource_reduction(t):
    return t("events").groupBy("user_id").agg(F.round(a.exact_mean(F.col("value")), 1).alias("mean_load"), F.round(F.max("value"), 1).alias("peak_load"), F.count(F.lit(1)).alias("samples"))


@query("""SELECT count(*) AS total, count(*) FILTER (role = 'user') AS asked, count(*) FILTER (role = 'assistant') AS answered, count(*) FILTER (role NOT IN ('user', 'assistant')) AS other FROM conversations""")
def session_stats(t):
    r = F.col("role")
    return t("conversations").agg(F.count(F.lit(1)).alias("total"), F.count_if(r == "user").alias("asked"), F.count_if(r == "assistant").alias("answered"), F.count_if(~r.isin("user", "assistant")).alias("other"))


@query("SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 5")
def last_five(t):
    return t("conversations").select("conv_id", "turn", "role").orderBy(F.desc("conv_id"), F.desc("turn")).limit(5)


@query("""WITH w AS (SELECT doc_id, word, count(*) AS f FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]{4,}')) AS word FROM documents) GROUP BY ALL)
SELECT doc_id, word, f, row_number() OVER (PARTITION BY doc_id ORDER BY f DESC, length(word) DESC, word) AS rank FROM w QUALIFY rank <= 2""")
def topic_words(t):
    from ..operators.ledger import Window

    words = t("documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]{4,}"), F.lit(0))).alias("word"))
    counted = words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("f"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("f"), F.desc(F.length("word")), "word")
    return counted.withColumn("rank", F.row_number().over(w)).where("rank <= 2")


KEYWORDS = [("law", "license"), ("law", "under the"), ("place", "from"), ("place", "with this"), ("time", "when"), ("time", "was"), ("time", "des")]
KW = ", ".join(f"('{c}', '{w}')" for c, w in KEYWORDS)


@query(f"""WITH k(category, word) AS (VALUES {KW}), d AS (SELECT doc_id, lower(text) AS text, list_distinct({TOK.format('text')}) AS s FROM documents),
h AS (SELECT doc_id, category, CASE WHEN contains(word, ' ') THEN 2 ELSE 1 END AS w FROM d, k WHERE (contains(word, ' ') AND contains(text, word)) OR list_contains(s, word)),
s AS (SELECT doc_id, category, sum(w)::BIGINT AS score FROM h GROUP BY ALL) SELECT doc_id, category, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, category) = 1""")
def category_score(t):
    d = t("documents").select("doc_id", F.lower("text").alias("text"), text.tokens(F.col("text")).alias("tokens"))
    return a.keyword_category(d, d.sparkSession.createDataFrame(KEYWORDS, "category string, word string"))


@query("""WITH x AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN []::VARCHAR[] ELSE [(doc_id % 7)::VARCHAR, (doc_id % 3)::VARCHAR] END AS cited, [(doc_id % 4)::VARCHAR] AS same, [(doc_id % 6)::VARCHAR, '9'] AS other FROM documents)
SELECT lang, CASE WHEN len(cited) = 0 THEN 'none' WHEN list_has_any(cited, same) THEN 'same' WHEN list_has_any(cited, other) THEN 'other' ELSE 'unknown' END AS class, count(*) AS n FROM x GROUP BY ALL""")
def cross_edition_classes(t):
    s = lambda k: (F.col("doc_id") % k).cast("string")
    cited = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(s(7), s(3)))
    return t("documents").select("lang", a.error_class(cited, F.array(s(4)), F.array(s(6), F.lit("9"))).alias("class")).groupBy("lang", "class").agg(F.count(F.lit(1)).alias("n"))




@query(r"""SELECT doc_id, a::VARCHAR AS article, k AS ord, CASE WHEN k = 0 THEN a::VARCHAR ELSE a || '.1.a' END AS clause, 'LEAVE' AS title, p AS page FROM (SELECT doc_id, doc_id % 40 + 1 AS a, coalesce(try_cast(nullif(regexp_extract(regexp_replace(text, '\n', ' ', 'g'), '(?i)page(?:[\s\x{00a0}]*[-_]+[\s\x{00a0}]*|[\s\x{00a0}]+)?(\d+)', 1), '') AS INT), doc_id % 9 + 1)::INT AS p FROM documents), range(2) r(k)""")
def clause_segment(t):
    d = F.col("doc_id")
    n = (d % 40 + 1).cast("string")
    body = F.concat(F.lit("ARTICLE "), n, F.lit(" – LEAVE\n<<page_"), d % 9 + 1, F.lit(">>\n"), F.regexp_replace("text", "\n", " "), F.lit("\n"), n, F.lit(".1(a) First\nbody\n99.1 not mine"))
    rows = t("documents").select("doc_id", F.posexplode(chunking.segment(body)).alias("ord", "c"))
    return rows.select("doc_id", "c.article", F.col("ord").cast("bigint").alias("ord"), "c.clause", "c.title", "c.page")


PIECES = "pieces AS (SELECT doc_id // 7 AS doc, doc_id AS ord, source AS clause, (doc_id % 5)::INT AS page, text FROM documents), tk AS (SELECT *, len(regexp_extract_all(text, '[^\\s]+')) AS tokens FROM pieces)"


@query(f"""WITH {PIECES}, r AS (SELECT *, (tokens >= 30)::INT AS lg, coalesce(sum((tokens >= 30)::INT) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef, sum((tokens >= 30)::INT) OVER (PARTITION BY doc) AS al FROM tk),
g AS (SELECT *, least(bef, al - 1)::BIGINT AS gid FROM r WHERE al > 0)
SELECT doc, gid, any_value(clause) FILTER (lg = 1) AS clause, coalesce(arg_min(page, ord) FILTER (lg = 0 AND bef < al), any_value(page) FILTER (lg = 1)) AS page, md5(string_agg(text, chr(10) ORDER BY ord)) AS body FROM g GROUP BY doc, gid""")
def clause_merge_short(t):
    """Every document's whole text is a clause."""
    d = F.col("doc_id")
    p = t("documents").select(F.floor(d / 7).cast("bigint").alias("doc"), d.alias("ord"), F.col("source").alias("clause"), (d % 5).cast("int").alias("page"), "text", text.token_count(F.col("text")).alias("tokens"))
    return chunking.merge_short(p, "doc").select("doc", "gid", "clause", "page", F.md5("text").alias("body"))


@query()
def clause_split_long(t):
    parts = chunking.split_long(F.col("text"), 100)
    rows = t("documents").select("doc_id", F.arrays_zip(parts.alias("part"), chunking.part_ids(F.col("source"), parts).alias("clause")).alias("x"))
    return rows.select("doc_id", F.posexplode("x").alias("ord", "p")).select("doc_id", "ord", "p.clause", text.token_count(F.col("p.part")).alias("tokens"))


@query("SELECT doc_id, lag(doc_id) OVER w AS prev_id, lead(doc_id) OVER w AS next_id FROM documents WINDOW w AS (PARTITION BY lang, source ORDER BY n_chars, doc_id)")
def neighbor_chunks(t):
    return chunking.neighbours(t("documents").withColumn("chunk_index", F.col("n_chars"))).select("doc_id", "prev_id", "next_id")


SETS = f"""qs AS (SELECT item_id, list_distinct({TOK.format('text')}) AS s FROM benchmark), ds AS (SELECT doc_id, list_distinct({TOK.format('text')}) AS s, lag(doc_id) OVER w AS prev_id, lead(doc_id) OVER w AS next_id FROM documents WINDOW w AS (PARTITION BY lang, source ORDER BY n_chars, doc_id)),
ov AS (SELECT item_id, doc_id, count(*)::DOUBLE / any_value(n) AS overlap FROM (SELECT item_id, len(s) AS n, unnest(s) AS t FROM qs) JOIN (SELECT doc_id, unnest(s) AS t FROM ds) USING (t) GROUP BY ALL)"""


def sets(t):
    q = t("benchmark").select("item_id", text.token_set(F.col("text")).alias("s"))
    d = chunking.neighbours(t("documents").withColumn("chunk_index", F.col("n_chars"))).select("doc_id", text.token_set(F.col("text")).alias("s"), "prev_id", "next_id")
    return q, d


@query(f"WITH {SETS} SELECT item_id, doc_id, round(overlap, 6) AS overlap FROM ov QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) = 1")
def argmax_chunk(t):
    return textmatch.best(*sets(t)).withColumn("overlap", F.round("overlap", 6))


@query(f"WITH {SETS}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rank FROM ov) SELECT item_id, doc_id, rank, round(overlap, 6) AS overlap FROM r WHERE overlap >= 0.3::DOUBLE OR rank = 1")
def resolve_ids_by_text(t):
    return textmatch.resolved(*sets(t)).withColumn("overlap", F.round("overlap", 6))


@query(f"""WITH {SETS}, b AS (SELECT item_id, doc_id FROM ov QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) = 1),
x AS (SELECT b.item_id, b.doc_id, qs.s AS q, d.s AS s, coalesce(p.s, []) AS p, coalesce(n.s, []) AS n FROM b JOIN qs USING (item_id) JOIN ds d ON d.doc_id = b.doc_id LEFT JOIN ds p ON p.doc_id = d.prev_id LEFT JOIN ds n ON n.doc_id = d.next_id),
y AS (SELECT item_id, doc_id, round(len(list_intersect(q, s))::DOUBLE / len(q), 6) AS s0, round(len(list_intersect(q, list_concat(s, n)))::DOUBLE / len(q), 6) AS s1, round(len(list_intersect(q, list_concat(s, p)))::DOUBLE / len(q), 6) AS s2, round(len(list_intersect(q, list_concat(list_concat(s, n), p)))::DOUBLE / len(q), 6) AS s3 FROM x)
SELECT item_id, doc_id, CASE greatest(s0, s1, s2, s3) WHEN s0 THEN 'single' WHEN s1 THEN 'forward' WHEN s2 THEN 'backward' ELSE 'both' END AS how, greatest(s0, s1, s2, s3) AS score, round(100 * greatest(s0, s1, s2, s3)) >= 80 AS accepted FROM y""")
def chunk_expansion(t):
    q, d = sets(t)
    return gold.expanded(textmatch.best(q, d), q, d)


PICKED = "s AS (SELECT doc_id, lang, label, row_number() OVER (PARTITION BY lang, label ORDER BY md5('42:' || doc_id), doc_id) AS pick FROM (SELECT doc_id, lang, coalesce(quality, 2) AS label FROM documents LEFT JOIN labels USING (doc_id)) QUALIFY pick <= CASE WHEN label = 2 THEN 8 ELSE 7 END)"


def picked(t):
    rows = t("documents").select("doc_id", "lang").join(t("labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(2)).alias("label"))
    return rows, sampling.stratified(rows, ["lang", "label"], "doc_id", F.when(F.col("label") == 2, 8).otherwise(7))


@query(f"WITH {PICKED} SELECT doc_id, lang, label, pick FROM s")
def stratified_sample(t):
    return picked(t)[1]


@query(f"""WITH {PICKED}, rest AS (SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s)), b AS (SELECT doc_id, lang FROM rest QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= 5)
SELECT doc_id, lang, 'H' || lpad(row_number() OVER (ORDER BY md5('42#' || doc_id), doc_id)::VARCHAR, 3, '0') AS item_id FROM b""")
def disjoint_sample(t):
    rows, first = picked(t)
    b = sampling.stratified(sampling.disjoint(rows, first, "doc_id"), ["lang"], "doc_id", F.lit(5)).select("doc_id", "lang")
    return sampling.item_ids(b, "doc_id")


@query("""WITH c AS (SELECT lang AS cell, count(*) AS n FROM documents GROUP BY lang), q AS (SELECT cell, n, round_even(30 * n / sum(n) OVER ()::DOUBLE, 0)::BIGINT AS quota FROM c)
SELECT cell, n, quota + CASE WHEN row_number() OVER (ORDER BY n DESC, cell) = 1 THEN 30 - sum(quota) OVER () ELSE 0 END::BIGINT AS quota FROM q""")
def overlap_quota(t):
    return sampling.scaled_quotas(t("documents").groupBy(F.col("lang").alias("cell")).agg(F.count(F.lit(1)).alias("n")), 30)


@query("SELECT doc_id, CASE WHEN quality = 1 - toxic THEN quality WHEN doc_id % 3 = 0 THEN 1 END AS consensus, quality <> 1 - toxic AS disagree FROM labels")
def adjudication(t):
    q, h = F.col("quality"), 1 - F.col("toxic")
    return t("labels").select("doc_id", sampling.adjudicated(q, h, F.when(F.col("doc_id") % 3 == 0, 1)).alias("consensus"), (q != h).alias("disagree"))
