"""Scalar text functions, citations, predicates and the small parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citation, predicates, text
from .registry import query

TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
WS = "len(regexp_extract_all({}, '[^\\s]+'))"


@query(f"SELECT doc_id, len({TOK.format('text')}) AS n_tokens, len(list_distinct({TOK.format('text')})) AS n_distinct, {WS.format('text')} AS n_words FROM documents")
def token_counts(t):
    c = F.col("text")
    return t("documents").select("doc_id", F.size(text.tokens(c)).alias("n_tokens"), F.size(text.token_set(c)).alias("n_distinct"), text.token_count(c).alias("n_words"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(' ' || replace(text, ' ', chr(160)) || '  ' || chr(10) || chr(10) || chr(10) || chr(10) || text, chr(160), ' '), chr(8203), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS cleaned FROM documents""")
def clean_text(t):
    c = F.col("text")
    raw = F.concat(F.lit(" "), F.replace(c, F.lit(" "), F.lit(" ")), F.lit("  \n\n\n\n"), c)
    return t("documents").select("doc_id", F.md5(text.clean_text(raw)).alias("cleaned"))


STEM = "'agreement ' || (1990 + doc_id % 40) || '-' || (1995 + doc_id % 40) || ' final_2018'"


@query(f"""WITH y AS (SELECT doc_id, list_max(list_transform(regexp_extract_all({STEM}, '\\b(?:19|20)\\d{{2}}\\b'), lambda x: x::INT)) AS end_year FROM documents)
SELECT doc_id, end_year, round(0.3::DOUBLE + 0.7::DOUBLE * greatest(0, least(1, (end_year - 1998) / 28.0::DOUBLE)), 4) AS weight FROM y""")
def recency_weight(t):
    stem = F.concat(F.lit("agreement "), 1990 + F.col("doc_id") % 40, F.lit("-"), 1995 + F.col("doc_id") % 40, F.lit(" final_2018"))
    rows = t("documents").select("doc_id", text.end_year(stem).alias("end_year"))
    return rows.withColumn("weight", text.recency_weight(F.col("end_year")))


@query("""WITH x AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'English' WHEN 1 THEN ' FR ' WHEN 2 THEN 'français' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'chunk text' END AS l, 'test_' || lang || '_' || doc_id AS qid FROM documents)
SELECT doc_id, CASE WHEN lower(trim(coalesce(l, ''))) IN ('en', 'english', 'eng') THEN 'en' WHEN lower(trim(coalesce(l, ''))) IN ('fr', 'french', 'français', 'francais', 'fra') THEN 'fr'
 WHEN contains(qid, '_fr') THEN 'fr' WHEN contains(qid, '_en') THEN 'en' WHEN coalesce(l, '') = '' THEN '' ELSE l END AS resolved,
 CASE WHEN contains(qid, '_en') THEN 'en' WHEN contains(qid, '_fr') THEN 'fr' WHEN contains(qid, '_de') THEN 'de' WHEN contains(qid, '_es') THEN 'es' ELSE substr(qid, 6, 2) END AS mark,
 CASE WHEN substr(lower('Ge' || lang), 1, 2) = 'ge' THEN 'de' END AS code FROM x JOIN documents USING (doc_id)""")
def language_folding(t):
    k = F.col("doc_id") % 6
    raw = F.when(k == 0, "English").when(k == 1, " FR ").when(k == 2, "français").when(k == 3, "").when(k == 4, F.lit(None)).otherwise("chunk text")
    qid = F.concat(F.lit("test_"), "lang", F.lit("_"), "doc_id")
    return t("documents").select("doc_id", text.resolve_language(raw, qid).alias("resolved"), text.language_mark(qid).alias("mark"), text.language_code(F.concat(F.lit("Ge"), "lang")).alias("code"))


def _marks(code: str) -> str:
    return " + ".join(f"contains(s, '{m}')::INT" for m in text.MARKERS[code])


@query(f"""WITH x AS (SELECT doc_id, ' ' || lower(text) || ' ' AS s FROM documents), c AS (SELECT doc_id, {', '.join(f'{_marks(k)} AS {k}' for k in text.MARKERS)} FROM x)
SELECT doc_id, CASE greatest(en, fr, de, es) WHEN en THEN 'en' WHEN fr THEN 'fr' WHEN de THEN 'de' ELSE 'es' END AS detected FROM c""")
def detect_language(t):
    return t("documents").select("doc_id", text.detect_language(F.col("text")).alias("detected"))


@query("""SELECT doc_id, CASE WHEN len(list_filter([' le ', ' la ', ' les ', ' des ', ' une ', ' un ', ' de ', ' et ', ' est ', ' au '], lambda m: contains(s, m)))
 > len(list_filter([' the ', ' and ', ' of ', ' to ', ' is ', ' are ', ' with ', ' for '], lambda m: contains(s, m))) THEN 'French' ELSE 'English' END AS detected
FROM (SELECT doc_id, ' ' || lower(text) || ' ' AS s FROM documents)""")
def english_or_french(t):
    return t("documents").select("doc_id", text.english_or_french(F.col("text")).alias("detected"))


@query("""SELECT item_id, k, CASE WHEN regexp_matches(q, '\\b(?:19|20)\\d{2}\\b') THEN q WHEN k = 1 THEN q || ' convention collective 2020 - 2025' ELSE q || ' collective agreement 2020 - 2025' END AS augmented
FROM (SELECT item_id, k, text || CASE k WHEN 2 THEN ' in 2022' WHEN 3 THEN ' Clause 3000' ELSE '' END AS q FROM benchmark, range(4) r(k))""")
def year_augmentation(t):
    rows = t("benchmark").select("item_id", F.col("text").alias("q"), F.explode(F.array(*(F.lit(i).cast("bigint") for i in range(4)))).alias("k"))
    q = F.concat("q", F.when(F.col("k") == 2, " in 2022").when(F.col("k") == 3, " Clause 3000").otherwise(""))
    return rows.select("item_id", "k", text.augment_with_year(q, F.when(F.col("k") == 1, "fr").otherwise("en")).alias("augmented"))


CITED = "'Per clause ' || (doc_id % 9 + 1) || '.' || (doc_id % 5) || '.' || (doc_id % 3) || ' (B) of Article ' || (doc_id % 7 + 1) || ', section ' || (doc_id % 11) || '. '"
GOLDEN = "CASE WHEN doc_id % 13 = 0 THEN 'none' ELSE 'ARTICLE ' || (doc_id % 4 + 1) || ' Absatz ' || (doc_id % 9 + 1) || '.' || (doc_id % 2) || '.' || (doc_id % 3) || '(b)' END"
ART, CW, DOT = citation.ARTICLE, citation.CLAUSE_WORD, citation.DOTTED


def _clauses(c: str) -> str:
    norm = "regexp_replace(lower(regexp_replace(x, '\\s+', '', 'g')), '^[ .]+|[ .]+$', '', 'g')"
    return f"list_sort(list_distinct(list_concat(list_transform(regexp_extract_all({c}, '{DOT}', 1), lambda x: {norm}), list_filter(list_transform(regexp_extract_all({c}, '{CW}', 1), lambda x: {norm}), lambda x: contains(x, '.')))))"


def _articles(c: str) -> str:
    return f"list_sort(list_distinct(list_concat(regexp_extract_all({c}, '{ART}', 1), list_filter(regexp_extract_all({c}, '{CW}', 1), lambda x: NOT contains(x, '.')), list_transform({_clauses(c)}, lambda x: split_part(x, '.', 1)))))"


CITES = f"x AS (SELECT doc_id, {CITED} || text AS answer, {GOLDEN} AS gold FROM documents), c AS (SELECT doc_id, {_articles('answer')} AS articles, {_clauses('answer')} AS clauses, {_articles('gold')} AS ga, {_clauses('gold')} AS gc FROM x)"
PICK = """list_sort(list_transform(ga, lambda v: {'n': length(v), 'v': v}))[1].v AS gold_article,
list_sort(list_transform(gc, lambda v: {'p': -len(string_split(v, '.')), 'n': -length(v), 'v': v}))[1].v AS gold_clause"""


def cited(t):
    d = F.col("doc_id")
    answer = F.concat(F.lit("Per clause "), d % 9 + 1, F.lit("."), d % 5, F.lit("."), d % 3, F.lit(" (B) of Article "), d % 7 + 1, F.lit(", section "), d % 11, F.lit(". "), "text")
    gold = F.when(d % 13 == 0, "none").otherwise(F.concat(F.lit("ARTICLE "), d % 4 + 1, F.lit(" Absatz "), d % 9 + 1, F.lit("."), d % 2, F.lit("."), d % 3, F.lit("(b)")))
    return t("documents").select("doc_id", answer.alias("answer"), gold.alias("gold"))


@query(f"WITH {CITES} SELECT doc_id, array_to_string(articles, ',') AS articles, array_to_string(clauses, ',') AS clauses FROM c")
def citation_extract(t):
    return cited(t).select("doc_id", F.array_join(citation.articles(F.col("answer")), ",").alias("articles"), F.array_join(citation.clauses(F.col("answer")), ",").alias("clauses"))


@query(f"WITH {CITES}, g AS (SELECT doc_id, {PICK} FROM c) SELECT doc_id, coalesce(gold_article, '') AS gold_article, coalesce(gold_clause, '') AS gold_clause FROM g")
def citation_gold(t):
    return cited(t).select("doc_id", citation.gold_article(F.col("gold")).alias("gold_article"), citation.gold_clause(F.col("gold")).alias("gold_clause"))


@query(f"""WITH {CITES}, g AS (SELECT doc_id, articles, clauses, {PICK} FROM c) SELECT doc_id, CASE WHEN gold_article IS NULL AND gold_clause IS NULL THEN NULL WHEN list_contains(clauses, gold_clause) THEN 1.0::DOUBLE
WHEN list_contains(articles, gold_article) THEN 0.5 ELSE 0 END AS score FROM g""")
def citation_score(t):
    return cited(t).select("doc_id", citation.accuracy(F.col("answer"), F.col("gold")).alias("score"))


@query(f"""WITH x AS (SELECT doc_id, {CITED} || text AS s FROM documents) SELECT doc_id, regexp_extract(s, '(?i)(?:article|clause)\\s+(\\d{{1,3}})', 1) AS first_article,
regexp_replace(regexp_replace(' ' || (doc_id % 9) || '.' || (doc_id % 5) || '(a). ', '\\(([^)]*)\\)', '.\\1', 'g'), '^[ .]+|[ .]+$', '', 'g') AS normal FROM x""")
def article_numbers(t):
    d = F.col("doc_id")
    return cited(t).select("doc_id", citation.first_article(F.col("answer")).alias("first_article"), citation.dotted_id(F.concat(F.lit(" "), d % 9, F.lit("."), d % 5, F.lit("(a). "))).alias("normal"))


@query("""WITH x AS (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'Llama3.2:3b-instruct-q4_K_M' WHEN 1 THEN ' llama3.2:3b-GPU' WHEN 2 THEN 'mistral:latest' ELSE 'judge:' END AS s FROM embeddings)
SELECT vec_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(s)), '-gpu$', ''), '-instruct-q4_k_m$', ''), ':latest$', ''), '[:-]+$', '') AS tag FROM x""")
def canonical_tags(t):
    k = F.col("vec_id") % 4
    raw = F.when(k == 0, "Llama3.2:3b-instruct-q4_K_M").when(k == 1, " llama3.2:3b-GPU").when(k == 2, "mistral:latest").otherwise("judge:")
    return t("embeddings").select("vec_id", text.canonical_tag(raw).alias("tag"))


@query(f"""WITH n AS (SELECT doc_id, source, unnest(range(7)) AS j FROM documents), m AS (SELECT doc_id, j, source, doc_id + j // 2 AS i FROM n),
l AS (SELECT doc_id, j, CASE WHEN i % 3 <> 0 THEN 'ARTICLE ' || (i % 9) || '.1' WHEN i % 2 <> 0 THEN 'ARTICLE ' || (i % 2) ELSE '' END AS h, CASE WHEN i % 4 = 0 THEN '' ELSE source END AS s FROM m),
f AS (SELECT doc_id, CASE WHEN h <> '' AND s <> '' THEN h || ' - ' || s WHEN h <> '' THEN h ELSE s END AS label, min(j) AS j FROM l GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS r FROM f WHERE label <> '')
SELECT doc_id, coalesce((SELECT string_agg(label, ';' ORDER BY r) FROM k WHERE k.doc_id = d.doc_id AND r <= 5), '') AS labels FROM documents d""")
def header_labels(t):
    def node(j):
        i = F.col("doc_id") + j // 2
        clause = F.when(i % 3 == 0, "0").otherwise(F.concat(i % 9, F.lit(".1__p2")))
        return F.struct(clause.alias("clause_id"), (i % 2).cast("string").alias("article_number"), F.when(i % 4 == 0, "").otherwise(F.col("source")).alias("section_title"))

    return t("documents").select("doc_id", F.array_join(text.header_labels(F.array(*(node(j) for j in range(7)))), ";").alias("labels"))


@query("""SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-zA-ZÀ-ÿ]{4,}')), lambda x: NOT list_contains(string_split(
'what how is are the a an of to in for and or on according collective agreement does provide regarding apply conditions shall be with that this from at by member members university any all may not no if when which who whom whose it its their there here also such other than quelles quel quels quelle que est sont le la les des du de au aux dans pour et ou selon convention collective indique sujet applique sur une un ses leur leurs cette ces avec par plus comme tout tous toute toutes doit peut sera etre être', ' '), x))) AS n FROM documents""")
def content_words(t):
    return t("documents").select("doc_id", F.size(text.content_words(F.col("text"))).alias("n"))


@query("""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(' c' || doc_id || ' | |c' || (doc_id + 1) || '|', '|'), lambda x: trim(x)), lambda x: x <> ''), ',') AS ids,
regexp_replace(trim(' a  b' || chr(10) || source), '\\s+', ' ', 'g') AS flat, regexp_replace(lower('Q: ' || source || '?'), '[^\\p{L}\\p{N}_]+', '', 'g') || '|' || substr(text, 1, 160) AS key,
replace(regexp_replace(regexp_replace(regexp_replace('CA (' || source || ') 2015 - 2018.', '(\\d{4})\\s*[-–]\\s*(\\d{4})', '\\1~\\2', 'g'), '[^\\p{L}\\p{N}~]+', '_', 'g'), '^_+|_+$', '', 'g'), '~', '-') AS stem FROM documents""")
def id_lists_and_keys(t):
    d = F.col("doc_id")
    return t("documents").select(
        "doc_id",
        F.array_join(text.id_list(F.concat(F.lit(" c"), d, F.lit(" | |c"), d + 1, F.lit("|"))), ",").alias("ids"),
        text.collapsed(F.concat(F.lit(" a  b\n"), "source")).alias("flat"),
        text.dedupe_key(F.concat(F.lit("Q: "), "source", F.lit("?")), F.col("text")).alias("key"),
        text.file_stem(F.concat(F.lit("CA ("), "source", F.lit(") 2015 - 2018."))).alias("stem"),
    )


@query("""SELECT doc_id, CASE WHEN d = '' THEN 0.5::DOUBLE ELSE d::DOUBLE / 5 END AS single, CASE doc_id % 5 WHEN 0 THEN 0 WHEN 4 THEN 0.5 ELSE round((doc_id % 5) / 5.0::DOUBLE, 4) END AS combined,
CASE WHEN doc_id % 3 = 2 THEN 0.5::DOUBLE ELSE (doc_id % 3)::DOUBLE END AS cited, CASE WHEN doc_id % 2 = 0 THEN 'two' ELSE 'x' END AS second FROM (SELECT doc_id, regexp_extract('Score: ' || (doc_id % 8) || ' of five', '\\b([1-5])\\b', 1) AS d FROM documents)""")
def judge_parse(t):
    d = F.col("doc_id")
    line = F.when(d % 5 == 4, "bad").otherwise((d % 5).cast("string"))
    reply = F.when(d % 5 == 0, "nothing").otherwise(F.concat(F.lit("faithfulness_reasoning: fine\n faithfulness_score: "), line, F.lit(" \nother")))
    return t("documents").select(
        "doc_id",
        text.judge_score(F.concat(F.lit("Score: "), d % 8, F.lit(" of five"))).alias("single"),
        text.combined_judge_score(reply, "faithfulness").alias("combined"),
        text.citation_judge_score(F.concat(F.lit("I say "), F.when(d % 3 == 2, "0.5").otherwise((d % 3).cast("string")))).alias("cited"),
        F.element_at(text.numbered_lines(F.when(d % 2 == 0, "2. two\n1. one").otherwise("1. one\nx"), 2), 2).alias("second"),
    )


E = "(CASE WHEN n = 0 THEN 0 ELSE floor(n / 3.2::DOUBLE)::BIGINT + 1 END)"


@query(f"""WITH x AS (SELECT conv_id, length(string_agg(text, ' ' ORDER BY turn)) * 20 AS n FROM conversations GROUP BY conv_id), y AS (SELECT conv_id, {E} AS prompt_tokens FROM x),
z AS (SELECT *, greatest(768, least(4096, round_even(prompt_tokens * 0.35::DOUBLE, 0)))::BIGINT AS reserve FROM y)
SELECT conv_id, prompt_tokens, reserve, CASE WHEN prompt_tokens + reserve <= 12288 THEN 12288 WHEN prompt_tokens + reserve <= 16384 THEN 16384 WHEN prompt_tokens + reserve <= 20480 THEN 20480 ELSE 24576 END AS context_window FROM z""")
def context_budget(t):
    c = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    prompt = F.repeat(F.array_join(F.transform("x", lambda x: x["text"]), " "), F.lit(20))
    n = text.estimated_tokens(prompt)
    return c.select("conv_id", n.alias("prompt_tokens"), text.predicted_output(n).alias("reserve"), text.context_window(prompt).alias("context_window"))


@query("""SELECT doc_id, CASE WHEN n < 18 THEN 'easy' WHEN n < 35 THEN 'medium' ELSE 'hard' END AS difficulty, CASE WHEN n % 10 >= 7 THEN 'high' WHEN n % 10 >= 4 THEN 'mid' ELSE 'low' END AS class,
md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped, CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN '1' ELSE '2.5' END AS entered
FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[^\\s]+')) AS n FROM documents)""")
def difficulty_and_classes(t):
    n = text.token_count(F.col("text"))
    entered = F.when(n % 3 == 0, "nan").when(n % 3 == 1, "1.0").otherwise("2.5")
    return t("documents").select("doc_id", text.difficulty(F.col("text")).alias("difficulty"), text.score_class(F.round(n % 10 / F.lit(10.0), 1)).alias("class"), F.md5(text.escape_html(F.col("text"))).alias("escaped"), text.whole_number(entered).alias("entered"))


@query()
def sentence_pairs(t):
    rows = t("documents").select("doc_id", text.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n_sentences"), text.adjacent(F.col("s")).alias("p"))
    return rows.select("doc_id", "n_sentences", F.size("p").alias("n_pairs"), F.size(F.filter("p", lambda x: F.length(x).between(60, 420))).alias("n_candidates"))


CELL = "(CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' NaN ' WHEN 3 THEN 'none' WHEN 4 THEN '0.0' WHEN 5 THEN 'Yes' WHEN 6 THEN '1.0' ELSE value::VARCHAR END)"
BLANK = f"({CELL} IS NULL OR lower(trim({CELL})) IN ('', 'nan', 'none'))"
NUM = f"(CASE WHEN NOT isnan(try_cast(trim({CELL}) AS DOUBLE)) THEN try_cast(trim({CELL}) AS DOUBLE) END)"


@query(f"""SELECT event_id, {BLANK} AS blank, {BLANK} OR coalesce({NUM} = 0, false) AS zero_or_blank, coalesce(lower(trim({CELL})) IN ('true', '1', '1.0', 'yes'), false) AS wide, coalesce(lower(trim({CELL})) IN ('true', '1'), false) AS narrow,
coalesce({NUM}, 0) > 1 AS retried, NOT {BLANK} AS answered FROM events""")
def null_model(t):
    k = F.col("event_id") % 8
    cell = F.when(k == 1, "").when(k == 2, " NaN ").when(k == 3, "none").when(k == 4, "0.0").when(k == 5, "Yes").when(k == 6, "1.0").when(k == 7, F.col("value").cast("string"))
    p = predicates
    return t("events").select("event_id", p.blank(cell).alias("blank"), p.zero_or_blank(cell).alias("zero_or_blank"), p.truthy(cell, p.TRUE_WIDE).alias("wide"), p.truthy(cell, p.TRUE_ONE).alias("narrow"), (F.coalesce(p.number(cell), F.lit(0.0)) > 1).alias("retried"), p.answered(cell).alias("answered"))
