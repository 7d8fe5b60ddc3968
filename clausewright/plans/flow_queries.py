"""Sources, the question loop and incremental processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import loop, retrieval
from ..sources import files
from ..streaming import buckets, incremental
from .registry import ORACLE, QUERIES, query


@query("SELECT doc_id::VARCHAR AS doc_id, md5(text) AS body, lang, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS source FROM documents")
def csv_round_trip(t):
    d = t("documents")
    spark = d.sparkSession
    path = files.scratch(spark)
    files.write_csv(d.select("doc_id", "text", "lang", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source")), path)
    return files.read_csv(spark, path, files.header(spark, path)).select("doc_id", F.md5("text").alias("body"), "lang", "source")


@query("SELECT conv_id, turn, role, md5(text) AS body FROM conversations")
def json_round_trip(t):
    c = t("conversations")
    path = files.scratch(c.sparkSession)
    files.write_json(c, path)
    return files.read_json(c.sparkSession, path, "conv_id bigint, turn bigint, role string, text string").select("conv_id", "turn", "role", F.md5("text").alias("body"))


@query("""WITH p AS (SELECT page_id, i::INT AS page_no, s[i] AS part, url FROM (SELECT page_id, url, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT page_id, url, string_split(html, chr(10)) AS s FROM pages)))
SELECT page_id, page_no, md5(part) AS body, CASE WHEN page_id % 2 = 0 THEN 'foot 2015 - 2018' ELSE url || ' Page ' || page_no END AS footer FROM p""")
def paged_text(t):
    parts = F.replace("html", F.lit("\n"), F.lit("\f"))
    rows = t("pages").select("page_id", "url", F.inline(files.pages(parts)))
    last = F.when(F.col("page_id") % 2 == 0, "foot 2015 - 2018").otherwise("foot")
    page = files.with_footer(F.concat(F.lit("body\n"), last), F.col("url"), F.col("page_no"))
    return rows.select("page_id", "page_no", F.md5("text").alias("body"), F.element_at(F.split(page, "\n"), -1).alias("footer"))


@query()
def agentic_loop(t):
    docs = t("documents").select("doc_id", "text")

    def retrieve(q):
        best = retrieval.bm25(docs, q, 1).select("item_id", "doc_id")
        return best.join(docs.withColumnRenamed("text", "chunk"), "doc_id")

    q = t("benchmark").select("item_id", text.augment_with_year(F.col("text"), F.lit("en")).alias("text"))
    out = loop.run(q, retrieve, 2)
    return out.select("item_id", "doc_id", "attempts", "grounded", F.length("answer").alias("answer_chars"))


@query()
def naive_loop(t):
    docs = t("documents").select("doc_id", "text")
    best = lambda q: retrieval.bm25(docs, q, 1).select("item_id", "doc_id").join(docs.withColumnRenamed("text", "chunk"), "doc_id")
    return loop.run(t("benchmark"), best, 1).select("item_id", "doc_id", "attempts", "grounded")


@query("""SELECT count(*) AS n, count(*) FILTER (doc_id % 4 = 0) AS grounded, count(*) FILTER (lang NOT IN ('en', 'fr')) AS translated FROM documents""")
def reflector_replies(t):
    k = F.col("doc_id") % 4
    reply = F.when(k == 0, " grounded indeed").when(k == 1, "UNGROUNDED").when(k == 2, "GROUNDEDNESS").otherwise(F.lit(None))
    return t("documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(loop.reflected(reply)).alias("grounded"), F.count_if(loop.needs_translation(F.col("lang"))).alias("translated"))


@query()
def rewrite_batches(t):
    return loop.batches(t("documents").select(F.col("doc_id").alias("item_id"), "text"))


def _incremental(spark, sf_dir):
    source = incremental.file_stream(spark, f"{sf_dir}/events.parquet", ["event_id", "user_id", "event_type", "value"])
    keys, path = ["user_id", "event_type"], files.scratch(spark)
    buckets.merge_stream(source, keys, buckets.upsert(keys, "event_id"), path)
    return buckets.ledger(spark, path, source.schema)


QUERIES["incremental_upsert_stream"] = _incremental
ORACLE["incremental_upsert_stream"] = "SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"


def _running(spark, sf_dir):
    source = incremental.file_stream(spark, f"{sf_dir}/events.parquet", ["event_type", "value"])
    return buckets.running_means(source, "event_type", "value", files.scratch(spark))


QUERIES["running_means_stream"] = _running
ORACLE["running_means_stream"] = "SELECT event_type, round(avg(value), 4) AS mean, count(*) AS n FROM events GROUP BY event_type"
