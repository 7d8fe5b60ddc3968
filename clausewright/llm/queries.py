"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, chat, hard_negatives, media, packing, quality, secrets, sentencepiece_codec, simhash, substring_dedup, suffix_dedup, toxicity
from .common import table, text_of


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), check=True)
    return e.select(F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_ids"), F.sha2("decoded", 256).alias("decoded_sha256"), "same", "ids")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    p = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))
    return p.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "cut")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _scored(quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"))))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _scored(toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))))


def _scored(s: DataFrame) -> DataFrame:
    return s.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = suffix_dedup.remove_repeats(docs, passages=suffix_dedup.PASSAGE)
    found = found.select("k1", "k2", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "passage_bytes")
    return docs.select("doc_id", *suffix_dedup.keys_of(text_of("text"))).join(found.hint("merge"), ["k1", "k2"]).drop("k1", "k2")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media.to_media(table(spark, sf_dir, "documents"))
    text = F.concat_ws(":", "n_frames", F.size("fingerprint"), F.hex(F.xxhash64("fingerprint")))
    return m.select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), text.alias("feature"), "fingerprint"
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [secrets.count_of(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return s.select(F.col("id").alias("doc_id"), *counts, F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"), "n_copied", "n_owned")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)
    return n.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [tokenizer_path(name) for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
    a = alignment.align(table(spark, sf_dir, "documents"), *paths, digest=True)
    return a.withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    width = substring_dedup.WIDTH
    left = substring_dedup.remove_copied(docs, width=width).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
    text = text_of("text")
    rows = docs.select("doc_id", *substring_dedup.keys_of(text)).join(left.hint("merge"), ["k1", "k2"])
    copy = (F.coalesce("doc_id", F.lit(substring_dedup.LAST)) != F.col("ord")) & (F.col("n_words") >= width)
    removed = F.when(copy, F.col("n_words")).otherwise(F.col("n_removed"))
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_sentencepiece, op2_chat, op3_packing, op4_ann, op5_quality, op6_suffix_array, op7_media, op8_secrets, op9_toxicity, op10_simhash, op11_hard_negatives, op12_alignment, op13_substring_dedup]
    import corpus_pipeline

    return {**{f.__name__: f for f in found}, "pipeline": corpus_pipeline.run}


ORACLE = {
    "op11_hard_negatives": """WITH r AS (
 SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM r JOIN r a ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""",
    "op13_substring_dedup": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
again AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM again),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
