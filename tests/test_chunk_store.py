"""The chunk store: what a write replaces, what a read opens, and ingestion of documents."""

from pathlib import Path

from pyspark.sql import functions as F

from clausewright.sources import chunk_store


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_writes_replace_folders_only(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [(f"c{k}", "en" if k % 2 else "fr", str(k % 5), f"t{k}") for k in range(60)]
    df = spark.createDataFrame([*rows, rows[7], ("x", None, "1", "t"), (None, "en", "1", "t")], "chunk_id string, language string, article_number string, text string")
    chunk_store.write(df, path, 4)
    before = files(path)
    assert len(before) == 8
    chunk_store.upsert(spark, spark.createDataFrame([("c7", "en", "9", "new", 5), ("c99", "en", "9", "more", 5)], "chunk_id string, language string, article_number string, text string, other int"), path, 4)
    same = [f for f, when in files(path).items() if before.get(f) == when]
    assert 6 <= len(same) < 8 and all("language=fr" in f for f in before if f not in same) is False
    got = {(r.chunk_id, r.language): r.text for r in chunk_store.read(spark, path).collect()}
    want = {(i, k): t for i, k, _, t in rows} | {("c7", "en"): "new", ("c99", "en"): "more"}
    assert got == want


def test_reads_open_what_the_filters_name(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.range(80).select(F.col("id").cast("string").alias("chunk_id"), F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("language"), (F.col("id") % 5).cast("string").alias("article_number"), F.lit("t").alias("text"))
    chunk_store.write(df, path, 4)
    found = chunk_store.read(spark, path, languages=["en"], articles=["2"], ids=["2", "12", "13", "77"], parts=4)
    assert sorted(r.chunk_id for r in found.collect()) == ["12", "2"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    folders = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "language" in folders and "part" in folders and "article_number" in plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert chunk_store.read(spark, path, ids=[]).count() == 0 and chunk_store.read(spark, path, articles=[]).count() == 0


def test_ingest_gives_clauses_with_weights(spark):
    long = " ".join(f"Word{k} is here." for k in range(40))
    text = f"ARTICLE 1 Terms\nshort\nARTICLE 2 Pay\n{long}\n2.1 Rates\n{long}\nARTICLE 3\nend"
    docs = spark.createDataFrame([("Agreement 2012-2026.pdf", "en", text), ("plain", "fr", ""), ("none", "fr", None)], "source string, language string, text string")
    got = chunk_store.ingest(docs, lambda t: F.array(F.length(t).cast("float"))).orderBy("chunk_id").collect()
    assert [(r.language, r.article_number, r.clause_id) for r in got] == [("en", "2", "2"), ("en", "2", "2.1")]
    assert got[0].text.startswith("ARTICLE 1") and got[1].text.endswith("end") and got[0].recency_weight == 1.0 and got[0].embedding == [float(len(got[0].text))]
    assert chunk_store.summary(chunk_store.canonical(chunk_store.ingest(docs))).first().chunks == 2
