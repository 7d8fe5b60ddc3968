"""The pipeline's stages against plain versions, on a small fixture with planted cases."""

import random

import pytest

pytest.importorskip("clausewright.llm")

import corpus_pipeline
from clausewright.llm import secrets, simhash, suffix_dedup
from clausewright.llm.queries import queries, tokenizer_path

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture
def planted(spark):
    rng = random.Random(1)
    base = [words(rng, 150) for _ in range(12)]
    near = base[0].split()
    near[70] = "changed"
    nearer = base[0].split()
    nearer[71:73] = ["other", "thing"]
    passage = words(rng, 100)
    texts = [*base, base[3], " ".join(near), " ".join(nearer), None, "", passage + " " + words(rng, 80), words(rng, 80) + " " + passage, "token=abcdef123456 " + words(rng, 50)]
    rows = [(k, t, "en", "src", len(t or ""), "extra") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, root string"), texts


def test_one_of_each_group_stays(spark, planted):
    df, _ = planted
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, SF).collect()}
    assert got == {*range(12), 15, 17, 18, 19}  # 12 copies 3, 13 and 14 are near 0, 16 is empty like 15


def test_near_copies_are_the_pairs_alike_in_four_fifths(spark):
    rng = random.Random(7)
    texts = []
    for changed in range(3, 11):  # similarities from 0.71 to 0.90
        for _ in range(8):
            base = words(rng, 300).split()
            other = list(base)
            for at in rng.sample(range(6, 294, 6), changed):
                other[at] = "other"
            texts += [" ".join(base), " ".join(other)]
    line = words(rng, 12)
    texts += [" ".join([line] * 40 + [words(rng, 30)]) for _ in range(3)]  # alike in fingerprint only
    texts += [texts[0], "", None, "one two", "one two"]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]

    def alike(a, b):
        return a == b or len(a & b) / len(a | b) >= 0.8

    pairs = [alike(sets[2 * k], sets[2 * k + 1]) for k in range(64)]
    between = [len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(64)]
    assert sum(pairs) == 32 and 0.7 < min(between) < max(between) < 0.91
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    rows = [(k, t, "en", "src", len(t or "")) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, SF).collect()) == sorted(set(root))


def test_parts_of_a_group_are_joined(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SETS", 4)
    rng = random.Random(8)
    base = words(rng, 300).split()
    texts = []
    for k in range(30):
        other = list(base)
        other[10 * k % 290] = f"w{k}"
        texts.append(" ".join(other))
    df = spark.createDataFrame([(k, t, "en", "src", len(t)) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, SF).collect()] == [0]


def test_repeats_go(spark, planted):
    df, texts = planted
    got = {r.doc_id: r for r in corpus_pipeline.suffix_array_stage(spark, df, SF).collect()}
    assert len(got) == len(texts) and got[3].text == got[12].text == ""
    for a, b in ((17, 18),):
        assert texts[a][:100] not in got[a].text and len(got[a].text) < len(texts[a]) and len(got[b].text) < len(texts[b])
    assert got[1].text == texts[1] and got[15].text == "" and all(r.n_chars == len(r.text) for r in got.values())


def test_cut_characters_are_dropped(spark):
    shared = "é" * 300
    df = spark.createDataFrame([(1, "xé" + shared + "e", 1), (2, "y" + shared + "e", 1)], "doc_id bigint, text string, kept int")
    for r in suffix_dedup.without_repeats(df, width=401).collect():
        assert set(r.text) <= set("xyée") and len(r.text) < 300 and r.kept == 1


def test_secrets_are_masked(spark, planted):
    df, texts = planted
    got = {r.doc_id: r.text for r in corpus_pipeline.secrets_stage(spark, df, SF).collect()}
    assert got[19].startswith("[secret] ") and got[1] == texts[1] and len(got) == len(texts)
    spans = {r.id: r.spans for r in secrets.scan(df).collect()}
    assert [s.stop for s in spans[19]][:1] == [len("token=abcdef123456")]


def test_toxic_documents_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.toxicity_stage(spark, docs, "/root/testdata/sf0.01")
    assert kept.columns == corpus_pipeline.COLUMNS
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    clean, toxic = [r.doc_id in ids for r in labels if r.toxic == 0], [r.doc_id in ids for r in labels if r.toxic == 1]
    assert sum(clean) > 0.97 * len(clean) and sum(toxic) < 0.25 * len(toxic)  # some 320 labels to learn from


def test_whole_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "suffix array", "secrets", "packing"]
    pieces = queries()["pipeline"](spark, SF).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == corpus_pipeline.COLUMNS
    want = {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == want
