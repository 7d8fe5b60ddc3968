"""Queries whose whole job shows on small tables of planted cases."""

import hashlib

import pytest

from clausewright.plans import QUERIES


@pytest.fixture
def tables(spark, tmp_path):
    def make(docs, questions=()):
        spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
        if questions:
            spark.createDataFrame(questions, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
        return str(tmp_path)

    return make


def test_zero_fill_keeps_every_hit(spark, tables):
    docs = [(k, "apple " + "pear " * k if k % 9 == 8 else f"plum {k}", "en", "s", 1) for k in range(60)]
    rows = sorted(QUERIES["bm25_zero_fill"](spark, tables(docs, [(1, "apple")])).collect(), key=lambda r: r["rank"])
    assert [r.doc_id for r in rows] == [8, 17, 26, 35, 44, 53, *[k for k in range(16) if k != 8][:14]]
    assert [r.score > 0 for r in rows] == [True] * 6 + [False] * 14


def test_gold_is_found_behind_copies_and_other_languages(spark, tables):
    docs = [(k, "apple", "de", "s", 1) for k in range(7)] + [(k, "apple apple apple", "en", "s", 1) for k in range(7, 14)]
    docs += [(20, "apple pie " + "cream " * 300, "fr", "s", 1)] + [(k, f"plum {k}", "en", "s", 1) for k in range(30, 90)]
    rows = QUERIES["gold_finder"](spark, tables(docs, [(1, "apple pie")])).collect()
    assert [(r.doc_id, r.overlap, r.accepted) for r in rows] == [(20, 1.0, True)]


def test_paragraphs_join_lines(spark, tables):
    line = "x" * 30
    texts = ["\n".join([line] * 3), "\n".join([line, "", line]), "\n".join([line, line, "ARTICLE 4 Leave", line, line, line]), "\n".join([line] * 19), "y" * 81, ""]

    def plain(text):
        out, held = [], []
        for x in [*text.split("\n"), ""]:
            stop = not x.strip() or x.startswith("ARTICLE ")
            held += [] if stop else [x.strip()]
            if stop or len(held) == 8:
                out, held = [*out, " ".join(held)], []
        return sum(len(p) > 80 for p in out)

    got = {r.doc_id: r.n for r in QUERIES["paragraph_reconstruction"](spark, tables([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)])).collect()}
    assert got == {k: plain(t) for k, t in enumerate(texts)} == {0: 1, 1: 0, 2: 1, 3: 3, 4: 1, 5: 0}


def test_merged_bodies_hold_whole_texts(spark, tables):
    texts = [" ".join(f"w{k}x{i}" for i in range(n)) for k, n in enumerate([5, 60, 12, 45, 29, 30, 4])]
    rows = QUERIES["clause_merge_short"](spark, tables([(k, t, "en", "s", 3) for k, t in enumerate(texts)])).collect()
    want = ["\n".join(texts[a:b]) for a, b in ((0, 2), (2, 4), (4, 7))]
    assert [r.body for r in sorted(rows, key=lambda r: r.gid)] == [hashlib.md5(w.encode()).hexdigest() for w in want]
