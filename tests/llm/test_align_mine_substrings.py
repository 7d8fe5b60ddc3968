"""Operators 11 to 13 against brute-force versions of their definitions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("clausewright.llm")

import duckdb
from pyspark.sql import functions as F

from clausewright.llm import alignment, hard_negatives, substring_dedup
from clausewright.llm.queries import oracle_sql, queries, tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "a", "a ", " a", "a  b", "a\n\n  b", "tab\t end\n", "a  b", "　 x  y", "▁ b", "x <|endoftext|> y <s> <unk> <0x41>", "日本語 テキスト", "é é ́x", "👩‍👩‍👧 ok", "nul\x00 z", "it's  'll we’re", "z" * 3000, " " * 2000 + "end", "ab " * 1500, "1234567 89"]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    letters = alignment.byte_letters()
    out, holders = [], Counter()
    for text in texts:
        groups = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            xs = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
            ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(xs) == b"".join(ys) == (" " + text).encode():
                ends = [np.cumsum([len(t) for t in ts]).tolist() for ts in (xs, ys)]
                low = [0, 0]
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    to = [e.index(cut) + 1 for e in ends]
                    groups.append((x[low[0] : to[0]], y[low[1] : to[1]]))
                    low = to
        links = Counter((i, j) for p, q in groups for i in p for j in q)
        holders.update(links.keys())
        out.append((groups, links))
    most = Counter()
    for (i, _), n in holders.items():
        most[i] = max(most[i], n)
    write = lambda groups: ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
    return [
        (sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), sum(k.values()), sum(n for p, n in k.items() if holders[p] == most[p[0]]), sum(n * holders[p] for p, n in k.items()), write(g))
        for g, k in out
    ]


PATHS = [tokenizer_path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def test_alignment_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in [*COLUMNS, "groups_sha256"]) for r in queries()["op12_alignment"](spark, SF).collect()}
    want = {r.doc_id: (*x[:6], sha(x[6]) if x[6] else "") for r, x in zip(docs, plain_alignment([r.text for r in docs]), strict=True)}
    assert got == want


@pytest.mark.parametrize("block, slice_", [(1 << 22, 1 << 21), (40, 7)])
@pytest.mark.parametrize("ranks", [True, False])
def test_alignment_of_odd_texts(spark, monkeypatch, block, slice_, ranks):
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "SLICE", slice_)
    monkeypatch.setattr(alignment, "CHUNK", 50)
    texts = [*ODD, *ODD[:6], "ab " * 9, "the cat sat"]
    held = [t or "" for t in texts]
    x = alignment.Block(held, alignment.tokenizers(PATHS[0], PATHS[1] if ranks else None, PATHS[2]))
    want = plain_alignment(texts)
    assert [g.decode() for g in x.groups] == [w[6] for w in want]
    assert [t for t in zip(x.n_a, x.n_b, x.n_groups, x.n_links, strict=True)] == [w[:4] for w in want]
    df = spark.createDataFrame([(k if k % 5 else None, t, "n", 1) for k, t in enumerate(texts)], "doc_id bigint, text string, block string, code int").repartition(3)
    got = sorted((tuple(r[c] for c in [*COLUMNS, "groups"]) for r in alignment.align(df, *PATHS).collect()))
    assert got == sorted(want)
    assert alignment.align(df.where("false"), *PATHS).count() == 0


def test_wide_groups_count_each_pair():
    class Same:
        a_bytes = b_bytes = [b"x"] * 9
        a_sizes, b_sizes = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8]), np.array([0, 1, 2, 3, 4, 5, 6, 7, 8])

    a, b = np.array([3, 3, 3, 1, 2]), np.array([2, 2, 2, 4, 2])
    x = alignment.Aligned(a, np.array([5]), b, np.array([5]), Same)
    found = {(int(x.codes[p]) >> 32, int(x.codes[p]) & 0xFFFF): int(n) for p, n in zip(x.places, x.times, strict=True)}
    groups = [([3, 3], [2, 2, 2]), ([3, 1], [4]), ([2], [2])]
    assert x.n_groups.tolist() == [3] and found == Counter((i, j) for p, q in groups for i in p for j in q)


def plain_mining(rows):
    """rows: (id, label, vector)."""
    ok = [(i, k, [math.floor(256 * c) for c in v]) for i, k, v in rows if i is not None and k is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, k, v in ok:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in ok if j != i)
        for s, j, _ in [x for x in scored if x[2] == k][:5]:
            far = [(-t, n) for t, n, m in scored if m != k and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, j, r, n, -s, t) for r, (t, n) in enumerate(far, 1)]
    return sorted(out)


ORDER = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def _mined(df, **kinds):
    return sorted(tuple(r[c] for c in ORDER) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **kinds).collect())


def test_mining_query(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = queries()["op11_hard_negatives"](spark, SF)
    assert dict(got.dtypes)["rank"] == "int"
    want = plain_mining([(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in t])
    assert want and sorted(tuple(r[c] for c in ORDER) for r in got.collect()) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    found = con.execute(oracle_sql()["op11_hard_negatives"]).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(tuple(r[names.index(c)] for c in ORDER) for r in found) == want


@pytest.mark.parametrize("spread", [0.2, 40.0])
def test_mining_with_ties_and_cells(spark, spread):
    rng = np.random.default_rng(8)
    base = rng.normal(0, spread, (12, 6)).round(1)
    rows = [(i, int(rng.integers(0, 3)), base[rng.integers(0, 12)].tolist()) for i in range(420)]
    odd = [(1001, None, base[0].tolist()), (1002, 1, None), (None, 1, base[1].tolist()), (1003, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1004, 1, [math.nan] * 6), (1005, 1, [math.inf] + [0.0] * 5)]
    schema = "vec_id bigint, label int, embedding array<double>"
    want = plain_mining([*rows, *odd])
    more = [(1006, 1, [0.5] * 5), (1007, 2, [1e9] * 6), (1008, 0, [])]  # other length, too large, empty
    df = spark.createDataFrame([(*r, 5, "x", 0) for r in [*rows, *odd, *more]], schema + ", id int, v string, cell int")
    assert want and _mined(df) == want
    assert _mined(df, components=500, group=2) == want
    assert _mined(df.where("false")) == []
    twice = df.unionByName(spark.createDataFrame([(*r, 5, "x", 0) for r in rows[:150]], df.schema))
    assert _mined(twice, components=900) == want


def test_bit_planes_drop_candidates_and_keep_scores():
    rng = np.random.default_rng(4)
    rows, anchors = rng.integers(-200, 200, (3000, 32)), rng.integers(-200, 200, (5, 32))
    best = [[hard_negatives.Best((-hard_negatives.EVER, hard_negatives.EVER), 5), hard_negatives.Best((10_000, 90_000), 3)] for _ in anchors]
    left = hard_negatives.search(anchors, np.ones((5, 3000), bool), rows, np.arange(3000), best)
    assert left < 1500  # of 15,000 pairs
    for a, (every, band) in zip(anchors, best, strict=True):
        scores = rows @ a
        order = np.lexsort((np.arange(3000), -scores))
        assert every.ids.tolist() == order[:5].tolist() and every.scores.tolist() == scores[order[:5]].tolist()
        within = [i for i in order.tolist() if 10_000 <= scores[i] <= 90_000][:3]
        assert band.ids.tolist() == within


def plain_removal(rows, width):
    """(id, text): words, and those left, of each row."""
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0]))
    seen, out = set(), {}
    for k in order:
        w = words[k]
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            x = tuple(w[s : s + width])
            if x in seen:
                gone[s : s + width] = [True] * width
            seen.add(x)
        out[k] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return [out[k] for k in range(len(rows))]


def _removed(spark, rows, **kinds):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, k1 int, ord string").repartition(3)
    left = substring_dedup.remove_copied(df, **kinds)
    got = df.select("doc_id", "text", *[c.alias(n) for c, n in zip(substring_dedup.keys_of(F.coalesce("text", F.lit(""))), ("a", "b"), strict=True)]).join(left.withColumnsRenamed({"k1": "a", "k2": "b"}), ["a", "b"]).collect()
    assert len(got) == len(rows)
    width = kinds.get("width", 20)
    first = lambda r: (r.doc_id if r.doc_id is not None else substring_dedup.LAST) == r.ord or r.n_words < width
    return Counter((r.doc_id, r.text, r.n_words, *((r.n_removed, bytes(r.kept)) if first(r) else (r.n_words, b""))) for r in got)


def test_substring_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, m, sha(k)) for (i, _), (n, m, k) in zip(docs, plain_removal(docs, 20), strict=True)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries()["op13_substring_dedup"](spark, SF).collect()} == want
    assert sum(m for _, m, _ in want.values()) > 0


@pytest.mark.parametrize("kinds", [{}, {"hot": 1, "piece": 1}, {"most": 12, "piece": 60}, {"gram": 1}])
def test_substrings_of_odd_texts(spark, kinds):
    rng = np.random.default_rng(9)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 60, n))
    passages = [word(n) for n in (6, 9, 14, 30)]
    texts = ["", None, " \t\n", "a b c", "a " * 40, "a b " * 30, "é x " * 25, word(300)]
    texts += [" ".join(rng.permutation([word(int(rng.integers(1, 9))), *[passages[k] for k in rng.integers(0, 4, 3)], word(5)])) for _ in range(60)]
    texts += [texts[9], texts[10].replace(" ", "\n"), texts[4]]
    rows = [(int(k), t) for k, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    rows += [(None, texts[12]), (500, passages[2]), (None, passages[3] + " z"), (None, passages[3] + " z")]
    want = plain_removal(rows[:-1], 6)
    assert _removed(spark, rows, width=6, **kinds) == Counter((*r, *w) for r, w in zip([*rows[:-1], rows[-1]], [*want, want[-1]], strict=True))
    assert sum(w[1] for w in want) > 500


def test_matching_statistics():
    rng = np.random.default_rng(10)
    for letters in (1, 2, 3):
        shards = [rng.integers(0, letters, n).tolist() for n in (0, 1, 7, 30, 30, 12)]
        a = substring_dedup.Automaton()
        for s in shards:
            a.add(s)
        first, at = {}, 0
        for s in shards:
            for j in range(len(s)):
                for i in range(j + 1):
                    first.setdefault(tuple(s[i : j + 1]), at + j)
            at += len(s)
        text = rng.integers(0, letters + 1, 60).tolist()
        for width in (1, 4, 9, 100):
            for j, (length, end) in enumerate(a.matches(text, width)):
                known = [n for n in range(min(j + 1, width) + 1) if not n or tuple(text[j + 1 - n : j + 1]) in first]
                assert length == max(known)
                assert not length or end == first[tuple(text[j + 1 - length : j + 1])]
