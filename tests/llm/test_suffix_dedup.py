"""Suffix sorting against sorted slices, and removal against a table of all strings."""

import hashlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("clausewright.llm")

from clausewright.llm import suffix_dedup as sd
from clausewright.llm.queries import queries

SF = "/root/testdata/sf0.001"


def plain(raws, width):
    """Runs of removed bytes of each text, from a count of every string."""
    count = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - width + 1):
            if count[r[i : i + width]] > 1:
                gone[i : i + width] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[:-1].astype(int), [0]])))
        out.append((int(gone.sum()), len(edge) // 2, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in [*range(0, 40), 200, 401]:
        for letters in (1, 2, 5, 250):
            s = rng.integers(1, letters + 1, n)
            assert sd.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist()) or (letters == 1 and n > 3**6)


def test_shallow_recursion_keeps_equal_prefixes_together():
    rng = np.random.default_rng(2)
    block = rng.integers(97, 100, 60, dtype=np.uint8).tobytes()
    spans = [block * 4, block[5:] + b"x" * 40, b"ab" * 70, rng.integers(97, 99, 300, dtype=np.uint8).tobytes()]
    for width in (1, 5, 20, 27):
        got = sd.repeated(spans, width)
        count = Counter(s[i : i + width] for s in spans for i in range(len(s) - width + 1))
        assert [g.tolist() for g in got] == [[count[s[i : i + width]] > 1 for i in range(len(s) - width + 1)] for s in spans]


def test_anchor_runs_cover_and_agree():
    rng = np.random.default_rng(3)
    shared = rng.integers(97, 123, 900, dtype=np.uint8).tobytes()
    a = rng.integers(97, 123, 700, dtype=np.uint8).tobytes() + shared
    b = shared + rng.integers(97, 123, 500, dtype=np.uint8).tobytes()
    of = {}
    for name, raw in (("a", a), ("b", b)):
        edges, anchors, places, size = sd.anchor_runs(sd.laid_out(raw, sd.BYTES)[1], 400, 32)
        assert size == 32 and (places >= edges[1:] - 1).all() and (places + size <= edges[:-1] + 400).all()
        assert edges[0] == 0 and edges[-1] == len(raw) - 399 and (np.diff(edges) > 0).all()
        of[name] = np.repeat(anchors, np.diff(edges))
    assert (of["a"][700:1201] == of["b"][:501]).all()


def test_texts_side_by_side_have_the_runs_of_each():
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 100, n, dtype=np.uint8).tobytes() for n in (40, 41, 500)] + [b"ab" * 60, b"z" * 90]
    symbols = [sd.laid_out(t, sd.BYTES)[1] for t in texts]
    text, begin, end, anchor, twin = sd.runs_of(np.concatenate(symbols), np.array([len(t) for t in texts]), 40, 8)
    for k, (t, s) in enumerate(zip(texts, symbols, strict=True)):
        edges, anchors, places, size = sd.anchor_runs(s, 40, 8)
        mine = text == k
        assert begin[mine].tolist() == edges[:-1].tolist() and end[mine].tolist() == edges[1:].tolist() and anchor[mine].tolist() == anchors.tolist()
        grams = Counter(t[i : i + size] for i in range(len(t) - size + 1))
        assert twin[mine].tolist() == [grams[t[p : p + size]] > 1 for p in places.tolist()]


def plain_words(texts, width, split=str.split):
    """What is left of each text without its words under repeated strings of `width` words, and the removed bytes."""
    words = [split(t) for t in texts]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for t, w in zip(texts, words, strict=True):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = True
        at, left = 0, t[: len(t) - len(t.lstrip())]
        starts = []
        for x in w:
            at = t.index(x, at)
            starts.append(at)
            at += len(x)
        starts.append(len(t))
        left = t[: starts[0]] + "".join(t[starts[k] : starts[k + 1]] for k in range(len(w)) if not gone[k])
        out.append(left)
    return out


def check(spark, rows, width, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_bytes string, kept string").repartition(3)
    text = sd.text_of("text")
    found = sd.remove_repeats(df, width=width, **more)
    got = df.select("doc_id", *sd.keys_of(text)).join(found, ["k1", "k2"]).collect()
    raws = [(r[1] or "").encode() for r in rows]
    want = sorted((str(r[0]), len(raw), *p) for r, raw, p in zip(rows, raws, plain(raws, width), strict=True))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want


def odd_rows():
    rng = np.random.default_rng(4)

    def prose(n):
        return "".join(rng.choice(list("abcdé ")) for _ in range(n))

    shared, copy = prose(90), prose(150)
    rows = [(k, prose(int(rng.integers(0, 60))) + shared[int(rng.integers(0, 40)) :] + prose(20), "c", "c") for k in range(25)]
    for k in range(25, 45):  # near copies
        at = int(rng.integers(0, 140))
        rows.append((k, copy[:at] + "#" + copy[at + 1 :], "c", "c"))
    rows += [(50, copy, "c", "c"), (50, copy, "c", "c"), (51, None, None, None), (None, "", "c", "c"), (52, "En " * 90, "c", "c"), (53, "x" * 39, "c", "c"), (54, "x" * 40, "c", "c"), (55, "y" * 41, "c", "c")]
    return rows


@pytest.mark.parametrize("more", [{}, {"piece": 300}, {"hot": 3}])
def test_removal_equals_brute_force(spark, more):
    check(spark, odd_rows(), 40, **more)


@pytest.mark.parametrize("size", [0, 200, 2000])
def test_large_anchors_are_named(spark, size):
    check(spark, odd_rows(), 40, most=size)


def test_few_long_spans_are_hot(spark):
    rows = [(1, 7, (0, 1_500_000)), (1, 8, (0, 600_000)), (2, 7, (0, 1_900_000)), *((3, k, (0, 1)) for k in range(5001)), *((4, k, (0, 1)) for k in range(50))]
    classes = spark.createDataFrame([(*r, False) for r in rows], "anchor bigint, span bigint, one struct<begin:bigint,end:bigint>, twin boolean")
    got = {r.anchor: (r.kinds, r.hot) for r in sd._sizes(classes, 400, sd.HOT, sd.BYTES.most).collect()}
    assert got == {1: (2, True), 2: (1, False), 3: (5001, True), 4: (50, False)}
    assert sd.BYTES.most + sd.BYTES.piece < 3 << 20


def test_suffix_array_refuses_keys_over_63_bits():
    s = np.arange(1, 1 + (1 << 21))
    assert sd.suffix_array(s[:-1]).tolist() == list(range((1 << 21) - 1))
    with pytest.raises(AssertionError):
        sd.suffix_array(s)


def word_rows():
    rng = np.random.default_rng(6)

    def prose(n):
        return [f"w{x}" for x in rng.integers(0, 60, n)]

    def spaced(words):
        return "".join(w + str(rng.choice([" ", "  ", "\n", " \t"])) for w in words)

    out, planted = [], []
    for n in (51, 60, 80):
        for _ in range(6):
            passage = prose(n)
            for _ in range(int(rng.integers(2, 5))):
                planted.append(len(out))
                out.append(spaced(prose(int(rng.integers(0, 90))) + passage + prose(int(rng.integers(0, 90)))))
    for _ in range(6):  # passages of 50 words stay
        passage = prose(50)
        out += [spaced([f"a{k}", *passage, f"b{k}"]) for k in range(2)]
    edited = prose(160)
    for k in range(20):
        other = list(edited)
        other[int(rng.integers(0, 160))] = f"edit{k}"
        out.append(spaced(other))
    out += [spaced(prose(200)) for _ in range(15)]
    out += ["", " ", "one two", "ja " * 130, " ".join(["x", "y"] * 80), out[0], "word " * 50, "é" * 3000]
    return out, planted


@pytest.mark.parametrize("more", [{}, {"piece": 60}, {"hot": 2}, {"most": 100}])
def test_word_passages_equal_brute_force(spark, more):
    texts, planted = word_rows()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    found = sd.remove_repeats(df, width=sd.PASSAGE, unit=sd.WORDS, **more)
    got = {r.doc_id: bytes(r.kept).decode() for r in df.select("doc_id", *sd.keys_of(sd.text_of("text"))).join(found, ["k1", "k2"]).collect()}
    want = plain_words(texts, sd.PASSAGE)
    assert got == dict(enumerate(want))
    assert all(len(want[k]) < len(texts[k]) for k in planted)


def test_characters_of_unspaced_scripts_are_words(spark):
    rng = np.random.default_rng(8)
    passage = "".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 500, 55))
    texts = ["a b " + passage + " c", "\u65e5" + passage + "d", "e" * 500, "e" * 500 + "f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.text for r in sd.without_repeats(df, width=51, unit=sd.WORDS).collect()}
    assert got == {0: "a b c", 1: "\u65e5d", 2: texts[2], 3: texts[3]}


def test_passages_are_counted_beside(spark):
    texts, planted = word_rows()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = sd.remove_repeats(df, passages=sd.PASSAGE)
    got = {r.doc_id: (r.n_passages, r.passage_bytes) for r in df.select("doc_id", *sd.keys_of(sd.text_of("text"))).join(found, ["k1", "k2"]).collect()}
    want = [len(t.encode()) - len(w.encode()) for t, w in zip(texts, plain_words(texts, sd.PASSAGE), strict=True)]
    assert [got[k][1] for k in range(len(texts))] == want
    assert all((got[k][0] > 0) == (want[k] > 0) for k in range(len(texts))) and all(got[k][0] for k in planted)


def test_clashing_names_and_discard(spark):
    from pathlib import Path

    from clausewright.llm.common import discard, shared_folder

    rows = [(1, "x" * 500, 1, 2, "a", "b"), (2, "x" * 499, 3, 4, "c", "d"), (3, None, 5, 6, "e", "f")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, k1 int, _X0 int, kept string, _kept string")
    got = sd.without_repeats(df).collect()
    assert sorted((r.doc_id, r.text, r.k1, r._X0, r.kept, r._kept) for r in got) == [(1, "", 1, 2, "a", "b"), (2, "", 3, 4, "c", "d"), (3, "", 5, 6, "e", "f")]
    discard(spark)
    assert not [p for p in Path(shared_folder(spark).removeprefix("file:")).glob("*_*") if p.name.startswith(("distinct_texts_", "table_"))]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("distinct_texts_")]


def test_neighbours_are_compared_by_their_bytes():
    s = np.array([1, 2, 3, 4, 1, 2, 3, 5, 9, 2, 3, 4])
    i, j = np.array([0, 1, 1, 2, 4]), np.array([4, 5, 9, 10, 8])
    assert sd._verified(s, i, j, 2).tolist() == [True, True, True, True, False]


@pytest.mark.parametrize("top", [3, 200, 300, 70_000])
def test_comparison_takes_every_symbol(top):
    rng = np.random.default_rng(top)
    s = rng.integers(top - 2, top, 400)
    s = np.concatenate([s, s, [0]])
    for width in (1, 2, 3, 7, 8, 9, 40):
        other = s.copy()
        other[rng.integers(0, 800, 20)] = 1
        i = np.concatenate([np.arange(300), rng.integers(0, 700, 200)])
        j = np.concatenate([np.arange(300) + 400, rng.integers(0, 700, 200)])
        assert sd._verified(other, i, j, width).tolist() == [other[a : a + width].tolist() == other[b : b + width].tolist() for a, b in zip(i.tolist(), j.tolist(), strict=True)]


def test_pairs_are_not_compared_one_by_one(monkeypatch):
    rng = np.random.default_rng(11)
    text = rng.integers(97, 123, 900, dtype=np.uint8)
    spans = []
    for _ in range(30):  # near copies: the neighbours of a suffix lie in ever other spans
        near = text.copy()
        near[rng.integers(0, 900, 2)] = 35
        spans.append(near.tobytes())
    calls = []
    monkeypatch.setattr(np, "array_equal", lambda a, b, f=np.array_equal: calls.append(1) or f(a, b))
    got = sd.repeated(spans, 400)
    count = Counter(x[i : i + 400] for x in spans for i in range(501))
    assert [g.tolist() for g in got] == [[count[x[i : i + 400]] > 1 for i in range(501)] for x in spans]
    assert len(calls) < 100


@pytest.mark.parametrize("unit", [sd.BYTES, sd.WORDS])
def test_an_anchor_counts_as_one_unit(unit):
    rng = np.random.default_rng(12)

    def text(n):
        return rng.integers(97, 99, n, dtype=np.uint8).tobytes() if not unit.words else b" ".join(b"w%d" % x for x in rng.integers(0, 2, n))

    def join(*parts):
        return (b" " if unit.words else b"").join(p for p in parts if p)

    anchors = {k: b"ANCHOR%d" % k for k in range(3)}
    if not unit.words:
        assert len({len(a) for a in anchors.values()}) == 1
    long = 1 if unit.words else 7
    width = long + 5
    names = [int(x) for x in rng.integers(0, 3, 80)]
    before, after = ([text(int(rng.integers(0, 6))) for _ in names] for _ in range(2))
    size = lambda x: (len(x.split()) if unit.words else len(x))
    held = [k for k in range(80) if size(before[k]) + size(after[k]) >= 5]
    names, before, after = ([x[k] for k in held] for x in (names, before, after))
    wholes = [join(b, anchors[n], a) for b, n, a in zip(before, names, after, strict=True)]
    got = sd.repeated(before, width - long + 1, unit, names, after)
    assert [g.tolist() for g in got] == [g.tolist() for g in sd.repeated(wholes, width, unit)]
    assert any(g.any() for g in got) and not all(g.all() for g in got)


def moved(spark, seen=0):
    """Rows that shuffles have written, in stages from `seen` on; and the next stage."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    kept = [(s.stageId(), s.shuffleWriteRecords()) for s in (stages.apply(k) for k in range(stages.size()))]
    return sum(n for k, n in kept if k >= seen), max((k for k, _ in kept), default=-1) + 1


def test_runs_that_cannot_repeat_move_once(spark):
    rng = np.random.default_rng(13)
    rows = [(k, rng.integers(97, 123, 4000, dtype=np.uint8).tobytes().decode()) for k in range(150)]
    texts = sd._distinct_texts(spark.createDataFrame(rows, "doc_id int, text string"), "text")
    runs = texts.select("k1", "k2", "text", "copies").mapInArrow(lambda it: sd._runs(it, 400, sd.BYTES), sd.RUN).count()
    _, first = moved(spark)
    assert sd.repeats(texts, 400, sd.BYTES).count() == 0
    assert runs > 2500 and moved(spark, first)[0] < 3 * runs


@pytest.mark.parametrize("unit", [sd.BYTES, sd.WORDS])
def test_halves_are_sent_without_their_anchor(spark, unit, monkeypatch, tmp_path):
    rng = np.random.default_rng(14)
    width = 400 if not unit.words else 51
    body = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
    texts = []
    for k in range(8):
        mine = list(body)
        for at in rng.integers(0, 400, 6):
            mine[at] = f"edit{k}"
        texts.append(" ".join(mine))
    real = sd._spans

    def noted(batches, *rest):
        import uuid

        for batch in real(batches, *rest):
            if "bytes" in batch.schema.names:
                for x, y, low in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    (tmp_path / uuid.uuid4().hex).write_text(f"{len(x) + len(y or b'')} {y is not None}")
            yield batch

    monkeypatch.setattr(sd, "_spans", noted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = sd.remove_repeats(df, width=width, unit=unit)
    got = {r.doc_id: bytes(r.kept).decode() for r in df.select("doc_id", *sd.keys_of(sd.text_of("text"))).join(found, ["k1", "k2"]).collect()}
    want = plain_words(texts, width) if unit.words else [p[2].decode() for p in plain([t.encode() for t in texts], width)]
    assert got == dict(enumerate(want))
    sent = [p.read_text().split() for p in tmp_path.iterdir()]
    assert sent and all(halved == "True" for _, halved in sent)
    if not unit.words:  # a string's bytes but for the anchor's 216, and the starts
        assert np.median([int(n) for n, _ in sent]) < 400


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert sd.remove_repeats(df).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    raws = [(d.text or "").encode() for d in docs]
    got = {r.doc_id: r for r in queries()["op6_suffix_array"](spark, SF).collect()}
    for d, raw, (removed, spans, kept) in zip(docs, raws, plain(raws, 400), strict=True):
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), removed, spans, hashlib.sha256(kept).hexdigest())
