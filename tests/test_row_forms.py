"""Forms without a call or a copy for each row, against plain ones."""

import random

import numpy as np
from pyspark.sql import functions as F

from clausewright.functions import text
from clausewright.operators import analysis, layout, loop, retrieval


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_adjacent_sentences_are_cut_once(spark):
    rows = [(1, ["a", "b", "c"]), (2, ["a"]), (3, []), (4, None), (5, [f"s{k}" for k in range(3000)])]
    df = spark.createDataFrame(rows, "k int, s array<string>").select("k", text.adjacent(F.col("s")).alias("p"))
    want = {k: [f"{a} {b}" for a, b in zip(s or [], (s or [])[1:])] for k, s in rows}
    assert {r.k: r.p for r in df.collect()} == want
    assert "element_at" not in plan(df)


def lines(words):
    rows = []
    for y, x0, w in sorted(words):
        if rows and abs(y - rows[-1][0]) <= layout.TOLERANCE:
            rows[-1][1].append((x0, w))
            rows[-1][0] += (y - rows[-1][0]) / len(rows[-1][1])
        else:
            rows.append([y, [(x0, w)]])
    out = []
    for _, members in rows:
        t = " ".join(w for _, w in sorted(members))
        if out and out[-1].endswith("-"):
            out[-1] = out[-1][:-1] + t
        elif out and t[:1].islower():
            out[-1] += " " + t
        else:
            out.append(t)
    return out


def test_pages_come_in_batches(spark):
    r = random.Random(4)
    rows = [(d, p, r.choice(["Ab", "cd", "Ef-", "é", "Zz"]), x, x + 50.0, r.randint(0, 9) * 5.0 + r.random() * 4, 480.0) for d in range(20) for p in (1, 2) for x in [r.randint(0, 7) * 60.0 for _ in range(r.randint(1, 30))]]
    df = layout.column_lines(spark.createDataFrame(rows, "doc_id bigint, page_no int, word string, x0 double, x1 double, y double, width double"))
    assert "InPandas" not in plan(df)
    pages = {}
    for d, p, w, x0, x1, y, width in rows:
        pages.setdefault((d, p, "left" if (x0 + x1) / 2 < width / 2 else "right"), []).append((y, x0, w))
    want = {(*key, n, t) for key, words in pages.items() for n, t in enumerate(lines(words))}
    assert {tuple(x) for x in df.collect()} == want
    paired = layout.paired_columns(df)
    held = {(d, p, "en" if s == "left" else "fr", n) for d, p, s, n, _ in want}
    for x in paired.collect():
        other = "fr" if x.language == "en" else "en"
        n = int(x.chunk_id[-3:])
        assert x.partner_chunk_id == (f"{x.doc_id}_p{x.page_no:03d}_{other}_{n:03d}" if (x.doc_id, x.page_no, other, n) in held else None)
    assert "Join" not in plan(paired)


def test_box_holds_no_group_in_one_task(spark):
    r = random.Random(8)
    rows = [(g, float(r.randint(0, 500))) for g in "abc" for _ in range(r.randint(30, 400))] + [("d", 5.0), ("e", None), ("e", 1.0), ("e", 2.0)]
    df = analysis.box(spark.createDataFrame(rows, "g string, v double"), "g", "v")
    want = {}
    for g in {x for x, _ in rows}:
        v = [x for n, x in rows if n == g and x is not None]
        low, high = np.quantile(v, [0.25, 0.75])
        want[g] = (round(low, 4), round(high, 4), max(x for x in v if x <= high + 1.5 * (high - low)))
    assert {x.g: (x.q1, x.q3, x.whisker) for x in df.collect()} == want
    assert " percentile(" not in plan(df)


def test_neighbours_over_tiles():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(230, 5)).round(1)
    x[50:90] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rng.permutation(230)
    tiles = [(ids[a:b], x[a:b]) for a, b in ((0, 3), (3, 100), (100, 101), (101, 230))]
    got = retrieval._first_k(ids[:9], x[:9], tiles, 6, False).to_pydict()
    want = []
    for n in range(9):
        order = sorted((-round(float(x[n] @ x[m]), 6), int(ids[m])) for m in range(230) if m != n)[:6]
        want += [(int(ids[n]), d) for _, d in order]
    assert list(zip(got["item_id"], got["doc_id"], strict=True)) == want


def test_an_attempt_is_made_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(loop, "kept", lambda df: made.append(df.count()) or df)
    questions = spark.createDataFrame([(1, "one two"), (2, "three four")], "item_id bigint, text string")
    out = loop.run(questions, lambda q: q.select("item_id", F.lit(7).cast("bigint").alias("doc_id"), F.lit("one two").alias("chunk")), 2)
    assert sorted((r.item_id, r.attempts, r.grounded) for r in out.collect()) == [(1, 1, True), (2, 2, False)] and made == [2]


def test_a_mean_on_a_tie_does_not_depend_on_order(spark):
    r = random.Random(1)
    half = [r.randint(100, 9000) / 100 for _ in range(400)]
    rows = [(k, v) for k in range(40) for v in r.sample([x for h in half for x in (h, 108.7 - h)], 800)]  # each mean is 54.35
    df = spark.createDataFrame(rows, "k int, v double").groupBy("k").agg(F.round(analysis.exact_mean(F.col("v")), 1).alias("m"))
    assert {x.m for x in df.collect()} == {54.4}
    odd = spark.createDataFrame([(1, 1e300), (1, 1e300), (2, float("nan")), (2, 1.0), (3, None), (4, None), (4, 2.0)], "k int, v double")
    assert {x.k: str(x.m) for x in odd.groupBy("k").agg(analysis.exact_mean(F.col("v")).alias("m")).collect()} == {1: "1e+300", 2: "nan", 3: "None", 4: "2.0"}
