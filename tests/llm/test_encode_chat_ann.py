"""SentencePiece ids against the library, role repair against a full search, nearest neighbours against brute force."""

import random
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("clausewright.llm")

from clausewright.llm import ann, chat, sentencepiece_codec
from clausewright.llm.queries import queries, tokenizer_path

SF = "/root/testdata/sf0.001"
MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))


def test_ids_are_the_librarys(spark, library):
    rows = {r.doc_id: r for r in queries()["op1_sentencepiece"](spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        r = rows[d.doc_id]
        assert r.ids == library.encode(d.text) and r.n_ids == len(r.ids)
        assert r.same == (library.decode(r.ids) == d.text)


def test_decode_and_odd_rows(spark, library):
    model = tokenizer_path(MODEL)
    rows = [(1, "One two  three.\nFour", "c"), (1, "One two  three.\nFour", "c"), (None, None, "c"), (2, "", None), (3, "word " * 30000, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(df, model), model).collect()
    assert sorted((str(r.id), r.decoded) for r in back) == sorted((str(i), t or "") for i, t, _ in rows)
    assert sentencepiece_codec.encode(df.limit(0), model).count() == 0


def test_odd_texts(library):
    c = sentencepiece_codec.codec(tokenizer_path(MODEL))
    rng = random.Random(1)
    batch = ["", "  a  b ", " ", "▁x▁▁y", "日本語🙂", "x" * 500, "ab" * 3000, "a\n\n\tb ﬁ", "   lead", "a\u0000b <s> <0x41>", "the " * 50 + "  ", "line \n next\n last "]
    batch += ["".join(rng.choice("aabcde  thein.\n▁éß日") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for text, ids in zip(batch, c.encode(batch), strict=True):
        assert ids == library.encode(text), text
        assert c.decode(ids) == library.decode(ids)


def test_unigram_models_take_the_best_sum():
    c = object.__new__(sentencepiece_codec.Codec)
    pieces = ["<unk>", "▁", "a", "b", "ab", "ba", "▁a", "aba", "▁ab"]
    scores = [0, -3.1, -2.2, -2.3, -3.05, -3.0, -3.7, -4.1, -4.9]
    c.n, c.pieces, c.scores, c.unknown, c.byte, c.merges = len(pieces), pieces, np.array(scores), 0, {}, False
    c.id_of = {p: i for i, p in enumerate(pieces) if i}
    c.longest = 3
    c.powers = np.array([pow(int(sentencepiece_codec._BASE), k, 1 << 64) for k in range(4)], np.uint64)
    keys = np.array([c._hash(p) for p in pieces[1:]], np.uint64)
    order = np.argsort(keys)
    c.keys, c.key_ids = keys[order], np.arange(1, 9)[order]
    c._directory()
    c.codes = np.zeros((9, 3), np.uint32)
    for i, p in enumerate(pieces[1:], 1):
        c.codes[i, : len(p)] = [ord(x) for x in p]

    def best(word):
        if not word:
            return 0.0
        return max([scores[i] + best(word[len(p) :]) for p, i in c.id_of.items() if word.startswith(p)], default=-np.inf)

    for word in ("▁" + "".join(w) for n in (1, 3, 6) for w in product("ab", repeat=n)):
        ids = c.viterbi(np.array([[ord(x) for x in word]], np.uint32))[0].tolist()
        assert "".join(pieces[i] for i in ids) == word and np.isclose(sum(scores[i] for i in ids), best(word))


def full_search(roles):
    """Least cost over every choice of moves."""
    best = {chat.START: 0}
    for r in roles:
        new = {}
        for s, c in best.items():
            for a, b, cost, _, _ in [m for m in chat.MOVES[chat.role_of(r)] if m[0] == s]:
                new[b] = min(new.get(b, 10**9), c + cost)
        best = new
    return min(c + chat.end_cost(s) for s, c in best.items())


def legal(roles):
    rest = roles[1:] if roles and roles[0] == "system" else roles
    return len(rest) > 0 and len(rest) % 2 == 0 and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(rest))


def messages(pieces):
    text = "".join(pieces)
    return [m.split("\n", 1) for m in text.split("<|im_start|>")[1:]], text


def test_every_short_conversation_is_repaired_at_the_least_cost():
    for n in (1, 2, 3, 4):
        for roles in product(("system", "user", "assistant", "tool", None), repeat=n):
            moves = chat.solve([chat.role_of(r) for r in roles])
            end = moves[-1][1]
            assert sum(m[2] for m in moves) + chat.end_cost(end) == full_search(roles)
            pieces = list(chat.render([(k, r, f"t{k}") for k, r in enumerate(roles)], chat.START, None, True))
            found, text = messages([p[4] for p in pieces])
            assert legal([m[0] for m in found]) and all(f"t{k}" in text for k in range(n))
            if legal(list(roles)):
                assert {p[3] for p in pieces} <= {"keep", "end"}


def test_parts_give_the_whole_cost():
    rng = random.Random(2)
    for _ in range(60):
        roles = [rng.choice([0, 1, 2, 3]) for _ in range(30)]
        cuts = sorted(rng.sample(range(1, 30), 3))
        parts = [roles[a:b] for a, b in zip([0, *cuts], [*cuts, 30], strict=True)]
        states = chat.chain_states([chat.compose(p) for p in parts])
        cost, before = 0, chat.START
        for p, s in zip(parts, states, strict=True):
            cost += sum(m[2] for m in chat.solve(p, before, s))
            before = s
        whole = chat.solve(roles)
        assert cost + chat.end_cost(before) == sum(m[2] for m in whole) + chat.end_cost(whole[-1][1])


def rendered(df):
    by = defaultdict(list)
    for r in df.orderBy("place").collect():
        by[r.conv_id].append(r)
    return by


def test_chat_query(spark):
    by = rendered(queries()["op2_chat"](spark, SF))
    source = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        source[r.conv_id].append(r)
    assert set(by) == set(source)
    for conv, rows in source.items():
        found, text = messages([r.piece for r in by[conv]])
        assert legal([m[0] for m in found]) and text.endswith(chat.CLOSE)
        plain = "".join(p[4] for p in chat.render([(r.turn, r.role, r.text) for r in rows], chat.START, None, True))
        assert text == plain


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(3)
    rows = [(7, k, rng.choice(["user", "assistant", "system", "x", None]), f"t{k}", "clash") for k in range(900)]
    rows += [(8, 0, "user", "same", "c")] * 60 + [(None, None, None, None, None), (9, 0, "assistant", "z", "c")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, piece string").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        by = rendered(chat.repair(df))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert set(by) == {7, 8, 9, None}
    found, text = messages([r.piece for r in by[7]])
    assert legal([m[0] for m in found])
    assert [r.turn for r in by[7] if r.turn is not None] == list(range(900))
    cost = sum({"merge": 1, "relabel": 3, "insert": 2}[a] if not (a == "relabel" and chat.role_of(r.role) == 0) else 1 for r in by[7] for a in r.action.split("+") if a not in ("keep", "end"))
    assert cost == full_search([r[2] for r in rows[:900]])
    assert sum(r.action == "merge" for r in by[8]) == 59
    assert chat.repair(df.limit(0)).count() == 0


def brute(vectors, k=20):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], np.float64)
    out = {}
    for n in np.flatnonzero(ids % 20 == 0):
        s = (x * x[n]).sum(axis=1)
        rows = np.flatnonzero(ids != ids[n])
        best = rows[np.lexsort((ids[rows], -s[rows]))][:k]
        out[int(ids[n])] = [(int(ids[b]), s[b]) for b in best]
    return out


def recall_of(rows, want):
    got = defaultdict(list)
    for r in rows:
        got[r.query_id].append(r)
    hits = total = 0
    for q, best in want.items():
        mine = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(best) + 1))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += len({r.vec_id for r in mine} & {i for i, _ in best})
        total += len(best)
    assert set(got) == set(want)
    return hits / total


def test_ann_recall(spark):
    rows = queries()["op4_ann"](spark, SF).collect()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert recall_of(rows, brute(vectors)) >= 0.9
    x = {i: np.array(v, np.float64) for i, v in vectors}
    assert all(np.isclose(r.score, x[r.query_id] @ x[r.vec_id], rtol=1e-12, atol=1e-12) for r in rows)


def test_ann_odd_vectors(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(np.float32(v)) for v in rng.normal(size=8) * (1 + i % 5)]) for i in range(120)]
    good += [(i, [1.0] * 8) for i in range(120, 180)]  # ties
    bad = [(200, None), (201, [0.0] * 8), (202, [float("nan")] + [1.0] * 7), (203, [float("inf")] + [1.0] * 7), (204, [1.0]), (205, [None] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "c") for i, v in good + bad], "vec_id bigint, embedding array<float>, score string").repartition(3)
    rows = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    assert recall_of(rows, brute(good)) >= 0.9
    tied = [r.vec_id for r in sorted(rows, key=lambda r: r.rank) if r.query_id == 120]
    assert not set(tied) & {200, 201, 202, 203, 204, 205}
    few = ann.search(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert [r.rank for r in sorted(few, key=lambda r: r.rank)] == [1, 2, 3, 4]
    assert ann.search(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_pigeonhole_probing_misses_no_code():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 32))
    rotation = ann.learn_rotations(x)
    c = ann.codes(x, rotation)
    for radius in (5, 17, 26):
        index = ann.Index(np.arange(600), x, rotation, radius)
        for q in range(0, 600, 60):
            found = np.logical_or.reduce(index.found[np.arange(c.shape[1]), c[q]])
            assert found[ann.distances(c, c[q]) <= radius].all()
