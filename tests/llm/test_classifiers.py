"""The factorisation machine and the recurrent network: formulas, gradients, folds and held-out accuracy."""

import string
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

pytest.importorskip("clausewright.llm")

from clausewright.llm import quality, toxicity

SF = "/root/testdata/sf0.01"
ODD = "doc_id bigint, text string, score string, label string"


def test_pair_term_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    size = quality.N_STATS + quality.BUCKETS
    m = quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.RANK)))
    found = [quality.features(t) for t in (b"One two two | three!!", b"", b"a b c d e f g")]
    sizes = np.array([len(i) for i, _ in found])
    got = m.score(np.concatenate([i for i, _ in found]), np.concatenate([x for _, x in found]), np.cumsum(sizes) - sizes)
    for z, (i, x) in zip(got, found, strict=True):
        want = 0.3 + (m.weight[i] * x).sum()
        for a in range(len(i)):
            for b in range(a + 1, len(i)):
                want += m.factor[i[a]] @ m.factor[i[b]] * x[a] * x[b]
        assert np.isclose(z, want)


def test_network_gradients_are_the_slopes(monkeypatch):
    for name, value in (("HIDDEN", 3), ("DIM", 4), ("ATTEND", 3)):
        monkeypatch.setattr(toxicity, name, value)
    net = toxicity.Network.fresh(np.random.default_rng(2))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    v = toxicity.Vocabulary()
    ids, mask = toxicity._laid_out([v(w) for w in ([b"ab", b"c"], [b"c", b"ab", b"dde", b"c"], [b""])])
    x = np.random.default_rng(3).normal(size=(len(v.ids), 4))
    ids_mask = (ids, mask.astype(np.float64))
    weights = np.array([0.7, -1.1, 0.4])

    def loss():
        return float(net.run(x, *ids_mask)[0].astype(np.float64) @ weights)

    _, kept = net.run(x, *ids_mask, keep=True)
    g, dx = net.grads(x, *ids_mask, kept, weights)
    for name, values, d in [(k, net.p[k], g[k]) for k in g] + [("x", x, dx)]:
        flat, slope = values.reshape(-1), np.asarray(d).reshape(-1)
        for k in range(0, len(flat), max(1, len(flat) // 4)):
            old = flat[k]
            flat[k] = old + 1e-2
            up = loss()
            flat[k] = old - 1e-2
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-2 - slope[k]) < 5e-3, (name, k)


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 112, 113, 500):
        starts = toxicity.windows_of(n)
        covered = {k for s in starts for k in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n)) and len(starts) == len(set(starts))


def test_worst_window_decides():
    net = toxicity.Network.fresh(np.random.default_rng(4))
    words = [f"w{k % 13}x{k % 7}" for k in range(300)]
    whole = toxicity.score_texts(net, [" ".join(words), "", "short one"])
    each = [toxicity.score_texts(net, [" ".join(words[s : s + toxicity.WINDOW])])[0] for s in toxicity.windows_of(300)]
    assert np.isclose(whole[0], max(each), atol=1e-4) and np.isfinite(whole).all()


@pytest.mark.parametrize("seed", [11, 13])
def test_few_labels_beat_the_majority(seed):
    """Some 330 labels, 45 of them toxic; two of the six held-out toxic texts have no word that other toxic texts have."""
    docs, labels = (pq.read_table(f"{SF}/{t}.parquet").to_pylist() for t in ("documents", "labels"))
    label = {r["doc_id"]: r["toxic"] for r in labels}
    rows = [(zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0, d["text"] or "", label[d["doc_id"]]) for d in docs if d["doc_id"] in label]
    net = toxicity.fit([(t, y) for held, t, y in rows if not held], seed)
    held = [(t, y) for h, t, y in rows if h]
    said, truth = toxicity.score_texts(net, [t for t, _ in held]) >= 0, np.array([y for _, y in held]) == 1
    assert (said == truth).mean() > max(truth.mean(), 1 - truth.mean()) + 0.02
    assert said[truth].mean() >= 1 / 3 and said[~truth].mean() <= 0.02


def test_words_have_keys_of_their_own():
    v = toxicity.Vocabulary()
    v([f"{a}{b}{c}".encode() for a in "abcdefgh" for b in "ijklmnop" for c in range(200)])
    assert len(np.unique(v.rows()[0])) == len(v.ids)


def plain_logit(net, text):
    """The network's definition, one window, one word and one step at a time."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    words = text.lower().translate(str.maketrans(string.punctuation, " " * len(string.punctuation))).split() or [""]
    sig = lambda a: 1 / (1 + np.exp(-a))
    h, out = toxicity.HIDDEN, []
    for start in toxicity.windows_of(len(words)):
        xs = []
        for w in words[start : start + toxicity.WINDOW]:
            v = toxicity.Vocabulary()
            v([w.encode()])
            key, gram, _ = v.rows()
            x = p["word"][toxicity._row(key, toxicity.WORDS)[0]] + p["gram"][gram].mean(axis=0)
            x[0] += dict(zip(net.known[0].tolist(), net.known[1].tolist(), strict=True)).get(int(key[0]), 0)
            xs.append(x)
        states = np.zeros((len(xs), 2 * h))
        for d, half, order in (("f", slice(0, h), range(len(xs))), ("b", slice(h, 2 * h), range(len(xs) - 1, -1, -1))):
            s = np.zeros(h)
            for t in order:
                a = xs[t] @ p[f"in_{d}"] + p[f"b_{d}"]
                z, r = sig(a[:h] + s @ p[f"rec_{d}"][:, :h]), sig(a[h : 2 * h] + s @ p[f"rec_{d}"][:, h : 2 * h])
                c = np.tanh(a[2 * h :] + r * (s @ p[f"rec_{d}"][:, 2 * h :]))
                s = (1 - z) * c + z * s
                states[t, half] = s
        e = np.exp(np.tanh(states @ p["att"]) @ p["ask"])
        out.append((e / e.sum()) @ states @ p["out"] + p["bias"][0])
    return max(out) - net.shift


def test_scores_equal_a_plain_network():
    net = toxicity.Network.fresh(np.random.default_rng(8))
    corpus = toxicity.Corpus([(f"Bad{k % 2}, word{k % 3} here {k}", k % 2) for k in range(60)])
    net.known, net.shift = toxicity.evidence(corpus, np.arange(60)), 0.3
    texts = ["", "Bad1 word1, here!", " ".join(f"w{k % 17} é{k % 5}" for k in range(90)), "x", "word " * 64]
    assert np.allclose(toxicity.score_texts(net, texts), [plain_logit(net, t) for t in texts], atol=1e-3)


def test_quality_scores_equal_all_pairs(spark):
    machine = quality.fit([(*quality.features(t.encode()), y) for t, y in [("fine words here", 1), ("zz zz zz", 0), ("", 0)] * 4], epochs=3)
    texts = ["fine words here and there", "", "zz 1 2 3", "é " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.id: r.score for r in quality.score(df, machine).collect()}
    for k, t in enumerate(texts):
        index, value = quality.features(t.encode())
        z = machine.bias + sum(machine.weight[i] * x for i, x in zip(index, value, strict=True))
        z += sum(float(machine.factor[index[a]] @ machine.factor[index[b]]) * value[a] * value[b] for a in range(len(index)) for b in range(a))
        assert abs(got[k] - 1 / (1 + np.exp(-z))) < 1e-4


@pytest.mark.parametrize(("operator", "label", "folds", "held", "train"), [(quality, "quality", 3, 1, {}), (toxicity, "toxic", 5, 0, {})])
def test_held_out_accuracy(spark, operator, label, folds, held, train):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = operator.train(docs, labels, **train)
    rows = operator.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % folds == held) for r in rows)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    right = [(r.score >= 0.5) == (truth[r.id] == 1) for r in rows if r.held_out and r.id in truth]
    assert len(right) > 50 and np.mean(right) > 0.9


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_odd_rows(spark, operator):
    rows = [(1, "fine words here", "s", "l"), (1, "fine words here", "s", "l"), (None, None, None, None), (3, "", "s", "l"), (4, "word " * 20000, "s", "l")]
    docs = spark.createDataFrame(rows, ODD)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 0, None), (None, 1, 1), (4, 7, 0)], "doc_id bigint, quality int, toxic int")
    label = "quality" if operator is quality else "toxic"
    got = operator.score(docs, operator.train(docs, labels, label)).collect()
    assert len(got) == 5 and len({r.score for r in got if r.id == 1}) == 1
    assert operator.score(docs.limit(0), operator.train(docs.limit(0), labels, label)).count() == 0
    none = operator.train(docs, labels.limit(0), label)
    assert none is None and {r.score for r in operator.score(docs, none).collect()} == {1.0 if operator is quality else 0.0}
