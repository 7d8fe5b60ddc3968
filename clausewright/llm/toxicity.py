"""Toxicity: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word's input is the sum of a hashed word vector and the mean of its hashed byte-trigram vectors. Windows of WINDOW words, each STRIDE
words after the last and the final one flush with the end, cover the whole text; every window is scored and a
text has the score of its worst window. Words, not texts, pay for the input layer: a batch's distinct words
are projected once for both directions.

It is fitted on the driver on whole texts of at most BOUND labelled rows. A text's label says that some window is toxic, not which.
So what the labels say about a word (`evidence`: nothing, unless chance would hardly give it) is added to the first coordinate
of its vector, the windows with the most of it are the first to be learned from, and later the network itself
chooses the worst window of every text, beside a window of each clean text by lot. Last the threshold, chosen on texts
kept aside, is moved to 0.5.

Defined cases: null and empty texts are scored as one empty word; without labelled rows every score is 0; a
null id stays null and counts as "" for the fold; repeated rows stay; an empty table gives an empty table.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, texts
from .labelled import fold, labelled_texts, sample

BOUND = 6000
WINDOW, STRIDE = 64, 48
FOLDS, HELD = 5, 0
WORDS, GRAMS = 1 << 14, 1 << 13
DIM, HIDDEN, ATTEND = 16, 12, 12
EPOCHS, BATCH, RATE = 8, 128, 0.01
TABLES = 0.3  # of the rate, for word and trigram vectors: they must not learn single texts by heart
SLICE = 2048
CHECK = 6
STEPS = 300
CHANCE = 4.0  # in standard deviations

_LETTERS = np.random.default_rng(29).integers(0, 1 << 63, 256, dtype=np.uint64)
_SPACES = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_SPACES).split() or [b""]


def windows_of(n: int) -> list[int]:
    """Starts of the windows over n words."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


class Vocabulary:
    """Distinct words of a batch, with their hashed rows."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        ids = self.ids
        return np.array([ids.setdefault(w, len(ids)) for w in words], np.int32)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words as 64-bit keys, trigram rows, and where each word's trigrams begin."""
        words = list(self.ids)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint32)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        grams = np.full(len(data), 0, np.uint32)
        grams[:-2] = data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA6B) + data[2:] * np.uint32(0xC2B2AE35)
        power = np.multiply.accumulate(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        whole = np.add.reduceat(_LETTERS[data] * power[place], starts)
        whole = (whole ^ (whole >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        keep = np.ones(len(data), bool)
        keep[ends - 1] = False
        keep[ends - 2] = sizes == 2  # the empty word keeps one, of its own
        grams[ends[sizes == 2] - 2] = 1
        first = starts - np.concatenate([[0], np.cumsum(sizes - np.maximum(sizes - 2, 1))[:-1]])
        return whole, _row(grams[keep], GRAMS), first


def _row(x: np.ndarray, rows: int) -> np.ndarray:
    return (((x ^ (x >> x.dtype.type(15))) * x.dtype.type(0x2C1B3C6D) >> x.dtype.type(8)) % x.dtype.type(rows)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    p: dict[str, np.ndarray]
    known: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(1, np.uint64), np.zeros(1, np.float32)))  # sorted keys, evidence
    shift: float = 0.0
    moments: dict = field(default_factory=dict)

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        g = lambda *s, k: rng.normal(0, k, s).astype(np.float32)
        p = {"word": g(WORDS, DIM, k=0.05), "gram": g(GRAMS, DIM, k=0.3), "att": g(2 * HIDDEN, ATTEND, k=0.3), "ask": g(ATTEND, k=0.3), "out": g(2 * HIDDEN, k=0.3), "bias": np.full(1, -1.0, np.float32)}
        for d in "fb":
            p |= {f"in_{d}": g(DIM, 3 * HIDDEN, k=0.3), f"b_{d}": np.zeros(3 * HIDDEN, np.float32), f"rec_{d}": g(HIDDEN, 3 * HIDDEN, k=0.3)}
        return Network(p)

    def vectors(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, gram, first = rows
        sizes = np.diff(np.append(first, len(gram)))
        mean = np.empty((len(key), DIM), np.float32)
        for at in range(0, len(key), 1 << 15):  # trigram vectors of some words at a time
            to = min(len(key), at + (1 << 15))
            low, high = first[at], first[to] if to < len(key) else len(gram)
            mean[at:to] = np.add.reduceat(self.p["gram"][gram[low:high]], first[at:to] - low, axis=0)
        x = self.p["word"][_row(key, WORDS)] + mean / sizes[:, None].astype(np.float32)
        x[:, 0] += self.said(key)
        return x, sizes

    def said(self, key: np.ndarray) -> np.ndarray:
        """The evidence of words."""
        keys, values = self.known
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, values[at], np.float32(0))

    def run(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Window logits. ids: time x window rows of x; mask: the same shape, 0 beyond a window's end."""
        p, (steps, n) = self.p, ids.shape
        both = np.empty((steps, n, 2 * HIDDEN), np.float32)
        kept: dict = {}
        for d, half in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            xp = x @ p[f"in_{d}"] + p[f"b_{d}"]
            rec_g, rec_c = p[f"rec_{d}"][:, : 2 * HIDDEN], p[f"rec_{d}"][:, 2 * HIDDEN :]
            h = np.zeros((n, HIDDEN), np.float32)
            trace = []
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                a = xp[ids[t]]
                g = _sigmoid(a[:, : 2 * HIDDEN] + h @ rec_g)
                z, r = g[:, :HIDDEN], g[:, HIDDEN:]
                hr = h @ rec_c
                c = np.tanh(a[:, 2 * HIDDEN :] + r * hr)
                new = c + z * (h - c)
                if mask is not None:
                    m = mask[t][:, None]
                    new = new * m + h * (1 - m)
                if keep:
                    trace.append((t, h, z, r, hr, c))
                h = new
                both[t, :, half] = h
            kept[d] = trace
        act = np.tanh(both @ p["att"])
        e = act @ p["ask"]
        if mask is not None:
            e = np.where(mask > 0, e, -1e9)
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", w, both)
        return pooled @ p["out"] + p["bias"][0], kept | {"both": both, "act": act, "w": w, "pooled": pooled}

    def grads(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, k: dict, dz: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters, and of x, for the gradient dz of the logits."""
        p = self.p
        g = {"out": k["pooled"].T @ dz, "bias": np.array([dz.sum()], np.float32)}
        dpool = dz[:, None] * p["out"]
        dw = np.einsum("nh,tnh->tn", dpool, k["both"])
        de = k["w"] * (dw - (k["w"] * dw).sum(axis=0))
        g["ask"] = np.einsum("tn,tna->a", de, k["act"])
        da = de[:, :, None] * p["ask"] * (1 - k["act"] ** 2)
        g["att"] = np.einsum("tnh,tna->ha", k["both"], da)
        dboth = k["w"][:, :, None] * dpool + da @ p["att"].T
        dx = np.zeros_like(x)
        order = np.argsort(ids, axis=None, kind="stable")
        flat = ids.reshape(-1)[order]
        firsts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        for d, half in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            rec_g, rec_c = p[f"rec_{d}"][:, : 2 * HIDDEN], p[f"rec_{d}"][:, 2 * HIDDEN :]
            d_rec, dh = np.zeros_like(p[f"rec_{d}"]), np.zeros((ids.shape[1], HIDDEN), np.float32)
            da_in = np.empty((*ids.shape, 3 * HIDDEN), np.float32)
            for t, h, z, r, hr, c in reversed(k[d]):
                m = mask[t][:, None]
                dh = dh + dboth[t, :, half]
                dn = dh * m
                dc = dn * (1 - z) * (1 - c**2)
                dzt = dn * (h - c) * z * (1 - z)
                dr = dc * hr * r * (1 - r)
                dg = np.concatenate([dzt, dr], axis=1)
                d_rec[:, : 2 * HIDDEN] += h.T @ dg
                d_rec[:, 2 * HIDDEN :] += h.T @ (dc * r)
                dh = dh * (1 - m) + dn * z + dg @ rec_g.T + (dc * r) @ rec_c.T
                da_in[t, :, : 2 * HIDDEN], da_in[t, :, 2 * HIDDEN :] = dg, dc
            dxp = np.zeros((len(x), 3 * HIDDEN), np.float32)
            dxp[flat[firsts]] = np.add.reduceat(da_in.reshape(-1, 3 * HIDDEN)[order], firsts, axis=0)
            g[f"rec_{d}"], g[f"in_{d}"], g[f"b_{d}"] = d_rec, x.T @ dxp, dxp.sum(axis=0)
            dx += dxp @ p[f"in_{d}"].T
        return g, dx

    def step(self, g: dict[str, np.ndarray], rows: dict[str, np.ndarray], t: int, rate: float) -> None:
        """Adam; of the tables of `rows` only these rows have gradients and move."""
        for name, d in g.items():
            p, at = self.p[name], rows.get(name, slice(None))
            if name not in self.moments:
                self.moments[name] = np.zeros_like(p), np.zeros_like(p)
            m, v = self.moments[name]
            m[at] = some_m = m[at] + 0.1 * (d - m[at])
            v[at] = some_v = v[at] + 0.001 * (d * d - v[at])
            p[at] -= (rate * TABLES if name in rows else rate) * (some_m / (1 - 0.9**t)) / (np.sqrt(some_v / (1 - 0.999**t)) + 1e-8)


def _laid_out(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray | None]:
    """Windows as time x window ids and their mask; None for a mask of ones."""
    sizes = np.array([len(x) for x in parts])
    steps = int(sizes.max())
    if (sizes == steps).all():
        return np.ascontiguousarray(np.stack(parts).T), None
    ids = np.zeros((len(parts), steps), np.int32)
    mask = (np.arange(steps) < sizes[:, None]).astype(np.float32)
    ids[mask > 0] = np.concatenate(parts)
    return np.ascontiguousarray(ids.T), np.ascontiguousarray(mask.T)


def score_texts(net: Network, batch: list[str]) -> np.ndarray:
    """Logit of the worst window of each text; all windows are scored."""
    vocabulary, full, short = Vocabulary(), [], []
    for k, text in enumerate(batch):
        ids = vocabulary(words_of(text))
        if len(ids) < WINDOW:
            short.append((k, ids))
        else:
            full += [(k, ids[s : s + WINDOW]) for s in windows_of(len(ids))]
    x, _ = net.vectors(vocabulary.rows())
    out = np.full(len(batch), -np.inf)
    short.sort(key=lambda s: len(s[1]))
    for group, most in ((short, 256), (full, SLICE)):
        for at in range(0, len(group), most):
            part = group[at : at + most]
            z, _ = net.run(x, *_laid_out([w for _, w in part]))
            np.maximum.at(out, [k for k, _ in part], z)
    return out - net.shift


class Corpus:
    """Texts as ids of their words, and their windows one after the other."""

    def __init__(self, rows: list[tuple[str, int]]):
        vocabulary = Vocabulary()
        self.texts = [vocabulary(words_of(t)) for t, _ in rows]
        self.labels = np.array([y for _, y in rows])
        self.key, self.gram, self.first = vocabulary.rows()
        self.sizes = np.diff(np.append(self.first, len(self.gram)))
        starts = [windows_of(len(t)) for t in self.texts]
        self.text = np.repeat(np.arange(len(rows)), [len(s) for s in starts])
        self.start = np.array([s for each in starts for s in each])
        self.begin = np.append(0, np.cumsum([len(s) for s in starts]))

    def window(self, k: int) -> np.ndarray:
        return self.texts[self.text[k]][self.start[k] : self.start[k] + WINDOW]

    def rows_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `Vocabulary.rows`, for some of the words."""
        n = self.sizes[words]
        first = np.cumsum(n) - n
        return self.key[words], self.gram[np.arange(n.sum()) + np.repeat(self.first[words] - first, n)], first

    def batch(self, windows: np.ndarray) -> tuple[tuple, np.ndarray, np.ndarray | None]:
        """Rows of the distinct words, and windows laid out as indexes of these."""
        ids, mask = _laid_out([self.window(k) for k in windows.tolist()])
        words, places = np.unique(ids, return_inverse=True)
        return self.rows_of(words), places.reshape(ids.shape).astype(np.int32), mask

    def worst(self, score: np.ndarray) -> np.ndarray:
        """The window with the highest score of every text; the first of several."""
        order = np.lexsort((-np.arange(len(score)), score, self.text))
        return order[self.begin[1:] - 1]


def _weights(c: Corpus, of: np.ndarray) -> np.ndarray:
    """One over the number of texts alike, by the least hashes of word pairs: a group of copies speaks for its words once."""
    least = np.empty((len(of), 4), np.uint64)
    for n, k in enumerate(of.tolist()):
        h = c.key[c.texts[k]]
        h = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] if len(h) > 1 else h) * np.uint64(0xBF58476D1CE4E5B9)
        least[n] = [((h ^ (h >> np.uint64(29))) * np.uint64(m)).min() for m in (0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
    out = np.zeros(len(of))
    for column in least.T:
        _, which, count = np.unique(column, return_inverse=True, return_counts=True)
        out += 1 / count[which] / least.shape[1]
    return out


def evidence(c: Corpus, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, as sorted keys, and what the labels of the texts `of` say about them: the signed root of the likelihood ratio beyond CHANCE."""
    weight = _weights(c, of)
    counts = np.zeros((2, len(c.key)))
    for k, w in zip(of.tolist(), weight, strict=True):
        counts[c.labels[k], np.unique(c.texts[k])] += w
    n, p = counts.sum(axis=0), np.average(c.labels[of], weights=weight)
    if not 0 < p < 1:
        return np.zeros(1, np.uint64), np.zeros(1, np.float32)
    part = lambda k, q: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(n, 1e-9) / q), 0)
    root = np.sqrt(np.maximum(0, 2 * (part(counts[1], p) + part(counts[0], 1 - p)))) - CHANCE
    some = np.append(0, np.flatnonzero(root > 0))
    key, first = np.unique(c.key[some], return_index=True)
    value = np.sign(counts[1] - n * p)[some] * np.clip(root[some], 0, 4)
    return key, value[first].astype(np.float32)


def fit(rows: list[tuple[str, int]], seed: int = 11, epochs: int = EPOCHS) -> Network | None:
    """rows: whole texts and their labels."""
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    net, t = Network.fresh(rng), 0
    c = Corpus(rows)
    every = np.arange(len(rows))
    aside = every[::CHECK] if len(rows) >= 50 * CHECK else every  # unseen texts for the threshold, where there are enough
    learned = np.setdiff1d(every, aside) if len(aside) < len(every) else every
    clean = learned[c.labels[learned] == 0]
    boost = float(np.clip(len(clean) / max(1, len(learned) - len(clean)), 1, 3))
    net.known = evidence(c, learned)
    said = np.maximum(net.said(c.key), 0)
    worst = c.worst(np.array([said[c.window(k)].sum() for k in range(len(c.text))]))
    epochs *= max(1, round(STEPS * BATCH / (epochs * (len(learned) + len(clean)))))  # few texts are gone over more often
    turns = set(np.linspace(0, epochs, 5).astype(int)[1:-1].tolist())  # when the network chooses the windows anew
    for epoch in range(epochs):
        if epoch in turns:
            worst = c.worst(_logits(net, c, np.arange(len(c.text))))
        lot = c.begin[clean] + rng.integers(0, np.diff(c.begin)[clean])
        items = np.concatenate([worst[learned], lot])
        order = rng.permutation(len(items))
        rate = RATE * (1 - epoch / (epochs + 1))
        for at in range(0, len(items), BATCH):
            part = items[order[at : at + BATCH]]
            (key, gram, first), ids, mask = c.batch(part)
            mask = np.ones(ids.shape, np.float32) if mask is None else mask
            x, sizes = net.vectors((key, gram, first))
            z, kept = net.run(x, ids, mask, keep=True)
            y = c.labels[c.text[part]].astype(np.float32)
            dz = ((_sigmoid(z) - y) * np.where(y > 0, boost, 1) / len(part)).astype(np.float32)
            g, dx = net.grads(x, ids, mask, kept, dz)
            touched = {}
            for name, at_rows, d in (("word", _row(key, WORDS), dx), ("gram", gram, np.repeat(dx / sizes[:, None].astype(np.float32), sizes, axis=0))):
                touched[name], which = np.unique(at_rows, return_inverse=True)
                g[name] = np.zeros((len(touched[name]), DIM), np.float32)
                np.add.at(g[name], which, d)
            t += 1
            net.step(g, touched, t, rate)
    mine = np.flatnonzero(np.isin(c.text, aside))
    z = np.full(len(rows), -np.inf)
    np.maximum.at(z, c.text[mine], _logits(net, c, mine))
    net.shift = _threshold(z[aside], c.labels[aside])
    net.moments = {}
    return net


def _logits(net: Network, c: Corpus, windows: np.ndarray) -> np.ndarray:
    """Logits of some windows, those of one length together."""
    size = np.minimum(np.array([len(t) for t in c.texts])[c.text[windows]], WINDOW)
    order = np.argsort(size, kind="stable")
    out = np.empty(len(windows), np.float32)
    for at in range(0, len(order), SLICE):
        part = order[at : at + SLICE]
        rows, ids, mask = c.batch(windows[part])
        out[part] = net.run(net.vectors(rows)[0], ids, mask)[0]
    return out


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the cut with the fewest errors, of several the nearest to 0; 0 where a class is missing."""
    if y.min() == y.max():
        return 0.0
    order = np.argsort(z)
    z, y = z[order], y[order]
    errors = np.concatenate([[(y == 0).sum()], (y == 0).sum() + np.cumsum(2 * y - 1)])  # texts before the cut pass
    best = np.flatnonzero(errors == errors.min())
    edge = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    middle = (edge[best] + edge[best + 1]) / 2
    return float(middle[np.abs(middle).argmin()])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", bound: int = BOUND, seed: int = 11) -> Network | None:
    """Fit on the whole texts of at most `bound` labelled rows outside the held-out fold; of several texts under one id on the least."""
    chosen = sample(labels, label_col, FOLDS, HELD, bound, id_col)
    return fit([(r.text, r.label) for r in labelled_texts(docs, chosen, id_col, text_col)], seed)


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score) of every row; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # fixed size: the tables and matrices above

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sent.value
        for batch in batches:
            out = [np.zeros(0)]
            for at in range(0, batch.num_rows, 1000):
                part = texts(batch.column(2).slice(at, 1000))
                out.append(np.zeros(len(part)) if n is None else 1 / (1 + np.exp(-np.clip(score_texts(n, part), -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(out), pa.float64())], names=["id", "held_out", "score"])

    found = docs.select(F.col(id_col).cast("bigint").alias("id"), (fold(id_col, FOLDS) == HELD).alias("held_out"), text_of(text_col).alias("text"))
    return found.mapInArrow(rows, "id bigint, held_out boolean, score double")


def keep(docs: DataFrame, net: Network | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that score below `threshold`, with all their columns; no shuffle and no join."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    place = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                z = np.full(part.num_rows, -np.inf) if n is None else score_texts(n, texts(part.column(place)))
                yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) < threshold))

    return docs.mapInArrow(rows, docs.schema)
