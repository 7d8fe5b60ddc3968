"""Quality classifier: a factorisation machine over hashed words, structure statistics and the length.

    y(x) = b + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

The pair term is the sum-of-squares identity, so a text costs time in proportion to its features. The inputs are
word hashes (weights log(1 + count), scaled to unit length), statistics of the whole text and its length;
labels, language, source and id are not among them. It is fitted on the driver with numpy on at most BOUND labelled
texts, of which the executors send the sparse features only; the model has a fixed size.

Defined cases: null texts are empty and are scored like others; without labelled rows every score is 1; a null
id stays null and counts as the id "" for the fold; repeated rows stay; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, utf8
from .labelled import fold, labelled_texts, sample

BOUND = 8000
BUCKETS = 1 << 14
RANK = 8
FOLDS, HELD = 3, 1
EPOCHS, BATCH, RATE = 8, 64, 0.05
DECAY = 2e-5

_CLASS = np.zeros(256, np.int64)  # byte classes: 0 other, then as in STATS
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b"!", b"|", b"#$%&*@^~+=<>{}[]\\_", b".,;:?'\"()-/", bytes(range(128, 256))), 1):
    _CLASS[list(_chars)] = _k
N_CLASSES = 11
N_STATS = N_CLASSES + 9


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (statistics first, then word buckets) and values of a whole text."""
    n = len(raw)
    stats = np.zeros(N_STATS, np.float32)
    if n:
        share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=N_CLASSES) / n
        stats[:N_CLASSES] = np.sqrt(share)
    words = raw.lower().split()
    m = len(words)
    stats[N_CLASSES] = np.log1p(n) / 10
    stats[N_CLASSES + 1] = np.log1p(m) / 10
    if not m:
        return np.arange(N_STATS), stats
    codes = np.fromiter(map(zlib.crc32, words), np.uint32, m)
    kinds, counts = np.unique(codes, return_counts=True)
    lines = raw.split(b"\n")
    tail = [w[-1] for w in words]
    stats[N_CLASSES + 2] = len(kinds) / m
    stats[N_CLASSES + 3] = counts.max() / m
    stats[N_CLASSES + 4] = (codes[1:] == codes[:-1]).mean() if m > 1 else 0
    stats[N_CLASSES + 5] = 1 - len(set(lines)) / len(lines)
    stats[N_CLASSES + 6] = min(1.0, n / m / 20)
    stats[N_CLASSES + 7] = np.count_nonzero(_CLASS[tail] >= 6) / m
    stats[N_CLASSES + 8] = 1.0 if m < 8 else 0.0
    index, which = np.unique(kinds % BUCKETS, return_inverse=True)
    value = np.log1p(np.bincount(which, counts)).astype(np.float32)
    return np.concatenate([np.arange(N_STATS), index.astype(np.int64) + N_STATS]), np.concatenate([stats, value / np.linalg.norm(value)])


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Logits of texts whose features begin at `starts`."""
        v = self.factor[index] * value[:, None]
        s = np.add.reduceat(v, starts, axis=0)
        q = np.add.reduceat(v * v, starts, axis=0)
        return self.bias + np.add.reduceat(self.weight[index] * value, starts) + 0.5 * (s * s - q).sum(axis=1)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, seed: int = 7) -> Machine | None:
    """Adagrad on the logistic loss; None without rows."""
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    size = N_STATS + BUCKETS
    w = np.zeros(size, np.float32)
    v = rng.normal(0, 0.05, (size, RANK)).astype(np.float32)
    p = float(np.clip(np.mean([r[2] for r in rows]), 0.01, 0.99))
    b = float(np.log(p / (1 - p)))
    gw, gv, gb = np.full(size, 1e-3, np.float32), np.full((size, RANK), 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            part = [rows[k] for k in order[at : at + BATCH]]
            index, value = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
            sizes = np.array([len(r[0]) for r in part])
            starts = np.cumsum(sizes) - sizes
            y = np.array([r[2] for r in part], np.float32)
            xv = v[index] * value[:, None]
            s = np.add.reduceat(xv, starts, axis=0)
            q = np.add.reduceat(xv * xv, starts, axis=0)
            z = b + np.add.reduceat(w[index] * value, starts) + 0.5 * (s * s - q).sum(axis=1)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(part)
            dx = np.repeat(d, sizes) * value
            touched, which = np.unique(index, return_inverse=True)
            dw = np.bincount(which, dx) + DECAY * w[touched]
            dv_each = dx[:, None] * (np.repeat(s, sizes, axis=0) - xv)
            dv = np.stack([np.bincount(which, dv_each[:, f]) for f in range(RANK)], axis=1) + DECAY * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            gb += d.sum() ** 2
            w[touched] -= (RATE * dw / np.sqrt(gw[touched])).astype(np.float32)
            v[touched] -= (RATE * dv / np.sqrt(gv[touched])).astype(np.float32)
            b -= RATE * d.sum() / np.sqrt(gb)
    return Machine(float(b), w, v)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", bound: int = BOUND) -> Machine | None:
    """Fit on at most `bound` labelled texts outside the held-out fold; of several texts under one id on the least."""
    chosen = sample(labels, label_col, FOLDS, HELD, bound, id_col)
    return fit([(*features(r.text.encode()), r.label) for r in labelled_texts(docs, chosen, id_col, text_col)])


def score(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score) of every row; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # fixed size: (N_STATS + BUCKETS) * (RANK + 1) floats

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 256):
                found = [features(t) for t in utf8(batch.column(2).slice(at, 256))]
                if m is None:
                    out.append(np.ones(len(found)))
                    continue
                sizes = np.array([len(i) for i, _ in found])
                z = m.score(np.concatenate([i for i, _ in found]), np.concatenate([x for _, x in found]), np.cumsum(sizes) - sizes)
                out.append(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())], names=["id", "held_out", "score"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), (fold(id_col, FOLDS) == HELD).alias("held_out"), text_of(text_col).alias("text"))
    return texts.mapInArrow(rows, "id bigint, held_out boolean, score double")
