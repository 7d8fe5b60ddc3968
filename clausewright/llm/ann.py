"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes: ROTATIONS rotations learned by alternating signs and orthogonal fits on a bounded sample give one bit a
dimension each. A code is cut into 8-bit substrings, and a block of vectors has for each substring an index from value to
rows. A query probes in every index the values within radius // substrings of its own; by the pigeonhole
principle that finds every code within the radius. Codes beyond the radius are dropped, the rest are ranked by inner
product in double precision on the original vectors. A block in which fewer than k codes lie within the radius
widens it until k do, so a query never has fewer than k results unless there are fewer candidates.

The radius is fitted on the sample: it holds the true neighbours there at the rate `recall`. A sample is thinner than
the whole, its neighbours are farther, so the whole is searched with a radius that is if anything too wide.

Queries are sent in blocks of at most about QUERY_BLOCK vectors, each block against all rows; the rows never move, only
each task's best k for a query do. Vectors of one hub or many copies therefore load no task more than others.

Defined cases: null vectors, vectors with null or non-finite components, zero vectors and those whose length is not the
most common one take no part, nor do rows without an id; several rows with one id that is a query count as
one query (the least vector), and none of them is its candidate; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 8192
SAMPLE_QUERIES = 256
ROTATIONS = 2
ROUNDS = 15
QUERY_BLOCK = 20_000
BLOCK = 8192
RECALL = 0.97

_POP = np.array([bin(v).count("1") for v in range(256)], np.uint8)
_NEAR = [[np.flatnonzero(_POP[np.arange(256) ^ v] <= r) for v in range(256)] for r in range(9)]


def learn_rotations(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """dim x (ROTATIONS * dim): iterative quantisation from random starts."""
    rng = np.random.default_rng(seed)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = []
    for _ in range(ROTATIONS):
        r, _ = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(x.T @ np.where(x @ r >= 0, 1.0, -1.0))
            r = u @ v
        found.append(r)
    return np.concatenate(found, axis=1)


def codes(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Rows of code bytes."""
    return np.packbits(x @ rotation >= 0, axis=1)


def distances(all_codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(all_codes ^ code).sum(axis=1, dtype=np.int32)


def fit_radius(x: np.ndarray, rotation: np.ndarray, k: int, recall: float) -> int:
    """The least radius that holds `recall` of the true k nearest of sample queries."""
    c = codes(x, rotation)
    far = []
    for q in np.linspace(0, len(x) - 1, min(SAMPLE_QUERIES, len(x))).astype(int):
        s = x @ x[q]
        s[q] = -np.inf
        top = np.argsort(-s)[: min(k, len(x) - 1)]
        far.append(distances(c[top], c[q]))
    far = np.concatenate(far) if far else np.empty(0)
    return int(np.quantile(far, recall, method="higher")) if len(far) else c.shape[1] * 8


class Index:
    """The substring indexes of a block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rotation: np.ndarray, radius: int):
        self.ids, self.x, self.codes, self.radius = ids, x, codes(x, rotation), radius
        parts = self.codes.shape[1]
        each = min(8, radius // parts)
        self.found = np.zeros((parts, 256, len(ids)), bool)  # for each substring value: rows whose substring is near
        for j in range(parts):
            order = np.argsort(self.codes[:, j], kind="stable")
            ends = np.searchsorted(self.codes[order, j], np.arange(257))
            for v in np.flatnonzero(np.diff(ends)):
                self.found[j][np.ix_(_NEAR[each][v], order[ends[v] : ends[v + 1]])] = True

    def search(self, own: int, vector: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, best first."""
        rows = np.flatnonzero(np.logical_or.reduce(self.found[np.arange(len(code)), code]))
        far = distances(self.codes[rows], code)
        rows = rows[(far <= self.radius) & (self.ids[rows] != own)]
        if len(rows) < k:
            far = distances(self.codes, code)
            far[self.ids == own] = 1 << 20
            others = int((self.ids != own).sum())
            rows = np.flatnonzero(far <= np.partition(far, min(k, others) - 1)[min(k, others) - 1]) if others else rows[:0]
        score = (self.x[rows] * vector).sum(axis=1)
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]


def usable(vector: Column, dim: int | None = None) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ok = vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0)
    return ok if dim is None else ok & (F.size(vector) == dim)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1).astype(np.float64)


def _collected(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.toArrow().combine_chunks().to_batches()
    return _arrays(t[0]) if t and t[0].num_rows else (np.empty(0, np.int64), np.empty((0, 1)))


def search(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that `is_query` marks, by inner product."""
    schema = "query_id bigint, vec_id bigint, score double"
    rows = df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"), is_query.alias("query"))
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not common:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("v") == common[0]["dim"])
    _, sample = _collected(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "v"))
    rotation = learn_rotations(sample)
    radius = fit_radius(sample, rotation, k, recall)
    queries = rows.where("query").groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def found(block: int) -> DataFrame:
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        qids, qx = _collected(part.select("id", "v"))  # about QUERY_BLOCK rows at most
        sent = df.sparkSession.sparkContext.broadcast((qids, qx, codes(qx, rotation) if len(qids) else None, rotation, radius))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors, qcodes, turned, r = sent.value
            top: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for cids, cx in _blocks(batches):
                index = Index(cids, cx, turned, r)
                for n in range(len(ids)):
                    i, s = index.search(int(ids[n]), vectors[n], qcodes[n], k)
                    if n in top:
                        i, s = np.concatenate([top[n][0], i]), np.concatenate([top[n][1], s])
                        keep = np.lexsort((i, -s))[:k]
                        i, s = i[keep], s[keep]
                    top[n] = i, s
            for at in range(0, len(ids), 4096):
                some = range(at, min(len(ids), at + 4096))
                if top:
                    sizes = [len(top[n][0]) for n in some]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + 4096], sizes)), pa.array(np.concatenate([top[n][0] for n in some])), pa.array(np.concatenate([top[n][1] for n in some]))], names=["query_id", "vec_id", "score"])

        return rows.select("id", "v").mapInArrow(best, schema)

    every = found(0)
    for b in range(1, blocks):
        every = every.unionByName(found(b))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = _arrays(batch.slice(at, BLOCK))
            held.append(part)
            size += len(part[0])
            if size >= BLOCK:
                yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                held, size = [], 0
    if held:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
