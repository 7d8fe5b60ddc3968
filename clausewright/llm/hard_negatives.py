"""Hard-negative mining by bit-sliced integer products.

Vectors become integers, floor(256 x). Written in two's complement, a component is minus its sign bit at the highest place plus
its lower bits, so the product of an anchor with a row is the sum over bit-planes of the anchor's product with the plane's zeros
and ones. Planes are taken most significant first. The planes still to come add between (2**k - 1) times the sum of the anchor's negative
components and as much of its positive ones, so after every plane the score lies in an interval that halves. A candidate is dropped when its interval leaves
the scores asked for, or ends below the lower ends of as many candidates as are asked for. What is left after the last plane has its exact score.

The same search runs twice: for each anchor the first rows of its own label (positives), then for each score of a positive the
first rows of other labels whose score lies between the two given hundredths of it.

Rows and anchors meet in cells: rows are dealt to slices by a hash of their id and anchors to groups, both of a bounded size; a
row goes to every group's cell of its slice, an anchor to every slice's cell of its group. A task reads the rows of a cell as
integers and lets anchors stream past. It hands on each anchor's first few, which a window over all cells cuts to the first again. Labels
and copies of vectors do not decide where a row goes, so none of them loads a task.

Defined cases: rows without id, label or vector, with a null or non-finite component, with a component of 2**23 or more in magnitude
after scaling, or with a length that is not the most common one take no part; of rows with one id the least by label and vector takes
part; equal scores come by id; a negative positive score has no negatives; an anchor without rows of its label has no row; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

SCALE = 256
LARGEST = 1 << 23
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # hundredths of a positive's score
COMPONENTS = 1 << 25  # of a slice's rows
ANCHORS = 1 << 16  # of a group
ROWS, BATCH = 8192, 128  # multiplied at once
LATE = 4  # bits still to come from which candidates are held against each other
EVER = (1 << 62) - 1

Band = tuple[int, int]


def planes(x: np.ndarray) -> int:
    """Bits below the sign that the integers need."""
    return int(max(x.max(initial=0), (~x).max(initial=0))).bit_length()


def floors(best: np.ndarray, k: int) -> int:
    """The k-th largest, or a bound that all pass."""
    return int(np.partition(best, len(best) - k)[len(best) - k]) if len(best) >= k else -EVER


class Best:
    """The first k of one band of one anchor, so far."""

    def __init__(self, band: Band, k: int):
        self.low, self.high, self.k = *band, k
        self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    def floor(self) -> int:
        """What a score has to reach to come in."""
        return max(self.low, int(self.scores[-1])) if len(self.scores) == self.k else self.low

    def take(self, ids: np.ndarray, scores: np.ndarray) -> None:
        mine = (scores >= self.floor()) & (scores <= self.high)
        if mine.any():
            ids, scores = np.concatenate([self.ids, ids[mine]]), np.concatenate([self.scores, scores[mine]])
            order = np.lexsort((ids, -scores))[: self.k]
            self.ids, self.scores = ids[order], scores[order]


def search(anchors: np.ndarray, wanted: np.ndarray, rows: np.ndarray, ids: np.ndarray, best: list[list[Best]]) -> int:
    """Put the scores of `rows` into the bands of `best`, a list for each anchor; `wanted`: which rows count for which anchor.

    Returns how many pairs were still in when the last plane was reached.
    """
    bits = planes(rows)
    exact = np.float32 if len(anchors) and np.abs(anchors).sum(axis=1).max() < 1 << 24 else np.float64
    a = anchors.astype(exact)
    more, less = np.maximum(anchors, 0).sum(axis=1), np.minimum(anchors, 0).sum(axis=1)
    score = (a @ (rows < 0).astype(exact).T).astype(np.int64) * -(1 << bits)
    alive = wanted.copy()
    columns = np.arange(len(rows))
    for bit in range(bits, -1, -1):
        rest = (1 << bit) - 1
        low, high = score + (rest * less)[:, None], score + (rest * more)[:, None]
        for n, bands in enumerate(best):
            at = np.flatnonzero(alive[n])
            if not len(at):
                continue
            lows, highs, still = low[n, at], high[n, at], np.zeros(len(at), bool)
            for band in bands:
                floor = band.floor()
                if bit <= LATE:
                    floor = max(floor, floors(lows[(lows >= band.low) & (highs <= band.high)], band.k))
                still |= (highs >= floor) & (lows <= band.high)
            alive[n, at] = still
        used = alive.any(axis=0)
        if not used.all():
            columns, rows, score, alive = columns[used], rows[used], score[:, used], alive[:, used]
        if bit:
            score += (a @ ((rows >> (bit - 1)) & 1).astype(exact).T).astype(np.int64) << (bit - 1)
    for n, bands in enumerate(best):
        at = np.flatnonzero(alive[n])
        for band in bands if len(at) else ():
            band.take(ids[columns[at]], score[n, at])
    return int(alive.sum())


FOUND = "anchor_id bigint, band bigint, id bigint, score bigint"
_FOUND = [c.split()[0] for c in FOUND.split(", ")]


def _matrix(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _least_of_each_id(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    same = np.flatnonzero(ids[order][1:] == ids[order][:-1])
    if len(same):
        order = np.lexsort((*x.T[::-1], labels, ids))
    keep = order[np.flatnonzero(np.append(True, ids[order][1:] != ids[order][:-1]))] if len(order) else order
    return ids[keep], labels[keep], x[keep]


def _cells(batches: Iterator[pa.RecordBatch], dim: int, k: int, own: bool) -> Iterator[pa.RecordBatch]:
    """Each anchor's first k in every band, from the rows of a cell and then its anchors; sorted by cell and kind."""
    now, held = None, []
    ids = labels = x = None

    def found(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, part.num_rows, BATCH):
            some = part.slice(at, BATCH)
            anchor_ids, anchor_labels, a = some.column("id").to_numpy(), some.column("label").to_numpy(), _matrix(some, "v", dim)
            best = [[Best((b["low"], b["high"]), k) for b in bands] for bands in some.column("bands").to_pylist()]
            for low in range(0, len(ids), ROWS):
                to = slice(low, low + ROWS)
                same = anchor_labels[:, None] == labels[to]
                search(a, (same == own) & (anchor_ids[:, None] != ids[to]), x[to], ids[to], best)
            out = [(i, b["band"], y.ids, y.scores) for i, bands, mine in zip(anchor_ids.tolist(), some.column("bands").to_pylist(), best, strict=True) for b, y in zip(bands, mine, strict=True) if len(y.ids)]
            if out:
                sizes = [len(o[2]) for o in out]
                columns = [np.repeat([o[0] for o in out], sizes), np.repeat([o[1] for o in out], sizes), *(np.concatenate([o[c] for o in out]) for c in (2, 3))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_FOUND)

    for batch in batches:
        cell, kind = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True):
            if low == high:
                continue
            part = batch.slice(low, high - low)
            if cell[low] != now:
                now, held, ids = cell[low], [], None
            if kind[low] == 0:
                held.append((part.column("id").to_numpy(), part.column("label").to_numpy(), _matrix(part, "v", dim)))
            elif held or ids is not None:
                if ids is None:
                    ids, labels, x = _least_of_each_id(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held = []
                yield from found(part)


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(SCALE) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Without null, non-finite or too large components, and with any."""
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= LARGEST / SCALE))


def first_of(rows: DataFrame, anchors: DataFrame, dim: int, slices: int, groups: int, k: int, own: bool) -> DataFrame:
    """(anchor_id, band, id, score, rank): the first k `rows` (id, label, v) in each of the anchors' `bands`, of their own or of other labels."""
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("array<struct<band:bigint,low:bigint,high:bigint>>")
    a = rows.select("*", of(slices).alias("slice"), every(groups).alias("group"), F.lit(0).alias("kind"), none.alias("bands"))
    b = anchors.select("id", "label", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).alias("group"), every(slices).alias("slice"), F.lit(1).alias("kind"), "bands")
    both = a.unionByName(b).withColumn("cell", (F.col("slice") * groups + F.col("group")).cast("bigint")).drop("slice", "group")
    cells = both.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(lambda it: _cells(it, dim, k, own), FOUND)
    order = Window.partitionBy("anchor_id", "band").orderBy(F.desc("score"), "id")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, components: int = COMPONENTS, group: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row that `is_anchor` marks."""
    spark = df.sparkSession
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    rows = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), integers(F.col(vector_col)).alias("v"), is_anchor.alias("anchor"))
    common = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not common:
        return spark.createDataFrame([], out)
    dim, n, n_anchors = common[0]
    slices = max(-(-n * dim // components), min(spark.sparkContext.defaultParallelism, -(-n // ROWS)))
    groups = max(1, -(-n_anchors // group))
    rows = rows.where(F.size("v") == dim)
    one = F.min(F.struct("label", "v")).alias("one")
    anchors = rows.where("anchor").groupBy("id").agg(one).select("id", "one.*")
    rows = rows.drop("anchor")

    bands = lambda *cols: F.struct(*(c.cast("bigint").alias(name) for c, name in zip(cols, ("band", "low", "high"), strict=True)))
    every = F.array(bands(F.lit(0), F.lit(-EVER), F.lit(EVER)))
    near = first_of(rows, anchors.withColumn("bands", every), dim, slices, groups, positives, True)
    near = cut_lineage(near.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    p = F.col("positive_score")
    within = bands(p, F.ceil(p * LOW / F.lit(100)), F.floor(p * HIGH / F.lit(100)))
    asked = near.where(p >= 0).groupBy("anchor_id").agg(F.collect_set(within).alias("bands"))  # of at most `positives`
    asked = anchors.join(asked.withColumnRenamed("anchor_id", "id"), "id")
    far = first_of(rows, asked, dim, slices, groups, negatives, False)
    far = far.select("anchor_id", F.col("band").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["anchor_id", "positive_score"]).select(*(c.split()[0] for c in out.split(", ")))
