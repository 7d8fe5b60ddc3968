"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a binary-trie self-join.

The distinct fingerprints of a group, sorted, are a binary trie: a node is a run that shares its upper bits. The join goes
down two nodes at a time, adds up the bits in which their prefixes differ and drops a pair of nodes when the
sum passes the budget; small pairs are compared outright.

It is distributed by the pigeonhole principle: of budget + 1 blocks of the bits, two fingerprints within the budget share one
whole. So each fingerprint goes to one group for each block, by the block's value, and the join starts from every group with
itself. A group of more than NODE fingerprints is cut into parts by hash, each pair of parts is a task, and the join starts from the
two parts' roots: n fingerprints are sent n / NODE times. Beyond PARTS parts (millions of different fingerprints that agree in a block) the group is
linked by midpoints instead: two fingerprints within four bits both lie within two bits of some third value, and all that do are within four bits of each other,
so linking those around each value to the least of them loses no component, at a fixed number of rows a fingerprint. A task hands on a spanning forest of
the links it found, not the links, and the forests are joined by distributed star steps, so no group of copies is expanded into pairs.

`keep_one` links by the texts themselves: keys of least hashes bring candidates into one group, the trie join of their
fingerprints leaves the pairs within LOOSE bits, and the exact Jaccard similarity of their shingle sets decides.

Defined cases: a null text is empty and has fingerprint zero, like any text without words; texts of fewer
words than a shingle give one shingle; rows with equal fingerprints are linked; a null id takes no part in
the minimum; repeated rows stay; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, salted_join, text_of, unused, utf8
from .components import components

SEED = 42
BUDGET = 4
LOOSE = 24  # bits; sets alike in 0.8 differ in 9.7 of 64 bits on average, with a standard deviation of 2.9
NODE = 1 << 16  # fingerprints of a group, or of a part of one
PARTS = 64
WAVE = 1 << 20  # pairs of nodes taken at once
BATCH = 1 << 15  # of small groups joined at once
LEAF = 128
SETS = 1024  # shingle sets in a part of a group, at most about
HASHES = 1 << 20
SLICE = 1 << 20
_ALL = (1 << 64) - 1
_ODD = np.random.default_rng(23).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included; none for a text without words."""
    words = raw.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, "<u8")
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8")


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    n = len(h)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        bits = np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(raw: bytes, width: int) -> int:
    return majority(shingle_hashes(raw, width))


def band_keys(h: np.ndarray, bands: int) -> np.ndarray:
    """For each band a key of the least hashes under two permutations: texts alike in 0.8 of their shingles share one at a rate of 1 - 0.36**bands."""
    if not len(h):
        return np.zeros(1, np.uint64)
    least = np.array([(h * m ^ (h >> np.uint64(31)) * m).min() for m in _ODD[: 2 * bands]], np.uint64)
    return (least[::2] * _ODD[0] ^ least[1::2]) * _ODD[1] + np.arange(bands, dtype=np.uint64)


def fingerprints(df: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text")).mapInArrow(rows, "id bigint, fp bigint")


def trie_links(keys: np.ndarray, begins: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of keys within `budget` bits, slice by slice, in each of the groups that begin at `begins`; a group's keys are sorted and distinct."""
    low = np.asarray(begins, np.int64)
    high = np.append(low[1:], len(keys))
    yield from trie_join(keys, low, high, low, high, budget)


def trie_join(keys: np.ndarray, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of keys within `budget` bits between the tries at [alo, ahi) and [blo, bhi), which are equal or a before b; keys of a trie are sorted and distinct."""
    if not len(keys):
        return
    waves = [(63, alo, ahi, blo, bhi, np.zeros(len(alo), np.int64))]
    while waves:  # the deepest first, so that few wait
        bit, alo, ahi, blo, bhi, acc = waves.pop()
        small = (ahi - alo) * (bhi - blo) <= (LEAF if bit >= 0 else np.inf)
        if small.any():
            yield from _leaves(keys, alo[small], ahi[small], blo[small], bhi[small], budget)
            keep = ~small
            alo, ahi, blo, bhi, acc = alo[keep], ahi[keep], blo[keep], bhi[keep], acc[keep]
        if not len(alo) or bit < 0:
            continue
        amid, bmid = _halves(keys, alo, ahi, bit), _halves(keys, blo, bhi, bit)
        own = alo == blo  # a node with itself: one of the two mixed pairs is enough
        parts = [(alo, amid, blo, bmid, acc), (amid, ahi, bmid, bhi, acc), (alo, amid, bmid, bhi, acc + 1), (amid, ahi, blo, bmid, np.where(own, budget + 1, acc + 1))]
        nodes = [np.concatenate(x) for x in zip(*parts, strict=True)]
        keep = (nodes[1] > nodes[0]) & (nodes[3] > nodes[2]) & (nodes[4] <= budget)
        nodes = [x[keep] for x in nodes]
        waves += [(bit - 1, *(x[at : at + WAVE] for x in nodes)) for at in range(0, len(nodes[0]), WAVE)]


def _halves(keys: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """Where in each sorted run of keys that share their upper bits those with the bit begin, by binary search on all at once."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) // 2
        one = (keys[mid] >> np.uint64(bit) & np.uint64(1)).astype(bool)
        high[open_] = np.where(one, mid, high[open_])
        low[open_] = np.where(one, low[open_], mid + 1)


def _leaves(keys: np.ndarray, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    width = bhi - blo
    # one entry for each key of a's side with the run of b's side, then the runs laid out slice by slice
    rows = np.repeat(np.arange(len(alo)), ahi - alo)
    first = np.arange(len(rows)) - np.repeat(np.cumsum(ahi - alo) - (ahi - alo), ahi - alo) + alo[rows]
    runs, lows = width[rows], blo[rows]
    total = np.cumsum(runs)
    at = 0
    while at < len(rows):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + SLICE, side="right")))
        n = runs[at:to]
        i = np.repeat(first[at:to], n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lows[at:to], n)
        near = (np.bitwise_count(keys[i] ^ keys[j]) <= budget) & (i < j)
        if near.any():
            yield i[near], j[near]
        at = to


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index of each of n nodes' components."""
    label = np.arange(n)
    for i, j in links:
        while True:
            x, y = label[i], label[j]
            open_ = x != y
            if not open_.any():
                break
            i, j, x, y = i[open_], j[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    return label


def blocks(mask: int, n: int) -> list[int]:
    """The bits outside of `mask` in n blocks as equal as can be, as masks of their own."""
    free = [k for k in range(64) if not mask >> k & 1]
    return [sum(1 << k for k in part.tolist()) for part in np.array_split(np.array(free, np.int64), n) if len(part)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _group_links(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """A forest of the links in each group, or between two parts of one; columns mask, value, i, j, part and fp, sorted by these, fp without its sign."""
    held: list[np.ndarray] = []
    runs: list[tuple[tuple, int]] = []  # (mask, value, i, j, part) and where it begins
    size, last = 0, None

    def joined() -> pa.RecordBatch:
        keys = np.concatenate(held)
        ends = [at for _, at in runs[1:]] + [size]
        pairs = []
        for n, ((*task, part), at) in enumerate(runs):
            if task[2] == task[3]:
                pairs.append((at, ends[n], at, ends[n]))
            elif part == task[2] and n + 1 < len(runs) and list(runs[n + 1][0][:4]) == task:
                pairs.append((at, ends[n], ends[n], ends[n + 1]))
        bounds = np.array(pairs, np.int64).reshape(-1, 4).T
        root = forest(len(keys), trie_join(keys, *bounds, budget))
        moved = np.flatnonzero(root != np.arange(len(keys)))
        return pa.RecordBatch.from_arrays([pa.array(keys[moved].view(np.int64)), pa.array(keys[root[moved]].view(np.int64))], names=["u", "v"])

    for batch in batches:
        *names, fp = (c.to_numpy() for c in batch.columns)
        changed = np.zeros(max(0, len(fp) - 1), bool)
        for c in names:
            changed |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist()] if len(fp) else []
        for a, b in zip(cuts, [*cuts[1:], len(fp)], strict=True):
            name = tuple(int(c[a]) for c in names)
            if name != last:
                if size >= BATCH and (not last or name[:4] != last[:4]):
                    yield joined()
                    held, runs, size = [], [], 0
                runs.append((name, size))
                last = name
            held.append(fp[a:b].view(np.uint64))
            size += b - a
    if size:
        yield joined()


def near_links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(u, v): spanning forests, one for some groups of a task, of the links among the column fp of `distinct`."""
    masks = F.array(*(F.lit(_signed(m)).cast("bigint") for m in blocks(0, budget + 1)))
    sent = distinct.select("fp", F.explode(masks).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    n = F.count(F.lit(1)).alias("n")
    large = cut_lineage(sent.groupBy("mask", "value").agg(n).where(F.col("n") > NODE).select("mask", "value", F.ceil(F.col("n") / NODE).cast("int").alias("parts")))
    zero = F.lit(0).cast("int")
    tasks = sent.join(large.hint("merge"), ["mask", "value"], "left_anti").select("mask", "value", zero.alias("i"), zero.alias("j"), zero.alias("part"), "fp")
    if not large.isEmpty():
        cut = cut_lineage(salted_join(sent, large, ["mask", "value"], "fp"))
        most = PARTS if budget % 2 == 0 else 1 << 30
        of = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        parts = cut.where(F.col("parts") <= most).withColumn("part", of).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        tasks = tasks.unionByName(parts.select("mask", "value", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "fp"))
    order = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))  # signed order of this is unsigned order of fp
    tasks = tasks.repartition("mask", "value", "i", "j").sortWithinPartitions("mask", "value", "i", "j", "part", order)
    links = tasks.mapInArrow(lambda it: _group_links(it, budget), "u bigint, v bigint")
    if large.isEmpty():
        return links
    return links.unionByName(midpoint_links(cut.where(F.col("parts") > most).select("fp").distinct(), budget))


def midpoint_links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(u, v): every fingerprint with the least one around each value within half of the (even) budget of it."""
    flips = [sum(1 << b for b in some) for n in range(budget // 2 + 1) for some in combinations(range(64), n)]
    around = distinct.select("fp", F.explode(F.array(*(F.lit(_signed(x)).cast("bigint") for x in flips))).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("value"))
    low = around.groupBy("value").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("value", "low")
    return salted_join(around, low, "value", "fp").where("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v")).distinct()


def near_duplicates(df: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """(id, fp, component_id, root) for every row; component_id is the least id of the row's component, root a key of it.

    Links are all pairs within `budget` bits.
    """
    rows = cut_lineage(fingerprints(df, width, id_col, text_col))
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("least")))
    return _grouped(rows, classes, near_links(classes, budget))


def _grouped(rows: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """`rows` with component_id and root, from the links (u, v) among their fp; `classes` has the least id of each fp."""
    roots = components(links, "u", "v")
    every = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = cut_lineage(every.join(classes.hint("merge"), F.col("node") == F.col("fp")).select("fp", "least", "root"))
    low = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = salted_join(linked.select(F.col("fp").alias("_node"), "root"), low, "root", "_node")
    named = classes.join(joined.hint("merge"), F.col("fp") == F.col("_node"), "left")
    named = named.select(F.col("fp").alias("_fp"), F.when(F.col("_node").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "fp").alias("root"))
    # read back, so that both sides come from plain exchanges and a fingerprint of many copies can be split at run time
    return rows.join(cut_lineage(named).hint("merge"), F.col("fp") == F.col("_fp")).drop("_fp")


def set_keys(df: DataFrame, width: int, bands: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, n_set, bands, _row): fp is a hash of the set of a text's shingles here, n_set its size."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, width)) for t in utf8(batch.column(1))]
            fps = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
            keys = pa.array([band_keys(h, bands).view(np.int64) for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), pa.array([len(h) for h in sets], pa.int64()), keys, batch.column(2)], names=["id", "fp", "n_set", "bands", "_row"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"), "_row").mapInArrow(rows, "id bigint, fp bigint, n_set bigint, bands array<bigint>, _row bigint")


def close(prints: np.ndarray, budget: int) -> np.ndarray:
    """Which pairs of fingerprints are within `budget` bits, by the trie join."""
    order = np.argsort(prints, kind="stable")
    out = np.zeros((len(prints), len(prints)), bool)
    for x, y in trie_links(prints[order], np.zeros(1, int), budget):
        out[order[x], order[y]] = out[order[y], order[x]] = True
    return out


def set_forest(sets: list[np.ndarray], prints: np.ndarray, first: int, alike: float) -> Iterator[tuple[int, int]]:
    """Links (i, j) that span the components of all pairs of sets within LOOSE bits with a Jaccard similarity of at least `alike`.

    With `first` only pairs of one of the first `first` sets and one of the others count. Pairs already joined are not compared.
    """
    near = close(prints, LOOSE)
    size = np.array([len(x) for x in sets])
    stop = np.cumsum(size)
    start = stop - size
    values, places = np.unique(np.concatenate(sets), return_inverse=True)
    mine = np.zeros(len(values), bool)
    label = np.arange(len(sets))
    for i in range(first or 1, len(sets)):
        to = first or i
        smaller, larger = np.minimum(size[:to], size[i]), np.maximum(size[:to], size[i])
        open_ = np.flatnonzero(near[i, :to] & (label[:to] != label[i]) & (smaller >= alike * larger - 1e-6) & (larger > 0))
        if not len(open_):
            continue
        mine[places[start[i] : stop[i]]] = True
        if 4 * len(open_) < to:
            both = np.array([np.count_nonzero(mine[places[start[j] : stop[j]]]) for j in open_.tolist()])
        else:
            sums = np.append(0, np.cumsum(mine[places[: stop[to - 1]]]))
            both = sums[stop[open_]] - sums[start[open_]]
        mine[places[start[i] : stop[i]]] = False
        for j in open_[both / (size[open_] + size[i] - both) >= alike].tolist():
            if label[j] != label[i]:
                yield i, j
                label[label == label[j]] = label[i]


def _set_links(batches: Iterator[pa.RecordBatch], alike: float) -> Iterator[pa.RecordBatch]:
    """The links in each (key, a, b) of rows sorted by these; columns key, a, b, part, fp, print, hashes."""
    for _, rows in groupby((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[:3]):
        rows = sorted(rows, key=lambda r: r[3:5])  # at most about two parts
        first = sum(r[3] == r[1] for r in rows) if rows[0][1] != rows[0][2] else 0
        if rows[0][1] != rows[0][2] and first in (0, len(rows)):
            continue  # the hash left one of the parts empty
        sets, prints = [np.frombuffer(r[6], "<u8") for r in rows], np.array([r[5] for r in rows], np.int64).view(np.uint64)
        out = [(rows[i][4], rows[j][4]) for i, j in set_forest(sets, prints, first, alike)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["u", "v"])


def alike_links(docs: DataFrame, rows: DataFrame, width: int, alike: float, text_col: str) -> DataFrame:
    """(u, v): forests of the pairs of shingle sets that share a band's key, are within LOOSE bits and alike in `alike`, counted exactly.

    Sets are made again from the texts of those rows only that share a key. Keys shared by the same sets are one group. A group of
    more than SETS sets or HASHES hashes is cut into parts by hash, and all pairs of parts are compared.
    """
    classes = rows.groupBy("fp").agg(F.min(F.struct("_row", "n_set", "bands")).alias("one")).select("fp", "one.*")
    keyed = cut_lineage(classes.select("fp", "_row", "n_set", F.explode("bands").alias("key")).distinct())
    same = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("fp")).alias("sign"), F.min("fp").alias("low"), F.max("fp").alias("high"), F.sum("n_set").alias("hashes")]
    groups = keyed.groupBy("key").agg(*same).where("n > 1").groupBy("n", "sign", "low", "high", "hashes").agg(F.min("key").alias("key"))
    parts = F.greatest(F.ceil(F.col("n") / SETS), F.ceil(F.col("hashes") / HASHES)).cast("int")
    members = keyed.join(groups.select("key", parts.alias("parts")).hint("merge"), "key")
    wanted = members.groupBy("_row", "fp").agg(F.collect_list(F.struct("key", "parts")).alias("groups"))
    names = ["key", "a", "b", "part", "fp", "print", "hashes"]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, fp, its in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = np.unique(shingle_hashes(raw, width))
                bits, hashes = _signed(majority(own)), own.tobytes()
                out = [(g["key"], min(p, o), max(p, o), p, fp, bits, hashes) for g in its for p in [(fp * int(_ODD[0]) & _ALL) % g["parts"]] for o in range(g["parts"])]
                for at in range(0, len(out), 64):
                    cols = zip(*out[at : at + 64], strict=True)
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    texts = docs.select("_row", text_of(text_col).alias("text")).join(wanted.hint("merge"), "_row").select("text", "fp", "groups")
    pieces = texts.mapInArrow(sent, "key bigint, a int, b int, part int, fp bigint, print bigint, hashes binary")
    return pieces.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(lambda it: _set_links(it, alike), "u bigint, v bigint").distinct()


def keep_one(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text", alike: float = 0.8, bands: int = 8) -> DataFrame:
    """The rows of `docs` whose id is the least of their component, one for each component.

    Links are the pairs of texts whose sets of shingles have a Jaccard similarity of at least `alike`, among those that share a
    band's key and whose fingerprints are within LOOSE bits. Rows are numbered as they are read, so `docs` must read the same again, as a written table does. Where several rows of a component share its least id (or all ids are null), the one with the least row number stays.
    """
    names = docs.columns
    (number,) = unused(names, 1)
    whole, docs = docs, docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("_row"))
    id_col, text_col = "id", "text"
    rows = cut_lineage(set_keys(docs, width, bands, id_col, text_col))
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("least")))
    near = _grouped(rows.select("id", "fp", "_row"), classes, alike_links(docs, rows, width, alike, text_col))
    first = near.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("_row").alias("_row"))
    first = first.select(F.col("_row").alias(number))
    return whole.withColumn(number, F.monotonically_increasing_id()).join(first.hint("merge"), number, "left_semi").select(*names)
