"""Substring removal by suffix automata: every word under a window of `width` words that also starts earlier goes.

Earlier: in a document with a smaller id, or further to the front of the same one. The first occurrence of a passage stays.

A suffix automaton of a shard of reference passages holds with every state the place where its strings first end. Passages are
streamed through it: the matching statistic at a word is the longest string ending there that the shard holds, and where it
reaches `width`, the state tells the first occurrence. If that is not the place itself, the window goes; the maximal spans under
such windows are removed.

The reference here is the corpus itself, so an automaton of one shard cannot be sent to all documents: documents times shards
grows with the square of the corpus. Content routes each passage to the one shard that can hold it instead:

1. Equal texts are reduced to one row with their least id. Every window has an anchor, the least hash among its substrings of GRAM
   words; neighbouring windows with one anchor form a run. Equal windows have equal anchors. Anchors are counted, and runs of one that
   occurs once go no further.
2. The runs left go back to their texts for a hash of their whole span. Those with equal spans are one class, for which its first run stands; the others are its copies.
3. The spans of the classes go to tasks by their anchor, in order of place. Anchors side by side, up to PIECE words, are a shard; a task builds its automaton,
   streams the shard's passages through it, and gives for each class the windows that occur earlier, and those that its copies
   repeat. Windows of one anchor are in one shard, so a shard decides about them for all.
4. An anchor with more than HOT classes, or more than MOST words in them (a common phrase in many contexts), would be too much for
   one task. Its windows are taken one by one, each with its own hash for an anchor, and steps 2 and 3 are taken again. A group is
   then a single window, however often it occurs.

A task holds one shard, of a bounded size; places go back to texts by joins on their keys, salted where a class has many copies.

Defined cases: null texts have no words; a null id comes after all others, texts of one id in the order of their hashes; rows alike in id
and text are one document, whose result each of them gets; texts under `width` words lose nothing; a repetition within one text
counts; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, kept_table, release, replaced, salted_join, shared_folder, text_of, to_discard, utf8
from .suffix_dedup import SLICE, _signed, _word_hashes, covered, runs_of

WIDTH = 20
GRAM = 8
PIECE = 40_000  # words of a shard, about
HOT, MOST = 1000, 40_000
LAST = (1 << 63) - 1  # stands for a null id

RUN = "anchor bigint, k1 bigint, k2 int, begin int, end int, twin boolean"
_RUN = [c.split()[0] for c in RUN.split(", ")]
SPAN = "anchor bigint, span bigint, ord bigint, k1 bigint, k2 int, begin int, end int, twin boolean"
_SPAN = [c.split()[0] for c in SPAN.split(", ")]
PLACE = ["ord", "k1", "k2", "begin"]


class Automaton:
    """The suffix automaton of sequences of symbols, added one after the other; `first`: where a state's strings first end, counting all symbols."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.first = [-1], [0], [-1]
        self.n = 0

    def _state(self, size: int, link: int, first: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        self.first.append(first)
        return len(self.size) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the strings of q that are no longer than those of p and c."""
        clone = self._state(self.size[p] + 1, self.link[q], self.first[q], self.next[q].copy())
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, symbols: list[int]) -> None:
        following, link, size = self.next, self.link, self.size
        last = 0
        for c in symbols:
            q = following[last].get(c)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._split(last, c, q)
            else:
                new = self._state(size[last] + 1, 0, self.n, {})
                p = last
                while p >= 0 and c not in following[p]:
                    following[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = following[p][c]
                    link[new] = q if size[q] == size[p] + 1 else self._split(p, c, q)
                last = new
            self.n += 1

    def matches(self, symbols: list[int], width: int) -> Iterator[tuple[int, int]]:
        """For each symbol the length of the longest string ending there, counted up to `width`, and where that first ends."""
        following, link, size, first = self.next, self.link, self.size, self.first
        state = length = 0
        for c in symbols:
            while state and c not in following[state]:
                state = link[state]
                length = size[state]
            if c in following[state]:
                state = following[state][c]
                length += 1
                if length >= width:
                    length = width
                    while size[link[state]] >= width:
                        state = link[state]
            yield length, first[state]


def ranges_of(flags: list[bool]) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(flags, np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def judged(spans: list[bytes], width: int) -> list[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """For each span, given in order of place: its windows that occur earlier, and all that occur in the shard, as ranges of starts."""
    number: dict[bytes, int] = {}
    sequences = [[number.setdefault(w, len(number)) for w in span.split(b" ")] for span in spans]
    shard = Automaton()
    for s in sequences:
        shard.add(s)
    out, at = [], 0
    for s in sequences:
        earlier, known = [], []
        for k, (length, first) in enumerate(shard.matches(s, width), at):
            known.append(length >= width)
            earlier.append(length >= width and first < k)
        out.append((ranges_of(earlier[width - 1 :]), ranges_of(known[width - 1 :])))
        at += len(s)
    return out


_KINDS = {"k2": pa.int32(), "begin": pa.int32(), "end": pa.int32(), "low": pa.int32(), "high": pa.int32(), "twin": pa.bool_(), "copies": pa.bool_(), "bytes": pa.binary()}


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS.get(n, pa.int64())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def _spans_of(body: bytes, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> Iterator[bytes]:
    """The bytes of the windows that start in [begin, end)."""
    for a, b in zip(starts[begin].tolist(), ends[end + width - 2].tolist(), strict=True):
        yield body[a:b]


def _runs(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The runs of texts (k1, k2, text)."""

    def found() -> pa.RecordBatch:
        at, symbols = zip(*held, strict=True)
        text, begin, end, anchor, twin = runs_of(np.concatenate(symbols), np.array([len(x) for x in symbols]), width, gram)
        keys = [pa.array(c[np.array(at)[text]]) for c in (k1, k2)]
        return pa.RecordBatch.from_arrays([_signed(anchor), *keys, pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(twin)], names=_RUN)

    for batch in batches:
        k1, k2 = (batch.column(c).to_numpy() for c in range(2))
        held, size = [], 0
        for n, raw in enumerate(utf8(batch.column(2))):
            words = raw.split()
            if len(words) >= width:
                held.append((n, _word_hashes(b" ".join(words))[0]))
                size += len(words)
            if size >= SLICE:
                yield found()
                held, size = [], 0
        if held:
            yield found()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows with texts, some at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            yield from batch.slice(at, 200).to_pylist()


def _laid_out(row: dict) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a row's text joined by one space, and where each begins and ends."""
    body = b" ".join(row["text"].encode().split())
    return body, *_word_hashes(body)[1:]


def _named(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Runs, which come beside their texts, with a hash of their spans."""
    for row in _rows(batches):
        laid = _laid_out(row)
        for at in range(0, len(row["runs"]), 4096):
            runs = row["runs"][at : at + 4096]
            begin, end = (np.array([r[k] for r in runs]) for k in ("begin", "end"))
            spans = np.array([xxhash.xxh3_64_intdigest(s) for s in _spans_of(*laid, begin, end, width)], np.uint64).view(np.int64).tolist()
            yield _columns([(r["anchor"], s, row["ord"], row["k1"], row["k2"], r["begin"], r["end"], r["twin"]) for r, s in zip(runs, spans, strict=True)], _SPAN)


def _single(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The windows of runs, which come beside their texts, each as a run of its own."""
    for row in _rows(batches):
        laid = _laid_out(row)
        for r in row["runs"]:
            for low in range(r["begin"], r["end"], 4096):
                begin = np.arange(low, min(low + 4096, r["end"]))
                digests = [xxhash.xxh3_128_intdigest(s) for s in _spans_of(*laid, begin, begin + 1, width)]
                halves = [np.array([d >> k & (1 << 64) - 1 for d in digests], np.uint64).view(np.int64).tolist() for k in (64, 0)]
                yield _columns([(a, b, row["ord"], row["k1"], row["k2"], s, s + 1, False) for a, b, s in zip(*halves, begin.tolist(), strict=True)], _SPAN)


SENT = "anchor bigint, span bigint, ord bigint, k1 bigint, k2 int, begin int, bytes binary"
_SENT = [c.split()[0] for c in SENT.split(", ")]


def _sent(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        laid = _laid_out(row)
        for at in range(0, len(row["runs"]), 2048):
            runs = row["runs"][at : at + 2048]
            begin, end = (np.array([r[k] for r in runs]) for k in ("begin", "end"))
            yield _columns([(r["anchor"], r["span"], row["ord"], row["k1"], row["k2"], r["begin"], s) for r, s in zip(runs, _spans_of(*laid, begin, end, width), strict=True)], _SENT)


FOUND = "anchor bigint, span bigint, k1 bigint, k2 int, begin int, low int, high int, copies boolean"
_FOUND = [c.split()[0] for c in FOUND.split(", ")]


def _shards(batches: Iterator[pa.RecordBatch], width: int, piece: int) -> Iterator[pa.RecordBatch]:
    """What a class's first run and its copies lose, from spans sorted by anchor and place; anchors are never divided."""

    def found() -> Iterator[pa.RecordBatch]:
        out = []
        for (anchor, span, _, k1, k2, begin, _), ranges in zip(held, judged([h[6] for h in held], width), strict=True):
            out += [(anchor, span, k1, k2, begin, low, high, copies) for copies, part in enumerate(ranges) for low, high in part]
        if out:
            yield _columns([(*r[:7], bool(r[7])) for r in out], _FOUND)

    held: list[tuple] = []
    size = 0
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for _, group in groupby(rows, key=lambda row: row[0]):
        if size >= piece:
            yield from found()
            held, size = [], 0
        some = list(group)  # of at most HOT rows and MOST words
        held += some
        size += sum(row[6].count(b" ") + 1 for row in some)
    if held:
        yield from found()


def _beside(texts: DataFrame, runs: DataFrame, *columns: str) -> DataFrame:
    """Texts with their runs as an array; texts stay in their buckets."""
    wanted = runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "begin", "end", *columns)).alias("runs"))
    return texts.select("k1", "k2", "ord", "text").join(wanted.hint("merge"), ["k1", "k2"])


def _classes(runs: DataFrame, width: int, hot: int, most: int) -> DataFrame:
    """(anchor, span, n, the first run, hot) of the classes that may share windows with another run."""
    first = F.min(F.struct(*PLACE, "end")).alias("one")
    classes = runs.groupBy("anchor", "span").agg(first, F.count(F.lit(1)).alias("n"), F.max("twin").alias("twin"))
    kinds, words = F.count(F.lit(1)), F.sum(F.col("one.end") - F.col("one.begin") + width - 1)
    sizes = classes.groupBy("anchor").agg((F.sum("n") > 1).alias("again"), ((kinds > hot) | (words > most)).alias("hot"))
    wanted = classes.join(sizes.hint("merge"), "anchor").where("again or twin or hot")
    kept = cut_lineage(wanted.select("anchor", "span", "n", "one.*", "hot"))
    release(runs.sparkSession)
    return kept


def _decided(texts: DataFrame, runs: DataFrame, classes: DataFrame, width: int, piece: int) -> DataFrame:
    """(k1, k2, begin, end): windows of `runs` that occur earlier, by the automata of the classes' shards."""
    spans = _beside(texts, classes, "span").mapInArrow(lambda it: _sent(it, width), SENT)
    shards = spans.repartition("anchor").sortWithinPartitions("anchor", *PLACE).mapInArrow(lambda it: _shards(it, width, piece), FOUND)
    found = kept_table(shards)
    lost = found.where("not copies").select("k1", "k2", (F.col("begin") + F.col("low")).alias("begin"), (F.col("begin") + F.col("high")).alias("end"))
    # a class has one range of all its windows here; the copies are the runs that are not its first
    several = found.where("copies").join(classes.where("n > 1").select("anchor", "span").hint("merge"), ["anchor", "span"])
    several = several.select("anchor", "span", F.struct("k1", "k2", "begin").alias("one"), "low", "high")
    copies = salted_join(runs.select("anchor", "span", "k1", "k2", "begin"), several, ["anchor", "span"], "k1")
    copies = copies.where(F.struct("k1", "k2", "begin") != F.col("one"))
    return lost.unionByName(copies.select("k1", "k2", (F.col("begin") + F.col("low")).alias("begin"), (F.col("begin") + F.col("high")).alias("end")))


def earlier(texts: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, most: int = MOST, piece: int = PIECE) -> DataFrame:
    """(k1, k2, begin, end): ranges of words at which windows of `texts` (ord, k1, k2, text) start that also start earlier."""
    runs = kept_table(texts.select("k1", "k2", "text").mapInArrow(lambda it: _runs(it, width, gram), RUN))
    again = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("twin").alias("twin")).where("n > 1 or twin").select("anchor")
    repeated = runs.join(again.hint("merge"), "anchor", "left_semi")
    runs = replaced(runs, _beside(texts, repeated, "twin").mapInArrow(lambda it: _named(it, width), SPAN))
    classes = _classes(runs, width, hot, most)
    first = _decided(texts, runs, classes.where("not hot"), width, piece)
    # of a hot class only the first run is looked into; what copies hold occurs there
    firsts = classes.where("hot and n > 1").select("anchor", "span", F.struct("k1", "k2", "begin").alias("one"))
    copied = salted_join(runs.select("anchor", "span", "k1", "k2", "begin", "end"), firsts, ["anchor", "span"], "k1")
    copied = copied.where(F.struct("k1", "k2", "begin") != F.col("one")).select("k1", "k2", "begin", "end")
    single = kept_table(_beside(texts, classes.where("hot"), "span").mapInArrow(lambda it: _single(it, width), SPAN))
    second = _decided(texts, single, _classes(single, width, LAST, LAST), width, piece)
    return kept_table(first.unionByName(copied).unionByName(second))


def keys_of(text: Column) -> list[Column]:
    """A 64-bit and a 32-bit hash of a text: its key."""
    return [F.xxhash64(text).alias("k1"), F.hash(F.lit(1), text, F.lit(2)).alias("k2")]


def _distinct(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, ord, text), one row a text with its least id, kept in the shared folder in buckets of both keys."""
    spark = df.sparkSession
    text = text_of(text_col)
    rows = df.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("ord"), text.alias("text"), *keys_of(text))
    rows = rows.groupBy("k1", "k2").agg(F.min("ord").alias("ord"), F.first("text").alias("text"))
    name = f"first_texts_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    rows.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "k1", "k2").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    to_discard(path, name)
    return spark.table(name)


KEPT = "k1 bigint, k2 int, ord bigint, n_words bigint, n_removed bigint, kept binary"


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in KEPT.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            out = []
            for raw, ranges in zip(utf8(part.column(3)), part.column(4).to_pylist(), strict=True):
                words = raw.split()
                gone = covered([(r["begin"], r["end"]) for r in ranges or []], width)
                edges = [0, *(x for span in gone for x in span), len(words)]
                left = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                out.append((len(words), len(words) - len(left), b" ".join(left)))
            n_words, n_removed, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], names=names)


def remove_copied(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot: int = HOT, most: int = MOST, piece: int = PIECE) -> DataFrame:
    """(k1, k2, ord, n_words, n_removed, kept): what is left of each distinct text where it comes first, under the id `ord`.

    `kept` are the words joined by one space. Under any other id the whole text has come before: from `width` words on nothing is left.
    """
    texts = _distinct(df, id_col, text_col)
    release(df.sparkSession)
    ranges = earlier(texts, width, gram, hot, most, piece)
    lists = ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    both = texts.select("k1", "k2", "ord", "text").join(lists.hint("merge"), ["k1", "k2"], "left").select("k1", "k2", "ord", "text", "ranges")
    return both.mapInArrow(lambda it: _cut(it, width), KEPT)
