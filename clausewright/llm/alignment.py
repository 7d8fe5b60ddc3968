"""Alignment of two tokenizers over the same bytes, and how often their tokens are linked.

A text is encoded twice: by A, a byte-level vocabulary, with a space before the text, and by B, a SentencePiece model that puts
that space there itself. Byte offsets where tokens of both end (running sums of lengths, `intersect1d`) cut the tokens into groups,
`searchsorted` labels every token with its group, and repeating tokens by the sizes of the other side makes the links: every
token of A in a group with every token of B in it. Where both sides of a group have several tokens, equal ones are first counted, so
a group without inner cuts costs its different tokens and not the product of its sizes.

Before a space that follows no white space both sides always end a token: the pattern of A never goes on there, and no piece
of B holds a space after another character (checked when the model is read; otherwise texts stay whole). So texts are cut there into units, and
a block encodes and aligns its different units once.

Spark's part:

1. A task encodes blocks of texts of about BLOCK characters and writes, to a table in the shared folder, each document's distinct pairs
   (places in the block's list of pairs) with their numbers, and for each pair of the block how many documents hold it.
2. The blocks' pairs are summed in two stages, by pair and a salt of the block, then by pair; the highest count of each id of A
   is taken from the sums. Nothing of this is broadcast or collected: the table of pairs grows with the corpus.
3. The sums go back to the blocks by a salted join on the pair, as sorted rows before the documents of the block, and a task walks
   through blocks with one block's counts at a time. So what is shuffled is a row a pair and block, not a row a link.

Defined cases: texts that are null or empty, or whose joined bytes on either side differ from a space and the text, have no tokens
(zeros, an empty string of groups) and count for no pair; repeated rows count each; null ids stay; an empty table gives an
empty table. A text longer than BLOCK is a block of its own.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_table, salted_join, text_of, texts

BLOCK = 1 << 22  # characters of text
CHUNK = 1 << 14  # bytes encoded at once
DOCUMENTS = 4096  # of a block, at most
SLICE = 1 << 21  # links laid out at once, about
SALTS = 16

_CUT = re.compile(r"(?<=\S) ")  # Python's white space holds all that the pattern of A knows
_ODD = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]

ROWS = "block bigint, kind int, code bigint, n bigint, id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links binary"
_ROWS = [f.split()[0] for f in ROWS.split(", ")]
DOCUMENT, PAIR = 1, 0


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Tokenizers:
    """Both encoders with the bytes of their ids. `ranks`: the vocabulary of A as byte ranks, for a faster encoder that gives the same ids."""

    def __init__(self, a_path: str, ranks: str | None, b_path: str):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(a_path)
        slow.encode_special_tokens = True  # their strings are plain text
        self._slow, self._fast = slow, None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        letters = byte_letters()
        by_id = {i: t for t, i in slow.get_vocab().items()}
        self.a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in (by_id.get(i, "") for i in range(max(by_id) + 1))]
        self._b = b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in range(b.get_piece_size()) for p in [b.id_to_piece(i)]]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in s], np.int64) for s in (self.a_bytes, self.b_bytes))
        self.cuts = not any(re.search("[^▁]▁", b.id_to_piece(i)) for i in range(b.get_piece_size()))
        self.base = 2 * len(self.a_bytes)
        #: how an id is written in a string of groups: followed by another of its side, or the last of its side
        self.written = [f"{i}{end}".encode() for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(n) for end in ends]
        self.written_sizes = np.array([len(x) for x in self.written])

    def a(self, text: str) -> np.ndarray:
        if self._fast is None:
            return np.asarray(self._slow.encode(text, add_special_tokens=False).ids, np.int64)
        return self._fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)

    def _same(self, a: np.ndarray, raw: bytes) -> bool:
        """Whether the bytes of A are those of the text; the encoder by ranks cuts them from the text itself."""
        return int(self.a_sizes[a].sum()) == len(raw) and (self._fast is not None or b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw)

    def units(self, text: str) -> list[str]:
        """What a text with a space before it is cut into, each without its first character, a space."""
        if not self.cuts:
            return [text]
        odd = text[0] == " " or any(x in text for x in _ODD)
        return _CUT.split(text) if odd else text.split(" ")

    def both(self, units: list[str], ends: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A, how many each unit has, the same of B, and which units are lost: the bytes of a side are not a space and the unit.

        Units go to the encoders in joined chunks; those of `ends`, which may end in white space and then would not stay apart, go alone.
        """
        sizes = np.fromiter(map(len, map(str.encode, units)), np.int64, len(units)) + 1
        alone = np.zeros(len(units), bool)
        alone[[u for u in ends if not units[u] or units[u][-1].isspace()]] = True
        order = np.argsort(alone, kind="stable")
        chunk = (np.cumsum(sizes[order]) - 1) // CHUNK
        cuts = np.flatnonzero((chunk[1:] != chunk[:-1]) | alone[order][1:]) + 1 if len(order) else order
        todo = [part.tolist() for part in np.split(order, cuts)] if len(order) else []
        n_a, n_b, lost = (np.zeros(len(units), kind) for kind in (np.int64, np.int64, bool))
        a_ids, b_ids, placed = [], [], []
        while todo:
            joined = [" ".join(map(units.__getitem__, part)) for part in todo]
            again = []
            for part, text, b in zip(todo, joined, self._b.encode(joined, num_threads=1), strict=True):
                b = b or [self._b.piece_to_id("▁")]  # a space at the end of a text
                a, raw = self.a(" " + text), b" " + text.encode()
                if b"".join(map(self.b_bytes.__getitem__, b)) == raw and self._same(a, raw):
                    stops = np.cumsum(sizes[part])
                    b = np.array(b, np.int64)
                    for ids, into, count, each in ((a, a_ids, n_a, self.a_sizes), (b, b_ids, n_b, self.b_sizes)):
                        into.append(ids)
                        count[part] = np.diff(np.searchsorted(np.cumsum(each[ids]), stops, side="right"), prepend=0)
                    placed.append(part)
                elif len(part) > 1:
                    again += [[u] for u in part]
                else:
                    lost[part] = True
            todo = again
        placed = np.array([u for part in placed for u in part], np.int64)
        return *_in_order(a_ids, n_a, placed), *_in_order(b_ids, n_b, placed), lost


def _in_order(parts: list[np.ndarray], count: np.ndarray, placed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of units, which come in the order `placed`, by unit."""
    ids = np.concatenate([np.empty(0, np.int64), *parts])
    low = np.zeros(len(count), np.int64)
    low[placed] = np.cumsum(count[placed]) - count[placed]
    return ids[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)], count


@functools.lru_cache(maxsize=2)
def tokenizers(a_path: str, ranks: str | None, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, ranks, b_path)


def _counted(group: np.ndarray, ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (group, id), sorted by group, and how often each occurs."""
    key, n = np.unique(group << bits | ids, return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), n


def _expanded(ga: np.ndarray, a: np.ndarray, na: np.ndarray, gb: np.ndarray, b: np.ndarray, nb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, code, number) of every entry of A with every entry of B of its group, slice by slice; both come sorted by group."""
    low = np.searchsorted(gb, ga)
    runs = np.searchsorted(gb, ga, side="right") - low
    total = np.cumsum(runs)
    at = 0
    while at < len(ga):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE, side="right")))
        r = runs[at:to]
        j = np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r) + np.repeat(low[at:to], r)
        yield np.repeat(ga[at:to], r), np.repeat(a[at:to], r) << 32 | b[j], np.repeat(na[at:to], r) * nb[j]
        at = to


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, with the sums of their numbers."""
    if not len(key):
        return key, n
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n[order], first)


class Aligned:
    """The alignment of some texts, all at once: n_a, n_b, n_groups and n_links by text, `codes`, and the distinct links of each text."""

    def __init__(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, t: Tokenizers):
        n = len(n_a)
        self.a, self.n_a, self.b, self.n_b = a, n_a, b, n_b
        a_ends, b_ends = np.cumsum(t.a_sizes[a]), np.cumsum(t.b_sizes[b])
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        self.ga, self.gb = ga, gb = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        self.a_in, self.b_in = np.bincount(ga, minlength=len(common)), np.bincount(gb, minlength=len(common))
        text = np.repeat(np.arange(n), self.n_a)  # of each token of A
        last = np.cumsum(self.a_in) - 1
        self.text = text[last]  # of each group
        self.n_groups = np.bincount(self.text, minlength=n)
        self.n_links = np.zeros(n, np.int64)
        np.add.at(self.n_links, self.text, self.a_in * self.b_in)
        bits = int(max(len(t.a_bytes), len(t.b_bytes))).bit_length()
        wide = (self.a_in > 1) & (self.b_in > 1)
        plain_a, plain_b = ~wide[ga], ~wide[gb]
        one = lambda x: np.ones(len(x), np.int64)
        sides = [(ga[plain_a], a[plain_a], one(ga[plain_a]), gb[plain_b], b[plain_b], one(gb[plain_b]))]
        sides.append((*_counted(ga[~plain_a], a[~plain_a], bits), *_counted(gb[~plain_b], b[~plain_b], bits)))
        held = [self._by_text(*x) for side in sides for x in _expanded(*side)]
        self.codes = np.unique(np.concatenate([np.empty(0, np.int64), *(c for _, c, _ in held)]))
        size = max(1, len(self.codes))
        key = np.concatenate([np.empty(0, np.int64), *(d * size + np.searchsorted(self.codes, c) for d, c, _ in held)])
        key, self.times = _summed(key, np.concatenate([np.empty(0, np.int64), *(m for _, _, m in held)]))
        self.places = key % size
        self.each = np.searchsorted(key // size, np.arange(n + 1))

    def _by_text(self, group: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, code, number), summed within a slice of links."""
        codes, at = np.unique(code, return_inverse=True)
        key, n = _summed(self.text[group] * max(1, len(codes)) + at, n)
        return key // max(1, len(codes)), codes[key % max(1, len(codes))], n

    def written(self, t: Tokenizers) -> list[bytes]:
        """The groups of each text: `a1,a2|b1;a3|b2,b3;`."""
        a_last, b_last = np.append(self.ga[1:] != self.ga[:-1], True), np.append(self.gb[1:] != self.gb[:-1], True)
        out = np.empty(len(self.a) + len(self.b), np.int64)
        if len(out):
            out[np.arange(len(self.a)) + (np.cumsum(self.b_in) - self.b_in)[self.ga]] = 2 * self.a + a_last
            out[np.arange(len(self.b)) + np.cumsum(self.a_in)[self.gb]] = t.base + 2 * self.b + b_last
        whole = b"".join(map(t.written.__getitem__, out.tolist()))
        ends = np.append(0, np.cumsum(t.written_sizes[out]))[np.cumsum(self.n_a + self.n_b)].tolist()
        return [whole[low:high] for low, high in zip([0, *ends], ends)]


class Numbers(dict):
    """Numbers its keys as they are met."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Block:
    """The alignment of whole texts from that of their different units: n_a, n_b, n_groups, n_links, `groups`, and distinct links by text."""

    def __init__(self, some: list[str], t: Tokenizers):
        number = Numbers()
        rows = [list(map(number.__getitem__, t.units(text))) if text else [] for text in some]
        *ids, lost = t.both(list(number), {row[-1] for row in rows if row})
        unit = Aligned(*ids, t)
        if lost.any():
            lost = lost.tolist()
            rows = [[] if any(map(lost.__getitem__, row)) else row for row in rows]
        sizes = np.array([len(row) for row in rows])
        own = np.repeat(np.arange(len(some)), sizes)
        units = np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum()))
        written = unit.written(t)
        self.groups = [b"".join(map(written.__getitem__, row))[:-1] for row in rows]
        for name in ("n_a", "n_b", "n_groups", "n_links"):
            total = np.append(0, np.cumsum(getattr(unit, name)[units]))
            ends = np.cumsum(sizes)
            setattr(self, name, total[ends] - total[ends - sizes])
        self.codes = unit.codes
        size = max(1, len(self.codes))
        key, times = np.unique(own * max(1, len(number)) + units, return_counts=True)
        own, units = key // max(1, len(number)), key % max(1, len(number))
        runs = unit.each[units + 1] - unit.each[units]
        j = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(unit.each[units], runs)
        key, self.times = _summed(np.repeat(own, runs) * size + unit.places[j], np.repeat(times, runs) * unit.times[j])
        self.places = key % size
        self.each = np.searchsorted(key // size, np.arange(len(some) + 1))
        self.holders = np.bincount(self.places, minlength=len(self.codes))


def _aligned(batches: Iterator[pa.RecordBatch], paths: tuple, digest: bool) -> Iterator[pa.RecordBatch]:
    t = tokenizers(*paths)
    block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    held: list[tuple[int | None, str]] = []
    size = 0
    for batch in batches:
        for row in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            held.append(row)
            size += len(row[1])
            if size >= BLOCK or len(held) >= DOCUMENTS:
                yield from _block_rows(held, block, t, digest)
                held, size, block = [], 0, block + 1
    if held:
        yield from _block_rows(held, block, t, digest)


def _block_rows(held: list[tuple[int | None, str]], number: int, t: Tokenizers, digest: bool) -> Iterator[pa.RecordBatch]:
    x = Block([text for _, text in held], t)

    def batch(size: int, kind: int, **columns) -> pa.RecordBatch:
        fixed = {"block": pa.array(np.full(size, number)), "kind": pa.array(np.full(size, kind, np.int32))}
        kinds = {"groups": pa.string(), "links": pa.binary()}
        return pa.RecordBatch.from_arrays([(fixed | columns)[c] if c in fixed or c in columns else pa.nulls(size, kinds.get(c, pa.int64())) for c in _ROWS], names=_ROWS)

    used = np.flatnonzero(x.holders)  # units of texts without tokens have pairs that no text holds
    place = np.cumsum(x.holders > 0) - 1
    if len(used):
        yield batch(len(used), PAIR, code=pa.array(x.codes[used]), n=pa.array(x.holders[used]))
    groups = [hashlib.sha256(g).hexdigest() if digest and g else g.decode() for g in x.groups]
    links = []
    for low, high in zip(x.each[:-1].tolist(), x.each[1:].tolist(), strict=True):
        links.append(np.concatenate([place[x.places[low:high]].astype("<u4").view(np.uint8), x.times[low:high].astype("<i8").view(np.uint8)]).tobytes())
    for at in range(0, len(held), 256):
        to = slice(at, at + 256)
        numbers = {k: pa.array(getattr(x, k)[to], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")}
        yield batch(len(held[to]), DOCUMENT, id=pa.array([i for i, _ in held[to]], pa.int64()), groups=pa.array(groups[to], pa.string()), links=pa.array(links[to], pa.binary()), **numbers)


OUT = "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"


def _with_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with n_best and count_sum; columns block, kind, code, n, best and those of documents, sorted by the first three."""
    now, held = None, []
    counts, best = np.empty(0, np.int64), np.empty(0, bool)
    for batch in batches:
        block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
            part = batch.slice(low, high - low)
            if not part.num_rows:
                continue
            if block[low] != now:
                now, held = block[low], []
                counts, best = np.empty(0, np.int64), np.empty(0, bool)
            if kind[low] == PAIR:
                held.append((part.column("n").to_numpy(zero_copy_only=False), part.column("best").to_numpy(zero_copy_only=False).astype(bool)))
                continue
            if held:
                counts, best = (np.concatenate(c) for c in zip(*held, strict=True))
                held = []
            n_best, sums = [], []
            for raw in part.column("links").to_pylist():
                n = len(raw) // 12
                places, times = np.frombuffer(raw, "<u4", n), np.frombuffer(raw, "<i8", n, 4 * n)
                n_best.append(int(times[best[places]].sum()))
                sums.append(int((times * counts[places]).sum()))
            cols = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
            yield pa.RecordBatch.from_arrays([cols[c] if c in cols else part.column(c) for c in (f.split()[0] for f in OUT.split(", "))], names=[f.split()[0] for f in OUT.split(", ")])


def pair_counts(rows: DataFrame) -> DataFrame:
    """(code, n, best): in how many documents a pair (id of A << 32 | id of B) is linked, and whether that is the most for its id of A."""
    pairs = rows.where(F.col("kind") == PAIR).groupBy("code", F.pmod("block", F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    pairs = kept_table(pairs.groupBy("code").agg(F.sum("n").alias("n")))
    a = F.shiftright("code", 32)
    most = pairs.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return pairs.withColumn("a", a).join(most, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def align(df: DataFrame, a_path: str, ranks: str | None, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each row of `df`.

    n_best: links whose pair is held by as many documents as any pair of its id of A; count_sum: documents of the pair, over links.
    groups: ids of A and B by group as `a1,a2|b1;a3|b2,b3`; with `digest` the SHA-256 of that, in hex ('' without tokens).
    """
    paths = (a_path, ranks, b_path)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text")).mapInArrow(lambda it: _aligned(it, paths, digest), ROWS)
    rows = kept_table(rows)
    counted = pair_counts(rows)
    of_blocks = salted_join(rows.where(F.col("kind") == PAIR).select("block", "kind", "code"), counted, "code", "block")
    documents = rows.where(F.col("kind") == DOCUMENT).drop("n").drop("code")
    both = of_blocks.unionByName(documents, allowMissingColumns=True)
    ordered = both.repartition("block").sortWithinPartitions("block", "kind", "code")
    return ordered.mapInArrow(_with_counts, OUT)
