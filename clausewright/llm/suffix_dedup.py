"""Suffix-array removal of repeated strings: every byte under a string of `width` units that also starts elsewhere goes.

A unit is a byte, or a word (`words_of`), so that "400 bytes" and "over 50 words" are both said exactly. Suffix sorting is by the
difference-cover algorithm of modulus three (`suffix_array`: sort the triples at positions 1 and 2 modulo 3, recurse on
their names, sort the rest by one symbol and a rank, merge, then compare neighbours' prefixes), in pieces of
bounded size. What the pieces are is decided by content, so that equal strings always meet in one piece and most of the
text need not be sorted at all:

1. Equal texts are reduced to one row with its number of copies. Every string of `width` units has an anchor, the least
   hash among its substrings of `gram` units; neighbouring strings with the same anchor form a run. Equal strings have equal
   anchors. Anchors are counted first: those that occur once cannot repeat, their runs go no further and their text is never
   sent anywhere.
2. Runs whose whole span is equal are one class: in classes of two or more every string repeats. One run of each
   class stands for it from here on.
3. Where an anchor has several classes, each run is cut in two where the anchor passes the middle of a string. All strings of
   the first half hold the units before the anchor, all of the second half those after it; these longer substrings are the
   halves' new anchors, and steps 1 and 2 are taken again with them. A common phrase alone thus brings nothing together. (An
   anchor that lies twice in one text, as in periodic text, stays as it is.)
4. Where an anchor still has several classes, or lies twice in a text, its spans are brought together by the anchor and
   suffix-sorted; neighbours with equal prefixes of `width` units repeat, and their bytes are compared. All strings of a half
   hold its anchor at one place, so there the anchor is a single symbol: its bytes are neither sent nor sorted, and a 128-bit hash
   (the anchor and a second hash of 64 bits) stands for them. An anchor with more than HOT
   classes, or more units in their spans than `most`, would be too much for one task: its strings are named one by
   one by a 128-bit hash instead, and names are counted, combined before the shuffle.

Recursion stops once names stand for more than `width` units. Spark keeps the distinct texts in a table in the shared
checkpoint folder, bucketed by their whole key, so later joins move positions and not texts; `common.discard` drops it.

Defined cases: null texts are empty; texts under `width` units lose nothing; a repetition within one text counts;
two rows of one text remove all of it (from `width` units on) in both; null ids stay; an empty table gives
an empty table.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, kept_table, release, replaced, salted_join, shared_folder, text_of, to_discard, unused

WIDTH = 400
PASSAGE = 51  # words: the least passage of over 50
HOT = 5000

_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_TABLE = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_WORD = re.compile(rb"[\xe3-\xf4][\x80-\xbf]*|[^\s\xe3-\xf4]+")  # from lead byte E3 on: kana, ideographs and what lies beyond
_LATE = re.compile(rb"[\xe3-\xf4]")
SLICE = 1 << 18  # units, or bytes of words, in arrays at once


@dataclass(frozen=True)
class Unit:
    """What strings are counted in. gram: units of an anchor; piece: units sorted at once; most: units of an anchor's spans in one task."""

    words: bool
    gram: int
    piece: int
    most: int


BYTES = Unit(False, 32, 150_000, 2_000_000)  # with piece below 3 * 2**20, up to where the names of triples fit 21 bits
WORDS = Unit(True, 8, 100_000, 300_000)


def words_of(raw: bytes) -> list[bytes]:
    """Runs without ASCII white space; in scripts written without spaces every character is a word."""
    return _WORD.findall(raw) if _LATE.search(raw) else raw.split()


def _word_hashes(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of `body`, which one space parts, and where they begin and end."""
    x = np.frombuffer(body, np.uint8)
    ends = np.append(np.flatnonzero(x == 32), len(x))
    starts = np.concatenate([[0], ends[:-1] + 1])
    out = np.empty(len(ends), np.uint64)
    at = 0
    while at < len(ends):  # some words at a time: their powers fit in a table
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + SLICE, side="right")))
        n = int(ends[to - 1]) - low
        up, down = _powers_of(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[x[low : low + n]] * up[:n], out=sums[1:])
        a = starts[at:to] - low
        out[at:to] = (sums[ends[at:to] - low] - sums[a]) * down[a]
        at = to
    out ^= out >> np.uint64(32)
    return out * np.uint64(_MIX[2]) | np.uint64(1), starts, ends


def laid_out(raw: bytes, unit: Unit) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes that units are cut from (words: joined by one space), the units' hashes, and where each begins and ends."""
    if not unit.words:
        at = np.arange(len(raw) + 1)
        return raw, _TABLE[np.frombuffer(raw, np.uint8)], at[:-1], at[1:]
    body = b" ".join(words_of(raw))
    return body, *(_word_hashes(body) if body else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)))


def suffix_array(s: np.ndarray, limit: int = 6, depth: int = 1) -> np.ndarray:
    """Order of the suffixes of positive integers; suffixes alike in 3**limit symbols may come in any order."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = s
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # one past the end keeps the halves apart
    sample = np.concatenate([ones, twos])
    bits = np.int64(int(t.max()).bit_length())
    place = np.int64(len(sample).bit_length())  # of ranks
    assert max(3 * bits, 2 * bits + place) <= 63, "a piece is too large for keys of 63 bits"
    key = (t[sample] << (2 * bits)) | (t[sample + 1] << bits) | t[sample + 2]
    order = np.argsort(key)
    ranked = key[order]
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(np.append(1, ranked[1:] != ranked[:-1]))
    if names.max() < len(sample) and depth < limit:
        order = suffix_array(names, limit, depth + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sorted12 = sample[order]
    sorted12 = sorted12[sorted12 < n]
    zeros = np.arange(0, n, 3)
    # a suffix at 0 modulo 3 meets those at 1 by a symbol and a rank, those at 2 by two symbols and a rank
    pair, trio = (lambda at: (t[at] << place) | rank[at + 1]), (lambda at: (((t[at] << bits) | t[at + 1]) << place) | rank[at + 2])
    sorted0 = zeros[np.argsort(pair(zeros))]
    low = np.zeros(len(sorted0), np.int64)
    for residue, key in ((1, pair), (2, trio)):
        others = np.maximum.accumulate(key(sorted12[sorted12 % 3 == residue]))  # only suffixes alike beyond the depth can be out of order
        low += np.searchsorted(others, key(sorted0))
    out = np.empty(n, np.int64)
    at0 = np.maximum.accumulate(low) + np.arange(len(sorted0))
    rest = np.ones(n, bool)
    rest[at0] = False
    out[at0], out[rest] = sorted0, sorted12
    return out


def _powers(n: int, base: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.multiply.accumulate(x)


@lru_cache(maxsize=4)
def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(n, _STEP), _powers(n, pow(_STEP, -1, 1 << 64))


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the step, and of its inverse."""
    return _powers_to(max(1024, 1 << (n - 1).bit_length()))


def prefix_codes(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit code of the `width` units from each position that has so many, from the units' hashes."""
    n = len(h)
    up, down = _powers_of(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=sums[1:])
    return (sums[width:] - sums[: n - width + 1]) * down[: n - width + 1]


def _verified(s: np.ndarray, i: np.ndarray, j: np.ndarray, width: int) -> np.ndarray:
    """Which pairs of positions have equal strings of `width` units; eight bytes of all pairs are compared at a time."""
    if not len(i):
        return np.zeros(0, bool)
    s = np.ascontiguousarray(s, np.min_scalar_type(int(s.max())))
    per = 8 // s.itemsize
    if width < per:
        per, words = 1, s
    else:
        words = np.ndarray(len(s) - per + 1, np.uint64, s, strides=(s.itemsize,)).copy()
    ok = np.ones(len(i), bool)
    for k in [*range(0, width - per, per), width - per]:
        ok &= words[i + k] == words[j + k]
    return ok


def repeated(spans: list[bytes], width: int, unit: Unit = BYTES, anchors: list | None = None, after: list[bytes] | None = None) -> list[np.ndarray]:
    """For each span, which of its `width`-unit strings occur elsewhere among the spans.

    With `anchors`, a span goes on with its anchor, which counts as one unit that only equal anchors equal, and the units `after` it.
    """
    names: dict = {}
    marks = [] if anchors is None else [names.setdefault(x, len(names)) for x in anchors]
    if unit.words:
        ids: dict[bytes, int] = {}
        parts = [[ids.setdefault(w, len(ids)) for w in span.split(b" ")] if span else [] for span in spans]
        sizes = np.array([len(p) for p in parts])
        if marks:
            tails = [[ids.setdefault(w, len(ids)) for w in span.split(b" ")] if span else [] for span in after]
            parts = [x for p, q in zip(parts, tails, strict=True) for x in (p, [0], q)]
        s = np.fromiter((w for p in parts for w in p), np.int64)
        h = (_word_hashes(b" ".join(ids))[0] if ids else np.zeros(1, np.uint64))[s]
        least = len(ids)
    else:
        sizes = np.array([len(x) for x in spans])
        s = np.frombuffer(b"".join([x for p, q in zip(spans, after, strict=True) for x in (p, b"\0", q)] if marks else spans), np.uint8)
        h = _TABLE[s]
        least = 256
        if marks:
            s = s.astype(np.int64)
        tails = after
    if marks:
        before = sizes
        sizes = before + 1 + np.array([len(x) for x in tails])
        at = np.cumsum(sizes) - sizes + before
        s[at] = least + np.array(marks)
        h[at] = (np.array(marks, np.uint64) + np.uint64(1)) * np.uint64(_MIX[3])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    limit = next(d for d in range(1, 64) if 3**d >= width)
    order = suffix_array(s.astype(np.int64) + 1, limit)
    whole = np.zeros(len(s), bool)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        whole[a : b - width + 1] = True
    order = order[whole[order]]  # equal prefixes stay neighbours
    code = prefix_codes(h, width)[order]
    same = np.flatnonzero(code[1:] == code[:-1])
    i, j = order[same], order[same + 1]
    ok = _verified(s, i, j, width)
    found = np.zeros(len(s), bool)
    found[i[ok]] = True
    found[j[ok]] = True
    return [found[a : b - width + 1] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _grams(symbols: np.ndarray, gram: int) -> tuple[np.ndarray, int]:
    """Hashes of the substrings of the largest power of two units up to `gram` and 32, and that power."""
    h, size = symbols, 1
    for m in _MIX:
        if 2 * size <= gram:
            h = h[:-size] * np.uint64(m) + h[size:]
            size *= 2
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(_MIX[2])
    h ^= h >> np.uint64(29)
    return h, size


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w neighbours."""
    n = len(h)
    p = np.full(-(-n // w) * w, ~np.uint64(0), np.uint64)
    p[:n] = h
    p = p.reshape(-1, w)
    left = np.minimum.accumulate(p, axis=1).ravel()
    right = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchor_runs(symbols: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Where each run of strings with one anchor begins (and, last, ends), the anchors, their first places and their size."""
    h, size = _grams(symbols, min(gram, width))
    least = _least(h, width - size + 1)
    starts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    anchors = least[starts]
    low = np.flatnonzero(h <= anchors.max())  # few: anchors are least values
    low = low[np.argsort(h[low], kind="stable")]
    return np.append(starts, len(least)), anchors, low[np.searchsorted(h[low], anchors)], size


def runs_of(symbols: np.ndarray, sizes: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of texts laid one after the other: text, begin, end, anchor, and whether the anchor lies in several places of its text.

    `sizes` are the texts' units, each at least `width`.
    """
    h, size = _grams(symbols, min(gram, width))
    off = np.cumsum(sizes) - sizes
    many = sizes - width + 1
    text = np.repeat(np.arange(len(sizes)), many)
    at = np.arange(many.sum()) + np.repeat(off - (np.cumsum(many) - many), many)
    least = _least(h, width - size + 1)[at]
    first = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])))
    run_text, anchor = text[first], least[first]
    begin = at[first] - off[run_text]
    end = begin + np.diff(np.append(first, len(at)))

    most = np.zeros(len(sizes), np.uint64)
    np.maximum.at(most, run_text, anchor)
    place = sizes - size + 1
    owner = np.repeat(np.arange(len(sizes)), place)
    where = np.arange(place.sum()) + np.repeat(off - (np.cumsum(place) - place), place)
    low = np.flatnonzero(h[where] <= most[owner])  # few: anchors are least values
    mark = lambda value, of: value ^ (of.astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP)
    seen, count = np.unique(mark(h[where[low]], owner[low]), return_counts=True)
    return run_text, begin, end, anchor, count[np.searchsorted(seen, mark(anchor, run_text))] > 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


RUN = "k1 bigint, k2 bigint, begin bigint, end bigint, anchor bigint, span bigint, copies bigint, twin boolean"
HALF = f"{RUN}, low bigint"  # where the longer anchor begins
_RUN, _HALF = ([c.split()[0] for c in kind.split(", ")] for kind in (RUN, HALF))


def _runs(batches: Iterator[pa.RecordBatch], width: int, unit: Unit) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k1, k2, copies = (batch.column(c).to_numpy() for c in (0, 1, 3))
        held, size = [], 0
        for n, raw in enumerate(_bytes(batch.column(2))):
            if len(raw) < width:
                continue
            body, symbols, starts, stops = laid_out(raw, unit)
            if len(symbols) >= width:
                held.append((n, body, symbols, starts, stops))
                size += len(symbols)
            if size >= SLICE:
                yield _runs_batch(held, k1, k2, copies, width, unit)
                held, size = [], 0
        if held:
            yield _runs_batch(held, k1, k2, copies, width, unit)


def _runs_batch(held: list[tuple], k1: np.ndarray, k2: np.ndarray, copies: np.ndarray, width: int, unit: Unit) -> pa.RecordBatch:
    rows, bodies, symbols, starts, stops = zip(*held, strict=True)
    text, begin, end, anchor, twin = runs_of(np.concatenate(symbols), np.array([len(x) for x in symbols]), width, unit.gram)
    each = np.searchsorted(text, np.arange(len(rows) + 1))
    digest, span = xxhash.xxh3_64_intdigest, []
    for n, body in enumerate(bodies):
        mine = slice(each[n], each[n + 1])
        span += [digest(body[a:b]) for a, b in zip(starts[n][begin[mine]].tolist(), stops[n][end[mine] + width - 2].tolist(), strict=True)]
    w = np.array(rows)[text]
    return pa.RecordBatch.from_arrays([pa.array(k1[w]), pa.array(k2[w]), pa.array(begin), pa.array(end), _signed(anchor), _signed(np.array(span, np.uint64)), pa.array(copies[w]), pa.array(twin)], names=_RUN)


def _halves(batches: Iterator[pa.RecordBatch], width: int, unit: Unit) -> Iterator[pa.RecordBatch]:
    """The halves of runs whose anchor lies once in their text, with longer anchors."""
    digest = lambda body, a, b, seed: xxhash.xxh3_64_intdigest(body[a:b], seed=seed)
    for batch in batches:
        for row in batch.to_pylist():
            body, symbols, starts, stops = laid_out(row["text"].encode(), unit)
            edges, _, places, size = anchor_runs(symbols, width, unit.gram)
            half = (width - size) // 2
            out = []
            for r in row["runs"]:
                b, e = r["begin"], r["end"]
                p = int(places[np.searchsorted(edges, b, side="right") - 1])
                mid = min(max(p - half + 1, b), e)
                for seed, a, z, low, high in ((1, b, mid, p - half, p + size), (2, mid, e, p, p + size + half)):
                    if a < z:
                        out.append((row["k1"], row["k2"], a, z, digest(body, starts[low], stops[high - 1], seed), digest(body, starts[a], stops[z + width - 2], 0), r["copies"], False, low))
            cols = list(zip(*out, strict=True))
            arrays = [_signed(np.array(c, np.uint64)) if k in (4, 5) else pa.array(c, pa.bool_() if k == 7 else pa.int64()) for k, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays(arrays, names=_HALF)


def _long(width: int, unit: Unit) -> int:
    """Units of a half's anchor."""
    size = min(1 << len(_MIX), 1 << (min(unit.gram, width).bit_length() - 1))
    return size + (width - size) // 2


def _of_runs(row: dict, width: int, unit: Unit, hot: bool) -> Iterator[tuple]:
    body, _, starts, stops = laid_out(row["text"].encode(), unit)
    long = _long(width, unit)
    for r in row["runs"]:
        head = (row["k1"], row["k2"], r["begin"], r["anchor"], r["copies"] == 1)
        if not hot:
            a, z, low = r["begin"], r["end"] + width - 1, r["low"]
            if low is None:
                yield *head, body[starts[a] : stops[z - 1]], None, 0
                continue
            high = low + long
            check = xxhash.xxh3_64_intdigest(body[starts[low] : stops[high - 1]], seed=3) - (1 << 63)
            yield *head, body[starts[a] : stops[low - 1]] if a < low else b"", body[starts[high] : stops[z - 1]] if high < z else b"", check
            continue
        for s in range(r["begin"], r["end"]):
            d = xxhash.xxh3_128_digest(body[starts[s] : stops[s + width - 1]])
            yield *head[:2], s, *head[3:], int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _spans(batches: Iterator[pa.RecordBatch], width: int, unit: Unit, hot: bool) -> Iterator[pa.RecordBatch]:
    """The bytes of runs (of halves, those before and after the anchor, and its second hash), or, hot, the names of their strings."""
    names = ["k1", "k2", "begin", "anchor", "single"] + (["w1", "w2"] if hot else ["bytes", "after", "check"])
    for batch in batches:
        for row in batch.to_pylist():
            out = _of_runs(row, width, unit, hot)
            while part := list(islice(out, 2000)):  # the names of a long run are many times its bytes
                cols = list(zip(*part, strict=True))
                kinds = [pa.int64()] * 4 + [pa.bool_()] + ([pa.int64()] * 2 if hot else [pa.binary(), pa.binary(), pa.int64()])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _sorted_pieces(batches: Iterator[pa.RecordBatch], width: int, unit: Unit, piece: int) -> Iterator[pa.RecordBatch]:
    """Repeated strings of spans that come sorted by anchor, as ranges of starts; anchors are never divided."""
    per_unit = 6 if unit.words else 1  # bytes, about

    def ranges(held: list[tuple], halves: bool) -> Iterator[pa.RecordBatch]:
        spans = [h[5] for h in held]
        marked = repeated(spans, width - _long(width, unit) + 1, unit, [(h[3], h[7]) for h in held], [h[6] for h in held]) if halves else repeated(spans, width, unit)
        out = []
        for (k1, k2, begin, _, single, *_), found in zip(held, marked, strict=True):
            if single and found.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], found.view(np.int8), [0]])))
                out += [(k1, k2, begin + a, begin + b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["k1", "k2", "begin", "end"])

    held: dict[bool, list[tuple]] = {True: [], False: []}  # halves, others: an anchor's spans are all of one kind
    size = {True: 0, False: 0}
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for _, group in groupby(rows, key=lambda row: row[3]):
        some = list(group)  # of at most HOT rows and `most` units
        kind = some[0][6] is not None
        if size[kind] >= piece * per_unit:
            yield from ranges(held[kind], kind)
            held[kind], size[kind] = [], 0
        held[kind] += some
        size[kind] += sum(len(row[5]) + len(row[6] or b"") for row in some)
    for kind, some in held.items():
        if some:
            yield from ranges(some, kind)


def covered(ranges: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """Maximal runs of units under the strings that start in [begin, end) of the ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        b += width - 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _in_bytes(raw: bytes, gone: list[tuple[int, int]], unit: Unit) -> list[tuple[int, int]]:
    """Byte ranges of ranges of units; a word takes the white space after it along."""
    if not unit.words or not gone:
        return gone
    starts = [m.start() for m in (_WORD if _LATE.search(raw) else re.compile(rb"\S+")).finditer(raw)] + [len(raw)]
    return [(starts[a], starts[b]) for a, b in gone]


CUT = "k1 bigint, k2 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, n_passages bigint, passage_bytes bigint"


def _cut(batches: Iterator[pa.RecordBatch], width: int, unit: Unit, words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            kept, numbers = [], []
            for raw, ranges, passages in zip(_bytes(part.column(2)), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                gone = _in_bytes(raw, covered([(r["begin"], r["end"]) for r in ranges or []], width), unit)
                marked = _in_bytes(raw, covered([(r["begin"], r["end"]) for r in passages or []], words), WORDS)
                edges = [0, *(x for span in gone for x in span), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if gone else raw)
                numbers.append((len(raw), len(raw) - len(kept[-1]), len(gone), len(marked), sum(b - a for a, b in marked)))
            n = [pa.array(c, pa.int64()) for c in zip(*numbers, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *n[:3], pa.array(kept, pa.binary()), *n[3:]], names=[c.split()[0] for c in CUT.split(", ")])


def keys_of(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text: its key."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text, F.lit(2)).alias("k2")]


def _distinct_texts(df: DataFrame, text_col: str) -> DataFrame:
    """(k1, k2, text, copies), kept in the shared folder in buckets of both keys."""
    spark = df.sparkSession
    text = text_of(text_col)
    rows = df.select(text.alias("text"), *keys_of(text)).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    name = f"distinct_texts_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, "k1", "k2").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    to_discard(path, name)
    return spark.table(name)


def _candidates(runs: DataFrame) -> DataFrame:
    """The runs whose anchor occurs again, in place of the kept table `runs`: anchors are counted before runs are moved by them."""
    often = runs.groupBy("anchor").agg(F.sum("copies").alias("n"), F.max("twin").alias("twin")).where("n > 1 or twin").select("anchor")
    return replaced(runs, salted_join(runs, often, "anchor", "k1").select(*runs.columns))


def _sizes(classes: DataFrame, width: int, hot: int, most: int) -> DataFrame:
    """For each anchor the number of its classes, whether it lies twice in a text, and whether classes or units are too many for one task."""
    kinds, size = F.count(F.lit(1)), F.sum(F.col("one.end") - F.col("one.begin") + width - 1)
    return classes.groupBy("anchor").agg(kinds.alias("kinds"), F.max("twin").alias("twins"), ((kinds > hot) | (size > most)).alias("hot"))


def _place(runs: DataFrame) -> list[str]:
    return [c for c in ("k1", "k2", "begin", "end", "low") if c in runs.columns]


def _classes(runs: DataFrame, width: int, hot: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The runs in classes of equal spans, as ranges; and the runs that stand for classes which may share a part of their strings."""
    classes = runs.groupBy("anchor", "span").agg(F.sum("copies").alias("n"), F.max("twin").alias("twin"), F.min(F.struct(*_place(runs))).alias("one"))
    classes = cut_lineage(classes.join(_sizes(classes, width, hot, most).hint("merge"), "anchor").where("n > 1 or kinds > 1 or twin"))
    alike = runs.join(classes.where("n > 1").select("anchor", "span").hint("merge"), ["anchor", "span"]).select("k1", "k2", "begin", "end")
    stand = classes.where("kinds > 1 or (n = 1 and twin)").select("one.*", "anchor", "span", F.least("n", F.lit(2)).alias("copies"), "twin", "twins", "hot")
    return alike, stand


def _beside(texts: DataFrame, runs: DataFrame, *by: str) -> DataFrame:
    """Texts with their runs as an array; texts stay in their buckets."""
    wanted = runs.groupBy("k1", "k2", *by).agg(F.collect_list(F.struct(*_place(runs)[2:], "anchor", "copies")).alias("runs"))
    return texts.select("k1", "k2", "text").join(wanted.hint("merge"), ["k1", "k2"]).select("k1", "k2", "text", "runs", *by)


def repeats(texts: DataFrame, width: int, unit: Unit, hot: int = HOT, piece: int | None = None, most: int | None = None) -> DataFrame:
    """(k1, k2, begin, end): ranges of units at which strings start that also start elsewhere in `texts` (k1, k2, text, copies)."""
    most = unit.most if most is None else most
    runs = _candidates(kept_table(texts.select("k1", "k2", "text", "copies").mapInArrow(lambda it: _runs(it, width, unit), RUN)))
    alike, stand = _classes(runs, width, hot, most)
    halves = _beside(texts, stand.where("not twins")).mapInArrow(lambda it: _halves(it, width, unit), HALF)
    halves = kept_table(halves.unionByName(stand.where("twins").select(*_RUN), allowMissingColumns=True))
    again, rest = _classes(halves, width, hot, most)

    read = _beside(texts, rest.withColumn("low", F.when(~F.col("twins"), F.col("low"))), "hot")
    head = "k1 bigint, k2 bigint, begin bigint, anchor bigint, single boolean"
    spans = read.where("not hot").drop("hot").mapInArrow(lambda it: _spans(it, width, unit, False), f"{head}, bytes binary, after binary, check bigint")
    sorted_ = spans.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda it: _sorted_pieces(it, width, unit, piece or unit.piece), "k1 bigint, k2 bigint, begin bigint, end bigint")
    named = read.where("hot").drop("hot").mapInArrow(lambda it: _spans(it, width, unit, True), f"{head}, w1 bigint, w2 bigint")
    twice = named.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hot_ = salted_join(named.where("single"), twice, ["w1", "w2"], "k1").select("k1", "k2", "begin", (F.col("begin") + 1).alias("end"))
    return kept_table(alike.unionByName(again).unionByName(sorted_).unionByName(hot_))


def remove_repeats(df: DataFrame, text_col: str = "text", width: int = WIDTH, unit: Unit = BYTES, passages: int = 0, hot: int = HOT, piece: int | None = None, most: int | None = None) -> DataFrame:
    """(k1, k2, n_bytes, n_removed, n_spans, kept, n_passages, passage_bytes) for each distinct text of `df`; `keys_of` gives a row's key.

    With `passages`, strings of so many words that repeat are counted too (the last two columns), but not removed.
    """
    texts = _distinct_texts(df, text_col)
    release(df.sparkSession)  # the shuffle of the texts
    ranges = repeats(texts, width, unit, hot, piece, most).withColumn("passage", F.lit(False))
    release(df.sparkSession)
    if passages:
        ranges = ranges.unionByName(repeats(texts, passages, WORDS, hot, piece).withColumn("passage", F.lit(True)))
    one = F.struct("begin", "end")
    lists = [F.collect_list(F.when(F.col("passage") == p, one)).alias(name) for p, name in ((False, "ranges"), (True, "marked"))]
    both = texts.select("k1", "k2", "text").join(ranges.groupBy("k1", "k2").agg(*lists).hint("merge"), ["k1", "k2"], "left").select("k1", "k2", "text", "ranges", "marked")
    return both.mapInArrow(lambda it: _cut(it, width, unit, passages), CUT)


def without_repeats(docs: DataFrame, text_col: str = "text", width: int = WIDTH, unit: Unit = BYTES) -> DataFrame:
    """`docs` with every text replaced by what is left of it; of cut characters nothing is left."""
    names = docs.columns
    a1, a2, b1, b2, left = unused(names, 5)
    cut = remove_repeats(docs, text_col, width, unit).where("n_removed > 0").select(F.col("k1").alias(b1), F.col("k2").alias(b2), F.col("kept").alias(left))
    k1, k2 = keys_of(text_of(text_col))
    rows = docs.withColumns({a1: k1, a2: k2}).join(cut.hint("merge"), (F.col(a1) == F.col(b1)) & (F.col(a2) == F.col(b2)), "left")
    valid = F.col(left).cast("string")
    if not unit.words:
        valid = F.replace(F.make_valid_utf8(valid), F.lit("\ufffd"), F.lit(""))
    return rows.withColumn(text_col, F.when(F.col(left).isNull(), text_of(text_col)).otherwise(valid)).select(*names)
