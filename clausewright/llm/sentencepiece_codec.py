"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A batch of texts is one array of characters. It is cut into words wherever two characters meet that no piece holds side
by side (so before every space, too); words are told apart by two 64-bit hashes, and the ids of known words are kept in
one pool. New words are grouped by length and a group's words advance together: at each end position the hash of every
substring that ends there is probed in the sorted hashes of the pieces, and a vectorised maximum keeps the best
predecessor of every word. For unigram models the maximum is that of summed scores. In models built by
merges a piece may follow another only if merging their joined text gives just those two again; with that rule every
prefix has one admissible last piece, so the same search gives exactly what the merges would (the rule's
answers are kept in a table of fixed size). Words over LONGEST characters, and words that begin with several
spaces (whose pieces share one score), are merged one by one.

Unknown characters become byte pieces where the model has them. Normalisation is that of the identity: a
space before the text, spaces written as U+2581.

Defined cases: null and empty texts have no ids and decode to the empty text; a null id stays null; repeated rows
stay; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, texts

SPACE = "▁"
LONGEST = 40
WORDS_KEPT = 1_000_000
PAIR_BITS = 21
PAIRS = 1 << PAIR_BITS
SLICE = 500
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)  # moves what short pieces differ in to the upper bits
_SECOND = np.uint64(0xBF58476D1CE4E5B9)
_NEAR = 512  # character codes below this have a table of pairs


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(self.n)]
        self.scores = np.array([sp.get_score(i) for i in range(self.n)])
        plain = [i for i in range(self.n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id_of = {self.pieces[i]: i for i in plain}
        self.unknown = sp.unk_id()
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(self.n) if sp.is_byte(i)}
        whole = self.scores[plain]
        self.merges = bool((whole == np.rint(whole)).all())
        self.longest = max(map(len, self.id_of))
        self.powers = np.array([1] + [0] * self.longest, np.uint64)
        for k in range(self.longest):
            self.powers[k + 1 : k + 2] = self.powers[k : k + 1] * _BASE
        keys = np.array([self._hash(self.pieces[i]) for i in plain], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(plain)[order]
        self._directory()
        assert len(np.unique(keys)) == len(keys), "two pieces share a hash"
        self.codes = np.zeros((self.n, self.longest), np.uint32)
        for i in plain:
            self.codes[i, : len(self.pieces[i])] = [ord(c) for c in self.pieces[i]]
        self.pair_keys, self.pair_ok = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        pairs = {(ord(p[k]), ord(p[k + 1])) for p in self.id_of for k in range(len(p) - 1)}
        self.pairs = np.sort(np.array([a << 21 | b for a, b in pairs], np.int64))
        self.near = np.zeros((_NEAR + 1, _NEAR + 1), bool)
        small = [(_NEAR if a == ord(SPACE) else a, _NEAR if b == ord(SPACE) else b) for a, b in pairs]
        for a, b in small:
            if a <= _NEAR and b <= _NEAR:
                self.near[a, b] = True
        self._forget()
        self.bytes_of = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for value, i in self.byte.items():
            self.bytes_of[i] = bytes([value])
        for i in range(self.n):
            if sp.is_control(i):
                self.bytes_of[i] = b""
            elif sp.is_unknown(i):
                self.bytes_of[i] = " ⁇ ".encode()
        self.byte_sizes = np.array(list(map(len, self.bytes_of)))
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.byte_pool = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def _directory(self) -> None:
        """Where in the sorted keys those with given upper bits begin, and how many share them at most."""
        tops = np.arange((1 << 20) + 1, dtype=np.uint64)
        self.first = np.append(np.searchsorted(self.keys, tops[:-1] << np.uint64(44)), len(self.keys)).astype(np.int32)
        self.most = int(np.diff(self.first).max())

    @functools.cached_property
    def whole(self) -> np.ndarray:
        """Pieces that merging their own text gives back."""
        found = np.zeros(self.n, bool)
        found[[i for p, i in self.id_of.items() if not self.merges or self.merged(p) == [i]]] = True
        return found

    def _hash(self, piece: str) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                h = h * _BASE + np.uint64(ord(c) + 1)
            return h * _SPREAD

    def merged(self, text: str) -> list[int]:
        """Ids by merging the best-scored adjacent pair, leftmost first; unknown characters are n + code."""
        parts = list(text)
        if len(parts) > 200:
            return self._merged_long(parts)
        get, scores = self.id_of.get, self.scores
        rank = [get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = -np.inf, -1
            for k, r in enumerate(rank):
                if r is not None and scores[r] > best:
                    best, at = scores[r], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del rank[at]
            if at < len(rank):
                rank[at] = get(parts[at] + parts[at + 1])
            if at:
                rank[at - 1] = get(parts[at - 1] + parts[at])
        return [get(p, self.n + ord(p[0])) for p in parts]

    def _merged_long(self, parts: list[str]) -> list[int]:
        """The same with a heap, for very long words."""
        import heapq

        get, n = self.id_of.get, len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            if a >= 0 and (b := right[a]) >= 0 and (i := get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, parts[a] + parts[b]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, a, joined = heapq.heappop(heap)
            b = right[a]
            if not parts[a] or b < 0 or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b] = joined, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a])
            offer(a)
        return [get(p, self.n + ord(p[0])) for p in parts if p]

    def _may_follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        ok = (before >= self.n) | (piece >= self.n)  # nothing merges with an unknown character
        if not self.merges:
            return np.ones_like(ok)
        need = np.flatnonzero(~ok)
        keys = before[need] * self.n + piece[need]
        slot = ((keys.astype(np.uint64) * _BASE) >> np.uint64(64 - PAIR_BITS)).astype(np.intp)
        found = self.pair_ok[slot]
        fresh = np.flatnonzero(self.pair_keys[slot] != keys)
        if len(fresh):  # each slot keeps the pair that was asked for last
            kinds, which = np.unique(keys[fresh], return_inverse=True)
            answers = np.array([self.merged(self.pieces[a] + self.pieces[b]) == [a, b] for a, b in (divmod(k, self.n) for k in kinds.tolist())])
            found[fresh] = answers[which]
            self.pair_keys[slot[fresh]], self.pair_ok[slot[fresh]] = keys[fresh], answers[which]
        ok[need] = found
        return ok

    def viterbi(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, given as rows of character codes: all ids in a row, and how many each word has."""
        n, size = code.shape
        prefix = np.zeros((n, size + 1), np.uint64)
        for k in range(size):
            prefix[:, k + 1] = prefix[:, k] * _BASE + code[:, k] + np.uint64(1)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        last = np.zeros((n, size + 1), np.int64)
        width = np.ones((n, size + 1), np.int64)
        lowest = self.scores.min() - 10
        for end in range(1, size + 1):
            for k in range(1, min(end, self.longest) + 1):
                start = end - k
                key = prefix[:, end] - prefix[:, start] * self.powers[k]
                key *= _SPREAD
                top = (key >> np.uint64(44)).astype(np.intp)
                at = self.first[top]
                rows = np.flatnonzero(at < self.first[top + 1])  # most substrings stop here
                key, at = key[rows], at[rows]
                for _ in range(self.most - 1):
                    at = np.minimum(at + (self.keys[at] < key), len(self.keys) - 1)
                piece = self.key_ids[at]
                same = self.keys[at] == key
                same &= (self.codes[piece, :k] == code[rows, start:end]).all(axis=1)
                rows, piece = rows[same], piece[same]
                score = self.scores[piece]
                if k == 1:
                    others = np.setdiff1d(np.arange(n), rows, assume_unique=True)
                    rows, piece = np.concatenate([rows, others]), np.concatenate([piece, self.n + code[others, start].astype(np.int64)])
                    score = np.concatenate([score, np.full(len(others), lowest)])
                if not len(rows):
                    continue
                ok = (piece >= self.n) | self.whole[np.minimum(piece, self.n - 1)]
                if start and self.merges:
                    some = np.flatnonzero(ok)
                    ok[some] = self._may_follow(last[rows[some], start], piece[some])
                value = np.where(ok, best[rows, start] + (0 if self.merges else score), -np.inf)
                better = value > best[rows, end]
                r = rows[better]
                best[r, end], last[r, end], width[r, end] = value[better], piece[better], k
        path = np.full((n, size), -1, np.int64)
        at, steps = np.full(n, size), np.zeros(n, np.int64)
        open_ = np.arange(n)
        while len(open_):
            steps[open_] += 1
            path[open_, size - steps[open_]] = last[open_, at[open_]]
            at[open_] -= width[open_, at[open_]]
            open_ = open_[at[open_] > 0]
        return self._spelled(path[path >= 0], steps)

    def _spelled(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters as byte pieces."""
        strange = np.flatnonzero(ids >= self.n)
        if not len(strange):
            return ids.astype(np.int32), counts
        spelled = [[self.byte.get(b, self.unknown) for b in chr(i - self.n).encode("utf-8", "replace")] if self.byte else [self.unknown] for i in ids[strange].tolist()]
        sizes = np.ones(len(ids), np.int64)
        sizes[strange] = list(map(len, spelled))
        out = np.repeat(ids, sizes)
        starts = np.cumsum(sizes) - sizes
        for at, piece in zip(starts[strange].tolist(), spelled, strict=True):
            out[at : at + len(piece)] = piece
        return out.astype(np.int32), np.add.reduceat(sizes, np.cumsum(counts) - counts)

    def _forget(self) -> None:
        self.known, self.check = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.at, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, np.int32)

    def _cuts(self, code: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where words begin; texts begin at `starts`."""
        left, right = code[:-1], code[1:]
        space = ord(SPACE)
        a = np.where(left == space, _NEAR, np.minimum(left, _NEAR + 1))
        b = np.where(right == space, _NEAR, np.minimum(right, _NEAR + 1))
        joined = np.zeros(len(left), bool)
        small = (a <= _NEAR) & (b <= _NEAR) & ((left < _NEAR) | (left == space)) & ((right < _NEAR) | (right == space))
        joined[small] = self.near[a[small], b[small]]
        rest = np.flatnonzero(~small)
        if len(rest):
            keys = (left[rest].astype(np.int64) << 21) | right[rest]
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            joined[rest] = self.pairs[at] == keys
        first = np.append(True, ~joined)
        first[starts] = True
        return np.flatnonzero(first)

    def _learn(self, code: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> None:
        """Put the ids of new words into the pool."""
        if len(self.known) + len(keys) > WORDS_KEPT:
            self._forget()
        flat, places, counts = [], [], []
        spaces = (sizes > 1) & (code[starts] == ord(SPACE)) & (code[np.minimum(starts + 1, len(code) - 1)] == ord(SPACE))
        alone = self.merges & ((sizes > LONGEST) | spaces)
        for k in np.flatnonzero(alone).tolist():
            word = code[starts[k] : starts[k] + sizes[k]].tobytes().decode("utf-32-le", "surrogatepass")
            ids, count = self._spelled_one(self.merged(word))
            flat.append(ids)
            places.append([k])
            counts.append(count)
        for size in np.unique(sizes[~alone]).tolist():
            rows = np.flatnonzero((sizes == size) & ~alone)
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                ids, count = self.viterbi(code[starts[part][:, None] + np.arange(size)])
                flat.append(ids)
                places.append(part)
                counts.append(count)
        places, counts = np.concatenate(places), np.concatenate(counts)
        at = len(self.pool) + np.cumsum(counts) - counts
        self.pool = np.concatenate([self.pool, *flat])
        every = np.concatenate([self.known, keys[places]])
        order = np.argsort(every)
        self.known, self.check = every[order], np.concatenate([self.check, checks[places]])[order]
        self.at, self.count = np.concatenate([self.at, at])[order], np.concatenate([self.count, counts])[order]

    def _spelled_one(self, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        return self._spelled(np.array(ids, np.int64), np.array([len(ids)]))

    def encode_arrays(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's begin (and, last, end)."""
        spaced = [SPACE + t.replace(" ", SPACE) if t else "" for t in batch]
        code = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.cumsum([0, *map(len, spaced)])
        if not len(code):
            return np.empty(0, np.int32), np.zeros(len(batch) + 1, np.int64)
        starts = self._cuts(code, edges[:-1][np.diff(edges) > 0])
        ends = np.append(starts[1:], len(code))
        value = code.astype(np.uint64) + np.uint64(1)
        keys, checks = (self._word_hashes(value, starts, ends, base) for base in (_BASE, _SECOND))
        distinct, one, which = np.unique(keys, return_index=True, return_inverse=True)
        slot = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        here = (self.known[slot] == distinct) & (self.check[slot] == checks[one]) if len(self.known) else np.zeros(len(distinct), bool)
        if not here.all():
            before = len(self.known)
            fresh = one[~here]
            if before + len(fresh) > WORDS_KEPT:
                fresh = one  # the table starts anew
            self._learn(code, starts[fresh], (ends - starts)[fresh], keys[fresh], checks[fresh])
            slot = np.searchsorted(self.known, distinct)
        at, count = self.at[slot][which], self.count[slot][which]
        total = np.cumsum(count)
        ids = self.pool[np.repeat(at - (total - count), count) + np.arange(total[-1])]
        sums = np.append(0, total)
        return ids, sums[np.searchsorted(starts, edges)]

    @staticmethod
    def _word_hashes(value: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
        up, down = _powers(len(value), int(base)), _powers(len(value), pow(int(base), -1, 1 << 64))
        sums = np.append(np.uint64(0), np.cumsum(value * up))
        h = (sums[ends] - sums[starts]) * down[starts]
        return (h ^ (h >> np.uint64(29))) * _SPREAD + (ends - starts).astype(np.uint64)

    def encode(self, batch: list[str]) -> list[list[int]]:
        ids, edges = self.encode_arrays(batch)
        flat = ids.tolist()
        return [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def decode_arrays(self, ids: np.ndarray, edges: np.ndarray) -> list[str]:
        """The texts of ids in a row."""
        sizes = self.byte_sizes[ids]
        total = np.cumsum(sizes)
        data = self.byte_pool[np.repeat(self.byte_starts[ids] - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)].tobytes()
        at = np.append(0, total)[edges].tolist()
        return [(data[a + 1 : b] if data[a : a + 1] == b" " else data[a:b]).decode("utf-8", "replace") for a, b in zip(at, at[1:])]

    def decode(self, ids: list[int]) -> str:
        return self.decode_arrays(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """The first n powers; the longest row asked for so far is kept."""
    if len(_POWERS.get(base, ())) < n:
        x = np.full(1 << max(21, (n - 1).bit_length()), base, np.uint64)
        x[0] = 1
        _POWERS[base] = np.multiply.accumulate(x)
    return _POWERS[base][:n]


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """(id, ids) of every row, with `check` also the text that the ids decode to, and whether it is the row's own; no shuffle.

    Checking in the same pass keeps one worker a task and sends no text back twice.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                own = texts(part.column(1))
                ids, edges = c.encode_arrays(own)
                out = [part.column(0), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))]
                if check:
                    back = c.decode_arrays(ids, edges)
                    out += [pa.array(back, pa.string()), pa.array([a == b for a, b in zip(own, back, strict=True)])]
                yield pa.RecordBatch.from_arrays(out, names=["id", "ids", "decoded", "same"][: len(out)])

    schema = "id bigint, ids array<int>" + (", decoded string, same boolean" if check else "")
    return df.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text")).mapInArrow(rows, schema)


def decode(df: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`df` with the text of its ids in `out_col`."""
    names = [c for c in df.columns if c != out_col]
    schema = df.select(*names).schema.add(out_col, "string")
    place = names.index(ids_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = [c.decode(ids.values.to_pylist()) if ids.is_valid else None for ids in part.column(place)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*names, out_col])

    return df.select(*names).mapInArrow(rows, schema)
