"""Order-preserving packing of token streams into windows, by dynamic programming.

The ids of the documents of an input partition form one stream in row order. Its candidate cuts are the ends
of documents and of sentences, and, inside sentences longer than GRID tokens, every GRID tokens. The cost of a
window is its padding (none at a power of two) plus OPEN; the cost of a cut is 0 at the end of a
document, SENTENCE at that of a sentence and INSIDE elsewhere. With pad = W - (p_j - p_i)

    f[j] = cut[j] + OPEN + W - p_j + min over p_i >= p_j - W of (f[i] + p_i)

which a monotone queue answers in constant amortised time; lengths that are powers of two add eleven
direct transitions. The plan is made for a block of tokens at a time, and the last window of a block goes
on into the next, so memory is bounded by BLOCK and the longest document.

Defined cases: a null or empty text has the end id alone; documents longer than the window go over several
windows; a null id stays null; repeated rows are packed each; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, texts

WINDOW = 1024
BLOCK = 1_000_000
GRID = 32
OPEN, SENTENCE, INSIDE = 16, 1, 6
SEQUENCES_A_TASK = 1 << 36

SCHEMA = "id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens int, cut string"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


class Encoder:
    """Ids of texts by a `tokenizers` file.

    Texts without special tokens' strings go through the same vocabulary as byte ranks, which is
    several times as fast and gives the same ids; the others through `tokenizers` itself.
    """

    def __init__(self, path: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        pieces = {i: t for t, i in self.exact.get_vocab().items()}
        text = [pieces.get(i, "") for i in range(max(pieces) + 1)]
        space, line = "Ġ", "Ċ"  # a space and a line feed in byte-level vocabularies
        self.stops = np.array([t.rstrip("\"')").endswith((".", "!", "?")) or line in t for t in text])
        self.opens = np.array([t.startswith((space, line)) for t in text])

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


@functools.cache
def encoder(path: str, ranks: str | None) -> Encoder:
    return Encoder(path, ranks)


def plan_cuts(pos: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> list[int]:
    """Indexes into `pos` (0 first, the stream's end last) where windows end, at the least total cost."""
    n = len(pos)
    jumps: dict[int, list[int]] = {}
    size = 1
    while size <= window:
        at = np.searchsorted(pos, pos - size)
        for j in np.flatnonzero((pos >= size) & (pos[np.minimum(at, n - 1)] == pos - size)).tolist():
            jumps.setdefault(j, []).append(int(at[j]))
        size *= 2
    p, c = pos.tolist(), cost.tolist()
    total, back, key = [0] * n, [0] * n, [0] * n
    queue, head = [0], 0
    for j in range(1, n):
        pj = p[j]
        low = pj - window
        while p[queue[head]] < low:
            head += 1
        came = queue[head]
        best = key[came] + window - pj
        if j in jumps:
            for i in jumps[j]:
                if total[i] < best:
                    best, came = total[i], i
        best += c[j] + OPEN
        total[j], back[j] = best, came
        key[j] = k = best + pj
        while len(queue) > head and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    ends, j = [], n - 1
    while j:
        ends.append(j)
        j = back[j]
    return ends[::-1]


def candidates(stream: np.ndarray, doc_ends: np.ndarray, enc: Encoder, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cut positions of a stream with 0 and the end, and each one's cost."""
    n = len(stream)
    inside = np.flatnonzero(enc.stops[stream[:-1]] & enc.opens[stream[1:]]) + 1
    pos = np.union1d(np.concatenate([[0, n], doc_ends]), inside)
    gaps = np.diff(pos)
    grid = min(GRID, window)
    long = np.flatnonzero(gaps > grid)
    if len(long):
        count = (gaps[long] - 1) // grid
        base = np.repeat(pos[long], count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
        added = base + step * grid
    else:
        added = np.empty(0, np.int64)
    every = np.union1d(pos, added)
    cost = np.full(len(every), INSIDE)
    cost[np.searchsorted(every, pos)] = SENTENCE
    cost[np.searchsorted(every, doc_ends)] = 0
    cost[[0, -1]] = 0
    return every, cost


def _pack(batches: Iterator[pa.RecordBatch], path: str, ranks: str | None, end_id: int, window: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path, ranks)
    sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) * SEQUENCES_A_TASK
    held: list[tuple[int | None, int, int, np.ndarray]] = []  # id, ids before, ids in the document, ids
    size = 0

    def flush(last: bool) -> pa.RecordBatch | None:
        nonlocal held, size, sequence
        stream = np.concatenate([h[3] for h in held])
        ends = np.cumsum([len(h[3]) for h in held])
        pos, cost = candidates(stream, ends, enc, window)
        cuts = pos[plan_cuts(pos, cost, window)]
        if not last:
            cuts = cuts[:-1]
        if not len(cuts):
            return None
        done = int(cuts[-1])
        bounds = np.union1d(cuts, ends[ends <= done])
        starts = np.concatenate([[0], bounds[:-1]])
        doc = np.searchsorted(ends, starts, side="right")
        seq = np.searchsorted(cuts, starts, side="right")
        seq_start = np.concatenate([[0], cuts])[seq]
        doc_start = np.concatenate([[0], ends])[doc]
        before = np.array([h[1] for h in held])[doc]
        kind = np.where(np.isin(bounds, ends), "document", np.where(enc.stops[stream[bounds - 1]], "sentence", "inside"))
        data = stream[:done].astype("<u4").tobytes()
        offsets = np.concatenate([[0], bounds * 4]).astype(np.int32)
        ids = pa.Array.from_buffers(pa.binary(), len(bounds), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([held[d][0] for d in doc.tolist()], pa.int64()),
                pa.array(before + starts - doc_start, pa.int64()),
                pa.array(bounds - starts, pa.int64()),
                ids,
                pa.array(np.array([h[2] for h in held])[doc], pa.int64()),
                pa.array(sequence + seq, pa.int64()),
                pa.array(starts - seq_start, pa.int64()),
                pa.array(cuts[seq] - seq_start, pa.int32()),
                pa.array(kind.tolist(), pa.string()),
            ],
            names=NAMES,
        )
        sequence += len(cuts)
        first = int(np.searchsorted(ends, done, side="right"))
        rest = held[first:]
        if rest and (used := done - (int(ends[first - 1]) if first else 0)):
            i, b, t, x = rest[0]
            rest[0] = (i, b + used, t, x[used:])
        held, size = rest, len(stream) - done
        return out

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            ids = np.append(enc(text), np.uint32(end_id))
            held.append((key, 0, len(ids), ids))
            size += len(ids)
            if size >= BLOCK and (out := flush(False)) is not None:
                yield out
    if held:
        yield flush(True)


def pack(df: DataFrame, tokenizer: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents with their ids (little-endian 32-bit), window and place in it; no shuffle.

    Documents keep the order in which the input partition holds them, so a task packs what it reads.
    Each task numbers its windows from its partition's own range, so a task run again gives the same rows.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _pack(it, tokenizer, ranks, end_id, window), SCHEMA)
