"""Two-column pages: words to lines to clauses, and the pairing of both languages by position."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 3.5


def _merged(words: Iterable[tuple[float, float, str]]) -> list[str]:
    """Words (y, x0, word) of one side of a page, sorted, to lines: heights cluster around a running mean, words follow from left to right."""
    rows: list[list[tuple[float, str]]] = []
    mean = 0.0
    for y, x0, word in words:
        if rows and abs(y - mean) <= TOLERANCE:
            rows[-1].append((x0, word))
            mean += (y - mean) / (len(rows[-1]))
        else:
            rows.append([(x0, word)])
            mean = y
    out: list[str] = []
    for members in rows:
        text = " ".join(w for _, w in sorted(members))
        if out and (text[:1].islower() or out[-1].endswith("-")):
            out[-1] = out[-1][:-1] + text if out[-1].endswith("-") else f"{out[-1]} {text}"
        else:
            out.append(text)
    return out


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each side of a page (doc_id, page_no, side, y, x0, word: arrays in the words' order) to one with its lines."""
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(3, 6)]
        lines = [_merged(zip(*page, strict=True)) for page in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lines, pa.list_(pa.string()))], names=["doc_id", "page_no", "side", "lines"])


def column_lines(words: DataFrame) -> DataFrame:
    """(doc_id, page_no, side, line_no, text) from words (doc_id, page_no, word, x0, x1, y, width).

    A word belongs to the side of the page's middle on which its own middle lies. A page's words are few, so a side of a page is a row; many rows make a batch.
    """
    side = F.when((F.col("x0") + F.col("x1")) / 2 < F.col("width") / 2, "left").otherwise("right")
    word = F.struct(F.col("y").cast("double").alias("y"), F.col("x0").cast("double").alias("x0"), "word")
    pages = words.groupBy("doc_id", "page_no", side.alias("side")).agg(F.array_sort(F.collect_list(word)).alias("w"))
    pages = pages.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), "side", "w.y", "w.x0", "w.word")
    rows = pages.mapInArrow(_lines, "doc_id bigint, page_no int, side string, lines array<string>")
    return rows.select("doc_id", "page_no", "side", F.posexplode("lines").alias("line_no", "text"))


def paired_columns(lines: DataFrame, left_language: str = "en", right_language: str = "fr") -> DataFrame:
    """Lines of both sides with deterministic ids, each with the id of the line at the same place on the other side."""
    lang = F.when(F.col("side") == "left", left_language).otherwise(right_language)
    name = lambda code: F.concat(F.col("doc_id").cast("string"), F.lit("_p"), F.lpad(F.col("page_no").cast("string"), 3, "0"), F.lit("_"), code, F.lit("_"), F.lpad(F.col("line_no").cast("string"), 3, "0"))
    rows = lines.withColumn("language", lang).withColumn("chunk_id", name(F.col("language")))
    place = Window.partitionBy("doc_id", "page_no", "line_no")  # a line of either side
    held = lambda code: F.max(F.when(F.col("language") == code, F.col("chunk_id"))).over(place)
    partner = F.when(F.col("language") == left_language, held(right_language)).otherwise(held(left_language))
    return rows.select("chunk_id", "doc_id", "page_no", "language", "text", partner.alias("partner_chunk_id"))


def spaced(words: Iterator[tuple[float, float, str]], gap: float = 1.5) -> str:
    """Words of a line joined, with a space only where the gap between them is wider than `gap`."""
    out, end = "", None
    for x0, x1, w in sorted(words):
        out += (" " if end is not None and x0 - end > gap else "") + w
        end = x1
    return out
