"""Clauses of documents: segmentation by headers, merging short ones, splitting long ones, and neighbours.

A document's lines stay in one array, so segmentation and packing are folds within a row and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_count
from ..sources.files import kept

#: How pages, dividers, articles and clauses are marked.
PAGE = r"(?i)page(?:[\s ]*[-_]+[\s ]*|[\s ]+)?(\d+)"
DIVIDER = r"(?i)^(?:PART|SECTION|SCHEDULE|APPENDIX|ANNEXE|PARTIE)[\s ]+[IVX\d]+"
ARTICLE = r"^(?:ARTICLE|Article)[\s ]+(\d{1,3})[\s .\-–—:]*([A-ZÀ-ÿ][^\n]*)?$"
CLAUSE = r"^(\d{1,3}(?:\.\d+)+(?:\([a-zA-Z0-9]+\))?)[\s .\-–—:]+(.+)?$"

#: The anchored variant's marks.
PAGE_MARK = r"^<<<PAGE:(\d+)>>>"
ANCHORED_ARTICLE = r"(?i)^ARTICLE\s+(\d{1,3})\b"
ANCHORED_CLAUSE = r"(?i)^(\d{1,3}(?:\.\d+)+(?:\([a-z]+\))?)\b"

_CLAUSE_TYPE = "struct<article:string,clause:string,title:string,page:int,text:string>"
_STATE = f"struct<article:string,clause:string,title:string,page:int,buffer:array<string>,out:array<{_CLAUSE_TYPE}>>"


def segment(text: Column) -> Column:
    """Array of clauses (article, clause, title, page, text).

    A clause keeps the article and clause number under which it began, and the title and page in force when it ends. A
    clause header opens one only if it extends the current article; lines with a page mark never do.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit("0").alias("article"), F.lit("0").alias("clause"), F.lit("PREAMBLE").alias("title"), F.lit(1).alias("page"), empty.alias("buffer"), F.array().cast(f"array<{_CLAUSE_TYPE}>").alias("out")).cast(_STATE)

    def flushed(acc: Column) -> Column:
        body = F.trim(F.regexp_replace(F.array_join(acc["buffer"], "\n"), PAGE, ""))
        body = F.regexp_replace(body, r"^\s+|\s+$", "")
        clause = F.struct(acc["article"].alias("article"), acc["clause"].alias("clause"), acc["title"].alias("title"), acc["page"].alias("page"), body.alias("text"))
        return F.when(body == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(clause)))

    def state(acc: Column, line: Column, **new: Column) -> Column:
        get = lambda k: new.get(k, acc[k]).alias(k)
        buffer = new.get("buffer", acc["buffer"])
        return F.struct(get("article"), get("clause"), get("title"), get("page"), F.concat(buffer, F.array(line)).alias("buffer"), get("out")).cast(_STATE)

    def step(acc: Column, line: Column) -> Column:
        bare = F.regexp_replace(line, r"^\s+|\s+$", "")
        article, title = F.regexp_extract(bare, ARTICLE, 1), F.trim(F.coalesce(F.regexp_extract(bare, ARTICLE, 2), F.lit("")))
        clause = F.regexp_extract(bare, CLAUSE, 1)
        number = F.regexp_replace(F.regexp_replace(clause, r"\(([^)]*)\)", ".$1"), r"^[ .]+|[ .]+$", "")
        return (
            F.when(bare == "", acc)
            .when(bare.rlike(PAGE), state(acc, line, page=F.coalesce(F.regexp_extract(bare, PAGE, 1).try_cast("int"), acc["page"])))
            .when(bare.rlike(DIVIDER), state(acc, line, title=bare))
            .when(article != "", state(acc, line, article=article, clause=article, title=F.when(title != "", title).otherwise(acc["title"]), buffer=empty, out=flushed(acc)))
            .when((clause != "") & clause.startswith(F.concat(acc["article"], F.lit("."))), state(acc, line, clause=number, buffer=empty, out=flushed(acc)))
            .otherwise(state(acc, line))
        )

    return F.aggregate(F.split(text, r"\r\n|\r|\n"), start, step, flushed)


def lines_of(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n, line): a text's lines, numbered."""
    return docs.select(doc, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("n", "line"))


def segmented(lines: DataFrame, doc: str = "doc_id", anchored: bool = False) -> DataFrame:
    """(doc, ord, article, clause, title, page, text): the clauses of documents given as lines (doc, n, line), in time linear in the lines.

    The rules are those of `segment`. Marks are found line by line; what is in force at a line is the last mark before it, clauses are
    numbered by a running count of the lines that open one, and one grouping joins their lines. `anchored` takes page marks
    of the form <<<PAGE:n>>> at the start of a line only, articles and clauses by their number alone, whatever follows; articles leave the title as it is, and
    blank lines stay in the text. A null line is blank.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    line = F.coalesce("line", F.lit(""))
    marks = lines.select(doc, "n", line.alias("line"), strip(line).alias("bare"))
    page_at, page = (F.col("line"), PAGE_MARK) if anchored else (F.col("bare"), PAGE)
    article, clause = (ANCHORED_ARTICLE, ANCHORED_CLAUSE) if anchored else (ARTICLE, CLAUSE)
    some = lambda c: F.when(c != "", c)
    kind = F.when(F.col("bare") == "", "blank").when(page_at.rlike(page), "page").when(F.col("bare").rlike(DIVIDER), "divider").when(F.col("bare").rlike(article), "article").when(F.col("bare").rlike(clause), "clause").otherwise("text")
    marks = marks.withColumn("kind", kind)
    is_ = lambda k: F.col("kind") == k
    number = F.regexp_extract("bare", clause, 1)
    named = F.lit(None).cast("string") if anchored else some(F.trim(F.regexp_extract("bare", ARTICLE, 2)))
    so_far = Window.partitionBy(doc).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    rows = marks.withColumns({
        "article": F.coalesce(last(F.when(is_("article"), F.regexp_extract("bare", article, 1))), F.lit("0")),
        "title": F.coalesce(last(F.when(is_("divider"), F.col("bare")).when(is_("article"), named)), F.lit("PREAMBLE")),
        "page": F.coalesce(last(F.when(is_("page"), F.regexp_extract(page_at, page, 1).try_cast("int"))), F.lit(1)),
    })
    extends = is_("clause") & F.startswith(number, F.concat("article", F.lit(".")))
    dotted = F.regexp_replace(F.regexp_replace(number, r"\(([^)]*)\)", ".$1"), r"^[ .]+|[ .]+$", "")
    rows = rows.withColumn("opens", is_("article") | extends)
    rows = rows.withColumns({"part": F.sum(F.col("opens").cast("int")).over(so_far), "clause": F.coalesce(last(F.when(is_("article"), F.col("article")).when(F.col("opens"), dotted)), F.lit("0"))})
    kept = F.collect_list(F.when(F.lit(anchored) | ~is_("blank"), F.struct("n", "line")))  # of one clause
    at_end = [F.max_by(c, "n").alias(c) for c in ("article", "clause", "title", "page")]
    whole = rows.groupBy(doc, "part").agg(F.array_sort(kept).alias("x"), *at_end)
    text = strip(F.regexp_replace(F.array_join(F.transform("x", lambda v: v["line"]), "\n"), PAGE_MARK.removeprefix("^") if anchored else PAGE, ""))
    whole = whole.withColumn("text", text).where("text <> ''")
    order = F.row_number().over(Window.partitionBy(doc).orderBy("part")) - 1
    return whole.select(doc, order.alias("ord"), "article", "clause", "title", "page", "text")


def merge_short(clauses: DataFrame, doc: str = "doc_id", place: str = "ord", least: int = 30) -> DataFrame:
    """Short clauses go to the next long one, the last short ones to the last long one; documents of short ones only vanish.

    Number and title are the long clause's; the page is that of the first short one before it.
    """
    long = (F.col("tokens") >= least).cast("int")
    w = Window.partitionBy(doc).orderBy(place)
    rows = clauses.withColumn("_long", long)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_long").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_all", F.sum("_long").over(Window.partitionBy(doc))).where("_all > 0")
    rows = rows.withColumn("gid", F.least("_before", F.col("_all") - 1))
    own = F.when(F.col("_long") == 1, F.struct(place, "clause", "page"))
    early = F.when((F.col("_long") == 0) & (F.col("_before") < F.col("_all")), F.struct(place, "page"))
    merged = rows.groupBy(doc, "gid").agg(F.array_sort(F.collect_list(F.struct(place, "text"))).alias("t"), F.min(own).alias("own"), F.min(early).alias("early"))
    return merged.select(doc, "gid", F.col("own.clause").alias("clause"), F.coalesce("early.page", "own.page").alias("page"), F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


def split_long(text: Column, most: int = 512) -> Column:
    """Parts of whole sentences with at most `most` tokens; a longer sentence stays whole."""
    sentences = F.split(text, r"(?<=[.!?])\s+(?=[A-ZÀ-ÿ])")
    state = "struct<n:int,cur:string,out:array<string>>"
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("cur"), F.array().cast("array<string>").alias("out")).cast(state)

    def step(acc: Column, s: Column) -> Column:
        n = token_count(s)
        full = (acc["n"] > 0) & (acc["n"] + n > most)
        fresh = F.struct(n.alias("n"), s.alias("cur"), F.concat(acc["out"], F.array(acc["cur"])).alias("out")).cast(state)
        more = F.struct((acc["n"] + n).alias("n"), F.when(acc["cur"] == "", s).otherwise(F.concat_ws(" ", acc["cur"], s)).alias("cur"), acc["out"].alias("out")).cast(state)
        return F.when(full, fresh).otherwise(more)

    packed = F.aggregate(sentences, start, step, lambda acc: F.concat(acc["out"], F.array(acc["cur"])))
    return F.when(token_count(text) <= most, F.array(text)).otherwise(packed)


def part_ids(clause: Column, parts: Column) -> Column:
    """The clause's number for the first part, suffixed __p2 and so on after it."""
    return F.transform(parts, lambda p, i: F.when(i == 0, clause).otherwise(F.concat(clause, F.lit("__p"), (i + 1).cast("string"))))


def neighbours(chunks: DataFrame, place: str = "chunk_index") -> DataFrame:
    """Previous and next chunk by position within (language, source).

    Chunks are sorted into ranges of about one size, whatever their source; each range looks to its own rows, and the first and
    last row of a range to those of the ranges beside it. Only these border rows, two a range, are brought together.
    """
    keys = ["lang", "source", place, "doc_id"]
    lead = ["_range", *chunks.columns]
    ranged = kept(chunks.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()).select(*lead))
    key = F.struct(F.col("lang").alias("l"), F.col("source").alias("s"), F.col(place).alias("p"), F.col("doc_id").alias("d"))
    borders = ranged.groupBy("_range").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    beside = Window.orderBy("_range")  # a row a range
    borders = borders.select("_range", F.lag("high").over(beside).alias("_before"), F.lead("low").over(beside).alias("_after"))
    w = Window.partitionBy("_range").orderBy(*keys)
    rows = ranged.withColumn("_key", key).withColumns({"_p": F.lag("_key").over(w), "_n": F.lead("_key").over(w)}).join(borders, "_range")
    near = lambda own, other: F.coalesce(F.col(own), F.col(other))
    same = lambda x: F.when(x["l"].eqNullSafe(F.col("lang")) & x["s"].eqNullSafe(F.col("source")), x["d"])
    return rows.select(*chunks.columns, same(near("_p", "_before")).alias("prev_id"), same(near("_n", "_after")).alias("next_id"))
