"""Secret scans with DataFrame functions only: base spans of three kinds, and ownership frequency.

Places come from the engine's own matcher: `regexp_extract_all` gives the matches in order and `split` by the
same pattern the text between them, so running sums of both lengths are the starts in code points.

A further candidate is a long mixed-case token with digits outside every base span. The values of all spans
are hashed and counted over the corpus by distinct owners (sources) and distinct repositories (the
documents' hosts here: source and document). A value held by one owner in at most MAX_REPOS repositories is
live-looking and gives an `own` span; a value that several owners or more repositories hold is a copied example. Base spans stay whatever their count.

Defined cases: a null text is empty; a null owner counts as one owner of its own; a document repeated under
the same id and text is scanned once and its rows get the same result; an empty table gives an
empty table; the result has the columns named here only, whatever else the input has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, salted_join, text_of, unused

KINDS = ("assign", "access", "hex", "own")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # maximal runs, so the bound on the length can be part of the pattern
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{24,}"
HINT = r"(?i)password|passwd|secret|token|api_?key"
MIN_ASSIGN = 6
MAX_REPOS = 10  # an owner may keep a live value in a few places

_SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _places(text: Column, pattern: str, kind: int, value: str | None = None, least: int = 0) -> Column:
    """Spans of `pattern` with group `value` (the whole match if None) of at least `least` characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if value else found
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"), values.alias("value"))

    def step(acc: Column, row: Column) -> Column:
        at = acc["at"] + row["gap"]
        stop = at + F.length(row["hit"])
        span = F.struct(at.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), row["value"].alias("value"))
        kept = F.when(F.length(row["value"]) >= least, F.array(span)).otherwise(F.array().cast(_SPAN))
        return F.struct(stop.alias("at"), F.concat(acc["out"], kept).alias("out"))

    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    none = F.array().cast(_SPAN)
    return F.array_sort(
        F.concat(
            F.when(text.rlike(HINT), _places(text, ASSIGN, 0, "value", MIN_ASSIGN)).otherwise(none),
            F.when(text.contains("AKIA"), _places(text, ACCESS, 1)).otherwise(none),
            F.when(text.rlike(HEX), _places(text, HEX, 2)).otherwise(none),
        )
    )


def other_candidates(text: Column, base: Column) -> Column:
    """Long tokens with a digit, a capital and a small letter that touch no base span."""
    none = F.array().cast(_SPAN)
    tokens = F.when(text.rlike(TOKEN), _places(text, TOKEN, 3)).otherwise(none)

    def live(s: Column) -> Column:
        v = s["value"]
        free = ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
        return v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]") & free

    return F.filter(tokens, live)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_owners: int = 1, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per input row: id, text_key, base and spans (arrays of start, kind, stop, value), n_copied, n_owned.

    Only documents with a candidate go to the shuffles, and only with the hashes of their values.
    """
    text = text_of(text_col)
    docs = df.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(owner_col).cast("string").alias("owner"), F.xxhash64(text).alias("text_key"), base_spans(text).alias("base"), text.alias("_text")
    )
    docs = docs.withColumn("more", other_candidates(F.col("_text"), F.col("base"))).drop("_text")
    return _owned(cut_lineage(docs), max_owners, max_repos)  # else the patterns run once for each use


def _owned(docs: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    every = F.transform(F.concat("base", "more"), lambda s: F.struct(F.sha2(s["value"], 256).alias("h"), s["kind"].alias("kind")))
    held = docs.select("id", "text_key", "owner", F.explode(every).alias("c")).select("id", "text_key", "owner", "c.h", "c.kind")
    # a value's rows are first reduced to one per owner, so a value in a third of all documents is a few rows
    repos = held.select("h", "owner", "id").distinct().groupBy("h", "owner").agg(F.count(F.lit(1)).alias("repos"))
    counts = repos.groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))
    counts = counts.select("h", ((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).alias("owned"))
    rated = salted_join(held.select("id", "text_key", "h").distinct(), counts, "h", "id")  # a value may lie in a third of all documents
    by_doc = rated.groupBy(F.col("id").alias("_id"), F.col("text_key").alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct("h", "owned"))).alias("owned"))
    plain = docs.where((F.size("base") == 0) & (F.size("more") == 0)).withColumn("owned", F.lit(None).cast("map<string,boolean>"))
    listed = docs.where((F.size("base") > 0) | (F.size("more") > 0))
    listed = listed.join(by_doc.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left").drop("_id", "_key")
    both = plain.unionByName(listed)

    def owned(s: Column) -> Column:
        return F.element_at("owned", F.sha2(s["value"], 256))

    own = F.filter("more", owned)
    rows = F.concat("base", "more")
    return both.select(
        "id",
        "text_key",
        "base",
        F.array_sort(F.concat("base", own)).alias("spans"),
        F.size(F.filter(rows, lambda s: ~owned(s))).cast("bigint").alias("n_copied"),
        F.size(F.filter(rows, owned)).cast("bigint").alias("n_owned"),
    )


def joined(spans: Column) -> Column:
    """kind:start:end of the spans by start, then kind as listed, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """`text` with every span replaced by `mask`; overlapping spans by one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.when(fresh, F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text)))))


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """`docs` with every span of `scan` masked."""
    i, key, spans, mine = unused(docs.columns, 4)
    found = scan(docs, id_col, text_col, owner_col).where(F.size("spans") > 0).groupBy(F.col("id").alias(i), F.col("text_key").alias(key)).agg(F.first("spans").alias(spans))
    rows = docs.withColumn(mine, F.xxhash64(text_of(text_col)))
    rows = rows.join(found.hint("merge"), F.col(id_col).cast("bigint").eqNullSafe(F.col(i)) & (F.col(mine) == F.col(key)), "left")
    text = F.when(F.col(spans).isNull(), text_of(text_col)).otherwise(masked(text_of(text_col), F.col(spans)))
    return rows.withColumn(text_col, text).select(*docs.columns)
