"""Clauses of the pages' lines, by both variants of the segmenter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking
from .registry import query

#: Headers that take the place of some lines of a page, by the line's number; {page} marks a page.
HEADERS = {3: "'ARTICLE ' || (n // 11 + 1) || ' Terms'", 6: "(n // 11 + 1) || '.2(b) Sub'", 7: "'   '", 8: "'99.1 not mine'", 9: "'SECTION II'", 10: "{page}"}
MARKS = {False: "'<<page_' || n || '>>'", True: "'<<<PAGE:' || n || '>>>'"}


def _sql(anchored: bool) -> str:
    cases = " ".join(f"WHEN {k} THEN {v.format(page=MARKS[anchored])}" for k, v in HEADERS.items())
    page = r"^<<<PAGE:(\d+)>>>" if anchored else r"(?i)page(?:[\s ]*[-_]+[\s ]*|[\s ]+)?(\d+)"
    article = r"(?i)^ARTICLE\s+(\d{1,3})\b" if anchored else r"^(?:ARTICLE|Article)[\s ]+(\d{1,3})[\s .\-–—:]*([A-ZÀ-ÿ][^\n]*)?$"
    clause = r"(?i)^(\d{1,3}(?:\.\d+)+(?:\([a-z]+\))?)\b" if anchored else r"^(\d{1,3}(?:\.\d+)+(?:\([a-zA-Z0-9]+\))?)[\s .\-–—:]+(.+)?$"
    named = "NULL" if anchored else f"nullif(trim(regexp_extract(bare, '{article}', 2)), '')"
    running = "OVER (PARTITION BY page_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return rf"""WITH l AS (SELECT page_id, unnest(w) AS raw, unnest(range(len(w))) AS n FROM (SELECT page_id, regexp_extract_all(html, '>([^<>]+)<', 1) AS w FROM pages)),
m AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS bare FROM (SELECT page_id, n, CASE n % 11 {cases} ELSE raw END AS line FROM l)),
k AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN regexp_matches({'line' if anchored else 'bare'}, '{page}') THEN 'p' WHEN regexp_matches(bare, '(?i)^(?:PART|SECTION|SCHEDULE|APPENDIX|ANNEXE|PARTIE)[\s ]+[IVX\d]+') THEN 'd'
 WHEN regexp_matches(bare, '{article}') THEN 'a' WHEN regexp_matches(bare, '{clause}') THEN 'c' ELSE 't' END AS kind FROM m),
f AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'a' THEN regexp_extract(bare, '{article}', 1) END IGNORE NULLS) {running}, '0') AS article,
 coalesce(last_value(CASE WHEN kind = 'd' THEN bare WHEN kind = 'a' THEN {named} END IGNORE NULLS) {running}, 'PREAMBLE') AS title,
 coalesce(last_value(CASE WHEN kind = 'p' THEN try_cast(regexp_extract({'line' if anchored else 'bare'}, '{page}', 1) AS INTEGER) END IGNORE NULLS) {running}, 1) AS page, regexp_extract(bare, '{clause}', 1) AS number FROM k),
o AS (SELECT *, kind = 'a' OR (kind = 'c' AND starts_with(number, article || '.')) AS opens FROM f),
p AS (SELECT *, sum(opens::INT) {running} AS part, coalesce(last_value(CASE WHEN kind = 'a' THEN article WHEN opens THEN replace(replace(number, '(', '.'), ')', '') END IGNORE NULLS) {running}, '0') AS clause FROM o),
g AS (SELECT page_id, part, max_by(article, n) AS article, max_by(clause, n) AS clause, max_by(title, n) AS title, max_by(page, n) AS page,
 regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY n) FILTER ({anchored} OR kind <> 'b'), '{page.removeprefix("^")}', '', 'g'), '^\s+|\s+$', '', 'g') AS text FROM p GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY part)::INTEGER - 1 AS ord, article, clause, title, page, md5(text) AS body FROM g WHERE text <> ''"""


def _clauses(t, anchored: bool):
    raw = t("pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(">([^<>]+)<"), F.lit(1))).alias("n", "raw"))
    cases = " ".join(f"WHEN {k} THEN {v.format(page=MARKS[anchored]).replace('//', 'DIV')}" for k, v in HEADERS.items())
    lines = raw.select("page_id", "n", F.expr(f"CASE n % 11 {cases} ELSE raw END").alias("line"))
    return chunking.segmented(lines, "page_id", anchored).withColumn("body", F.md5("text")).drop("text")


@query(_sql(False))
def clause_segment_pages(t):
    """Clauses of the text nodes of pages, some of which are replaced by headers."""
    return _clauses(t, False)


@query(_sql(True))
def clause_segment_anchored(t):
    return _clauses(t, True)
