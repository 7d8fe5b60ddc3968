"""Text functions on Columns; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
YEAR = r"\b(?:19|20)\d{2}\b"
#: Fixed values.
ENGLISH = ("en", "english", "eng")
FRENCH = ("fr", "french", "français", "francais", "fra")
AGREEMENT_YEARS = "2020 - 2025"
TAG_SUFFIXES = ("-gpu", "-instruct-q4_k_m", ":latest")
#: Words by which a language shows itself; each counts once a text.
MARKERS = {
    "en": (" the ", " and ", " of ", " with "),
    "fr": (" le ", " la ", " les ", " des "),
    "de": (" der ", " die ", " und ", " das "),
    "es": (" el ", " los ", " que ", " por "),
}
#: Fixed values.
FRENCH_MARKS = (" le ", " la ", " les ", " des ", " une ", " un ", " de ", " et ", " est ", " au ")
ENGLISH_MARKS = (" the ", " and ", " of ", " to ", " is ", " are ", " with ", " for ")
STOP_WORDS = tuple(
    """what how is are the a an of to in for and or on according collective agreement does
    provide regarding apply conditions shall be with that this from at by member members university
    any all may not no if when which who whom whose it its their there here also such other than
    quelles quel quels quelle que est sont le la les des du de au aux dans pour et ou selon convention
    collective indique sujet applique sur une un ses leur leurs cette ces avec par plus comme tout
    tous toute toutes doit peut sera etre être""".split()
)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def token_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[^\s]+"), F.lit(0)))


def clean_text(c: Column) -> Column:
    spaced = F.regexp_replace(c, "[\\u00a0\\u200b]", " ")
    lines = F.regexp_replace(F.regexp_replace(spaced, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(lines, r"^\s+|\s+$", "")


def end_year(stem: Column) -> Column:
    """The latest year written as a word of its own, or null."""
    return F.array_max(F.transform(F.regexp_extract_all(stem, F.lit(YEAR), F.lit(0)), lambda y: y.cast("int")))


def recency_weight(year: Column, low: int = 1998, high: int = 2026) -> Column:
    if low == high:
        return F.lit(1.0)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (year - low) / F.lit(float(high - low))))
    return F.when(year.isNull(), 1.0).otherwise(F.round(F.lit(0.30) + F.lit(0.70) * share, 4))


def language_from_id(qid: Column) -> Column:
    s = F.lower(F.coalesce(qid, F.lit("")))
    return F.when(s.contains("_fr") | s.startswith("fr_"), "fr").when(s.contains("_en") | s.startswith("en_"), "en").otherwise("")


def resolve_language(lang: Column, qid: Column) -> Column:
    s, inferred = F.lower(F.trim(F.coalesce(lang, F.lit("")))), language_from_id(qid)
    return F.when(s.isin(*ENGLISH), "en").when(s.isin(*FRENCH), "fr").when(inferred != "", inferred).when(s.isin("", "nan", "none"), "").otherwise(lang)


def language_mark(c: Column) -> Column:
    out = F.substr(c, F.lit(6), F.lit(2))
    for code in ("es", "de", "fr", "en"):
        out = F.when(c.contains(f"_{code}"), code).otherwise(out)
    return out


def language_code(c: Column) -> Column:
    two = F.substr(F.lower(F.trim(c)), F.lit(1), F.lit(2))
    return F.when(two == "ge", "de").otherwise(two)


def english_or_french(c: Column) -> Column:
    """French where more of its markers occur than of English ones."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(c, F.lit(""))), F.lit(" "))
    en, fr = (sum((padded.contains(m).cast("int") for m in ms), F.lit(0)) for ms in (ENGLISH_MARKS, FRENCH_MARKS))
    return F.when(fr > en, "French").otherwise("English")


def detect_language(c: Column) -> Column:
    """The language with most markers; ties in the order of MARKERS."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(c, F.lit(""))), F.lit(" "))
    counts = {k: sum((padded.contains(m).cast("int") for m in ms), F.lit(0)) for k, ms in MARKERS.items()}
    most = F.greatest(*counts.values())
    out = F.lit("en")
    for k in reversed(list(counts)):
        out = F.when(counts[k] == most, k).otherwise(out)
    return out


def augment_with_year(c: Column, lang: Column) -> Column:
    more = F.when(lang == "fr", f" convention collective {AGREEMENT_YEARS}").otherwise(f" collective agreement {AGREEMENT_YEARS}")
    return F.when(c.rlike(YEAR), c).otherwise(F.concat(c, more))


def canonical_tag(c: Column) -> Column:
    s = F.lower(F.trim(c))
    for suffix in TAG_SUFFIXES:
        s = F.when(s.endswith(suffix), F.substr(s, F.lit(1), F.length(s) - len(suffix))).otherwise(s)
    return F.regexp_replace(s, "[:-]+$", "")


def content_words(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-zA-ZÀ-ÿ]{4,}"), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*(F.lit(w) for w in stop)))


def id_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def split_marker_off(c: Column) -> Column:
    s = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"__p\d+$", "")
    return F.when(s == "0", "").otherwise(s)


def header_labels(nodes: Column, most: int = 5) -> Column:
    """At most five different labels, in order, of structs with clause_id, article_number and section_title."""

    def label(n: Column) -> Column:
        clause, article = split_marker_off(n["clause_id"]), split_marker_off(n["article_number"])
        ident, title = F.when(clause != "", clause).otherwise(article), F.trim(F.coalesce(n["section_title"], F.lit("")))
        head = F.when(ident != "", F.concat(F.lit("ARTICLE "), ident)).otherwise("")
        return F.when((head != "") & (title != ""), F.concat(head, F.lit(" - "), title)).when(head != "", head).otherwise(title)

    return F.slice(F.array_distinct(F.filter(F.transform(nodes, label), lambda x: x != "")), 1, most)


def sentences(c: Column, least: int = 45, most: int = 450) -> Column:
    parts = F.transform(F.split(c, r"(?<=[.?!;:])\s+"), lambda x: F.trim(x))
    return F.filter(parts, lambda s: F.length(s).between(least, most))


def adjacent(items: Column) -> Column:
    """Each item joined with the one after it: the array against itself, one place on, so nothing is computed again for an item."""
    last = F.greatest(F.size(items) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(items, F.lit(1), last), F.slice(items, F.lit(2), last), lambda a, b: F.concat_ws(" ", a, b))
    return F.coalesce(pairs, F.array().cast("array<string>"))


def difficulty(answer: Column) -> Column:
    n = token_count(answer)
    return F.when(n < 18, "easy").when(n < 35, "medium").otherwise("hard")


def score_class(c: Column) -> Column:
    """The class of a score; none for a score that is not there or not a number."""
    return F.when(c.isNull() | F.isnan(c.cast("double")), "").when(c >= 0.7, "high").when(c >= 0.4, "mid").otherwise("low")


def escape_html(c: Column) -> Column:
    for raw, out in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(out))
    return c


def judge_score(c: Column) -> Column:
    digit = F.regexp_extract(F.trim(c), r"\b([1-5])\b", 1)
    return F.when(digit == "", 0.5).otherwise(digit.try_cast("double") / 5.0)


def combined_judge_score(c: Column, metric: str) -> Column:
    """The last line `metric_score: n`; 0 without one, 0.5 where n is no number."""
    found = F.regexp_extract_all(c, F.lit(rf"(?m)^[ \t]*{metric}_score:([^:\n]*)"), F.lit(1))
    value = F.trim(F.element_at(found, -1)).try_cast("double")
    return F.when(F.size(found) == 0, 0.0).otherwise(F.coalesce(F.round(value / 5.0, 4), F.lit(0.5)))


def citation_judge_score(c: Column) -> Column:
    digit = F.regexp_extract(c, r"\b([01])(?:\.0+)?\b", 1)
    return F.when(c.rlike(r"0?\.5"), 0.5).when(digit == "", 0.0).otherwise(digit.try_cast("double"))


def numbered_lines(c: Column, expected: int) -> Column:
    """Line i must begin with its number; a missing one falls back to the i-th line as it is."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def pick(i: Column) -> Column:
        mine = F.filter(lines, lambda x: x.startswith(F.concat(i.cast("string"), F.lit("."))))
        own = F.when(F.size(mine) > 0, F.trim(F.regexp_replace(F.get(mine, F.lit(0)), r"^\d+\.", "")))
        return F.coalesce(own, F.get(lines, i - 1), F.lit(""))

    return F.transform(F.sequence(F.lit(1), F.lit(expected)), pick)


def estimated_tokens(c: Column) -> Column:
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0).otherwise(F.floor(F.length(c) / F.lit(3.2)) + 1).cast("bigint")


def predicted_output(prompt_tokens: Column, ratio: float = 0.35, low: int = 768, high: int = 4096) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.bround(prompt_tokens * F.lit(ratio)))).cast("bigint")


def context_window(prompt: Column, base: int = 12288, maximum: int = 24576, buckets: tuple[int, ...] = (16384, 20480, 24576)) -> Column:
    tokens_ = estimated_tokens(prompt)
    needed = tokens_ + predicted_output(tokens_)
    out = F.lit(maximum)
    for b in sorted(buckets, reverse=True):
        if b <= maximum:
            out = F.when(needed <= b, b).otherwise(out)
    return F.when(needed <= base, base).otherwise(out).cast("bigint")


def whole_number(c: Column) -> Column:
    """Hand-entered numbers: 1.0 becomes 1, blanks become the empty text."""
    s = F.trim(F.coalesce(c, F.lit("")))
    x = s.try_cast("double")
    return F.when(F.lower(s).isin("", "nan", "none"), "").when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(s)


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def dedupe_key(question: Column, answer: Column) -> Column:
    return F.concat(F.regexp_replace(F.lower(question), r"[^\p{L}\p{N}_]+", ""), F.lit("|"), F.substr(answer, F.lit(1), F.lit(160)))


def file_stem(c: Column) -> Column:
    """Safe file names: runs of other characters become one underscore, year ranges keep their dash."""
    kept = F.regexp_replace(c, r"(\d{4})\s*[-–]\s*(\d{4})", "$1~$2")
    return F.replace(F.regexp_replace(F.regexp_replace(kept, r"[^\p{L}\p{N}~]+", "_"), "^_+|_+$", ""), F.lit("~"), F.lit("-"))
