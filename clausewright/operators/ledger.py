"""Ledgers: schema-safe append, upsert, bidirectional sync, copies by key, and the de-duplication rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.predicates import TRUE_ONE, answered, blank, filled, number, truthy
from ..functions.text import resolve_language


def migrate(df: DataFrame, columns: list[str], default: str | None = "") -> DataFrame:
    """The canonical columns in order: missing ones are added with `default`, others dropped."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(default).cast("string").alias(c) for c in columns))


def added_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def has_old_schema(df: DataFrame) -> bool:
    return "source1_score" in df.columns and "source1_cosine_score" not in df.columns


def rename_legacy(df: DataFrame, sources: int = 5) -> DataFrame:
    """sourceN_score becomes sourceN_cosine_score where only the old name is there."""
    names = {f"source{k}_score": f"source{k}_cosine_score" for k in range(1, sources + 1)}
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and b not in df.columns})


def append(ledger: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    return migrate(ledger, columns).unionByName(migrate(rows, columns))


def upsert(ledger: DataFrame, rows: DataFrame, keys: list[str], owned: list[str]) -> DataFrame:
    """Overwrite the owned columns of every matching row with the given values that are not null; add rows that match nothing.

    `rows` has one row for each key.
    """
    new = rows.select(*keys, *(F.col(c).alias(f"_{c}") for c in rows.columns if c not in keys), F.lit(True).alias("_there"))
    both = ledger.withColumn("_here", F.lit(True)).join(new, keys, "full_outer")
    out = []
    for c in ledger.columns:
        if c in keys or f"_{c}" not in new.columns:
            out.append(F.col(c))
        elif c in owned:
            out.append(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_here").isNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
    return both.select(*out)


def sync(left: DataFrame, right: DataFrame, keys: list[str], shared: list[str]) -> DataFrame:
    """Full outer: blanks of either side filled from the other; `origin` says where a row came from."""
    r = right.select(*keys, *(F.col(c).alias(f"_{c}") for c in shared), F.lit(True).alias("_r"))
    both = left.select(*keys, *shared, F.lit(True).alias("_l")).join(r, keys, "full_outer")
    origin = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    return both.select(*keys, *(filled(F.col(c), F.col(f"_{c}")).alias(c) for c in shared), origin.alias("origin"))


def two_way(left: DataFrame, right: DataFrame, keys: list[str], shared: list[str], mirrors: dict[str, str], question: str = "question_id", language: str = "language") -> tuple[DataFrame, Observation]:
    """Both ledgers made whole from each other, and the counters of what was done.

    A row a key: the shared columns of the left side, of the right side (r_...), the right side's mirrors, and `origin`. Blank cells are filled from the
    other side, missing rows made from it, languages normalised on both with the question's id as the witness, and blank mirrors filled from
    their source. The counters (filled_left, filled_right, added_left, added_right, language_fixed, rows) come from the same pass: they are
    there once an action has run over the rows. Ledgers have one row a key.
    """
    a = left.select(*keys, *(F.col(c).alias(f"_l_{c}") for c in shared), F.lit(True).alias("_l"))
    b = right.select(*keys, *(F.col(c).alias(f"_r_{c}") for c in (*shared, *mirrors)), F.lit(True).alias("_r"))
    both = a.join(b, keys, "full_outer").withColumn("origin", F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both"))
    paired = F.col("origin") == "both"
    l, r = (lambda c: F.col(f"_l_{c}")), (lambda c: F.col(f"_r_{c}"))
    fill = lambda x, y: F.when(blank(x) & ~blank(y), y).otherwise(x)
    fills = {side: sum(((paired & blank(x(c)) & ~blank(y(c))).cast("int") for c in shared), F.lit(0)) for side, x, y in (("left", l, r), ("right", r, l))}
    whole = both.withColumns({f"_fill_{k}": v for k, v in fills.items()})
    for c in shared:
        first, second = F.when(F.col("_l").isNull(), r(c)).otherwise(fill(l(c), r(c))), F.when(F.col("_r").isNull(), l(c)).otherwise(fill(r(c), l(c)))
        whole = whole.withColumns({c: first, f"r_{c}": second})
    fixed = {c: resolve_language(F.coalesce(c, F.lit("")), F.col(question)) for c in (language, f"r_{language}")} if language in shared else {}
    changed = ~F.coalesce(F.col(language), F.lit("")).eqNullSafe(fixed[language]) if fixed else F.lit(False)
    whole = whole.withColumn("_fixed", changed).withColumns(fixed)
    own = lambda c: F.col(f"r_{c}") if c in shared else F.col(c)
    whole = whole.withColumns({f"r_{m}": fill(r(m), own(source)) for m, source in mirrors.items()})
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    counters = Observation(f"two_way_{uuid.uuid4().hex}")
    added = {side: count(F.col("origin") == other) for side, other in (("left", "right"), ("right", "left"))}
    whole = whole.observe(
        counters, count(F.col("_fill_left")).alias("filled_left"), count(F.col("_fill_right")).alias("filled_right"), added["left"].alias("added_left"),
        added["right"].alias("added_right"), count(F.col("_fixed")).alias("language_fixed"), F.count(F.lit(1)).alias("rows"),
    )
    return whole.select(*keys, *shared, *(f"r_{c}" for c in (*shared, *mirrors)), "origin"), counters


def reuse(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Copy the source's non-blank cells by key; rows without a match stay as they are."""
    s = source.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    both = target.join(s, keys, "left")
    return both.select(*(F.when(blank(F.col(f"_{c}")), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in target.columns))


def enrich(df: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Left join that fills blanks only."""
    s = other.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    both = df.join(s, keys, "left")
    kept = [filled(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns]
    return both.select(*kept, *(F.col(f"_{c}").alias(c) for c in columns if c not in df.columns))


def keep_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in `order`, which has to be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: list[str], place: str) -> DataFrame:
    return keep_one(df, keys, F.desc(place))


def keep_first(df: DataFrame, combinations: list[list[str]], place: str) -> DataFrame:
    """First row for each combination of columns, one combination after the other."""
    for keys in combinations:
        df = keep_one(df, keys, F.asc(place))
    return df


def invalid_reason(attempts: Column, grounded: Column, faith: Column, relevance: Column, f1: Column, mrr: Column) -> Column:
    """The first rule that a row breaks, or null; missing judge scores count as 1."""
    sure = truthy(grounded, ("true",))
    f, r = F.coalesce(number(faith), F.lit(1.0)), F.coalesce(number(relevance), F.lit(1.0))
    tries = F.coalesce(number(attempts), F.lit(0.0))
    hit, exact = F.coalesce(number(mrr), F.lit(0.0)), F.coalesce(number(f1), F.lit(0.0))
    return F.when((tries > 2) & ~sure, "ungrounded after retries").when(sure & (f < 0.4), "grounded but unfaithful").when((hit > 0) & (exact == 0), "retrieved but no overlap").when((tries >= 2) & (r < 0.4), "irrelevant after retry")


def invalid_any(attempts: Column, grounded: Column, faith: Column, relevance: Column, f1: Column, mrr: Column) -> Column:
    """Whether any rule is broken; here missing judge scores count as 0."""
    zero = lambda c: F.coalesce(number(c), F.lit(0.0))
    sure = truthy(grounded, ("true",))
    return ((zero(attempts) > 2) & ~sure) | (sure & (zero(faith) < 0.4)) | ((zero(mrr) > 0) & (zero(f1) == 0)) | ((zero(attempts) >= 2) & (zero(relevance) < 0.4))


def keep_best(df: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Valid rows first, then the higher f1, mrr and faithfulness."""
    return keep_one(df, keys, F.asc("invalid"), F.desc("f1"), F.desc("mrr"), F.desc("faith"), F.desc(place))


def keep_best_retrieval(df: DataFrame, keys: list[str], place: str, most: int = 5) -> DataFrame:
    """The row of each key with the highest fused scores, then recency scores, source by source; then grounded ones, answered ones,
    those of fewer attempts, and the first in `place`. Scores that are missing count as 0, attempts that are missing come last."""
    of = {c.lower(): F.col(c) for c in df.columns}
    scores = [f"source{k}_{s}" for s in ("rrf_score", "recency_adjusted_cosine_score") for k in range(1, most + 1)]
    order = [F.coalesce(number(of[c]), F.lit(0.0)).desc() for c in scores if c in of]
    order += [truthy(of["grounded"], TRUE_ONE).desc()] if "grounded" in of else []
    order += [F.coalesce(answered(of["answer"]), F.lit(False)).desc()] if "answer" in of else []
    order += [number(of["attempts"]).asc_nulls_last()] if "attempts" in of else []
    return keep_one(df, keys, *order, F.asc(place))


def flag_split(flag: Column) -> Column:
    """keep, drop or undecided (which is kept too)."""
    s = F.lower(F.trim(F.coalesce(flag, F.lit(""))))
    return F.when(s.isin("1", "1.0", "true", "yes", "keep"), "keep").when(s.isin("0", "0.0", "false", "no", "drop"), "drop").otherwise("undecided")


def blank_cells(df: DataFrame, selected: Column, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(selected, "").otherwise(F.col(c)) for c in columns})


def flat_sources(sources: Column, most: int = 5) -> list[Column]:
    """An array of structs (id, cosine, text) as numbered columns: scores to four places, texts of 500 characters at most."""
    out = []
    for k in range(most):
        s = F.get(sources, F.lit(k))
        out += [s["id"].alias(f"source{k + 1}_id"), F.round(s["cosine"], 4).alias(f"source{k + 1}_cosine_score"), F.substr(s["text"], F.lit(1), F.lit(500)).alias(f"source{k + 1}_text")]
    return out


def nested_sources(df: DataFrame, most: int = 5) -> Column:
    """Numbered columns back to an array; slots without an id are left out, the weight is adjusted over plain score."""
    slots = [
        F.struct(F.col(f"source{k}_id").alias("id"), F.col(f"source{k}_cosine_score").alias("cosine"), F.when(F.col(f"source{k}_cosine_score") == 0, 1.0).otherwise(F.col(f"source{k}_adj") / F.col(f"source{k}_cosine_score")).alias("weight"))
        for k in range(1, most + 1)
        if f"source{k}_id" in df.columns
    ]
    return F.filter(F.array(*slots), lambda s: ~blank(s["id"]))


def completed_ids(df: DataFrame, column: str) -> DataFrame:
    """Distinct trimmed ids that are not empty."""
    return df.select(F.trim(F.col(column).cast("string")).alias(column)).where((F.col(column) != "") & F.col(column).isNotNull()).distinct()


def has_retrieval(sources: Column) -> Column:
    """Whether any source carries a fused score."""
    return F.exists(sources, lambda s: s["rrf"].isNotNull())


def group_complete(df: DataFrame, groups: dict[str, list[str]]) -> list[Column]:
    """For each named group of metric columns: whether any is neither zero nor missing."""
    out = []
    for name, columns in groups.items():
        some = F.lit(False)
        for c in columns:
            x = number(F.col(c))
            some = some | F.coalesce(x != 0, F.lit(False))
        out.append(some.alias(name))
    return out


def preserved(previous: Column, fresh: Column, score: Column, least: float = 0.01) -> Column:
    """A stored retrieval stays where its score passes `least`, and otherwise only fills what is missing."""
    return F.when(number(score) > least, previous).otherwise(F.coalesce(fresh, previous))


def reconciled(ledger: DataFrame, healed: DataFrame, flagged: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Flagged rows out, healed rows in, and the last of each key kept."""
    return keep_last(ledger.join(flagged.select(*keys).distinct(), keys, "left_anti").unionByName(healed), keys, place)


def click_order(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Numeric order where a cell is a number, else that of the lower-case text; numbers come first."""
    keys = [number(F.col(column)), F.lower(F.col(column).cast("string"))]
    return df.orderBy(*(k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys))


def blind_sheets(sample: DataFrame, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """The annotators' sheet without what would give the system away, and the key that has it."""
    return sample.drop(*hidden), sample.select("item_id", *hidden)
