"""What is reported of systems: a block of figures each, the comparison on retried questions, metrics against human labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import TRUE_HUMAN, blank, number, truthy
from .analysis import unjudged

#: The ledgers' column names, by kind.
JUDGE = ["answer_relevance", "faithfulness", "context_precision"]
LEXICAL = ["token_f1_score", "sentence_bleu_score", "rouge1", "rouge2", "rougeL", "meteor"]
RETRIEVAL = ["mrr", "ndcg_at_k", "recall_1", "recall_3", "recall_5", "precision_1", "precision_3", "precision_5"]
CITATION = ["citation_accuracy_regex"]
METRICS = JUDGE + LEXICAL + RETRIEVAL + CITATION
LATENCIES = ["retrieval_latency_s", "ttft_s", "end_to_end_latency_s"]
MEMORY = ["gpu_vram_mb", "system_ram_mb"]
LANGUAGES = ["en", "fr", "de"]
BY_LANGUAGE = {"faithfulness": "faithfulness", "token_f1": "token_f1_score", "mrr": "mrr"}
COMPARED = JUDGE + ["token_f1_score", "rougeL", "meteor", "mrr", "recall_5", "citation_accuracy_regex"]
GROUNDED = {"true": True, "1": True, "false": False, "0": False}

ACCURACY = 10_000  # of the sketch that brackets a quantile: it is off by one part in so many of the ranks


def quantiles(df: DataFrame, by: list[str], value: str, points: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """Exact quantiles of each group, interpolated between neighbouring ranks: (by, n, a column for each of `points`).

    Spark's own exact percentile holds a group's distinct values in one task. Here a sketch brackets each quantile; values below the bracket are counted, and
    only the distinct values within it, some 4 in `accuracy` of the rows, are put in order. A value that many rows share is one row with its count. Null values and
    rows with a null in `by` are left out.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.greatest(*(F.col(c).isNull().cast("int") for c in by), F.lit(0)).cast("boolean"))
    slack = 2.0 / accuracy
    wide = [x for p in points.values() for x in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(value, wide, accuracy).alias("_b"))
    at = [F.struct(F.lit(k).alias("k"), F.lit(p).alias("p"), F.get("_b", F.lit(2 * k)).alias("lo"), F.get("_b", F.lit(2 * k + 1)).alias("hi")) for k, p in enumerate(points.values())]
    brackets = sketch.select(*by, "_n", F.explode(F.array(*at)).alias("_q"))
    counted = rows.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")).join(brackets, by).select(*by, "_n", "_v", "_c", "_q.*")
    group = [*by, "k"]
    below, above = F.col("_v") < F.col("lo"), F.col("_v") > F.col("hi")
    edges = counted.groupBy(*group).agg(F.coalesce(F.sum(F.when(below, F.col("_c"))), F.lit(0)).alias("_below"), F.max(F.when(below, F.col("_v"))).alias("_prev"), F.min(F.when(above, F.col("_v"))).alias("_next"))
    order = Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = counted.where(~below & ~above).withColumn("_to", F.sum("_c").over(order)).join(edges, group)
    place = (F.col("_n") - 1) * F.col("p")
    low, high = F.floor(place), F.ceil(place)
    end = F.col("_below") + F.col("_to")
    holds = lambda rank: F.max(F.when((end - F.col("_c") <= rank) & (rank < end), F.col("_v")))
    found = inside.groupBy(*group).agg(F.max("_n").alias("n"), F.max(place - low).alias("_part"), holds(low).alias("_low"), holds(high).alias("_high"), F.max("_prev").alias("_prev"), F.min("_next").alias("_next"))
    x = F.coalesce("_low", "_prev") + F.col("_part") * (F.coalesce("_high", "_next") - F.coalesce("_low", "_prev"))
    return found.withColumn("_x", x).groupBy(*by).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("k") == k, F.col("_x"))).alias(name) for k, name in enumerate(points)))


def _numbers(df: DataFrame, keep: list[Column], names: list[str]) -> DataFrame:
    """`keep` and the named columns as numbers; those that are missing are null."""
    return df.select(*keep, *((number(F.col(c)) if c in df.columns else F.lit(None).cast("double")).alias(c) for c in names))


def scored(evaluations: DataFrame, keep: list[Column]) -> DataFrame:
    """All metrics as numbers, judge scores null in rows that no judge has seen (all three zero or missing)."""
    rows = _numbers(evaluations, keep, METRICS)
    return rows.withColumns(dict(zip(JUDGE, unjudged(*(F.col(c) for c in JUDGE)), strict=True)))


def language_key(c: Column) -> Column:
    """The first two letters in lower case; those of the English word for German count as de."""
    two = F.substring(F.lower(c), 1, 2)
    return F.when(two == "ge", "de").otherwise(two)


def blocks(evaluations: DataFrame, ledger: DataFrame, system: str = "system", language: str = "language", limit: float = 60.0) -> DataFrame:
    """One row a system that either table has rows of: counts, means of all metrics with judged counts, latencies (mean, exact median, 95th percentile), share of
    answers strictly under `limit` seconds, memory, attempts, grounded answers, and counts and main metrics by language.

    Means have four places, latencies two, memory none, attempts three. A figure without values is null, a count of values 0. What is no number
    is missing. Rows with a blank system belong to none. Cells of `grounded` other than true, false, 1 and 0 are not counted.
    """
    key = F.trim(F.col(system)).alias("system")
    ev = scored(evaluations.where(~blank(F.col(system))), [key, language_key(F.col(language)).alias("_lang")])
    mean = lambda c, places: F.round(F.avg(c), places)
    count = lambda when: F.count_if(F.coalesce(when, F.lit(False)))
    aggs = [F.count(F.lit(1)).alias("n_eval"), *(mean(F.col(c), 4).alias(c) for c in METRICS), *(F.count(c).alias(f"{c}_n") for c in JUDGE)]
    for lang in LANGUAGES:
        here = F.col("_lang") == lang
        aggs += [count(here).alias(f"n_{lang}"), *(mean(F.when(here, F.col(c)), 4).alias(f"{name}_{lang}") for name, c in BY_LANGUAGE.items())]
    left = ev.groupBy("system").agg(*aggs)

    cell = F.lower(F.trim(F.col("grounded").cast("string"))) if "grounded" in ledger.columns else F.lit(None).cast("string")
    sure = F.create_map(*(F.lit(x) for pair in GROUNDED.items() for x in pair))[cell]
    rows = _numbers(ledger.where(~blank(F.col(system))), [key, sure.alias("_sure")], [*LATENCIES, *MEMORY, "attempts"])
    aggs = [F.count(F.lit(1)).alias("n_ledger")]
    for c in LATENCIES:
        aggs += [mean(F.col(c), 2).alias(f"{c}_mean"), F.count(c).alias(f"{c}_n")]
    aggs += [F.round(100 * F.avg((F.col(LATENCIES[-1]) < limit).cast("double")), 1).alias("pct_under")]
    for c in MEMORY:
        aggs += [mean(F.col(c), 0).alias(f"{c}_mean"), F.round(F.max(c), 0).alias(f"{c}_peak")]
    aggs += [mean(F.col("attempts"), 3).alias("attempts_mean"), F.when(F.count("attempts") > 0, count(F.col("attempts") > 1)).alias("attempts_gt1")]
    total = F.count("_sure")
    aggs += [F.when(total > 0, count(F.col("_sure"))).alias("grounded_n"), F.when(total > 0, total).alias("grounded_total"), F.round(100.0 * count(F.col("_sure")) / F.nullif(total, F.lit(0)), 1).alias("grounded_pct")]
    right = rows.groupBy("system").agg(*aggs)

    long = rows.unpivot(["system"], LATENCIES, "_measure", "_x")
    q = quantiles(long, ["system", "_measure"], "_x", {"median": 0.5, "p95": 0.95})
    spread = q.groupBy("system").agg(*(F.round(F.max(F.when(F.col("_measure") == c, F.col(p))), 2).alias(f"{c}_{p}") for c in LATENCIES for p in ("median", "p95")))
    counts = ["n_eval", "n_ledger", *(f"{c}_n" for c in JUDGE + LATENCIES), *(f"n_{lang}" for lang in LANGUAGES)]
    return left.join(right.join(spread, "system", "left"), "system", "full").fillna(0, counts)


def _sides(df: DataFrame, pairs: DataFrame, system: str) -> DataFrame:
    """Rows of the systems of `pairs` (a, b) with the pair and whether the system is its first; a system may be in several pairs."""
    ends = pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("s"), F.lit(True).alias("first")), F.struct(F.col("b").alias("s"), F.lit(False).alias("first")))).alias("_e"))
    return df.join(ends.select("a", "b", F.col("_e.s").alias(system), F.col("_e.first").alias("_first")), system)


def retried(ledger: DataFrame, pairs: DataFrame, system: str = "system", question: str = "question_id") -> DataFrame:
    """(a, b, question): questions that the first system of a pair tried more than once, the only ones on which both can differ."""
    rows = ledger.where(number(F.col("attempts")) > 1).select(F.col(system).alias("a"), question).where(F.col(question).isNotNull())
    return rows.join(pairs, "a").select("a", "b", question).distinct()


def _shared(evaluations: DataFrame, ids: DataFrame, pairs: DataFrame, system: str, question: str, names: list[str]) -> DataFrame:
    """One row a pair and retried question that both sides evaluated, with each metric's sum and count on either side."""
    rows = _sides(scored(evaluations, [F.col(system), F.col(question)]), pairs, system).join(ids, ["a", "b", question], "left_semi")
    aggs = [F.max(F.col("_first")).alias("_any"), F.min(F.col("_first")).alias("_all")]
    for c in names:
        for side, here in (("a", F.col("_first")), ("b", ~F.col("_first"))):
            x = F.when(here, F.col(c))
            aggs += [F.sum(x).alias(f"{c}_{side}"), F.count(x).alias(f"{c}_n{side}")]
    return rows.groupBy("a", "b", question).agg(*aggs).where("_any AND NOT _all")


def retry_comparison(evaluations: DataFrame, ledger: DataFrame, pairs: DataFrame, system: str = "system", question: str = "question_id", least: float = 0.9) -> DataFrame:
    """Each metric on the retried questions that both systems of a pair evaluated: (a, b, metric, n_retry, n_both, n_a, n_b, mean_a, mean_b, delta, status).

    OK where both sides have values for `least` of the shared questions or more, PARTIAL where they have fewer, PENDING where one has none; only OK
    rows carry means, since a mean over a judge pass under way looks like a result. delta is a's mean less b's. Pairs without a shared question give no row.
    A question with several rows on a side counts with all of them.
    """
    ids = retried(ledger, pairs, system, question)
    shared = _shared(evaluations, ids, pairs, system, question, COMPARED)
    sums = shared.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both"), *(F.sum(f"{c}_{k}").alias(f"{c}_{k}") for c in COMPARED for k in ("a", "na", "b", "nb")))
    each = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"{c}_a").alias("sa"), F.col(f"{c}_na").alias("n_a"), F.col(f"{c}_b").alias("sb"), F.col(f"{c}_nb").alias("n_b")) for c in COMPARED))
    rows = sums.select("a", "b", "n_both", F.explode(each).alias("x")).select("a", "b", "n_both", "x.*").join(ids.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_retry")), ["a", "b"])
    enough = (F.col("n_a") >= least * F.col("n_both")) & (F.col("n_b") >= least * F.col("n_both"))
    status = F.when((F.col("n_a") == 0) | (F.col("n_b") == 0), "PENDING").when(enough, "OK").otherwise("PARTIAL")
    fine = status == "OK"
    a, b = F.col("sa") / F.col("n_a"), F.col("sb") / F.col("n_b")
    return rows.select("a", "b", "metric", "n_retry", "n_both", "n_a", "n_b", F.when(fine, F.round(a, 4)).alias("mean_a"), F.when(fine, F.round(b, 4)).alias("mean_b"), F.when(fine, F.round(a - b, 4)).alias("delta"), status.alias("status"))


def retry_latency(evaluations: DataFrame, ledger: DataFrame, pairs: DataFrame, system: str = "system", question: str = "question_id") -> DataFrame:
    """Of the shared retried questions that the second system's ledger has too: exact medians of the end-to-end latency on both sides and
    the first side's mean attempts, to two places: (a, b, n, median_a, median_b, attempts_a). Medians are null unless both sides have a latency."""
    latency = LATENCIES[-1]
    shared = _shared(evaluations, retried(ledger, pairs, system, question), pairs, system, question, []).select("a", "b", question)
    rows = _sides(_numbers(ledger, [F.col(system), F.col(question)], [latency, "attempts"]), pairs, system)
    there = shared.join(rows.where(~F.col("_first")).select("a", "b", question).distinct(), ["a", "b", question], "left_semi")
    rows = rows.join(there, ["a", "b", question], "left_semi")
    q = quantiles(rows, ["a", "b", "_first"], latency, {"m": 0.5}).groupBy("a", "b").agg(F.max(F.when(F.col("_first"), F.col("m"))).alias("x"), F.max(F.when(~F.col("_first"), F.col("m"))).alias("y"))
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    head = there.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).join(rows.where("_first").groupBy("a", "b").agg(F.round(F.avg("attempts"), 2).alias("attempts_a")), ["a", "b"], "left")
    return head.join(q, ["a", "b"], "left").select("a", "b", "n", F.when(known, F.round("x", 2)).alias("median_a"), F.when(known, F.round("y", 2)).alias("median_b"), "attempts_a")


def consensus(df: DataFrame, column: str, place: str, question: str = "question_id") -> DataFrame:
    """(question, h): the adjudicated value of every question in the human sample; of several rows the last in `place` that has one."""
    rows = df.where(truthy(F.col("in_human_sample"), TRUE_HUMAN)).select(question, number(F.col(column)).alias("h"), place).where(F.col("h").isNotNull() & F.col(question).isNotNull())
    return rows.groupBy(question).agg(F.max_by("h", place).alias("h"))


def validation(evaluations: DataFrame, place: str, other: DataFrame | None = None, question: str = "question_id") -> DataFrame:
    """Automatic metrics against adjudicated labels: (comparison, n, agreement, first, second), one row for each comparison that has values.

    * citation: rows whose question has a label and that have a score; agreement is exact, first the share of scores below the label;
    * faithfulness: both cut at 0.5; first and second are the means of score and label;
    * realism: agreement is the mean label, first the sum, second the count;
    * appropriateness, against `other` on questions that both have: agreement is the difference of the means first and second.

    Shares have four places, means three. `place` orders the rows of a table, for questions with several rows.
    """
    human = lambda c: consensus(evaluations, c, place, question)
    n = F.count(F.lit(1)).alias("n")
    share = lambda when: F.avg(when.cast("double"))

    def row(rows: DataFrame, name: str, agreement: Column, first: Column, second: Column) -> DataFrame:
        figures = rows.agg(n, F.round(agreement, 4).alias("agreement"), first.cast("double").alias("first"), second.cast("double").alias("second")).where("n > 0")
        return figures.select(F.lit(name).alias("comparison"), "n", "agreement", "first", "second")

    def against(metric: str, label: str) -> DataFrame:
        return evaluations.select(question, number(F.col(metric)).alias("s")).where("s IS NOT NULL").join(human(label), question)

    s, h = F.col("s"), F.col("h")
    none = F.lit(None).cast("double")
    out = row(against("citation_accuracy_regex", "human_citation_accuracy"), "citation", share(s == h), F.round(share(s < h), 4), none)
    out = out.unionByName(row(against("faithfulness", "human_faithfulness"), "faithfulness", share((s >= 0.5) == (h >= 0.5)), F.round(F.avg(s), 3), F.round(F.avg(h), 3)))
    out = out.unionByName(row(human("human_question_realistic"), "realism", F.avg(h), F.sum(h), F.count(h)))
    if other is not None:
        both = human("human_appropriateness").join(consensus(other, "human_appropriateness", place, question).withColumnRenamed("h", "g"), question)
        out = out.unionByName(row(both, "appropriateness", F.avg("h") - F.avg("g"), F.round(F.avg("h"), 3), F.round(F.avg("g"), 3)))
    return out
