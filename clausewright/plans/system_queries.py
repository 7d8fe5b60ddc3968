"""Figures of systems, retried questions, resume gates and human labels, over ledgers that the events stand in for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates
from ..operators import systems as s
from .registry import query

#: Metric k of an event is ((k + 3) * id % 101) / 100, missing in every (k + 5)th; no judge has seen every sixth.
CELLS = ", ".join(
    f"CASE WHEN event_id % {k + 5} = 0 THEN NULL {'WHEN event_id % 6 = 0 THEN NULL' if c in s.JUDGE else ''} ELSE (event_id * {k + 3} % 101) / 100.0::DOUBLE END AS {c}" for k, c in enumerate(s.METRICS)
)
EVALS = f"""raw AS (SELECT event_id, event_type AS system, user_id AS question_id, CASE event_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' END AS lang, {CELLS} FROM events WHERE event_id % 10 <> 9),
ev AS (SELECT * REPLACE ({", ".join(f"CASE WHEN NOT ({' AND '.join(f'coalesce({j}, 0) = 0' for j in s.JUDGE)}) THEN {c} END AS {c}" for c in s.JUDGE)}) FROM raw)"""
LEDGER = """lu AS (SELECT event_id, event_type AS system, user_id AS question_id, value / 7 AS retrieval_latency_s, CASE WHEN event_id % 3 <> 0 THEN value / 10 END AS ttft_s, CASE WHEN event_id % 5 <> 0 THEN value END AS end_to_end_latency_s,
(event_id % 8000)::DOUBLE AS gpu_vram_mb, (event_id % 333)::DOUBLE AS system_ram_mb, CASE WHEN event_id % 13 < 9 THEN (event_id % 13 % 4)::DOUBLE END AS attempts, CASE event_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN '0' WHEN 2 THEN '1' WHEN 3 THEN 'false' END AS grounded FROM events WHERE event_id % 10 <> 8)"""


def evaluations(t):
    i = F.col("event_id")
    cells = [
        F.when(i % (k + 5) == 0, "n/a").otherwise((i * (k + 3) % 101 / F.lit(100.0)).cast("string") if c not in s.JUDGE else F.when(i % 6 == 0, "0.0").otherwise((i * (k + 3) % 101 / F.lit(100.0)).cast("string"))).alias(c)
        for k, c in enumerate(s.METRICS)
    ]
    language = F.when(i % 4 == 0, "English").when(i % 4 == 1, "FR").when(i % 4 == 2, "German").otherwise("x")
    return t("events").where(i % 10 != 9).select(i, F.col("event_type").alias("system"), F.col("user_id").alias("question_id"), language.alias("language"), *cells)


def ledger(t):
    i, v = F.col("event_id"), F.col("value")
    grounded = F.when(i % 6 == 0, " True").when(i % 6 == 1, "0").when(i % 6 == 2, "1").when(i % 6 == 3, "FALSE").when(i % 6 == 4, "yes").otherwise("")
    return t("events").where(i % 10 != 8).select(
        i,
        F.col("event_type").alias("system"),
        F.col("user_id").alias("question_id"),
        (v / 7).alias("retrieval_latency_s"),
        F.when(i % 3 != 0, v / 10).alias("ttft_s"),
        F.when(i % 5 != 0, v.cast("string")).otherwise("nan").alias("end_to_end_latency_s"),
        (i % 8000).alias("gpu_vram_mb"),
        (i % 333).alias("system_ram_mb"),
        F.when(i % 13 < 9, i % 13 % 4).alias("attempts"),
        grounded.alias("grounded"),
    )


def _mean(c: str, places: int, when: str = "") -> str:
    return f"round(avg({c}){f' FILTER ({when})' if when else ''}, {places})"


LEFT = ", ".join(
    [f"{_mean(c, 4)} AS {c}" for c in s.METRICS]
    + [f"count({c}) AS {c}_n" for c in s.JUDGE]
    + [f"count(*) FILTER (lang = '{x}') AS n_{x}" for x in s.LANGUAGES]
    + [f"{_mean(c, 4, f'''lang = '{x}' ''')} AS {name}_{x}" for x in s.LANGUAGES for name, c in s.BY_LANGUAGE.items()]
)
RIGHT = ", ".join(
    [f"{_mean(c, 2)} AS {c}_mean, round(quantile_cont({c}, 0.5), 2) AS {c}_median, round(quantile_cont({c}, 0.95), 2) AS {c}_p95, count({c}) AS {c}_n" for c in s.LATENCIES]
    + [f"{_mean(c, 0)} AS {c}_mean, round(max({c}), 0) AS {c}_peak" for c in s.MEMORY]
)


@query(f"""WITH {EVALS}, {LEDGER}, l AS (SELECT system, count(*) AS n_eval, {LEFT} FROM ev GROUP BY system),
r AS (SELECT system, count(*) AS n_ledger, {RIGHT}, round(100 * avg((end_to_end_latency_s < 60)::INT), 1) AS pct_under, round(avg(attempts), 3) AS attempts_mean, count(*) FILTER (attempts > 1) AS attempts_gt1,
 count(*) FILTER (grounded IN ('true', '1')) AS grounded_n, count(grounded) AS grounded_total, round(100.0::DOUBLE * count(*) FILTER (grounded IN ('true', '1')) / count(grounded), 1) AS grounded_pct FROM lu GROUP BY system)
SELECT * FROM l FULL JOIN r USING (system)""")
def system_blocks(t):
    """The whole block of figures of every system."""
    return s.blocks(evaluations(t), ledger(t))


PAIRS = [("click", "view"), ("view", "purchase"), ("click", "purchase")]
PAIR_SQL = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)
SHARED = f"""pairs(a, b) AS (VALUES {PAIR_SQL}), ids AS (SELECT DISTINCT a, b, question_id FROM lu JOIN pairs ON system = a WHERE attempts > 1),
near AS (SELECT a, b, ids.question_id FROM ids WHERE EXISTS (SELECT 1 FROM ev WHERE system = a AND ev.question_id = ids.question_id) AND EXISTS (SELECT 1 FROM ev WHERE system = b AND ev.question_id = ids.question_id))"""


def pairs(t):
    return t("events").sparkSession.createDataFrame(PAIRS, "a string, b string")


@query(f"""WITH {EVALS}, {LEDGER}, {SHARED}, long AS (UNPIVOT (SELECT system, question_id, {', '.join(f'coalesce({c}, -1) AS {c}' for c in s.COMPARED)} FROM ev) ON {', '.join(s.COMPARED)} INTO NAME metric VALUE x),
side AS (SELECT a, b, metric, count(*) FILTER (x >= 0 AND system = a) AS n_a, count(*) FILTER (x >= 0 AND system = b) AS n_b, avg(x) FILTER (x >= 0 AND system = a) AS ma, avg(x) FILTER (x >= 0 AND system = b) AS mb
 FROM near JOIN long ON long.question_id = near.question_id AND system IN (a, b) GROUP BY ALL),
c AS (SELECT a, b, count(*) AS n_retry FROM ids GROUP BY ALL), d AS (SELECT a, b, count(*) AS n_both FROM near GROUP BY ALL),
f AS (SELECT *, CASE WHEN n_a = 0 OR n_b = 0 THEN 'PENDING' WHEN n_a >= 0.9::DOUBLE * n_both AND n_b >= 0.9::DOUBLE * n_both THEN 'OK' ELSE 'PARTIAL' END AS status FROM side JOIN c USING (a, b) JOIN d USING (a, b))
SELECT a, b, metric, n_retry, n_both, n_a, n_b, CASE WHEN status = 'OK' THEN round(ma, 4) END AS mean_a, CASE WHEN status = 'OK' THEN round(mb, 4) END AS mean_b, CASE WHEN status = 'OK' THEN round(ma - mb, 4) END AS delta, status FROM f""")
def retry_comparison(t):
    return s.retry_comparison(evaluations(t), ledger(t), pairs(t))


@query(f"""WITH {EVALS}, {LEDGER}, {SHARED}, there AS (SELECT * FROM near WHERE EXISTS (SELECT 1 FROM lu WHERE system = b AND lu.question_id = near.question_id)),
r AS (SELECT a, b, system = a AS first, end_to_end_latency_s AS x, attempts FROM there JOIN lu ON lu.question_id = there.question_id AND system IN (a, b))
SELECT a, b, (SELECT count(*) FROM there WHERE there.a = r.a AND there.b = r.b) AS n, round(quantile_cont(x, 0.5) FILTER (first), 2) AS median_a, round(quantile_cont(x, 0.5) FILTER (NOT first), 2) AS median_b, round(avg(attempts) FILTER (first), 2) AS attempts_a FROM r GROUP BY a, b""")
def retry_latency(t):
    return s.retry_latency(evaluations(t), ledger(t), pairs(t))


@query("""WITH x AS (SELECT l_returnflag, l_linestatus, l_extendedprice::DOUBLE AS v FROM lineitem)
SELECT l_returnflag, l_linestatus, count(*) AS n, round(quantile_cont(v, 0.01), 4) AS p01, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.999), 4) AS p999 FROM x GROUP BY ALL""")
def exact_quantiles(t):
    rows = t("lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").cast("double").alias("v"))
    q = s.quantiles(rows, ["l_returnflag", "l_linestatus"], "v", {"p01": 0.01, "median": 0.5, "p999": 0.999})
    return q.select("l_returnflag", "l_linestatus", "n", *(F.round(c, 4).alias(c) for c in ("p01", "median", "p999")))


HUMAN = """h AS (SELECT event_id, user_id AS q, event_type, CASE WHEN event_id % 4 < 3 THEN (event_id % 3) / 2.0::DOUBLE END AS regex, CASE WHEN event_id % 5 > 0 THEN (event_id % 7) / 6.0::DOUBLE END AS faith, event_id % 6 < 4 AS sampled,
CASE WHEN event_id % 9 < 8 THEN (event_id % 2)::DOUBLE END AS cit, CASE WHEN event_id % 11 < 10 THEN (event_id % 5 < 3)::INT::DOUBLE END AS fai, (event_id % 4 > 0)::INT::DOUBLE AS rea, CASE WHEN event_id % 7 < 6 THEN (event_id % 3 > 0)::INT::DOUBLE END AS app FROM events)"""
LAST = "{0} AS (SELECT q, arg_max({1}, event_id) AS h FROM h WHERE sampled AND {1} IS NOT NULL AND event_type {2} 'view' GROUP BY q)"


def human(t):
    i = F.col("event_id")
    flag = lambda c: c.cast("int").cast("string")
    return t("events").select(
        i,
        F.col("user_id").alias("question_id"),
        "event_type",
        F.when(i % 4 < 3, (i % 3 / F.lit(2.0)).cast("string")).otherwise("").alias("citation_accuracy_regex"),
        F.when(i % 5 > 0, i % 7 / F.lit(6.0)).alias("faithfulness"),
        F.when(i % 6 == 0, "1").when(i % 6 == 1, "1.0").when(i % 6 == 2, " Yes").when(i % 6 == 3, "TRUE").when(i % 6 == 4, "0").otherwise("").alias("in_human_sample"),
        F.when(i % 9 < 8, (i % 2).cast("string")).otherwise("?").alias("human_citation_accuracy"),
        F.when(i % 11 < 10, flag(i % 5 < 3)).alias("human_faithfulness"),
        flag(i % 4 > 0).alias("human_question_realistic"),
        F.when(i % 7 < 6, flag(i % 3 > 0)).otherwise("none").alias("human_appropriateness"),
    )


@query(f"""WITH {HUMAN}, {LAST.format('c', 'cit', '<>')}, {LAST.format('f', 'fai', '<>')}, {LAST.format('r', 'rea', '<>')}, {LAST.format('x', 'app', '<>')}, {LAST.format('y', 'app', '=')}, e AS (SELECT * FROM h WHERE event_type <> 'view')
SELECT 'citation' AS comparison, count(*) AS n, round(avg((regex = h)::INT), 4) AS agreement, round(avg((regex < h)::INT), 4) AS first, NULL::DOUBLE AS second FROM e JOIN c USING (q) WHERE regex IS NOT NULL
UNION ALL SELECT 'faithfulness', count(*), round(avg(((faith >= 0.5) = (h >= 0.5))::INT), 4), round(avg(faith), 3), round(avg(h), 3) FROM e JOIN f USING (q) WHERE faith IS NOT NULL
UNION ALL SELECT 'realism', count(*), round(avg(h), 4), sum(h), count(*)::DOUBLE FROM r UNION ALL SELECT 'appropriateness', count(*), round(avg(x.h) - avg(y.h), 4), round(avg(x.h), 3), round(avg(y.h), 3) FROM x JOIN y USING (q)""")
def human_validation(t):
    """Metrics against adjudicated labels; the view events stand for the other system."""
    rows = human(t)
    return s.validation(rows.where("event_type <> 'view'"), "event_id", rows.where("event_type = 'view'"))


RUN = """run AS (SELECT event_id, (event_id % 700)::VARCHAR AS q, event_id % 8 IN (0, 3, 4, 5, 6, 7) AS usable, event_id % 5 IN (0, 1) AS grounded, event_id % 6 < 3 AS timed, event_id % 13 = 0 OR event_id % 17 = 0 AS scored FROM events)"""


def run_ledger(t):
    i = F.col("event_id")
    return t("events").select(
        F.concat(F.lit(" "), i % 700).alias("question_id"),
        F.when(i % 8 == 1, "ERROR").when(i % 8 == 2, "  ").when(i % 8 == 3, "error").otherwise("text").alias("answer"),
        F.when(i % 5 == 0, "True ").when(i % 5 == 1, "TRUE").when(i % 5 == 2, "1").when(i % 5 == 3, "false").alias("grounded"),
        F.when(i % 6 < 3, (i % 6).cast("string")).when(i % 6 == 3, "NaT").when(i % 6 == 4, " nan").alias("ttft_s"),
        F.when(i % 13 == 0, "0.5").when(i % 13 == 1, "?").otherwise("0").alias("mrr"),
        F.when(i % 17 == 0, 0.25).otherwise(0.0).alias("ndcg_at_k"),
    )


OPEN = "SELECT '{0}' AS phase, count(*) AS n, coalesce(sum(doc_id), 0)::BIGINT AS ids FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT q FROM run WHERE {1})"


@query(f"WITH {RUN} " + " UNION ALL ".join(OPEN.format(*x) for x in (("generation", "usable AND grounded"), ("one pass", "usable"), ("regeneration", "usable AND timed"), ("evaluation", "scored"))))
def resume_pending(t):
    """What each phase has yet to do; documents stand for questions."""
    docs, run = t("documents").select(F.col("doc_id").cast("string").alias("question_id")), run_ledger(t)
    left = {
        "generation": gates.pending(docs, run, gates.GENERATION),
        "one pass": gates.pending(docs, run, gates.GENERATION, max_retries=1),
        "regeneration": gates.pending(docs, run, gates.REGENERATION, force=True),
        "evaluation": gates.pending(docs, run, gates.EVALUATION),
    }
    out = None
    for phase, rows in left.items():
        row = rows.agg(F.lit(phase).alias("phase"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("question_id").cast("bigint")), F.lit(0).cast("bigint")).alias("ids"))
        out = row if out is None else out.unionByName(row)
    return out
