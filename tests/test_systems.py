"""Exact quantiles, retried questions, human labels and resume gates against plain versions."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausewright.operators import gates
from clausewright.operators import systems as s

POINTS = {"p00": 0.0, "p15": 0.15, "median": 0.5, "p95": 0.95, "p100": 1.0}


def quantiles_of(spark, rows, accuracy=s.ACCURACY):
    df = spark.createDataFrame(rows, "g string, x double")
    return {r["g"]: r.asDict() for r in s.quantiles(df, ["g"], "x", POINTS, accuracy).collect()}


def test_quantiles_are_numpys(spark):
    rng = np.random.default_rng(3)
    groups = {
        "one": [4.0],
        "two": [1.0, 2.0],
        "ten": list(map(float, range(10))),
        "ties": [5.0] * 3000 + [6.0],
        "mixed": [0.0] * 900 + list(rng.normal(size=2000)),
        "long": list(rng.exponential(size=30_000)),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("one", None), (None, 1.0)]
    for accuracy in (s.ACCURACY, 50):  # a coarse sketch brackets more widely and gives the same
        found = quantiles_of(spark, rows, accuracy)
        assert set(found) == set(groups)
        for g, xs in groups.items():
            assert found[g]["n"] == len(xs)
            for name, p in POINTS.items():
                assert found[g][name] == pytest.approx(np.quantile(xs, p), abs=1e-12), (g, name, accuracy)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40))
def test_quantiles_of_small_groups(spark, xs):
    found = quantiles_of(spark, [("g", float(x)) for x in xs])["g"]
    for name, p in POINTS.items():
        assert found[name] == pytest.approx(np.quantile(xs, p), abs=1e-12)


def test_quantiles_of_nothing(spark):
    assert quantiles_of(spark, []) == {} and quantiles_of(spark, [("g", None)]) == {}


def test_blocks_of_one_sided_systems(spark):
    ev = spark.createDataFrame([(" only ev", "german", "0.5", "0"), ("both", "French", "x", "1"), ("nan", "en", "1", "1"), (None, "en", "1", "1")], "system string, language string, mrr string, faithfulness string")
    lu = spark.createDataFrame([("both", "10", "2", "yes"), ("both", "70", None, "TRUE"), ("only lu", None, "1", None)], "system string, end_to_end_latency_s string, attempts string, grounded string")
    rows = {r["system"]: r for r in s.blocks(ev, lu).collect()}
    assert set(rows) == {"only ev", "both", "only lu"}
    assert rows["only ev"]["n_ledger"] == 0 and rows["only ev"]["n_de"] == 1 and rows["only ev"]["mrr_de"] == 0.5
    assert rows["only ev"]["faithfulness"] is None and rows["only ev"]["faithfulness_n"] == 0  # no judge has seen it
    b = rows["both"]
    assert (b["end_to_end_latency_s_median"], b["pct_under"], b["attempts_gt1"], b["grounded_n"], b["grounded_total"]) == (40.0, 50.0, 1, 1, 1)
    assert b["mrr"] is None and b["faithfulness"] == 1.0 and b["ttft_s_median"] is None and b["gpu_vram_mb_peak"] is None
    assert rows["only lu"]["n_eval"] == 0 and rows["only lu"]["grounded_pct"] is None and rows["only lu"]["end_to_end_latency_s_n"] == 0
    assert {r["system"] for r in s.blocks(ev.limit(0), lu.limit(0)).collect()} == set()


def test_retry_statuses(spark):
    lu = [("a", str(q), "2" if q < 10 else "1", 1.0 + q) for q in range(12)] + [("b", str(q), "1", 2.0 * q) for q in range(11)] + [("a", None, "9", 1.0)]
    ev = [("a", str(q), 0.5, 0.8, 1.0 if q < 3 else None) for q in range(12)] + [("b", str(q), 0.25, 0.4 if q != 2 else None, None) for q in range(2, 12)]
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "nobody")], "a string, b string")
    lu = spark.createDataFrame(lu, "system string, question_id string, attempts string, end_to_end_latency_s double")
    ev = spark.createDataFrame(ev, "system string, question_id string, mrr double, meteor double, rougeL double")
    rows = {(r["a"], r["b"], r["metric"]): r for r in s.retry_comparison(ev, lu, pairs).collect()}
    assert {k[:2] for k in rows} == {("a", "b")}  # b retried nothing, nobody has no rows
    mrr, meteor, rouge = (rows["a", "b", m] for m in ("mrr", "meteor", "rougeL"))
    assert (mrr["n_retry"], mrr["n_both"], mrr["status"], mrr["delta"]) == (10, 8, "OK", 0.25)
    assert (meteor["n_b"], meteor["status"], meteor["mean_a"]) == (7, "PARTIAL", None)  # 7 of 8 is under nine tenths
    assert rouge["status"] == "PENDING"
    [r] = s.retry_latency(ev, lu, pairs).collect()
    assert (r["n"], r["median_a"], r["median_b"], r["attempts_a"]) == (8, 6.5, 11.0, 2.0)


def test_validation_takes_the_last_label_and_leaves_out_what_has_none(spark):
    schema = "k int, question_id string, in_human_sample string, citation_accuracy_regex string, human_citation_accuracy string, faithfulness string, human_faithfulness string, human_question_realistic string, human_appropriateness string"
    rows = [(1, "p", "1", "0", "0", "0.6", "", "1", ""), (2, "p", "1", "1", "1", "x", "", "0", ""), (3, "q", "0", "1", "1", "0.2", "1", "1", "1"), (4, None, "1", "1", "1", "1", "1", "1", "1")]
    found = {r["comparison"]: r for r in s.validation(spark.createDataFrame(rows, schema), "k").collect()}
    assert set(found) == {"citation", "realism"}
    assert (found["citation"]["n"], found["citation"]["agreement"], found["citation"]["first"]) == (2, 0.5, 0.5)
    assert (found["realism"]["n"], found["realism"]["agreement"]) == (1, 0.0)


def test_gates(spark):
    rows = [("1", "text", "True", "0.4", "0", "0"), ("2", "text", "no", "", "0.1", "x"), ("3", "ERROR", "true", "1", "", "0.2"), (" 4", "error", "true", "NaT", None, None), (None, "text", "true", "1", "1", "1"), ("5", None, None, None, None, None)]
    ledger = spark.createDataFrame(rows, "question_id string, answer string, grounded string, ttft_s string, mrr string, ndcg_at_k string")
    asked = spark.createDataFrame([(str(k),) for k in range(1, 7)] + [(None,), ("",)], "question_id string")

    def left(phase, **kw):
        return {r[0] for r in gates.pending(asked, ledger, phase, **kw).collect()} - {None, ""}

    assert left(gates.GENERATION) == {"2", "3", "5", "6"}
    assert left(gates.GENERATION, mode="cloud") == left(gates.GENERATION, max_retries=1) == {"3", "5", "6"}
    assert left(gates.GENERATION, force=True) == {"1", "2", "3", "4", "5", "6"}
    assert left(gates.REGENERATION, force=True) == {"2", "3", "4", "5", "6"}
    assert left(gates.EVALUATION) == {"1", "4", "5", "6"}
    assert gates.pending(asked, ledger, gates.EVALUATION).where("coalesce(question_id, '') = ''").count() == 2
    assert gates.pending(asked, ledger.select("question_id"), gates.REGENERATION).count() == 8  # no telemetry column: nothing is done
    assert gates.pending(asked, ledger.where(F.lit(False)), gates.GENERATION).count() == 8
