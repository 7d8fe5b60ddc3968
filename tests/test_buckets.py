"""Ledgers in buckets: restarts, replays, and buckets that no batch touches."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clausewright.streaming import buckets

SCHEMA = "k bigint, n bigint, x string"


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(spark, path, version=None):
    return sorted(tuple(r) for r in buckets.ledger(spark, path, SCHEMA, version).collect())


def files(path):
    return {str(f.relative_to(path)): hashlib.md5(f.read_bytes()).hexdigest() for f in Path(path).rglob("*.parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path, up = str(tmp_path / "l"), buckets.upsert(["k"], "n")
    assert rows(spark, path) == []
    buckets.apply(batch(spark, [(k, 1, "a") for k in range(40)]), 0, ["k"], up, path, 8)
    before = files(path)
    buckets.apply(batch(spark, [(3, 2, "b"), (3, 1, "old"), (99, 1, "new")]), 1, ["k"], up, path, 8)
    after = files(path)
    assert {f: after[f] for f in before} == before
    first, second = buckets.manifest(spark, path, 0), buckets.manifest(spark, path, 1)
    moved = {b for b in second if second[b] != first.get(b)}
    assert len(first) == 8 and 1 <= len(moved) <= 2 and {f.split("/")[2] for f in set(after) - set(before)} == {f"bucket={b}" for b in moved}
    want = sorted([(k, 1, "a") for k in range(40) if k != 3] + [(3, 2, "b"), (99, 1, "new")])
    assert rows(spark, path) == want and rows(spark, path, 0) == [(k, 1, "a") for k in range(40)]


def test_replay_and_failure_give_the_same_version(spark, tmp_path):
    path, total = str(tmp_path / "l"), buckets.summed(["k"])
    df = lambda rows: spark.createDataFrame(rows, "k bigint, n bigint")
    read = lambda: sorted(tuple(r) for r in buckets.ledger(spark, path, "k bigint, n bigint").collect())
    buckets.apply(df([(1, 5), (2, 7), (1, 1)]), 0, ["k"], total, path, 4)
    buckets.apply(df([(1, 10)]), 1, ["k"], total, path, 4)
    for _ in range(2):
        assert read() == [(1, 16), (2, 7)]
        buckets.apply(df([(1, 10)]), 1, ["k"], total, path, 4)  # the same batch again
    (tmp_path / "l" / "manifest" / "1").unlink()  # rows were written, the manifest was not
    assert read() == [(1, 6), (2, 7)]
    buckets.apply(df([(1, 10)]), 1, ["k"], total, path, 4)
    assert read() == [(1, 16), (2, 7)]
    buckets.apply(df([]), 2, ["k"], total, path, 4)
    assert read() == [(1, 16), (2, 7)] and buckets.versions(spark, path) == [0, 1, 2]


def test_vacuum_keeps_what_is_named(spark, tmp_path):
    path, up = str(tmp_path / "l"), buckets.upsert(["k"], "n")
    for v in range(5):
        buckets.apply(batch(spark, [(k, v, "a") for k in range(v, 20)]), v, ["k"], up, path, 4)
    want, last = rows(spark, path), rows(spark, path, 3)
    assert buckets.vacuum(spark, path) > 0 and buckets.versions(spark, path) == [3, 4]
    assert rows(spark, path) == want and rows(spark, path, 3) == last and buckets.vacuum(spark, path) == 0


@pytest.mark.parametrize("what", ["upsert", "means"])
def test_stream_goes_on_after_a_restart(spark, tmp_path, what):
    def add(rows, name):
        batch(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
        if what == "means":
            return sorted(tuple(r) for r in buckets.running_means(source, "x", "n", str(tmp_path / "l")).collect())
        buckets.merge_stream(source, ["k"], buckets.upsert(["k"], "n"), str(tmp_path / "l"), 4)
        return rows(spark, str(tmp_path / "l"))

    add([(1, 1, "a"), (2, 1, "b")], "one")
    assert run() == ([("a", 1.0, 1), ("b", 1.0, 1)] if what == "means" else [(1, 1, "a"), (2, 1, "b")])
    add([(2, 2, "b"), (3, 4, "a"), (4, None, "c")], "two")
    want = [("a", 2.5, 2), ("b", 1.5, 2), ("c", None, 1)] if what == "means" else [(1, 1, "a"), (2, 2, "b"), (3, 4, "a"), (4, None, "c")]
    assert run() == want == run()
