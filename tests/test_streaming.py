"""Appending of arriving trees: replays, failures and restarts."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ladderwork.streaming import jobs

SCHEMA = "problem_id string, n int, x double, at timestamp, nodes array<struct<node_id:string,q_value:double>>"


def arrive(spark, path, rows):
    made = [(k, n, 0.1 * n, None, [(f"node-{n}", None if n % 2 else n / 7)]) for k, n in rows]
    df = spark.createDataFrame(made, SCHEMA).withColumn("at", F.timestamp_micros(F.col("n") * 1_000_001))
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def run(spark, tmp_path, state="state", per=None, **options):
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = jobs.read_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=per)
    return jobs.append_trees(stream, str(tmp_path / "out"), str(tmp_path / state), **options).first()


def there(spark, tmp_path):
    return sorted((r.problem_id or "", r.n) for r in jobs.appended_trees(spark, str(tmp_path / "out"), spark.createDataFrame([], SCHEMA).schema).collect())


def test_state_over_batches_and_runs(spark, tmp_path):
    path = str(tmp_path / "in")
    arrive(spark, path, [("a", 1), ("b", 2), (None, 3), ("", 4)])
    arrive(spark, path, [("b", 5), ("c", 7), ("c", 6), (None, 3)])
    first = run(spark, tmp_path, per=1)
    # Of b the file read first counts; of two trees of c in one batch that of the smaller text.
    got = there(spark, tmp_path)
    assert [x for x in got if x[0]] in ([("a", 1), ("b", 2), ("c", 6)], [("a", 1), ("b", 5), ("c", 6)]) and [n for k, n in got if not k] == [3, 3, 4]
    assert (first.input_count, first.skipped_count, first.new_count, first.output_count, first.status) == (8, 2, 6, 6, "completed")
    arrive(spark, path, [("a", 8), ("d", 9)])
    again = run(spark, tmp_path, per=1)  # the same checkpoint: only the new file is read
    assert (again.input_count, again.new_count, again.output_count) == (10, 7, 7)
    other = run(spark, tmp_path, "state2")  # a fresh checkpoint: all is read, keys that are there are left out
    assert (other.input_count, other.new_count, other.output_count) == (10, 3, 10)
    assert [x[0] for x in there(spark, tmp_path) if x[0]] == ["a", "b", "c", "d"]


def test_rows_are_kept_exactly(spark, tmp_path):
    arrive(spark, str(tmp_path / "in"), [(f"k{n}", n) for n in range(40)])
    run(spark, tmp_path)
    schema = spark.createDataFrame([], SCHEMA).schema
    got = jobs.appended_trees(spark, str(tmp_path / "out"), schema)
    assert got.schema == schema
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, spark.read.parquet(str(tmp_path / "in")).collect()))


@pytest.mark.parametrize("lost", ["mark", "after the mark"])
def test_replayed_batch_adds_nothing(spark, tmp_path, monkeypatch, lost):
    """A batch dies after its trees are written, before or after they are marked; its replay gives the same rows."""
    arrive(spark, str(tmp_path / "in"), [("a", 1), (None, 2), (None, 2), ("b", 3)])
    kill = "_marked" if lost == "mark" else "_report"
    real, calls = getattr(jobs.TreeSink, kill), []

    def dies(self, *args):
        calls.append(args)
        if kill == "_report" or len(calls) == 2:
            raise RuntimeError("killed")
        return real(self, *args)

    monkeypatch.setattr(jobs.TreeSink, kill, dies)
    with pytest.raises(Exception):
        run(spark, tmp_path)
    assert list(Path(tmp_path / "out/trees").rglob("*.parquet"))
    assert there(spark, tmp_path) == ([] if lost == "mark" else [("", 2), ("", 2), ("a", 1), ("b", 3)])
    monkeypatch.setattr(jobs.TreeSink, kill, real)
    done = run(spark, tmp_path)
    assert there(spark, tmp_path) == [("", 2), ("", 2), ("a", 1), ("b", 3)]
    assert (done.input_count, done.new_count, done.output_count, done.status) == (4, 4, 4, "completed")


def test_failure_leaves_what_is_finished(spark, tmp_path):
    """One tree can't be built: the other parts of its batch are finished, the summary says so, a restart does the rest."""
    arrive(spark, str(tmp_path / "in"), [(f"k{n}", n) for n in range(30)])
    poisoned = lambda df: df.withColumn("n", F.when(F.col("n") == 13, F.raise_error(F.lit("poisoned tree")).cast("int")).otherwise(F.col("n") * 2))
    with pytest.raises(Exception, match="poisoned"):
        run(spark, tmp_path, build=poisoned)
    row = json.loads(next(Path(tmp_path / "out/summary").glob("part-*")).read_text())
    part = there(spark, tmp_path)
    assert row["status"] == "failed" and row["input_count"] == 30 and 0 < row["new_count"] == row["output_count"] == len(part) < 30
    assert ("k13", 26) not in part
    built = []
    done = run(spark, tmp_path, build=lambda df: built.append(df.count()) or df.withColumn("n", F.col("n") * 2))
    assert there(spark, tmp_path) == sorted((f"k{n}", 2 * n) for n in range(30))
    assert (done.new_count, done.output_count, done.status) == (30, 30, "completed") and built == [30 - len(part)]


def test_nothing_arrives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    done = run(spark, tmp_path)
    assert (done.output_count, done.status) == (0, "completed") and there(spark, tmp_path) == []


def test_cost_of_a_batch_is_its_own(spark, tmp_path):
    """What a later batch reads doesn't grow with what is written: the files of earlier batches can be gone."""
    path = str(tmp_path / "in")
    arrive(spark, path, [(f"k{n}", n) for n in range(20)])
    run(spark, tmp_path)
    for f in Path(tmp_path / "out/trees").rglob("*.parquet"):
        f.unlink()
    arrive(spark, path, [("k3", 1), ("new", 2)])
    done = run(spark, tmp_path)
    assert (done.new_count, done.output_count, done.skipped_count) == (21, 21, 1) and there(spark, tmp_path) == [("new", 2)]
