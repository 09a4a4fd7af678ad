"""Each text is worked through once: expressions that a plan repeats cost as often as they stand there."""

import sys

import pytest
from pyspark.sql import functions as F

from ladderwork.functions import text
from ladderwork.plans import queries
from ladderwork.streaming import jobs

TABLES = "/root/testdata/sf0.001"


def planned(spark, name):
    return queries.QUERIES[name](spark, TABLES)._jdf.queryExecution().optimizedPlan().toString()


def test_white_space_is_that_of_patterns(spark):
    every = spark.createDataFrame([(k, chr(k)) for k in range(1, sys.maxunicode + 1) if not 0xD800 <= k < 0xE000], "k int, c string")
    white = every.where(F.col("c").rlike(r"(?U)^\s\z")).collect()
    assert "".join(r.c for r in sorted(white)) == text.WHITE_SPACE
    both = every.select("c", text.strip(F.concat(F.lit("\t　a "), "c", F.lit("b \x85\n"))).alias("s"), text.rstrip(F.concat(F.lit(" "), "c")).alias("r"))
    assert both.where((F.col("s") != F.concat(F.lit("a "), "c", F.lit("b"))) | (F.col("r") != F.regexp_replace(F.concat(F.lit(" "), "c"), r"(?U)\s+\z", ""))).count() == 0


@pytest.mark.parametrize("name, most", [("prefix_tree", 2), ("expansion_tree", 1), ("expansion_log", 1), ("split_steps", 1), ("first_step", 1)])
def test_steps_are_split_once(spark, name, most):
    # One splitting has the marker three times: counted, split by, looked for at the start.
    assert planned(spark, name).count(r"Step\s+") <= 3 * most


@pytest.mark.parametrize("name", ["grade_rollouts", "keep_rollouts", "grade_predictions"])
def test_grading_repeats_no_text(spark, name):
    plan = planned(spark, name)
    assert plan.count("<answer>\\s*") <= 2 and plan.count("(?U)\\s+") <= 8 and plan.count("ArrowEvalPython") == 1


def test_keys_are_kept_without_python(spark, tmp_path):
    """A key of an arriving tree costs no call of a Python function, however many there are."""
    (tmp_path / "done").mkdir()
    spark.range(3).selectExpr("string(id) as problem_id", "id as n").write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), "problem_id string, n bigint")
    done = jobs.read_stream(spark, str(tmp_path / "done"), "key string, n bigint")
    plan = jobs.new_trees(stream, done, "problem_id")._jdf.queryExecution().analyzed().toString()
    assert "Pandas" not in plan and "Python" not in plan


def test_rows_of_a_batch_by_key(spark):
    rows = [("a", "2", "arrived"), ("a", "1", "arrived"), ("a", None, "new"), ("b", "1", "arrived"), ("c", "1", "arrived"), ("c", None, "finished"), ("c", None, "new"), (None, "1", "arrived"), (None, "1", "arrived"), ("d", None, "finished"), ("d", None, "new")]
    got = jobs.by_key(spark.createDataFrame(rows, "key string, row string, kind string").repartition(5)).collect()
    assert sorted((r.arrived, r.row or "") for r in got) == [(0, ""), (1, ""), (1, ""), (1, "1"), (1, "1"), (2, "1")]
