"""Rules of single operators on literal examples."""

import json
import math
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ladderwork.functions import answers, text
from ladderwork.operators import grading, pairs, problems, search, trees
from ladderwork.sources import records
from ladderwork.streaming import jobs


def values(spark, items, column, kind="string"):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(items)], f"k int, x {kind}").repartition(3)
    return [r.v for r in rows.select("k", column(F.col("x")).alias("v")).orderBy("k").collect()]


def test_grading_cases(spark):
    cases = [
        ("Omitted. <answer>72</answer>", "So. #### 72", True), ("<answer>1,234</answer>", "#### 1234", True), ("<answer>72 apples</answer>", "#### 72", True),
        ("<answer>1/2</answer>", "#### 0.5", True), ("the answer is 99", "#### 99", False), ("<answer>98</answer>", "#### 99", False),
        ("<answer>12.5%</answer>", "#### 1/8", True), ("<answer>1/3</answer>", "#### 0.3333333333", False), ("<answer>1/3</answer>", "#### 0." + "3" * 28, True),
        ("<answer>Straße.</answer>", "#### STRASSE", True), ("<answer></answer>", "#### 5", False), ("<answer>nan</answer>", "#### nan", False),
        ("<answer>-0</answer>", "#### 0.00", True), ("<answer>１２</answer>", "#### 12", True), ("<answer>1/0</answer>", "#### 0", True), (None, "#### None", False),
    ]
    rows = spark.createDataFrame([(k, p, a) for k, (p, a, _) in enumerate(cases)], "k int, prediction string, answer string")
    got = {r.k: r for r in grading.grade(rows).collect()}
    assert [got[k].is_correct for k in range(len(cases))] == [c[2] for c in cases]
    assert got[4].comparison_mode == "missing_answer_tag" and got[0].comparison_mode == "tag_numeric" and got[9].comparison_mode == "tag_text"
    lenient = {r.k: r for r in grading.grade(rows, strict=False).collect()}
    assert lenient[4].is_correct and lenient[4].comparison_mode == "fallback_last_number_numeric"
    empty = grading.accuracy(grading.grade(rows.limit(0))).first()
    assert (empty.correct, empty.total, empty.accuracy) == (0, 0, 0.0)


def test_answer_functions(spark):
    assert values(spark, ["<answer> a\nb </ANSWER>", "none", "<answer></answer>", None], answers.extract_answer_tag) == ["a\nb", None, "", None]
    assert values(spark, ["1/2 cups", "1,2345", "5-3", "no", ".5%", ""], answers.extract_last_number) == ["2", "5", "-3", None, ".5%", None]
    assert values(spark, ["x\n####\n32", "#### 1\n#### 2", "####", None], answers.extract_reference) == ["32", "1", None, None]
    assert values(spark, ["$1,000.50", "1/4", "50%", "-0.0", "+5", "1e3", "1_000", "x", "", "1/0"], answers.canonical_decimal) == ["1000.5", "0.25", "0.5", "-0", "5", "1000", "1000", None, None, None]
    keys = values(spark, ["100", "1e2", "1_00", "100.000", "10000%", "200/2", "0.1e3", "abc", "inf", "1e999999"], answers.numeric_key)
    assert len(set(keys[:7])) == 1 and keys[7] is None and keys[8] == "inf" and keys[9] == "1e999999"


@pytest.mark.parametrize("x", ["0", "007.50", "-12.30", "+.5", "5.", "123456789012345678901234567", "0.000", "12%"])
def test_plain_numbers_agree_with_decimals(spark, x):
    value = answers.parse_decimal(x)
    assert values(spark, [x], answers.numeric_key) == [answers._key(value)]
    assert values(spark, [x], answers.canonical_decimal) == [answers._fixed(value)]


def test_text_functions(spark):
    assert values(spark, ["  a   b\n", "", None], text.normalize_whitespace) == ["a b", "", None]
    assert values(spark, ["$ 5 . 。", ": x", "a:", "a："], text.strip_outer_punctuation) == ["5", "x", "a", "a："]
    assert values(spark, ["− 1，234．5／2 €"], text.normalize_numeric) == ["-1234.5/2"]
    steps = values(spark, ["pre Step 1: a step 2 : b\r\nc", "a\n\n b ", "only Step 1: x", " \n", None, "Step 1: Step 2: b"], text.split_steps)
    assert steps == [["Step 1: a", "step 2 : b\nc"], ["a", "b"], ["only Step 1: x"], [], [], ["Step 1:", "Step 2: b"]]
    assert values(spark, ["😀" * 600], lambda c: F.char_length(text.truncate_step(c))) == [512]
    assert values(spark, ["a", " ", None], lambda c: text.continuation_prompt(F.lit("p \n"), c)) == ["p\na\n", "p\n", "p\n"]
    assert values(spark, ["a ", "", None], lambda c: text.merge_prediction(c, F.lit(" b "))) == ["a\nb", "b", "b"]
    assert values(spark, ["x"], lambda c: text.render_prompt("{{a}} {question}!", c)) == ["{a} x!"]
    with pytest.raises(ValueError):
        text.render_prompt("none", F.lit("x"))


def test_problems(spark):
    raw = spark.createDataFrame([("train", 7, " How many? ", "Think. \n#### 32"), ("train", 123456, "q", "#### $1,000.0")], "split string, source_index long, question string, answer string")
    a, b = problems.prepare_problems(raw).orderBy("source_index").collect()
    assert (a.problem_id, a.final_answer, a.final_answer_numeric, a.answer_tag, a.solution) == ("gsm8k-main-train-00007", "32", "32", "<answer>32</answer>", "Think.")
    assert a.prompt.endswith("Question:\nHow many?\n") and (b.problem_id, b.final_answer_numeric) == ("gsm8k-main-train-123456", "1000")
    bad = raw.withColumn("answer", F.lit("no mark"))
    assert problems.prepare_problems(bad, on_missing="drop").count() == 0
    with pytest.raises(Exception, match="####"):
        problems.prepare_problems(bad).collect()


def test_samples(spark):
    df = spark.range(500).select(F.col("id").alias("source_index"), F.lit("q").alias("question"))
    drawn = problems.sample_train_dev(df.repartition(7), 30, 10).collect()
    again = problems.sample_train_dev(df.repartition(2), 30, 10).collect()
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, again))
    ids = {s: {r.original_index for r in drawn if r.split == s} for s in ("train", "dev")}
    assert len(ids["train"]) == 30 and len(ids["dev"]) == 10 and not ids["train"] & ids["dev"]
    assert sorted(r.source_index for r in drawn if r.split == "dev") == list(range(10))
    assert problems.sample_test(df, None).count() == problems.sample_test(df, 0).count() == problems.sample_test(df, 500).count() == 500
    assert problems.sample_test(df, 20).count() == 20
    with pytest.raises(ValueError):
        problems.sample_train_dev(df, 499, 2)


TREE = [
    ("root", None, 0, "", "", None), ("a", "root", 1, "Step 1: add", "Step 1: add", 0.9), ("b", "root", 1, "Step 1: guess", "Step 1: guess", 0.1),
    ("c", "a", 2, "Step 2: end", "x", 1.0), ("d", "a", 2, "Step 2: stop", "y", 0.5),
]
NODE = "node_id string, parent_id string, depth int, step_text string, prefix_text string, q_value double"


def tree(spark, nodes=TREE, problem=1):
    return spark.createDataFrame([(problem, "Why?", None, nodes)], f"problem_id long, question string, prompt string, nodes array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>")


def test_pairs_of_a_small_tree(spark):
    nested = tree(spark)
    made = sorted(pairs.make_pairs_nested(nested).collect(), key=lambda r: r.pair_id)
    flat = pairs.make_pairs(pairs.explode_nodes(nested), nested.select("problem_id", "question", "prompt"))
    assert sorted(r.pair_id for r in flat.collect()) == [r.pair_id for r in made] == ["1__a__c__d", "1__root__a__b"]
    assert all(r.chosen_score > r.rejected_score for r in made)
    assert "(empty)" in made[1].step_prompt and made[0].step_prompt.startswith("You are a careful") and "Step 1: add" in made[0].step_prompt
    shared = pairs.render(flat, "sharegpt").collect()
    assert shared[0].conversations[0]["from"] == "human" and shared[0].chosen["from"] == "gpt"
    assert pairs.render(flat, "alpaca").columns[1:5] == ["instruction", "input", "chosen", "rejected"]
    with pytest.raises(ValueError):
        pairs.render(flat, "other")


def test_pair_classes_and_spread(spark):
    nan = float("nan")
    nodes = [("root", None, 0, "", "", None)] + [(f"n{k}", "root", 1, t, "", s) for k, (t, s) in enumerate([("a", 0.5), ("b", 0.5), ("a ", 0.9), (" ", 0.1), ("c", None), ("d", nan), ("e", 0.6)])]
    flat = pairs.explode_nodes(tree(spark, nodes))
    one, many = (pairs.classify_pairs(pairs.candidate_pairs(flat, spread=s)) for s in (100, 2))
    count = lambda df: {r["class"]: r["count"] for r in df.groupBy("class").count().collect()}
    inside = pairs.classify_pairs(pairs.candidate_pairs_nested(tree(spark, nodes)))
    assert count(one) == count(many) == count(inside)
    assert sum(count(one).values()) == 21 and count(one)["missing_score"] == 11 and count(one)["same_text"] == 1 and count(one)["tie"] == 5
    stats = pairs.pair_stats(one).first()
    assert (stats.parent_groups, stats.paired_groups, stats.skipped_missing_score) == (1, 1, 11)
    empty = pairs.pair_summary(flat.limit(0), one.limit(0), pairs.oriented_pairs(one).limit(0)).first()
    assert empty.input_problem_count == 0 and empty.avg_score_gap == 0.0


def test_prefix_trees(spark):
    rows = [(1, 0, "Step 1: a\nStep 2: b"), (1, 1, "Step 1: a Step 2: c"), (1, 2, " "), (2, 0, "x\ny")]
    done = spark.createDataFrame(rows, "problem_id long, branch_index int, completion string")
    nodes = trees.prefix_tree(done).collect()
    assert {(r.problem_id, r.prefix_text): r.path_hits for r in nodes if r.depth} == {
        (1, "Step 1: a"): 2, (1, "Step 1: a\nStep 2: b"): 1, (1, "Step 1: a\nStep 2: c"): 1, (2, "x"): 1, (2, "x\ny"): 1,
    }
    own = trees.expansion_tree(done)
    assert sorted((r.problem_id, r.step_text, r.path_hits) for r in own.collect() if r.depth) == [(1, "Step 1: a", 2), (2, "x", 1)]
    log = {(r.problem_id, r.branch_index): r.status for r in trees.expansion_log(done).collect()}
    assert log == {(1, 0): "created", (1, 1): "reused", (1, 2): "empty_step", (2, 0): "created"}
    linked = {(r.problem_id, r.node_id): r.children_ids for r in trees.link_children(trees.prefix_tree(done)).collect()}
    assert linked[1, "root"] == ["node-00001"] and linked[1, "node-00001"] == ["node-00002", "node-00003"] and linked[1, "node-00003"] == []


def test_events_back_up(spark):
    rows = [(1, 0, ["root", "a"], 0.5, "expand_backup", "b"), (1, 1, ["root"], 1.0, "terminal_backup", None)]
    events = spark.createDataFrame(rows, "problem_id long, simulation_index int, selected_path array<string>, backed_up_value double, event_type string, best_child_id string")
    got = {r.node_id: (r.visit_count, r.total_value) for r in trees.backup(trees.visits_of_events(events)).collect()}
    assert got == {"root": (2, 1.5), "a": (1, 0.5), "b": (1, 0.5)}


def plain_search(answer, recorded, s):
    """One problem's search, step by step: {node_id: (parent_id, step, q_value, visits, total, terminal)} and event types."""
    tag = lambda t: re.search(r"<answer>(.*?)</answer>", t)
    nodes, events = [dict(id="root", up=None, path=(), q=None, n=0, t=0.0, end=False, kids=None)], []

    def valued(path):
        text = "\n".join(path)
        if tag(text):
            return float(tag(text)[1] == answer), True
        tries = [recorded[(k + len(path)) % len(recorded)] for k in range(s.rollouts)]
        return sum(bool(tag(f"{text}\n{x}")) and tag(f"{text}\n{x}")[1] == answer for x in tries) / s.rollouts, False

    def expand(node, n):
        made = []
        node["kids"] = []
        for k in range(n if recorded else 0):
            step = next((x for x in recorded[(k + len(node["path"])) % len(recorded)].split("\n") if x.strip()), None)
            path = (*node["path"], step)
            if step is None:
                continue
            known = [x for x in nodes if x["path"] == path]
            if not known:
                q, end = valued(path)
                known = [dict(id=f"node-{len(nodes):05d}", up=node["id"], path=path, q=q, n=0, t=0.0, end=end or len(path) >= s.max_depth, kids=None)]
                nodes.append(known[0])
                node["kids"].append(known[0])
            made.append(known[0])
        return made

    def visit(path, value):
        for x in path:
            x["n"], x["t"] = x["n"] + 1, x["t"] + value

    def bound(p, c):
        spread = math.log(p["n"] + 2)
        return c["q"] + s.ucb_c * math.sqrt(spread) if not c["n"] else c["t"] / c["n"] + s.ucb_c * math.sqrt(spread / c["n"]) + 0.05 * c["q"]

    expand(nodes[0], s.root_branches)
    for child in nodes[0]["kids"]:
        visit([nodes[0], child], child["q"])
    for _ in range(s.simulations):
        path = [nodes[0]]
        while path[-1]["kids"]:
            path.append(max(path[-1]["kids"], key=lambda c: round(bound(path[-1], c), 9)))
        leaf = path[-1]
        if leaf["end"]:
            events.append("terminal_backup")
            visit(path, leaf["q"] or 0.0)
        elif made := expand(leaf, s.expansion_branches):
            best = max(made, key=lambda c: c["q"])
            events.append("expand_backup")
            visit([*path, best], best["q"])
        else:
            events.append("dead_end_backup")
            leaf["end"] = True
            visit(path, leaf["q"] or 0.0)
    return {x["id"]: (x["up"], x["path"][-1] if x["path"] else "", x["q"], x["n"], round(x["t"], 9), x["end"]) for x in nodes}, events


def test_search(spark, tmp_path):
    said = {
        1: ["two and two\ndone <answer>4</answer>", "guess\n<answer>5</answer>", "<answer>4</answer>", "other\n<answer>4</answer>", "two and two\n\n"], 2: [" ", ""], 3: [], 4: ["a\nb", "a\nc <answer>7</answer>", "d"],
        5: [f"s{k % 3}\n<answer>{k}</answer>" for k in range(7)],
    }
    answers = {1: "4", 2: "9", 3: "1", 4: "7", 5: "3"}
    asked = spark.createDataFrame([(k, f"#### {a}") for k, a in answers.items()], "problem_id long, answer string")
    recorded = spark.createDataFrame([(k, j, x) for k, texts in said.items() for j, x in enumerate(texts)] + [(99, 0, "x")], "problem_id long, branch_index int, completion string")
    settings = search.SearchSettings(simulations=5, max_depth=3)
    nodes, events = search.replay_search(asked, recorded.repartition(3), str(tmp_path), settings)
    found, happened = nodes.collect(), events.orderBy("problem_id", "simulation_index").collect()
    assert {r.problem_id for r in found} == set(answers)
    for k, answer in answers.items():
        want, kinds = plain_search(answer, said[k], settings)
        own = {r.node_id: (r.parent_id, r.step_text, r.q_value, r.visit_count, round(r.total_value, 9), r.is_terminal) for r in found if r.problem_id == k}
        assert own == want and [r.event_type for r in happened if r.problem_id == k] == kinds
    backed = trees.backup(trees.visits_of_events(events.where("problem_id = 5"))).collect()
    assert {r.node_id: r.visit_count for r in backed}["root"] == 5


def test_records(spark, tmp_path):
    path = str(tmp_path / "in.jsonl")
    (tmp_path / "in.jsonl").write_text('{"a": 1, "t": "é"}\n\n  \n{"a": null}\n', encoding="utf-8")
    assert sorted((r.a or 0, r.t) for r in records.read_records(spark, path, "a int, t string").collect()) == [(0, None), (1, "é")]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n[{"a": 2}]\n{"a":\n', encoding="utf-8")
    bad = str(tmp_path / "bad.jsonl")
    assert records.read_records(spark, bad, "a int", "drop").count() == 1
    assert sum(r._malformed is not None for r in records.read_records(spark, bad, "a int", "keep").collect()) == 2
    with pytest.raises(Exception, match="not a JSON object"):
        records.read_records(spark, bad, "a int").collect()
    df = spark.createDataFrame([(1, None), (2, "ü")], "a int, t string")
    out = str(tmp_path / "out")
    records.write_records(df, out)
    with pytest.raises(Exception):
        records.write_records(df, out)
    records.write_records(df, out, if_exists="append")
    lines = [json.loads(x.value) for x in spark.read.text(out).collect()]
    assert len(lines) == 4 and all("t" in x for x in lines)
    records.append_records(df.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    records.write_summary(df.limit(1), str(tmp_path / "summary"))
    row = spark.range(1).select(records.dataset_descriptor("x", "x.json", "sharegpt"), records.dataset_descriptor("y", "y.json", "generic")).first()
    assert row.x.formatting == "sharegpt" and row.x.columns.messages == "conversations" and row.y is None


def test_splits_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("q", "#### 1")], "question string, answer string")
    df.write.parquet(str(tmp_path / "train"))
    df.drop("answer").write.parquet(str(tmp_path / "test"))
    with pytest.raises(ValueError):
        records.read_problem_splits(spark, str(tmp_path))
    assert records.read_problem_splits(spark, str(tmp_path), ("train",)).first().split == "train"
    ids = spark.createDataFrame([("a",), ("b",), (None,), ("",)], "problem_id string")
    done = spark.createDataFrame([("a",), ("",), (None,)], "problem_id string")
    assert sorted(r.problem_id or "" for r in records.resume_filter(ids, done).collect()) == ["", "", "b"]
    with pytest.raises(ValueError):
        records.limit_problems(ids, 0, need=True)


def test_streams_resume(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    tree(spark).write.parquet(source)
    schema = tree(spark).schema
    for turn in range(2):
        jobs.stream_append_trees(jobs.read_stream(spark, source, schema), out, str(tmp_path / f"state{turn}")).awaitTermination()
    assert spark.read.parquet(f"{out}/trees").count() == 1
    assert spark.read.json(f"{out}/summary").first().output_count == 1
    tree(spark, problem=2).write.mode("append").parquet(source)
    jobs.stream_append_trees(jobs.read_stream(spark, source, schema), out, str(tmp_path / "state1")).awaitTermination()
    assert spark.read.parquet(f"{out}/trees").count() == 2


def test_stream_keeps_trees_without_ids(spark, tmp_path):
    schema = "problem_id string, n int"
    rows = [("a", 1), ("a", 2), (None, 3), (None, 4), ("", 5), ("", 6)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    jobs.stream_append_trees(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/trees")).count() == 5


def test_paths_deeper_than_a_search(spark):
    rows = [(1, k, "\n".join([*(f"s{j}" for j in range(11)), f"end {k}"])) for k in range(2)]
    done = spark.createDataFrame(rows, "problem_id long, branch_index int, completion string")
    assert {r.depth: r.n for r in trees.prefix_tree(done).groupBy("depth").agg(F.count("*").alias("n")).collect()} == {k: 1 for k in range(12)} | {12: 2}
    assert trees.prefix_tree(done, max_depth=8).agg(F.max("depth")).first()[0] == 8


def test_decimals_keep_exactness():
    assert answers.parse_decimal("1/2/3") == Decimal("1.5") and answers.parse_decimal("12.5%") == Decimal("0.125")
    assert answers.parse_decimal("x") is None and answers.parse_decimal("1/0") is None


def test_case_folding_of_all_characters(spark):
    """Each character in front of a letter, alone and together, as the language folds it."""
    every = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    rows = [(k, x + "A", (x + "A").casefold()) for k, x in enumerate(every)] + [(-1, "".join(every[:70_000:7]), "".join(every[:70_000:7]).casefold()), (-2, "Straße ΣΊΣΥΦΟΣ ŉ", "Straße ΣΊΣΥΦΟΣ ŉ".casefold()), (-3, "", "")]
    df = spark.createDataFrame(rows, "k int, x string, want string").repartition(8)
    assert df.where(~text.fold_case(F.col("x")).eqNullSafe(F.col("want"))).count() == 0
    assert values(spark, [None], text.fold_case) == [None]


def test_deep_paths(spark, tmp_path):
    chain = [(1, "root" if k == 0 else f"n{k}", f"n{k + 1}") for k in range(1000)] + [(2, "root", "a"), (3, "x", "y")]
    best = spark.createDataFrame(chain, "problem_id long, parent_id string, node_id string")
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,)], "problem_id long")
    got = {r.problem_id: r.path for r in trees.select_deep_path(best, asked, str(tmp_path / "a")).collect()}
    assert got == {1: ["root", *(f"n{k + 1}" for k in range(1000))], 2: ["root", "a"], 3: ["root"], 4: ["root"]}
    for depth in (0, 1, 5, 8):
        cut = {r.problem_id: r.path for r in trees.select_deep_path(best, asked, str(tmp_path / f"d{depth}"), depth).collect()}
        assert cut == {k: v[: depth + 1] for k, v in got.items()} if depth else True
        plain = {r.problem_id: r.path for r in trees.select_path(best, asked, depth).collect()} if depth else cut
        assert cut == plain


def test_resumed_write_observes_its_summary(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("", 4), ("b", 5)], "problem_id string, n int")
    out = str(tmp_path / "out")
    first = records.write_resumed(df, df.limit(0), out, format="parquet", rollouts=3).first()
    assert tuple(first) == (5, 0, 5, 5, "complete", 3)
    more = df.unionByName(spark.createDataFrame([("c", 6)], df.schema))
    second = records.write_resumed(more, spark.read.parquet(out), out, format="parquet").first()
    assert tuple(second) == (6, 3, 3, 8, "complete") and spark.read.parquet(out).count() == 8
    named = df.where("problem_id <> ''")
    assert records.write_resumed(named, spark.read.parquet(out), out, format="parquet").first().status == "nothing_to_do"
