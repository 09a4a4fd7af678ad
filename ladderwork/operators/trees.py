"""Prefix trees of reasoning steps and their Monte Carlo values.

Nodes are named by problem_id and node_id; the root is 'root', others number the nodes of a problem by depth, first
branch and text, so ids don't depend on the partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import extract_answer_tag
from ..functions.text import first_step, join_steps, merge_prediction, split_steps
from .grading import grade

MAX_DEPTH = 8


def _path_key(path: Column) -> Column:
    """Short stand-in for a path as a grouping key."""
    return F.sha2(F.array_join(path, "\x01"), 256)


def _with_ids(nodes: DataFrame) -> DataFrame:
    """pos and node_id: nodes of a problem numbered by depth, first branch and key."""
    order = Window.partitionBy("problem_id").orderBy("depth", "first_branch", "key")
    return nodes.withColumn("pos", F.row_number().over(order)).withColumn("node_id", _node_name(F.col("pos")))


def _node_name(pos: Column) -> Column:
    number = F.when(pos < 100000, F.lpad(pos.cast("string"), 5, "0")).otherwise(pos.cast("string"))
    return F.concat(F.lit("node-"), number)


def _with_parents(nodes: DataFrame) -> DataFrame:
    """nodes (problem_id, key, parent_key, node_id and more) with parent_id, the node of that key; 'root' where there is none.

    A node stands twice, as itself and as a child, and both meet by key among the problem's nodes, which are together since
    they were numbered: what nodes are made from is read once, not joined with itself."""
    payload = [c for c in nodes.columns if c not in ("problem_id", "key", "parent_key")]
    own = F.struct(F.col("key").alias("at"), F.col("node_id").alias("known"), F.lit(None).cast(nodes.select(F.struct(*payload)).schema[0].dataType).alias("child"))
    child = F.struct(F.col("parent_key").alias("at"), F.lit(None).cast("string").alias("known"), F.struct(*payload).alias("child"))
    twice = nodes.select("problem_id", F.inline(F.array(own, child)))
    parent = F.max("known").over(Window.partitionBy("problem_id", "at"))
    met = twice.withColumn("parent", F.when(F.col("problem_id").isNotNull(), parent)).where("child is not null")
    return met.select("problem_id", "child.*", F.coalesce("parent", F.lit("root")).alias("parent_id"))


def _numbered(paths: DataFrame) -> DataFrame:
    """problem_id, path, hits, first_branch -> nodes with ids, parents and the root."""
    nodes = _with_ids(paths.withColumns({"depth": F.size("path"), "key": _path_key(F.col("path"))}))
    up = F.slice("path", 1, F.col("depth") - 1)
    out = _with_parents(nodes.withColumn("parent_key", F.when(F.col("depth") > 1, _path_key(up))))
    return _with_roots(out.select("problem_id", "pos", "node_id", "parent_id", "depth", F.col("path").alias("step_path"), "hits"))


def _with_roots(nodes: DataFrame) -> DataFrame:
    """Nodes with their texts; a problem's first node brings the root."""
    node = F.struct(
        "pos", "node_id", "parent_id", "depth", F.try_element_at("step_path", F.lit(-1)).alias("step_text"), join_steps(F.col("step_path")).alias("prefix_text"), "step_path",
        F.col("hits").alias("path_hits"),
    )
    root = F.struct(
        F.lit(0).alias("pos"), F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.lit("").alias("step_text"),
        F.lit("").alias("prefix_text"), F.array().cast("array<string>").alias("step_path"), F.lit(1).cast("bigint").alias("path_hits"),
    )
    return nodes.select("problem_id", F.inline(F.when(F.col("pos") == 1, F.array(root, node)).otherwise(F.array(node))))


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("problem_id", _path_key(F.col("path"))).agg(F.first("path").alias("path"), F.count("*").alias("hits"), F.min("branch").alias("first_branch")).select("problem_id", "path", "hits", "first_branch")


def prefix_tree(completions: DataFrame, max_depth: int | None = None, **steps) -> DataFrame:
    """Whole reasoning paths (problem_id, branch_index, completion): every prefix (of at most max_depth steps, if given) is a
    node, counted by the completions that share it. Completions without steps give nothing; a problem without any gives no
    root.

    A prefix is named by a hash that each step extends, so what is grouped, numbered and joined to its parent holds no text;
    a node's steps come from one completion that has it, at the end."""
    split = split_steps(F.col("completion"), **steps)
    if max_depth:
        split = F.slice(split, 1, max_depth)
    # No filter on steps or keys: it would be moved below and compute them once more.
    paths = completions.select("problem_id", F.col("branch_index").alias("branch"), split.alias("steps"))
    hashed = lambda done, step: F.unhex(F.sha2(F.concat(F.coalesce(F.lower(F.hex(F.try_element_at(done, F.lit(-1)))), F.lit("")), F.lit("\x01"), step), 256))
    paths = paths.withColumn("keys", F.aggregate("steps", F.array().cast("array<binary>"), lambda done, step: F.concat(done, F.array(hashed(done, step)))))
    whole = F.struct("branch", F.try_element_at("keys", F.lit(-1)).alias("end"))
    prefix = lambda key, i: F.struct((i + 1).alias("depth"), key.alias("key"), F.when(i > 0, F.try_element_at("keys", F.when(i > 0, i))).alias("parent_key"))
    prefixes = paths.select("problem_id", whole.alias("whole"), F.inline(F.transform("keys", prefix)))
    nodes = prefixes.groupBy("problem_id", "key").agg(F.count("*").alias("hits"), F.min("whole").alias("whole"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"))
    nodes = _with_parents(_with_ids(nodes.withColumn("first_branch", F.col("whole.branch"))))
    texts = paths.select("problem_id", whole.alias("whole"), "steps").dropDuplicates(["problem_id", "whole"]).select(F.col("problem_id").alias("p"), F.col("whole").alias("w"), "steps")
    out = nodes.join(texts, F.col("problem_id").eqNullSafe(F.col("p")) & (F.col("whole") == F.col("w")))
    return _with_roots(out.select("problem_id", "pos", "node_id", "parent_id", "depth", F.slice("steps", 1, F.col("depth")).alias("step_path"), "hits"))


def _branches(expansions: DataFrame, **steps) -> DataFrame:
    path = F.col("parent_path") if "parent_path" in expansions.columns else F.array().cast("array<string>")
    return expansions.select("problem_id", F.col("branch_index").alias("branch"), "completion", path.alias("parent_path"), first_step(F.col("completion"), **steps).alias("step"))


def expansion_tree(expansions: DataFrame, **steps) -> DataFrame:
    """Sampled expansions (problem_id, branch_index, completion, optionally parent_path): the first step of each is a child of
    its parent path. A parent path that is no node itself hangs below the root."""
    return _numbered(_grouped(_step_paths(expansions, **steps)).where("path is not null"))


def _step_paths(expansions: DataFrame, **steps) -> DataFrame:
    """Branches with the path of their step, null without one."""
    return _branches(expansions, **steps).withColumn("path", F.when(F.col("step").isNotNull(), F.concat("parent_path", F.array("step"))))


def expansion_log(expansions: DataFrame, values: DataFrame | None = None, **steps) -> DataFrame:
    """Per branch: first step, child and status (empty_step, created by the first branch of a path, reused by later ones).

    values (problem_id, node_id, q_value, evaluation_mode) adds the child's q_value to created and reused branches and its
    evaluation_mode to created ones; other branches have null. Branches are numbered as expansion_tree numbers their paths."""
    rows = _step_paths(expansions, **steps).withColumns({"key": _path_key(F.col("path")), "depth": F.when(F.col("path").isNotNull(), F.size("path"))}).drop("path", "parent_path")
    alike = Window.partitionBy("problem_id", "key")
    rows = rows.withColumns({"turn": F.row_number().over(alike.orderBy("branch", "completion")), "first_branch": F.min("branch").over(alike)})
    rows = rows.withColumn("pos", F.dense_rank().over(Window.partitionBy("problem_id").orderBy(F.asc_nulls_last("depth"), "first_branch", "key")))
    status = F.when(F.col("step").isNull(), "empty_step").when(F.col("turn") == 1, "created").otherwise("reused")
    child = F.when(F.col("problem_id").isNotNull() & F.col("step").isNotNull(), _node_name(F.col("pos")))
    log = rows.select("problem_id", F.col("branch").alias("branch_index"), F.col("completion").alias("raw_completion"), F.col("step").alias("first_step_text"), child.alias("child_node_id"), status.alias("status"))
    if values is None:
        return log
    known = values.select("problem_id", F.col("node_id").alias("child_node_id"), "q_value", "evaluation_mode")
    return log.join(known, ["problem_id", "child_node_id"], "left").select(*log.columns, "q_value", F.when(F.col("status") == "created", F.col("evaluation_mode")).alias("evaluation_mode"))


def link_children(nodes: DataFrame) -> DataFrame:
    """nodes with children_ids, in order; an empty list for leaves."""
    one = F.struct("pos", "node_id")
    own = nodes.where("parent_id is not null").groupBy("problem_id", F.col("parent_id").alias("node_id")).agg(F.sort_array(F.collect_list(one)).alias("c"))
    joined = nodes.join(own, ["problem_id", "node_id"], "left")
    return joined.withColumn("children_ids", F.coalesce(F.col("c.node_id"), F.array().cast("array<string>"))).drop("c")


def grade_rollouts(rollouts: DataFrame, nodes: DataFrame | None = None, problems: DataFrame | None = None) -> DataFrame:
    """Rollouts (problem_id, node_id, rollout_index, continuation_text) with the graded whole prediction. prefix_text and answer
    come from nodes and problems where given, else from rollouts; they are graded before anything wide is shuffled again."""
    if nodes is not None:
        rollouts = rollouts.drop("prefix_text").join(nodes.select("problem_id", "node_id", "prefix_text"), ["problem_id", "node_id"])
    if problems is not None:
        rollouts = rollouts.drop("answer").join(problems.select("problem_id", "answer"), "problem_id")
    whole = rollouts.withColumn("full_prediction", merge_prediction(F.col("prefix_text"), F.col("continuation_text")))
    return grade(whole, "full_prediction", "answer", strict=True)


def estimate_values(nodes: DataFrame, graded: DataFrame, answers: DataFrame, keep_rollouts: bool = False) -> DataFrame:
    """q_value, success_count, rollout_count, evaluation_mode and terminal_correct of each node.

    A prefix with an answer tag is graded itself (terminal, one rollout); else its rollouts' share of right answers, 0.0
    for none. nodes: problem_id, node_id, prefix_text; graded: from grade_rollouts; answers: problem_id, answer.
    """
    aggs = [F.count_if("is_correct").alias("successes"), F.count("*").alias("n")]
    if keep_rollouts:
        aggs.append(keep_rollouts_column())
    sums = graded.groupBy("problem_id", "node_id").agg(*aggs)
    done = grade(nodes.join(answers.select("problem_id", "answer"), "problem_id", "left"), "prefix_text", "answer", strict=True)
    terminal = extract_answer_tag(F.coalesce("prefix_text", F.lit(""))).isNotNull()
    n, good = F.coalesce("n", F.lit(0)), F.coalesce("successes", F.lit(0))
    right = F.col("is_correct").cast("bigint")
    out = done.join(sums, ["problem_id", "node_id"], "left").select(
        *nodes.columns, F.when(terminal, right.cast("double")).otherwise(good / F.greatest(n, F.lit(1))).alias("q_value"), F.when(terminal, right).otherwise(good).alias("success_count"),
        F.when(terminal, F.lit(1)).otherwise(n).alias("rollout_count"), F.when(terminal, "terminal").otherwise("rollout").alias("evaluation_mode"), F.when(terminal, F.col("is_correct")).alias("terminal_correct"),
        *([F.when(terminal, F.array().cast(_kind(sums, "rollout_records"))).otherwise(F.coalesce("rollout_records", F.array().cast(_kind(sums, "rollout_records")))).alias("rollout_records")] if keep_rollouts else []),
    )
    return out


def _kind(df: DataFrame, column: str):
    return df.schema[column].dataType


def keep_rollouts_column() -> Column:
    """The graded rollouts of a group, in order."""
    return F.sort_array(F.collect_list(F.struct("rollout_index", "continuation_text", "full_prediction", "is_correct", "comparison_mode", "extracted_prediction"))).alias("rollout_records")


def keep_rollouts(graded: DataFrame) -> DataFrame:
    return graded.groupBy("problem_id", "node_id").agg(keep_rollouts_column())


def mark_terminal(valued: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """is_terminal: the prefix has an answer, or no deeper step is allowed."""
    return valued.withColumn("is_terminal", (F.col("evaluation_mode") == "terminal") | (F.col("depth") >= max_depth))


def visits_of_events(events: DataFrame) -> DataFrame:
    """Search events (problem_id, simulation_index, selected_path, backed_up_value, event_type, and for expand_backup the best
    child in best_child_id) as one row per visited node."""
    path = F.when((F.col("event_type") == "expand_backup") & F.col("best_child_id").isNotNull(), F.concat("selected_path", F.array("best_child_id"))).otherwise(F.col("selected_path"))
    return events.select("problem_id", "simulation_index", F.explode(path).alias("node_id"), "backed_up_value")


def backup(visits: DataFrame) -> DataFrame:
    """visit_count and total_value of each visited node."""
    return visits.groupBy("problem_id", "node_id").agg(F.count("*").alias("visit_count"), F.sum("backed_up_value").alias("total_value"))


def mean_value(visits: Column, total: Column, q: Column) -> Column:
    return F.when(visits > 0, total / visits).otherwise(F.coalesce(q, F.lit(0.0)))


def ucb_scores(nodes: DataFrame, c: float = 1.4) -> DataFrame:
    """Children with their upper confidence bound under the parent's visits: problem_id, parent_id, node_id, pos, score."""
    parents = nodes.select("problem_id", F.col("node_id").alias("parent_id"), F.col("visit_count").alias("parent_visits"))
    children = nodes.where("parent_id is not null").join(parents, ["problem_id", "parent_id"])
    spread = F.log(F.col("parent_visits") + 2)
    prior, n = F.coalesce("q_value", F.lit(0.0)), F.col("visit_count")
    new = prior + F.lit(c) * F.sqrt(spread)
    seen = mean_value(n, F.col("total_value"), F.col("q_value")) + F.lit(c) * F.sqrt(spread / F.when(n > 0, n)) + F.lit(0.05) * prior
    return children.select("problem_id", "parent_id", "node_id", "pos", F.when(n > 0, seen).otherwise(new).alias("score"))


def best_child(scores: DataFrame, digits: int = 9) -> DataFrame:
    """The child of the highest score of each parent; of equal scores (rounded) the first child."""
    order = Window.partitionBy("problem_id", "parent_id").orderBy(F.desc(F.round("score", digits)), "pos")
    return scores.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def select_path(best: DataFrame, problems: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """problem_id and the path from the root along best children, at most max_depth steps: one join per step over one edge per parent."""
    edges = best.select("problem_id", F.col("parent_id").alias("last"), F.col("node_id").alias("next"))
    start = problems.select("problem_id").distinct().select("problem_id", F.array(F.lit("root")).alias("path"), F.lit("root").alias("last"))

    def longer(paths: DataFrame, _: int) -> DataFrame:
        grown = paths.join(edges, ["problem_id", "last"], "left")
        more = F.col("next").isNotNull()
        return grown.select("problem_id", F.when(more, F.concat("path", F.array("next"))).otherwise(F.col("path")).alias("path"), F.when(more, F.col("next")).alias("last"))

    return reduce(longer, range(max_depth), start).select("problem_id", "path")


def select_deep_path(best: DataFrame, problems: DataFrame, folder: str, max_depth: int | None = None) -> DataFrame:
    """As select_path for paths of any length, with joins in proportion to the logarithm of the longest.

    Edges are doubled until none is left: a table of jumps over 2, 4, 8 ... steps each. From the root, the nodes at all depths are
    found by the widest jump first, each narrower one adding those between. Every table is written below folder, so that
    plans stay small; a node has one row in each, and a path is gathered at the end alone."""

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    jumps = [written(best.select("problem_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("next")), "jumps-1")]
    while max_depth is None or 1 << len(jumps) <= max_depth:
        onward = jumps[-1].select("problem_id", F.col("node_id").alias("next"), F.col("next").alias("end"))
        longer = written(jumps[-1].join(onward, ["problem_id", "next"]).select("problem_id", "node_id", F.col("end").alias("next")), f"jumps-{1 << len(jumps)}")
        if longer.isEmpty():
            break
        jumps.append(longer)
    found = problems.select("problem_id").distinct().select("problem_id", F.lit("root").alias("node_id"), F.lit(0).alias("depth"))
    for k in reversed(range(len(jumps))):
        more = found.join(jumps[k], ["problem_id", "node_id"]).select("problem_id", F.col("next").alias("node_id"), (F.col("depth") + (1 << k)).alias("depth"))
        found = written(found.unionByName(more.where(F.col("depth") <= max_depth) if max_depth is not None else more), f"found-{1 << k}")
    return found.groupBy("problem_id").agg(F.sort_array(F.collect_list(F.struct("depth", "node_id"))).alias("p")).select("problem_id", F.col("p.node_id").alias("path"))


def tree_statistics(nodes: DataFrame, visits: DataFrame | None = None) -> DataFrame:
    """node_count, initial_branch_count, max_depth_reached and extreme values of each problem; with visits also simulation_count."""
    out = nodes.groupBy("problem_id").agg(
        F.count("*").alias("node_count"), F.count_if(F.col("depth") == 1).alias("initial_branch_count"), F.max("depth").alias("max_depth_reached"),
        F.max("q_value").alias("max_q_value"), F.min("q_value").alias("min_q_value"),
    )
    if visits is None:
        return out
    runs = visits.groupBy("problem_id").agg(F.count_distinct("simulation_index").alias("simulation_count"))
    return out.join(runs, "problem_id", "left").withColumn("simulation_count", F.coalesce("simulation_count", F.lit(0)))


def event_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("backed_up_value").alias("avg_value"))


def _listed(rows: DataFrame, order: str, name: str) -> DataFrame:
    """problem_id and its rows as an array of structs in order."""
    fields = [order, *[c for c in rows.columns if c not in ("problem_id", order)]]
    return rows.groupBy("problem_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def tree_records(problems: DataFrame, nodes: DataFrame, paths: DataFrame, events: DataFrame) -> DataFrame:
    """Full tree records: problem_id, question, prompt, reference_answer, reference_answer_numeric, nodes, initial_paths,
    simulation_events and statistics.

    problems: from prepare_problems; paths: the root's expansion_log; events: problem_id, simulation_index and more. A
    problem without nodes, paths or events has empty lists and counts of 0; its extreme values are null."""
    nested = assemble_trees(problems, nodes).join(_listed(paths, "branch_index", "initial_paths"), "problem_id", "left").join(_listed(events, "simulation_index", "simulation_events"), "problem_id", "left")
    lists = ("nodes", "initial_paths", "simulation_events")
    nested = nested.withColumns({c: F.coalesce(c, F.array().cast(_kind(nested, c))) for c in lists})
    statistics = F.struct(
        F.size("nodes").alias("node_count"), F.size("initial_paths").alias("initial_branch_count"), F.size("simulation_events").alias("simulation_count"),
        F.coalesce(F.array_max("nodes.depth"), F.lit(0)).alias("max_depth_reached"), F.array_max("nodes.q_value").alias("max_q_value"), F.array_min("nodes.q_value").alias("min_q_value"),
    )
    return nested.select(
        "problem_id", "question", "prompt", F.col("final_answer").alias("reference_answer"), F.col("final_answer_numeric").alias("reference_answer_numeric"), *lists, statistics.alias("statistics")
    )


def assemble_trees(problems: DataFrame, nodes: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Nested trees from flat tables, for export: problems' columns, nodes in order, and events in order where given."""
    fields = [c for c in nodes.columns if c not in ("problem_id", "pos")]
    own = nodes.groupBy("problem_id").agg(F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("nodes"))
    own = own.withColumn("nodes", F.transform("nodes", lambda x: F.struct(*[x[f].alias(f) for f in fields])))
    out = problems.join(own, "problem_id", "left")
    if events is not None:
        out = out.join(_listed(events, "simulation_index", "simulation_events"), "problem_id", "left")
    return out
