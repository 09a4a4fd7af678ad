"""Preference pairs of sibling steps.

Flat nodes: problem_id, pos (order within the problem), node_id, parent_id, depth, step_text, prefix_text and scores, and
optionally evaluation_mode. Nested trees: problem_id, prompt, question, nodes (array of structs in order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_block, strip

#: Fixed value: the request that ends a step prompt.
PROMPT_SUFFIX = (
    "Continue from the current reasoning state and generate only the next best reasoning step. "
    "Do not restart the full solution. "
    "If this next step should finish the problem, put the final answer inside <answer>...</answer>."
)
#: Fixed value: the prompt of a problem that has a question only.
DEFAULT_PROMPT = (
    "You are a careful math reasoning assistant.\n"
    "Solve the problem step by step.\n"
    "Put the final answer inside <answer>...</answer>.\n\n"
    "Question:\n"
)
CLASSES = ("missing_score", "same_text", "small_gap", "tie")
#: Children of one parent beyond which the left side of a pair is spread over tasks.
SPREAD = 10_000
_NODE = ("node_id", "pos", "depth", "step_text", "score", "evaluation_mode")


def explode_nodes(trees: DataFrame) -> DataFrame:
    """One row per node with its place `pos`; nodes without an id are left out, null or empty lists give nothing."""
    flat = trees.select("problem_id", F.posexplode("nodes").alias("pos", "node")).where("node.node_id is not null")
    names = [f.name for f in trees.schema["nodes"].dataType.elementType.fields if f.name not in ("problem_id", "pos")]
    return flat.select("problem_id", "pos", *[F.col(f"node.{n}").alias(n) for n in names])


def step_prompt(prompt: Column, question: Column, prefix: Column, suffix: str = PROMPT_SUFFIX) -> Column:
    """Prompt (or a default one around the question; neither is an error), the state so far, and the request."""
    blank = lambda c: normalize_block(F.coalesce(c, F.lit("")))
    base, asked, state = blank(prompt), blank(question), blank(prefix)
    default = F.when(asked == "", F.raise_error(F.lit("a tree has neither prompt nor question")).cast("string")).otherwise(F.concat(F.lit(DEFAULT_PROMPT), asked))
    text = F.concat(
        F.when(base != "", base).otherwise(default), F.lit("\n\nCurrent reasoning state:\n"), F.when(state != "", state).otherwise("(empty)"), F.lit("\n\n" + suffix.strip())
    )
    return strip(text)


def _children(nodes: DataFrame, score_field: str) -> DataFrame:
    mode = F.col("evaluation_mode") if "evaluation_mode" in nodes.columns else F.lit(None).cast("string")
    text = normalize_block(F.coalesce("step_text", F.lit("")))
    return nodes.where("parent_id is not null and node_id is not null").select(
        "problem_id", "parent_id", "node_id", "pos", F.coalesce("depth", F.lit(0)).alias("depth"), text.alias("step_text"),
        F.col(score_field).cast("double").alias("score"), mode.alias("evaluation_mode"),
    )


def _parents(nodes: DataFrame) -> DataFrame:
    """One row per node id: the last of equal ids."""
    prefix = F.col("prefix_text") if "prefix_text" in nodes.columns else F.lit("")
    row = F.struct("pos", F.coalesce("depth", F.lit(0)).alias("depth"), normalize_block(F.coalesce(prefix, F.lit(""))).alias("prefix"))
    last = nodes.where("node_id is not null").groupBy("problem_id", F.col("node_id").alias("parent_id")).agg(F.max(row).alias("p"))
    return last.select("problem_id", "parent_id", F.col("p.depth").alias("parent_depth"), F.col("p.prefix").alias("parent_prefix_text"))


def sibling_groups(nodes: DataFrame, score_field: str = "q_value") -> DataFrame:
    """Parents with at least two children and a known node: problem_id, parent_id, n_children, group_pos (place of the first
    child), parent_depth, parent_prefix_text."""
    children = _children(nodes, score_field).groupBy("problem_id", "parent_id").agg(F.count("*").alias("n_children"), F.min("pos").alias("group_pos"))
    return children.where("n_children > 1").join(_parents(nodes), ["problem_id", "parent_id"])


def candidate_pairs(nodes: DataFrame, score_field: str = "q_value", spread: int = SPREAD) -> DataFrame:
    """All unordered pairs of siblings, left before right: an equi-join on the parent. Where parents have more than `spread`
    children, left rows are salted and right rows repeated, so a wide parent is many tasks."""
    groups = sibling_groups(nodes, score_field)
    children = _children(nodes, score_field)
    keys = ["problem_id", "parent_id"]
    salts = F.ceil(F.col("n_children") / spread).cast("int")
    left = children.join(groups, keys).withColumn("salt", F.pmod(F.col("pos").cast("int"), salts))
    right = children.join(groups.select(*keys, salts.alias("salts")), keys).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    left = left.select(*keys, "salt", "group_pos", "parent_depth", "parent_prefix_text", F.struct(*_NODE).alias("l"))
    right = right.select(*keys, "salt", F.struct(*_NODE).alias("r"))
    return left.join(right, [*keys, "salt"]).where("l.pos < r.pos").drop("salt")


def candidate_pairs_nested(trees: DataFrame, score_field: str = "q_value") -> DataFrame:
    """As candidate_pairs, in the row of a nested tree: no shuffle, so it also serves streams."""
    fields = [f.name for f in trees.schema["nodes"].dataType.elementType.fields]
    have = lambda name, kind: f"n.{name}" if name in fields else f"cast(null as {kind})"
    block = lambda e: rf"regexp_replace(replace(replace(coalesce({e}, ''), '\r\n', '\n'), '\r', '\n'), '(?U)^\\s+|\\s+\\z', '')"
    node = (
        f"struct(n.node_id as node_id, cast(i as int) as pos, coalesce({have('depth', 'int')}, 0) as depth, {block(have('step_text', 'string'))} as step_text,"
        f" cast(n.{score_field} as double) as score, {have('evaluation_mode', 'string')} as evaluation_mode,"
        f" n.parent_id as parent_id, {block(have('prefix_text', 'string'))} as prefix)"
    )
    all_nodes = f"filter(transform(nodes, (n, i) -> {node}), n -> n.node_id is not null)"
    kept = [c for c in trees.columns if c != "nodes"]
    rows = trees.select(*kept, F.expr(all_nodes).alias("ns"))
    parents = rows.select(*kept, "ns", F.explode(F.expr("array_distinct(transform(filter(ns, n -> n.parent_id is not null), n -> n.parent_id))")).alias("parent_id"))
    own = parents.select(*kept, "parent_id", F.expr("filter(ns, n -> n.parent_id = parent_id)").alias("c"), F.expr("element_at(filter(ns, n -> n.node_id = parent_id), -1)").alias("p"))
    parents = own.where("size(c) > 1 and p is not null")
    plain = "struct(x.node_id, x.pos, x.depth, x.step_text, x.score, x.evaluation_mode)"
    pairs = f"flatten(transform(c, (a, i) -> transform(slice(c, i + 2, size(c)), b -> struct({plain.replace('x.', 'a.')} as l, {plain.replace('x.', 'b.')} as r))))"
    return parents.select(
        *kept, "parent_id", F.expr("array_min(transform(c, x -> x.pos))").alias("group_pos"), F.col("p.depth").alias("parent_depth"), F.col("p.prefix").alias("parent_prefix_text"), F.explode(F.expr(pairs)).alias("x")
    ).select(*kept, "parent_id", "group_pos", "parent_depth", "parent_prefix_text", "x.l", "x.r")


def classify_pairs(pairs: DataFrame, min_gap: float = 0.2) -> DataFrame:
    """pairs with `class`: pair or the first reason against it. NaN compares with nothing, so it is a tie."""
    a, b = F.col("l.score"), F.col("r.score")
    gap = F.abs(a - b)
    kind = (
        F.when(a.isNull() | b.isNull() | (F.col("l.step_text") == "") | (F.col("r.step_text") == ""), "missing_score")
        .when(F.col("l.step_text") == F.col("r.step_text"), "same_text")
        .when(F.isnan(a) | F.isnan(b) | F.isnan(gap), "tie")
        .when(gap < min_gap, F.when(gap == 0, "tie").otherwise("small_gap"))
        .when(a == b, "tie")
        .otherwise("pair")
    )
    return pairs.withColumn("class", kind)


def oriented_pairs(classified: DataFrame, score_field: str = "q_value") -> DataFrame:
    """The kept pairs, higher score chosen, with ids and the places that order them."""
    left_wins = F.col("l.score") > F.col("r.score")
    pick = lambda first, name: F.when(left_wins, F.col(f"{'l' if first else 'r'}.{name}")).otherwise(F.col(f"{'r' if first else 'l'}.{name}"))
    out = classified.where("class = 'pair'")
    sides = {f"{side}_{new}": pick(first, old) for side, first in (("chosen", True), ("rejected", False)) for new, old in (("node_id", "node_id"), ("text", "step_text"), ("score", "score"), ("depth", "depth"), ("evaluation_mode", "evaluation_mode"))}
    out = out.withColumns({**sides, "left_pos": F.col("l.pos"), "right_pos": F.col("r.pos"), "score_field": F.lit(score_field)}).drop("l", "r", "class")
    name = F.concat_ws("__", F.coalesce(F.col("problem_id").cast("string"), F.lit("unknown")), "parent_id", "chosen_node_id", "rejected_node_id")
    return out.withColumns({"score_gap": F.col("chosen_score") - F.col("rejected_score"), "pair_id": name}).withColumnRenamed("parent_id", "parent_node_id")


def make_pairs(nodes: DataFrame, problems: DataFrame | None = None, score_field: str = "q_value", min_gap: float = 0.2, suffix: str = PROMPT_SUFFIX) -> DataFrame:
    """Flat nodes to preference pairs. problems (problem_id, prompt, question) adds step_prompt."""
    pairs = oriented_pairs(classify_pairs(candidate_pairs(nodes, score_field), min_gap), score_field)
    if problems is None:
        return pairs
    asked = problems.select("problem_id", *[F.col(c) if c in problems.columns else F.lit(None).cast("string").alias(c) for c in ("prompt", "question")])
    return pairs.join(asked, "problem_id").withColumn("step_prompt", step_prompt(F.col("prompt"), F.col("question"), F.col("parent_prefix_text"), suffix)).drop("prompt", "question")


def make_pairs_nested(trees: DataFrame, score_field: str = "q_value", min_gap: float = 0.2, suffix: str = PROMPT_SUFFIX) -> DataFrame:
    """Nested trees to preference pairs, row by row."""
    pairs = oriented_pairs(classify_pairs(candidate_pairs_nested(trees, score_field), min_gap), score_field)
    if not {"prompt", "question"} & set(trees.columns):
        return pairs
    have = lambda c: F.col(c) if c in trees.columns else F.lit(None).cast("string")
    return pairs.withColumn("step_prompt", step_prompt(have("prompt"), have("question"), F.col("parent_prefix_text"), suffix)).drop("prompt", "question")


def cap_pairs(pairs: DataFrame, most: int | None) -> DataFrame:
    """The first pairs of each problem by first child of the group, left and right place; null or not positive: all."""
    if not most or most <= 0:
        return pairs
    order = Window.partitionBy("problem_id").orderBy("group_pos", "left_pos", "right_pos")
    return pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


_META = [
    "problem_id", "parent_node_id", "parent_depth", "parent_prefix_text", "chosen_node_id", "rejected_node_id", "chosen_score", "rejected_score",
    "score_gap", "score_field", "chosen_depth", "rejected_depth", "chosen_evaluation_mode", "rejected_evaluation_mode",
]


def render(pairs: DataFrame, layout: str = "sharegpt") -> DataFrame:
    """Pairs with step_prompt in a training layout: sharegpt, alpaca or generic; each with the metadata columns."""
    said = lambda who, c: F.struct(F.lit(who).alias("from"), F.col(c).alias("value"))
    body = {
        "sharegpt": [F.array(said("human", "step_prompt")).alias("conversations"), said("gpt", "chosen_text").alias("chosen"), said("gpt", "rejected_text").alias("rejected")],
        "alpaca": [F.col("step_prompt").alias("instruction"), F.lit("").alias("input"), F.col("chosen_text").alias("chosen"), F.col("rejected_text").alias("rejected")],
        "generic": ["step_prompt", F.col("chosen_text").alias("chosen"), F.col("rejected_text").alias("rejected")],
    }
    if layout not in body:
        raise ValueError(f"unknown layout: {layout}")
    return pairs.select(F.col("pair_id").alias("id"), *body[layout], *_META)


def pair_stats(classified: DataFrame) -> DataFrame:
    """Per problem, before any cap: parent_groups, paired_groups, pairs and pairs skipped by reason."""
    is_pair = F.col("class") == "pair"
    return classified.groupBy("problem_id").agg(
        F.count_distinct("parent_id").alias("parent_groups"), F.count_distinct(F.when(is_pair, F.col("parent_id"))).alias("paired_groups"), F.count_if(is_pair).alias("pairs"),
        *[F.count_if(F.col("class") == c).alias(f"skipped_{c}") for c in CLASSES],
    )


def pair_summary(problems: DataFrame, classified: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: problems, pairs after the cap, shares and averages (0.0 for none), counts before the cap."""
    per = problems.select("problem_id").join(kept.groupBy("problem_id").agg(F.count("*").alias("n")), "problem_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    first = per.agg(
        F.count("*").alias("input_problem_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("output_pair_count"), F.count("n").alias("problems_with_pairs"),
        zero(F.avg(F.when(F.col("n").isNotNull(), 1.0).otherwise(0.0))).alias("problem_pair_ratio"), zero(F.avg(F.coalesce("n", F.lit(0)))).alias("avg_pairs_per_problem"),
    )
    averages = kept.agg(*[zero(F.avg(c)).alias(f"avg_{c}") for c in ("chosen_score", "rejected_score", "score_gap", "parent_depth")])
    stats = pair_stats(classified)
    counts = stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in stats.columns if c not in ("problem_id", "pairs")])
    one = F.lit(1).alias("one")
    return first.select(one, "*").join(averages.select(one, "*"), "one").join(counts.select(one, "*"), "one").drop("one")
