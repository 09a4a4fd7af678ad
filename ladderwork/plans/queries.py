"""One query per operator over the given tables, with the SQL that DuckDB must agree on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as X
from ..operators import grading, pairs, problems, search, trees
from ..sources import records, saved
from ..streaming import jobs
from .inputs import SQL as INPUTS
from .inputs import derived, with_derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, source: str, sql: str | None, make: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, d: make(derived(spark, d, source))
    if sql:
        ORACLE_SQL[name] = with_derived(source, sql)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; on a single machine, where none is set, below a temporary one."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="ladderwork-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- SQL of scalar functions -------------------------------------------------------------------------------------------

_TAG = r"(?is)<answer>\s*(.*?)\s*</answer>"
_REF = r"(?m)####\s*(.+?)\s*$"
_NUM = r"[-+]?(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+)%?"


def _ws(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _nws(x: str) -> str:
    return _ws(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def _sop(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[\s.。!！?？,，;；:]+$', ''), '^[\s$￥£€:：]+', '')"


def _canon(x: str) -> str:
    return f"lower(upper({_sop(_nws(x))}))"


def _norm(x: str) -> str:
    return f"translate({_sop(_nws(x))}, '−．／$￥£€,， ', '-./')"


def _tag(x: str) -> str:
    return f"case when regexp_matches({x}, '{_TAG}') then {_ws(f"regexp_extract({x}, '{_TAG}', 1)")} end"


def _ref(x: str) -> str:
    return f"case when regexp_matches({x}, '{_REF}') then {_ws(f"regexp_extract({x}, '{_REF}', 1)")} end"


def _last(x: str) -> str:
    return f"regexp_extract_all({x}, '{_NUM}')[-1]"


def _double(n: str) -> str:
    """Value of a normalized number as a double, for shapes that the derived inputs have."""
    return (
        rf"case when regexp_matches({n}, '^[+-]?(\d+(\.\d*)?|\.\d+)%?$') then cast(rtrim({n}, '%') as double) / (case when {n} like '%!%' escape '!' then 100 else 1 end)"
        rf" when regexp_matches({n}, '^[+-]?\d+/\d+$') and cast(split_part({n}, '/', 2) as double) <> 0 then cast(split_part({n}, '/', 1) as double) / cast(split_part({n}, '/', 2) as double) end"
    )


def _block(x: str) -> str:
    return _ws(f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))")


_LIST_WS = r"list_filter(list_transform({}, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


def _steps_sql(source: str, keys: str, text: str) -> str:
    """CTEs blocks(keys, b), pieces (m, l: by markers, by lines) and steps(keys, s: list)."""
    marked = r"string_split(regexp_replace(b, '(?i)(Step\s+\d+\s*:)', chr(1) || '\1', 'g'), chr(1))"
    return rf"""
    blocks as (select {keys}, {_block(f"coalesce({text}, '')")} as b from {source}),
    pieces as materialized (select *, case when len(regexp_extract_all(b, '(?i)Step\s+\d+\s*:')) >= 2 then {_LIST_WS.format(f"{marked}[2:]")} else [] end as m,
      {_LIST_WS.format("string_split(b, chr(10))")} as l from blocks),
    steps as materialized (select {keys}, m, l, b, list_filter(list_transform(case when len(m) > 0 then m when len(l) > 1 then l else [b] end,
      lambda x: {_ws("substr(" + _ws("x") + ", 1, 512)")}), lambda x: x <> '') as s from pieces)
    """


# --- sources and sinks -------------------------------------------------------------------------------------------------

_PREDICTION = "source_index bigint, sample_index int, answer string, prediction string"


def _read_records(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "records")
    records.write_records(derived(spark, d, "fx_predictions"), path)
    return records.read_records(spark, path, _PREDICTION)


def _append_records(spark: SparkSession, d: str) -> DataFrame:
    path, nodes = scratch(spark, "append"), derived(spark, d, "fx_nodes")
    for part in (nodes.where("pos = 0"), nodes.where("pos > 0"), nodes.where("pos < 0")):
        records.append_records(part, path, "parquet")
    return spark.read.schema(nodes.schema).parquet(path)


QUERIES["read_records"] = _read_records
ORACLE_SQL["read_records"] = with_derived("fx_predictions", "select * from fx_predictions")
QUERIES["append_records"] = _append_records
ORACLE_SQL["append_records"] = with_derived("fx_nodes", "select * from fx_nodes")
_query("limit_problems", "fx_problems", "select * from fx_problems order by source_index limit 1000", lambda p: records.limit_problems(p, 1000))
_done = lambda p: p.where("source_index % 3 = 0").select("source_index")
_query("resume_filter", "fx_problems", "select * from fx_problems where source_index % 3 <> 0", lambda p: records.resume_filter(p, _done(p), "source_index"))
_query(
    "run_summary", "fx_problems",
    "select count(*) as input_count, count(*) filter (source_index % 3 = 0) as skipped_count, count(*) filter (source_index % 3 <> 0) as new_count, count(*) as output_count, 'complete' as status, 2 as rollouts from fx_problems",
    lambda p: records.run_summary(p, _done(p), "source_index", rollouts=2),
)



def _problem_splits(spark: SparkSession, d: str) -> DataFrame:
    path, asked = scratch(spark, "splits"), derived(spark, d, "fx_problems")
    for split, rest in (("train", 0), ("test", 1)):
        records.write_records(asked.where(F.col("source_index") % 2 == rest), f"{path}/{split}", "parquet")
    return records.read_problem_splits(spark, path)


def _saved_dataset(spark: SparkSession, d: str) -> DataFrame:
    """All problems saved as a collection of Arrow shards, and read from it again."""
    path, asked = scratch(spark, "saved"), derived(spark, d, "fx_problems")
    saved.save_dataset(asked.withColumn("split", F.when(F.col("source_index") % 5 == 0, "test").otherwise("train")), path)
    return saved.read_saved_dataset(spark, path)


QUERIES["saved_dataset"] = _saved_dataset
ORACLE_SQL["saved_dataset"] = with_derived("fx_problems", "select source_index, question, answer, case when source_index % 5 = 0 then 'test' else 'train' end as split from fx_problems")


def _existing_output(spark: SparkSession, d: str) -> DataFrame:
    """Writes in two parts; the guard refuses the second until it is told to append. guarded: how often it refused."""
    path, asked = scratch(spark, "guarded"), derived(spark, d, "fx_problems")
    first, second = asked.where("source_index % 4 = 0"), asked.where("source_index % 4 = 1")
    records.write_records(asked, path, "parquet")
    records.write_records(first, path, "parquet", "overwrite")
    refused = 0
    try:
        records.write_records(second, path, "parquet")
    except AnalysisException:
        refused = 1
    records.write_records(second, path, "parquet", "append")
    return spark.read.schema(asked.schema).parquet(path).withColumn("guarded", F.lit(refused))


def _summary(spark: SparkSession, d: str) -> DataFrame:
    path, asked = scratch(spark, "summary"), derived(spark, d, "fx_problems")
    row = records.run_summary(asked, _done(asked), "source_index", rollouts=2)
    records.write_summary(row, path)
    return records.read_records(spark, path, row.schema)


def _descriptor(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors of two files of all problems, as the summary row that goes beside them."""
    named = derived(spark, d, "fx_problems").agg(F.count("*").alias("n_rows")).select("n_rows", *[records.dataset_descriptor(x, f"{x}.jsonl", x) for x in ("sharegpt", "alpaca", "generic")])
    one, two = "sharegpt", "alpaca"
    return named.select(
        "n_rows", *[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in (one, two) for c in ("file_name", "ranking")], F.col(f"{one}.formatting").alias("sharegpt_formatting"),
        F.col(f"{one}.columns.messages").alias("messages"), F.col(f"{two}.columns.prompt").alias("prompt"), F.col(f"{two}.columns.query").alias("query"), F.col(f"{two}.columns.rejected").alias("rejected"), F.col("generic"),
    )


def _write_resumed(spark: SparkSession, d: str) -> DataFrame:
    """What is written beside what was there, each row with the summary's counts."""
    path, asked = scratch(spark, "resumed"), derived(spark, d, "fx_problems")
    records.write_records(asked.where("source_index % 3 = 0"), path, "parquet")
    row = records.write_resumed(asked, spark.read.schema(asked.schema).parquet(path), path, "source_index", "parquet")
    return spark.read.schema(asked.schema).parquet(path).join(F.broadcast(row))


QUERIES["write_resumed"] = _write_resumed
ORACLE_SQL["write_resumed"] = with_derived(
    "fx_problems", "select p.*, c.* from fx_problems p, (select count(*) as input_count, count(*) filter (source_index % 3 = 0) as skipped_count, count(*) filter (source_index % 3 <> 0) as new_count, count(*) as output_count, 'complete' as status from fx_problems) c"
)
QUERIES |= {"read_problem_splits": _problem_splits, "existing_output": _existing_output, "write_summary": _summary, "dataset_descriptor": _descriptor}
ORACLE_SQL["read_problem_splits"] = with_derived("fx_problems", "select case when source_index % 2 = 0 then 'train' else 'test' end as split, source_index, question, answer from fx_problems")
ORACLE_SQL["existing_output"] = with_derived("fx_problems", "select *, 1 as guarded from fx_problems where source_index % 4 < 2")
ORACLE_SQL["write_summary"] = ORACLE_SQL["run_summary"]
ORACLE_SQL["dataset_descriptor"] = with_derived(
    "fx_problems",
    """select count(*) as n_rows, 'sharegpt.jsonl' as sharegpt_file_name, true as sharegpt_ranking, 'alpaca.jsonl' as alpaca_file_name, true as alpaca_ranking, 'sharegpt' as sharegpt_formatting,
      'conversations' as messages, 'instruction' as prompt, 'input' as query, 'rejected' as rejected, cast(null as varchar) as generic from fx_problems""",
)

# --- problems ----------------------------------------------------------------------------------------------------------

_raw = lambda p: p.withColumn("split", F.lit("train"))
_query("extract_reference", "fx_problems", f"select source_index, {_ref('answer')} as final_answer from fx_problems", lambda p: p.select("source_index", A.extract_reference(F.col("answer")).alias("final_answer")))
_query(
    "split_solution", "fx_problems", rf"select source_index, regexp_replace(split_part(answer, '####', 1), '\s+$', '') as solution, {_ref('answer')} as final_answer from fx_problems",
    lambda p: p.select("source_index", *[c.alias(n) for c, n in zip(problems.split_solution(F.col("answer")), ("solution", "final_answer"))]),
)
_FINAL = f"(select source_index, final_answer, {_norm('final_answer')} as n from (select source_index, {_ref('answer')} as final_answer from fx_problems))"
_FIXED = rf"""case when regexp_matches(n, '^[+-]?\d+(\.\d*)?%?$') then regexp_replace(rtrim(cast(cast(round(cast(rtrim(n, '%') as double) * (case when n like '%!%' escape '!' then 100 else 10000 end)) as decimal(30, 0)) / cast(10000 as decimal(5, 0)) as decimal(30, 4))::varchar, '0'), '\.$', '') end"""
_query(
    "canonical_decimal", "fx_problems", f"select source_index, {_FIXED} as number, round({_double('n')}, 6) as value from {_FINAL}",
    lambda p: p.select("source_index", A.extract_reference(F.col("answer")).alias("f")).select(
        "source_index", F.when(~F.contains("f", F.lit("/")), A.canonical_decimal(F.col("f"))).alias("number"), F.round(A.parse_numeric(F.col("f")), 6).alias("value")),
)
_query("parse_numeric", "fx_problems", f"select source_index, round({_double('n')}, 6) as value from {_FINAL}", lambda p: p.select("source_index", F.round(A.parse_numeric(A.extract_reference(F.col("answer"))), 6).alias("value")))
_PROMPT = "'" + problems.PROMPT_TEMPLATE.split("{question}")[0].replace("\n", "' || chr(10) || '") + "'"
#: Fractions of the derived answers as decimals: denominators of 1, 2 and 4 end, those of 3 have 28 digits.
_SHARE = """case when b = 3 and a % 3 > 0 then case when a > 3 then cast(a // 3 as varchar) else '0' end || '.' || case a % 3 when 1 then repeat('3', d) else repeat('6', d - 1) || '7' end
  else regexp_replace(rtrim(cast(cast(a as decimal(10, 2)) / b as decimal(10, 2))::varchar, '0'), '\\.$', '') end"""
_NUMERIC = f"""case when final_answer like '%/%' then (select {_SHARE} from (select a, b, case when a > 3 then 27 else 28 end as d from (select try_cast(split_part(final_answer, '/', 1) as int) as a, try_cast(split_part(final_answer, '/', 2) as int) as b)))
  else (select {_FIXED} from (select {_norm('final_answer')} as n)) end"""
_query(
    "prepare_problems", "fx_problems",
    rf"""select 'gsm8k-main-train-' || case when length(cast(source_index as varchar)) < 5 then lpad(cast(source_index as varchar), 5, '0') else cast(source_index as varchar) end as problem_id,
      'gsm8k' as dataset_name, 'main' as dataset_config, 'train' as split, source_index, question, regexp_replace(split_part(answer, '####', 1), '\s+$', '') as solution, answer, final_answer,
      '<answer>' || final_answer || '</answer>' as answer_tag, {_PROMPT} || question || chr(10) as prompt, {_NUMERIC} as final_answer_numeric from (select *, {_ref('answer')} as final_answer from fx_problems)""",
    lambda p: problems.prepare_problems(_raw(p)),
)
_RANK = "row_number() over (order by md5('{}-' || cast(source_index as varchar)), source_index)"
_query(
    "sample_train_dev", "fx_problems",
    f"""select question, answer, original_index, case when n <= 500 then 'train' else 'dev' end as split, case when n <= 500 then n - 1 else n - 501 end as source_index
      from (select question, answer, source_index as original_index, {_RANK.format(42)} as n from fx_problems) where n <= 700""",
    lambda p: problems.sample_train_dev(p, 500, 200, 42),
)
_query(
    "sample_test", "fx_problems", f"select question, answer, original_index, 'test' as split, n - 1 as source_index from (select question, answer, source_index as original_index, {_RANK.format(7)} as n from fx_problems) where n <= 300",
    lambda p: problems.sample_test(p, 300, 7),
)
_query(
    "split_summary", "fx_problems", "select split, count(*) as n, case split when 'train' then 900 when 'dev' then 100 end as asked, 42 as seed, 4 as n_fields from (select case source_index % 3 when 0 then 'dev' when 1 then 'test' else 'train' end as split from fx_problems) group by split",
    lambda p: problems.split_summary(p.withColumn("split", F.expr("case source_index % 3 when 0 then 'dev' when 1 then 'test' else 'train' end")), 42, train=900, dev=100),
)

# --- grading -----------------------------------------------------------------------------------------------------------


def _text_query(name: str, column: Callable, sql: Callable[[str], str]) -> None:
    _query(name, "fx_predictions", f"select source_index, sample_index, {sql('prediction')} as value from fx_predictions", lambda p: p.select("source_index", "sample_index", column(F.col("prediction")).alias("value")))


_text_query("extract_answer_tag", A.extract_answer_tag, _tag)
_text_query("extract_last_number", A.extract_last_number, _last)
_text_query("normalize_whitespace", X.normalize_whitespace, _nws)
_text_query("strip_outer_punctuation", X.strip_outer_punctuation, _sop)
_text_query("canonicalize_text", X.canonicalize_text, _canon)
_text_query("normalize_numeric", X.normalize_numeric, _norm)


def _graded_sql(source: str, keys: str, prediction: str, reference: str, strict: bool) -> str:
    """CTE graded over source with keys, is_correct, extracted_prediction, extracted_reference, comparison_mode."""
    lenient = f"coalesce(tag, {_last('p')})" if not strict else "tag"
    mode = "case when tag is not null then 'tag' else 'missing_answer_tag' end" if strict else f"case when tag is not null then 'tag' when {_last('p')} is not null then 'fallback_last_number' else 'missing_prediction_answer' end"
    number = lambda x: f"coalesce({_double(x + '_n')}, {_double(x + '_ln')})"
    return f"""
    g1 as (select *, {_tag('p')} as tag, coalesce({_ref('r')}, {_nws('r')}) as b from (select *, {prediction} as p, {reference} as r from {source})),
    g2 as (select *, {lenient} as a, {mode} as mode from g1),
    g3 as (select *, {_norm('a')} as a_n, {_norm('b')} as b_n, {_norm(_last('a'))} as a_ln, {_norm(_last('b'))} as b_ln from g2),
    g4 as (select *, {number('a')} as x, {number('b')} as y from g3),
    graded as (select {keys}, a as extracted_prediction, b as extracted_reference,
      case when a is null then false when x is not null and y is not null then x = y else {_canon('a')} = {_canon('b')} end as is_correct,
      case when a is null then mode when x is not null and y is not null then mode || '_numeric' else mode || '_text' end as comparison_mode,
      case when a is null then 'no_answer' when x is not null and y is not null then 'compared_as_numbers' else 'compared_as_texts' end as reason from g4)"""


def _with_graded(body: str, strict: bool = True) -> str:
    sql = with_derived("fx_predictions", "")
    return f"{sql}, {_graded_sql('fx_predictions', 'source_index, sample_index', 'prediction', 'answer', strict)} {body}"


def _grade_query(name: str, body: str, make: Callable[[DataFrame], DataFrame], strict: bool = True) -> None:
    QUERIES[name] = lambda spark, d: make(grading.grade(derived(spark, d, "fx_predictions"), strict=strict))
    ORACLE_SQL[name] = _with_graded(body, strict)


_grade_query("grade_predictions", "select * from graded", lambda g: g.drop("prediction", "answer"))
_grade_query("grade_lenient", "select * from graded", lambda g: g.drop("prediction", "answer"), strict=False)
_grade_query("select_prediction_answer", "select source_index, sample_index, extracted_prediction, comparison_mode from graded", lambda g: g.select("source_index", "sample_index", "extracted_prediction", "comparison_mode"), strict=False)
_grade_query("accuracy", "select cast(count(*) filter (is_correct) as bigint) as correct, count(*) as total, round(avg(case when is_correct then 1.0 else 0.0 end), 9) as accuracy from graded", lambda g: grading.accuracy(g).withColumn("accuracy", F.round("accuracy", 9)))
_grade_query("grade_breakdown", "select comparison_mode, is_correct, count(*) as n from graded group by rollup (comparison_mode, is_correct)", lambda g: grading.grade_breakdown(g, totals=True))

# --- steps -------------------------------------------------------------------------------------------------------------


def _steps_query(name: str, source: str, keys: list[str], text: str, column: Callable, sql: str, exploded: bool = True, table: bool = False) -> None:
    def make(df: DataFrame) -> DataFrame:
        if not exploded:
            return df.select(*keys, column(F.col(text)).alias("step"))
        return df.select(*keys, F.posexplode(column(F.col(text))).alias("n", "step"))

    body = f"select {', '.join(keys)}, {'step' if not exploded else 'cast(i - 1 as int) as n, s[i] as step'} from "
    body += f"(select {', '.join(keys)}, {sql} as step from steps)" if not exploded else f"(select {', '.join(keys)}, s, unnest(range(1, len(s) + 1)) as i from (select {', '.join(keys)}, {sql} as s from steps))"
    ctes = _steps_sql(source, ", ".join(keys), text)
    if table:
        QUERIES[name] = lambda spark, d: make(spark.read.parquet(f"{d}/{source}.parquet"))
        ORACLE_SQL[name] = f"with {ctes} {body}"
    else:
        QUERIES[name] = lambda spark, d: make(derived(spark, d, source))
        ORACLE_SQL[name] = f"{with_derived(source, '')}, {ctes} {body}"


_BRANCH = ["problem_id", "branch_index"]
_steps_query("normalize_block", "fx_completions", _BRANCH, "completion", X.normalize_block, "b", exploded=False)
_steps_query("split_on_markers", "fx_completions", _BRANCH, "completion", lambda c: X.split_on_markers(X.normalize_block(c)), "m")
_steps_query("split_on_lines", "fx_completions", _BRANCH, "completion", lambda c: X.split_on_lines(X.normalize_block(c)), "l")
_steps_query("truncate_step", "fx_completions", _BRANCH, "completion", lambda c: X.truncate_step(c, 40), _ws("substr(b, 1, 40)"), exploded=False)
_steps_query("split_steps", "fx_completions", _BRANCH, "completion", X.split_steps, "s")
_steps_query("first_step", "fx_completions", _BRANCH, "completion", X.first_step, "s[1]", exploded=False)
_steps_query("join_steps", "fx_completions", _BRANCH, "completion", lambda c: X.join_steps(X.split_steps(c)), "coalesce(array_to_string(s, chr(10)), '')", exploded=False)
_steps_query("split_steps_conversations", "conversations", ["conv_id", "turn"], "text", X.split_steps, "s", table=True)
_steps_query("split_on_lines_documents", "documents", ["doc_id"], "text", lambda c: X.split_on_lines(X.normalize_block(c)), "l", table=True)
_KEY3 = "problem_id, node_id, rollout_index"
_query(
    "continuation_prompt", "fx_rollouts", rf"select {_KEY3}, regexp_replace(answer, '\s+$', '') || chr(10) || case when regexp_replace(prefix_text, '\s+$', '') <> '' then regexp_replace(prefix_text, '\s+$', '') || chr(10) else '' end as prompt from fx_rollouts",
    lambda r: r.select(*_KEY3.split(", "), X.continuation_prompt(F.col("answer"), F.col("prefix_text")).alias("prompt")),
)
_MERGED = rf"case when regexp_replace(prefix_text, '\s+$', '') = '' then {_ws('continuation_text')} when {_ws('continuation_text')} = '' then regexp_replace(prefix_text, '\s+$', '') else regexp_replace(prefix_text, '\s+$', '') || chr(10) || {_ws('continuation_text')} end"
_query("merge_prediction", "fx_rollouts", f"select {_KEY3}, {_MERGED} as text from fx_rollouts", lambda r: r.select(*_KEY3.split(", "), X.merge_prediction(F.col("prefix_text"), F.col("continuation_text")).alias("text")))

# --- trees -------------------------------------------------------------------------------------------------------------

_TREE_SQL = """,
  paths as materialized (select problem_id, branch_index, {paths}),
  grouped as (select problem_id, path, count(*) as path_hits, min(branch_index) as first_branch, len(path) as depth, sha256(array_to_string(path, chr(1))) as key from paths group by problem_id, path),
  numbered as (select *, cast(row_number() over (partition by problem_id order by depth, first_branch, key) as int) as pos from grouped),
  named as materialized (select *, 'node-' || lpad(cast(pos as varchar), 5, '0') as node_id, case when depth > 1 then sha256(array_to_string(path[1:depth - 1], chr(1))) end as parent_key from numbered),
  tree as (select a.problem_id, a.pos, a.node_id, coalesce(b.node_id, 'root') as parent_id, cast(a.depth as int) as depth, a.path[-1] as step_text, array_to_string(a.path, chr(10)) as prefix_text, a.path_hits
    from named a left join named b on b.problem_id = a.problem_id and b.key = a.parent_key
    union all select distinct problem_id, 0, 'root', null, 0, '', '', 1 from paths)
"""
_STEPS = with_derived("fx_completions", "") + ", " + _steps_sql("fx_completions", "problem_id, branch_index", "completion")
_WHOLE = _STEPS + _TREE_SQL.format(paths="s[1:k] as path from (select *, unnest(range(1, len(s) + 1)) as k from steps)")
_FIRST = _STEPS + _TREE_SQL.format(paths="[s[1]] as path from steps where len(s) > 0")
_flat = lambda t: t.drop("step_path")
QUERIES["prefix_tree"] = lambda spark, d: _flat(trees.prefix_tree(derived(spark, d, "fx_completions")))
ORACLE_SQL["prefix_tree"] = _WHOLE + "select * from tree"
QUERIES["expansion_tree"] = lambda spark, d: _flat(trees.expansion_tree(derived(spark, d, "fx_completions")))
ORACLE_SQL["expansion_tree"] = _FIRST + "select * from tree"


def _logged(spark: SparkSession, d: str) -> DataFrame:
    values = derived(spark, d, "fx_nodes").select("problem_id", "node_id", "q_value", F.when(F.col("pos") % 2 == 0, "terminal").otherwise("rollout").alias("evaluation_mode"))
    return trees.expansion_log(derived(spark, d, "fx_completions"), values)


QUERIES["expansion_log"] = _logged
_LOG = """ log as (select l.*, case when status <> 'empty_step' then v.q_value end as q_value, case when status = 'created' then case when v.pos % 2 = 0 then 'terminal' when v.pos % 2 = 1 then 'rollout' end end as evaluation_mode
      from logged l left join fx_nodes v on v.problem_id = l.problem_id and v.node_id = l.child_node_id)"""
_LOGGED = (
    with_derived("fx_ucb", "") + ", fx_completions as (" + INPUTS["fx_completions"] + ")," + _FIRST[_FIRST.index("blocks as (") :]
    + """, logged as (select c.problem_id, c.branch_index, c.completion as raw_completion, s.s[1] as first_step_text, t.node_id as child_node_id,
      case when len(s.s) = 0 then 'empty_step' when row_number() over (partition by c.problem_id, s.s[1] order by c.branch_index, c.completion) = 1 then 'created' else 'reused' end as status
      from fx_completions c join steps s on s.problem_id = c.problem_id and s.branch_index = c.branch_index left join tree t on t.problem_id = c.problem_id and t.depth = 1 and t.step_text = s.s[1]),"""
    + _LOG
)
ORACLE_SQL["expansion_log"] = _LOGGED + " select * from log"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    return turns.select(F.col("conv_id").alias("problem_id"), F.col("turn").alias("branch_index"), F.col("text").alias("completion"))


QUERIES["prefix_tree_conversations"] = lambda spark, d: _flat(trees.prefix_tree(_turns(spark, d)))
ORACLE_SQL["prefix_tree_conversations"] = (
    "with turns as (select conv_id as problem_id, turn as branch_index, text as completion from conversations), " + _steps_sql("turns", "problem_id, branch_index", "completion")
    + _TREE_SQL.format(paths="s[1:k] as path from (select *, unnest(range(1, len(s) + 1)) as k from steps)") + "select * from tree"
)
_query(
    "link_children", "fx_nodes", "select c.problem_id, c.parent_id as node_id, cast(row_number() over (partition by c.problem_id, c.parent_id order by c.pos) - 1 as int) as n, c.node_id as child_id from fx_nodes c join fx_nodes p on p.problem_id = c.problem_id and p.node_id = c.parent_id",
    lambda n: trees.link_children(n).select("problem_id", "node_id", F.posexplode("children_ids").alias("n", "child_id")),
)


def _rollouts_sql(body: str) -> str:
    return f"{with_derived('fx_rollouts', '')}, merged as (select *, {_MERGED} as full_prediction from fx_rollouts), {_graded_sql('merged', _KEY3 + ', full_prediction, continuation_text', 'full_prediction', 'answer', True)} {body}"


QUERIES["grade_rollouts"] = lambda spark, d: trees.grade_rollouts(derived(spark, d, "fx_rollouts")).select(*_KEY3.split(", "), "full_prediction", "is_correct", "comparison_mode", "extracted_prediction")
ORACLE_SQL["grade_rollouts"] = _rollouts_sql(f"select {_KEY3}, full_prediction, is_correct, comparison_mode, extracted_prediction from graded")


def _valued(spark: SparkSession, d: str) -> DataFrame:
    rollouts = derived(spark, d, "fx_rollouts")
    nodes = derived(spark, d, "fx_nodes").select("problem_id", "node_id", "depth", F.col("step_text").alias("prefix_text"))
    tagged = nodes.withColumn("prefix_text", F.when(F.col("problem_id") % 5 == 0, F.concat("prefix_text", F.lit("<answer>12</answer>"))).otherwise(F.col("prefix_text")))
    answers = derived(spark, d, "fx_problems").select(F.col("source_index").alias("problem_id"), "answer")
    return trees.mark_terminal(trees.estimate_values(tagged, trees.grade_rollouts(rollouts), answers), 3).drop("prefix_text")


_VALUES = f"""
  sums as (select problem_id, node_id, count(*) as n, count(*) filter (is_correct) as good from graded group by problem_id, node_id),
  finals as (select source_index as problem_id, coalesce({_double('n')}, {_double('ln')}) as y from (select source_index, {_norm('f')} as n, {_norm(_last('f'))} as ln from (select source_index, {_ref('answer')} as f from fx_problems))),
  valued as (select n.problem_id, n.node_id, n.depth, n.problem_id % 5 = 0 as t, coalesce(f.y = 12, false) as hit, coalesce(s.n, 0) as n, coalesce(s.good, 0) as good
    from fx_nodes n left join sums s on s.problem_id = n.problem_id and s.node_id = n.node_id left join finals f on f.problem_id = n.problem_id)
  select problem_id, node_id, depth, case when t then cast(hit as double) else good / greatest(n, 1) end as q_value, case when t then cast(hit as bigint) else good end as success_count,
    case when t then 1 else n end as rollout_count, case when t then 'terminal' else 'rollout' end as evaluation_mode, case when t then hit end as terminal_correct, t or depth >= 3 as is_terminal from valued"""
QUERIES["estimate_values"] = _valued
ORACLE_SQL["estimate_values"] = _rollouts_sql(",").rstrip().rstrip(",") + "," + _VALUES
QUERIES["mark_terminal"] = lambda spark, d: _valued(spark, d).groupBy("evaluation_mode", "is_terminal").agg(F.count("*").alias("n"))
ORACLE_SQL["mark_terminal"] = ORACLE_SQL["estimate_values"].replace(_VALUES, _VALUES.replace("  select problem_id, node_id, depth, case when t then cast", "  select evaluation_mode, is_terminal, count(*) as n from (select case when t then cast") + ") group by all")
QUERIES["keep_rollouts"] = lambda spark, d: trees.keep_rollouts(trees.grade_rollouts(derived(spark, d, "fx_rollouts"))).select("problem_id", "node_id", F.inline("rollout_records"))
ORACLE_SQL["keep_rollouts"] = _rollouts_sql(f"select {_KEY3}, continuation_text, full_prediction, is_correct, comparison_mode, extracted_prediction from graded")
_query("backup", "fx_visits", "select problem_id, node_id, count(*) as visit_count, sum(backed_up_value) as total_value from fx_visits group by problem_id, node_id", trees.backup)
_query(
    "mean_value", "fx_ucb", "select problem_id, node_id, round(case when visit_count > 0 then total_value / visit_count else coalesce(q_value, 0) end, 6) as mean_value from fx_ucb",
    lambda n: n.select("problem_id", "node_id", F.round(trees.mean_value(F.col("visit_count"), F.col("total_value"), F.col("q_value")), 6).alias("mean_value")),
)
_UCB = """, scores as (select c.problem_id, c.parent_id, c.node_id, c.pos, case when c.visit_count > 0
    then c.total_value / c.visit_count + 1.4 * sqrt(ln(p.visit_count + 2) / c.visit_count) + 0.05 * coalesce(c.q_value, 0) else coalesce(c.q_value, 0) + 1.4 * sqrt(ln(p.visit_count + 2)) end as score
    from fx_ucb c join fx_ucb p on p.problem_id = c.problem_id and p.node_id = c.parent_id),
  best as (select * from (select *, row_number() over (partition by problem_id, parent_id order by round(score, 9) desc, pos) as n from scores) where n = 1)"""
_ucb = lambda body: with_derived("fx_ucb", "") + _UCB + body
_rounded = lambda s: s.withColumn("score", F.round("score", 6))
QUERIES["ucb_scores"] = lambda spark, d: _rounded(trees.ucb_scores(derived(spark, d, "fx_ucb")))
ORACLE_SQL["ucb_scores"] = _ucb(" select problem_id, parent_id, node_id, pos, round(score, 6) as score from scores")
QUERIES["best_child"] = lambda spark, d: _rounded(trees.best_child(trees.ucb_scores(derived(spark, d, "fx_ucb"))))
ORACLE_SQL["best_child"] = _ucb(" select problem_id, parent_id, node_id, pos, round(score, 6) as score from best")


def _selected(spark: SparkSession, d: str) -> DataFrame:
    nodes = derived(spark, d, "fx_ucb")
    return trees.select_path(trees.best_child(trees.ucb_scores(nodes)), nodes).select("problem_id", F.array_join("path", ">").alias("path"))


QUERIES["select_path"] = _selected
ORACLE_SQL["select_path"] = _ucb(""", walk as (select problem_id, 'root' as last, 'root' as path, 0 as n from fx_ucb where pos = 0
    union all select w.problem_id, b.node_id, w.path || '>' || b.node_id, w.n + 1 from walk w join best b on b.problem_id = w.problem_id and b.parent_id = w.last where w.n < 8)
  select problem_id, arg_max(path, n) as path from walk group by problem_id""")


def _deep(spark: SparkSession, d: str) -> DataFrame:
    """Long paths: a supplier's line items are nodes, and the best child of node k is node k + 1 + k % 3."""
    own = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("problem_id"), F.row_number().over(own).alias("pos"))
    name = lambda k: F.when(k == 0, "root").otherwise(F.concat(F.lit("node-"), k.cast("string")))
    below = rows.select("problem_id", F.explode(F.expr("case when pos = 1 then array(0, 1) else array(pos) end")).alias("k"))
    edges = below.withColumn("next", F.col("k") + 1 + F.col("k") % 3).join(rows.withColumnRenamed("pos", "next"), ["problem_id", "next"])
    best = edges.select("problem_id", name(F.col("k")).alias("parent_id"), name(F.col("next")).alias("node_id"))
    paths = trees.select_deep_path(best, rows, scratch(spark, "paths"))
    return paths.select("problem_id", F.size("path").alias("n_nodes"), F.md5(F.array_join("path", ">")).alias("path_md5"), F.element_at("path", -1).alias("last"))


QUERIES["select_deep_path"] = _deep
ORACLE_SQL["select_deep_path"] = """with recursive sizes as (select l_suppkey as problem_id, count(*) as n from lineitem group by l_suppkey),
  walk as (select problem_id, n, cast(0 as bigint) as k, 'root' as name from sizes union all select problem_id, n, k + 1 + k % 3, 'node-' || cast(k + 1 + k % 3 as varchar) from walk where k + 1 + k % 3 <= n)
  select problem_id, cast(count(*) as int) as n_nodes, md5(string_agg(name, '>' order by k)) as path_md5, arg_max(name, k) as last from walk group by problem_id"""


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    return trees.tree_statistics(derived(spark, d, "fx_nodes"), derived(spark, d, "fx_visits"))


QUERIES["tree_statistics"] = _statistics
ORACLE_SQL["tree_statistics"] = with_derived("fx_visits", """select n.problem_id, node_count, initial_branch_count, max_depth_reached, max_q_value, min_q_value, coalesce(s, 0) as simulation_count
  from (select problem_id, count(*) as node_count, count(*) filter (depth = 1) as initial_branch_count, max(depth) as max_depth_reached, max(q_value) as max_q_value, min(q_value) as min_q_value from fx_nodes group by problem_id) n
  left join (select problem_id, count(distinct simulation_index) as s from fx_visits group by problem_id) v on v.problem_id = n.problem_id""")
_EVENT = "case when simulation_index % 5 = 0 then 'terminal_backup' when simulation_index % 7 = 0 then 'dead_end_backup' else 'expand_backup' end"
_query(
    "event_summary", "fx_visits", f"select event_type, count(*) as n, round(avg(backed_up_value), 6) as avg_value from (select {_EVENT} as event_type, * from fx_visits where node_id = 'root') group by event_type",
    lambda v: trees.event_summary(v.where("node_id = 'root'").withColumn("event_type", F.expr(_EVENT))).withColumn("avg_value", F.round("avg_value", 6)),
)


def _nested(spark: SparkSession, d: str) -> DataFrame:
    nodes = derived(spark, d, "fx_nodes")
    asked = derived(spark, d, "fx_problems").select(F.col("source_index").alias("problem_id"), "question")
    return trees.assemble_trees(asked, nodes)


QUERIES["assemble_trees"] = lambda spark, d: _nested(spark, d).select("problem_id", "question", F.posexplode("nodes").alias("pos", "x")).select("problem_id", "question", "pos", "x.*")
ORACLE_SQL["assemble_trees"] = with_derived("fx_rollouts", "select n.problem_id, p.question, n.pos, n.node_id, n.parent_id, n.depth, n.step_text, n.q_value from fx_nodes n join fx_problems p on p.source_index = n.problem_id")


def _tree_records(spark: SparkSession, d: str) -> DataFrame:
    """Tree records of all problems, their lists as counts and their first and last entries."""
    asked = problems.prepare_problems(_raw(derived(spark, d, "fx_problems"))).withColumn("problem_id", F.col("source_index"))
    events = derived(spark, d, "fx_visits").where("node_id = 'root'").select("problem_id", "simulation_index", F.expr(_EVENT).alias("event_type"), "backed_up_value")
    records_ = trees.tree_records(asked, derived(spark, d, "fx_nodes"), _logged(spark, d), events)
    path, event = F.try_element_at("initial_paths", F.lit(1)), F.try_element_at("simulation_events", F.lit(-1))
    return records_.select(
        "problem_id", "question", "reference_answer", "reference_answer_numeric", "statistics.*", F.element_at("nodes.node_id", -1).alias("last_node_id"),
        path["status"].alias("first_status"), path["q_value"].alias("first_q_value"), event["event_type"].alias("last_event_type"), event["backed_up_value"].alias("last_value"),
    )


QUERIES["tree_records"] = _tree_records
ORACLE_SQL["tree_records"] = (
    _LOGGED
    + f""", p as (select source_index as problem_id, question, final_answer as reference_answer, {_NUMERIC} as reference_answer_numeric from (select *, {_ref('answer')} as final_answer from ({INPUTS['fx_problems']}))),
  n as (select problem_id, count(*) as node_count, max(depth) as max_depth_reached, max(q_value) as max_q_value, min(q_value) as min_q_value, arg_max(node_id, pos) as last_node_id from fx_nodes group by problem_id),
  i as (select problem_id, count(*) as initial_branch_count from log group by problem_id),
  e as (select problem_id, count(*) as simulation_count, max(simulation_index) as last from fx_visits where node_id = 'root' group by problem_id),
  x as (select problem_id, simulation_index, {_EVENT} as last_event_type, backed_up_value as last_value from fx_visits where node_id = 'root')
  select p.problem_id, question, reference_answer, reference_answer_numeric, cast(node_count as int) as node_count, cast(coalesce(initial_branch_count, 0) as int) as initial_branch_count, cast(coalesce(simulation_count, 0) as int) as simulation_count,
    max_depth_reached, max_q_value, min_q_value, last_node_id, log.status as first_status, log.q_value as first_q_value, last_event_type, last_value
  from p left join n using (problem_id) left join i using (problem_id) left join e using (problem_id) left join log on log.problem_id = p.problem_id and log.branch_index = 0
    left join x on x.problem_id = p.problem_id and x.simulation_index = e.last"""
)
QUERIES["explode_nodes"] = lambda spark, d: pairs.explode_nodes(_nested(spark, d))
ORACLE_SQL["explode_nodes"] = with_derived("fx_nodes", "select problem_id, pos, node_id, parent_id, depth, step_text, q_value from fx_nodes")



def _search(spark: SparkSession, d: str) -> DataFrame:
    asked = derived(spark, d, "fx_problems").select(F.col("source_index").alias("problem_id"), "answer")
    nodes, events = search.replay_search(asked, derived(spark, d, "fx_completions"), scratch(spark, "search"))
    kinds = [F.count_if(F.col("event_type") == f"{k}_backup").alias(f"n_{k}_backups") for k in ("terminal", "dead_end", "expand")]
    return nodes.join(events.groupBy("problem_id").agg(*kinds), "problem_id", "left").drop("prefix_text")


QUERIES["replay_search"] = _search

# --- pairs -------------------------------------------------------------------------------------------------------------

_CLASSIFIED = f""", ch as (select problem_id, parent_id, node_id, pos, depth, {_block('step_text')} as t, q_value as s from fx_nodes where parent_id is not null),
  kids as materialized (select problem_id, parent_id, count(*) as n_children, min(pos) as group_pos, list({{'n': node_id, 'p': pos, 't': t, 's': s}} order by pos) as k from ch group by problem_id, parent_id having count(*) > 1),
  groups as materialized (select c.problem_id, c.parent_id, n_children, group_pos, p.depth as parent_depth, k from kids c join fx_nodes p on p.problem_id = c.problem_id and p.node_id = c.parent_id),
  firsts as (select *, unnest(range(1, n_children)) as i from groups),
  twos as (select *, unnest(range(i + 1, n_children + 1)) as j from firsts),
  cand as materialized (select problem_id, parent_id, group_pos, parent_depth, k[i].n as ln, k[i].p as lp, k[i].t as lt, k[i].s as ls, k[j].n as rn, k[j].p as rp, k[j].t as rt, k[j].s as rs from twos),
  classified as materialized (select *, case when ls is null or rs is null or lt = '' or rt = '' then 'missing_score' when lt = rt then 'same_text' when abs(ls - rs) < 0.2 then case when ls = rs then 'tie' else 'small_gap' end else 'pair' end as class from cand),
  made as (select *, problem_id || '__' || parent_id || '__' || case when ls > rs then ln || '__' || rn else rn || '__' || ln end as pair_id, case when ls > rs then lt else rt end as chosen_text, case when ls > rs then rt else lt end as rejected_text,
    greatest(ls, rs) as chosen_score, least(ls, rs) as rejected_score, greatest(ls, rs) - least(ls, rs) as score_gap from classified where class = 'pair')"""
_pairs_sql = lambda body, source="fx_nodes": with_derived(source, "") + _CLASSIFIED + body
_classified = lambda spark, d: pairs.classify_pairs(pairs.candidate_pairs(derived(spark, d, "fx_nodes")))
QUERIES["sibling_groups"] = lambda spark, d: pairs.sibling_groups(derived(spark, d, "fx_nodes")).drop("parent_prefix_text")
ORACLE_SQL["sibling_groups"] = _pairs_sql(" select problem_id, parent_id, n_children, group_pos, parent_depth from groups")
QUERIES["candidate_pairs"] = lambda spark, d: pairs.candidate_pairs(derived(spark, d, "fx_nodes")).select("problem_id", "parent_id", F.col("l.node_id").alias("left_id"), F.col("r.node_id").alias("right_id"))
ORACLE_SQL["candidate_pairs"] = _pairs_sql(" select problem_id, parent_id, ln as left_id, rn as right_id from cand")
QUERIES["classify_pairs"] = lambda spark, d: _classified(spark, d).groupBy("class").agg(F.count("*").alias("n"))
ORACLE_SQL["classify_pairs"] = _pairs_sql(" select class, count(*) as n from classified group by class")
_PAIR = ["pair_id", "problem_id", "parent_node_id", "parent_depth", "chosen_text", "rejected_text", "chosen_score", "rejected_score", "score_gap"]
_PAIR_SQL = "pair_id, problem_id, parent_id as parent_node_id, parent_depth, chosen_text, rejected_text, chosen_score, rejected_score, score_gap"
QUERIES["make_pairs"] = lambda spark, d: pairs.make_pairs(derived(spark, d, "fx_nodes")).select(*_PAIR)
ORACLE_SQL["make_pairs"] = _pairs_sql(f" select {_PAIR_SQL} from made")
QUERIES["make_pairs_nested"] = lambda spark, d: pairs.make_pairs_nested(_nested(spark, d)).select(*_PAIR)
ORACLE_SQL["make_pairs_nested"] = ORACLE_SQL["make_pairs"]
QUERIES["cap_pairs"] = lambda spark, d: pairs.cap_pairs(pairs.make_pairs(derived(spark, d, "fx_nodes")), 2).select("pair_id")
ORACLE_SQL["cap_pairs"] = _pairs_sql(" select pair_id from (select pair_id, row_number() over (partition by problem_id order by group_pos, lp, rp) as n from made) where n <= 2")


def _prompted(spark: SparkSession, d: str) -> DataFrame:
    asked = derived(spark, d, "fx_problems").select(F.col("source_index").alias("problem_id"), "question")
    nodes = derived(spark, d, "fx_nodes").withColumn("prefix_text", F.col("step_text"))
    return pairs.make_pairs(nodes, asked)


_lines = lambda text: "'" + text.replace("\n", "' || chr(10) || '") + "'"
_PROMPTED = f""", prompted as (select m.*, x.step_prompt from made m join (select n.problem_id, n.node_id, {_lines(pairs.DEFAULT_PROMPT)} || q.question || chr(10) || chr(10) || 'Current reasoning state:' || chr(10)
    || case when {_block('n.step_text')} = '' then '(empty)' else {_block('n.step_text')} end || chr(10) || chr(10) || {_lines(pairs.PROMPT_SUFFIX)} as step_prompt
    from fx_nodes n join fx_problems q on q.source_index = n.problem_id) x on x.problem_id = m.problem_id and x.node_id = m.parent_id)"""
_prompts_sql = lambda body: _pairs_sql(_PROMPTED + body, "fx_rollouts")
QUERIES["step_prompt"] = lambda spark, d: _prompted(spark, d).select("pair_id", "step_prompt")
ORACLE_SQL["step_prompt"] = _prompts_sql(" select pair_id, step_prompt from prompted")
_META = ["parent_depth", "chosen_score", "rejected_score", "score_gap"]
QUERIES["render_sharegpt"] = lambda spark, d: pairs.render(_prompted(spark, d), "sharegpt").select("id", F.col("conversations")[0]["from"].alias("speaker"), F.col("conversations")[0]["value"].alias("prompt"), F.col("chosen.value").alias("chosen"), F.col("rejected.value").alias("rejected"), *_META)
ORACLE_SQL["render_sharegpt"] = _prompts_sql(f" select pair_id as id, 'human' as speaker, step_prompt as prompt, chosen_text as chosen, rejected_text as rejected, {', '.join(_META)} from prompted")
QUERIES["render_alpaca"] = lambda spark, d: pairs.render(_prompted(spark, d), "alpaca").select("id", "instruction", "input", "chosen", "rejected", *_META)
ORACLE_SQL["render_alpaca"] = _prompts_sql(f" select pair_id as id, step_prompt as instruction, '' as input, chosen_text as chosen, rejected_text as rejected, {', '.join(_META)} from prompted")
QUERIES["render_generic"] = lambda spark, d: pairs.render(_prompted(spark, d), "generic").select("id", "step_prompt", "chosen", "rejected", *_META)
ORACLE_SQL["render_generic"] = _prompts_sql(f" select pair_id as id, step_prompt, chosen_text as chosen, rejected_text as rejected, {', '.join(_META)} from prompted")
_STATS = "count(distinct parent_id) as parent_groups, count(distinct case when class = 'pair' then parent_id end) as paired_groups, count(*) filter (class = 'pair') as pairs, " + ", ".join(f"count(*) filter (class = '{c}') as skipped_{c}" for c in pairs.CLASSES)
QUERIES["pair_stats"] = lambda spark, d: pairs.pair_stats(_classified(spark, d))
ORACLE_SQL["pair_stats"] = _pairs_sql(f" select problem_id, {_STATS} from classified group by problem_id")


def _pair_summary(spark: SparkSession, d: str) -> DataFrame:
    nodes = derived(spark, d, "fx_nodes")
    classified = pairs.classify_pairs(pairs.candidate_pairs(nodes))
    out = pairs.pair_summary(nodes.where("pos = 0"), classified, pairs.cap_pairs(pairs.oriented_pairs(classified), 2))
    return out.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c).cast("bigint").alias(c) for c, kind in out.dtypes])


QUERIES["pair_summary"] = _pair_summary
ORACLE_SQL["pair_summary"] = _pairs_sql(f""", kept as (select * from (select *, row_number() over (partition by problem_id order by group_pos, lp, rp) as n from made) where n <= 2),
  per as (select r.problem_id, count(k.pair_id) as n from (select problem_id from fx_nodes where pos = 0) r left join kept k on k.problem_id = r.problem_id group by r.problem_id),
  stats as (select problem_id, {_STATS} from classified group by problem_id)
  select (select count(*) from per) as input_problem_count, (select count(*) from kept) as output_pair_count, (select count(*) from per where n > 0) as problems_with_pairs, (select round(avg(case when n > 0 then 1.0 else 0.0 end), 6) from per) as problem_pair_ratio,
    (select round(avg(n), 6) from per) as avg_pairs_per_problem, (select round(avg(chosen_score), 6) from kept) as avg_chosen_score, (select round(avg(rejected_score), 6) from kept) as avg_rejected_score,
    (select round(avg(score_gap), 6) from kept) as avg_score_gap, (select round(avg(parent_depth), 6) from kept) as avg_parent_depth,
    cast(sum(parent_groups) as bigint) as parent_groups, cast(sum(paired_groups) as bigint) as paired_groups, {', '.join(f'cast(sum(skipped_{c}) as bigint) as skipped_{c}' for c in pairs.CLASSES)} from stats""")

# --- incremental -------------------------------------------------------------------------------------------------------


def _arriving(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str, str]:
    """df as files that a stream reads: (stream, output path, checkpoint path)."""
    source = scratch(spark, name)
    df.write.parquet(source)
    return jobs.read_stream(spark, source, df.schema), scratch(spark, f"{name}-out"), scratch(spark, f"{name}-state")


def _stream_grade(spark: SparkSession, d: str) -> DataFrame:
    stream, out, state = _arriving(spark, derived(spark, d, "fx_predictions"), "predictions")
    graded = grading.grade(stream)
    jobs.stream_grade(stream, out, state).awaitTermination()
    return spark.read.schema(graded.schema).parquet(out).drop("prediction", "answer")


def _stream_pairs(spark: SparkSession, d: str) -> DataFrame:
    stream, out, state = _arriving(spark, _nested(spark, d), "trees")
    made = pairs.make_pairs_nested(stream)
    jobs.stream_pairs(stream, out, state).awaitTermination()
    return spark.read.schema(made.schema).parquet(out).select(*_PAIR)


def _stream_trees(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over the same arriving trees: the second adds nothing."""
    nested = _nested(spark, d)
    stream, out, _ = _arriving(spark, nested, "trees")
    for _ in range(2):
        jobs.append_trees(stream, out, scratch(spark, "trees-state"))
    return jobs.appended_trees(spark, out, nested.schema).select("problem_id", F.size("nodes").alias("n_nodes"))


QUERIES |= {"stream_grade": _stream_grade, "stream_pairs": _stream_pairs, "stream_append_trees": _stream_trees}
ORACLE_SQL["stream_grade"] = ORACLE_SQL["grade_predictions"]
ORACLE_SQL["stream_pairs"] = ORACLE_SQL["make_pairs"]
ORACLE_SQL["stream_append_trees"] = with_derived("fx_nodes", "select problem_id, cast(count(*) as int) as n_nodes from fx_nodes group by problem_id")
