"""Inputs derived from the given tables in SQL that Spark and DuckDB both accept, as views and as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A node's ancestor k levels up in a tree of three children per node is (pos - before) / width, where it has one; the levels
#: reach to places beyond 250,000.
_LEVELS = " union all ".join(f"select {3**k} as width, {(3**k - 1) // 2} as before" for k in range(12))

SQL = {
    "fx_problems": """
select o_orderkey as source_index,
  'Customer ' || cast(o_custkey as string) || ' placed order ' || cast(o_orderkey as string) || '. What is due?' as question,
  'Look at order ' || cast(o_orderkey as string) || '.' || chr(10) || 'Priority ' || o_orderpriority || '.' || chr(10) || '#### ' ||
  case o_orderkey % 8
    when 0 then case when n >= 1000 then cast(cast(floor(n / 1000) as bigint) as string) || ',' || lpad(cast(n % 1000 as string), 3, '0') else cast(n as string) end
    when 1 then '$' || cast(n as string) || '.50'
    when 2 then cast(o_custkey % 9 as string) || '/' || cast(1 + o_custkey % 4 as string)
    when 3 then cast(o_custkey % 100 as string) || '%'
    when 4 then lower(o_orderpriority)
    when 5 then o_orderstatus
    when 6 then cast(o_custkey as string) || ' apples.'
    else cast(n as string) || '.0' end as answer
from (select *, cast(floor(o_totalprice) as bigint) as n from orders)
""",
    "fx_samples": """
select l_orderkey, l_linenumber, l_partkey, cast(l_quantity as int) as qty,
  cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as int) as pos
from lineitem
""",
    "fx_predictions": """
select s.l_orderkey as source_index, s.pos as sample_index, p.answer as answer,
  'Step 1: take ' || cast(s.qty as string) || '.' || chr(10) || 'Step 2: finish.' || chr(10) ||
  case s.l_linenumber
    when 1 then '<answer>' || f || '</answer>'
    when 2 then '<ANSWER> ' || f || ' units </ANSWER>'
    when 3 then '<answer>' || cast(s.l_partkey as string) || '</answer>'
    when 4 then 'so it is ' || cast(s.l_partkey as string)
    when 5 then '<answer></answer>'
    when 6 then '<answer>' || upper(f) || '.</answer><answer>0</answer>'
    else 'unsure' end as prediction
from fx_samples s join (select source_index, answer, split_part(answer, '#### ', 2) as f from fx_problems) p on p.source_index = s.l_orderkey
""",
    "fx_nodes": """
select problem_id, pos, node_id, parent_id, depth, step_text, q_value from (
  select s.l_orderkey as problem_id, s.pos as pos,
    'node-' || lpad(cast(s.pos as string), 5, '0') as node_id,
    case when s.pos <= 3 then 'root' else 'node-' || lpad(cast(cast(floor((s.pos - 1) / 3) as int) as string), 5, '0') end as parent_id,
    case when s.pos <= 3 then 1 when s.pos <= 12 then 2 else 3 end as depth,
    case when s.pos % 5 = 0 then ' ' when s.qty % 6 = 0 then 'Step: same' else 'Step: part ' || cast(s.l_partkey as string) || chr(13) || chr(10) end as step_text,
    case when s.l_linenumber = 7 then null else cast(s.qty % 9 as double) / cast(8 as double) end as q_value
  from fx_samples s
  union all
  select o_orderkey, 0, 'root', null, 0, '', null from orders)
""",
    "fx_rollouts": """
select n.problem_id as problem_id, n.node_id as node_id, k.k as rollout_index, n.step_text as prefix_text,
  case (n.pos + k.k + n.problem_id) % 3 when 0 then 'hence' || chr(10) || '<answer>' || p.f || '</answer>'
       when 1 then '<answer>' || cast(n.pos as string) || '</answer>' else 'no tag ' || p.f end as continuation_text,
  p.answer as answer
from fx_nodes n join (select source_index, answer, split_part(answer, '#### ', 2) as f from fx_problems) p on p.source_index = n.problem_id
cross join (select 0 as k union all select 1 union all select 2) k
where n.pos > 0
""",
    "fx_visits": """
select problem_id, pos as simulation_index, case when pos < before + width then 'root' else 'node-' || lpad(cast(cast(floor((pos - before) / width) as int) as string), 5, '0') end as node_id,
  coalesce(q_value, cast(0 as double)) as backed_up_value
from fx_nodes join (LEVELS) levels on before <= pos
where pos > 0
""",
    "fx_completions": """
select l_orderkey as problem_id, pos - 1 as branch_index,
  case pos % 6
    when 0 then ' ' || chr(10)
    when 1 then 'Let us see. Step 1: use ' || cast(l_partkey % 3 as string) || '. step 2 : add ' || cast(l_partkey % 2 as string) || chr(13) || chr(10) || '<answer>' || cast(qty as string) || '</answer>'
    when 2 then 'Step 1: use ' || cast(l_partkey % 3 as string) || '.' || chr(10) || 'Step 2: add ' || cast(l_partkey % 2 as string)
    when 3 then 'use ' || cast(l_partkey % 2 as string) || chr(10) || chr(10) || '  then stop ' || chr(10)
    when 4 then 'only Step 1: one line ' || repeat('x', 600)
    else 'Step 1: use ' || cast(l_partkey % 3 as string) || '. Step 2: add 1 Step 3: end' end as completion
from fx_samples
""",
    "fx_ucb": """
select n.problem_id as problem_id, n.node_id as node_id, n.parent_id as parent_id, n.pos as pos, n.depth as depth, n.q_value as q_value,
  cast(coalesce(v.c, 0) as bigint) as visit_count, coalesce(v.t, cast(0 as double)) as total_value
from fx_nodes n left join (select problem_id, node_id, count(*) as c, sum(backed_up_value) as t from fx_visits where simulation_index % 2 = 1 group by problem_id, node_id) v
  on v.problem_id = n.problem_id and v.node_id = n.node_id
""",
}
SQL["fx_visits"] = SQL["fx_visits"].replace("LEVELS", _LEVELS)
#: Those that each one reads, directly or not, in order.
_NEEDS = {
    "fx_problems": [],
    "fx_samples": [],
    "fx_predictions": ["fx_problems", "fx_samples"],
    "fx_nodes": ["fx_samples"],
    "fx_rollouts": ["fx_problems", "fx_samples", "fx_nodes"],
    "fx_visits": ["fx_samples", "fx_nodes"],
    "fx_completions": ["fx_samples"],
    "fx_ucb": ["fx_samples", "fx_nodes", "fx_visits"],
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for table in ("orders", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    for other in _NEEDS[name]:
        spark.sql(SQL[other]).createOrReplaceTempView(other)
    return spark.sql(SQL[name])


def with_derived(name: str, body: str) -> str:
    """A DuckDB query over a derived input and those below it, each of which is computed once."""
    ctes = ", ".join(f"{n} as materialized ({SQL[n].strip()})" for n in [*_NEEDS[name], name])
    return f"with recursive {ctes} {body.strip()}"
