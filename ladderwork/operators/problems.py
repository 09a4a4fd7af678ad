"""Preparation of question/answer problems: normalization, reproducible samples, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import canonical_decimal, extract_reference
from ..functions.text import render_prompt, rstrip, strip

#: Fixed value: the prompt around a question.
PROMPT_TEMPLATE = (
    "You are a careful math reasoning assistant.\n"
    "Solve the problem step by step.\n"
    "Put the final answer inside <answer>...</answer>.\n\n"
    "Question:\n{question}\n"
)
PREPARED = [
    "problem_id", "dataset_name", "dataset_config", "split", "source_index", "question",
    "solution", "answer", "final_answer", "final_answer_numeric", "answer_tag", "prompt",
]


def split_solution(answer: Column, on_missing: str = "fail") -> tuple[Column, Column]:
    """(text before the first ####, final answer). on_missing: 'fail' raises for an answer without one, 'null' gives null."""
    final = extract_reference(answer)
    if on_missing == "fail":
        final = F.coalesce(final, F.raise_error(F.lit("an answer has no #### line")).cast("string"))
    return rstrip(F.substring_index(answer, "####", 1)), final


def problem_id(split: Column, index: Column, dataset: str = "gsm8k", config: str = "main") -> Column:
    """dataset-config-split-index, the index with at least five digits."""
    number = index.cast("string")
    return F.concat(F.lit(f"{dataset}-{config}-"), split, F.lit("-"), F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number))


def prepare_problems(raw: DataFrame, template: str = PROMPT_TEMPLATE, dataset: str = "gsm8k", config: str = "main", on_missing: str = "fail") -> DataFrame:
    """split, source_index, question, answer -> the twelve columns of a prepared problem; one projection, no shuffle.
    on_missing 'drop' leaves out answers without a final one. Null questions and answers count as missing."""
    question, answer = strip(F.col("question")), strip(F.col("answer"))
    solution, final = split_solution(answer, "fail" if on_missing == "fail" else "null")
    out = raw.select(
        problem_id(F.col("split"), F.col("source_index"), dataset, config).alias("problem_id"), F.lit(dataset).alias("dataset_name"), F.lit(config).alias("dataset_config"),
        "split", "source_index", question.alias("question"), solution.alias("solution"), answer.alias("answer"), final.alias("final_answer"),
    )
    if on_missing != "fail":
        out = out.where(F.col("final_answer").isNotNull())
    number = canonical_decimal(F.col("final_answer"))
    tag = F.concat(F.lit("<answer>"), "final_answer", F.lit("</answer>"))
    return out.withColumns({"final_answer_numeric": number, "answer_tag": tag, "prompt": render_prompt(template, F.col("question"))}).select(*PREPARED)


def _drawn(df: DataFrame, size: int | None, seed: int, key: str) -> DataFrame:
    """The first `size` rows by a hash of seed and key (a top-k, no full sort), with their rank from 1. One small task ranks them."""
    order = [F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), F.col(key)]
    top = df.orderBy(*order).limit(size)
    return top.withColumn("_all", F.lit(0)).withColumn("rank", F.row_number().over(Window.partitionBy("_all").orderBy(*order))).drop("_all")


def sample_train_dev(df: DataFrame, train_size: int = 1500, dev_size: int = 200, seed: int = 42, key: str = "source_index") -> DataFrame:
    """Disjoint samples, named in `split` (train, dev). source_index numbers the rows of each sample from 0; the key's value
    is kept as original_index. The same rows for any partitioning; more rows than there are is an error."""
    if min(train_size, dev_size) < 0:
        raise ValueError("sizes must not be negative")
    have = df.limit(train_size + dev_size).count()
    if have < train_size + dev_size:
        raise ValueError(f"{train_size + dev_size} rows are asked for, there are {have}")
    drawn = _drawn(df, train_size + dev_size, seed, key)
    first = F.col("rank") <= train_size
    return drawn.withColumn("original_index", F.col(key)).withColumns(
        {"split": F.when(first, "train").otherwise("dev"), "source_index": (F.col("rank") - F.when(first, 1).otherwise(train_size + 1)).cast("bigint")}
    ).drop("rank")


def sample_test(df: DataFrame, size: int | None = None, seed: int = 42, key: str = "source_index") -> DataFrame:
    """All rows if size is null, not positive or at least their number; else a sample as above. split is 'test'."""
    whole = df.withColumns({"original_index": F.col(key), "split": F.lit("test")})
    if size is None or size <= 0 or df.limit(size + 1).count() <= size:
        return whole
    drawn = _drawn(df, size, seed, key).withColumns({"original_index": F.col(key), "split": F.lit("test")})
    return drawn.withColumn("source_index", (F.col("rank") - 1).cast("bigint")).drop("rank")


def split_summary(problems: DataFrame, seed: int = 42, **sizes: int) -> DataFrame:
    """Rows per split, with the sizes asked for, the seed and the number of fields."""
    asked = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]) if sizes else F.create_map().cast("map<string,int>")
    n_fields = len(problems.columns)
    return problems.groupBy("split").agg(F.count("*").alias("n")).select("split", "n", F.try_element_at(asked, F.col("split")).alias("asked"), F.lit(seed).alias("seed"), F.lit(n_fields).alias("n_fields"))
