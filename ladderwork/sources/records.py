"""Reading, writing and resuming of record collections."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, on_malformed: str = "fail") -> DataFrame:
    """JSON lines, one object each; blank lines are skipped. on_malformed: 'fail' raises on a line that is no object, 'drop'
    leaves it out, 'keep' keeps it in _malformed (null for good lines)."""
    lines = spark.read.text(path).where(r"value rlike '(?U)\\S'")
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*schema.fields, T.StructField("_malformed", T.StringType())])
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    bad = ~F.col("value").rlike(r"(?Us)^\s*\{") | F.col("r").isNull() | F.col("r._malformed").isNotNull()
    rows = lines.withColumn("r", parsed)
    fields = [F.col(f"r.{f.name}") for f in schema.fields]
    if on_malformed == "keep":
        return rows.select(*fields, F.when(bad, F.col("value")).alias("_malformed"))
    if on_malformed == "drop":
        return rows.where(~F.coalesce(bad, F.lit(True))).select(*fields)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 200)))).otherwise(F.col("r"))
    return rows.select(checked.alias("r")).select(*fields)


def read_problem_splits(spark: SparkSession, path: str, splits: tuple[str, ...] = ("train", "test"), format: str = "parquet") -> DataFrame:
    """One table per split below path, as one with `split` and source_index; a missing split or column is an error."""
    out = None
    for split in splits:
        part = spark.read.format(format).load(f"{path}/{split}")
        missing = {"question", "answer"} - set(part.columns)
        if missing:
            raise ValueError(f"split {split} lacks {sorted(missing)}")
        if "source_index" not in part.columns:
            part = part.withColumn("source_index", F.monotonically_increasing_id())
        part = part.select(F.lit(split).alias("split"), F.col("source_index").cast("bigint").alias("source_index"), "question", "answer")
        out = part if out is None else out.unionByName(part)
    return out


def write_records(df: DataFrame, path: str, format: str = "json", if_exists: str = "fail") -> None:
    """JSON lines with nulls and non-ASCII text kept, or Parquet. if_exists: fail, append (resume) or overwrite."""
    mode = {"fail": "errorifexists", "append": "append", "overwrite": "overwrite"}[if_exists]
    writer = df.write.mode(mode).format(format)
    (writer.option("ignoreNullFields", "false") if format == "json" else writer).save(path)


def append_records(df: DataFrame, path: str, format: str = "json") -> None:
    """Adds df's rows; nothing is written for no rows."""
    if not df.isEmpty():
        write_records(df, path, format, "append")


def write_summary(row: DataFrame, path: str) -> None:
    """A one-row frame as one JSON object."""
    row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def dataset_descriptor(name: str, file_name: str, layout: str) -> Column:
    """Column map of a rendered file for a trainer's dataset list, as a struct named `name`; null for the generic layout."""
    columns = {
        "sharegpt": {"messages": "conversations", "chosen": "chosen", "rejected": "rejected"},
        "alpaca": {"prompt": "instruction", "query": "input", "chosen": "chosen", "rejected": "rejected"},
    }
    if layout not in columns:
        return F.lit(None).cast("string").alias(name)
    head = [F.lit(file_name).alias("file_name")] + ([F.lit("sharegpt").alias("formatting")] if layout == "sharegpt" else [])
    return F.struct(*head, F.lit(True).alias("ranking"), F.struct(*[F.lit(v).alias(k) for k, v in columns[layout].items()]).alias("columns")).alias(name)


def limit_problems(df: DataFrame, n: int | None, order: str = "source_index", need: bool = False) -> DataFrame:
    """The first n rows in order (a top-k). Not positive or null: all, or with need an error."""
    if n is None or n <= 0:
        if need and n is not None:
            raise ValueError("the limit must be positive")
        return df
    return df.orderBy(order).limit(n)


def resume_filter(df: DataFrame, done: DataFrame, key: str = "problem_id") -> DataFrame:
    """Rows whose key isn't among the done ones; rows of a missing or empty key stay."""
    kind = df.schema[key].dataType
    ids = done.select(F.col(key).cast(kind).alias(key)).where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).distinct()
    return df.join(ids, key, "left_anti")


def run_summary(df: DataFrame, done: DataFrame, key: str = "problem_id", **settings: str | int | float) -> DataFrame:
    """One row: input_count, skipped_count (done already), new_count, output_count, status and the settings."""
    ids = done.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_done", F.lit(True))
    counts = df.join(ids, key, "left").agg(F.count("*").alias("input_count"), F.count_if(F.coalesce("_done", F.lit(False))).alias("skipped_count"))
    before = done.agg(F.count("*").alias("done_count"))
    one = F.lit(1).alias("one")
    out = counts.select(one, "*").join(before.select(one, "*"), "one").drop("one").withColumn("new_count", F.col("input_count") - F.col("skipped_count"))
    out = out.withColumn("output_count", F.col("done_count") + F.col("new_count")).withColumn("status", F.when(F.col("new_count") > 0, "complete").otherwise("nothing_to_do"))
    return out.drop("done_count").select("input_count", "skipped_count", "new_count", "output_count", "status", *[F.lit(v).alias(k) for k, v in settings.items()])


def _observed(observation: Observation, *names: str) -> list[int]:
    """Observed counts. Of a frame that is empty as planned nothing is observed."""
    try:
        return [observation.get[name] for name in names]
    except Py4JJavaError:
        return [0] * len(names)


def write_resumed(df: DataFrame, done: DataFrame, path: str, key: str = "problem_id", format: str = "json", **settings: str | int | float) -> DataFrame:
    """Appends df's rows whose key isn't done to path; the run summary (as run_summary), observed while they are written: df and done
    are read once each, and nothing is counted in a second pass. Rows of a missing or empty key are always written, so here
    they count as new."""
    seen, written = Observation(), Observation()
    ids = done.select(F.col(key).cast(df.schema[key].dataType).alias(key)).observe(seen, F.count("*").alias("n"))
    ids = ids.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).distinct().withColumn("__done", F.lit(True))
    marked = df.join(ids, key, "left").observe(written, F.count("*").alias("input"), F.count("__done").alias("skipped"))
    write_records(marked.where("__done is null").drop("__done").select(*df.columns), path, format, "append")
    (n, skipped), (before,) = _observed(written, "input", "skipped"), _observed(seen, "n")
    row = (n, skipped, n - skipped, before + n - skipped, "complete" if n > skipped else "nothing_to_do")
    out = df.sparkSession.createDataFrame([row], "input_count bigint, skipped_count bigint, new_count bigint, output_count bigint, status string")
    return out.select("*", *[F.lit(v).alias(k) for k, v in settings.items()])
