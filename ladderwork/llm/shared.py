"""Shared folder, written stages and reading of tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds more than one in so many rows is frequent, so there are fewer frequent keys than this.
FREQUENT = 2000
#: Ids that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a single machine takes a new
    temporary folder; on a cluster it is an error, since executors could not read what another has written."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="ladderwork-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df below the shared folder and reads it again: later jobs start from files that survive a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """The name, or where df has such a column one with underscores before it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Rows of df whose key is ("left_semi") or isn't ("left_anti") among ids, which are written, counted and broadcast if they are
    few: then df's rows, texts included, are not shuffled. A null key is never among them."""
    ids = stage(ids.where(F.col(key).isNotNull()).select(key).distinct(), "ids")
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


def repeated_once(docs: DataFrame, most: int) -> DataFrame | None:
    """doc_id, text and copies (how often the row is there) of docs, where rows that repeat are one row if their texts have together
    more bytes than `most`; others have one copy each. None if there are no such rows. Which rows repeat is counted by 64
    bits of a row; tasks count before they send, so a row that fills the table is one row per task."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_row"))
    counts = keyed.groupBy("_row").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    many = stage(counts.where((F.col("n") > 1) & (F.col("bytes") > most)).select("_row"), "repeated")
    n = many.count()
    if not n:
        return None
    many = F.broadcast(many) if n <= BROADCAST_IDS else many
    once = keyed.join(many, "_row", "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    return keyed.join(many, "_row", "left_anti").select("doc_id", "text", F.lit(1).cast("bigint").alias("copies")).unionByName(once)


def join_frequent(rows: DataFrame, of_key: DataFrame, key: str) -> DataFrame:
    """rows.join(of_key, key, "left") for any share of rows with one key, or none. of_key has at most one row for a key. Its rows of
    frequent keys, fewer than FREQUENT, are broadcast, so that rows of these keys stay where they are, as do rows of a null
    key. rows is read several times."""
    total = rows.count()
    many = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > max(16, total // FREQUENT)).select(key)
    many = F.broadcast(stage(many, "frequent"))
    one = rows.join(many, key, "left_semi").join(F.broadcast(of_key.join(many, key, "left_semi")), key, "left")
    named = rows.where(F.col(key).isNotNull())
    return named.join(many, key, "left_anti").join(of_key, key, "left").unionByName(one).unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)
