"""Incremental jobs over arriving files. No job waits for event times, so no watermark is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.grading import grade
from ..operators.pairs import make_pairs_nested

#: Parts in which the trees of a batch are built and finished, each by itself.
SLICES = 4
_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_COUNTS = "input_count bigint, skipped_count bigint, new_count bigint, output_count bigint, last_batch bigint, status string"


def read_stream(spark: SparkSession, path: str, schema, format: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(format)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def _append(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_grade(predictions: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Grades predictions as they arrive."""
    return _append(grade(predictions, **options), out, checkpoint)


def stream_pairs(trees: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Preference pairs of arriving nested trees, row by row."""
    return _append(make_pairs_nested(trees, **options), out, checkpoint)


# --- appending trees ----------------------------------------------------------------------------------------------------
#
# Below `out`:
#   trees/run=R/batch=N/slice=K  finished trees
#   done/run=R/batch=N/slice=K   one file, written after them: their ids, and one row without an id that counts them
#   arrived/run=R/batch=N        new rows of a batch that is still to be built, where trees are built from what arrives
#   progress/run=R/batch=N       counts up to this batch
#   summary                      the last progress
# R is the streaming query's id, which its checkpoint keeps, so a batch that is replayed writes the same folders again.

_DONE = "key string, n bigint"
_PLACE = ["run", "batch", "slice"]


def new_trees(trees: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """Streaming: key, row (a tree as JSON) and kind: arrived for each arriving tree, finished for each key done before, new for
    a key's first batch. by_key has what they come to. finished: a stream of keys done before (key).

    A state store keeps the keys, so a batch costs what arrives in it; rows of a null or empty key have no key here."""
    name, none = F.col(key).cast("string"), F.lit(None).cast("string")
    row = F.to_json(F.struct(*[F.col(c) for c in trees.columns]), _JSON)
    named, known = trees.select(name.alias("key")).where("key <> ''"), finished.where("key is not null").select("key")
    first = named.unionByName(known).dropDuplicates(["key"])
    arrived = trees.select(F.when(name != "", name).alias("key"), row.alias("row"), F.lit("arrived").alias("kind"))
    return arrived.unionByName(known.select("key", none.alias("row"), F.lit("finished").alias("kind"))).unionByName(first.select("key", none.alias("row"), F.lit("new").alias("kind")))


def by_key(batch: DataFrame) -> DataFrame:
    """A batch of new_trees: arrived (rows of a key) and row (the tree to take as JSON, null if its key was there before). Of differing
    trees of one key that of the smallest text is taken; rows without a key are all taken, each by itself."""
    alone = batch.withColumn("alone", F.when(F.col("key").isNull(), F.monotonically_increasing_id()))
    is_new = F.max(F.col("kind") == "new") & ~F.max(F.col("kind") == "finished")
    return alone.groupBy("key", "alone").agg(F.count_if(F.col("kind") == "arrived").alias("arrived"), F.when(F.col("key").isNull() | is_new, F.min("row")).alias("row")).select("arrived", "row")


class TreeSink:
    """Writes batches of new_trees. Each part of a batch is written, and then marked as done by one file; a part that is marked is
    left alone when the batch is replayed, any other is written anew, so no tree is there twice, with an id or without.

    build makes trees from arrived rows. It fails for a whole part; then the batch's other parts are still finished and marked,
    the summary has the status failed and the counts so far, and the error is raised. A restart repeats the failed part only."""

    def __init__(self, out: str, schema: T.StructType, key: str, build: Callable[[DataFrame], DataFrame] | None = None, slices: int = SLICES):
        self.out, self.schema, self.key, self.build, self.slices = out, schema, key, build, slices if build else 1

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        place, counts = f"run={run}/batch={number}", Observation()
        rows = by_key(batch).observe(counts, F.coalesce(F.sum("arrived"), F.lit(0)).alias("arrived"), F.count("row").alias("fresh"))
        fresh = rows.where("row is not null").select(F.from_json("row", self.schema, _JSON).alias("r")).select("r.*")
        error, new = None, 0
        if self.build is None:
            if self._marked(spark, f"{place}/slice=0") is None:
                fresh.write.mode("overwrite").parquet(f"{self.out}/trees/{place}/slice=0")
            else:
                rows.write.format("noop").mode("overwrite").save()
        else:
            fresh.withColumn("slice", F.pmod(F.xxhash64(F.to_json(F.struct("*"), _JSON)), F.lit(self.slices)).cast("int")).write.mode("overwrite").partitionBy("slice").parquet(f"{self.out}/arrived/{place}")
        for k in range(self.slices if counts.get["fresh"] else 0):
            try:
                new += self._finish(spark, place, k)
            except Exception as e:  # noqa: BLE001  # raised below, when all that can be finished is
                error = error or e
        self._report(spark, run, number, counts.get, new, "failed" if error else "running")
        if error:
            raise error

    def _marked(self, spark: SparkSession, place: str) -> int | None:
        """How many trees a finished part has, or None."""
        try:
            row = spark.read.schema(_DONE).parquet(f"{self.out}/done/{place}").where("key is null").select("n").first()
        except AnalysisException:
            return None
        return row.n if row else None

    def _finish(self, spark: SparkSession, place: str, k: int) -> int:
        own = f"{place}/slice={k}"
        if (n := self._marked(spark, own)) is not None:
            return n
        target = f"{self.out}/trees/{own}"
        if self.build:
            try:
                arrived = spark.read.schema(self.schema).parquet(f"{self.out}/arrived/{own}")
            except AnalysisException:
                return 0  # nothing of the batch is in this part
            self.build(arrived).write.mode("overwrite").parquet(target)
        ids = spark.read.parquet(target).select(F.col(self.key).cast("string").alias("key"))
        counted = ids.agg(F.lit(None).cast("string").alias("key"), F.count("*").alias("n"))
        ids.where("key is not null and key <> ''").select("key", F.lit(None).cast("bigint").alias("n")).unionByName(counted).coalesce(1).write.mode("overwrite").parquet(f"{self.out}/done/{own}")
        return self._marked(spark, own)

    def _report(self, spark: SparkSession, run: str, number: int, counts: dict, new: int, status: str) -> None:
        before = None
        if number:
            try:
                before = spark.read.schema(_COUNTS).json(f"{self.out}/progress/run={run}/batch={number - 1}").first()
            except AnalysisException:
                pass
        if before:
            total = before.output_count
        else:  # a run's first batch counts what others have written, once
            done = _done(spark, self.out)
            total = done.where((F.col("run") != run) | (F.col("batch") < number)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] if done is not None else 0
        input_, skipped, added = (before.input_count, before.skipped_count, before.new_count) if before else (0, 0, 0)
        row = (input_ + counts["arrived"], skipped + counts["arrived"] - counts["fresh"], added + new, total + new, number, status)
        one = spark.createDataFrame([row], _COUNTS).coalesce(1)
        for path in (f"progress/run={run}/batch={number}", "summary"):
            one.write.mode("overwrite").json(f"{self.out}/{path}")


def _done(spark: SparkSession, out: str) -> DataFrame | None:
    """run, batch, slice and n of each finished part, or None where there is none yet."""
    try:
        done = spark.read.schema(f"{_DONE}, run string, batch bigint, slice int").parquet(f"{out}/done")
    except AnalysisException:
        return None
    return done.where("key is null").select(*_PLACE, "n")


def appended_trees(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The trees of all finished parts below out; what a failed or unfinished batch has written is left out."""
    done = _done(spark, out)
    if done is None or done.isEmpty():
        return spark.createDataFrame([], schema)
    places = T.StructType().add("run", T.StringType()).add("batch", T.LongType()).add("slice", T.IntegerType())
    own = T.StructType(list(schema.fields) + list(places.fields))
    return spark.read.schema(own).parquet(f"{out}/trees").join(F.broadcast(done.drop("n")), _PLACE, "left_semi").select(*schema.names)


def stream_append_trees(
    trees: DataFrame, out: str, checkpoint: str, key: str = "problem_id", build: Callable[[DataFrame], DataFrame] | None = None, built_schema: T.StructType | None = None, slices: int = SLICES
) -> StreamingQuery:
    """Appends arriving trees below out, leaving out those whose key is there, whichever run has written it; out/summary has the counts
    after each batch. appended_trees reads them. With build, what arrives is turned into trees first (TreeSink)."""
    spark = trees.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/done")
    done.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(done)
    # All files of finished keys that are there belong to the first batch, before any tree is taken.
    finished = spark.readStream.schema(f"{_DONE}, run string, batch bigint, slice int").parquet(f"{out}/done")
    sink = TreeSink(out, trees.schema, key, build, slices)
    return new_trees(trees, finished, key).writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_trees(trees: DataFrame, out: str, checkpoint: str, **options) -> DataFrame:
    """stream_append_trees to its end; the summary, with the status completed. If a batch fails the summary that is left has the status
    failed and the error is raised."""
    spark = trees.sparkSession
    stream_append_trees(trees, out, checkpoint, **options).awaitTermination()
    try:
        row = spark.read.schema(_COUNTS).json(f"{out}/summary").first()
    except AnalysisException:
        row = None
    row = tuple(row)[:-1] if row else (0, 0, 0, 0, -1)
    spark.createDataFrame([(*row, "completed")], _COUNTS).coalesce(1).write.mode("overwrite").json(f"{out}/summary")
    return spark.read.schema(_COUNTS).json(f"{out}/summary")
