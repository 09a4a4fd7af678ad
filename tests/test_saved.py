"""Saved datasets of Arrow shards: round trips, shards as partitions, metadata."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ladderwork.operators import problems
from ladderwork.sources import saved


def shard(path, table):
    with pa.OSFile(str(path), "wb") as f, pa.ipc.new_stream(f, table.schema) as out:
        for batch in table.to_batches(max_chunksize=2):
            out.write_batch(batch)


def collection(tmp_path, tables, features):
    for name, shards in tables.items():
        (tmp_path / name).mkdir()
        names = [f"data-{k:05d}-of-{len(shards):05d}.arrow" for k in range(len(shards))]
        for x, t in zip(names, shards):
            shard(tmp_path / name / x, t)
        (tmp_path / name / "state.json").write_text(json.dumps({"_data_files": [{"filename": x} for x in names], "_fingerprint": "x", "_split": name}))
        (tmp_path / name / "dataset_info.json").write_text(json.dumps({"features": features}))
    (tmp_path / "dataset_dict.json").write_text(json.dumps({"splits": list(tables)}))
    return str(tmp_path)


QA = {"question": {"dtype": "string", "_type": "Value"}, "answer": {"dtype": "string", "_type": "Value"}}


def qa(*rows):
    return pa.table({"question": pa.array([r[0] for r in rows], pa.string()), "answer": pa.array([r[1] for r in rows], pa.string())})


def test_splits_in_order_of_shards(spark, tmp_path):
    path = collection(tmp_path, {"train": [qa(("a", "#### 1"), ("b", "#### 2"), ("é", None)), qa(), qa(("c", "#### 3"))], "test": [qa(("d", "#### 4"))]}, QA)
    got = saved.read_saved_dataset(spark, path)
    rows = [tuple(r) for r in got.orderBy("split", "source_index").select("split", "question", "answer").collect()]
    assert rows == [("test", "d", "#### 4"), ("train", "a", "#### 1"), ("train", "b", "#### 2"), ("train", "é", None), ("train", "c", "#### 3")]
    one = spark.read.format(saved.FORMAT).load(f"{path}/train")
    assert one.rdd.getNumPartitions() == 3 and one.select("source_index").distinct().count() == 4
    assert saved.read_saved_dataset(spark, path, ("test",)).count() == 1 and saved.read_saved_dataset(spark, path, None).count() == 5
    ready = problems.prepare_problems(got.where("answer is not null"), on_missing="drop")
    assert ready.count() == 4
    with pytest.raises(ValueError, match="lacks the splits"):
        saved.read_saved_dataset(spark, path, ("train", "dev"))
    with pytest.raises(ValueError, match="no saved dataset"):
        saved.read_saved_dataset(spark, str(tmp_path / "train"))


def test_types_of_the_metadata(spark, tmp_path):
    features = {
        "n": {"dtype": "int32", "_type": "Value"}, "x": {"dtype": "float64", "_type": "Value"}, "label": {"names": ["no", "yes"], "_type": "ClassLabel"}, "tags": {"feature": {"dtype": "string", "_type": "Value"}, "_type": "Sequence"},
        "meta": {"a": {"dtype": "bool", "_type": "Value"}, "b": [{"dtype": "int64", "_type": "Value"}]}, "source_index": {"dtype": "int64", "_type": "Value"},
    }
    rows = pa.table({
        "n": pa.array([1, None], pa.int32()), "x": pa.array([0.5, None]), "label": pa.array([1, 0]), "tags": pa.array([["p", None], None], pa.list_(pa.string())),
        "meta": pa.array([{"a": True, "b": [1]}, None], pa.struct([("a", pa.bool_()), ("b", pa.list_(pa.int64()))])), "source_index": pa.array([7, 8]),
    })
    got = saved.read_saved_dataset(spark, collection(tmp_path, {"train": [rows]}, features), ("train",)).orderBy("source_index")
    a, b = got.collect()
    assert (a.n, a.x, a.label, a.tags, a.meta.a, a.meta.b, a.source_index) == (1, 0.5, 1, ["p", None], True, [1], 7) and (b.n, b.tags, b.meta) == (None, None, None)
    with pytest.raises(ValueError):
        saved._type({"_type": "Image"})


def test_round_trip(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("source_index"), F.concat(F.lit("q "), "id").alias("question"), (F.col("id") / 3).alias("x"), F.array(F.col("id").cast("string"), F.lit(None)).alias("tags"), F.when(F.col("id") % 4 == 0, "dev").otherwise("train").alias("split"))
    path = f"file://{tmp_path}/kept"
    saved.save_dataset(df.repartition(3), path)
    got = saved.read_saved_dataset(spark, path, None).select(*df.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.collect()))
