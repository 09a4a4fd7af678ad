"""Saved datasets: folders of Arrow shard files with their metadata, as a Spark data source.

A saved collection of splits is a folder with dataset_dict.json, which names the splits, and a folder for each. A split's folder
has state.json, which names its shards in order, dataset_info.json, which names the columns and their types, and the shards:
Arrow streams. A shard is a partition, and its record batches are passed on as they are read, so a task holds one batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "saved_dataset"

#: Types of the metadata by their Arrow names.
_TYPES = {
    "string": pa.string(), "large_string": pa.large_string(), "binary": pa.binary(), "large_binary": pa.large_binary(), "bool": pa.bool_(), "int8": pa.int8(), "int16": pa.int16(), "int32": pa.int32(),
    "int64": pa.int64(), "uint8": pa.int16(), "uint16": pa.int32(), "uint32": pa.int64(), "float16": pa.float32(), "float32": pa.float32(), "float64": pa.float64(), "date32": pa.date32(), "timestamp[s]": pa.timestamp("us"),
    "timestamp[ms]": pa.timestamp("us"), "timestamp[us]": pa.timestamp("us"), "timestamp[ns]": pa.timestamp("us"), "null": pa.null(),
}


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _json(path: str, name: str) -> dict:
    files, top = _at(path)
    try:
        with files.open_input_stream(f"{top.rstrip('/')}/{name}") as f:
            return json.loads(f.read())
    except FileNotFoundError as e:
        raise ValueError(f"{path} is no saved dataset: it has no {name}") from e


def _type(feature: dict | list) -> pa.DataType:
    """Arrow type of a column's entry in the metadata: a value, a class label, a list or a struct."""
    if isinstance(feature, list):
        return pa.list_(_type(feature[0]))
    kind = feature.get("_type")
    if kind == "Value":
        if feature["dtype"] not in _TYPES:
            raise ValueError(f"a column's type {feature['dtype']} can't be read")
        return _TYPES[feature["dtype"]]
    if kind == "ClassLabel":
        return pa.int64()
    if kind in ("Sequence", "List", "LargeList"):
        return pa.list_(_type(feature["feature"]))
    if kind is None or isinstance(kind, dict):
        return pa.struct([(k, _type(v)) for k, v in feature.items()])
    raise ValueError(f"a column of kind {kind} can't be read")


@dataclass
class _Shard(InputPartition):
    path: str
    number: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: pa.Schema, counted: bool):
        self.path, self.schema, self.counted = path.rstrip("/"), schema, counted

    def partitions(self) -> list[InputPartition]:
        names = [x["filename"] for x in _json(self.path, "state.json")["_data_files"]]
        return [_Shard(f"{self.path}/{name}", k) for k, name in enumerate(names)]

    def read(self, shard: _Shard) -> Iterator[pa.RecordBatch]:
        files, path = _at(shard.path)
        at = shard.number << 40  # places count shards and the rows of each, in order
        with files.open_input_stream(path) as f, pa.ipc.open_stream(f) as batches:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                columns = [table.column(name).cast(kind) for name, kind in zip(self.schema.names, self.schema.types) if name != "source_index" or not self.counted]
                if self.counted:
                    columns.append(pa.chunked_array([pa.array(range(at, at + len(table)), pa.int64())]))
                at += len(table)
                yield from pa.table(columns, schema=self.schema).combine_chunks().to_batches()


class SavedDataset(DataSource):
    """spark.read.format("saved_dataset").load(folder of a split). A column source_index that the data lack is added: it numbers rows
    in the order of the shards, with gaps between shards."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _fields(self) -> pa.Schema:
        features = _json(self.options["path"], "dataset_info.json")["features"]
        fields = [pa.field(name, _type(x)) for name, x in features.items()]
        return pa.schema([*fields, *([] if "source_index" in features else [pa.field("source_index", pa.int64())])])

    def schema(self) -> StructType:
        return from_arrow_schema(self._fields())

    def reader(self, schema: StructType) -> DataSourceReader:
        path = self.options["path"]
        return _Reader(path, self._fields(), "source_index" not in _json(path, "dataset_info.json")["features"])


def read_saved_dataset(spark: SparkSession, path: str, splits: tuple[str, ...] | None = ("train", "test")) -> DataFrame:
    """The splits of a saved collection as one table, with the column `split`; None: all. A split that is missing is an error, as is a
    collection whose splits differ in their columns. An empty shard, or a split without shards, gives no rows."""
    known = _json(path, "dataset_dict.json")["splits"]
    if missing := set(splits or ()) - set(known):
        raise ValueError(f"{path} lacks the splits {sorted(missing)}")
    spark.dataSource.register(SavedDataset)
    out = None
    for split in known if splits is None else splits:
        part = spark.read.format(FORMAT).load(f"{path.rstrip('/')}/{split}").withColumn("split", F.lit(split))
        if out is not None and set(part.columns) != set(out.columns):
            raise ValueError(f"split {split} has other columns than {splits[0] if splits else known[0]}")
        out = part if out is None else out.unionByName(part)
    return out


def save_dataset(df: DataFrame, path: str, split: str = "split") -> None:
    """Writes df as a saved collection below path, a local or shared folder that executors reach: a folder for each value of `split`, a
    shard for each partition of df that has rows of it. Shards are written by the tasks, under names that a repeated task writes
    again; the metadata, a few lines for each shard, by the driver at the end."""
    columns = [c for c in df.columns if c != split]
    order = df.select(*columns, split)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, writers, counts, kinds = TaskContext.get().partitionId(), {}, {}, {}
        try:
            for batch in batches:
                names = batch.column(split)
                if names.null_count:
                    raise ValueError("a row has no split")
                for value in names.unique().to_pylist():
                    own = batch.filter(pc.equal(names, value)).select(columns)
                    if value not in writers:
                        files, top = _at(path)
                        files.create_dir(f"{top.rstrip('/')}/{value}", recursive=True)
                        out = files.open_output_stream(f"{top.rstrip('/')}/{value}/data-{number:05d}.arrow")
                        writers[value] = (out, pa.ipc.new_stream(out, own.schema))
                        kinds[value], counts[value] = own.schema, 0
                    writers[value][1].write_batch(own)
                    counts[value] += len(own)
        finally:
            for out, stream in writers.values():
                stream.close()
                out.close()
        made = [(value, number, counts[value], json.dumps({f.name: _feature(f.type) for f in kinds[value]})) for value in counts]
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["split", "number", "n", "features"])

    made = order.mapInArrow(write, "split string, number bigint, n bigint, features string").collect()
    made.sort(key=lambda r: (r.split, r.number))
    files, top = _at(path)

    def put(name: str, content: dict) -> None:
        with files.open_output_stream(f"{top.rstrip('/')}/{name}") as f:
            f.write(json.dumps(content, ensure_ascii=False).encode())

    splits = list(dict.fromkeys(r.split for r in made))
    for value in splits:
        own = [r for r in made if r.split == value]
        put(f"{value}/state.json", {"_data_files": [{"filename": f"data-{r.number:05d}.arrow"} for r in own], "_split": value})
        put(f"{value}/dataset_info.json", {"features": json.loads(own[0].features), "splits": {value: {"name": value, "num_examples": sum(r.n for r in own)}}})
    put("dataset_dict.json", {"splits": splits})


def _feature(kind: pa.DataType) -> dict:
    """A column's entry in the metadata."""
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return {"feature": _feature(kind.value_type), "_type": "Sequence"}
    if pa.types.is_struct(kind):
        return {kind.field(k).name: _feature(kind.field(k).type) for k in range(kind.num_fields)}
    name = {"double": "float64", "float": "float32", "date32[day]": "date32"}.get(str(kind), str(kind).split(",")[0].removesuffix("]") + ("]" if str(kind).startswith("timestamp") else ""))
    return {"dtype": name, "_type": "Value"}
