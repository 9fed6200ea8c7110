"""Arrow data sets as a Spark data source: IPC files by tasks and a manifest that makes them one set.

The layout is the public one of data sets saved to disk: `data-*.arrow` in the IPC stream format, `dataset_info.json` and
`state.json`, which lists the files and is written last. Files that no manifest lists (of tasks that were run twice, or of a write
that broke off) are not part of the set. Paths are file system paths that the driver and all executors share.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

STATE, INFO = "state.json", "dataset_info.json"
#: Arrow types as the layout names them.
_NAMES = {"int32": "int32", "int64": "int64", "double": "float64", "float": "float32", "string": "string", "bool": "bool"}


def manifest(path: str) -> list[str]:
    """The files of a data set; a path without a manifest raises."""
    with open(os.path.join(path, STATE), encoding="utf-8") as f:
        return [x["filename"] for x in json.load(f)["_data_files"]]


@dataclass
class _Written(WriterCommitMessage):
    files: tuple[str, ...]
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, to_arrow_schema(schema), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        name, rows, writer = f"data-{uuid.uuid4().hex}.arrow", 0, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if writer is None:
                os.makedirs(self.path, exist_ok=True)
                sink = pa.OSFile(os.path.join(self.path, name), "wb")
                writer = pa.ipc.new_stream(sink, self.schema)
            writer.write_batch(pa.RecordBatch.from_arrays(batch.columns, schema=self.schema))
            rows += batch.num_rows
        if writer is not None:
            writer.close()
            sink.close()
        return _Written((name,) if rows else (), rows)

    def commit(self, messages: list[_Written | None]) -> None:
        done = [m for m in messages if m is not None]
        old = manifest(self.path) if os.path.exists(os.path.join(self.path, STATE)) else []
        files = sorted(x for m in done for x in m.files)
        kept = files if self.overwrite else [*old, *files]
        if not kept:
            if old:
                os.remove(os.path.join(self.path, STATE))  # a set without rows is no set
        else:
            features = {f.name: {"dtype": _NAMES.get(str(f.type), str(f.type)), "_type": "Value"} for f in self.schema}
            self._put(INFO, {"features": features})
            self._put(STATE, {"_data_files": [{"filename": x} for x in kept], "_fingerprint": uuid.uuid4().hex, "_format_type": None, "_split": None})
        for x in old if self.overwrite else ():
            self._drop(x)

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            for x in m.files if m is not None else ():
                self._drop(x)

    def _put(self, name: str, content: dict) -> None:
        aside = os.path.join(self.path, f".{name}-{uuid.uuid4().hex}")
        with open(aside, "w", encoding="utf-8") as f:
            json.dump(content, f, ensure_ascii=False)
        os.replace(aside, os.path.join(self.path, name))

    def _drop(self, name: str) -> None:
        at = os.path.join(self.path, name)
        if os.path.exists(at):
            os.remove(at)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x) for x in manifest(self.path)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with pa.memory_map(os.path.join(self.path, partition.value)) as f:
            yield from pa.ipc.open_stream(f)


def local(path: str) -> str:
    """A path that open() takes; one of a store that only Spark reads raises."""
    bare = path.removeprefix("file://").removeprefix("file:")
    if ":" in bare.split("/")[0]:
        raise ValueError(f"{path} is no file system path")
    return bare


class ArrowDataset(DataSource):
    """format("arrow_dataset"): load(path) reads a set, a task a file; save(path) adds to it or replaces it."""

    @classmethod
    def name(cls) -> str:
        return "arrow_dataset"

    def schema(self) -> StructType:
        path = local(self.options["path"])
        with pa.memory_map(os.path.join(path, manifest(path)[0])) as f:
            return from_arrow_schema(pa.ipc.open_stream(f).schema)

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(local(self.options["path"]))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(local(self.options["path"]), schema, overwrite)


def write_by_agent(preferences: DataFrame, path: str, agents: tuple[str, ...]) -> list[str]:
    """A data set a folder of each agent, in place of what lay there; agents without rows get none. Returns those with one."""
    preferences.sparkSession.dataSource.register(ArrowDataset)
    for agent in agents:
        preferences.where(F.col("agent") == agent).drop("agent").write.format("arrow_dataset").mode("overwrite").save(f"{path}/{agent}")
    return [a for a in agents if os.path.exists(f"{local(path)}/{a}/{STATE}")]


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArrowDataset)
    return spark.read.format("arrow_dataset").load(path)
