"""Pairs, caches, preferences, results and metrics as files. Writes replace partitions, so that reruns don't repeat rows."""

from __future__ import annotations

import json
import logging
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = "sample_id long, actor_prompt string, critic_prompt string, positive string, negative string, positive_critic string, negative_critic string, round int, delta double, direction string"
PREFERENCES = "sample_id long, prompt string, chosen string, rejected string, round int, delta double, direction string, agent string"
METRICS = "phase string, step long, timestamp timestamp, metrics map<string,double>"
AGENTS = ("actor", "critic")


#: How the records of an array lie in its file: one a line behind its comma, or each over several lines under an indent of two.
LINES, INDENTED = "lines", "indented"


def read_pairs(spark: SparkSession, path: str, whole_array: bool = False, schema: str = PAIRS) -> DataFrame:
    """JSON lines, or one JSON array in any layout, a file a task; malformed rows and a missing path raise. For arrays that many tasks read see read_array."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", whole_array).json(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").json(path)


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of one array: a record a line, commas before all but the first."""
    begun = False
    for batch in batches:
        if batch.num_rows:
            lines = pc.binary_join_element_wise(",", batch.column("value"), "")
            if not begun:
                lines = pa.concat_arrays([pa.array(["["]), batch.column("value").slice(0, 1).cast(pa.string()), lines.slice(1).cast(pa.string())])
            begun = True
            yield pa.RecordBatch.from_arrays([lines.cast(pa.string())], names=["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["]"] if begun else ["[", "]"])], names=["value"])


def write_array(rows: DataFrame, path: str, files: int | None = 1) -> None:
    """JSON arrays, one a file, record by record through a task: nothing is gathered. files=None leaves a file to each partition."""
    records = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    records = records.coalesce(files) if files else records
    records.mapInArrow(_bracketed, "value string").write.mode("overwrite").text(path)


def read_array(spark: SparkSession, path: str, schema: str = PAIRS, layout: str = LINES) -> DataFrame:
    """Records of JSON arrays, by as many tasks as the bytes make: a task starts at the first record that begins in its range.

    lines: as write_array has them. indented: as common writers lay arrays out with an indent of two, where a line feed, two
    blanks and a brace begin a record and nothing else, since texts have no line feed of their own in JSON. Malformed records
    and a missing path raise.
    """
    if layout == LINES:
        bare = F.regexp_replace(F.regexp_replace("value", r"^\s*[\[,]?\s*", ""), r"\s*[,\]]?\s*$", "")
        text = spark.read.text(path).select(bare.alias("r")).where("r <> ''")
    elif layout == INDENTED:
        # the separator takes the brace with it; the last record has the array's end behind it
        bare = F.regexp_replace("value", r"\n  \}\s*,?\s*(?:\]\s*)?$", "\n}")
        text = spark.read.option("lineSep", "\n  {").text(path).where(~F.col("value").rlike(r"^\s*\[?\s*(?:\]\s*)?$")).select(F.concat(F.lit("{"), bare).alias("r"))
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return text.select(F.from_json("r", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir, or under a temporary folder on one machine where that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/colloquy-stores/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _file_system(spark, path)
    return files.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, files = _file_system(spark, path)
    files.delete(at, True)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to path was committed."""
    return exists(spark, f"{path}/_SUCCESS")


def cached(spark: SparkSession, root: str, agent: str, iteration: int, make: Callable[[], DataFrame], reuse: bool = True) -> DataFrame:
    """Rows of root/agent=.../iteration=...; made and written first where no write was committed, where there are none, or not to be reused."""
    if agent not in AGENTS:
        raise ValueError(f"unknown agent {agent!r}")
    path = f"{root}/agent={agent}/iteration={iteration}"
    if reuse and complete(spark, path):
        found = spark.read.parquet(path)
        if not found.isEmpty():
            return found
    made = make()
    made.write.mode("overwrite").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


class Ledger:
    """What has been committed under a folder: small entries, each a file whose name appears with all of its content.

    An entry is written beside its name and renamed; a name that is there already stays as it is, so that of two writers one wins.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, name: str):
        return _file_system(self.spark, f"{self.path}/{name}.json")

    def commit(self, name: str, entry: dict[str, Any]) -> bool:
        """Whether this call made the entry."""
        at, files = self._at(name)
        if files.exists(at):
            return False
        aside = _file_system(self.spark, f"{self.path}/_{uuid.uuid4().hex}")[0]
        out = files.create(aside, False)
        out.write(bytearray(json.dumps(entry, ensure_ascii=False).encode()))
        out.close()
        if files.rename(aside, at):
            return True
        files.delete(aside, False)
        return False

    def get(self, name: str) -> dict[str, Any] | None:
        at, files = self._at(name)
        if not files.exists(at):
            return None
        stream = files.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def names(self) -> list[str]:
        """Names of all entries, in order."""
        at, files = _file_system(self.spark, self.path)
        if not files.exists(at):
            return []
        found = [x.getPath().getName() for x in files.listStatus(at)]
        return sorted(x.removesuffix(".json") for x in found if x.endswith(".json") and not x.startswith("_"))


def write_preferences(preferences: DataFrame, path: str, agents: tuple[str, ...] = AGENTS) -> None:
    """By agent. All of agents are replaced, those without rows by nothing; readers see the old rows until the new ones are written."""
    spark = preferences.sparkSession
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    preferences.where(F.col("agent").isin(*agents)).write.partitionBy("agent").parquet(staged)
    for agent in agents:
        old, files = _file_system(spark, f"{path}/agent={agent}")
        files.delete(old, True)
        new = _file_system(spark, f"{staged}/agent={agent}")[0]
        if files.exists(new) and not files.rename(new, old):
            raise OSError(f"{new} could not be moved to {old}")
    files.delete(_file_system(spark, staged)[0], True)


def read_preferences(spark: SparkSession, path: str, agent: str) -> DataFrame:
    return spark.read.schema(PREFERENCES).parquet(path).where(F.col("agent") == agent)


def write_results(results: DataFrame, path: str) -> None:
    """Everything under path/results and the same without sample_details under path/summary."""
    results.write.mode("overwrite").json(f"{path}/results")
    results.drop("sample_details").write.mode("overwrite").json(f"{path}/summary")


def append_metrics(spark: SparkSession, path: str, phase: str, metrics: dict[str, float], step: int | None = None) -> None:
    row = spark.createDataFrame([(phase, step, {k: float(v) for k, v in metrics.items()})], "phase string, step long, metrics map<string,double>")
    row.select("phase", "step", F.current_timestamp().alias("timestamp"), "metrics").coalesce(1).write.mode("append").json(path)


class MetricLog:
    """Metrics of one experiment as rows under a path, and to a tracker if there is one; NoTracker otherwise."""

    def __init__(self, spark: SparkSession, path: str, tracker: Tracker | None = None, name: str = "experiment"):
        self.spark, self.path, self.tracker = spark, path, tracker or NoTracker()
        self.log = logging.getLogger(name)

    def metrics(self, phase: str, values: dict[str, float], step: int | None = None) -> None:
        self.log.info("%s %s: %s", phase, step, values)
        append_metrics(self.spark, self.path, phase, values, step)
        self.tracker.send({f"{phase}/{k}": v for k, v in values.items()}, step)

    def read(self) -> DataFrame:
        return self.spark.read.schema(METRICS).json(self.path)

    def close(self) -> None:
        self.tracker.close()


class Tracker(Protocol):
    def send(self, values: dict[str, float], step: int | None) -> None: ...

    def close(self) -> None: ...


class NoTracker:
    """Stands where no remote tracker is."""

    def send(self, values: dict[str, float], step: int | None) -> None:
        return None

    def close(self) -> None:
        return None


def setup_logging(level: int = logging.INFO, path: str | None = None) -> logging.Logger:
    """The package's logger on the driver, to standard error and to a file if one is named; repeated calls add no handlers."""
    log = logging.getLogger("colloquy")
    log.setLevel(level)
    wanted = [logging.StreamHandler()] + ([logging.FileHandler(path, encoding="utf-8")] if path else [])
    known = {(type(h), getattr(h, "baseFilename", None)) for h in log.handlers}
    for h in wanted:
        if (type(h), getattr(h, "baseFilename", None)) not in known:
            h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
            log.addHandler(h)
    return log
