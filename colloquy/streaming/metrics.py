"""Metric files as a stream: event counts in windows under a watermark, live early stopping, and sending to a tracker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.deliberation import early_stop
from ..sources.stores import METRICS, Ledger, Tracker


def metrics_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(METRICS).json(path)


def windowed_metrics(rows: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count and mean of each metric in each phase and window; works on streams and tables."""
    each = rows.withWatermark("timestamp", late).select("phase", "timestamp", F.explode("metrics").alias("metric", "value"))
    out = each.groupBy(F.window("timestamp", window).alias("w"), "phase", "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), "phase", "metric", "n", "mean")


def live_early_stop(rows: DataFrame, metric: str, patience: int, least: float = 0.0) -> DataFrame:
    """A row a phase whenever it has new records of metric: (phase, records, ran, best, stopped) as the fold over all records by step has them.

    The state is a phase's values by step, a pair a validation. A record that comes late takes its place among the others and the
    fold is taken anew, so the result is that of the records, whatever their order and wherever a restart fell; a step that comes
    again replaces its value. Records without step or value change nothing.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values: dict[int, float] = dict(zip(*state.get, strict=True)) if state.exists else {}
        for batch in batches:
            values |= dict(zip(batch["step"].tolist(), batch["value"].tolist(), strict=True))
        steps = sorted(values)
        ordered = [values[s] for s in steps]
        state.update((steps, ordered))
        ran = early_stop(ordered, patience, least)
        # stopped: some run of patience records had no improvement, so the fold would take no record more
        stopped = early_stop([*ordered, float("inf")], patience, least) == ran
        yield pd.DataFrame({"phase": [key[0]], "records": [len(ordered)], "ran": [ran], "best": [max(ordered[:ran], default=None)], "stopped": [stopped]})

    each = rows.select("phase", "step", F.try_element_at("metrics", F.lit(metric)).alias("value")).where("phase is not null and step is not null and value is not null and not isnan(value)")
    return each.groupBy("phase").applyInPandasWithState(fold, "phase string, records long, ran long, best double, stopped boolean", "steps array<long>, ordered array<double>", "update", GroupStateTimeout.NoTimeout)


def track(rows: DataFrame, tracker: Tracker, ledger: Ledger) -> DataStreamWriter:
    """A writer that sends metrics under `phase/` to a tracker, an epoch at a time, in order of time; the caller sets trigger and checkpoint.

    The ledger has each epoch whose metrics were sent. One that Spark replays is not sent again; one that broke off half-way is sent
    from the record after the last that was noted.
    """

    def send(batch: DataFrame, epoch: int) -> None:
        name = f"epoch-{epoch:012d}"
        if ledger.get(name) is not None:
            return
        noted = [int(x.rpartition("-")[2]) for x in ledger.names() if x.startswith(f"{name}-")]
        first = max(noted, default=-1) + 1
        ordered = batch.orderBy("timestamp", "phase", "step", F.to_json("metrics"))
        for i, row in enumerate(ordered.toLocalIterator()):
            if i >= first:
                tracker.send({f"{row['phase']}/{k}": v for k, v in (row["metrics"] or {}).items()}, row["step"])
                ledger.commit(f"{name}-{i:09d}", {})
        ledger.commit(name, {})

    return rows.writeStream.foreachBatch(send)
