"""Structured Streaming forms: a rate-limited source, keyed processors that run the batch folds' steps, windows with watermarks, fan-out, and an observer with resumable state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from framequarry.schema import FRAME_SCHEMA, bytes_long
from framequarry.streaming.folds import Step


def frame_stream(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """Frames from a folder of Parquet files as they come; the count of files a batch is the back-pressure, nothing is dropped."""
    return spark.readStream.schema(FRAME_SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def with_time(df: DataFrame, late: str = "5 seconds") -> DataFrame:
    """Frames with a timestamp column and a watermark. Frames later than that are dropped by windows; the per-identifier folds see all in arrival order."""
    return df.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", late)


def tumbling(df: DataFrame, width: str = "500 milliseconds", slide: str | None = None) -> DataFrame:
    """Frames and identifiers of each window, tumbling or sliding."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return with_time(df).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("frames"), F.size(F.collect_set("can_id")).cast("long").alias("ids")).select("w.start", "w.end", "frames", "ids")


class StepProcessor(StatefulProcessor):
    """A fold's step per key, with its state kept as JSON between batches."""

    def __init__(self, step: Step, columns: list[str], order: list[str]):
        self.step, self.columns, self.order = step, columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        out: list[dict] = []
        batch = pd.concat(list(rows))
        for row in batch.sort_values(self.order).to_dict("records"):
            plain = {k: v.tolist() if hasattr(v, "tolist") else v for k, v in row.items()}
            state, more = self.step(state, plain)
            out += more
        self.state.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def run_stream_fold(df: DataFrame, key: str, order: list[str], step: Step, schema: str) -> DataFrame:
    """The streaming form of run_fold(): rows are in order inside a batch, batches in the order they come."""
    columns = [s.split()[0] for s in schema.split(", ")]
    return df.groupBy(key).transformWithStateInPandas(StepProcessor(step, columns, order), schema, "append", "none")


def fan_out(df: DataFrame, sinks: list[Callable[[DataFrame, int], None]], every: int = 16, slow: list[Callable[[DataFrame, int], None]] = (), checkpoint: str | None = None, available_now: bool = False):
    """Each batch goes to all ``sinks`` whole and to the ``slow`` ones one frame in ``every``; it is kept while they run. ``available_now``: the query ends with the files that are there."""
    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
            for sink in slow:
                sink(batch.filter(F.pmod(F.col("frame_id") + 1, F.lit(every)) == 0), number)
        finally:
            batch.unpersist()

    writer = df.writeStream.foreachBatch(each)
    writer = writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def observe(df: DataFrame) -> DataFrame:
    """The observer's counters of each byte, as sums and masks that merge: seen0, seen1, samples. On a stream they are state that resumes from its checkpoint."""
    return bytes_long(df).groupBy("can_id", "byte_idx").agg(F.bit_or("byte_val").alias("seen1"), F.bit_or(F.lit(255) - F.col("byte_val")).alias("seen0"), F.count(F.lit(1)).alias("samples"))


def merge_observed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two states as one, for runs that were stopped and resumed."""
    return a.unionByName(b).groupBy("can_id", "byte_idx").agg(F.bit_or("seen1").alias("seen1"), F.bit_or("seen0").alias("seen0"), F.sum("samples").alias("samples"))


def classify_live(corpus: DataFrame, k: int, say: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A sink that gives each batch's signal vectors (vec_id, embedding) their k nearest in a labelled corpus."""
    from framequarry.operators.learn import nearest

    return lambda batch, number: say(nearest(corpus, batch, k), number)
