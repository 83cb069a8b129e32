"""Extension points: user callables per frame or alert (E01, E02), plugins with a pushed-down guard (E03), injected predicates and scorers (E04), and a table function."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import Row

SCRIPT_SCHEMA = "frame_id long, kind string, text string, out_id long, out_data array<short>"


class Host:
    """What a script may do: send a frame, log a line, read the time of the frame at hand in milliseconds."""

    def __init__(self, frame_id: int, tick_us: int):
        self.frame_id, self.tick_us, self.rows = frame_id, tick_us, []

    def send_frame(self, can_id: int, data: list[int]) -> None:
        self.rows.append((self.frame_id, "frame", None, int(can_id), [int(x) for x in data]))

    def log(self, text: str) -> None:
        self.rows.append((self.frame_id, "log", str(text), None, None))

    def tick(self) -> int:
        return self.tick_us // 1000


def on_frame(df: DataFrame, script: Callable[[Host, int, list[int], int], None]) -> DataFrame:
    """``script(host, id, data, time)`` for each frame; what it sends and logs, and its errors as rows of kind "error", after which the stream goes on."""
    columns = [x.split()[0] for x in SCRIPT_SCHEMA.split(", ")]

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                host = Host(r.frame_id, r.ts_us)
                try:
                    script(host, r.can_id, [int(x) for x in r.data], r.ts_us)
                except Exception:
                    host.rows.append((r.frame_id, "error", traceback.format_exc(limit=1).splitlines()[-1], None, None))
                rows += host.rows
            yield pd.DataFrame(rows, columns=columns).astype({"out_id": "Int64"})

    return df.select("frame_id", "can_id", "ts_us", "data").mapInPandas(over, SCRIPT_SCHEMA)


def on_alert(alerts: DataFrame, script: Callable[[Host, str, int, int], None]) -> DataFrame:
    """``script(host, rule, id, time)`` for each row of an alert table (rule, frame_id, can_id, ts_us)."""
    columns = [x.split()[0] for x in SCRIPT_SCHEMA.split(", ")]

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                host = Host(r.frame_id, r.ts_us)
                try:
                    script(host, r.rule, r.can_id, r.ts_us)
                except Exception:
                    host.rows.append((r.frame_id, "error", traceback.format_exc(limit=1).splitlines()[-1], None, None))
                rows += host.rows
            yield pd.DataFrame(rows, columns=columns).astype({"out_id": "Int64"})

    return alerts.mapInPandas(over, SCRIPT_SCHEMA)


class Plugin(Protocol):
    """A guard that Spark pushes down, and a function over the frames that pass it."""

    schema: str

    def relevant(self) -> Column: ...

    def process(self, pdf: pd.DataFrame) -> pd.DataFrame: ...


def run_plugin(df: DataFrame, plugin: Plugin) -> DataFrame:
    return df.filter(plugin.relevant()).mapInPandas(lambda batches: (plugin.process(pdf) for pdf in batches), plugin.schema)


def scored(df: DataFrame, trigger: Column, score: Column) -> DataFrame:
    """The frames of an injected predicate with an injected score."""
    return df.filter(trigger).withColumn("score", score)


def register_decode(spark: SparkSession, signals: list[tuple], name: str = "decode_signals") -> None:
    """A SQL table function ``decode_signals(id, data)`` over a parsed dictionary: LATERAL decode_signals(can_id, data)."""
    from pyspark.sql.functions import udtf

    by_id: dict[int, list[tuple]] = {}
    for s in signals:
        if s[3] is not None:
            by_id.setdefault(s[0], []).append(s)

    class Decode:
        def eval(self, can_id: int, data: list[int]):
            size = 8 * len(data or [])
            for s in by_id.get(can_id, []):
                start, length, little = s[4], s[5], s[6]
                first = 8 * (start // 8) + 7 - start % 8
                places = [start + i for i in range(length)] if little else [8 * ((first + i) // 8) + 7 - (first + i) % 8 for i in reversed(range(length))]
                places = [p for p in places if p < size] if little else places
                raw = sum((data[p // 8] >> p % 8 & 1) << i for i, p in enumerate(places) if p < size)
                if places and start // 8 < len(data):
                    if s[7] and raw >> len(places) - 1 & 1:
                        raw -= 1 << len(places)
                    yield Row(sig_name=s[3], value=raw * s[8] + s[9])

    spark.udtf.register(name, udtf(Decode, returnType="sig_name string, value double"))


class Tools:
    """Q10: the tool calls of the remote interface as a thin layer over DataFrames; transport is left to the caller."""

    def __init__(self, df: DataFrame, signals: DataFrame | None = None, alerts: DataFrame | None = None):
        self.df, self.signals, self.alerts = df, signals, alerts

    def call(self, name: str, **args) -> DataFrame:
        from framequarry.operators import decode, store

        calls: dict[str, Callable[[], DataFrame]] = {
            "get_status": lambda: store.status(self.df),
            "get_frames": lambda: store.newest(self.df, args.get("limit", 100), args.get("id"), 2000),
            "get_ids": lambda: store.ids(self.df),
            "get_alerts": lambda: self.alerts.orderBy(F.desc("ts_us")).limit(args.get("limit", 100)),
            "list_dbc_messages": lambda: self.signals.select("msg_id", "msg_name", "msg_dlc").distinct(),
            "decode_signals": lambda: decode.decode(self.df if args.get("id") is None else self.df.filter(F.col("can_id") == args["id"]), self.signals),
        }
        if name not in calls:
            raise ValueError(f"unknown tool: {name}")
        return calls[name]()
