"""Windows over arrival order, of all frames or of each identifier, without gathering all their rows in one partition: time is cut into chunks.

A chunk is a fixed span of time, so a window function runs in as many tasks as there are chunks (and identifiers); what a row needs from
beyond its chunk comes from rows copied over the edge (a look-back shorter than a chunk) or from a table of one row a chunk. Frames have
an identifier and a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry.schema import seq_order

HOUR_US = 3_600_000_000


def by_time(chunk_us: int = HOUR_US) -> Column:
    """The chunk of a frame, for orders that begin with the time."""
    return F.expr(f"ts_us div {chunk_us}")


def by_arrival(frames: int = 1 << 20) -> Column:
    """The chunk of a frame, for the order of frame_id alone, where times may run back."""
    return F.expr(f"frame_id div {frames}")


def carried(df: DataFrame, key: list[str], parts: dict[str, tuple[Column, Callable[[str], Column]]], chunk: Column | None = None) -> DataFrame:
    """df with _chunk and, for each part (aggregate of a chunk, fold over chunks), the fold of the key's earlier chunks; null in its first.

    The table of chunks has one row a key and chunk; the join deals rows by (key, _chunk), as windows inside chunks do.
    """
    rows = df.withColumn("_chunk", by_time() if chunk is None else chunk)
    table = rows.groupBy(*key, "_chunk").agg(*(aggregate.alias(name) for name, (aggregate, _) in parts.items()))
    earlier = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(table.select(*key, "_chunk", *(fold(name).over(earlier).alias(name) for name, (_, fold) in parts.items())), [*key, "_chunk"])


def previous(df: DataFrame, columns: dict[str, str], key: list[str] | None = None, chunk: Column | None = None, order: list[Column] | None = None) -> DataFrame:
    """df with each of ``columns`` (new name to column) of the key's row before; null in its first row. The key is can_id, the order that of arrival."""
    key, order = key or ["can_id"], order or seq_order()
    values = F.struct(*(F.col(c).alias(name) for name, c in columns.items()))
    rows = carried(df, key, {"_before": (F.max(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), values.alias("v"))), F.last)}, chunk)
    inside = F.lag(values).over(Window.partitionBy(*key, "_chunk").orderBy(*order))
    rows = rows.withColumn("_prev", F.coalesce(inside, F.col("_before.v")))
    return rows.select(*df.columns, *(F.col(f"_prev.{name}").alias(name) for name in columns))


def following(df: DataFrame, columns: dict[str, str], key: list[str] | None = None, chunk: Column | None = None) -> DataFrame:
    """df with each of ``columns`` (new name to column) of the key's next row in arrival order; null in its last row."""
    key, order = key or ["can_id"], seq_order()
    values = F.struct(*(F.col(c).alias(name) for name, c in columns.items()))
    rows = df.withColumn("_chunk", by_time() if chunk is None else chunk)
    firsts = rows.groupBy(*key, "_chunk").agg(F.min(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), values.alias("v"))).alias("_first"))
    after = firsts.select(*key, "_chunk", F.lead("_first").over(Window.partitionBy(*key).orderBy("_chunk")).alias("_after"))
    inside = F.lead(values).over(Window.partitionBy(*key, "_chunk").orderBy(*order))
    rows = rows.join(after, [*key, "_chunk"]).withColumn("_next", F.coalesce(inside, F.col("_after.v")))
    return rows.select(*df.columns, *(F.col(f"_next.{name}").alias(name) for name in columns))


def position(df: DataFrame, name: str = "rn", key: list[str] | None = None, chunk: Column | None = None) -> DataFrame:
    """df with the position of each row among its key's in arrival order, from 1."""
    key = key or ["can_id"]
    rows = carried(df, key, {"_count": (F.count(F.lit(1)), F.sum)}, chunk)
    inside = F.row_number().over(Window.partitionBy(*key, "_chunk").orderBy(*seq_order()))
    return rows.select(*df.columns, (F.coalesce("_count", F.lit(0)) + inside).alias(name))


def rolling_sum(df: DataFrame, value: Column, width_us: int, name: str) -> DataFrame:
    """df with the sum of ``value`` over the frames of the last ``width_us`` microseconds, equal times included."""
    rows = df.withColumn("_chunk", F.expr(f"ts_us div {width_us}")).withColumn("_v", value)
    both = rows.withColumn("_own", F.lit(True)).unionByName(rows.withColumn("_chunk", F.col("_chunk") + 1).withColumn("_own", F.lit(False)))
    w = Window.partitionBy("_chunk").orderBy("ts_us").rangeBetween(-width_us, 0)
    return both.withColumn(name, F.sum("_v").over(w)).filter("_own").drop("_chunk", "_v", "_own")


def next_row(df: DataFrame, column: str, name: str, chunk_us: int) -> DataFrame:
    """df with ``column`` of the next frame in arrival order, null at the end."""
    rows = df.withColumn("_chunk", F.expr(f"ts_us div {chunk_us}"))
    firsts = rows.groupBy("_chunk").agg(F.min(F.struct(*seq_order(), F.col(column).alias("v"))).alias("first"))
    after = firsts.withColumn("_next", F.lead("first").over(Window.orderBy("_chunk"))).select("_chunk", F.col("_next.v").alias("_next"))
    inside = F.lead(column).over(Window.partitionBy("_chunk").orderBy(*seq_order()))
    last = F.row_number().over(Window.partitionBy("_chunk").orderBy(F.desc("ts_us"), F.desc("frame_id"))) == 1
    out = rows.withColumn("_in", inside).withColumn("_last", last).join(after, "_chunk")
    return out.withColumn(name, F.when(F.col("_last"), F.col("_next")).otherwise(F.col("_in"))).drop("_chunk", "_in", "_last", "_next")


def numbered(df: DataFrame, chunk_us: int, name: str = "rn") -> DataFrame:
    """df with the position of each frame in arrival order, from 1: counts of the chunks before, then a row number inside."""
    rows = df.withColumn("_chunk", F.expr(f"ts_us div {chunk_us}"))
    sizes = rows.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_chunk").orderBy(*seq_order()))
    return rows.join(before, "_chunk").withColumn(name, F.col("_before") + inside).drop("_chunk", "_before")
