"""Decoded signals: the join with a dictionary, statistics, histograms, latest values, alarms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framequarry.functions.signals import decimal_parts, in_payload, physical, raw_value
from framequarry.operators.profile import zero
from framequarry.schema import seq_order


def decode(df: DataFrame, signals: DataFrame, compat: str = "mapper") -> DataFrame:
    """One row for each frame and signal of its message: (frame_id, ts_us, can_id, msg_name, sig_name, value, unit). Spark broadcasts the dictionary if its size allows."""
    signals = signals.withColumns(decimal_parts())
    j = df.join(signals, df["can_id"] == signals["msg_id"]).filter(in_payload()).withColumn("_raw", raw_value("data", compat)).withColumn("value", physical(F.col("_raw")))
    return j.select("frame_id", "ts_us", "can_id", "msg_name", "sig_name", "value", "unit")


def signal_stats(values: DataFrame, buckets: int = 10) -> DataFrame:
    """Count, bounds, mean, sample deviation and an equal-width histogram of each signal; the greatest value is in the last bucket, equal bounds put all in the first.

    The histogram counts each (signal, bucket) cell, so no values are gathered.
    """
    stats = values.groupBy("sig_name").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value"), zero(F.stddev_samp("value")).alias("sd"))
    span = F.col("max_value") - F.col("min_value")
    cell = F.when(span == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("value") - F.col("min_value")) / F.nullif(span, F.lit(0.0)) * buckets), F.lit(buckets - 1))).cast("int")
    cells = values.join(stats, "sig_name").withColumn("cell", cell).groupBy("sig_name").agg(*(F.count_if(F.col("cell") == i).alias(f"h{i}") for i in range(buckets)))
    return stats.join(cells, "sig_name")


def latest(values: DataFrame) -> DataFrame:
    """The last value of each signal with its bounds so far."""
    return values.groupBy("sig_name").agg(F.max_by("value", F.struct(*seq_order())).alias("last_value"), F.max("ts_us").alias("last_us"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def alarms(values: DataFrame, bounds: DataFrame) -> DataFrame:
    """Signals whose last value lies strictly beyond a bound (sig_name, low or null, high or null)."""
    j = latest(values).join(bounds, "sig_name")
    return j.withColumn("alarm", F.coalesce(F.col("last_value") < F.col("low"), F.lit(False)) | F.coalesce(F.col("last_value") > F.col("high"), F.lit(False)))


def trend(values: DataFrame, window_us: int) -> DataFrame:
    """The points of each signal's last window."""
    return values.withColumn("last_us", F.max("ts_us").over(Window.partitionBy("sig_name"))).filter(F.col("ts_us") >= F.col("last_us") - window_us)
