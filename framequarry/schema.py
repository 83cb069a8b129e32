"""The frame table, its long forms, and the adapter that reads frames out of an events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME_SCHEMA = T.StructType(
    [
        T.StructField("frame_id", T.LongType()),
        T.StructField("session_id", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("can_id", T.LongType()),
        *(T.StructField(c, T.BooleanType()) for c in ("extended", "rtr", "error", "fd", "brs", "esi", "xl")),
        T.StructField("dlc", T.ShortType()),
        T.StructField("data", T.ArrayType(T.ShortType())),
    ]
)

#: Codes of the event types in byte 5 of an adapted frame.
EVENT_CODES = ("click", "error", "purchase", "signup", "view")


def frames_from_events(events: DataFrame) -> DataFrame:
    """Frames out of (event_id, ts, user_id, event_type, value, props): 16 identifiers, 4 or 8 bytes, arrival order by event_id."""
    c = F.col
    k = F.get_json_object("props", "$.k").cast("long")
    b = [c("event_id") % 16, F.floor("value") % 256, F.floor(c("value") / 256) % 256, k]
    b.append(b[0].bitwiseXOR(b[1]).bitwiseXOR(b[2]).bitwiseXOR(b[3]))
    code = F.lit(None).cast("long")
    for i, name in enumerate(EVENT_CODES):
        code = F.when(c("event_type") == name, F.lit(i).cast("long")).otherwise(code)
    b += [code, c("user_id") % 256, F.lit(0).cast("long")]
    dlc = F.when(c("event_type") == "signup", 4).otherwise(8)
    off = F.lit(False)
    return events.select(
        c("event_id").alias("frame_id"), (c("event_id") % 2).alias("session_id"), F.unix_micros(c("ts").cast("timestamp")).alias("ts_us"), (c("user_id") % 16 + 256).alias("can_id"),
        off.alias("extended"), off.alias("rtr"), (c("event_type") == "error").alias("error"), off.alias("fd"), off.alias("brs"), off.alias("esi"), off.alias("xl"),
        dlc.cast("short").alias("dlc"), F.slice(F.array(*(x.cast("short") for x in b)), 1, dlc).alias("data"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def bytes_long(df: DataFrame, limit: int = 8) -> DataFrame:
    """One row for each of the first ``limit`` bytes of each frame: (frame_id, ts_us, can_id, byte_idx, byte_val)."""
    return df.select("frame_id", "ts_us", "can_id", F.posexplode(F.slice("data", 1, limit)).alias("byte_idx", "byte_val")).withColumn("byte_val", F.col("byte_val").cast("int"))


def payload_bytes(df: DataFrame, least: int = 8) -> int:
    """The length of the longest payload, from ``least`` to 64: byte positions past it hold nothing in any frame."""
    return min(64, max(least, df.agg(F.max(F.size("data"))).first()[0] or 0))


def byte_at(i: int | Column, data: str | Column = "data") -> Column:
    """The byte at position i, 0 out of range."""
    return F.coalesce(F.get(data, i if isinstance(i, Column) else F.lit(i)), F.lit(0)).cast("long")


def hex_bytes(data: str | Column = "data") -> Column:
    """The payload as upper-case hex pairs."""
    return F.array_join(F.transform(data, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "")


def seq_order() -> list[Column]:
    """Arrival order, with frame_id as the tie-break that makes it total."""
    return [F.col("ts_us"), F.col("frame_id")]


#: The same adapter for DuckDB: CTEs fr (frames; data is a list) and by (bytes), to stand after WITH.
FRAMES_SQL = """e0 AS (SELECT *, event_id % 16 AS b0, floor(value)::BIGINT % 256 AS b1, floor(value / 256)::BIGINT % 256 AS b2, json_extract_string(props, '$.k')::BIGINT AS b3,
  list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)::BIGINT - 1 AS b5, user_id % 256 AS b6 FROM events),
fr AS (SELECT event_id AS frame_id, event_id % 2 AS session_id, epoch_us(ts) AS ts_us, 256 + user_id % 16 AS can_id, false AS extended, event_type = 'error' AS error,
  CASE event_type WHEN 'signup' THEN 4 ELSE 8 END::BIGINT AS dlc, b0, b1, b2, b3, xor(xor(b0, b1), xor(b2, b3)) AS b4, b5, b6, 0::BIGINT AS b7,
  list_slice([b0, b1, b2, b3, xor(xor(b0, b1), xor(b2, b3)), b5, b6, 0], 1, CASE event_type WHEN 'signup' THEN 4 ELSE 8 END) AS data FROM e0),
by_ AS (SELECT frame_id, ts_us, can_id, unnest(range(0, len(data))) AS byte_idx, unnest(data) AS byte_val FROM fr)"""


def sql(body: str) -> str:
    """A DuckDB statement over fr and by_: ``body`` is further CTEs and the SELECT, or a SELECT alone."""
    head = "WITH " + FRAMES_SQL
    return f"{head}, {body.strip()}" if not body.strip().upper().startswith("SELECT") else f"{head} {body.strip()}"
