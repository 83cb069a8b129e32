"""Queries of a frame store: filters, slices, sorted reads, set operations, and row views of the text exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry.schema import hex_bytes, seq_order


def id_of(text: str) -> int:
    """An identifier written in hex, 0x optional."""
    return int(text.strip(), 16)


def by_hex_id(df: DataFrame, text: str) -> DataFrame:
    """the frames of one identifier; an empty text takes all, a text that is no hex number none."""
    if not text.strip():
        return df
    try:
        return df.filter(F.col("can_id") == id_of(text))
    except ValueError:
        return df.filter(F.lit(False))


def export_filter(df: DataFrame, low: int, high: int, start: int | None = None, stop: int | None = None) -> DataFrame:
    """identifiers and, where given, times inside inclusive bounds."""
    out = df.filter(F.col("can_id").between(low, high))
    return out.filter(F.col("ts_us").between(start, stop)) if start is not None and stop is not None else out


def events_in_range(df: DataFrame, start: int, stop: int, can_id: int | None = None) -> DataFrame:
    """frames inside an inclusive time range, of one identifier or all, in arrival order."""
    out = df.filter(F.col("ts_us").between(start, stop))
    return (out if can_id is None else out.filter(F.col("can_id") == can_id)).orderBy(*seq_order())


def search_payload(df: DataFrame, pattern: list[int], mask: list[int] | None = None, can_id: int | None = None, limit: int | None = None) -> DataFrame:
    """frames that hold ``pattern`` under a byte mask, with the first offset; an empty pattern finds nothing."""
    n, mask = len(pattern), mask or [255] * len(pattern)
    if not n:
        return df.withColumn("offset", F.lit(0)).filter(F.lit(False))
    fits = lambda o: _all(F.get("data", o + i).cast("int").bitwiseAND(mask[i]) == (pattern[i] & mask[i]) for i in range(n))
    offsets = F.when(F.size("data") >= n, F.sequence(F.lit(0), F.size("data") - n)).otherwise(F.array().cast("array<int>"))
    out = (df if can_id is None else df.filter(F.col("can_id") == can_id)).withColumn("offset", F.get(F.filter(offsets, fits), F.lit(0))).filter(F.col("offset").isNotNull())
    return out if limit is None else out.orderBy(*seq_order()).limit(limit)


def _all(parts) -> Column:
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def decimate(df: DataFrame, n: int) -> DataFrame:
    """every n-th frame in arrival order. frame_id is the position in the recording, so no sort is needed."""
    return df.filter(F.pmod(F.col("frame_id") + 1, F.lit(n)) == 0)


def display_rows(df: DataFrame) -> DataFrame:
    """the frame table's text columns."""
    ident = F.when(F.col("extended"), F.lpad(F.hex("can_id"), 8, "0")).otherwise(F.lpad(F.hex("can_id"), 3, "0"))
    kind = F.when(F.col("xl"), "XL").when(F.col("fd"), "FD").when(F.col("extended"), "J1939").otherwise("CAN")
    return df.select("frame_id", ident.alias("id_text"), kind.alias("kind"), F.array_join(F.transform("data", lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), " ").alias("data_text"))


def compare_filter(df: DataFrame, can_id: int | None, start_s: float | None, stop_s: float | None) -> DataFrame:
    """rows of one identifier and a range of seconds, each bound optional."""
    if can_id is not None:
        df = df.filter(F.col("can_id") == can_id)
    if start_s is not None:
        df = df.filter(F.col("ts_us") / 1e6 >= start_s)
    return df if stop_s is None else df.filter(F.col("ts_us") / 1e6 <= stop_s)


def sort_rows(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """The table by one column, ties in arrival order. Numbers sort as numbers, payloads as text."""
    key = hex_bytes() if column == "data" else F.col(column)
    return df.orderBy(key.desc() if descending else key, *seq_order())


def newest(df: DataFrame, limit: int, can_id: int | None = None, most: int = 5000) -> DataFrame:
    """Newest first, the limit held between 1 and ``most``."""
    out = df if can_id is None else df.filter(F.col("can_id") == can_id)
    return out.orderBy(F.desc("ts_us"), F.desc("frame_id")).limit(max(1, min(limit, most)))


def top_ids(df: DataFrame, n: int, by: str = "frames") -> DataFrame:
    """The n identifiers with most frames or bytes."""
    out = df.groupBy("can_id").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.col("dlc").cast("long")).alias("bytes"))
    return out.orderBy(F.desc(by), "can_id").limit(n)


def by_can_id(df: DataFrame, can_id: int, session: int = -1, limit: int = 1000) -> DataFrame:
    """Q01: frames of an identifier, of one session or (-1) all, oldest first."""
    return _session(df.filter(F.col("can_id") == can_id), session).orderBy(*seq_order()).limit(limit)


def time_range(df: DataFrame, start: int, stop: int, session: int = -1, limit: int = 10_000) -> DataFrame:
    """Q02: frames inside an inclusive time range, oldest first."""
    return _session(df.filter(F.col("ts_us").between(start, stop)), session).orderBy(*seq_order()).limit(limit)


def total(df: DataFrame, session: int = -1) -> DataFrame:
    """Q03: the count of frames."""
    return _session(df, session).agg(F.count(F.lit(1)).alias("frames"))


def _session(df: DataFrame, session: int) -> DataFrame:
    return df if session < 0 else df.filter(F.col("session_id") == session)


def sessions(table: DataFrame) -> DataFrame:
    """Q04: (id, label, started, ended) newest first, a missing label empty."""
    return table.select("id", F.coalesce("label", F.lit("")).alias("label"), "started", "ended").orderBy(F.desc("started"), F.desc("id"))


def sessions_of(df: DataFrame) -> DataFrame:
    """The session table that a frame table implies."""
    return df.groupBy(F.col("session_id").alias("id")).agg(F.min("ts_us").alias("started"), F.max("ts_us").alias("ended")).withColumn("label", F.when(F.col("id") == 0, F.lit("even")))


def reset(df: DataFrame) -> DataFrame:
    """Q05: the emptied store, to overwrite it with."""
    return df.limit(0)


def status(df: DataFrame, baud: int = 500_000) -> DataFrame:
    """Q06: one row of totals: frames, identifiers, frames a second, bus load over the whole recording."""
    from framequarry.operators.profile import frame_bits

    span = (F.max("ts_us") - F.min("ts_us")) / 1e6
    return df.agg(
        F.count(F.lit(1)).alias("frames"), F.countDistinct("can_id").alias("unique_ids"), F.coalesce(F.count(F.lit(1)) / F.nullif(span, F.lit(0.0)), F.lit(0.0)).alias("fps"),
        F.coalesce(100.0 * F.sum(frame_bits()) / F.nullif(span * baud, F.lit(0.0)), F.lit(0.0)).alias("bus_load_pct"),
    )


def ids(df: DataFrame) -> DataFrame:
    """Q08: each identifier with its count and last time."""
    return df.groupBy("can_id").agg(F.count(F.lit(1)).alias("frames"), F.max("ts_us").alias("last_us")).orderBy("can_id")


def common_ids(df: DataFrame, group: str) -> DataFrame:
    """Identifiers present in every group."""
    each = df.select("can_id", group).distinct()
    groups = df.agg(F.countDistinct(group).alias("groups"))
    return each.groupBy("can_id").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(groups)).filter("n = groups").select("can_id")


def minus_ids(df: DataFrame, other: DataFrame) -> DataFrame:
    """Identifiers of df that other lacks."""
    return df.select("can_id").distinct().join(other.select("can_id").distinct(), "can_id", "left_anti")


def id_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Identifiers only in a (removed) or only in b (added)."""
    return minus_ids(a, b).withColumn("change", F.lit("removed")).unionByName(minus_ids(b, a).withColumn("change", F.lit("added")))


def merge_streams(*parts: tuple[str, DataFrame]) -> DataFrame:
    """Several sources as one table with the source's name; columns that one lacks are null."""
    out = None
    for name, df in parts:
        df = df.withColumn("origin", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def distinct_ids(df: DataFrame) -> DataFrame:
    """U05."""
    return df.select("can_id").dropDuplicates(["can_id"])


def csv_rows(df: DataFrame) -> DataFrame:
    """The rows of the CSV export. Index is the position in arrival order, which frame_id holds."""
    ident = F.when(F.col("extended"), F.lpad(F.hex("can_id"), 8, "0")).otherwise(F.lpad(F.hex("can_id"), 3, "0"))
    return df.select(
        F.col("frame_id").alias("Index"), F.col("ts_us").alias("Timestamp_us"), ident.alias("ID_hex"), F.col("extended").cast("int").alias("Extended"),
        F.col("rtr").cast("int").alias("RTR"), F.col("fd").cast("int").alias("FD"), F.col("dlc").cast("int").alias("DLC"), hex_bytes(F.slice("data", 1, 64)).alias("Data_hex"),
    )


def candump_line(iface: str = "can0", dialect: str = "digit") -> Column:
    """A candump line. Dialects: ``standard`` (seconds, plain data), ``digit`` (seconds, a length digit before the data), ``us`` (whole microseconds, unpadded identifier, length digit)."""
    ident = F.hex("can_id") if dialect == "us" else F.when(F.col("extended"), F.lpad(F.hex("can_id"), 8, "0")).otherwise(F.lpad(F.hex("can_id"), 3, "0"))
    when = F.col("ts_us").cast("string") if dialect == "us" else F.format_string("%d.%06d", F.expr("ts_us div 1000000"), F.col("ts_us") % 1_000_000)
    digit = F.lit("") if dialect == "standard" else F.col("dlc").cast("string")
    flags = F.concat(F.lit("##"), digit) if dialect == "us" else F.lit("##0")
    body = F.when(F.col("fd") | F.col("xl"), F.concat(flags, hex_bytes(F.slice("data", 1, 64)))).otherwise(F.concat(F.lit("#"), digit, hex_bytes(F.slice("data", 1, 8))))
    return F.concat(F.lit("("), when, F.lit(f") {iface} "), ident, body)


def candump_rows(df: DataFrame, iface: str = "can0", dialect: str = "digit") -> DataFrame:
    return df.select("frame_id", candump_line(iface, dialect).alias("line"))


def frame_json() -> Column:
    """One frame as the JSON object of the network protocols."""
    return F.to_json(F.struct(F.col("can_id").alias("id"), "extended", "rtr", "fd", F.col("dlc").cast("int").alias("dlc"), F.col("ts_us").alias("timestamp"), hex_bytes().alias("data")))


def json_batches(df: DataFrame, size: int = 500) -> DataFrame:
    """Frames in batches of ``size`` positions, each one JSON message; a batch is bounded by its size."""
    rows = df.select(F.expr(f"frame_id div {size}").alias("batch"), "frame_id", F.struct(F.col("can_id").alias("id"), "extended", "rtr", "fd", F.col("dlc").cast("int").alias("dlc"), F.col("ts_us").alias("timestamp"), hex_bytes().alias("data")).alias("f"))
    made = rows.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("frame_id", "f"))).alias("fs"))
    return made.select("batch", F.size("fs").cast("long").alias("n"), F.to_json(F.struct(F.lit("frames").alias("type"), F.size("fs").alias("count"), F.transform("fs", lambda x: x["f"]).alias("frames"))).alias("message"))


def id_frequency(df: DataFrame) -> DataFrame:
    """Frames an identifier and the mean interval (last - first) / (n - 1) in seconds; 0 for a single frame."""
    out = df.groupBy("can_id").agg(F.count(F.lit(1)).alias("frames"), F.min("ts_us").alias("first"), F.max("ts_us").alias("last"))
    return out.select("can_id", "frames", F.when(F.col("frames") > 1, (F.col("last") - F.col("first")) / 1e6 / (F.col("frames") - 1)).otherwise(0.0).alias("mean_interval_s"))


def window_trim(df: DataFrame, value: Column, window_us: int) -> DataFrame:
    """Per identifier the points of its last window, with their least and greatest value."""
    last = F.max("ts_us").over(Window.partitionBy("can_id"))
    kept = df.withColumn("value", value).withColumn("last", last).filter(F.col("ts_us") >= F.col("last") - window_us)
    return kept.groupBy("can_id").agg(F.count(F.lit(1)).alias("points"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
