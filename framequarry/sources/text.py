"""Text and message formats of frames as Column parsers: candump dialects, serial lines, JSON messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.schema import FRAME_SCHEMA

FRAME_COLUMNS = [f.name for f in FRAME_SCHEMA]


def hex_long(text: Column) -> Column:
    """A hex number as a long, null for anything else."""
    return F.when(text.rlike("^[0-9A-Fa-f]{1,15}$"), F.conv(text, 16, 10).cast("long"))


def hex_data(text: Column) -> Column:
    """Hex pairs as bytes; pairs that aren't hex and a last odd digit are left out."""
    pairs = F.regexp_extract_all(text, F.lit("(..)"), 1)
    good = F.filter(pairs, lambda x: x.rlike("^[0-9A-Fa-f]{2}$"))
    return F.transform(good, lambda x: F.conv(x, 16, 10).cast("short"))


def as_frames(df: DataFrame, **found: Column) -> DataFrame:
    """df's rows as frames: the columns given, flags false and times null where they aren't."""
    off = F.lit(False)
    base = {"frame_id": F.lit(None).cast("long"), "session_id": F.lit(None).cast("long"), "ts_us": F.lit(None).cast("long"), **{c: off for c in ("extended", "rtr", "error", "fd", "brs", "esi", "xl")}}
    out = df.select(*(({**base, **found}[c]).alias(c) for c in FRAME_COLUMNS if c != "dlc" or "dlc" in found))
    if "dlc" not in found:
        out = out.withColumn("dlc", F.size("data").cast("short"))
    return out.select(*FRAME_COLUMNS).withColumn("dlc", F.col("dlc").cast("short"))


def parse_candump(lines: DataFrame, dialect: str = "standard") -> DataFrame:
    """Frames out of lines (column value) ``(time) interface ID#DATA``.

    ``standard``: seconds with a fraction; ``us``: whole microseconds; ``digit``: seconds, and a length digit before the data (as the exporter writes).
    A second # marks FD frames, whose first digit holds flags. Comments and lines of another form are skipped; identifiers over three digits are extended.
    """
    v = F.trim("value")
    when = r"(\d+)" if dialect == "us" else r"(\d+(?:\.\d+)?)"
    pattern = rf"^\({when}\)\s+\S+\s+([0-9A-Fa-f]+)#(#?)([0-9A-Fa-f]*)\s*$"
    part = lambda i: F.regexp_extract(v, pattern, i)
    rows = lines.filter(~v.startswith("#") & ~v.startswith("//") & v.rlike(pattern))
    ts = part(1).cast("long") if dialect == "us" else (part(1).cast("decimal(20,6)") * 1_000_000).cast("long")
    flexible = part(3) == "#"
    body = F.when(flexible | F.lit(dialect in ("digit",)), F.substring(part(4), 2, 1_000_000)).otherwise(part(4))
    return as_frames(rows, ts_us=ts, can_id=hex_long(part(2)), extended=F.length(part(2)) > 3, fd=flexible, data=hex_data(body))


def read_candump(spark: SparkSession, path: str, dialect: str = "standard") -> DataFrame:
    return parse_candump(spark.read.text(path), dialect)


def parse_slcan(lines: DataFrame) -> DataFrame:
    """Serial lines t/T/r/R, identifier of 3 or 8 digits, a length digit (at most 8), data. Other lines are skipped; lower-case r and R are remote frames."""
    pattern = r"^(?:([tr])([0-9A-Fa-f]{3})|([TR])([0-9A-Fa-f]{8}))([0-9A-Fa-f])([0-9A-Fa-f]*)"
    part = lambda i: F.regexp_extract("value", pattern, i)
    dlc = F.least(hex_long(part(5)), F.lit(8))
    given = hex_data(part(6))
    data = F.transform(F.when(dlc > 0, F.sequence(F.lit(0), (dlc - 1).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.coalesce(F.get(given, i), F.lit(0)).cast("short"))
    return as_frames(lines.filter(F.col("value").rlike(pattern)), can_id=hex_long(F.concat(part(2), part(4))), extended=part(3) != "", rtr=F.lower(F.concat(part(1), part(3))) == "r", dlc=dlc, data=data)


def parse_esp(lines: DataFrame) -> DataFrame:
    """``RX EXT|STD id dlc b0 b1 ...``; lines with another head, a bad identifier or a length outside 0 to 8 are skipped, missing bytes are 0."""
    t = F.split("value", " ")
    rows = lines.withColumn("t", t).withColumn("ident", hex_long(F.get("t", F.lit(2)))).withColumn("n", F.expr("try_cast(get(t, 3) as int)"))
    rows = rows.filter((F.get("t", F.lit(0)) == "RX") & F.col("ident").isNotNull() & F.col("n").between(0, 8))
    every = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    return as_frames(rows, can_id=F.col("ident"), extended=F.get("t", F.lit(1)) == "EXT", dlc=F.col("n"), data=F.transform(every, lambda i: F.coalesce(hex_long(F.get("t", i + 4)), F.lit(0)).cast("short")))


_FRAME_JSON = "id long, extended boolean, rtr boolean, fd boolean, dlc int, timestamp long, data string"


def parse_messages(messages: DataFrame) -> DataFrame:
    """Frames of JSON messages {"type": "frames", "frames": [...]} (column value); other types and broken JSON give none."""
    m = messages.select(F.from_json("value", f"type string, frames array<struct<{', '.join(x.replace(' ', ': ') for x in _FRAME_JSON.split(', '))}>>").alias("m")).filter("m.type = 'frames'")
    rows = m.select(F.posexplode("m.frames").alias("pos", "f"))
    flag = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(False))
    return as_frames(rows, ts_us=F.col("f.timestamp"), can_id=F.col("f.id"), extended=flag("extended"), rtr=flag("rtr"), fd=flag("fd"), data=hex_data(F.coalesce("f.data", F.lit(""))))


def parse_send(bodies: DataFrame) -> DataFrame:
    """Frames of posted bodies {"id": 256 or "0x100", "extended", "dlc", "data"}: extended if said or the identifier is above 0x7FF, length 8 without one, data padded with 0; bodies without an identifier give none."""
    b = bodies.select(F.from_json("value", "id string, extended boolean, dlc int, data string").alias("b"))
    text = F.col("b.id")
    ident = F.when(F.lower(text).startswith("0x"), hex_long(F.substring(text, 3, 15))).otherwise(F.expr("try_cast(b.id as bigint)"))
    rows = b.withColumn("ident", ident).withColumn("n", F.least(F.greatest(F.coalesce("b.dlc", F.lit(8)), F.lit(0)), F.lit(64))).filter("ident is not null")
    given = hex_data(F.coalesce("b.data", F.lit("")))
    every = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    return as_frames(rows, can_id=F.col("ident"), extended=F.coalesce("b.extended", F.col("ident") > 0x7FF), dlc=F.col("n"), data=F.transform(every, lambda i: F.coalesce(F.get(given, i), F.lit(0)).cast("short")))
