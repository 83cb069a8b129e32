"""Binary recordings: the MCAN format with or without zstd (S03, S04, K05, K06), PCAP (K04), channel blocks (K07), GVRET streams."""

from __future__ import annotations

import io
import os
import struct
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from framequarry.schema import FRAME_SCHEMA

# Fixed values of the formats.
MCAN_MAGIC, MCAN_VERSION = 0x4E41434D, 1
MCAN_FLAGS = (("extended", 0x01), ("rtr", 0x02), ("error", 0x04), ("fd", 0x08), ("xl", 0x10))
PCAP_MAGIC, PCAP_LINKTYPE, PCAP_SNAPLEN = 0xA1B2C3D4, 227, 65535
GVRET_HEAD = b"\xf1\x00"
#: Files of fewer bytes are not worth compressing.
LEAST_COMPRESSED = 512


def _body(row) -> bytes:
    return b"" if row["data"] is None else bytes(int(x) for x in row["data"])


def decode_mcan(blob: bytes) -> list[tuple]:
    """(frame_id, None, ts_us, can_id, extended, rtr, error, fd, brs, esi, xl, dlc, data) of each whole record; a wrong magic gives none, the version isn't looked at. zstd frames are unpacked."""
    if blob[:4] == b"\x28\xb5\x2f\xfd":
        blob = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(blob)).read()
    if len(blob) < 8 or struct.unpack_from("<I", blob)[0] != MCAN_MAGIC:
        return []
    out, at = [], 8
    while at + 14 <= len(blob):
        ts, ident, flags = struct.unpack_from("<QIB", blob, at)
        wide = bool(flags & 0x10)
        if at + 14 + wide > len(blob):
            break
        n = min(struct.unpack_from("<H", blob, at + 13)[0], 64) if wide else blob[at + 13]
        at += 14 + wide
        size = min(n, 64)
        if at + size > len(blob):
            break
        has = {name: bool(flags & bit) for name, bit in MCAN_FLAGS}
        out.append((len(out), None, ts, ident, has["extended"], has["rtr"], has["error"], has["fd"], False, False, wide, n, list(blob[at : at + size])))
        at += size
    return out


def encode_mcan(rows: Iterator, head: bool = True) -> bytes:
    """Rows with the frame columns as MCAN bytes."""
    out = [struct.pack("<II", MCAN_MAGIC, MCAN_VERSION)] if head else []
    for r in rows:
        flags = sum(bit for name, bit in MCAN_FLAGS if r[name])
        body = _body(r)[:64]
        out.append(struct.pack("<QIB", r["ts_us"], r["can_id"], flags) + (struct.pack("<H", r["dlc"]) if r["xl"] else struct.pack("<B", r["dlc"])) + body.ljust(min(r["dlc"], 64), b"\0"))
    return b"".join(out)


def packed(blob: bytes) -> bytes:
    """A recording as a zstd frame, if it is long enough."""
    return zstandard.ZstdCompressor(level=1).compress(blob) if len(blob) >= LEAST_COMPRESSED else blob


def encode_mcan_zstd(rows: Iterator) -> bytes:
    return packed(encode_mcan(rows))


def encode_pcap(rows: Iterator) -> bytes:
    """Rows as a capture of link type 227; payloads are cut at 8 bytes, the identifier carries flags in bits 31 and 30."""
    out = [struct.pack("<IHHIIII", PCAP_MAGIC, 2, 4, 0, 0, PCAP_SNAPLEN, PCAP_LINKTYPE)]
    for r in rows:
        ident = r["can_id"] | (0x80000000 if r["extended"] else 0) | (0x40000000 if r["fd"] else 0)
        body = _body(r)[: min(r["dlc"], 8)]
        out.append(struct.pack("<IIII", r["ts_us"] // 1_000_000, r["ts_us"] % 1_000_000, 16, 16) + struct.pack("<IB3x", ident, min(r["dlc"], 8)) + body.ljust(8, b"\0"))
    return b"".join(out)


def encode_channels(rows: Iterator) -> bytes:
    """An identification block, then for each identifier a channel block and a data block of (relative seconds, first byte) pairs."""
    block = lambda tag, body: tag + b"\0" * (16 - len(tag)) + struct.pack("<Q", 24 + len(body)) + body
    channels: dict[int, list[bytes]] = {}
    start = None
    for r in rows:
        start = r["ts_us"] if start is None else start
        channels.setdefault(r["can_id"], []).append(struct.pack("<dd", (r["ts_us"] - start) / 1e6, float(_body(r)[0]) if _body(r) else 0.0))
    out = [block(b"IDBLOCK", b"")]
    for ident, samples in sorted(channels.items()):
        out += [block(b"CNBLOCK", f"CAN_ID_0x{ident:03x}".encode()[:32].ljust(32, b"\0")), block(b"DTBLOCK", b"".join(samples))]
    return b"".join(out)


def decode_channels(blob: bytes) -> dict[str, list[tuple[float, float]]]:
    out, name, at = {}, "", 0
    while at + 24 <= len(blob):
        tag, size = blob[at : at + 7], struct.unpack_from("<Q", blob, at + 16)[0]
        body = blob[at + 24 : at + size]
        if tag == b"CNBLOCK":
            name = body.rstrip(b"\0").decode()
        elif tag == b"DTBLOCK":
            out[name] = list(struct.iter_unpack("<dd", body))
        at += size
    return out


def feed_gvret(buf: bytes) -> tuple[list[tuple[int, bool, bytes]], bytes]:
    """(identifier, extended, data) of each whole packet, and the bytes to keep: a packet not yet whole, or a last byte that may begin one. Empty packets of identifier 0 are skipped."""
    out = []
    while True:
        at = buf.find(GVRET_HEAD)
        if at < 0:
            return out, buf[-1:]
        buf = buf[at:]
        if len(buf) < 11 or len(buf) < 11 + (n := min(buf[10] & 0x0F, 8)):
            return out, buf
        ident = struct.unpack_from("<I", buf, 6)[0]
        if ident & 0x1FFFFFFF or n:
            out.append((ident & 0x1FFFFFFF, bool(ident & 0x80000000), buf[11 : 11 + n]))
        buf = buf[11 + n :]


def read_mcan(spark: SparkSession, path: str) -> DataFrame:
    """Recordings through Spark's own file reader, so any store works; one file is one task, since a recording has no split points."""
    def over(batches):
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame([(*r, name) for r in decode_mcan(bytes(content))], columns=[*(f.name for f in FRAME_SCHEMA), "file"]).astype({"session_id": "Int64"})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FRAME_SCHEMA) + ", file string"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(over, schema)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _McanReader(DataSourceReader):
    """One partition a file. Bounds on ts_us and can_id that Spark pushes down are applied while records are decoded."""

    def __init__(self, path: str):
        self.path, self.bounds = path, []

    def pushFilters(self, filters):
        from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThanOrEqual

        ours = {EqualTo: lambda a, b: a == b, GreaterThanOrEqual: lambda a, b: a >= b, LessThanOrEqual: lambda a, b: a <= b}
        for f in filters:
            if type(f) in ours and f.attribute in (("ts_us",), ("can_id",)):
                self.bounds.append((2 if f.attribute == ("ts_us",) else 3, type(f).__name__, f.value))
            else:
                yield f

    def partitions(self):
        names = [os.path.join(self.path, x) for x in sorted(os.listdir(self.path))] if os.path.isdir(self.path) else [self.path]
        return [_File(n) for n in names if n.endswith((".mcan", ".zst"))]

    def read(self, partition):
        compare = {"EqualTo": lambda a, b: a == b, "GreaterThanOrEqual": lambda a, b: a >= b, "LessThanOrEqual": lambda a, b: a <= b}
        with open(partition.path, "rb") as f:
            for row in decode_mcan(f.read()):
                if all(compare[kind](row[i], value) for i, kind, value in self.bounds):
                    yield row


class _McanWriter(DataSourceWriter):
    """One recording a task, rows in the order they come; zstd from 512 bytes on if asked for."""

    def __init__(self, path: str, compress: bool, overwrite: bool):
        self.path, self.compress, self.overwrite = path, compress, overwrite

    def write(self, rows):
        from pyspark import TaskContext

        blob = encode_mcan(rows)
        if len(blob) <= 8:
            return WriterCommitMessage()
        body = packed(blob) if self.compress else blob
        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"part-{TaskContext.get().partitionId():05d}.mcan" + ".zst" * (body is not blob))
        with open(f"{name}.tmp", "wb") as f:
            f.write(body)
        os.replace(f"{name}.tmp", name)
        return WriterCommitMessage()


class McanSource(DataSource):
    """format("mcan") over files on a path that all executors mount (read_mcan() covers other stores). Options: path, compression=zstd."""

    @classmethod
    def name(cls):
        return "mcan"

    def schema(self):
        return FRAME_SCHEMA

    def reader(self, schema):
        return _McanReader(self.options["path"])

    def writer(self, schema, overwrite):
        return _McanWriter(self.options["path"], self.options.get("compression") == "zstd", overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(McanSource)


def write_store(df: DataFrame, path: str) -> None:
    """Appends frames to the store, a folder a session."""
    df.write.mode("append").partitionBy("session_id").option("compression", "zstd").parquet(path)


def session_files(df: DataFrame, encode=encode_mcan) -> DataFrame:
    """One binary file (session_id, content) for each session, encoded where its rows are. A file is one value, so a session must fit in a task's memory; longer recordings go to format("mcan") by part."""
    def over(pdf):
        import pandas as pd

        rows = pdf.sort_values(["ts_us", "frame_id"]).to_dict("records")
        return pd.DataFrame([(pdf["session_id"].iloc[0], encode(rows))], columns=["session_id", "content"])

    return df.groupBy("session_id").applyInPandas(over, "session_id long, content binary")


def session_digests(df: DataFrame, encode=encode_mcan) -> DataFrame:
    return session_files(df, encode).select("session_id", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
