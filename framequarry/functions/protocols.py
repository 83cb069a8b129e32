"""Diagnostic and transport protocols as Column builders and dimension joins over frames or raw payload arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.functions import protocol_tables as T
from framequarry.functions.signals import raw_little
from framequarry.schema import byte_at


def name_of(table: dict[int, str], code: Column, other: Column) -> Column:
    """The table's name for a code; ``other`` where it has none. The tables are small literals, so this is one map lookup and no join."""
    names = F.create_map(*(x for k, v in table.items() for x in (F.lit(k).cast("long"), F.lit(v))))
    return F.coalesce(F.try_element_at(names, code.cast("long")), other)


def hex_text(prefix: str, code: Column, width: int = 2, upper: bool = False) -> Column:
    digits = F.lpad(F.hex(code.cast("long")), width, "0")
    return F.concat(F.lit(prefix), digits if upper else F.lower(digits))


def be16(i: int, data: str = "data") -> Column:
    return byte_at(i, data) * 256 + byte_at(i + 1, data)


def be(i: int, n: int, data: str = "data") -> Column:
    out = F.lit(0).cast("long")
    for k in range(n):
        out = out * 256 + byte_at(i + k, data)
    return out


def bits(x: Column, shift: int, mask: int) -> Column:
    return F.shiftright(x.cast("long"), shift).bitwiseAND(F.lit(mask).cast("long"))


# F09
def is_obd() -> Column:
    return (F.col("can_id") == 0x7DF) | F.col("can_id").between(0x7E0, 0x7EF)


def looks_like_uds() -> Column:
    wide = (F.shiftright("can_id", 16) == 0x18DA) | (F.col("can_id") == 0x18DB33F1)
    return (F.col("dlc") >= 1) & F.when(F.col("extended"), wide).otherwise(F.col("can_id").between(0x700, 0x7FF))


def is_j1939() -> Column:
    return F.col("extended")


def is_canopen() -> Column:
    ident = F.col("can_id").bitwiseAND(0x7FF)
    return ~F.col("extended") & ((ident == 0) | ident.between(0x080, 0x77F))


def j1939_fields(pdu: str = "standard") -> list[Column]:
    """The parts of a 29-bit identifier. ``standard`` leaves the destination out of PDU1 group numbers and takes the group extension into PDU2 ones; ``compat`` does the reverse."""
    c = F.col("can_id")
    pf, ps = bits(c, 16, 0xFF), bits(c, 8, 0xFF)
    base = bits(c, 25, 1) * 131072 + bits(c, 24, 1) * 65536 + pf * 256
    first = pf < 240
    with_ps = ~first if pdu == "standard" else first
    return [
        bits(c, 26, 7).alias("priority"), bits(c, 24, 1).alias("data_page"), pf.alias("pdu_format"), ps.alias("pdu_specific"), bits(c, 0, 0xFF).alias("source"),
        first.alias("pdu1"), F.when(first, ps).otherwise(0xFF).alias("destination"), F.when(with_ps, base + ps).otherwise(base).alias("pgn"),
    ]


def j1939_id(priority: Column, pgn: Column, pf: Column, ps: Column, source: Column) -> Column:
    """The identifier from its parts."""
    return priority * 67108864 + bits(pgn, 17, 1) * 33554432 + bits(pgn, 16, 1) * 16777216 + pf * 65536 + ps * 256 + source


def spn_table(spark: SparkSession) -> DataFrame:
    rows = [(p[0], p[1], p[2], *(s[0], s[1], s[2], s[3], s[4], float(s[5]), float(s[6]), s[7]), i) for p in T.PGNS for i, s in enumerate(p[3])]
    return spark.createDataFrame(rows, "pgn long, pgn_name string, label string, spn int, spn_name string, byte_off int, bit_off int, bits int, resolution double, off double, unit string, ord int")


def decode_spns(df: DataFrame, pdu: str = "standard") -> DataFrame:
    """The parameters of each J1939 frame; 0 where the parameter starts past the payload, bytes past it read 0."""
    rows = df.filter(is_j1939()).select("*", *j1939_fields(pdu))
    j = rows.join(spn_table(df.sparkSession), "pgn")
    raw = raw_little("data", "byte_off * 8 + bit_off", "bits")
    value = F.when(F.col("byte_off") >= F.size("data"), F.lit(0.0)).otherwise(raw.cast("double") * F.col("resolution") + F.col("off"))
    return j.withColumn("value", value)


def pgn_name() -> Column:
    return name_of({p[0]: p[1] for p in T.PGNS}, F.col("pgn"), hex_text("PGN 0x", F.col("pgn"), 5, True))


def source_name(sa: Column) -> Column:
    return name_of(T.SOURCES, sa, hex_text("SA 0x", sa))


def obd_fields() -> list[Column]:
    """Length, type, mode and PID of a single-frame OBD message; mode and PID are 0 outside the OBD identifiers."""
    b1, long = byte_at(1), F.size("data") >= 2
    request = (F.col("can_id") == 0x7DF) | F.col("can_id").between(0x7E0, 0x7E7)
    response = F.col("can_id").between(0x7E8, 0x7EF)
    ours = long & (request | response)
    answer, ask = ours & b1.between(0x41, 0x4A), ours & b1.between(0x01, 0x0A)
    mode = F.when(answer, b1 - 0x40).when(ask, b1).otherwise(F.lit(0).cast("long"))
    pid = F.when(ours & (F.size("data") >= 3), byte_at(2)).otherwise(F.lit(0).cast("long"))
    pid = F.when((mode == 1) & (F.size("data") >= 4) & (pid == 0), be16(2)).otherwise(pid)
    return [F.when(ours, byte_at(0).bitwiseAND(0x0F)).otherwise(0).alias("len"), F.when(answer, "Response").when(ask, "Request").otherwise("Unknown").alias("type"), mode.alias("mode"), pid.alias("pid")]


def pid_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, p, n, u, float(s), float(o), k) for m, p, n, u, s, o, k in T.OBD_PIDS], "mode long, pid long, pid_name string, unit string, scale double, off double, n_bytes int")


def decode_obd(df: DataFrame) -> DataFrame:
    """OBD messages with mode and PID names, unit and value; unknown PIDs and short payloads have value 0."""
    rows = df.select("*", *obd_fields()).join(pid_table(df.sparkSession), ["mode", "pid"], "left")
    n = F.size("data")
    value = F.when(F.col("n_bytes").isNull() | (n < 4) | ((F.col("n_bytes") >= 2) & (n < 5)), F.lit(0.0)).otherwise(F.when(F.col("n_bytes") >= 2, be16(3)).otherwise(byte_at(3)) * F.col("scale") + F.col("off"))
    return rows.withColumn("value", value).withColumn("mode_name", name_of(T.OBD_MODES, F.col("mode"), hex_text("Mode 0x", F.col("mode")))).withColumn("pid_name", F.coalesce("pid_name", hex_text("PID 0x", F.col("pid"), 4))).withColumn("unit", F.coalesce("unit", F.lit("")))


def dtc_text(raw: Column) -> Column:
    """A trouble code as text; empty for 0."""
    text = F.concat(F.substring(F.lit("PCBU"), (bits(raw, 14, 3) + 1).cast("int"), F.lit(1)), bits(raw, 12, 3).cast("string"), F.lpad(F.hex(bits(raw, 0, 0xFFF)), 3, "0"))
    return F.when(raw == 0, "").otherwise(text)


def dtcs() -> Column:
    """The trouble codes of a response of mode 3, 7 or 10, in order, zero codes left out. Needs obd_fields()."""
    n = F.least(F.expr("cast((len - 1) div 2 as int)"), F.expr("cast((size(data) - 2) div 2 as int)"))
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    raw = lambda i: F.coalesce(F.get("data", 2 + 2 * i), F.lit(0)).cast("long") * 256 + F.coalesce(F.get("data", 3 + 2 * i), F.lit(0)).cast("long")
    codes = F.filter(F.transform(every, lambda i: dtc_text(raw(i))), lambda x: x != "")
    return F.when((F.col("type") == "Response") & F.col("mode").isin(3, 7, 10), codes).otherwise(F.array().cast("array<string>"))


def uds_fields(data: str = "data") -> list[Column]:
    """Type, service, sub-function, data identifier and response code of a payload."""
    b0, n = byte_at(0, data), F.size(data)
    flow = (b0.bitwiseAND(0xF0) == 0x30) & (b0.bitwiseAND(0x0F) <= 2)
    kind = F.when(n < 1, "Unknown").when(flow, "FlowControl").when((b0 == 0x7F) & (n >= 3), "Negative").when(b0.between(0x40, 0x7E), "Positive").when(b0.between(0x10, 0x3E), "Request").otherwise("Unknown")
    wide = b0.isin(0x22, 0x2E, 0x2A, 0x2F) & (n >= 3)
    none = F.lit(0).cast("long")
    return [
        kind.alias("uds_type"), F.when(kind == "Negative", byte_at(1, data)).when(kind == "Positive", b0 - 0x40).when(kind == "Request", b0).otherwise(none).alias("sid"),
        F.when((kind == "Request") & ~wide & (n >= 2), byte_at(1, data)).otherwise(none).alias("sub"), F.when(((kind == "Positive") & (n >= 3)) | ((kind == "Request") & wide), be16(1, data)).otherwise(none).alias("did"),
        F.when(kind == "Negative", byte_at(2, data)).otherwise(none).alias("nrc"),
    ]


def uds_names() -> list[Column]:
    """Names of the fields of uds_fields()."""
    sid, sub = F.col("sid"), F.col("sub")
    sub_other = F.when(sid == 0x10, hex_text("Session 0x", sub)).when(sid == 0x11, hex_text("Reset 0x", sub)).when(sid == 0x28, hex_text("CommCtrl 0x", sub)).otherwise(hex_text("Sub 0x", sub))
    return [
        name_of(T.UDS_SERVICES, sid, hex_text("Unknown SID 0x", sid)).alias("service"), name_of(T.UDS_NRCS, F.col("nrc"), hex_text("NRC 0x", F.col("nrc"))).alias("nrc_name"),
        name_of(T.UDS_DIDS, F.col("did"), hex_text("DID 0x", F.col("did"), 4)).alias("did_name"), name_of({a * 256 + b: n for (a, b), n in T.UDS_SUBS.items()}, sid * 256 + sub, sub_other).alias("sub_name"),
    ]


def canopen_fields() -> list[Column]:
    """Function code, node, message type and its command, code or state in words."""
    ident = F.col("can_id").bitwiseAND(0x7FF)
    kind = F.lit("Unknown")
    for low, high, name in reversed(T.CANOPEN_TYPES):
        kind = F.when(ident.between(low, high), name).otherwise(kind)
    kind = F.when(F.col("extended"), "Unknown").otherwise(kind)
    code = byte_at(0) + 256 * byte_at(1)
    said = F.when(kind == "NMT", name_of(T.NMT_COMMANDS, byte_at(0), hex_text("NMT 0x", byte_at(0)))).when(kind == "EMCY", name_of(T.EMCY_CODES, code, hex_text("EMCY 0x", code, 4)))
    said = said.when(kind.startswith("SDO"), name_of(T.SDO_COMMANDS, bits(byte_at(0), 5, 7), F.lit("SDO"))).when(kind == "Heartbeat", name_of(T.HEARTBEAT_STATES, byte_at(0), hex_text("State 0x", byte_at(0))))
    return [bits(F.col("can_id"), 7, 0x0F).alias("func"), F.col("can_id").bitwiseAND(0x7F).alias("node"), kind.alias("co_type"), F.coalesce(said, F.lit("")).alias("said")]


def lin_pid(ident: Column) -> Column:
    """The protected identifier of a 6-bit one."""
    i = ident.cast("long").bitwiseAND(0x3F)
    b = lambda k: bits(i, k, 1)
    p0 = b(0).bitwiseXOR(b(1)).bitwiseXOR(b(2)).bitwiseXOR(b(4))
    p1 = 1 - b(1).bitwiseXOR(b(3)).bitwiseXOR(b(4)).bitwiseXOR(b(5))
    return i + p0 * 64 + p1 * 128


def lin_checksum(data: Column, pid: Column | None = None) -> Column:
    """The inverted sum with carry, classic, or with the identifier (enhanced)."""
    total = F.aggregate(data, F.lit(0).cast("long") if pid is None else pid.cast("long"), lambda a, x: a + x.cast("long"))
    # Adding carries until one byte is left is the sum modulo 255, with 255 for a multiple that isn't 0.
    folded = F.when(total == 0, F.lit(0)).otherwise((total - 1) % 255 + 1)
    return 255 - folded


def lin_parse(data: str = "data") -> list[Column]:
    """A LIN frame in bytes, with or without the leading 0x55: identifier, data, and whether the enhanced or else the classic checksum holds."""
    off = F.when(byte_at(0, data) == 0x55, 1).otherwise(0)
    pid = F.coalesce(F.get(data, off), F.lit(0)).cast("long")
    ident = pid.bitwiseAND(0x3F)
    guess = F.when(ident <= 0x1F, 2).when(ident <= 0x2F, 4).otherwise(8)
    n = F.least(F.size(data) - off - 2, guess, F.lit(8)).cast("int")
    body = F.slice(data, off + 2, F.greatest(n, F.lit(0)))
    found = F.coalesce(F.get(data, off + 1 + n), F.lit(-1)).cast("long")
    valid = n >= 1
    kind = F.when(~valid, "Short").when(lin_checksum(body, pid) == found, "Enhanced").when(lin_checksum(body) == found, "Classic").otherwise("Invalid")
    return [pid.alias("lin_pid"), ident.alias("lin_id"), F.when(valid, n).otherwise(0).alias("lin_dlc"), kind.alias("lin_checksum"), name_of(T.LIN_NAMES, ident, hex_text("ID_0x", ident, 2, True)).alias("lin_name")]


def doip_fields(data: str = "data") -> list[Column]:
    """X11: header, type name, error, and the addresses and codes of the payload types that have them; null where the type has none."""
    n = F.size(data)
    kind, length = be16(2, data), be(4, 4, data)
    error = F.when(n < 8, F.concat(F.lit("Too short: "), n.cast("string"), F.lit(" bytes (min 8)"))).when(byte_at(0, data).bitwiseXOR(byte_at(1, data)) != 0xFF, "Invalid DoIP header pattern (byte0 XOR byte1 != 0xFF)")
    error = error.when(n < 8 + length, F.concat(F.lit("Truncated: expected "), (8 + length).cast("string"), F.lit(" bytes, got "), n.cast("string")))
    ok = error.isNull()
    on = lambda codes, least, value: F.when(ok & kind.isin(*codes) & (length >= least), value)
    text = F.array_join(F.transform(F.slice(data, 9, 17), lambda x: F.char(x.cast("long"))), "")
    code = F.coalesce(on([0x0006], 5, byte_at(12, data)), on([0x8002, 0x8003], 5, byte_at(12, data)))
    said = F.when(kind == 0x0006, name_of(T.DOIP_ROUTING, code, F.concat(hex_text("Reserved (0x", code, 2, True), F.lit(")")))).when(kind.isin(0x8002, 0x8003), name_of(T.DOIP_ACKS, code, hex_text("0x", code, 2, True)))
    return [
        ok.alias("valid"), F.coalesce(error, F.lit("")).alias("error"), kind.alias("payload_type"), name_of(T.DOIP_TYPES, kind, F.concat(hex_text("Unknown (0x", kind, 4, True), F.lit(")"))).alias("type_name"), length.alias("payload_length"),
        on([0x0004], 32, text).alias("vin"), F.coalesce(on([0x0005], 3, be16(8, data)), on([0x0006], 5, be16(8, data)), on([0x8001], 4, be16(8, data)), on([0x8002, 0x8003], 5, be16(8, data)), on([0x0004], 32, be16(25, data))).alias("source_addr"),
        F.coalesce(on([0x0006], 5, be16(10, data)), on([0x8001], 4, be16(10, data)), on([0x8002, 0x8003], 5, be16(10, data))).alias("target_addr"), F.when(code.isNotNull(), said).alias("code_name"),
    ]


def someip_fields(data: str = "data") -> list[Column]:
    """Header, names, errors, and the entries of a service discovery message (16 bytes each)."""
    n = F.size(data)
    length = be(4, 4, data)
    error = F.when(n < 16, F.concat(F.lit("Too short: "), n.cast("string"), F.lit(" bytes (min 16)"))).when(length < 8, F.concat(F.lit("Length field "), length.cast("string"), F.lit(" < 8 (invalid)")))
    error = error.when(n < 8 + length, F.concat(F.lit("Truncated: expected "), (8 + length).cast("string"), F.lit(" bytes, got "), n.cast("string")))
    ok, discovery = error.isNull(), (be16(0, data) == 0xFFFF) & (be16(2, data) == 0x8100)
    size = be(20, 4, data)
    # Payload starts at 16: 4 bytes of flags, 4 of the entries' length, then the entries.
    whole = ok & discovery & (length - 8 >= 12) & (8 + size <= length - 8)
    at = lambda o, k: F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0).cast("long"), lambda a, i: a * 256 + F.coalesce(F.get(data, (o + i).cast("int")), F.lit(0)).cast("long"))
    entry = lambda o: F.struct(at(o, 1).alias("type"), at(o + 4, 2).alias("service"), at(o + 6, 2).alias("instance"), at(o + 8, 1).alias("major"), at(o + 9, 3).alias("ttl"), at(o + 12, 4).alias("minor"))
    starts = F.when(whole & (size >= 16), F.transform(F.sequence(F.lit(0).cast("long"), F.expr(f"({_sql_be(20, 4, data)}) div 16") - 1), lambda k: 24 + 16 * k)).otherwise(F.array().cast("array<bigint>"))
    return [
        ok.alias("valid"), F.coalesce(error, F.lit("")).alias("error"), be16(0, data).alias("service_id"), be16(2, data).alias("method_id"), name_of(T.SOMEIP_TYPES, byte_at(14, data), F.concat(hex_text("UNKNOWN(0x", byte_at(14, data), 2, True), F.lit(")"))).alias("type_name"),
        name_of(T.SOMEIP_CODES, byte_at(15, data), hex_text("0x", byte_at(15, data), 2, True)).alias("code_name"), (ok & discovery).alias("discovery"), F.transform(starts, entry).alias("entries"),
    ]


def _sql_be(i: int, n: int, data: str) -> str:
    out = "0L"
    for k in range(n):
        out = f"({out} * 256 + cast(coalesce(get({data}, {i + k}), 0) as bigint))"
    return out


def xcp_fields(data: str = "data") -> list[Column]:
    """Direction, command name and error text of a packet."""
    pid = byte_at(0, data)
    direction = F.when(F.size(data) < 1, "Unknown").when(pid >= 0xFE, "Response").when(pid == 0xFD, "Event").when(pid == 0xFC, "Service").otherwise("Command")
    error = F.when(pid == 0xFE, name_of(T.XCP_ERRORS, byte_at(1, data), F.concat(hex_text("Unknown error (0x", byte_at(1, data), 2, True), F.lit(")"))))
    return [pid.alias("xcp_pid"), direction.alias("direction"), name_of(T.XCP_COMMANDS, pid, hex_text("CMD_0x", pid, 2, True)).alias("command"), F.coalesce(error, F.lit("")).alias("xcp_error")]


def kwp_fields(data: str = "data") -> list[Column]:
    """Type, service, response code and XOR checksum of a message; the checksum holds if the XOR over all bytes is 0."""
    b0, n = byte_at(0, data), F.size(data)
    kind = F.when(n < 1, "Unknown").when(b0 == 0x7F, "Negative").when(b0.bitwiseAND(0x40) != 0, "Positive").otherwise("Request")
    sid = F.when(kind == "Negative", byte_at(1, data)).when(kind == "Positive", b0 - 0x40).otherwise(b0)
    nrc = F.when(kind == "Negative", byte_at(2, data)).otherwise(0)
    lrc = F.aggregate(data, F.lit(0), lambda a, x: a.bitwiseXOR(x.cast("int")))
    return [kind.alias("kwp_type"), sid.alias("kwp_sid"), name_of(T.KWP_SERVICES, sid, F.concat(hex_text("Unknown(0x", sid, 2, True), F.lit(")"))).alias("kwp_service"), F.when(kind == "Negative", name_of(T.KWP_NRCS, nrc, F.concat(hex_text("Unknown NRC (0x", nrc, 2, True), F.lit(")")))).otherwise("").alias("kwp_nrc"), lrc.cast("long").alias("lrc"), (lrc == 0).alias("checksum_ok")]


def cluster_fields(speed_id: int = 0x244, door_id: int = 0x19B, signal_id: int = 0x188) -> list[Column]:
    """Speed, door mask and turn signals of an instrument cluster's frames; null for other frames."""
    c, n = F.col("can_id"), F.size("data")
    kph = F.when((c == speed_id) & (n >= 5), be16(3) / 100)
    return [kph.alias("speed_kph"), (kph * 0.6213751).alias("speed_mph"), F.when((c == door_id) & (n >= 3), byte_at(2).bitwiseAND(0x0F)).alias("door_mask"), F.when((c == signal_id) & (n >= 1), byte_at(0).bitwiseAND(1) != 0).alias("left"), F.when((c == signal_id) & (n >= 1), byte_at(0).bitwiseAND(2) != 0).alias("right")]


def cluster_speed_data(mph: Column) -> Column:
    """The payload of a speed frame."""
    raw = F.floor(F.greatest(F.lit(0.0), mph) / 0.6213751 * 100).cast("long")
    return F.array(F.lit(0), F.lit(0), F.lit(0), bits(raw, 8, 0xFF), raw.bitwiseAND(0xFF)).cast("array<short>")
