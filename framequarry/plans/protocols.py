"""Protocol decoders over payloads made from the adapted frames, with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.functions import protocol_tables as T
from framequarry.functions import protocols as P
from framequarry.plans.profile import r
from framequarry.schema import sql


def case(table: dict[int, str], code: str, other: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {k} THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in table.items()) + f" ELSE {other} END"


def low(code: str, width: int = 2) -> str:
    return f"lpad(lower(to_hex({code})), {width}, '0')"


def up(code: str, width: int = 2) -> str:
    return f"lpad(upper(to_hex({code})), {width}, '0')"


def with_data(f: DataFrame, *parts: str) -> DataFrame:
    """Frames of 8 bytes with a payload made of SQL expressions over b0 to b6."""
    b = f.filter("size(data) = 8").select("*", *(F.get("data", F.lit(i)).cast("long").alias(f"b{i}") for i in range(8)))
    return b.withColumn("data", F.array(*(F.expr(p).cast("short") for p in parts)))


#: 29-bit identifiers whose group numbers often are in the table.
PGN_LIST = [p[0] for p in T.PGNS]


def j1939(f: DataFrame) -> DataFrame:
    b = f.filter("size(data) = 8").select("*", *(F.get("data", F.lit(i)).cast("long").alias(f"b{i}") for i in range(8)))
    pgn = F.element_at(F.array(*map(F.lit, PGN_LIST)), (F.col("frame_id") % len(PGN_LIST) + 1).cast("int")).cast("long")
    return b.withColumn("can_id", (F.col("b0") % 8) * 67108864 + pgn * 256 + F.col("b6")).withColumn("extended", F.lit(True))


J = f"jf AS (SELECT *, ([{', '.join(map(str, PGN_LIST))}])[frame_id % {len(PGN_LIST)} + 1] AS g FROM fr WHERE dlc = 8), jx AS (SELECT *, (b0 % 8) * 67108864 + g * 256 + b6 AS xid FROM jf), jp AS (SELECT *, (xid >> 16) & 255 AS pf, (xid >> 8) & 255 AS ps FROM jx)"
r("f09_predicates", lambda f: f.withColumn("can_id", F.col("can_id") + F.col("frame_id") % 7 * 256).withColumn("extended", F.col("frame_id") % 2 == 0).select("frame_id", P.is_obd().alias("obd"), P.looks_like_uds().alias("uds"), P.is_j1939().alias("j1939"), P.is_canopen().alias("canopen")), sql("x AS (SELECT frame_id, can_id + frame_id % 7 * 256 AS c, frame_id % 2 = 0 AS e FROM fr) SELECT frame_id, c = 2015 OR c BETWEEN 2016 AND 2031 AS obd, NOT e AND c BETWEEN 1792 AND 2047 AS uds, e AS j1939, NOT e AND (c & 2047 = 0 OR c & 2047 BETWEEN 128 AND 1919) AS canopen FROM x"))
r("x05_j1939_split", lambda f: j1939(f).select("frame_id", *P.j1939_fields(), F.col("can_id")), sql(f"{J} SELECT frame_id, b0 % 8 AS priority, (xid >> 24) & 1 AS data_page, pf AS pdu_format, ps AS pdu_specific, b6 AS source, pf < 240 AS pdu1, CASE WHEN pf < 240 THEN ps ELSE 255 END AS destination, CASE WHEN pf < 240 THEN (xid >> 24 & 1) * 65536 + pf * 256 ELSE (xid >> 24 & 1) * 65536 + pf * 256 + ps END AS pgn, xid AS can_id FROM jp"))
r("x05_j1939_compat", lambda f: j1939(f).select("frame_id", P.j1939_fields("compat")[-1]), sql(f"{J} SELECT frame_id, CASE WHEN pf < 240 THEN (xid >> 24 & 1) * 65536 + pf * 256 + ps ELSE (xid >> 24 & 1) * 65536 + pf * 256 END AS pgn FROM jp"))
r("x05_j1939_rebuild", lambda f: j1939(f).select("frame_id", "can_id", *P.j1939_fields()).select("frame_id", (P.j1939_id(F.col("priority"), F.col("pgn"), F.col("pdu_format"), F.col("pdu_specific"), F.col("source")) == F.col("can_id")).alias("same")), sql("SELECT frame_id, true AS same FROM fr WHERE dlc = 8"))
SPN = ", ".join(f"({p[0]}, {i}, {s[0]}, {s[2]}, {s[3]}, {s[4]}, {float(s[5])!r}::DOUBLE, {float(s[6])!r}::DOUBLE)" for p in T.PGNS for i, s in enumerate(p[3]))
r("x06_j1939_spns", lambda f: P.decode_spns(j1939(f)).select("frame_id", "pgn", F.col("ord").cast("long").alias("ord"), F.col("spn").cast("long").alias("spn"), "value"), sql(f"{J}, sp(pgn, ord, spn, byte_off, bit_off, bits, res, off) AS (VALUES {SPN}), w AS (SELECT frame_id, sp.*, (data[byte_off + 1] + 256 * coalesce(data[byte_off + 2], 0) + 65536 * coalesce(data[byte_off + 3], 0) + 16777216 * coalesce(data[byte_off + 4], 0)) AS w FROM jp JOIN sp ON sp.pgn = jp.g) SELECT frame_id, pgn::BIGINT AS pgn, ord::BIGINT AS ord, spn::BIGINT AS spn, round(((w >> bit_off) & ((1::BIGINT << bits) - 1)) * res + off, 6) AS value FROM w"))
r("j02_pgn_names", lambda f: j1939(f).select("frame_id", "can_id", *P.j1939_fields()).select("frame_id", P.pgn_name().alias("pgn_name"), P.source_name(F.col("source")).alias("source_name")), sql(f"{J}, q AS (SELECT *, CASE WHEN pf < 240 THEN (xid >> 24 & 1) * 65536 + pf * 256 ELSE (xid >> 24 & 1) * 65536 + pf * 256 + ps END AS pgn FROM jp) SELECT frame_id, {case({p[0]: p[1] for p in T.PGNS}, 'pgn', 'chr(80)||chr(71)||chr(78)||chr(32)||' + chr(39) + '0x' + chr(39) + '||' + up('pgn', 5))} AS pgn_name, {case(T.SOURCES, 'b6', chr(39) + 'SA 0x' + chr(39) + ' || ' + low('b6'))} AS source_name FROM q"))


def obd(f: DataFrame) -> DataFrame:
    return with_data(f, "3 + b0 % 5", "if(b0 % 2 = 0, 65, 1) + if(b3 % 4 = 0, b0 % 10, 0)", "b1 % 96", "b2", "b3", "b4", "b5", "b6").withColumn("can_id", F.lit(2016) + F.col("b0"))


OBD = "ob AS (SELECT frame_id, 2016 + b0 AS cid, (3 + b0 % 5) & 15 AS len, CASE WHEN b0 % 2 = 0 THEN 65 ELSE 1 END + CASE WHEN b3 % 4 = 0 THEN b0 % 10 ELSE 0 END AS m1, b1 % 96 AS p, b2, b3, b4, b5, b6 FROM fr WHERE dlc = 8), oc AS (SELECT *, CASE WHEN m1 BETWEEN 65 AND 74 THEN 'Response' WHEN m1 BETWEEN 1 AND 10 THEN 'Request' ELSE 'Unknown' END AS type, CASE WHEN m1 BETWEEN 65 AND 74 THEN m1 - 64 WHEN m1 BETWEEN 1 AND 10 THEN m1 ELSE 0 END AS mode FROM ob), od AS (SELECT *, CASE WHEN mode = 1 AND p = 0 THEN p * 256 + b2 ELSE p END AS pid FROM oc)"
PIDS = ", ".join(f"({m}, {p}, '{n}', '{u}', {float(s)!r}::DOUBLE, {float(o)!r}::DOUBLE, {k})" for m, p, n, u, s, o, k in T.OBD_PIDS)
r("x07_obd_fields", lambda f: obd(f).select("frame_id", *P.obd_fields()), sql(f"{OBD} SELECT frame_id, len, type, mode, pid FROM od"))
r("j03_obd_lookup", lambda f: P.decode_obd(obd(f)).select("frame_id", "mode_name", "pid_name", "unit", "value"), sql(f"{OBD}, pt(mode, pid, pid_name, unit, scale, off, k) AS (VALUES {PIDS}) SELECT frame_id, {case(T.OBD_MODES, 'od.mode', chr(39) + 'Mode 0x' + chr(39) + ' || ' + low('od.mode'))} AS mode_name, coalesce(pid_name, 'PID 0x' || {low('od.pid', 4)}) AS pid_name, coalesce(unit, '') AS unit, round(CASE WHEN k IS NULL THEN 0 WHEN k >= 2 THEN (b2 * 256 + b3) * scale + off ELSE b2 * scale + off END, 6) AS value FROM od LEFT JOIN pt ON pt.mode = od.mode AND pt.pid = od.pid"))


def dtc_frames(f: DataFrame) -> DataFrame:
    return with_data(f, "5 + b0 % 3", "67", "b1", "b2", "if(b3 < 10, 0, b4)", "if(b3 < 10, 0, b6)", "b5", "b0").withColumn("can_id", F.lit(2024).cast("long"))


DTC = lambda a, b: f"substr('PCBU', (({a}) >> 6) + 1, 1) || ((({a}) >> 4) & 3)::VARCHAR || lpad(upper(to_hex(((({a}) & 15) << 8) | ({b}))), 3, '0')"
r("x07_trouble_codes", lambda f: dtc_frames(f).select("frame_id", "data", "can_id", *P.obd_fields()).select("frame_id", F.array_join(P.dtcs(), ",").alias("codes")), sql(f"d AS (SELECT frame_id, (4 + b0 % 3) // 2 AS n, [b1, b2, CASE WHEN b3 < 10 THEN 0 ELSE b4 END, CASE WHEN b3 < 10 THEN 0 ELSE b6 END, b5, b0] AS v FROM fr WHERE dlc = 8) SELECT frame_id, array_to_string([{DTC('v[2 * i + 1]', 'v[2 * i + 2]')} FOR i IN range(0, least(n, 3)) IF v[2 * i + 1] <> 0 OR v[2 * i + 2] <> 0], ',') AS codes FROM d"))
r("x08_uds_fields", lambda f: with_data(f, "if(b0 % 4 = 0, 127, b1 % 128)", "b2 + 16", "b3", "b4", "0", "0", "0", "0").select("frame_id", *P.uds_fields()), sql("""u AS (SELECT frame_id, CASE WHEN b0 % 4 = 0 THEN 127 ELSE b1 % 128 END AS c, b2 + 16 AS d, b3 AS e FROM fr WHERE dlc = 8), t AS (SELECT *, CASE WHEN c BETWEEN 48 AND 50 THEN 'FlowControl' WHEN c = 127 THEN 'Negative' WHEN c BETWEEN 64 AND 126 THEN 'Positive' WHEN c BETWEEN 16 AND 62 THEN 'Request' ELSE 'Unknown' END AS k FROM u)
SELECT frame_id, k AS uds_type, CASE k WHEN 'Negative' THEN d WHEN 'Positive' THEN c - 64 WHEN 'Request' THEN c ELSE 0 END AS sid, CASE WHEN k = 'Request' AND c NOT IN (34, 46, 42, 47) THEN d ELSE 0 END AS sub, CASE WHEN k = 'Positive' OR (k = 'Request' AND c IN (34, 46, 42, 47)) THEN d * 256 + e ELSE 0 END AS did, CASE WHEN k = 'Negative' THEN e ELSE 0 END AS nrc FROM t"""))
r("j04_uds_names", lambda f: f.select("frame_id", (F.get("data", F.lit(1)) % 64).cast("long").alias("sid"), (F.col("frame_id") % 6).alias("sub"), (F.lit(0xF180) + F.get("data", F.lit(3))).cast("long").alias("did"), (F.get("data", F.lit(3)) + 10).cast("long").alias("nrc")).select("frame_id", *P.uds_names()), sql(f"n AS (SELECT frame_id, b1 % 64 AS sid, frame_id % 6 AS sub, 61824 + b3 AS did, b3 + 10 AS nrc FROM fr) SELECT frame_id, {case(T.UDS_SERVICES, 'sid', chr(39) + 'Unknown SID 0x' + chr(39) + ' || ' + low('sid'))} AS service, {case(T.UDS_NRCS, 'nrc', chr(39) + 'NRC 0x' + chr(39) + ' || ' + low('nrc'))} AS nrc_name, {case(T.UDS_DIDS, 'did', chr(39) + 'DID 0x' + chr(39) + ' || ' + low('did', 4))} AS did_name, {case({a * 256 + b: n for (a, b), n in T.UDS_SUBS.items()}, 'sid * 256 + sub', 'CASE sid WHEN 16 THEN ' + chr(39) + 'Session 0x' + chr(39) + ' WHEN 17 THEN ' + chr(39) + 'Reset 0x' + chr(39) + ' WHEN 40 THEN ' + chr(39) + 'CommCtrl 0x' + chr(39) + ' ELSE ' + chr(39) + 'Sub 0x' + chr(39) + ' END || ' + low('sub'))} AS sub_name FROM n"))
COT = "CASE " + " ".join(f"WHEN c BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in T.CANOPEN_TYPES) + " ELSE 'Unknown' END"
r("x09_canopen", lambda f: f.withColumn("can_id", F.get("data", F.lit(1)).cast("long") * 8 + F.col("frame_id") % 3).select("frame_id", *P.canopen_fields()), sql(f"k AS (SELECT *, b1 * 8 + frame_id % 3 AS c FROM fr), t AS (SELECT *, {COT} AS k FROM k) SELECT frame_id, (c >> 7) & 15 AS func, c & 127 AS node, k AS co_type, CASE WHEN k = 'NMT' THEN {case(T.NMT_COMMANDS, 'b0', chr(39) + 'NMT 0x' + chr(39) + ' || ' + low('b0'))} WHEN k = 'EMCY' THEN {case(T.EMCY_CODES, 'b0 + 256 * b1', chr(39) + 'EMCY 0x' + chr(39) + ' || ' + low('b0 + 256 * b1', 4))} WHEN k LIKE 'SDO%' THEN {case(T.SDO_COMMANDS, '(b0 >> 5)', chr(39) + 'SDO' + chr(39))} WHEN k = 'Heartbeat' THEN {case(T.HEARTBEAT_STATES, 'b0', chr(39) + 'State 0x' + chr(39) + ' || ' + low('b0'))} ELSE '' END AS said FROM t"))
r("x10_lin", lambda f: with_data(f, "85", "b1", "b2", "b3", "if(frame_id % 2 = 0, (255 - ((b2 + b3 - 1) % 255 + 1)) % 256, b4)", "0", "0", "0").filter("b2 + b3 > 0").select("frame_id", P.lin_pid(F.col("b1")).alias("pid"), *P.lin_parse()[:3]), sql("l AS (SELECT *, b1 & 63 AS i FROM fr WHERE dlc = 8 AND b2 + b3 > 0) SELECT frame_id, i + 64 * (xor(xor(i & 1, (i >> 1) & 1), xor((i >> 2) & 1, (i >> 4) & 1))) + 128 * (1 - xor(xor((i >> 1) & 1, (i >> 3) & 1), xor((i >> 4) & 1, (i >> 5) & 1))) AS pid, b1 AS lin_pid, i AS lin_id, CASE WHEN i <= 31 THEN 2 WHEN i <= 47 THEN 4 ELSE 5 END::INT AS lin_dlc FROM l"))
r("x10_lin_checksum", lambda f: f.select("frame_id", P.lin_checksum(F.col("data")).alias("classic"), P.lin_checksum(F.col("data"), F.col("can_id") % 256).alias("enhanced")), sql("s AS (SELECT frame_id, list_sum(data) AS c, list_sum(data) + can_id % 256 AS e FROM fr) SELECT frame_id, (255 - CASE WHEN c = 0 THEN 0 ELSE (c - 1) % 255 + 1 END)::BIGINT AS classic, (255 - CASE WHEN e = 0 THEN 0 ELSE (e - 1) % 255 + 1 END)::BIGINT AS enhanced FROM s"))
DOIP = ("2", "253", "if(b0 % 3 = 0, 128, 0)", "if(b0 % 3 = 0, 1 + b0 % 2, 5 + b0 % 2)", "0", "0", "0", "5", "b1", "b2", "b3", "b4", "b5")
r("x11_doip", lambda f: with_data(f, *DOIP).select("frame_id", *P.doip_fields()), sql(f"""d AS (SELECT *, CASE WHEN b0 % 3 = 0 THEN 32769 + b0 % 2 ELSE 5 + b0 % 2 END AS k FROM fr WHERE dlc = 8) SELECT frame_id, true AS valid, '' AS error, k AS payload_type, {case(T.DOIP_TYPES, 'k', "''")} AS type_name, 5::BIGINT AS payload_length, NULL::VARCHAR AS vin, b1 * 256 + b2 AS source_addr, CASE WHEN k <> 5 THEN b3 * 256 + b4 END AS target_addr,
CASE WHEN k = 6 THEN {case(T.DOIP_ROUTING, 'b5', "'Reserved (0x' || " + up('b5') + " || ')'")} WHEN k = 32770 THEN {case(T.DOIP_ACKS, 'b5', "'0x' || " + up('b5'))} END AS code_name FROM d"""))
r("x12_someip", lambda f: with_data(f, "b1", "b2", "b3", "b4", "0", "0", "0", "8 + b0 % 2", "0", "1", "0", "2", "1", "1", "b6 % 4", "b5").select("frame_id", *(c for c in P.someip_fields()[:6])), sql(f"SELECT frame_id, b0 % 2 = 0 AS valid, CASE WHEN b0 % 2 = 0 THEN '' ELSE 'Truncated: expected 17 bytes, got 16' END AS error, b1 * 256 + b2 AS service_id, b3 * 256 + b4 AS method_id, {case(T.SOMEIP_TYPES, '(b6 % 4)', chr(39) + 'UNKNOWN(0x' + chr(39) + ' || ' + up('(b6 % 4)') + ' || ' + chr(39) + ')' + chr(39))} AS type_name, {case(T.SOMEIP_CODES, 'b5', chr(39) + '0x' + chr(39) + ' || ' + up('b5'))} AS code_name FROM fr WHERE dlc = 8"))
r("x13_xcp", lambda f: with_data(f, "255 - b1 % 64", "b3", "0", "0", "0", "0", "0", "0").select("frame_id", *P.xcp_fields()), sql(f"x AS (SELECT frame_id, 255 - b1 % 64 AS p, b3 AS e FROM fr WHERE dlc = 8) SELECT frame_id, p AS xcp_pid, CASE WHEN p >= 254 THEN 'Response' WHEN p = 253 THEN 'Event' WHEN p = 252 THEN 'Service' ELSE 'Command' END AS direction, {case(T.XCP_COMMANDS, 'p', chr(39) + 'CMD_0x' + chr(39) + ' || ' + up('p'))} AS command, CASE WHEN p = 254 THEN {case(T.XCP_ERRORS, 'e', chr(39) + 'Unknown error (0x' + chr(39) + ' || ' + up('e') + ' || ' + chr(39) + ')' + chr(39))} ELSE '' END AS xcp_error FROM x"))
r("x14_kwp", lambda f: with_data(f, "if(b0 % 4 = 0, 127, b1 % 128)", "b3", "b2 + 16").select("frame_id", *P.kwp_fields()), sql(f"k AS (SELECT frame_id, CASE WHEN b0 % 4 = 0 THEN 127 ELSE b1 % 128 END AS a, b3 AS b, b2 + 16 AS c FROM fr WHERE dlc = 8), t AS (SELECT *, CASE WHEN a = 127 THEN 'Negative' WHEN a & 64 <> 0 THEN 'Positive' ELSE 'Request' END AS k, CASE WHEN a = 127 THEN b WHEN a & 64 <> 0 THEN a - 64 ELSE a END AS s FROM k) SELECT frame_id, k AS kwp_type, s AS kwp_sid, {case(T.KWP_SERVICES, 's', chr(39) + 'Unknown(0x' + chr(39) + ' || ' + up('s') + ' || ' + chr(39) + ')' + chr(39))} AS kwp_service, CASE WHEN k = 'Negative' THEN {case(T.KWP_NRCS, 'c', chr(39) + 'Unknown NRC (0x' + chr(39) + ' || ' + up('c') + ' || ' + chr(39) + ')' + chr(39))} ELSE '' END AS kwp_nrc, xor(xor(a, b), c) AS lrc, xor(xor(a, b), c) = 0 AS checksum_ok FROM t"))
r("x15_cluster", lambda f: f.withColumn("can_id", F.element_at(F.array(F.lit(0x244), F.lit(0x19B), F.lit(0x188)), (F.col("frame_id") % 3 + 1).cast("int")).cast("long")).select("frame_id", *P.cluster_fields()), sql("SELECT frame_id, round(CASE WHEN frame_id % 3 = 0 AND dlc >= 5 THEN (b3 * 256 + b4) / 100 END, 6) AS speed_kph, round(CASE WHEN frame_id % 3 = 0 AND dlc >= 5 THEN (b3 * 256 + b4) / 100 * 0.6213751::DOUBLE END, 6) AS speed_mph, CASE WHEN frame_id % 3 = 1 THEN b2 & 15 END AS door_mask, CASE WHEN frame_id % 3 = 2 THEN b0 & 1 <> 0 END AS \"left\", CASE WHEN frame_id % 3 = 2 THEN b0 & 2 <> 0 END AS \"right\" FROM fr"))
