"""Signals, checksums and dictionaries, with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from framequarry.functions import signals as X
from framequarry.operators import decode as D
from framequarry.plans.profile import HOUR, r
from framequarry.schema import byte_at, sql
from framequarry.sources.dictionary import dictionary, parse_arxml, parse_dbc

DBC = """
VERSION ""
BO_ 256 Engine: 8 Vector__XXX
 SG_ Speed : 8|16@1+ (0.25,0) [0|16383] "rpm" Vector__XXX
 SG_ Nibble : 4|8@1+ (1,-3) [0|0] "" Vector__XXX
 SG_ Temp : 8|8@1- (1,-40) [-168|87] "C" Vector__XXX
BO_ 0x101 Brake: 8 Vector__XXX
 SG_ Press : 15|16@0+ (0.1,0) [0|6553] "bar" Vector__XXX
 SG_ Odd : 12|6@0- (2,1) [0|0] "" Vector__XXX
BO_ 258 Empty: 4 Vector__XXX
"""
ARXML = """<AUTOSAR><I-SIGNAL><SHORT-NAME>Torque</SHORT-NAME><LENGTH>12</LENGTH><BIT-LENGTH>12</BIT-LENGTH></I-SIGNAL>
<I-SIGNAL-I-PDU><SHORT-NAME>P1</SHORT-NAME><LENGTH>8</LENGTH><I-SIGNAL-TO-PDU-MAPPINGS><I-SIGNAL-TO-I-PDU-MAPPING><SHORT-NAME>m</SHORT-NAME><I-SIGNAL-REF>/a/Torque</I-SIGNAL-REF><START-POSITION>4</START-POSITION><PACKING-BYTE-ORDER>MOST-SIGNIFICANT-BYTE-LAST</PACKING-BYTE-ORDER></I-SIGNAL-TO-I-PDU-MAPPING></I-SIGNAL-TO-PDU-MAPPINGS></I-SIGNAL-I-PDU>
<FRAME><SHORT-NAME>F1</SHORT-NAME><FRAME-LENGTH>8</FRAME-LENGTH><PDU-REF>/p/P1</PDU-REF></FRAME>
<CAN-FRAME-TRIGGERING><SHORT-NAME>T1</SHORT-NAME><FRAME-REF>/f/F1</FRAME-REF><IDENTIFIER>0x103</IDENTIFIER></CAN-FRAME-TRIGGERING></AUTOSAR>"""
VALUES = """s0 AS (SELECT frame_id, ts_us, 'Speed' AS sig_name, (b1 + 256 * b2) * 0.25 AS value FROM fr WHERE can_id = 256
 UNION ALL SELECT frame_id, ts_us, 'Nibble', ((b0 >> 4) | ((b1 & 15) << 4)) - 3.0 FROM fr WHERE can_id = 256
 UNION ALL SELECT frame_id, ts_us, 'Temp', (CASE WHEN b1 > 127 THEN b1 - 256 ELSE b1 END) - 40.0 FROM fr WHERE can_id = 256
 UNION ALL SELECT frame_id, ts_us, 'Press', (b1 * 256 + b2) * 0.1 FROM fr WHERE can_id = 257
 UNION ALL SELECT frame_id, ts_us, 'Odd', (CASE WHEN v > 31 THEN v - 64 ELSE v END) * 2.0 + 1 FROM (SELECT *, ((b1 & 31) << 1) | (b2 >> 7) AS v FROM fr WHERE can_id = 257)),
sg AS (SELECT frame_id, ts_us, sig_name, value::DOUBLE AS value FROM s0)"""


def decoded(f, compat: str = "mapper"):
    return D.decode(f, dictionary(f.sparkSession, parse_dbc(DBC)), compat)


r("j01_decode", lambda f: decoded(f).select("frame_id", "sig_name", "value"), sql(f"{VALUES} SELECT frame_id, sig_name, round(value, 6) AS value FROM sg"))
r("s06_dictionary", lambda f: dictionary(f.sparkSession, parse_dbc(DBC)).select("msg_id", "sig_name", "start_bit", "length"), "SELECT * FROM (VALUES (256::BIGINT, 'Speed', 8, 16), (256, 'Nibble', 4, 8), (256, 'Temp', 8, 8), (257, 'Press', 15, 16), (257, 'Odd', 12, 6)) t(msg_id, sig_name, start_bit, length)")
r("s07_arxml_decode", lambda f: D.decode(f, dictionary(f.sparkSession, parse_arxml(ARXML))).select("frame_id", "sig_name", "value"), sql("SELECT frame_id, 'Torque' AS sig_name, ((b0 >> 4) | (b1 << 4))::DOUBLE AS value FROM fr WHERE can_id = 259"))
r("j19_arxml_chain", lambda f: dictionary(f.sparkSession, parse_arxml(ARXML)).select("msg_id", "msg_name", "sig_name", "length", "little_endian"), "SELECT 259::BIGINT AS msg_id, 'F1' AS msg_name, 'Torque' AS sig_name, 12 AS length, true AS little_endian")
r("a06_signal_stats", lambda f: D.signal_stats(decoded(f)), sql(f"""{VALUES}, st AS (SELECT sig_name, count(*) AS n, min(value) AS lo, max(value) AS hi, avg(value) AS m, stddev_samp(value) AS sd FROM sg GROUP BY ALL), ce AS (SELECT sig_name, CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / (hi - lo) * 10), 9) END AS cell FROM sg JOIN st USING (sig_name)), hh AS (SELECT sig_name, {', '.join(f'count(*) FILTER (cell = {i}) AS h{i}' for i in range(10))} FROM ce GROUP BY ALL)
SELECT sig_name, n, round(lo, 6) AS min_value, round(hi, 6) AS max_value, round(m, 6) AS mean_value, round(sd, 6) AS sd, {', '.join(f'h{i}' for i in range(10))} FROM st JOIN hh USING (sig_name)"""))
LAST = "la AS (SELECT sig_name, arg_max(value, frame_id) AS last_value, max(ts_us) AS last_us, min(value) AS min_value, max(value) AS max_value FROM sg GROUP BY ALL)"
r("a20_gauges", lambda f: D.latest(decoded(f)).drop("last_us"), sql(f"{VALUES}, {LAST} SELECT sig_name, round(last_value, 6) AS last_value, round(min_value, 6) AS min_value, round(max_value, 6) AS max_value FROM la"))
r("t12_latest", lambda f: D.latest(decoded(f)).select("sig_name", "last_value", "last_us"), sql(f"{VALUES}, {LAST} SELECT sig_name, round(last_value, 6) AS last_value, last_us FROM la"))
r("t12_alarms", lambda f: D.alarms(decoded(f), f.sparkSession.createDataFrame([("Speed", None, 100.0), ("Temp", -300.0, 300.0), ("Odd", 60.0, None)], "sig_name string, low double, high double")).select("sig_name", "alarm"), sql(f"{VALUES}, {LAST} SELECT sig_name, CASE sig_name WHEN 'Speed' THEN last_value > 100 WHEN 'Temp' THEN last_value < -300 OR last_value > 300 ELSE last_value < 60 END AS alarm FROM la WHERE sig_name IN ('Speed', 'Temp', 'Odd')"))
r("w14_signal_trend", lambda f: D.trend(decoded(f), 24 * HOUR).groupBy("sig_name").agg(F.count(F.lit(1)).alias("points"), F.min("value").alias("min_value"), F.max("value").alias("max_value")), sql(f"{VALUES}, l2 AS (SELECT *, max(ts_us) OVER (PARTITION BY sig_name) AS l FROM sg) SELECT sig_name, count(*) AS points, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value FROM l2 WHERE ts_us >= l - {24 * HOUR} GROUP BY sig_name"))
r("x01_byte_at", lambda f: f.select("frame_id", byte_at(5).alias("b5"), byte_at(63).alias("b63")), sql("SELECT frame_id, CASE WHEN dlc > 5 THEN b5 ELSE 0 END AS b5, 0::BIGINT AS b63 FROM fr"))
r("x02_little_endian", lambda f: f.select("frame_id", X.raw_little("data", "12", "20").alias("raw"), X.signed(X.raw_little("data", "8", "8"), F.lit(8)).alias("s8")), sql("SELECT frame_id, ((b1 >> 4) | (b2 << 4) | (b3 << 12)) AS raw, CASE WHEN b1 > 127 THEN b1 - 256 ELSE b1 END AS s8 FROM fr"))
r("x03_motorola", lambda f: f.select("frame_id", X.raw_motorola("data", "15", "16").alias("be16"), X.raw_motorola("data", "3", "12").alias("be12"), X.raw_descending("data", "13", "4").alias("compat")), sql("SELECT frame_id, b1 * 256 + b2 AS be16, (b0 & 15) * 256 + b1 AS be12, (b1 >> 2) & 15 AS compat FROM fr"))
r("x04_encode", lambda f: f.select("frame_id", F.array_join(X.insert_little(F.col("data"), F.lit(10), F.lit(9), F.lit(0x155).cast("long")).cast("array<string>"), ",").alias("data")), sql("SELECT frame_id, array_to_string(list_slice([b0, (b1 & 3) | ((341 << 2) & 252), (b2 & 248) | (341 >> 6), b3, b4, b5, b6, b7], 1, dlc), ',') AS data FROM fr"))
r("x04_to_raw", lambda f: f.select("frame_id", F.lit(8).alias("length"), F.lit(True).alias("is_signed"), F.lit(0.5).alias("scale"), F.lit(-3.0).alias("offset"), F.get("data", F.lit(1)).cast("double").alias("v")).select("frame_id", X.to_raw(F.col("v")).alias("raw")), sql("SELECT frame_id, least(127, greatest(-128, round((b1 + 3.0) / 0.5)))::BIGINT AS raw FROM fr"))
r("x16_checksums", lambda f: f.select("frame_id", X.checksum("xor", 0, 3).alias("x"), X.checksum("sum8", 0, 3).alias("s"), X.checksum("sum8", 0, 7).alias("s8"), X.checksum_ok("xor", 4, 0, 3).alias("ok")), sql("SELECT frame_id, xor(xor(b0, b1), xor(b2, b3))::INT AS x, ((b0 + b1 + b2 + b3) % 256)::INT AS s, CASE WHEN dlc = 8 THEN (b0 + b1 + b2 + b3 + b4 + b5 + b6 + b7) % 256 ELSE 0 END::INT AS s8, dlc = 8 AS ok FROM fr"))


def crc_sql(name: str, poly: int) -> str:
    """CTEs that end in one of all 256 steps of a CRC, eight shifts of each byte, as a list."""
    step = lambda x: f"CASE WHEN {x} & 128 <> 0 THEN xor(({x} << 1) & 255, {poly}) ELSE ({x} << 1) & 255 END"
    parts = [f"{name}0 AS (SELECT unnest(range(0, 256)) AS i, unnest(range(0, 256)) AS x)", *(f"{name}{k} AS (SELECT i, {step('x')} AS x FROM {name}{k - 1})" for k in range(1, 9))]
    return ", ".join([*parts, f"{name} AS (SELECT list(x ORDER BY i) AS t FROM {name}8)"])


def crc_of(table: str, first: int) -> str:
    out = str(first)
    for i in range(4):
        out = f"{table}.t[xor({out}, b{i}) + 1]"
    return out


r("x16_crc8", lambda f: f.select("frame_id", X.checksum("crc8_j1850", 0, 3).alias("j1850"), X.checksum("crc8_autosar", 0, 3).alias("autosar")), sql(f"{crc_sql('sj', 0x1D)}, {crc_sql('au', 0x2F)} SELECT frame_id, ({crc_of('sj', 0xFF)})::INT AS j1850, xor({crc_of('au', 0xFF)}, 255)::INT AS autosar FROM fr, sj, au"))
r("x02_wide_fields", lambda f: f.select("frame_id", X.raw_little("data", "0", "64").alias("le64"), X.raw_motorola("data", "7", "64").alias("be64"), X.raw_little("data", "3", "55").alias("le55"), X.raw_motorola("data", "4", "57").alias("be57")), sql(f"w AS (SELECT frame_id, {', '.join(f'CASE WHEN dlc > {i} THEN b{i} ELSE 0 END::HUGEINT AS c{i}' for i in range(8))} FROM fr), v AS (SELECT frame_id, {' + '.join(f'c{i} * {1 << 8 * i}::HUGEINT' for i in range(8))} AS le, {' + '.join(f'c{i} * {1 << 56 - 8 * i}::HUGEINT' for i in range(8))} AS be FROM w) SELECT frame_id, le::BIGINT AS le64, be::BIGINT AS be64, ((le // 8) % {1 << 55}::HUGEINT)::BIGINT AS le55, ((be % {1 << 61}::HUGEINT) // 16)::BIGINT AS be57 FROM v"))
r("x17_hamming", lambda f: f.withColumn("p", F.array(*(F.lit(v).cast("short") for v in (1, 2, 3, 4, 5)))).select("frame_id", X.hamming("data", "p").alias("distance")), sql("SELECT frame_id, list_sum([bit_count(xor(coalesce(data[i], 0), coalesce(([1, 2, 3, 4, 5])[i], 0))) FOR i IN range(1, 9)])::BIGINT AS distance FROM fr"))
r("x20_units", lambda f: f.select("frame_id", X.kph_to_mph((F.get("data", F.lit(1)).cast("int") + 1).cast("double")).alias("mph"), (F.col("ts_us") / 1000).alias("ms")), sql("SELECT frame_id, round((b1 + 1) * 0.6213751::DOUBLE, 4) AS mph, round(ts_us / 1000, 4) AS ms FROM fr"), 4)
r("x21_rule_value", lambda f: f.select("frame_id", "data", F.lit(1).alias("byte_idx"), F.lit(2).alias("byte_len"), (F.col("frame_id") % 2 == 0).alias("little_endian"), F.when(F.col("frame_id") % 3 == 0, F.lit(0x0FF0)).cast("long").alias("mask"), (F.col("frame_id") % 3 != 0).alias("is_signed"), F.lit(0.1).alias("scale"), F.lit(5.0).alias("offset")).select("frame_id", X.rule_value().alias("value")), sql("w AS (SELECT frame_id, CASE WHEN frame_id % 2 = 0 THEN b1 + 256 * b2 ELSE b1 * 256 + b2 END AS raw FROM fr) SELECT frame_id, round(CASE WHEN frame_id % 3 = 0 THEN ((raw & 4080) >> 4) WHEN raw > 32767 THEN raw - 65536 ELSE raw END * 0.1::DOUBLE + 5, 6) AS value FROM w"))
