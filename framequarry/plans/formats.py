"""Round trips of the text, message and binary formats over the adapted frames, and the extension points, with the SQL they must agree with."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.functions import extend as E
from framequarry.operators import learn as L
from framequarry.operators.store import candump_rows, frame_json, json_batches
from framequarry.plans.decode import DBC, VALUES
from framequarry.plans.folds import ALERTS, TAIL, alerts
from framequarry.plans.registry import add
from framequarry.schema import byte_at, hex_bytes, sql
from framequarry.sources import binary as B
from framequarry.sources import dictionary as D
from framequarry.sources import text as T

HEX = "array_to_string([lpad(upper(to_hex(x)), 2, '0') FOR x IN data], '')"
PLAIN = sql(f"SELECT can_id, {HEX} AS data, count(*) AS n FROM fr GROUP BY ALL")


def told(df: DataFrame) -> DataFrame:
    """Frames whose format carries no time, as counts of equal ones."""
    return df.select("can_id", hex_bytes().alias("data")).groupBy("can_id", "data").agg(F.count(F.lit(1)).alias("n"))


def lines(f: DataFrame, line) -> DataFrame:
    return f.select(line.alias("value"))


def serial_line():
    return F.concat(F.lit("t"), F.lpad(F.hex("can_id"), 3, "0"), F.col("dlc").cast("string"), hex_bytes())


def esp_line():
    return F.concat_ws(" ", F.lit("RX"), F.lit("STD"), F.hex("can_id"), F.col("dlc").cast("string"), F.array_join(F.transform("data", lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), " "))


add("s08_serial_lines", lambda f: told(T.parse_slcan(lines(f, serial_line()))), PLAIN)
add("s10_esp_lines", lambda f: told(T.parse_esp(lines(f, esp_line()))), PLAIN)
add("s11_json_messages", lambda f: T.parse_messages(json_batches(f).select(F.col("message").alias("value"))).select("ts_us", "can_id", hex_bytes().alias("data")), sql(f"SELECT ts_us, can_id, {HEX} AS data FROM fr"))
add("s12_posted_frames", lambda f: told(T.parse_send(lines(f, frame_json()))), PLAIN)
add("s01_candump_us", lambda f: T.parse_candump(candump_rows(f, "can0", "us").select(F.regexp_replace("line", r"#\d", "#").alias("value")), "us").select("ts_us", "can_id", hex_bytes().alias("data")), sql(f"SELECT ts_us, can_id, {HEX} AS data FROM fr"))
add("s02_candump_digit", lambda f: T.parse_candump(candump_rows(f, "can0", "digit").select(F.regexp_replace("line", r"#(\d)", "##$1").alias("value")), "digit").select("ts_us", "can_id", hex_bytes().alias("data")), sql(f"SELECT ts_us, can_id, {HEX} AS data FROM fr"))


def gvret(f: DataFrame) -> DataFrame:
    """Packets of each frame, cut in two so that every second read ends inside one."""
    def over(batches):
        for pdf in batches:
            rest, out = b"", []
            for r in pdf.itertuples():
                body = bytes(int(x) for x in r.data)
                packet = B.GVRET_HEAD + bytes(4) + struct.pack("<I", r.can_id) + bytes([len(body)]) + body
                for part in (packet[:7], packet[7:]):
                    found, rest = B.feed_gvret(rest + part)
                    out += [(i, d.hex().upper()) for i, _, d in found]
            yield pd.DataFrame(out, columns=["can_id", "data"])

    return f.select("can_id", "data").mapInPandas(over, "can_id long, data string").groupBy("can_id", "data").agg(F.count(F.lit(1)).alias("n"))


add("s09_gvret_stream", gvret, PLAIN)
add("k12_dictionary_text", lambda f: f.sparkSession.createDataFrame([s for s in D.parse_dbc(D.serialize_dbc(D.parse_dbc(DBC))) if s[3]], D.SIGNAL_SCHEMA).select("msg_id", "sig_name", "start_bit", "length"), "SELECT * FROM (VALUES (256::BIGINT, 'Speed', 8, 16), (256, 'Nibble', 4, 8), (256, 'Temp', 8, 8), (257, 'Press', 15, 16), (257, 'Odd', 12, 6)) t(msg_id, sig_name, start_bit, length)")
add("k16_top_significant", lambda f: L.p_values(L.byte_correlations(L.long_bytes_of_frames(f, "k", byte_at(3).cast("double")))).filter("p < 0.05").orderBy(F.desc(F.abs(F.round("r", 9))), "can_id", "byte_idx").limit(20).select("can_id", "byte_idx"), sql(f"{TAIL} SELECT can_id, byte_idx FROM t WHERE p < 0.05 ORDER BY abs(round(r, 9)) DESC, can_id, byte_idx LIMIT 20"))


def _log_new(host, rule, can_id, ts) -> None:
    if rule == "new":
        host.log(f"{can_id}")


class Odd:
    """A plugin that numbers the bytes of frames with an odd first byte."""

    schema = "frame_id long, total long"

    def relevant(self):
        return byte_at(0) % 2 == 1

    def process(self, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"frame_id": pdf["frame_id"], "total": [int(sum(x)) for x in pdf["data"]]})


add("e02_alert_script", lambda f: E.on_alert(alerts(f), _log_new).select("frame_id", "text"), sql(f"{ALERTS} SELECT frame_id, can_id::VARCHAR AS text FROM al WHERE rule = 'new'"))
add("e03_plugin", lambda f: E.run_plugin(f, Odd()), sql("SELECT frame_id, list_sum(data)::BIGINT AS total FROM fr WHERE b0 % 2 = 1"))
add("e04_injected_score", lambda f: E.scored(f, F.col("error"), byte_at(1) * 2).select("frame_id", "score"), sql("SELECT frame_id, b1 * 2 AS score FROM fr WHERE error"))


def decode_in_sql(f: DataFrame) -> DataFrame:
    E.register_decode(f.sparkSession, D.parse_dbc(DBC))
    return f.sparkSession.sql("SELECT f.frame_id, d.sig_name, round(d.value, 6) AS value FROM {f} f, LATERAL decode_signals(f.can_id, f.data) d", f=f)


add("e06_table_function", decode_in_sql, sql(f"{VALUES} SELECT frame_id, sig_name, round(value, 6) AS value FROM sg"))
