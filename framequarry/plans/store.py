"""Queries over the frame store, with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from framequarry.functions.expr import compile_filter, filter_frames
from framequarry.operators import store as S
from framequarry.plans.registry import add
from framequarry.schema import hex_bytes, sql

T0 = 1_704_067_200_000_000
HEX2 = "lpad(upper(to_hex(x)), 2, '0')"
HEX_SQL = f"array_to_string([{HEX2} FOR x IN data], '')"
EXPR = "can.id >= 0x104 and (can.data[1] > 128 or not can.dlc == 8) && can.data[7] == 0"

add("f01_filter_language", lambda f: filter_frames(f, EXPR).select("frame_id", "can_id"), sql("SELECT frame_id, can_id FROM fr WHERE can_id >= 260 AND (b1 > 128 OR dlc <> 8) AND (dlc < 8 OR b7 = 0)"))
add("f01_filter_flags", lambda f: filter_frames(f, "can.err || can.data[12] != 0 || can.data[0] == 0xF").select("frame_id", "can_id"), sql("SELECT frame_id, can_id FROM fr WHERE error OR b0 = 15"))
add("f01_filter_invalid", lambda f: filter_frames(f, "can.id ==").agg(F.count(F.lit(1)).alias("n")), sql("SELECT 0::BIGINT AS n FROM fr LIMIT 1"))
add("f01_filter_empty", lambda f: filter_frames(f, " ").agg(F.count(F.lit(1)).alias("n")), sql("SELECT count(*) AS n FROM fr"))
add("f01_filter_time", lambda f: f.filter(compile_filter("!(can.ts < 1704153600000000) and can.ext == false and can.fd == 0")[0]).agg(F.count(F.lit(1)).alias("n"), F.sum("can_id").alias("ids")), sql("SELECT count(*) AS n, sum(can_id)::BIGINT AS ids FROM fr WHERE ts_us >= 1704153600000000"))
add("f02_hex_id_filter", lambda f: S.by_hex_id(f, "0x107").select("frame_id", "dlc"), sql("SELECT frame_id, dlc FROM fr WHERE can_id = 263"))
add("f03_export_filter", lambda f: S.export_filter(f, 258, 262, T0, T0 + 10 * 86_400_000_000).select("frame_id", "can_id", "ts_us"), sql(f"SELECT frame_id, can_id, ts_us FROM fr WHERE can_id BETWEEN 258 AND 262 AND ts_us BETWEEN {T0} AND {T0 + 10 * 86_400_000_000}"))
add("f04_events_in_range", lambda f: S.events_in_range(f, T0, T0 + 86_400_000_000, 260).select("frame_id", "ts_us"), sql(f"SELECT frame_id, ts_us FROM fr WHERE ts_us BETWEEN {T0} AND {T0 + 86_400_000_000} AND can_id = 260"))
add(
    "f05_payload_search", lambda f: S.search_payload(f, [0x00, 0x05], [0xF0, 0x07]).select("frame_id", "offset"),
    sql("m AS (SELECT frame_id, [o FOR o IN range(0, len(data) - 1) IF (data[o + 1] & 240) = 0 AND (data[o + 2] & 7) = 5] AS os FROM fr) SELECT frame_id, os[1] AS offset FROM m WHERE len(os) > 0"),
)
add("f11_decimate", lambda f: S.decimate(f, 16).select("frame_id", "can_id"), sql("SELECT frame_id, can_id FROM fr WHERE (frame_id + 1) % 16 = 0"))
add("f12_display_rows", S.display_rows, sql(f"SELECT frame_id, lpad(upper(to_hex(can_id)), 3, '0') AS id_text, 'CAN' AS kind, array_to_string([{HEX2} FOR x IN data], ' ') AS data_text FROM fr"))
add("f13_compare_filter", lambda f: S.compare_filter(f, 261, T0 / 1e6, T0 / 1e6 + 86_400 * 7).select("frame_id"), sql(f"SELECT frame_id FROM fr WHERE can_id = 261 AND ts_us / 1e6 >= {T0 / 1e6} AND ts_us / 1e6 <= {T0 / 1e6 + 86_400 * 7}"))
add("o01_sort_rows", lambda f: S.sort_rows(f, "dlc", True).select("frame_id", "dlc").limit(50), sql("SELECT frame_id, dlc FROM fr ORDER BY dlc DESC, ts_us, frame_id LIMIT 50"))
add("o02_newest_frames", lambda f: S.newest(f, 200, 266).select("frame_id", "ts_us"), sql("SELECT frame_id, ts_us FROM fr WHERE can_id = 266 ORDER BY ts_us DESC, frame_id DESC LIMIT 200"))
add("o03_top_by_bytes", lambda f: S.top_ids(f, 10, "bytes"), sql("SELECT can_id, count(*) AS frames, sum(dlc)::BIGINT AS bytes FROM fr GROUP BY can_id ORDER BY bytes DESC, can_id LIMIT 10"))
add("o03_top_by_frames", lambda f: S.top_ids(f, 10), sql("SELECT can_id, count(*) AS frames, sum(dlc)::BIGINT AS bytes FROM fr GROUP BY can_id ORDER BY frames DESC, can_id LIMIT 10"))
add("q01_by_can_id", lambda f: S.by_can_id(f, 259, 1, 100).select("frame_id", "ts_us", "dlc"), sql("SELECT frame_id, ts_us, dlc FROM fr WHERE can_id = 259 AND session_id = 1 ORDER BY ts_us, frame_id LIMIT 100"))
add("q02_time_range", lambda f: S.time_range(f, T0, T0 + 5 * 86_400_000_000).select("frame_id", "ts_us"), sql(f"SELECT frame_id, ts_us FROM fr WHERE ts_us BETWEEN {T0} AND {T0 + 5 * 86_400_000_000} ORDER BY ts_us, frame_id LIMIT 10000"))
add("q03_total", lambda f: S.total(f, 1), sql("SELECT count(*) AS frames FROM fr WHERE session_id = 1"))
add("q04_sessions", lambda f: S.sessions(S.sessions_of(f)), sql("SELECT session_id AS id, CASE session_id WHEN 0 THEN 'even' ELSE '' END AS label, min(ts_us) AS started, max(ts_us) AS ended FROM fr GROUP BY session_id"))
add("q05_reset", lambda f: S.reset(f).agg(F.count(F.lit(1)).alias("frames")), sql("SELECT 0::BIGINT AS frames FROM fr LIMIT 1"))
add("q05_id_frequency", S.id_frequency, sql("SELECT can_id, count(*) AS frames, CASE WHEN count(*) > 1 THEN (max(ts_us) - min(ts_us)) / 1e6 / (count(*) - 1) ELSE 0 END AS mean_interval_s FROM fr GROUP BY can_id"))
add(
    "q06_status", lambda f: S.status(f).select("frames", "unique_ids", F.round("fps", 9).alias("fps"), F.round("bus_load_pct", 9).alias("bus_load_pct")),
    sql("SELECT count(*) AS frames, count(DISTINCT can_id) AS unique_ids, round(count(*) / ((max(ts_us) - min(ts_us)) / 1e6), 9) AS fps, round(100.0 * sum(44 + 8 * dlc) / ((max(ts_us) - min(ts_us)) / 1e6 * 500000), 9) AS bus_load_pct FROM fr"),
)
add("q07_newest_all", lambda f: S.newest(f, 9000, None, 2000).select("frame_id", "can_id"), sql("SELECT frame_id, can_id FROM fr ORDER BY ts_us DESC, frame_id DESC LIMIT 2000"))
add("q08_ids", S.ids, sql("SELECT can_id, count(*) AS frames, max(ts_us) AS last_us FROM fr GROUP BY can_id"))
add("u01_common_ids", lambda f: S.common_ids(f, "session_id"), sql("SELECT can_id FROM fr GROUP BY can_id HAVING count(DISTINCT session_id) = (SELECT count(DISTINCT session_id) FROM fr)"))
add("u02_minus_ids", lambda f: S.minus_ids(f.filter("dlc = 8"), f.filter(F.col("ts_us") < T0 + 1_800_000_000)), sql(f"SELECT DISTINCT can_id FROM fr WHERE dlc = 8 AND can_id NOT IN (SELECT can_id FROM fr WHERE ts_us < {T0 + 1_800_000_000})"))
add("u03_id_changes", lambda f: S.id_changes(f.filter("can_id < 266"), f.filter("can_id > 260")), sql("SELECT DISTINCT can_id, 'removed' AS change FROM fr WHERE can_id <= 260 UNION ALL SELECT DISTINCT can_id, 'added' FROM fr WHERE can_id >= 266"))
add(
    "u04_merge_streams", lambda f: S.merge_streams(("live", f.filter("session_id = 0")), ("replay", f.filter("session_id = 1").drop("esi"))).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count("esi").alias("with_esi")),
    sql("SELECT CASE session_id WHEN 0 THEN 'live' ELSE 'replay' END AS origin, count(*) AS n, sum(CASE session_id WHEN 0 THEN 1 ELSE 0 END)::BIGINT AS with_esi FROM fr GROUP BY session_id"),
)
add("u05_distinct_ids", S.distinct_ids, sql("SELECT DISTINCT can_id FROM fr"))
add(
    "k01_csv_rows", S.csv_rows,
    sql(f'SELECT frame_id AS "Index", ts_us AS "Timestamp_us", lpad(upper(to_hex(can_id)), 3, \'0\') AS "ID_hex", 0 AS "Extended", 0 AS "RTR", 0 AS "FD", dlc::INT AS "DLC", {HEX_SQL} AS "Data_hex" FROM fr'),
)
for _name, _dialect, _when, _ident, _digit in (
    ("k02_candump_digit", "digit", "(ts_us // 1000000)::VARCHAR || '.' || lpad((ts_us % 1000000)::VARCHAR, 6, '0')", "lpad(upper(to_hex(can_id)), 3, '0')", "dlc::VARCHAR"),
    ("k02_candump_standard", "standard", "(ts_us // 1000000)::VARCHAR || '.' || lpad((ts_us % 1000000)::VARCHAR, 6, '0')", "lpad(upper(to_hex(can_id)), 3, '0')", "''"),
    ("k03_candump_us", "us", "ts_us::VARCHAR", "upper(to_hex(can_id))", "dlc::VARCHAR"),
):
    add(_name, lambda f, d=_dialect: S.candump_rows(f, "can0", d), sql(f"SELECT frame_id, '(' || {_when} || ') can0 ' || {_ident} || '#' || {_digit} || {HEX_SQL} AS line FROM fr"))
add("k08_append_counts", lambda f: f.groupBy("session_id").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.col("dlc").cast("long")).alias("bytes")), sql("SELECT session_id, count(*) AS frames, sum(dlc)::BIGINT AS bytes FROM fr GROUP BY session_id"))
add(
    "k09_json_batches", S.json_batches,
    sql(f"""j AS (SELECT frame_id // 500 AS batch, frame_id, '{{"id":' || can_id || ',"extended":false,"rtr":false,"fd":false,"dlc":' || dlc || ',"timestamp":' || ts_us || ',"data":"' || {HEX_SQL} || '"}}' AS f FROM fr)
SELECT batch, count(*) AS n, '{{"type":"frames","count":' || count(*) || ',"frames":[' || string_agg(f, ',' ORDER BY frame_id) || ']}}' AS message FROM j GROUP BY batch"""),
)
add("k11_frame_json", lambda f: f.select("frame_id", S.frame_json().alias("json")), sql(f"""SELECT frame_id, '{{"id":' || can_id || ',"extended":false,"rtr":false,"fd":false,"dlc":' || dlc || ',"timestamp":' || ts_us || ',"data":"' || {HEX_SQL} || '"}}' AS json FROM fr"""))
add("w14_trend_window", lambda f: S.window_trim(f, F.get("data", F.lit(1)).cast("long"), 86_400_000_000), sql("l AS (SELECT *, max(ts_us) OVER (PARTITION BY can_id) AS last FROM fr) SELECT can_id, count(*) AS points, min(b1) AS min_value, max(b1) AS max_value FROM l WHERE ts_us >= last - 86400000000 GROUP BY can_id"))
add("s05_store_scan", lambda f: f.select("frame_id", "session_id", "ts_us", "can_id", "dlc", hex_bytes().alias("data")), sql(f"SELECT frame_id, session_id, ts_us, can_id, dlc, {HEX_SQL} AS data FROM fr"))
