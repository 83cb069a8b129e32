"""Recording comparisons, rules and range joins, with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from framequarry.operators import diff as D
from framequarry.operators import profile as P
from framequarry.operators.store import common_ids
from framequarry.plans.profile import HOUR, PREV, r
from framequarry.schema import sql

ODD, EVEN = "session_id = 1", "session_id = 0"

r("j05_recording_diff", lambda f: D.recording_diff(f.filter(f"{EVEN} AND can_id <> 258"), f.filter(f"{ODD} AND can_id <> 270 AND (can_id <> 260 OR frame_id < 6000)")), sql("""fa AS (SELECT * FROM fr WHERE session_id = 0 AND can_id <> 258), fb AS (SELECT * FROM fr WHERE session_id = 1 AND can_id <> 270 AND (can_id <> 260 OR frame_id < 6000)),
na AS (SELECT can_id, count(*) AS n FROM fa GROUP BY can_id), nb AS (SELECT can_id, count(*) AS n FROM fb GROUP BY can_id),
ba AS (SELECT by_.can_id, byte_idx, min(byte_val) AS lo, max(byte_val) AS hi FROM by_ JOIN fa USING (frame_id) GROUP BY ALL), bb AS (SELECT by_.can_id, byte_idx, min(byte_val) AS lo, max(byte_val) AS hi FROM by_ JOIN fb USING (frame_id) GROUP BY ALL),
m AS (SELECT coalesce(ba.can_id, bb.can_id) AS can_id, sum(CASE WHEN ba.lo IS DISTINCT FROM bb.lo OR ba.hi IS DISTINCT FROM bb.hi THEN 1 << coalesce(ba.byte_idx, bb.byte_idx) ELSE 0 END)::BIGINT AS mask FROM ba FULL JOIN bb ON ba.can_id = bb.can_id AND ba.byte_idx = bb.byte_idx GROUP BY ALL),
j AS (SELECT coalesce(na.can_id, nb.can_id) AS can_id, na.n AS na, nb.n AS nb FROM na FULL JOIN nb ON na.can_id = nb.can_id)
SELECT can_id, CASE WHEN na IS NULL THEN 'Added' WHEN nb IS NULL THEN 'Removed' ELSE 'ByteChanged' END AS change, coalesce(na, 0) AS count_a, coalesce(nb, 0) AS count_b, CASE WHEN na IS NULL OR nb IS NULL THEN 0 ELSE mask END AS changed_mask FROM j JOIN m USING (can_id) WHERE na IS NULL OR nb IS NULL OR mask <> 0"""))
r("j06_compare_by_id", lambda f: D.compare_by_id(f.filter(EVEN), f.filter(ODD)), sql("""k AS (SELECT *, row_number() OVER (PARTITION BY session_id, can_id ORDER BY ts_us, frame_id) AS k FROM fr), a AS (SELECT * FROM k WHERE session_id = 0), b AS (SELECT * FROM k WHERE session_id = 1),
j AS (SELECT coalesce(a.can_id, b.can_id) AS can_id, coalesce(a.k, b.k) AS k, a.frame_id AS frame_a, b.frame_id AS frame_b, a.dlc AS da, b.dlc AS db, CASE WHEN a.frame_id IS NULL OR b.frame_id IS NULL THEN 0 ELSE len([i FOR i IN range(1, greatest(a.dlc, b.dlc) + 1) IF coalesce(a.data[i], 255) <> coalesce(b.data[i], 255)]) END AS diff_bytes FROM a FULL JOIN b ON a.can_id = b.can_id AND a.k = b.k)
SELECT can_id, k, frame_a, frame_b, diff_bytes, CASE WHEN frame_a IS NULL THEN 'RightOnly' WHEN frame_b IS NULL THEN 'LeftOnly' WHEN diff_bytes = 0 AND da = db THEN 'Identical' ELSE 'Different' END AS status FROM j"""))
r("j08_dlc_anomalies", lambda f: D.dlc_anomalies(f).select("frame_id", "can_id", F.col("usual_dlc").cast("long").alias("usual_dlc")), sql("m AS (SELECT can_id, dlc, row_number() OVER (PARTITION BY can_id ORDER BY count(*) DESC, dlc) AS r FROM fr GROUP BY can_id, dlc) SELECT frame_id, fr.can_id, m.dlc AS usual_dlc FROM fr JOIN m ON m.r = 1 AND m.can_id = fr.can_id WHERE fr.dlc <> m.dlc"))
r("j09_interval_join", lambda f: D.interval_join(f.select("frame_id", "ts_us"), f.filter("error AND can_id = 260").select(F.col("frame_id").alias("point_id"), F.col("ts_us").alias("at_us")), HOUR // 2, HOUR).select("point_id", "frame_id"), sql(f"p AS (SELECT frame_id AS point_id, ts_us AS at_us FROM fr WHERE error AND can_id = 260) SELECT point_id, frame_id FROM p JOIN fr ON ts_us BETWEEN at_us - {HOUR // 2} AND at_us + {HOUR}"))
r("j10_request_response", lambda f: D.request_response(f, HOUR // 60, HOUR // 4, 50, 5, HOUR), sql(f"n AS (SELECT *, row_number() OVER (ORDER BY ts_us, frame_id) AS rn FROM fr) SELECT a.can_id AS req_id, b.can_id AS resp_id, count(*) AS hits, round(avg(b.ts_us - a.ts_us) / 1000, 6) AS latency_ms FROM n a JOIN n b ON b.rn BETWEEN a.rn + 1 AND a.rn + 50 AND b.ts_us - a.ts_us BETWEEN {HOUR // 60} AND {HOUR // 4} AND a.can_id <> b.can_id GROUP BY ALL HAVING count(*) >= 5"))
r("j11_background_minus", lambda f: f.filter("frame_id >= 200").select("can_id").distinct().join(f.filter("frame_id < 20").select("can_id").distinct(), "can_id", "left_anti"), sql("SELECT DISTINCT can_id FROM fr WHERE frame_id >= 200 AND can_id NOT IN (SELECT can_id FROM fr WHERE frame_id < 20)"))
r("j12_ids_in_all_events", lambda f: common_ids(f.withColumn("ev", F.col("frame_id") % 5), "ev"), sql("SELECT can_id FROM fr GROUP BY can_id HAVING count(DISTINCT frame_id % 5) = 5"))
r("j18_dictionary_overlap", lambda f: D.dictionary_overlap(f.select("can_id").distinct().crossJoin(f.sparkSession.range(8).select(F.col("id").cast("int").alias("byte_idx"))), f.sparkSession.createDataFrame([(256, "Speed", 0, 16), (256, "Temp", 20, 6), (257, "Gear", 12, 10)], "msg_id long, sig_name string, start_bit int, length int")), sql("s(can_id, sig_name, sb, l) AS (VALUES (256, 'Speed', 0, 16), (256, 'Temp', 20, 6), (257, 'Gear', 12, 10)), c AS (SELECT DISTINCT can_id, byte_idx FROM (SELECT can_id, unnest(range(0, 8)) AS byte_idx FROM fr)) SELECT c.can_id, c.byte_idx, arg_min(s.sig_name, s.sb) AS sig_name FROM c LEFT JOIN s ON s.can_id = c.can_id AND byte_idx >= sb // 8 AND byte_idx < (sb + l + 7) // 8 GROUP BY ALL"))
GATE = {"white": list(range(256, 266)), "black": [258, 270], "remap": {256: 1280, 259: 1281}}
r("f06_gateway", lambda f: D.gateway(f, **GATE).filter("passes").select("frame_id", "out_id"), sql("SELECT frame_id, CASE can_id WHEN 256 THEN 1280 WHEN 259 THEN 1281 ELSE can_id END AS out_id FROM fr WHERE can_id BETWEEN 256 AND 265 AND can_id NOT IN (258, 270)"))
r("f06_gateway_stats", lambda f: D.gateway_stats(f, **GATE), sql("SELECT count(*) FILTER (can_id BETWEEN 256 AND 265 AND can_id <> 258) AS passed, count(*) FILTER (NOT (can_id BETWEEN 256 AND 265 AND can_id <> 258)) AS dropped, count(*) FILTER (can_id IN (256, 259)) AS remapped FROM fr"))
RULES = "ord int, src_id long, use_ext boolean, drop boolean, dst_id long, scale array<double>, shift array<double>"
r("f07_replay_filter", lambda f: D.replay_filter(f, f.sparkSession.createDataFrame([(1, 256, True, True, None, None, None), (2, 256, False, False, 512, [1.0, 0.5, 2.0], [0.0, 10.0, -3.0]), (3, 257, False, True, None, None, None), (4, 256, False, True, None, None, None)], RULES)).select("frame_id", "can_id", F.array_join(F.col("data").cast("array<string>"), ",").alias("data")), sql("""SELECT frame_id, CASE can_id WHEN 256 THEN 512 ELSE can_id END AS can_id, array_to_string(CASE WHEN can_id = 256 THEN [CASE i WHEN 1 THEN data[1] WHEN 2 THEN least(255, greatest(0, round(data[2] * 0.5 + 10.0)))::BIGINT WHEN 3 THEN least(255, greatest(0, round(data[3] * 2.0 - 3.0)))::BIGINT ELSE data[i] END FOR i IN range(1, len(data) + 1)] ELSE data END, ',') AS data FROM fr WHERE can_id <> 257"""))
r("f08_edit_recording", lambda f: D.edit_recording(f, f.filter("frame_id % 100 = 7").select("frame_id", F.lit(1024).cast("long").alias("new_id"), F.array(F.lit(1), F.lit(2)).cast("array<short>").alias("new_data")), f.filter("frame_id % 50 = 3")).select("frame_id", "ts_us", "can_id", F.col("dlc").cast("long").alias("dlc")), sql("SELECT frame_id, ts_us, CASE WHEN frame_id % 100 = 7 THEN 1024 ELSE can_id END AS can_id, CASE WHEN frame_id % 100 = 7 THEN 2 ELSE dlc END AS dlc FROM fr WHERE frame_id % 50 <> 3"))
NODES = "node string, trig_id long, id_mask long, trig_data array<int>, data_mask array<int>, resp_id long, resp_data array<int>, delay_us long"
r("f10_trigger_match", lambda f: D.match_nodes(f, f.sparkSession.createDataFrame([("a", 256, 0x7FC, [3, 0], [0x0F, 0x80], 1000, [1], 5), ("b", 0, 0, [5], [255], 1001, [2, 3], 9)], NODES)).select("frame_id", "node", "can_id", "ts_us"), sql("SELECT frame_id, 'a' AS node, 1000::BIGINT AS can_id, ts_us + 5 AS ts_us FROM fr WHERE (can_id & 2044) = 256 AND (b0 & 15) = 3 AND (b1 & 128) = 0 UNION ALL SELECT frame_id, 'b', 1001, ts_us + 9 FROM fr WHERE b0 = 5"))
r("t15_simulator_replies", lambda f: D.match_nodes(f, f.sparkSession.createDataFrame([("c", 261, 0x7FF, [], [], 1301, [9], 2)], NODES)).select("frame_id", "can_id", "ts_us"), sql("SELECT frame_id, 1301::BIGINT AS can_id, ts_us + 2 AS ts_us FROM fr WHERE can_id = 261"))
TRUTH = "m AS (SELECT *, b1 > 128 AS act, b3 > 50 AS pred FROM fr), c AS (SELECT count(*) FILTER (act AND pred) AS tp, count(*) FILTER (NOT act AND pred) AS fp, count(*) FILTER (act AND NOT pred) AS fn, count(*) FILTER (NOT act AND NOT pred) AS tn FROM m)"
BYTE = lambda i: F.get("data", F.lit(i)).cast("int")
r("a13_confusion", lambda f: D.confusion(f, BYTE(1) > 128, BYTE(3) > 50), sql(f"{TRUTH} SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS prec, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM c"))
r("a13_mse", lambda f: D.errors_of(f, BYTE(1).cast("double"), BYTE(3) * 2.5), sql("SELECT round(avg((b1 - b3 * 2.5) * (b1 - b3 * 2.5)), 6) AS mse, round(sqrt(avg((b1 - b3 * 2.5) * (b1 - b3 * 2.5))), 6) AS rmse FROM fr"))
r("a15_flag_rules", lambda f: D.flag_rules(P.flag_bits(f, 0.3)), sql(f"{PREV}, g AS (SELECT can_id, byte_idx, bit_or(byte_val) & bit_or(255 - byte_val) AS mask, count(*) FILTER (byte_val <> prev) AS changes, count(*) FILTER (byte_val <> prev AND abs(byte_val - prev) > 3) AS jumps FROM prv GROUP BY ALL), v AS (SELECT * FROM g WHERE bit_count(mask) BETWEEN 2 AND 6 AND changes > 0 AND jumps >= 0.3 * changes), x AS (SELECT can_id, byte_idx, mask, unnest(range(0, 8)) AS bit FROM v) SELECT can_id, byte_idx, bit::INT AS bit, (1 << bit)::INT AS bit_mask FROM x WHERE mask & (1 << bit) <> 0"))
MASK = lambda: F.when(F.col("frame_id") % 2 == 0, 0).otherwise(F.expr("shiftleft(1, cast(frame_id % 5 as int))")).cast("long").alias("mask")
r("j15_rule_match", lambda f: D.rule_match(f.select(F.col("frame_id").alias("sig"), "can_id", (F.col("frame_id") % 8).alias("byte_idx"), (F.col("frame_id") % 3 == 0).alias("discrete"), F.expr("shiftleft(1, cast(frame_id % 4 as int))").cast("long").alias("bit_mask")), f.select("frame_id", "can_id", (F.col("frame_id") % 8).alias("byte_idx"), MASK()).groupBy("can_id", "byte_idx", "mask").agg(F.min("frame_id").alias("ord"))), sql("""t AS (SELECT frame_id AS sig, can_id, frame_id % 8 AS byte_idx, frame_id % 3 = 0 AS discrete, 1 << (frame_id % 4) AS bit_mask FROM fr), u AS (SELECT min(frame_id) AS ord, can_id, frame_id % 8 AS byte_idx, CASE WHEN frame_id % 2 = 0 THEN 0 ELSE 1 << (frame_id % 5) END AS mask FROM fr GROUP BY ALL),
j AS (SELECT sig, ord, mask, CASE WHEN discrete THEN mask = bit_mask ELSE ord IS NOT NULL END AS ok FROM t LEFT JOIN u USING (can_id, byte_idx)), k AS (SELECT sig, ord, row_number() OVER (PARTITION BY sig ORDER BY ok DESC, mask <> 0, ord) AS r, ok FROM j) SELECT sig, CASE WHEN ok THEN ord END AS ord FROM k WHERE r = 1"""))
r("a24_detection_rate", lambda f: D.detection_rate(f.select(F.col("can_id").alias("sig"), (BYTE(1) % 3 != 0).alias("detected"))), sql("SELECT can_id AS sig, count(*) AS trials, count(*) FILTER (b1 % 3 = 0) AS misses, round(100.0 * count(*) FILTER (b1 % 3 <> 0) / count(*), 6) AS rate FROM fr GROUP BY can_id"))
r("a21_loss_rate", lambda f: D.loss_rate(f.groupBy("can_id").agg(F.count(F.lit(1)).alias("n_sent"), F.count_if(~F.col("error")).alias("n_rcvd"))), sql("SELECT can_id, count(*) AS n_sent, count(*) FILTER (NOT error) AS n_rcvd, round((1 - count(*) FILTER (NOT error) / count(*)) * 100, 6) AS loss_percent FROM fr GROUP BY can_id"))
r("a21_buffer_limits", lambda f: D.buffer_limits(f.select((F.col("can_id") % 4).alias("buffer_size"), F.col("dlc").cast("long").alias("frequency_hz"), BYTE(1).alias("wait_ms"), (BYTE(1) + BYTE(3) > 200).alias("loss"))), sql("SELECT can_id % 4 AS buffer_size, dlc AS frequency_hz, max(b1) FILTER (b1 + b3 <= 200) AS max_safe_ms, min(b1) FILTER (b1 + b3 > 200) AS min_lossy_ms FROM fr GROUP BY ALL"))
r("a23_autolabel_eval", lambda f: D.confusion(P.flag_bits(f, 0.3).withColumn("truth", F.col("byte_idx").isin(0, 5)), F.col("truth"), F.col("is_flags")), sql(f"{PREV}, g AS (SELECT can_id, byte_idx, bit_or(byte_val) & bit_or(255 - byte_val) AS mask, count(*) FILTER (byte_val <> prev) AS changes, count(*) FILTER (byte_val <> prev AND abs(byte_val - prev) > 3) AS jumps FROM prv GROUP BY ALL), v AS (SELECT byte_idx IN (0, 5) AS act, bit_count(mask) BETWEEN 2 AND 6 AND changes > 0 AND jumps >= 0.3 * changes AS pred FROM g), c AS (SELECT count(*) FILTER (act AND pred) AS tp, count(*) FILTER (NOT act AND pred) AS fp, count(*) FILTER (act AND NOT pred) AS fn, count(*) FILTER (NOT act AND NOT pred) AS tn FROM v) SELECT tp, fp, fn, tn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS prec, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM c"))
r("m28_auto_events", lambda f: D.auto_events(f, BYTE(1), 200).select("frame_id", "value", "prev"), sql("p AS (SELECT frame_id, b1::DOUBLE AS value, lag(b1) OVER (PARTITION BY can_id ORDER BY ts_us, frame_id)::DOUBLE AS prev FROM fr) SELECT * FROM p WHERE abs(value - prev) > 200"))
r("a12_latency_stats", lambda f: f.groupBy(F.col("can_id").alias("model")).agg(F.count_if(~F.col("error")).alias("n_success"), *(x for i, c in enumerate(("t_det", "t_llm", "t_ota")) for x in (F.avg(F.when(~F.col("error"), BYTE(i + 1))).alias(f"mean_{c}"), F.stddev_samp(F.when(~F.col("error"), BYTE(i + 1))).alias(f"sigma_{c}")))), sql("SELECT can_id AS model, count(*) AS n_success, round(avg(b1), 6) AS mean_t_det, round(stddev_samp(b1), 6) AS sigma_t_det, round(avg(b2), 6) AS mean_t_llm, round(stddev_samp(b2), 6) AS sigma_t_llm, round(avg(b3), 6) AS mean_t_ota, round(stddev_samp(b3), 6) AS sigma_t_ota FROM fr WHERE NOT error GROUP BY can_id"))
