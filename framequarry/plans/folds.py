"""Sequential folds over the adapted frames. Where a fold has a window form too, SQL checks it; the rest is tested on vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.operators import learn as L
from framequarry.operators.store import candump_rows
from framequarry.plans.profile import HOUR, r
from framequarry.plans.registry import add
from framequarry.schema import byte_at, hex_bytes, sql
from framequarry.sources.text import parse_candump
from framequarry.streaming import folds as S


def valued(f: DataFrame) -> DataFrame:
    return f.select("frame_id", "can_id", "ts_us", byte_at(1).cast("double").alias("value"))


def iso_tp_frames(f: DataFrame) -> DataFrame:
    """A trace of transport frames: each adapted frame becomes a single frame, or a first and a consecutive one."""
    b = lambda i: byte_at(i).cast("int")
    single = F.array(F.lit(3), b(1), b(2), b(3))
    first = F.array(F.lit(0x10), F.lit(10), b(0), b(1), b(2), b(3), b(4), b(5))
    next_ = F.array(F.when(F.col("frame_id") % 7 == 0, 0x22).otherwise(0x21), b(6), b(1), b(2), b(3))
    parts = F.when(F.col("frame_id") % 3 == 0, F.array(F.struct(F.lit(0).alias("o"), single.alias("data")))).otherwise(F.array(F.struct(F.lit(0).alias("o"), first.alias("data")), F.struct(F.lit(1).alias("o"), next_.alias("data"))))
    return f.select("frame_id", (F.lit(0x7E0) + F.col("can_id") % 16).alias("can_id"), "ts_us", F.inline(parts)).withColumn("ts_us", F.col("ts_us") + F.col("o")).withColumn("data", F.col("data").cast("array<short>"))


ISO = "it AS (SELECT frame_id, 2016 + can_id % 16 AS can_id, ts_us, CASE WHEN frame_id % 3 = 0 THEN [b1, b2, b3] ELSE [b0, b1, b2, b3, CASE WHEN dlc > 4 THEN b4 ELSE 0 END, CASE WHEN dlc > 5 THEN b5 ELSE 0 END, CASE WHEN dlc > 6 THEN b6 ELSE 0 END, b1, b2, b3] END AS p FROM fr WHERE frame_id % 3 = 0 OR frame_id % 7 <> 0), ix AS (SELECT can_id, ts_us, array_to_string([lpad(lower(to_hex(x)), 2, '0') FOR x IN p], '') AS payload FROM it)"
add("t07_iso_tp", lambda f: S.run_fold(iso_tp_frames(f), ["can_id"], ["ts_us", "frame_id"], S.iso_tp(), "can_id long, ts_us long, payload string"), sql(f"{ISO} SELECT * FROM ix"))
add("t08_can_tp", lambda f: S.run_fold(iso_tp_frames(f), ["can_id"], ["ts_us", "frame_id"], S.can_tp(), "can_id long, ts_us long, payload string, error string"), sql(f"{ISO} SELECT can_id, ts_us, payload, '' AS error FROM ix UNION ALL SELECT 2016 + can_id % 16, ts_us, '', 'CAN TP sequence number error (expected 1, got 2)' FROM fr WHERE frame_id % 3 <> 0 AND frame_id % 7 = 0"))
#: Frames numbered by identifier, for recursions that take one frame of each identifier a step.
STEPS = "nu AS (SELECT can_id, frame_id, ts_us, b1::DOUBLE AS x, list_slice(data, 2, 4) AS part, row_number() OVER (PARTITION BY can_id ORDER BY ts_us, frame_id) AS rn FROM fr)"


def recursive(body: str) -> str:
    return sql(body).replace("WITH ", "WITH RECURSIVE ", 1)


add("w08_rate_limit", lambda f: S.run_fold(f, ["can_id"], ["ts_us", "frame_id"], S.rate_limit(1 / 7200, {260: 0, 261: 1 / 36000}), "frame_id long, can_id long, ts_us long"), recursive(f"""{STEPS}, st AS (SELECT can_id, frame_id, ts_us, rn, ts_us AS last, true AS ok FROM nu WHERE rn = 1 AND can_id <> 260
UNION ALL SELECT n.can_id, n.frame_id, n.ts_us, n.rn, CASE WHEN n.ts_us - s.last < CASE n.can_id WHEN 261 THEN 36000000000 ELSE 7200000000 END THEN s.last ELSE n.ts_us END, n.ts_us - s.last >= CASE n.can_id WHEN 261 THEN 36000000000 ELSE 7200000000 END FROM st s JOIN nu n ON n.can_id = s.can_id AND n.rn = s.rn + 1) SELECT frame_id, can_id, ts_us FROM st WHERE ok"""))
add("k10_publish_on_change", lambda f: S.run_fold(valued(f), ["can_id"], ["ts_us", "frame_id"], S.dead_band(50.0), "can_id long, ts_us long, value double"), recursive(f"""{STEPS}, st AS (SELECT can_id, ts_us, rn, x AS held, true AS ok FROM nu WHERE rn = 1
UNION ALL SELECT n.can_id, n.ts_us, n.rn, CASE WHEN abs(n.x - s.held) < 50 THEN s.held ELSE n.x END, abs(n.x - s.held) >= 50 FROM st s JOIN nu n ON n.can_id = s.can_id AND n.rn = s.rn + 1) SELECT can_id, ts_us, held AS value FROM st WHERE ok"""))
r("m15_ewma", lambda f: S.run_fold(valued(f), ["can_id"], ["ts_us", "frame_id"], S.ewma(), "can_id long, frame_id long, score double"), recursive(f"""{STEPS}, st AS (SELECT can_id, frame_id, rn, x, x AS mean, 0::DOUBLE AS var FROM nu WHERE rn = 1
UNION ALL SELECT n.can_id, n.frame_id, n.rn, n.x, s.mean + 0.1::DOUBLE * (n.x - s.mean), 0.9::DOUBLE * (s.var + 0.1::DOUBLE * (n.x - s.mean) * (n.x - s.mean)) FROM st s JOIN nu n ON n.can_id = s.can_id AND n.rn = s.rn + 1) SELECT can_id, frame_id, round(CASE WHEN rn > 1 AND var > 1e-12 THEN abs(x - mean) / sqrt(var) ELSE 0 END, 6) AS score FROM st"""))
RULES = [{"name": "new", "type": "NewCanId"}, {"name": "dlc", "type": "DlcChange"}, {"name": "rate", "type": "RateAnomaly", "percent": 50.0}]
ALERTS = "ga AS (SELECT *, row_number() OVER w AS rn, lag(ts_us) OVER w AS t1, lag(ts_us, 2) OVER w AS t2, first_value(dlc) OVER w AS d0 FROM fr WINDOW w AS (PARTITION BY can_id ORDER BY ts_us, frame_id)), ba AS (SELECT can_id, 1e6 / avg(ts_us - t1) AS hz FROM ga WHERE rn BETWEEN 2 AND 16 GROUP BY can_id), al AS (SELECT 'new' AS rule, frame_id, can_id, ts_us FROM ga WHERE rn = 1 UNION ALL SELECT 'dlc', frame_id, can_id, ts_us FROM ga WHERE dlc <> d0 UNION ALL SELECT 'rate', frame_id, can_id, ts_us FROM ga JOIN ba USING (can_id) WHERE rn >= 18 AND t1 > t2 AND abs(1e6 / (t1 - t2) - hz) / hz * 100 > 50)"
alerts = lambda f: S.run_fold(f.select("frame_id", "can_id", "ts_us", F.col("dlc").cast("long").alias("dlc")), ["can_id"], ["ts_us", "frame_id"], S.alerts(RULES), "rule string, frame_id long, can_id long, ts_us long")
add("t09_alert_rules", alerts, sql(f"{ALERTS} SELECT * FROM al"))
add("q09_newest_alerts", lambda f: alerts(f).orderBy(F.desc("ts_us"), "rule", "frame_id").limit(100), sql(f"{ALERTS} SELECT * FROM al ORDER BY ts_us DESC, rule, frame_id LIMIT 100"))
add("t10_uds_sequence", lambda f: S.run_fold(iso_tp_frames(f).join(f.select("frame_id", "session_id"), "frame_id"), ["session_id"], ["ts_us", "frame_id"], S.uds_sequence([{"name": "open", "rx": 0x7E3, "sid": 0x30, "timeout_us": 10 * HOUR, "retries": 1, "stop": True}, {"name": "read", "rx": 0x7E8, "sid": 0x22, "timeout_us": HOUR, "retries": 2, "stop": False}]), "step string, status string, retries long, elapsed_us long"))
add("t11_liveness", lambda f: S.run_fold(f, ["can_id"], ["ts_us", "frame_id"], S.liveness({i: 6.0 * HOUR for i in range(256, 272)}), "can_id long, ts_us long, event string"), sql(f"gp2 AS (SELECT can_id, ts_us, lag(ts_us) OVER (PARTITION BY can_id ORDER BY ts_us, frame_id) AS pt FROM fr) SELECT can_id, pt + {6 * HOUR} AS ts_us, 'offline' AS event FROM gp2 WHERE ts_us - pt > {6 * HOUR} UNION ALL SELECT can_id, ts_us, 'online' FROM gp2 WHERE ts_us - pt > {6 * HOUR}"))
#: What a stream keeps after a step: all while it is short or a frame isn't whole, what follows a frame, nothing without a sync byte. A step brings four bytes, so it ends one frame at most.
LEFT_OVER = "CASE WHEN len(s.b) < 4 THEN s.b WHEN NOT list_contains(s.b, 85) THEN []::BIGINT[] WHEN len(s.b) - list_position(s.b, 85) + 1 < 5 THEN list_slice(s.b, list_position(s.b, 85), len(s.b)) ELSE list_slice(s.b, list_position(s.b, 85) + 5, len(s.b)) END"
add("t13_lin_stream", lambda f: S.run_fold(f.withColumn("data", F.concat(F.array(F.lit(0x55).cast("short")), F.slice("data", 2, 3))), ["can_id"], ["ts_us", "frame_id"], S.lin_feed(2), "can_id long, ts_us long, pid long, payload string, checksum long"), recursive(f"""{STEPS}, fe AS (SELECT can_id, ts_us, rn, list_concat([85::BIGINT], part) AS d FROM nu), jo AS (SELECT can_id, ts_us, rn, d AS b FROM fe WHERE rn = 1
UNION ALL SELECT f.can_id, f.ts_us, f.rn, list_concat({LEFT_OVER}, f.d) FROM jo s JOIN fe f ON f.can_id = s.can_id AND f.rn = s.rn + 1), cu AS (SELECT can_id, ts_us, list_slice(b, list_position(b, 85), len(b)) AS c FROM jo WHERE len(b) >= 4 AND list_contains(b, 85))
SELECT can_id, ts_us, c[2] AS pid, array_to_string([lpad(lower(to_hex(x)), 2, '0') FOR x IN list_slice(c, 3, 4)], '') AS payload, c[5] AS checksum FROM cu WHERE len(c) >= 5"""))
add("j07_compare_positional", lambda f: S.merge_heads(f.withColumn("side", F.when(F.col("session_id") == 0, "a").otherwise("b")), HOUR // 20).groupBy("status").agg(F.count(F.lit(1)).alias("n")))
#: p of r as the tail of its density, (1 - u^2)^((n - 4) / 2) over the beta function, by Simpson's rule on 2,000 steps from |r| to 1.
TAIL = """z AS (SELECT by_.can_id, byte_idx::INT AS byte_idx, byte_val, b3::DOUBLE AS value FROM by_ JOIN fr USING (frame_id)), c AS (SELECT can_id, byte_idx, count(*) AS n, CASE WHEN count(*) < 3 OR stddev_pop(byte_val) < 1e-9 OR stddev_pop(value) < 1e-9 THEN 0 ELSE corr(byte_val, value) END AS r FROM z GROUP BY ALL),
s AS (SELECT *, unnest(range(0, 2001)) AS i FROM c), u AS (SELECT *, abs(r) + (1 - abs(r)) * i / 2000.0::DOUBLE AS u, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM s),
t AS (SELECT can_id, byte_idx, any_value(n) AS n, any_value(r) AS r, CASE WHEN any_value(n) < 3 THEN 1 WHEN abs(any_value(r)) >= 1 - 1e-12 THEN 0 ELSE 2 * exp(lgamma((any_value(n) - 1) / 2.0) - lgamma(0.5) - lgamma((any_value(n) - 2) / 2.0)) * (1 - abs(any_value(r))) / 6000.0 * sum(w * power(greatest(0, 1 - u * u), (n - 4) / 2.0)) END AS p FROM u GROUP BY can_id, byte_idx)"""
r("x18_p_values", lambda f: L.p_values(L.byte_correlations(L.long_bytes_of_frames(f, "k", byte_at(3).cast("double")))).select("can_id", "byte_idx", "n", "r", "p"), sql(f"{TAIL} SELECT can_id, byte_idx, n, round(r, 6) AS r, round(p, 6) AS p FROM t"))
r("f14_significant", lambda f: L.p_values(L.byte_correlations(L.long_bytes_of_frames(f, "k", byte_at(3).cast("double")))).filter("p < 0.05").select("can_id", "byte_idx"), sql(f"{TAIL} SELECT can_id, byte_idx FROM t WHERE p < 0.05"))
r("k07_channel_samples", lambda f: f.crossJoin(F.broadcast(f.agg(F.min("ts_us").alias("t0")))).select("can_id", "frame_id", ((F.col("ts_us") - F.col("t0")) / 1e6).alias("rel_s"), byte_at(0).cast("double").alias("value")), sql("SELECT can_id, frame_id, round((ts_us - (SELECT min(ts_us) FROM fr)) / 1e6, 6) AS rel_s, b0::DOUBLE AS value FROM fr"))
add("s01_s02_candump_round_trip", lambda f: parse_candump(candump_rows(f, "can0", "standard").withColumnRenamed("line", "value"), "standard").select("ts_us", "can_id", hex_bytes().alias("data")), sql("SELECT ts_us, can_id, array_to_string([lpad(upper(to_hex(x)), 2, '0') FOR x IN data], '') AS data FROM fr"))
