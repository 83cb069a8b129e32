"""Numeric models over the adapted frames: iterative or randomised, so checked by vectors and invariants in the tests; what SQL can say is said."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.operators import learn as L
from framequarry.operators import models as M
from framequarry.operators import profile as P
from framequarry.operators import windows as W
from framequarry.plans.folds import STEPS, recursive
from framequarry.plans.profile import ENT, HOUR, PREV, r
from framequarry.plans.registry import add
from framequarry.schema import byte_at, bytes_long, sql
from framequarry.functions import extend as E
from framequarry.sources import binary as B
from framequarry.sources import documents as J
from framequarry.streaming import folds as S
from framequarry.streaming import runtime as R


def series(f: DataFrame) -> DataFrame:
    """Each byte of each identifier as a series in arrival order, with byte 3 as the target."""
    t = f.select("frame_id", byte_at(3).alias("target"))
    return bytes_long(f).join(t, "frame_id").select("can_id", F.col("byte_idx").cast("long").alias("byte_idx"), F.col("frame_id").alias("ord"), F.col("byte_val").alias("value"), "target")


def win(f: DataFrame) -> DataFrame:
    return W.window_features(f, 2 * HOUR)


def flat(f: DataFrame) -> DataFrame:
    return f.select("frame_id", *(byte_at(i).cast("double").alias(f"x{i}") for i in range(7)), (byte_at(1) * 2.0 + byte_at(3)).alias("y"))


X = [f"x{i}" for i in range(7)]
#: Lines of byte 3 by each byte.
LINES = "z AS (SELECT by_.can_id, byte_idx, byte_val, b3::DOUBLE AS value FROM by_ JOIN fr USING (frame_id)), ln AS (SELECT can_id, byte_idx, regr_slope(value, byte_val) AS slope, regr_intercept(value, byte_val) AS intercept, corr(byte_val, value) AS c, stddev_pop(byte_val) AS sx FROM z GROUP BY ALL)"
r("m13_bootstrap_interval", lambda f: M.bootstrap_models(L.long_bytes_of_frames(f, "k", byte_at(3).cast("double"))).select("can_id", "byte_idx", "slope", (F.round("intercept", 6) + 0.0).alias("intercept"), (F.col("low") <= F.col("high")).alias("ordered")), sql(f"{LINES} SELECT can_id, byte_idx, round(slope, 6) AS slope, round(intercept, 6) + 0.0 AS intercept, true AS ordered FROM ln WHERE sx >= 1e-9"))
add("m16_isolation_forest", lambda f: M.isolation_scores(win(f)))
add("m17_window_clusters", lambda f: M.cluster_windows(win(f)))
add("m17_dominant_ids", lambda f: M.dominant_ids(W.feature_windows(f, 2 * HOUR), M.cluster_windows(win(f))))
add("m18_elbow", lambda f: M.elbow(win(f)))
add("m19_density_clusters", lambda f: M.dbscan_windows(win(f)))
add("m20_principal_components", lambda f: M.pca_windows(win(f)))
add("m21_tsne", lambda f: M.tsne_windows(win(f)))
r("m22_fft_peaks", lambda f: M.fft_peaks(series(f)), sql("""se AS (SELECT can_id, byte_idx, row_number() OVER w - 1 AS k, byte_val - avg(byte_val) OVER (PARTITION BY can_id, byte_idx) AS v FROM by_ WINDOW w AS (PARTITION BY can_id, byte_idx ORDER BY frame_id)), sz AS (SELECT can_id, byte_idx, power(2, ceil(log2(count(*))))::BIGINT AS n FROM se GROUP BY ALL),
bi AS (SELECT can_id, byte_idx, n, unnest(range(0, n // 2 + 1)) AS i FROM sz), fo AS (SELECT can_id, byte_idx, n, i, sqrt(power(sum(v * cos(2 * pi() * ((i * k) % n) / n)), 2) + power(sum(v * sin(2 * pi() * ((i * k) % n) / n)), 2)) / n * CASE WHEN i = 0 THEN 0.5 ELSE 1 END AS mag FROM bi JOIN se USING (can_id, byte_idx) GROUP BY can_id, byte_idx, n, i),
pk AS (SELECT *, lag(mag) OVER w AS lo, lead(mag) OVER w AS hi, max(mag) OVER (PARTITION BY can_id, byte_idx) AS top FROM fo WINDOW w AS (PARTITION BY can_id, byte_idx ORDER BY i)), rk AS (SELECT *, row_number() OVER (PARTITION BY can_id, byte_idx ORDER BY mag DESC, i) AS rn FROM pk WHERE i BETWEEN 1 AND n // 2 - 1 AND mag >= lo AND mag >= hi AND mag > 0.15 * top AND top > 1e-9)
SELECT can_id, byte_idx, i AS bin, round(n / i, 6) AS period, round(mag, 6) AS magnitude FROM rk WHERE rn <= 10"""))
add("m23_granger", lambda f: M.granger(series(f)))
add("m24_change_points", lambda f: M.series_changes(series(f)))
add("m25_boosted_stumps", lambda f: M.boosted_stumps(flat(f), X, "y"))
add("m26_network", lambda f: M.network_predictions(flat(f), X, "y"))
add("m27_flag_classifier", lambda f: M.flag_classifier(P.byte_features(f), F.col("byte_idx").isin(0, 5)))
add("a11_merged_signals", lambda f: M.merged_signals(P.byte_role(f)), sql(f"""{ENT}, {PREV}, cs AS (SELECT can_id, byte_idx, avg(CASE WHEN (prev + 1) % 256 = byte_val THEN 1.0 ELSE 0 END) AS c FROM prv WHERE prev IS NOT NULL GROUP BY ALL),
x AS (SELECT can_id, data, list_reduce(data, lambda a, b: xor(a, b)) AS ax FROM fr WHERE len(data) > 1), y AS (SELECT can_id, ax, unnest(range(0, len(data))) AS byte_idx, unnest(data) AS v FROM x), xs AS (SELECT can_id, byte_idx, avg(CASE WHEN xor(ax, v) = v THEN 1.0 ELSE 0 END) >= 0.85 AS k FROM y GROUP BY ALL),
ro AS (SELECT vt.can_id, vt.byte_idx, entropy, CASE WHEN distinct_vals = 1 THEN 'CONST' WHEN coalesce(c, 0) >= 0.8 THEN 'COUNTER' WHEN coalesce(k, false) THEN 'CHECKSUM' WHEN distinct_vals = 2 THEN 'TOGGLE' WHEN distinct_vals <= 8 AND entropy < 3 THEN 'ENUM' ELSE 'VALUE' END AS role FROM vt LEFT JOIN cs USING (can_id, byte_idx) LEFT JOIN xs USING (can_id, byte_idx)),
wi AS (SELECT *, role = 'VALUE' AND entropy > 3 AS wide FROM ro), gr AS (SELECT *, sum(CASE WHEN wide THEN 0 ELSE 1 END) OVER (PARTITION BY can_id ORDER BY byte_idx) AS g FROM wi), nu AS (SELECT *, row_number() OVER (PARTITION BY can_id, g, wide ORDER BY byte_idx) AS n, count(*) OVER (PARTITION BY can_id, g, wide) AS m FROM gr)
SELECT can_id, role || '_' || byte_idx AS sig_name, byte_idx * 8 AS start_bit, CASE WHEN wide AND n < m THEN 16 ELSE 8 END AS length FROM nu WHERE role <> 'CONST' AND NOT (wide AND n % 2 = 0)"""))
add("k04_pcap_files", lambda f: B.session_digests(f, B.encode_pcap).drop("sha256"), sql("SELECT session_id, 24 + 32 * count(*) AS size FROM fr GROUP BY session_id"))
add("k05_mcan_files", lambda f: B.session_digests(f).drop("sha256"), sql("SELECT session_id, (8 + 14 * count(*) + sum(dlc))::BIGINT AS size FROM fr GROUP BY session_id"))
add("s03_mcan_round_trip", lambda f: B.session_files(f).select(F.posexplode(F.udf(lambda c: [(r[2], r[3], r[11]) for r in B.decode_mcan(bytes(c))], "array<struct<ts_us: long, can_id: long, dlc: long>>")("content")).alias("pos", "r")).select("r.*"), sql("SELECT ts_us, can_id, dlc FROM fr"))
add("s04_zstd_round_trip", lambda f: B.session_files(f, B.encode_mcan_zstd).select(F.posexplode(F.udf(lambda c: [(r[2], r[3], r[11]) for r in B.decode_mcan(bytes(c))], "array<struct<ts_us: long, can_id: long, dlc: long>>")("content")).alias("pos", "r")).select("r.*"), sql("SELECT ts_us, can_id, dlc FROM fr"))
add("k06_compressed_files", lambda f: B.session_files(f.withColumn("session_id", F.expr("ts_us div 3600000000")), B.encode_mcan_zstd).select("session_id", (F.hex(F.substring("content", 1, 4)) == "28B52FFD").alias("packed")), sql("SELECT ts_us // 3600000000 AS session_id, 8 + 14 * count(*) + sum(dlc) >= 512 AS packed FROM fr GROUP BY ALL"))

def models_back(f: DataFrame) -> DataFrame:
    """The models that the JSON of a variable holds."""
    texts = J.model_json(L.linear_models(L.long_bytes_of_frames(f, "k", byte_at(3).cast("double"))))
    read = F.from_json("json", "variable string, models array<struct<key: long, slope: double, intercept: double, r: double>>")
    return texts.select(read.alias("d")).select("d.variable", F.inline("d.models")).withColumn("intercept", F.round("intercept", 6) + 0.0)


def rules_back(f: DataFrame) -> DataFrame:
    """The rules that completions hold: one for each flag bit, the true scale and offset of byte 1 where that isn't flags."""
    truth = f.select("can_id").distinct().select("can_id", F.lit(1).alias("byte_idx"), F.lit(0.5).alias("scale"), F.lit(-2.0).alias("offset"))
    read = F.from_json("completion", "can_id long, rules array<struct<byte_idx: int, bit_mask: long, scale: double, offset: double>>")
    return J.training_rows(P.flag_bits(f, 0.3), truth).select(read.alias("d")).select("d.can_id", F.inline("d.rules"))


r("k15_model_json", models_back, sql(f"{LINES} SELECT 'k' AS variable, can_id * 256 + byte_idx AS key, round(slope, 6) AS slope, round(intercept, 6) + 0.0 AS intercept, round(c, 6) AS r FROM ln WHERE sx >= 1e-9 AND abs(c) >= 0.8"))
r("k18_training_rows", rules_back, sql(f"""{PREV}, g AS (SELECT can_id, byte_idx, bit_or(byte_val) & bit_or(255 - byte_val) AS mask, count(*) FILTER (byte_val <> prev) AS changes, count(*) FILTER (byte_val <> prev AND abs(byte_val - prev) > 3) AS jumps FROM prv GROUP BY ALL), v AS (SELECT * FROM g WHERE bit_count(mask) BETWEEN 2 AND 6 AND changes > 0 AND jumps >= 0.3 * changes), x AS (SELECT can_id, byte_idx, mask, unnest(range(0, 8)) AS bit FROM v)
SELECT can_id, byte_idx::INT AS byte_idx, (1 << bit)::BIGINT AS bit_mask, NULL::DOUBLE AS scale, NULL::DOUBLE AS "offset" FROM x WHERE mask & (1 << bit) <> 0 UNION ALL SELECT DISTINCT can_id, 1, NULL, 0.5, -2.0 FROM fr WHERE can_id NOT IN (SELECT can_id FROM v WHERE byte_idx = 1)"""))
add("k10_publish_messages", lambda f: J.publish_messages(S.run_fold(f.select("frame_id", "can_id", "ts_us", byte_at(1).cast("double").alias("value")), ["can_id"], ["ts_us", "frame_id"], S.dead_band(50.0), "can_id long, ts_us long, value double")), recursive(f"""{STEPS}, st AS (SELECT can_id, ts_us, rn, x AS held, true AS ok FROM nu WHERE rn = 1
UNION ALL SELECT n.can_id, n.ts_us, n.rn, CASE WHEN abs(n.x - s.held) < 50 THEN s.held ELSE n.x END, abs(n.x - s.held) >= 50 FROM st s JOIN nu n ON n.can_id = s.can_id AND n.rn = s.rn + 1) SELECT 'can/' || lower(to_hex(can_id)) AS topic, '{{"value":' || held::VARCHAR || ',"unit":"","timestamp":' || ts_us || '}}' AS payload FROM st WHERE ok"""))
add("s15_synthetic_traffic", lambda f: P.byte_role(J.synthetic_frames(f.sparkSession, 7, 4000)).select("can_id", "byte_idx", "role"), "SELECT i AS can_id, j::INT AS byte_idx, (['COUNTER', 'VALUE', 'TOGGLE', 'ENUM', 'VALUE', 'CONST', 'CONST', 'CONST'])[j + 1] AS role FROM (SELECT unnest(range(256, 264)) AS i), (SELECT unnest(range(0, 8)) AS j)")
add("t16_observer", lambda f: R.merge_observed(R.observe(f.filter("session_id = 0")), R.observe(f.filter("session_id = 1"))), sql("SELECT can_id, byte_idx, bit_or(byte_val) AS seen1, bit_or(255 - byte_val) AS seen0, count(*) AS samples FROM by_ GROUP BY ALL"))


def _echo(host, can_id, data, ts) -> None:
    if can_id == 260 and data[0] == 3:
        host.send_frame(can_id + 1, data[:2])
    if can_id == 261 and len(data) < 8:
        host.log(f"short {len(data)}")


add("e01_frame_script", lambda f: E.on_frame(f, _echo).select("frame_id", "kind", "out_id", "text"), sql("SELECT frame_id, 'frame' AS kind, 261::BIGINT AS out_id, NULL::VARCHAR AS text FROM fr WHERE can_id = 260 AND b0 = 3 UNION ALL SELECT frame_id, 'log', NULL, 'short ' || dlc FROM fr WHERE can_id = 261 AND dlc < 8"))
add("q10_tools_get_ids", lambda f: E.Tools(f).call("get_ids"), sql("SELECT can_id, count(*) AS frames, max(ts_us) AS last_us FROM fr GROUP BY can_id"))
