"""Association mining, with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from framequarry.operators import learn as L
from framequarry.operators import windows as W
from framequarry.plans.profile import HOUR, PREV, WFEAT, r, rounded
from framequarry.plans.registry import add_tables
from framequarry.schema import sql

B = lambda i: F.get("data", F.lit(i)).cast("double")
AROUND = HOUR // 2


def obs(f):
    return L.observations(f, "k", 40, B(3)).unionByName(L.observations(f, "v", 50, B(1) + B(2)))


def ob(f):
    return L.observation_bytes(f, obs(f), AROUND, AROUND)


OBS = "os AS (SELECT 'k' AS variable, frame_id AS obs_id, ts_us, b3::DOUBLE AS value FROM fr WHERE frame_id % 40 = 0 UNION ALL SELECT 'v', frame_id, ts_us, (b1 + b2)::DOUBLE FROM fr WHERE frame_id % 50 = 0)"
OBY = OBS + f""", og AS (SELECT variable, obs_id, value, fr.can_id, {', '.join(f'floor(sum(CASE WHEN dlc > {i} THEN b{i} ELSE 0 END) / count(*))::INT AS a{i}' for i in range(8))} FROM os JOIN fr ON fr.ts_us BETWEEN os.ts_us - {AROUND} AND os.ts_us + {AROUND} GROUP BY ALL),
oy AS (SELECT variable, obs_id, value, can_id, unnest(range(0, 8))::INT AS byte_idx, unnest([{', '.join(f'a{i}' for i in range(8))}]) AS avg_byte FROM og)"""
PEAR = "CASE WHEN count(*) < 3 OR stddev_pop({x}) < 1e-9 OR stddev_pop({y}) < 1e-9 THEN 0 ELSE round(corr({x}, {y}), 6) END"
r("m01_observations", ob, sql(f"{OBY} SELECT * FROM oy"))
r("j13_frequent_ids", lambda f: L.frequent_ids(ob(f)), sql(f"{OBY}, n AS (SELECT variable, count(DISTINCT obs_id) AS n FROM oy GROUP BY variable) SELECT variable, can_id FROM oy JOIN n USING (variable) GROUP BY variable, can_id, n HAVING count(DISTINCT obs_id) >= greatest(3, n // 2)"))
r("m05_byte_correlations", lambda f: L.byte_correlations(ob(f)), sql(f"{OBY} SELECT variable, can_id, byte_idx, count(*) AS n, {PEAR.format(x='avg_byte', y='value')} AS r FROM oy GROUP BY ALL"))
NOISY = f"{PREV}, ni AS (SELECT can_id, byte_idx FROM prv WHERE prev IS NOT NULL GROUP BY ALL HAVING count(*) > 4 AND count(*) FILTER (byte_val <> prev) > 0.8 * count(*) AND count(*) FILTER (abs(byte_val - prev) IN (1, 255)) > 0.9 * count(*) FILTER (byte_val <> prev)), nc AS (SELECT can_id, byte_idx FROM prv WHERE prev IS NOT NULL GROUP BY ALL HAVING count(*) >= 4 AND greatest({', '.join(f'count(*) FILTER (xor(byte_val, prev) & {1 << i} <> 0)' for i in range(8))}) > 0.4 * count(*))"
r("m05_usable_correlations", lambda f: L.byte_correlations(L.usable(ob(f), f)), sql(f"{OBY}, {NOISY}, n AS (SELECT variable, count(DISTINCT obs_id) AS n FROM oy GROUP BY variable), q AS (SELECT variable, can_id FROM oy JOIN n USING (variable) GROUP BY variable, can_id, n HAVING count(DISTINCT obs_id) >= greatest(3, n // 2)) SELECT variable, can_id, byte_idx, count(*) AS n, {PEAR.format(x='avg_byte', y='value')} AS r FROM oy JOIN q USING (variable, can_id) WHERE (can_id, byte_idx) NOT IN (SELECT * FROM ni) AND (can_id, byte_idx) NOT IN (SELECT * FROM nc) GROUP BY ALL"))
r("m06_online_correlations", lambda f: L.online_correlations(ob(f)), sql(f"{OBY} SELECT variable, can_id, byte_idx, count(*) AS n, {PEAR.format(x='avg_byte', y='value')} AS r FROM oy GROUP BY ALL"))
r("m07_cross_bytes", lambda f: L.cross_bytes(ob(f).filter("variable = 'k'")), sql(f"{OBY}, a AS (SELECT * FROM oy WHERE variable = 'k') SELECT a.variable, a.can_id, a.byte_idx, b.can_id AS id2, b.byte_idx AS byte2, count(*) AS n, round(corr(a.avg_byte, b.avg_byte), 6) AS r FROM a JOIN a b USING (variable, obs_id) GROUP BY ALL HAVING count(*) >= 3 AND var_pop(a.avg_byte) >= 1e-9 AND var_pop(b.avg_byte) >= 1e-9"))
r("j14_byte_pairs", lambda f: L.cross_bytes(ob(f).filter("variable = 'v'")).select("can_id", "byte_idx", "id2", "byte2", "n"), sql(f"{OBY}, a AS (SELECT * FROM oy WHERE variable = 'v') SELECT a.can_id, a.byte_idx, b.can_id AS id2, b.byte_idx AS byte2, count(*) AS n FROM a JOIN a b USING (variable, obs_id) GROUP BY ALL HAVING count(*) >= 3 AND var_pop(a.avg_byte) >= 1e-9 AND var_pop(b.avg_byte) >= 1e-9"))
r("m08_variable_matrix", lambda f: L.variable_matrix(obs(f)), sql(f"{OBS}, k AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY ts_us, obs_id) AS k FROM os) SELECT a.variable, b.variable AS variable2, count(*) AS n, {PEAR.format(x='a.value', y='b.value')} AS r FROM k a JOIN k b USING (k) GROUP BY ALL"))
r("m09_discovery", lambda f: L.discover(L.long_bytes_of_frames(f, "k", B(3)), f, 24 * HOUR), sql(f"z AS (SELECT by_.can_id, byte_idx::INT AS byte_idx, byte_val, b3::DOUBLE AS value FROM by_ JOIN fr USING (frame_id)), l AS (SELECT DISTINCT can_id FROM fr WHERE ts_us >= (SELECT max(ts_us) FROM fr) - {24 * HOUR}), c AS (SELECT 'k' AS variable, can_id, byte_idx, count(*) AS n, {PEAR.format(x='byte_val', y='value')} AS r FROM z WHERE can_id IN (SELECT can_id FROM l) GROUP BY ALL) SELECT * FROM c WHERE n >= 5 AND abs(r) >= 0.5"))


def mi_sql(g: str) -> str:
    return f"""bi AS (SELECT *, least({g} - 1, floor((avg_byte - min(avg_byte) OVER w) / (max(avg_byte) OVER w - min(avg_byte) OVER w + 1e-9) * {g})) AS i, least({g} - 1, floor((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w + 1e-9) * {g})) AS j FROM gr WINDOW w AS (PARTITION BY variable, can_id, byte_idx, g)),
jo AS (SELECT variable, can_id, byte_idx, g, i, j, count(*) AS c FROM bi GROUP BY ALL), jp AS (SELECT *, sum(c) OVER (PARTITION BY variable, can_id, byte_idx, g) AS t, sum(c) OVER (PARTITION BY variable, can_id, byte_idx, g, i) AS ci, sum(c) OVER (PARTITION BY variable, can_id, byte_idx, g, j) AS cj FROM jo),
mi AS (SELECT variable, can_id, byte_idx, g, sum(c)::BIGINT AS n, sum(c / t * ln((c / t) / ((ci / t) * (cj / t)))) AS mi FROM jp GROUP BY ALL)"""


r("m10_mutual_information", lambda f: L.mutual_information(ob(f)), sql(f"{OBY}, gr AS (SELECT *, 10 AS g FROM oy), {mi_sql('10')} SELECT variable, can_id, byte_idx, n, round(mi, 6) AS mi FROM mi"))
r("m11_maximal_information", lambda f: L.maximal_information(ob(f)), sql(f"{OBY}, gr AS (SELECT *, unnest(range(2, 9)) AS g FROM oy), {mi_sql('g')} SELECT variable, can_id, byte_idx, max(n) AS n, round(max(mi / ln(g)), 6) AS mic FROM mi GROUP BY ALL"))
SELF = "z AS (SELECT by_.can_id, byte_idx::INT AS byte_idx, byte_val, (b1 * 2 + b3 * 0.01)::DOUBLE AS value FROM by_ JOIN fr USING (frame_id)), lm AS (SELECT 'k' AS variable, can_id, byte_idx, count(*) AS n, CASE WHEN stddev_pop(byte_val) < 1e-9 THEN 0 ELSE corr(byte_val, value) END AS r, regr_slope(value, byte_val) AS slope, regr_intercept(value, byte_val) AS intercept FROM z GROUP BY ALL)"
self_models = lambda f: L.linear_models(L.long_bytes_of_frames(f, "k", B(1) * 2 + B(3) * 0.01))
r("m12_linear_models", self_models, sql(f"{SELF} SELECT variable, can_id, byte_idx, n, round(r, 6) AS r, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM lm WHERE abs(r) >= 0.8"))
r("m12_predict", lambda f: L.predict(self_models(f), f).select("can_id", "byte_idx", "predicted"), sql(f"{SELF}, la AS (SELECT can_id, arg_max(data, frame_id) AS d FROM fr GROUP BY can_id) SELECT can_id, byte_idx, round(slope * coalesce(d[byte_idx + 1], 0) + intercept, 6) AS predicted FROM lm JOIN la USING (can_id) WHERE abs(r) >= 0.8"))
r("j16_latest_frames", lambda f: f.groupBy("can_id").agg(F.max_by("data", F.struct("ts_us", "frame_id")).alias("d")).select("can_id", F.array_join(F.col("d").cast("array<string>"), ",").alias("data")), sql("SELECT can_id, array_to_string(arg_max(data, frame_id), ',') AS data FROM fr GROUP BY can_id"))


def waved(f):
    """Frames whose byte 1 rises and falls in 111 hours, so that lagged bytes relate to what is observed."""
    wave = F.abs(F.expr("(ts_us div 1000000000) % 400") - 200)
    return f.withColumn("data", F.transform("data", lambda x, i: F.when(i == 1, wave.cast("short")).otherwise(x)))


WAVED = "fs AS (SELECT * REPLACE (abs((ts_us // 1000000000) % 400 - 200) AS b1) FROM fr), " + OBY.replace("FROM fr", "FROM fs").replace("JOIN fr ON fr.ts_us", "JOIN fs fr ON fr.ts_us")
r("w23_lag_correlations", lambda f: L.lag_correlations(ob(waved(f))), sql(f"""{WAVED}, o AS (SELECT DISTINCT variable, obs_id, value FROM oy), k AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY obs_id) AS k FROM o), c AS (SELECT DISTINCT variable, can_id, byte_idx FROM oy),
x AS (SELECT c.variable, c.can_id, c.byte_idx, k.k, coalesce(oy.avg_byte, 0) AS x FROM c JOIN k USING (variable) LEFT JOIN oy ON oy.variable = c.variable AND oy.obs_id = k.obs_id AND oy.can_id = c.can_id AND oy.byte_idx = c.byte_idx), s AS (SELECT *, unnest(range(-10, 11)) AS lag FROM x), g AS (SELECT s.variable, can_id, byte_idx, lag, count(*) AS n, {PEAR.format(x='x', y='k.value')} AS r FROM s JOIN k ON k.variable = s.variable AND k.k = s.k + s.lag GROUP BY ALL)
SELECT variable, can_id, byte_idx, lag::INT AS byte_leads_by, n, r FROM g WHERE n >= 5 AND abs(r) > 0.3"""))
r("x18_weighted_pearson", lambda f: L.weighted_pearson(L.long_bytes_of_frames(f, "k", B(3)), 1e-6, F.lit(1_706_659_200_000_000)), sql("z AS (SELECT by_.can_id, byte_idx::INT AS byte_idx, byte_val::DOUBLE AS x, b3::DOUBLE AS y, exp(-1e-6 * (1706659200000000 - fr.ts_us) / 1e6) AS w FROM by_ JOIN fr USING (frame_id)), s AS (SELECT can_id, byte_idx, count(*) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * x) / sum(w) AS xx, sum(w * y * y) / sum(w) AS yy, sum(w * x * y) / sum(w) AS xy FROM z GROUP BY ALL) SELECT 'k' AS variable, can_id, byte_idx, n, CASE WHEN n < 3 OR xx - mx * mx < 1e-9 OR yy - my * my < 1e-9 THEN 0 ELSE round((xy - mx * my) / sqrt((xx - mx * mx) * (yy - my * my)), 6) END AS r FROM s"))


def events(f):
    return f.filter("error").select(F.col("frame_id").alias("event_id"), (F.col("frame_id") % 16 == 0).alias("label"), F.col("ts_us").alias("at_us"))


SPAN = (4 * HOUR, HOUR)


EV = f"en AS (SELECT e.frame_id AS event_id, e.frame_id % 16 = 0 AS label, fr.* FROM fr e JOIN fr ON e.error AND fr.ts_us BETWEEN e.ts_us - {4 * HOUR} AND e.ts_us + {HOUR}), ev AS (SELECT * FROM en QUALIFY count(*) OVER (PARTITION BY event_id) >= 3)"
FEAT = EV + f", eg AS (SELECT *, (ts_us - lag(ts_us) OVER (PARTITION BY event_id, can_id ORDER BY ts_us, frame_id)) / 1000 AS gap FROM ev), ef AS (SELECT event_id, label, can_id, [count(*)::DOUBLE, coalesce(avg(gap), 0), coalesce(stddev_pop(gap), 0), {', '.join(f'avg(CASE WHEN dlc > {i} THEN b{i} ELSE 0 END) / 255' for i in range(8))}] AS vec FROM eg GROUP BY ALL)"
r("m02_event_frames", lambda f: L.event_frames(f.select("ts_us", "frame_id"), events(f), *SPAN).select("event_id", "label", "frame_id"), sql(f"{EV} SELECT event_id, label, frame_id FROM ev"))
r("m02_adaptive_window", L.adaptive_window, sql("w AS (SELECT least(2e6, greatest(1e5, 3 * (max(ts_us) - min(ts_us)) / (count(*) - 1)))::BIGINT AS before_us FROM fr) SELECT before_us, before_us // 3 AS after_us FROM w"))
r("m03_event_features", lambda f: L.event_features(f, events(f), *SPAN).select("event_id", "can_id", *(F.get("vec", F.lit(i)).alias(f"f{i}") for i in range(11))), sql(f"{FEAT} SELECT event_id, can_id, {', '.join(f'round(vec[{i + 1}], 6) AS f{i}' for i in range(11))} FROM ef"))
COS = "list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec)))"
r("m04_candidates", lambda f: L.candidates(L.event_features(f, events(f), *SPAN)), sql(f"{FEAT}, ps AS (SELECT * FROM ef WHERE label AND can_id IN (SELECT can_id FROM ef WHERE label GROUP BY can_id HAVING count(DISTINCT event_id) = (SELECT count(DISTINCT event_id) FROM ef WHERE label))), sa AS (SELECT a.can_id, avg({COS}) AS same FROM ps a JOIN ps b ON a.can_id = b.can_id AND a.event_id < b.event_id GROUP BY ALL), di AS (SELECT a.can_id, avg({COS}) AS diff FROM ps a JOIN ef b ON a.can_id = b.can_id AND NOT b.label GROUP BY ALL) SELECT can_id, round(same, 6) AS same, round(diff, 6) AS diff, round(same * (1 - 0.5 * coalesce(diff, 0)), 6) AS score FROM sa LEFT JOIN di USING (can_id)"))
r("w21_sequences", lambda f: L.sequences(f, events(f), *SPAN, 2), sql(f"{EV}, g AS (SELECT upper(to_hex(can_id)) || '→' || upper(to_hex(lead(can_id) OVER (PARTITION BY event_id ORDER BY ts_us, frame_id))) AS seq FROM ev) SELECT seq, count(*) AS n, round(count(*) / (SELECT count(DISTINCT event_id) FROM ev), 6) AS confidence FROM g WHERE seq IS NOT NULL GROUP BY seq"))
r("m14_anomaly_score", lambda f: L.anomaly_score(W.window_features(f, 2 * HOUR), L.normal_model(W.window_features(f, 2 * HOUR))), sql(f"{WFEAT}, m AS (SELECT avg(frames) AS a1, stddev_pop(frames) AS s1, avg(ids) AS a2, stddev_pop(ids) AS s2, avg(entropy) AS a3, stddev_pop(entropy) AS s3, avg(duration_ms) AS a4, stddev_pop(duration_ms) AS s4 FROM wx) SELECT win, round(power((frames - a1) / s1, 2) + power((ids - a2) / s2, 2) + power((entropy - a3) / s3, 2) + power((duration_ms - a4) / s4, 2), 6) AS score FROM wx, m"))
r("x19_cosine_matrix", lambda f: L.matrix_cosine(L.byte_means(f)), sql(f"v AS (SELECT can_id, [{', '.join(f'avg(CASE WHEN dlc > {i} THEN b{i} ELSE 0 END)' for i in range(8))}] AS vec FROM fr GROUP BY can_id) SELECT a.can_id, b.can_id AS id2, round({COS}, 6) AS cosine FROM v a, v b"))
r("m30_batch_cosine", lambda f: L.matrix_cosine(L.byte_means(f)).groupBy("can_id").agg(F.avg("cosine").alias("mean_cosine")), sql(f"v AS (SELECT can_id, [{', '.join(f'avg(CASE WHEN dlc > {i} THEN b{i} ELSE 0 END)' for i in range(8))}] AS vec FROM fr GROUP BY can_id) SELECT a.can_id, round(avg({COS}), 6) AS mean_cosine FROM v a, v b GROUP BY ALL"))
r("m29_mask_accuracy", lambda f: L.mask_accuracy(f.select("can_id", F.lit(0).alias("byte_idx"), (F.col("frame_id") % 8).alias("bit"), (F.col("frame_id") % 8 < F.col("can_id") % 9).alias("truth"), (F.col("frame_id") % 8 < F.col("can_id") % 7).alias("predicted")).distinct()), sql("b AS (SELECT DISTINCT can_id, frame_id % 8 AS bit FROM fr), m AS (SELECT can_id, bit_or(CASE WHEN bit < can_id % 9 THEN 1 << bit ELSE 0 END) AS t, bit_or(CASE WHEN bit < can_id % 7 THEN 1 << bit ELSE 0 END) AS p, count(*) AS n FROM b GROUP BY can_id) SELECT CASE WHEN bit_count(t) = n THEN 'pure' ELSE 'mixed' END AS kind, count(*) AS n, count(*) FILTER (t = p) AS exact FROM m WHERE t <> 0 GROUP BY ALL"))
add_tables("x22_json_helpers", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object(L.fenced_json(F.concat(F.lit("say\n```json\n"), "props", F.lit("\n``` done"))), "$.k").cast("long").alias("k")), "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
add_tables("j17_nearest_vectors", lambda s, d: rounded(L.nearest(v := s.read.parquet(f"{d}/embeddings.parquet"), v.filter("vec_id % 100 = 0"), 6).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank")), 6), "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings), s AS (SELECT b.vec_id AS query_id, a.vec_id, round(" + COS + ", 6) AS c FROM v a JOIN v b ON b.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), k AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s) SELECT * FROM k WHERE rank <= 6")
