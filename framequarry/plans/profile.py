"""Per-identifier and sequential analytics, with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.operators import profile as P
from framequarry.operators import windows as W
from framequarry.operators.store import id_frequency
from framequarry.plans.registry import add
from framequarry.schema import sql

HOUR = 3_600_000_000


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, to compare with another engine's sums."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r(name: str, plan, oracle: str | None = None, digits: int = 6) -> None:
    add(name, lambda f: rounded(plan(f), digits), oracle)


PREV = "prv AS (SELECT *, lag(byte_val) OVER (PARTITION BY can_id, byte_idx ORDER BY ts_us, frame_id) AS prev FROM by_)"
GAP = "gp AS (SELECT *, lag(ts_us) OVER (PARTITION BY can_id ORDER BY ts_us, frame_id) AS pt, row_number() OVER (PARTITION BY can_id ORDER BY ts_us, frame_id) AS rn FROM fr)"
ENT = "vc AS (SELECT can_id, byte_idx, byte_val, count(*) AS n FROM by_ GROUP BY ALL), vt AS (SELECT can_id, byte_idx, min(byte_val) AS min_val, max(byte_val) AS max_val, count(*) AS distinct_vals, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM vc GROUP BY ALL)"

r("a01_id_profile", P.id_profile, sql(f"""{GAP}, i AS (SELECT can_id, count(*) AS frames, min(ts_us) AS first_us, max(ts_us) AS last_us, coalesce(min(CASE WHEN pt IS NOT NULL THEN greatest(0, ts_us - pt) END) / 1e6, 0) AS min_gap_s,
  coalesce(max(CASE WHEN pt IS NOT NULL THEN greatest(0, ts_us - pt) END) / 1e6, 0) AS max_gap_s, coalesce(avg(CASE WHEN pt IS NOT NULL THEN greatest(0, ts_us - pt) END) / 1e6, 0) AS avg_gap_s, max(dlc) AS max_dlc FROM gp GROUP BY can_id)
SELECT can_id, frames, first_us, last_us, round(min_gap_s, 6) AS min_gap_s, round(max_gap_s, 6) AS max_gap_s, round(avg_gap_s, 6) AS avg_gap_s, 0::BIGINT AS n_fd, 0::BIGINT AS n_brs, 0::BIGINT AS n_esi, max_dlc, round(CASE WHEN avg_gap_s = 0 THEN 0 ELSE 1 / avg_gap_s END, 6) AS hz FROM i"""))
r("a01_byte_profile", P.byte_profile, sql("n AS (SELECT can_id, count(*) AS frames FROM fr GROUP BY can_id) SELECT can_id, byte_idx, min(byte_val) AS min_val, max(byte_val) AS max_val, round(sum(byte_val) / any_value(frames), 6) AS avg_val FROM by_ JOIN n USING (can_id) GROUP BY can_id, byte_idx"))
r("a02_interval_stats", P.interval_stats, sql("""h AS (SELECT *, max(ts_us) OVER (PARTITION BY can_id ORDER BY ts_us, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM fr),
k AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY can_id ORDER BY ts_us, frame_id) AS iv FROM h WHERE high IS NULL OR ts_us > high),
m AS (SELECT *, avg(iv) OVER (PARTITION BY can_id ORDER BY ts_us, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rm FROM k),
a AS (SELECT can_id, count(iv) AS intervals, coalesce(avg(iv) / 1e6, 0) AS mean_s, coalesce(stddev_samp(iv / 1e6), 0) AS sd_s, coalesce(min(iv) / 1e6, 0) AS min_s, coalesce(max(iv) / 1e6, 0) AS max_s, sum(CASE WHEN iv > 3 * rm THEN 1 ELSE 0 END)::BIGINT AS gaps FROM m GROUP BY can_id)
SELECT can_id, intervals, round(mean_s, 6) AS mean_s, round(sd_s, 6) AS sd_s, round(min_s, 6) AS min_s, round(max_s, 6) AS max_s, gaps, intervals >= 3 AND mean_s > 0 AND sd_s < 0.2 * mean_s AS periodic FROM a"""))
r("a03_bit_profile", P.bit_profile, sql("b AS (SELECT can_id, byte_idx, bit_and(byte_val) AS ones, bit_and(255 - byte_val) AS zeros FROM by_ GROUP BY ALL) SELECT *, 255 - (ones | zeros) AS varying FROM b"))
r("a04_error_classes", P.error_counts, sql("c AS (SELECT *, CASE WHEN can_id & 1 <> 0 THEN 'TxTimeout' WHEN can_id & 2 <> 0 THEN 'LostArbitration' WHEN can_id & 4 <> 0 THEN 'Controller' WHEN can_id & 8 <> 0 THEN 'Protocol' WHEN can_id & 16 <> 0 THEN 'Transceiver' WHEN can_id & 32 <> 0 THEN 'Ack' WHEN can_id & 64 <> 0 THEN 'BusOff' WHEN can_id & 128 <> 0 THEN 'BusError' WHEN can_id & 256 <> 0 THEN 'Restarted' ELSE 'Unknown' END AS class FROM fr WHERE error) SELECT class, count(*) AS n, bool_or(can_id & 64 <> 0) AS bus_off FROM c GROUP BY class"))
r("a05_byte_ranges", P.byte_ranges, sql("n AS (SELECT can_id, count(*) AS frames, max(dlc) AS max_dlc FROM fr GROUP BY can_id) SELECT can_id, byte_idx, min(byte_val) AS min_val, max(byte_val) AS max_val, any_value(frames) AS frames, any_value(max_dlc) AS max_dlc FROM by_ JOIN n USING (can_id) GROUP BY can_id, byte_idx"))
r("a07_id_frequency", id_frequency, sql("SELECT can_id, count(*) AS frames, round(CASE WHEN count(*) > 1 THEN (max(ts_us) - min(ts_us)) / 1e6 / (count(*) - 1) ELSE 0 END, 6) AS mean_interval_s FROM fr GROUP BY can_id"))
r("a08_dashboard", P.dashboard, sql("SELECT count(*) AS frames, sum(dlc)::BIGINT AS bytes, count(DISTINCT can_id) AS ids, count(*) FILTER (error) AS errors, round(avg(dlc * 8 + 47.0), 6) AS avg_bits FROM fr"))
r("a08_dlc_histogram", P.dlc_histogram, sql("x AS (SELECT unnest(range(0, 65)) AS dlc), n AS (SELECT dlc, count(*) AS n FROM fr GROUP BY dlc) SELECT x.dlc, coalesce(n.n, 0) AS n FROM x LEFT JOIN n USING (dlc)"))
r("a09_byte_entropy", P.byte_entropy, sql(f"{ENT} SELECT can_id, byte_idx, min_val, max_val, distinct_vals, round(entropy, 6) AS entropy FROM vt"))
r("a10_counter_share", P.counter_share, sql(f"{PREV} SELECT can_id, byte_idx, round(avg(CASE WHEN (prev + 1) % 256 = byte_val THEN 1.0 ELSE 0 END), 6) AS counter_share FROM prv WHERE prev IS NOT NULL GROUP BY ALL"))
r("a10_checksum_share", P.checksum_share, sql("""x AS (SELECT can_id, data, list_reduce(data, lambda a, b: xor(a, b)) AS ax FROM fr WHERE len(data) > 1), y AS (SELECT can_id, ax, unnest(range(0, len(data))) AS byte_idx, unnest(data) AS v FROM x)
SELECT can_id, byte_idx, round(avg(CASE WHEN xor(ax, v) = v THEN 1.0 ELSE 0 END), 6) AS xor_share, avg(CASE WHEN xor(ax, v) = v THEN 1.0 ELSE 0 END) >= 0.85 AS is_checksum FROM y GROUP BY ALL"""))
r("a10_median_period", P.median_period, sql(f"{GAP}, q AS (SELECT can_id, list_sort(list(ts_us - pt)) AS l FROM gp WHERE pt IS NOT NULL GROUP BY can_id) SELECT can_id, l[len(l) // 2 + 1] / 1000 AS period_ms FROM q"))
r("a11_byte_role", P.byte_role, sql(f"""{ENT}, {PREV}, cs AS (SELECT can_id, byte_idx, avg(CASE WHEN (prev + 1) % 256 = byte_val THEN 1.0 ELSE 0 END) AS c FROM prv WHERE prev IS NOT NULL GROUP BY ALL),
x AS (SELECT can_id, data, list_reduce(data, lambda a, b: xor(a, b)) AS ax FROM fr WHERE len(data) > 1), y AS (SELECT can_id, ax, unnest(range(0, len(data))) AS byte_idx, unnest(data) AS v FROM x), xs AS (SELECT can_id, byte_idx, avg(CASE WHEN xor(ax, v) = v THEN 1.0 ELSE 0 END) >= 0.85 AS k FROM y GROUP BY ALL)
SELECT vt.can_id, vt.byte_idx, distinct_vals, round(entropy, 6) AS entropy, CASE WHEN distinct_vals = 1 THEN 'CONST' WHEN coalesce(c, 0) >= 0.8 THEN 'COUNTER' WHEN coalesce(k, false) THEN 'CHECKSUM' WHEN distinct_vals = 2 THEN 'TOGGLE' WHEN distinct_vals <= 8 AND entropy < 3 THEN 'ENUM' ELSE 'VALUE' END AS role
FROM vt LEFT JOIN cs USING (can_id, byte_idx) LEFT JOIN xs USING (can_id, byte_idx)"""))
r("a11_message_timing", P.message_timing, sql("""h AS (SELECT *, max(ts_us) OVER (PARTITION BY can_id ORDER BY ts_us, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM fr),
k AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY can_id ORDER BY ts_us, frame_id) AS iv FROM h WHERE high IS NULL OR ts_us > high), s AS (SELECT can_id, avg(iv) / 1e6 AS m, stddev_samp(iv / 1e6) AS sd FROM k GROUP BY can_id), n AS (SELECT can_id, count(*) AS frames FROM fr GROUP BY can_id)
SELECT can_id, frames, CASE WHEN frames < 20 THEN 'SPORADIC' WHEN m > 0 AND sd / m < 0.25 THEN 'PERIODIC' ELSE 'EVENT' END AS timing FROM s JOIN n USING (can_id)"""))
r("a14_flag_bits", P.flag_bits, sql(f"""{PREV}, g AS (SELECT can_id, byte_idx, bit_or(byte_val) & bit_or(255 - byte_val) AS mask, count(*) FILTER (byte_val <> prev) AS changes, count(*) FILTER (byte_val <> prev AND abs(byte_val - prev) > 3) AS jumps, count(*) AS samples FROM prv GROUP BY ALL)
SELECT can_id, byte_idx, changes, jumps, samples, mask, bit_count(mask)::BIGINT AS bits, round(CASE WHEN changes = 0 THEN 0 ELSE jumps / changes END, 6) AS jump_ratio, bit_count(mask) BETWEEN 2 AND 6 AND changes > 0 AND jumps / nullif(changes, 0) >= 0.5 AS is_flags FROM g"""))
r("a14_flag_bits_long_term", lambda f: P.flag_bits(f, 0.3).filter("is_flags").select("can_id", "byte_idx", "mask"), sql(f"{PREV}, g AS (SELECT can_id, byte_idx, bit_or(byte_val) & bit_or(255 - byte_val) AS mask, count(*) FILTER (byte_val <> prev) AS changes, count(*) FILTER (byte_val <> prev AND abs(byte_val - prev) > 3) AS jumps FROM prv GROUP BY ALL) SELECT can_id, byte_idx, mask FROM g WHERE bit_count(mask) BETWEEN 2 AND 6 AND changes > 0 AND jumps >= 0.3 * changes"))
r("a16_byte_features", P.byte_features, sql(f"""{PREV}, {ENT}, g AS (SELECT can_id, byte_idx, bit_count(bit_or(byte_val) & bit_or(255 - byte_val))::BIGINT AS bit_count, count(*) FILTER (abs(byte_val - prev) > 3) AS j, count(*) FILTER (byte_val <> prev) AS c, count(prev) AS p, count(DISTINCT byte_val) / 256 AS distinct_share, coalesce(avg(abs(byte_val - prev)), 0) AS mean_abs_delta,
  coalesce(max(abs(byte_val - prev)), 0)::BIGINT AS max_abs_delta, stddev_pop(byte_val) AS sd, avg(CASE WHEN byte_val = 0 THEN 1.0 ELSE 0 END) AS share_00, avg(CASE WHEN byte_val = 255 THEN 1.0 ELSE 0 END) AS share_ff, stddev_pop(bit_count(byte_val)) AS pop_sd FROM prv GROUP BY ALL)
SELECT can_id, byte_idx, bit_count, round(CASE WHEN c = 0 THEN 0 ELSE j / c END, 6) AS jump_ratio, round(CASE WHEN p = 0 THEN 0 ELSE c / p END, 6) AS change_ratio, round(distinct_share, 6) AS distinct_share, round(mean_abs_delta, 6) AS mean_abs_delta, max_abs_delta, round(sd, 6) AS sd, round(share_00, 6) AS share_00, round(share_ff, 6) AS share_ff, round(pop_sd, 6) AS pop_sd, round(entropy / 8, 6) AS entropy_share FROM g JOIN vt USING (can_id, byte_idx)"""))
r("a17_bit_features", P.bit_features, sql(f"""{PREV}, x AS (SELECT can_id, byte_idx, byte_val, xor(byte_val, prev) AS x FROM prv WHERE prev IS NOT NULL), t AS (SELECT can_id, byte_idx, bit, (x >> bit) & 1 AS t, CASE WHEN bit > 0 THEN (x >> (bit - 1)) & 1 ELSE 0 END AS lo, CASE WHEN bit < 7 THEN (x >> (bit + 1)) & 1 ELSE 0 END AS hi, CASE WHEN bit > 0 AND (x >> (bit - 1)) & 1 = 1 AND (byte_val >> (bit - 1)) & 1 = 0 THEN 1 ELSE 0 END AS fell, (byte_val >> bit) & 1 AS one FROM x, (SELECT unnest(range(0, 8)) AS bit)),
g AS (SELECT can_id, byte_idx, bit, avg(t) AS toggle_rate, avg(one) AS one_share, CASE WHEN sum(t) = 0 THEN 0 ELSE sum(t * lo) / sum(t) END AS with_lower, CASE WHEN sum(t) = 0 THEN 0 ELSE sum(t * hi) / sum(t) END AS with_upper, CASE WHEN sum(fell) = 0 THEN 0 ELSE sum(t * fell) / sum(fell) END AS carry FROM t GROUP BY ALL)
SELECT can_id, byte_idx, bit, round(toggle_rate, 6) AS toggle_rate, round(one_share, 6) AS one_share, round(with_lower, 6) AS with_lower, round(with_upper, 6) AS with_upper, round(carry, 6) AS carry, rank() OVER (PARTITION BY can_id, byte_idx ORDER BY toggle_rate DESC) AS toggle_rank, round(carry - toggle_rate, 6) AS carry_lift, coalesce((toggle_rate <= lag(toggle_rate) OVER (PARTITION BY can_id, byte_idx ORDER BY bit))::BIGINT, 1)::BIGINT AS falls_off FROM g"""))
r("a18_signal_features", P.signal_features, sql(f"""{PREV}, d AS (SELECT *, byte_val - prev AS d FROM prv), e AS (SELECT *, lag(d) OVER (PARTITION BY can_id, byte_idx ORDER BY ts_us, frame_id) AS d0 FROM d)
SELECT can_id, byte_idx, round(count(DISTINCT byte_val) / count(*), 6) AS distinct_share, round(CASE WHEN count(d) = 0 THEN 0 ELSE count(*) FILTER (d = 0) / count(d) END, 6) AS dwell, round(CASE WHEN count(d0) = 0 THEN 0 ELSE count(*) FILTER (d * d0 < 0) / count(d0) END, 6) AS oscillation, round(coalesce(avg(abs(d)) / 255, 0), 6) AS mean_step, round(stddev_pop(byte_val) / 255, 6) AS sd, round((max(byte_val) - min(byte_val)) / 255, 6) AS value_range, round(coalesce(max(abs(d)) / 255, 0), 6) AS max_step FROM e GROUP BY ALL"""))
r("a19_frame_bits", lambda f: f.select("frame_id", P.frame_bits().alias("bits")), sql("SELECT frame_id, 44 + 8 * dlc AS bits FROM fr"))
r("a22_sample_summary", lambda f: P.summary(f, F.get("data", F.lit(1))), sql("SELECT count(b1) AS n, round(avg(b1), 6) AS mean_v, round(stddev_samp(b1), 6) AS sd, round(median(b1), 6) AS median_v, min(b1)::DOUBLE AS min_v, max(b1)::DOUBLE AS max_v FROM fr"))
r("z15_load_formulas", lambda f: P.bus_load_variants(f, HOUR, 500), sql("SELECT ts_us // 3600000000 AS bucket, round(sum(44 + 8 * dlc) / (3600.0 * 500), 6) AS load_exact, round(count(*) * 64 / (3600.0 * 500), 6) AS load_flat, round(sum(dlc * 8 + 47.0) / (3600.0 * 500), 6) AS load_avg FROM fr GROUP BY ALL"))

r("w01_delta", lambda f: W.delta(f).select("frame_id", "delta_us"), sql(f"{GAP} SELECT frame_id, greatest(0, coalesce(ts_us - pt, 0)) AS delta_us FROM gp"))
r("w02_changed_mask", lambda f: W.changed_mask(f).select("frame_id", "changed_mask"), sql("""p AS (SELECT frame_id, data, lag(data) OVER (PARTITION BY can_id ORDER BY ts_us, frame_id) AS prev FROM fr)
SELECT frame_id, CASE WHEN prev IS NULL THEN 0 ELSE list_sum([CASE WHEN coalesce(data[i + 1], 0) <> coalesce(prev[i + 1], 0) THEN 1::BIGINT << i ELSE 0 END FOR i IN range(0, 8)])::BIGINT END AS changed_mask FROM p"""))
r("w03_bursts", lambda f: W.bursts(f, HOUR).select("frame_id", "burst"), sql(f"{GAP} SELECT frame_id, pt IS NOT NULL AND greatest(0, ts_us - pt) < {HOUR} AS burst FROM gp"))
r("w04_bus_load", lambda f: W.bus_load(f, HOUR, 500).select("frame_id", "window_bits", "load"), sql(f"w AS (SELECT frame_id, sum(44 + 8 * dlc) OVER (ORDER BY ts_us RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW)::BIGINT AS window_bits FROM fr) SELECT frame_id, window_bits, round(window_bits / (3600.0 * 500), 6) AS load FROM w"))
r("w04_peak_load", lambda f: W.peak_load(f, HOUR, 500), sql(f"w AS (SELECT ts_us, sum(44 + 8 * dlc) OVER (ORDER BY ts_us RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW) / (3600.0 * 500) AS load FROM fr) SELECT round(max(load), 6) AS peak_load, round(count(*) / ((max(ts_us) - min(ts_us)) / 1e6), 6) AS fps FROM w"))
r("w04_top_loaders", lambda f: W.top_loaders(f, 5, 24 * HOUR), sql(f"SELECT can_id, sum(44 + 8 * dlc)::BIGINT AS bits, count(*) AS frames FROM fr WHERE ts_us >= (SELECT max(ts_us) FROM fr) - {24 * HOUR} GROUP BY can_id ORDER BY bits DESC, can_id LIMIT 5"))
r("w05_trigger_capture", lambda f: W.trigger_capture(f, F.col("error") & (F.get("data", F.lit(1)) > 200), 20, 30).select("frame_id", "phase"), sql("n AS (SELECT *, row_number() OVER (ORDER BY ts_us, frame_id) AS rn FROM fr), h AS (SELECT min(rn) AS hit FROM n WHERE error AND b1 > 200) SELECT frame_id, CASE WHEN rn < hit THEN 'PRE' WHEN rn = hit THEN 'TRIGGER' ELSE 'POST' END AS phase FROM n, h WHERE rn BETWEEN hit - 20 AND hit + 30"))
r("w06_new_ids", W.new_ids, sql(f"{GAP} SELECT can_id, ts_us, frame_id FROM gp WHERE rn = 1"))
r("w07_dlc_changes", lambda f: W.dlc_changes(f).select("frame_id", "dlc", F.col("first_dlc").cast("long").alias("first_dlc")), sql("d AS (SELECT frame_id, dlc, first_value(dlc) OVER (PARTITION BY can_id ORDER BY ts_us, frame_id) AS first_dlc FROM fr) SELECT * FROM d WHERE dlc <> first_dlc"))
r("w09_counter_check", lambda f: W.counter_check(f, 260, 0, 16).groupBy("result").agg(F.count(F.lit(1)).alias("n")), sql("c AS (SELECT b0, lag(b0) OVER (ORDER BY ts_us, frame_id) AS p FROM fr WHERE can_id = 260) SELECT CASE WHEN p IS NULL THEN 'Skip' WHEN b0 = (p + 1) % 16 THEN 'Ok' ELSE 'Mismatch' END AS result, count(*) AS n FROM c GROUP BY ALL"))
r("w10_rate_anomalies", lambda f: W.rate_anomalies(f, 50.0).select("frame_id", "off_percent"), sql("g AS (SELECT *, row_number() OVER w AS rn, lag(ts_us) OVER w AS t1, lag(ts_us, 2) OVER w AS t2 FROM fr WINDOW w AS (PARTITION BY can_id ORDER BY ts_us, frame_id)), b AS (SELECT can_id, 1e6 / avg(ts_us - t1) AS hz FROM g WHERE rn BETWEEN 2 AND 16 GROUP BY can_id) SELECT frame_id, round(abs(1e6 / (t1 - t2) - hz) / hz * 100, 6) AS off_percent FROM g JOIN b USING (can_id) WHERE rn >= 18 AND t1 > t2 AND abs(1e6 / (t1 - t2) - hz) / hz * 100 > 50"))
r(
    "w11_cold_start", lambda f: W.cold_start(f, f.filter("can_id < 270").groupBy("can_id").agg(F.min(F.struct("ts_us", "frame_id", "data")).alias("m")).select("can_id", F.when(F.col("can_id") % 2 == 0, F.col("m.data")).alias("pattern"))).select("frame_id", "distance", "reason"),
    sql("""k AS (SELECT can_id, CASE WHEN can_id % 2 = 0 THEN arg_min(data, frame_id) END AS pattern FROM fr WHERE can_id < 270 GROUP BY can_id), j AS (SELECT fr.frame_id, fr.data, k.can_id AS kid, k.pattern FROM fr LEFT JOIN k USING (can_id) WHERE NOT error),
d AS (SELECT frame_id, kid, CASE WHEN pattern IS NOT NULL THEN list_sum([bit_count(xor(coalesce(data[i], 0), coalesce(pattern[i], 0))) FOR i IN range(1, 9)])::INT END AS distance FROM j) SELECT frame_id, distance, CASE WHEN kid IS NULL THEN 'UnknownId' ELSE 'PatternChanged' END AS reason FROM d WHERE kid IS NULL OR distance > 16"""),
)
r("w12_heatmap", lambda f: W.heatmap(f, 262, 240 * HOUR, 12), sql(f"""l AS (SELECT max(ts_us) - {240 * HOUR} AS s FROM fr), c AS (SELECT least(floor((ts_us - s) / {20.0 * HOUR})::BIGINT, 11) AS bucket, * FROM fr, l WHERE can_id = 262 AND ts_us >= s), g AS (SELECT bucket, {', '.join(f'avg(CASE WHEN dlc > {i} THEN b{i} ELSE 0 END) AS m{i}' for i in range(8))} FROM c GROUP BY bucket)
SELECT x.bucket, {', '.join(f'round(coalesce(m{i}, -1.0), 6) AS b{i}' for i in range(8))} FROM (SELECT unnest(range(0, 12)) AS bucket) x LEFT JOIN g USING (bucket)"""))
r("w13_timeline", lambda f: W.timeline(f, 4, 50).select("can_id", "frame_id", F.col("age").cast("long").alias("age")), sql("t AS (SELECT can_id FROM fr GROUP BY can_id ORDER BY count(*) DESC, can_id LIMIT 4), a AS (SELECT can_id, frame_id, row_number() OVER (PARTITION BY can_id ORDER BY ts_us DESC, frame_id DESC) AS age FROM fr WHERE can_id IN (SELECT can_id FROM t)) SELECT * FROM a WHERE age <= 50"))
r("w15_fps_bursts", lambda f: W.fps_bursts(f, HOUR, 20), sql("t AS (SELECT ts_us // 3600000000 AS tick, count(*) AS frames FROM fr GROUP BY ALL), s AS (SELECT *, avg(frames) OVER w AS m, stddev_pop(frames) OVER w AS sd FROM t WINDOW w AS (ORDER BY tick ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT tick, frames, round(m, 6) AS mean_frames, round(sd, 6) AS sd_frames, coalesce(frames > m + 3 * sd, false) AS burst FROM s"))
r("w16_error_burst", lambda f: W.error_burst(f, 10, 24 * HOUR), sql(f"e AS (SELECT *, max(ts_us) OVER () AS last, min(ts_us) OVER () AS first FROM fr WHERE error) SELECT count(*) AS errors, count(*) FILTER (ts_us >= last - {24 * HOUR}) AS recent, count(*) FILTER (ts_us >= last - {24 * HOUR}) >= 10 AS burst, round(count(*) / ((any_value(last) - any_value(first)) / 1e6), 6) AS error_rate FROM e"))
r("w16_recent_errors", lambda f: W.recent_errors(f, 24 * HOUR).select("frame_id", "class"), sql(f"SELECT frame_id, CASE WHEN can_id & 1 <> 0 THEN 'TxTimeout' WHEN can_id & 2 <> 0 THEN 'LostArbitration' WHEN can_id & 4 <> 0 THEN 'Controller' WHEN can_id & 8 <> 0 THEN 'Protocol' ELSE 'Restarted' END AS class FROM fr WHERE error AND ts_us >= (SELECT max(ts_us) FROM fr WHERE error) - {24 * HOUR}"))
r("w17_auto_increment", lambda f: P.auto_increment(f.withColumn("can_id", F.lit(1).cast("long"))), sql(f"prv AS (SELECT 1::BIGINT AS can_id, byte_idx, byte_val, lag(byte_val) OVER (PARTITION BY byte_idx ORDER BY ts_us, frame_id) AS prev FROM by_), g AS (SELECT can_id, byte_idx, count(*) AS pairs, count(*) FILTER (byte_val <> prev) AS changes, count(*) FILTER (abs(byte_val - prev) IN (1, 255)) AS ones FROM prv WHERE prev IS NOT NULL GROUP BY ALL) SELECT * FROM g WHERE pairs > 4 AND changes > 0.8 * pairs AND ones > 0.9 * changes"))
r("w18_cyclic_noise", P.cyclic_noise, sql(f"{PREV}, x AS (SELECT can_id, byte_idx, xor(byte_val, prev) AS x FROM prv WHERE prev IS NOT NULL), g AS (SELECT can_id, byte_idx, count(*) AS pairs, ({' + '.join(f'CASE WHEN count(*) FILTER (x & {1 << i} <> 0) > 0.4 * count(*) THEN {1 << i} ELSE 0 END' for i in range(8))})::BIGINT AS toggling FROM x GROUP BY ALL) SELECT * FROM g WHERE pairs >= 4 AND toggling > 0"))
WIN = "n0 AS (SELECT *, min(ts_us) OVER () AS t0, max(ts_us) OVER () AS t9 FROM fr), k0 AS (SELECT *, (ts_us - t0) // 3600000000 AS k FROM n0), wf AS (SELECT *, k AS win FROM k0 UNION ALL SELECT *, k - 1 FROM k0 WHERE k >= 1), ww AS (SELECT * FROM wf WHERE t0 + win * 3600000000 < t9)"
WFEAT = WIN + ", wi AS (SELECT win, can_id, count(*) AS n, min(ts_us) AS lo, max(ts_us) AS hi FROM ww GROUP BY ALL), wt AS (SELECT *, sum(n) OVER (PARTITION BY win) AS frames FROM wi), wx AS (SELECT win, any_value(frames)::BIGINT AS frames, count(*) AS ids, -sum(n / frames * ln(n / frames + 1e-9)) / ln(2) AS entropy, (max(hi) - min(lo)) / 1000 AS duration_ms FROM wt GROUP BY win HAVING any_value(frames) >= 3)"
r("w19_feature_windows", lambda f: W.feature_windows(f, 2 * HOUR).groupBy("win").agg(F.count(F.lit(1)).alias("frames")), sql(f"{WIN} SELECT win, count(*) AS frames FROM ww GROUP BY win"))
r("w20_window_features", lambda f: W.window_features(f, 2 * HOUR), sql(f"{WFEAT} SELECT win, frames, ids, round(entropy, 6) AS entropy, round(duration_ms, 6) AS duration_ms, 0.0::DOUBLE AS constant FROM wx"))
NEXT = "nx AS (SELECT can_id AS from_id, lead(can_id) OVER (ORDER BY ts_us, frame_id) AS to_id FROM fr), tr AS (SELECT from_id, to_id, count(*) AS n FROM nx WHERE to_id IS NOT NULL GROUP BY ALL), tp AS (SELECT *, n / sum(n) OVER (PARTITION BY from_id) AS prob FROM tr)"
r("w22_transitions", W.transitions, sql(f"{NEXT} SELECT from_id, to_id, n, round(prob, 6) AS prob FROM tp"))
r("w22_predict_next", W.predict_next, sql(f"{NEXT}, b AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY n DESC, to_id) AS r FROM tp), l AS (SELECT can_id FROM fr GROUP BY can_id ORDER BY max(ts_us) DESC LIMIT 5) SELECT from_id, to_id, n, round(prob, 6) AS prob FROM b WHERE r = 1 AND from_id IN (SELECT can_id FROM l)"))
r("w24_offline_spans", lambda f: W.offline_spans(f).select("frame_id", "can_id", "gap_s", "deadline_s"), sql("g AS (SELECT frame_id, can_id, (lead(ts_us) OVER (PARTITION BY can_id ORDER BY ts_us, frame_id) - ts_us) / 1e6 AS gap_s FROM fr), s AS (SELECT can_id, avg(gap_s) + greatest(3 * coalesce(stddev_samp(gap_s), 0), 0.05) AS deadline_s FROM g GROUP BY can_id) SELECT frame_id, can_id, round(gap_s, 6) AS gap_s, round(deadline_s, 6) AS deadline_s FROM g JOIN s USING (can_id) WHERE gap_s > deadline_s"))
r("w25_stale_signals", lambda f: W.stale_signals(f, 1_706_659_200_000_000, HOUR), sql(f"SELECT can_id, max(ts_us) AS last_us FROM fr GROUP BY can_id HAVING 1706659200000000 - max(ts_us) > {HOUR}"))
r("w26_trials", lambda f: W.trials(f).select("can_id", "frame_id", F.col("rn").cast("long").alias("rn"), F.array_join("context", ",").alias("context")), sql("g AS (SELECT *, row_number() OVER (PARTITION BY can_id ORDER BY ts_us, frame_id) AS rn, list(frame_id) OVER (PARTITION BY can_id ORDER BY ts_us, frame_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS context FROM fr) SELECT can_id, frame_id, rn, array_to_string(context, ',') AS context FROM g WHERE rn % 30 = 0"))
r("t05_tick_counts", lambda f: W.tick_counts(f, HOUR), sql("SELECT ts_us // 3600000000 AS tick, count(*) AS frames, count(DISTINCT can_id) AS ids FROM fr GROUP BY ALL"))
r("t14_replay_delay", lambda f: W.replay_delay(f, 1000.0), sql("SELECT frame_id, round(least(1000.0, greatest(0.0, coalesce((lead(ts_us) OVER (ORDER BY ts_us, frame_id) - ts_us) / 1000 / 1000.0, 0.0))), 6) AS delay_ms FROM fr"))
r("k13_id_stats_csv", lambda f: P.id_profile(f).select("can_id", "frames", "avg_gap_s"), sql(f"{GAP} SELECT can_id, count(*) AS frames, round(coalesce(avg(CASE WHEN pt IS NOT NULL THEN greatest(0, ts_us - pt) END) / 1e6, 0), 6) AS avg_gap_s FROM gp GROUP BY can_id"))
r("k17_trigger_log", lambda f: W.trigger_capture(f, F.col("can_id") == 270, 3, 3).orderBy("rn").select("frame_id", F.concat_ws(" ", "phase", F.hex("can_id")).alias("line")), sql("n AS (SELECT *, row_number() OVER (ORDER BY ts_us, frame_id) AS rn FROM fr), h AS (SELECT min(rn) AS hit FROM n WHERE can_id = 270) SELECT frame_id, CASE WHEN rn < hit THEN 'PRE' WHEN rn = hit THEN 'TRIGGER' ELSE 'POST' END || ' ' || upper(to_hex(can_id)) AS line FROM n, h WHERE rn BETWEEN hit - 3 AND hit + 3"))
