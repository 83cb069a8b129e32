"""Sequential analytics: deltas, bursts, load, triggers, alerts, counters, heatmaps, feature windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry.operators.ordered import carried, following, next_row, numbered, position, previous, rolling_sum
from framequarry.operators.profile import error_class, frame_bits, ratio, zero
from framequarry.schema import seq_order


def delta(df: DataFrame) -> DataFrame:
    """Microseconds to the frame before of the same identifier, 0 for the first and for times that don't rise."""
    return previous(df, {"prev_us": "ts_us"}).withColumn("delta_us", F.greatest(F.lit(0).cast("long"), F.coalesce(F.col("ts_us") - F.col("prev_us"), F.lit(0).cast("long")))).drop("prev_us")


def changed_mask(df: DataFrame) -> DataFrame:
    """A bit for each byte that differs from the frame before of the same identifier; a byte that one of them lacks counts as 0."""
    rows = previous(df, {"prev": "data"})
    bit = lambda x, i: F.when(F.coalesce(x, F.lit(0).cast("short")) != F.coalesce(F.get("prev", i), F.lit(0).cast("short")), F.expr("cast(1 as bigint)")).otherwise(F.lit(0).cast("long"))
    bits = F.transform(F.sequence(F.lit(0), F.greatest(F.size("data"), F.size("prev")) - 1), lambda i: F.call_function("shiftleft", bit(F.get("data", i), i), i))
    return rows.withColumn("changed_mask", F.when(F.col("prev").isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))).drop("prev")


def bursts(df: DataFrame, limit_us: int = 1000) -> DataFrame:
    """Frames under ``limit_us`` after the one before of the same identifier."""
    return previous(df, {"prev_us": "ts_us"}).withColumn("burst", F.col("prev_us").isNotNull() & (F.greatest(F.lit(0), F.col("ts_us") - F.col("prev_us")) < limit_us)).drop("prev_us")


def bus_load(df: DataFrame, window_us: int = 1_000_000, baud: int = 500_000) -> DataFrame:
    """The share of the bus that the frames of the trailing window take, after each frame."""
    out = rolling_sum(df.withColumn("bits", frame_bits()), F.col("bits"), window_us, "window_bits")
    return out.withColumn("load", F.col("window_bits") / (window_us / 1e6 * baud))


def peak_load(df: DataFrame, window_us: int = 1_000_000, baud: int = 500_000) -> DataFrame:
    """The greatest load, and frames a second over the recording."""
    span = (F.max("ts_us") - F.min("ts_us")) / 1e6
    return bus_load(df, window_us, baud).agg(F.max("load").alias("peak_load"), ratio(F.count(F.lit(1)).cast("double"), span).alias("fps"))


def top_loaders(df: DataFrame, n: int = 10, window_us: int = 1_000_000) -> DataFrame:
    """The identifiers with most bits in the last window of the recording."""
    last = df.agg(F.max("ts_us").alias("last"))
    near = df.join(F.broadcast(last), F.col("ts_us") >= F.col("last") - window_us)
    return near.groupBy("can_id").agg(F.sum(frame_bits()).alias("bits"), F.count(F.lit(1)).alias("frames")).orderBy(F.desc("bits"), "can_id").limit(n)


def trigger_capture(df: DataFrame, trigger: Column, before: int, after: int, chunk_us: int = 3_600_000_000) -> DataFrame:
    """The first frame that meets ``trigger``, ``before`` frames ahead of it and ``after`` behind, labelled PRE, TRIGGER, POST."""
    rows = numbered(df, chunk_us)
    hit = rows.filter(trigger).agg(F.min("rn").alias("hit"))
    near = rows.join(F.broadcast(hit), F.col("rn").between(F.col("hit") - before, F.col("hit") + after))
    return near.withColumn("phase", F.when(F.col("rn") < F.col("hit"), "PRE").when(F.col("rn") == F.col("hit"), "TRIGGER").otherwise("POST"))


def new_ids(df: DataFrame) -> DataFrame:
    """The first frame ever of each identifier. A grouped minimum; no window is needed."""
    return df.groupBy("can_id").agg(F.min(F.struct(*seq_order())).alias("f")).select("can_id", "f.ts_us", "f.frame_id")


def dlc_changes(df: DataFrame) -> DataFrame:
    """Frames whose length differs from the identifier's first."""
    first = df.groupBy("can_id").agg(F.min(F.struct(*seq_order(), "dlc")).alias("f")).select("can_id", F.col("f.dlc").alias("first_dlc"))
    return df.join(first, "can_id").filter("dlc <> first_dlc")


def counter_check(df: DataFrame, can_id: int, byte_idx: int, modulus: int = 256, upper_nibble: bool = False) -> DataFrame:
    """Ok or Mismatch of a counter that should step by one; OutOfRange frames lack the byte and leave the expectation. Skip: the first one."""
    rows = df.filter(F.col("can_id") == can_id)
    raw = F.get("data", F.lit(byte_idx)).cast("int")
    value = F.shiftright(raw, 4) if upper_nibble else raw
    rows = rows.withColumn("value", F.pmod(value, F.lit(modulus)))
    seen = F.max(F.when(F.col("value").isNotNull(), F.struct(*seq_order(), "value")))
    rows = carried(rows, ["can_id"], {"_seen": (seen, lambda c: F.last(c, ignorenulls=True))})
    inside = F.last("value", ignorenulls=True).over(Window.partitionBy("can_id", "_chunk").orderBy(*seq_order()).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("prev", F.coalesce(inside, F.col("_seen.value"))).drop("_chunk", "_seen")
    state = F.when(F.col("value").isNull(), "OutOfRange").when(F.col("prev").isNull(), "Skip").when(F.col("value") == (F.col("prev") + 1) % modulus, "Ok").otherwise("Mismatch")
    return rows.withColumn("result", state)


def rate_anomalies(df: DataFrame, percent: float) -> DataFrame:
    """The baseline is the rate over the first 16 frames of an identifier; from frame 18 on, the interval before the last must not stray from it by more than ``percent``."""
    rows = position(previous(previous(df, {"t1": "ts_us"}), {"t2": "t1"}))
    base = rows.filter("rn BETWEEN 2 AND 16").groupBy("can_id").agg((1e6 / F.avg(F.col("ts_us") - F.col("t1"))).alias("base_hz"))
    out = rows.filter("rn >= 18 AND t1 > t2").join(base, "can_id").withColumn("hz", 1e6 / (F.col("t1") - F.col("t2")))
    return out.withColumn("off_percent", F.abs(F.col("hz") - F.col("base_hz")) / F.col("base_hz") * 100).filter(F.col("off_percent") > percent)


def cold_start(df: DataFrame, known: DataFrame, most: int = 16) -> DataFrame:
    """Data frames of unknown identifiers, or whose payload lies more than ``most`` bits from the known pattern. known: (can_id, pattern array or null)."""
    rows = df.filter("NOT error AND NOT rtr").join(known.withColumn("known", F.lit(True)), "can_id", "left")
    n = F.greatest(F.size("data"), F.size("pattern"))
    at = lambda c, i: F.coalesce(F.get(c, i).cast("int"), F.lit(0))
    far = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.bit_count(at("data", i).bitwiseXOR(at("pattern", i)))), F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn("distance", F.when(F.col("pattern").isNotNull(), far))
    reason = F.when(F.col("known").isNull(), "UnknownId").when(F.col("distance") > most, "PatternChanged")
    return rows.withColumn("reason", reason).filter("reason is not null").drop("known", "pattern")


def heatmap(df: DataFrame, can_id: int, window_us: int, buckets: int) -> DataFrame:
    """The mean of each of 8 bytes in each bucket of the window before the recording's last frame, -1 without frames; bytes past the length count 0."""
    rows = df.filter(F.col("can_id") == can_id)
    last = df.agg(F.max("ts_us").alias("last"))
    near = rows.join(F.broadcast(last), F.col("ts_us") >= F.col("last") - window_us)
    bucket = F.least(F.floor((F.col("ts_us") - (F.col("last") - window_us)) / (window_us / buckets)), F.lit(buckets - 1)).cast("long")
    cells = near.withColumn("bucket", bucket).groupBy("bucket").agg(*(F.avg(F.coalesce(F.get("data", F.lit(i)), F.lit(0)).cast("double")).alias(f"b{i}") for i in range(8)))
    return df.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(F.broadcast(cells), "bucket", "left").select("bucket", *(F.coalesce(f"b{i}", F.lit(-1.0)).alias(f"b{i}") for i in range(8)))


def timeline(df: DataFrame, ids: int = 16, events: int = 500) -> DataFrame:
    """The last ``events`` frames of each of the ``ids`` busiest identifiers."""
    top = df.groupBy("can_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "can_id").limit(ids).select("can_id")
    back = Window.partitionBy("can_id").orderBy(F.desc("ts_us"), F.desc("frame_id"))
    return df.join(F.broadcast(top), "can_id").withColumn("age", F.row_number().over(back)).filter(F.col("age") <= events)


def fps_bursts(df: DataFrame, tick_us: int = 500_000, depth: int = 20, stretch: int = 4096) -> DataFrame:
    """Ticks whose count is above mean + 3 deviations of the ``depth`` ticks before. Ticks are numbered and looked at in stretches, each with the last ``depth`` ticks of the one before."""
    ticks = df.groupBy(F.expr(f"ts_us div {tick_us}").alias("tick")).agg(F.count(F.lit(1)).alias("frames"))
    rows = numbered(ticks.withColumn("ts_us", F.col("tick")).withColumn("frame_id", F.col("tick")), stretch, "_at").drop("ts_us", "frame_id").withColumn("_of", F.expr(f"(_at - 1) div {stretch}")).withColumn("_own", F.lit(True))
    edge = rows.filter((F.col("_at") - 1) % stretch >= stretch - depth).withColumn("_of", F.col("_of") + 1).withColumn("_own", F.lit(False))
    back = Window.partitionBy("_of").orderBy("tick").rowsBetween(-depth, -1)
    out = rows.unionByName(edge).withColumn("mean_frames", F.avg("frames").over(back)).withColumn("sd_frames", F.stddev_pop("frames").over(back)).filter("_own").drop("_at", "_of", "_own")
    return out.withColumn("burst", F.coalesce(F.col("frames") > F.col("mean_frames") + 3 * F.col("sd_frames"), F.lit(False)))


def error_burst(df: DataFrame, threshold: int = 10, window_us: int = 1_000_000) -> DataFrame:
    """Error frames within the window before the latest, whether they make a burst, and errors a second between first and last."""
    errors = df.filter("error")
    ends = errors.agg(F.max("ts_us").alias("last"), F.min("ts_us").alias("first"), F.count(F.lit(1)).alias("errors"))
    near = errors.join(F.broadcast(ends), F.col("ts_us") >= F.col("last") - window_us).agg(F.count(F.lit(1)).alias("recent"))
    return ends.crossJoin(near).select("errors", "recent", (F.col("recent") >= threshold).alias("burst"), ratio(F.col("errors").cast("double"), (F.col("last") - F.col("first")) / 1e6).alias("error_rate"))


def recent_errors(df: DataFrame, window_us: int = 1_000_000) -> DataFrame:
    """The error frames within the window before the latest, with their classes."""
    errors = df.filter("error")
    return errors.join(F.broadcast(errors.agg(F.max("ts_us").alias("last"))), F.col("ts_us") >= F.col("last") - window_us).select("frame_id", "ts_us", "can_id", error_class().alias("class"))


def feature_windows(df: DataFrame, size_us: int, full: bool = False) -> DataFrame:
    """(win, frame columns): windows of size_us every half of it, from the first frame; a frame lies in two. ``full``: only windows that end before the last frame."""
    step = size_us // 2
    ends = df.agg(F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"))
    rows = df.join(F.broadcast(ends)).withColumn("k", F.expr(f"(ts_us - t0) div {step}"))
    rows = rows.withColumn("win", F.explode(F.sequence(F.greatest(F.col("k") - 1, F.lit(0).cast("long")), F.col("k"))))
    last = F.col("t1") - (size_us if full else 0)
    return rows.filter(F.col("t0") + F.col("win") * step < last).drop("k", "t0", "t1")


def window_features(df: DataFrame, size_us: int, full: bool = False) -> DataFrame:
    """Frames, identifiers, identifier entropy, duration in ms, and a constant 0, of each window with at least 3 frames."""
    each = feature_windows(df, size_us, full).groupBy("win", "can_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    totals = each.groupBy("win").agg(F.sum("n").alias("frames"), F.count(F.lit(1)).alias("ids"), F.collect_list("n").alias("ns"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("frames >= 3")
    p = lambda x: x / F.col("frames")
    entropy = F.aggregate(F.transform(F.sort_array("ns"), lambda x: p(x) * F.log(p(x) + 1e-9)), F.lit(0.0), lambda a, x: a - x) / F.log(F.lit(2.0))
    return totals.select("win", "frames", "ids", entropy.alias("entropy"), ((F.col("hi") - F.col("lo")) / 1000).alias("duration_ms"), F.lit(0.0).alias("constant"))


def transitions(df: DataFrame, chunk_us: int = 3_600_000_000) -> DataFrame:
    """How often one identifier follows another in the global order, with the share of all successors."""
    pairs = next_row(df, "can_id", "to_id", chunk_us).filter("to_id is not null").groupBy(F.col("can_id").alias("from_id"), "to_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("from_id")))


def predict_next(df: DataFrame, last: int = 5, chunk_us: int = 3_600_000_000) -> DataFrame:
    """For the last ``last`` distinct identifiers seen, the likeliest successor (most frequent, then the smaller identifier)."""
    best = transitions(df, chunk_us).withColumn("r", F.row_number().over(Window.partitionBy("from_id").orderBy(F.desc("n"), "to_id"))).filter("r = 1").drop("r")
    recent = df.groupBy("can_id").agg(F.max(F.struct(*seq_order())).alias("at")).orderBy(F.desc("at")).limit(last).select(F.col("can_id").alias("from_id"))
    return best.join(F.broadcast(recent), "from_id")


def offline_spans(df: DataFrame, floor_us: int = 50_000) -> DataFrame:
    """Gaps beyond the identifier's learned deadline, mean + max(3 deviations, floor): from when it counts as offline to when it is back."""
    rows = following(df, {"next_us": "ts_us"})
    stats = rows.filter("next_us is not null").groupBy("can_id").agg((F.avg(F.col("next_us") - F.col("ts_us")) / 1e6).alias("mean_s"), zero(F.stddev_samp((F.col("next_us") - F.col("ts_us")) / 1e6)).alias("sd_s"))
    rows = rows.join(stats, "can_id").withColumn("deadline_s", F.col("mean_s") + F.greatest(3 * F.col("sd_s"), F.lit(floor_us / 1e6)))
    gap = (F.col("next_us") - F.col("ts_us")) / 1e6
    return rows.withColumn("gap_s", gap).filter(F.col("gap_s") > F.col("deadline_s"))


def stale_signals(df: DataFrame, now_us: int, limit_us: int) -> DataFrame:
    """Identifiers not seen for more than ``limit_us``."""
    return df.groupBy("can_id").agg(F.max("ts_us").alias("last_us")).filter(F.lit(now_us) - F.col("last_us") > limit_us)


def trials(df: DataFrame, depth: int = 30) -> DataFrame:
    """After every ``depth`` frames of an identifier the last one as trigger and those before as context; a group holds ``depth`` frames."""
    rows = position(df).groupBy("can_id", F.expr(f"(rn - 1) div {depth}").alias("turn")).agg(F.sort_array(F.collect_list(F.struct("rn", "frame_id", "ts_us"))).alias("rows"))
    last = F.element_at("rows", -1)
    return rows.filter(F.size("rows") == depth).select("can_id", last["frame_id"].alias("frame_id"), last["ts_us"].alias("ts_us"), last["rn"].alias("rn"), F.col("rows.frame_id").alias("context"))


def replay_delay(df: DataFrame, speed: float = 1.0, most_ms: float = 1000.0, chunk_us: int = 3_600_000_000) -> DataFrame:
    """Milliseconds to wait before the next frame on replay: the original spacing over the speed, at most ``most_ms``."""
    out = next_row(df, "ts_us", "next_us", chunk_us)
    return out.select("frame_id", F.least(F.lit(most_ms), F.greatest(F.lit(0.0), F.coalesce((F.col("next_us") - F.col("ts_us")) / 1000 / speed, F.lit(0.0)))).alias("delay_ms"))


def tick_counts(df: DataFrame, tick_us: int) -> DataFrame:
    """Frames and identifiers in tumbling ticks."""
    return df.groupBy(F.expr(f"ts_us div {tick_us}").alias("tick")).agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("can_id").alias("ids"))
