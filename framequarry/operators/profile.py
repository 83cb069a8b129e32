"""Per-identifier profiles: counts, intervals, bits, bytes, errors, roles, features. All are grouped aggregates with map-side partial sums; steps to the frame before are taken in chunks of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry.operators.ordered import by_arrival, carried, previous
from framequarry.schema import bytes_long

#: Error classes by bit of the identifier of an error frame, first match wins.
ERROR_BITS = (("TxTimeout", 0x001), ("LostArbitration", 0x002), ("Controller", 0x004), ("Protocol", 0x008), ("Transceiver", 0x010), ("Ack", 0x020), ("BusOff", 0x040), ("BusError", 0x080), ("Restarted", 0x100))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def zero(x: Column) -> Column:
    """x, 0 where it is null or not a number."""
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))


def frame_bits() -> Column:
    """Bits on the bus of one frame."""
    n = F.col("dlc").cast("long")
    classic = F.when(F.col("extended"), 64).otherwise(44) + 8 * F.least(n, F.lit(8))
    flexible = F.when(F.col("extended"), 80).otherwise(60) + 8 * F.least(n, F.lit(64))
    return F.when(F.col("fd"), flexible).otherwise(classic).cast("long")


def id_profile(df: DataFrame) -> DataFrame:
    """Count, times, intervals (negative ones count 0) and flags of each identifier."""
    rows = previous(df, {"prev_us": "ts_us"}).withColumn("gap", F.when(F.col("prev_us").isNotNull(), F.greatest(F.lit(0), F.col("ts_us") - F.col("prev_us"))))
    out = rows.groupBy("can_id").agg(
        F.count(F.lit(1)).alias("frames"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        F.coalesce(F.min("gap") / 1e6, F.lit(0.0)).alias("min_gap_s"), F.coalesce(F.max("gap") / 1e6, F.lit(0.0)).alias("max_gap_s"), F.coalesce(F.avg("gap") / 1e6, F.lit(0.0)).alias("avg_gap_s"),
        F.count_if("fd").alias("n_fd"), F.count_if("brs").alias("n_brs"), F.count_if("esi").alias("n_esi"), F.max("dlc").cast("long").alias("max_dlc"),
    )
    return out.withColumn("hz", ratio(F.lit(1.0), F.col("avg_gap_s")))


def byte_profile(df: DataFrame) -> DataFrame:
    """Least, greatest and average of each byte; the average divides by all frames of the identifier."""
    n = df.groupBy("can_id").agg(F.count(F.lit(1)).alias("frames"))
    out = bytes_long(df).groupBy("can_id", "byte_idx").agg(F.min("byte_val").alias("min_val"), F.max("byte_val").alias("max_val"), F.sum("byte_val").alias("total"))
    return out.join(n, "can_id").select("can_id", "byte_idx", "min_val", "max_val", (F.col("total") / F.col("frames")).alias("avg_val"))


def arrival() -> Window:
    """Each identifier's frames before one in a chunk as they arrived, also where their times run back."""
    return Window.partitionBy("can_id", "_chunk").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, -1)


def kept_intervals(df: DataFrame) -> DataFrame:
    """Frames whose time is above all earlier ones of the identifier, with the interval to the one before (A02's drop rule): times rise there, so that is the greatest so far."""
    rows = carried(df, ["can_id"], {"_high": (F.max("ts_us"), F.max)}, by_arrival())
    high = F.greatest(F.max("ts_us").over(arrival()), F.col("_high"))  # null only where both are
    kept = rows.withColumn("high", high).filter(F.col("high").isNull() | (F.col("ts_us") > F.col("high")))
    return kept.select(*df.columns, (F.col("ts_us") - F.col("high")).alias("iv"))


def interval_stats(df: DataFrame) -> DataFrame:
    """Mean, sample deviation, bounds, gaps (over three times the running mean before) and whether the identifier is periodic."""
    rows = carried(kept_intervals(df), ["can_id"], {"_sum": (F.sum("iv"), F.sum), "_n": (F.count("iv"), F.sum)}, by_arrival())
    so_far = lambda fold, name: F.coalesce(fold("iv").over(arrival()), F.lit(0)) + F.coalesce(name, F.lit(0))
    running = so_far(F.sum, "_sum") / F.nullif(so_far(F.count, "_n"), F.lit(0))
    rows = rows.withColumn("gap", F.coalesce((F.col("iv") > 3 * running).cast("long"), F.lit(0)))
    out = rows.groupBy("can_id").agg(
        F.count("iv").alias("intervals"), zero(F.avg("iv") / 1e6).alias("mean_s"), zero(F.stddev_samp(F.col("iv") / 1e6)).alias("sd_s"),
        F.coalesce(F.min("iv") / 1e6, F.lit(0.0)).alias("min_s"), F.coalesce(F.max("iv") / 1e6, F.lit(0.0)).alias("max_s"), F.sum("gap").alias("gaps"),
    )
    return out.withColumn("periodic", (F.col("intervals") >= 3) & (F.col("mean_s") > 0) & (F.col("sd_s") < 0.20 * F.col("mean_s")))


def bit_profile(df: DataFrame) -> DataFrame:
    """For each byte the masks of bits that are always 0, always 1, or vary."""
    out = bytes_long(df).groupBy("can_id", "byte_idx").agg(F.bit_and("byte_val").alias("ones"), F.bit_and(F.lit(255) - F.col("byte_val")).alias("zeros"))
    return out.withColumn("varying", F.lit(255) - F.col("ones").bitwiseOR(F.col("zeros")))


def error_class() -> Column:
    out = F.lit("Unknown")
    for name, bit in reversed(ERROR_BITS):
        out = F.when(F.col("can_id").bitwiseAND(bit) != 0, name).otherwise(out)
    return out


def error_counts(df: DataFrame) -> DataFrame:
    """Error frames by class, and whether any told of a bus that is off."""
    return df.filter("error").withColumn("class", error_class()).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("can_id").bitwiseAND(0x40) != 0).alias("bus_off"))


def byte_ranges(df: DataFrame) -> DataFrame:
    """A05."""
    n = df.groupBy("can_id").agg(F.count(F.lit(1)).alias("frames"), F.max("dlc").cast("long").alias("max_dlc"))
    return bytes_long(df).groupBy("can_id", "byte_idx").agg(F.min("byte_val").alias("min_val"), F.max("byte_val").alias("max_val")).join(n, "can_id")


def dashboard(df: DataFrame) -> DataFrame:
    """Totals of the recording; the average assumes 47 bits beside the payload."""
    return df.agg(F.count(F.lit(1)).alias("frames"), F.sum(F.col("dlc").cast("long")).alias("bytes"), F.countDistinct("can_id").alias("ids"), F.count_if("error").alias("errors"), F.avg(F.col("dlc") * 8 + 47.0).alias("avg_bits"))


def dlc_histogram(df: DataFrame) -> DataFrame:
    """Frames of each length 0 to 64."""
    have = df.groupBy(F.col("dlc").cast("long").alias("dlc")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(65).withColumnRenamed("id", "dlc").join(F.broadcast(have.filter("dlc <= 64")), "dlc", "left").select("dlc", F.coalesce("n", F.lit(0)).alias("n"))


def byte_entropy(df: DataFrame) -> DataFrame:
    """Bounds, distinct values and Shannon entropy in bits of each byte."""
    values = bytes_long(df).groupBy("can_id", "byte_idx", "byte_val").agg(F.count(F.lit(1)).alias("n"))
    # -sum(p log2 p) = log2 N - sum(n log2 n) / N needs the total only once.
    out = values.groupBy("can_id", "byte_idx").agg(F.min("byte_val").alias("min_val"), F.max("byte_val").alias("max_val"), F.count(F.lit(1)).alias("distinct_vals"), F.sum("n").alias("total"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("nlogn"))
    return out.select("can_id", "byte_idx", "min_val", "max_val", "distinct_vals", (F.log2(F.col("total").cast("double")) - F.col("nlogn") / F.col("total")).alias("entropy"))


def byte_steps(df: DataFrame) -> DataFrame:
    """Bytes with the value before in the same position of the same identifier."""
    return previous(bytes_long(df), {"prev": "byte_val"}, ["can_id", "byte_idx"])


def counter_share(df: DataFrame) -> DataFrame:
    """A10: the share of steps of +1 modulo 256 of each byte."""
    return byte_steps(df).filter("prev is not null").groupBy("can_id", "byte_idx").agg(F.avg(((F.col("prev") + 1) % 256 == F.col("byte_val")).cast("double")).alias("counter_share"))


def checksum_share(df: DataFrame) -> DataFrame:
    """A10: how often each byte is the XOR of all other bytes of the frame; from 0.85 on it counts as a checksum."""
    rows = df.filter(F.size("data") > 1).withColumn("all_xor", F.aggregate(F.transform("data", lambda x: x.cast("int")), F.lit(0), lambda a, x: a.bitwiseXOR(x)))
    each = rows.select("can_id", "all_xor", F.posexplode("data").alias("byte_idx", "v"))
    out = each.groupBy("can_id", "byte_idx").agg(F.avg((F.col("all_xor").bitwiseXOR(F.col("v").cast("int")) == F.col("v").cast("int")).cast("double")).alias("xor_share"))
    return out.withColumn("is_checksum", F.col("xor_share") >= 0.85)


def median_period(df: DataFrame) -> DataFrame:
    """A10: the upper median of the intervals of each identifier in milliseconds, by counts of equal intervals summed in chunks of their length and not by gathering them."""
    iv = previous(df, {"prev_us": "ts_us"}).select("can_id", (F.col("ts_us") - F.col("prev_us")).alias("iv")).filter("iv is not null")
    counts = iv.groupBy("can_id", "iv").agg(F.count(F.lit(1)).alias("n"))
    rows = carried(counts, ["can_id"], {"_below": (F.sum("n"), F.sum)}, F.expr("iv div 1000000"))
    inside = Window.partitionBy("can_id", "_chunk").orderBy("iv").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("n").over(inside) + F.coalesce("_below", F.lit(0))).join(counts.groupBy("can_id").agg(F.sum("n").alias("of")), "can_id")
    return rows.filter("of div 2 + 1 BETWEEN upto - n + 1 AND upto").select("can_id", (F.col("iv") / 1000).alias("period_ms"))


def flag_bits(df: DataFrame, jump_share: float = 0.5) -> DataFrame:
    """Bytes that look like bit flags: 2 to 6 bits seen both ways, and big jumps (over 3) in at least jump_share of the changes."""
    rows = byte_steps(df).withColumn("changed", F.coalesce(F.col("byte_val") != F.col("prev"), F.lit(False)))
    rows = rows.withColumn("jump", F.col("changed") & (F.abs(F.col("byte_val") - F.col("prev")) > 3))
    out = rows.groupBy("can_id", "byte_idx").agg(F.bit_or("byte_val").alias("seen1"), F.bit_or(F.lit(255) - F.col("byte_val")).alias("seen0"), F.count_if("changed").alias("changes"), F.count_if("jump").alias("jumps"), F.count(F.lit(1)).alias("samples"))
    out = out.withColumn("mask", F.col("seen1").bitwiseAND(F.col("seen0"))).withColumn("bits", F.bit_count("mask").cast("long"))
    share = ratio(F.col("jumps").cast("double"), F.col("changes"))
    return out.withColumn("jump_ratio", share).withColumn("is_flags", F.col("bits").between(2, 6) & (F.col("changes") > 0) & (share >= jump_share)).drop("seen0", "seen1")


def auto_increment(df: DataFrame) -> DataFrame:
    """Bytes that count: over 4 pairs, changed in more than 80 %, by one in more than 90 % of the changes."""
    rows = byte_steps(df).filter("prev is not null").withColumn("d", F.abs(F.col("byte_val") - F.col("prev")))
    out = rows.groupBy("can_id", "byte_idx").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("d") != 0).alias("changes"), F.count_if(F.col("d").isin(1, 255)).alias("ones"))
    return out.filter("pairs > 4 AND changes > 0.8 * pairs AND ones > 0.9 * changes")


def cyclic_noise(df: DataFrame) -> DataFrame:
    """Bytes with a bit that toggles in more than 40 % of at least 4 pairs; toggling has the mask of those bits."""
    rows = byte_steps(df).filter("prev is not null").withColumn("x", F.col("byte_val").bitwiseXOR(F.col("prev")))
    out = rows.groupBy("can_id", "byte_idx").agg(F.count(F.lit(1)).alias("pairs"), *(F.count_if(F.col("x").bitwiseAND(1 << i) != 0).alias(f"t{i}") for i in range(8)))
    mask = sum((F.when(F.col(f"t{i}") > 0.4 * F.col("pairs"), 1 << i).otherwise(0) for i in range(1, 8)), F.when(F.col("t0") > 0.4 * F.col("pairs"), 1).otherwise(0))
    return out.withColumn("toggling", mask.cast("long")).filter("pairs >= 4 AND toggling > 0").select("can_id", "byte_idx", "pairs", "toggling")


def byte_features(df: DataFrame) -> DataFrame:
    """The ten features of each byte position, as streams of values."""
    rows = byte_steps(df).withColumn("d", F.abs(F.col("byte_val") - F.col("prev"))).withColumn("pop", F.bit_count("byte_val").cast("double"))
    values = rows.groupBy("can_id", "byte_idx").agg(
        F.bit_count(F.bit_or("byte_val").bitwiseAND(F.bit_or(F.lit(255) - F.col("byte_val")))).cast("long").alias("bit_count"),
        ratio(F.count_if(F.col("d") > 3).cast("double"), F.count_if(F.col("d") > 0)).alias("jump_ratio"), ratio(F.count_if(F.col("d") > 0).cast("double"), F.count("d")).alias("change_ratio"),
        (F.countDistinct("byte_val") / 256).alias("distinct_share"), zero(F.avg("d")).alias("mean_abs_delta"), F.coalesce(F.max("d"), F.lit(0)).cast("long").alias("max_abs_delta"),
        F.stddev_pop("byte_val").alias("sd"), F.avg((F.col("byte_val") == 0).cast("double")).alias("share_00"), F.avg((F.col("byte_val") == 255).cast("double")).alias("share_ff"), F.stddev_pop("pop").alias("pop_sd"),
    )
    return values.join(byte_entropy(df).select("can_id", "byte_idx", (F.col("entropy") / 8).alias("entropy_share")), ["can_id", "byte_idx"])


def bit_features(df: DataFrame) -> DataFrame:
    """Toggle rate of each bit, its rank in the byte, carry lift (toggling with the next lower bit falling), and toggling together with neighbours."""
    rows = byte_steps(df).filter("prev is not null").withColumn("x", F.col("byte_val").bitwiseXOR(F.col("prev")))
    bits = rows.select("can_id", "byte_idx", "byte_val", "x", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    at = lambda c, i: F.expr(f"(shiftright({c}, {i}) & 1)")
    bits = bits.withColumn("t", at("x", "bit")).withColumn("below", F.expr("if(bit > 0, shiftright(x, bit - 1) & 1, 0)")).withColumn("above", F.expr("if(bit < 7, shiftright(x, bit + 1) & 1, 0)")).withColumn("fell", F.expr("if(bit > 0 AND (shiftright(x, bit - 1) & 1) = 1 AND (shiftright(byte_val, bit - 1) & 1) = 0, 1, 0)")).withColumn("one", at("byte_val", "bit"))
    s = lambda cond: F.sum(cond.cast("long")).cast("double")
    t, b, a, f = (F.col(x) == 1 for x in ("t", "below", "above", "fell"))
    out = bits.groupBy("can_id", "byte_idx", "bit").agg(
        F.avg(F.col("t").cast("double")).alias("toggle_rate"), F.avg(F.col("one").cast("double")).alias("one_share"), ratio(s(t & b), s(t)).alias("with_lower"), ratio(s(t & a), s(t)).alias("with_upper"), ratio(s(t & f), s(f)).alias("carry"),
    )
    order = Window.partitionBy("can_id", "byte_idx").orderBy(F.desc("toggle_rate"))
    out = out.withColumn("toggle_rank", F.rank().over(order).cast("long")).withColumn("carry_lift", F.col("carry") - F.col("toggle_rate"))
    lower = F.lag("toggle_rate").over(Window.partitionBy("can_id", "byte_idx").orderBy("bit"))
    return out.withColumn("falls_off", F.coalesce((F.col("toggle_rate") <= lower).cast("long"), F.lit(1)))


def signal_features(df: DataFrame, max_raw: float = 255.0) -> DataFrame:
    """Seven features of each byte as a signal: distinct values, dwell, oscillation, mean step, deviation, range and greatest step over max_raw."""
    rows = previous(byte_steps(df).withColumn("d", F.col("byte_val") - F.col("prev")), {"d0": "d"}, ["can_id", "byte_idx"])
    return rows.groupBy("can_id", "byte_idx").agg(
        ratio(F.countDistinct("byte_val").cast("double"), F.count(F.lit(1))).alias("distinct_share"), ratio(F.count_if(F.col("d") == 0).cast("double"), F.count("d")).alias("dwell"),
        ratio(F.count_if(F.col("d") * F.col("d0") < 0).cast("double"), F.count("d0")).alias("oscillation"), zero(F.avg(F.abs("d"))  / max_raw).alias("mean_step"),
        (F.stddev_pop("byte_val") / max_raw).alias("sd"), ((F.max("byte_val") - F.min("byte_val")) / max_raw).alias("value_range"), zero(F.max(F.abs("d")) / max_raw).alias("max_step"),
    )


def byte_role(df: DataFrame) -> DataFrame:
    """The role of each byte, from its distinct values, entropy, counting, and checksum share."""
    stats = byte_entropy(df).join(counter_share(df), ["can_id", "byte_idx"], "left").join(checksum_share(df), ["can_id", "byte_idx"], "left")
    role = F.when(F.col("distinct_vals") == 1, "CONST").when(F.coalesce("counter_share", F.lit(0.0)) >= 0.8, "COUNTER").when(F.coalesce("is_checksum", F.lit(False)), "CHECKSUM")
    role = role.when(F.col("distinct_vals") == 2, "TOGGLE").when((F.col("distinct_vals") <= 8) & (F.col("entropy") < 3.0), "ENUM").otherwise("VALUE")
    return stats.select("can_id", "byte_idx", "distinct_vals", "entropy", role.alias("role"))


def message_timing(df: DataFrame) -> DataFrame:
    """Periodic (deviation under a quarter of the mean), sporadic (under 20 frames) or event-driven."""
    n = df.groupBy("can_id").agg(F.count(F.lit(1)).alias("frames"))
    out = interval_stats(df).join(n, "can_id")
    kind = F.when(F.col("frames") < 20, "SPORADIC").when((F.col("mean_s") > 0) & (F.col("sd_s") / F.nullif(F.col("mean_s"), F.lit(0.0)) < 0.25), "PERIODIC").otherwise("EVENT")
    return out.select("can_id", "frames", kind.alias("timing"))


def bus_load_variants(df: DataFrame, window_us: int, baud: int) -> DataFrame:
    """The three load formulas side by side over tumbling windows: exact bits, 64 bits flat, and payload plus 47."""
    w = df.withColumn("bucket", F.expr(f"ts_us div {window_us}"))
    seconds = window_us / 1e6 * baud
    return w.groupBy("bucket").agg((F.sum(frame_bits()) / seconds).alias("load_exact"), (F.count(F.lit(1)) * 64 / seconds).alias("load_flat"), (F.sum(F.col("dlc") * 8 + 47.0) / seconds).alias("load_avg"))


def summary(df: DataFrame, value: Column) -> DataFrame:
    """N, mean, sample deviation, interpolated median and bounds of one sample."""
    v = df.select(value.cast("double").alias("v"))
    return v.agg(F.count("v").alias("n"), F.avg("v").alias("mean_v"), zero(F.stddev_samp("v")).alias("sd"), F.expr("percentile(v, 0.5)").alias("median_v"), F.min("v").alias("min_v"), F.max("v").alias("max_v"))
