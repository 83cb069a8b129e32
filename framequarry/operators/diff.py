"""Comparisons of recordings, gateway and replay rules, range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry.operators.ordered import numbered, position, previous
from framequarry.operators.profile import ratio
from framequarry.schema import bytes_long


def byte_summary(df: DataFrame) -> DataFrame:
    """Per identifier: frames, greatest length, and arrays of each byte's least and greatest value."""
    n = df.groupBy("can_id").agg(F.count(F.lit(1)).alias("frames"))
    each = bytes_long(df).groupBy("can_id", "byte_idx").agg(F.min("byte_val").alias("lo"), F.max("byte_val").alias("hi"))
    return n.join(each.groupBy("can_id").agg(F.sort_array(F.collect_list(F.struct("byte_idx", "lo", "hi"))).alias("bytes")), "can_id", "left")


def recording_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Identifiers that b adds or lacks, and those whose byte ranges differ, with a mask of the bytes; equal ones are left out."""
    x, y = byte_summary(a), byte_summary(b).select("can_id", F.col("frames").alias("frames_b"), F.col("bytes").alias("bytes_b"))
    j = x.join(y, "can_id", "full_outer").withColumn("count_a", F.coalesce("frames", F.lit(0))).withColumn("count_b", F.coalesce("frames_b", F.lit(0)))
    diff = lambda i: (F.size("bytes") <= i) != (F.size("bytes_b") <= i)
    same = lambda i: F.get("bytes", F.lit(i)).eqNullSafe(F.get("bytes_b", F.lit(i)))
    mask = sum((F.when(diff(i) | ~same(i), 1 << i).otherwise(0) for i in range(1, 8)), F.when(diff(0) | ~same(0), 1).otherwise(0))
    kind = F.when(F.col("frames").isNull(), "Added").when(F.col("frames_b").isNull(), "Removed").otherwise("ByteChanged")
    both = F.col("frames").isNotNull() & F.col("frames_b").isNotNull()
    out = j.select("can_id", kind.alias("change"), "count_a", "count_b", F.when(both, mask).otherwise(0).cast("long").alias("changed_mask"))
    return out.filter((F.col("change") != "ByteChanged") | (F.col("changed_mask") != 0))


def compare_by_id(a: DataFrame, b: DataFrame) -> DataFrame:
    """The k-th frame of an identifier on either side: Identical, Different, LeftOnly or RightOnly; diff_bytes counts bytes that differ, a missing byte reads 0xFF."""
    side = lambda df, n: position(df, "k").select("can_id", "k", F.col("data").alias(f"data_{n}"), F.col("dlc").alias(f"dlc_{n}"), F.col("frame_id").alias(f"frame_{n}"))
    j = side(a, "a").join(side(b, "b"), ["can_id", "k"], "full_outer")
    at = lambda c, i: F.coalesce(F.get(c, i).cast("int"), F.lit(255))
    n = F.greatest(F.size("data_a"), F.size("data_b"))
    diff = F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: at("data_a", i) != at("data_b", i)))
    both = F.col("frame_a").isNotNull() & F.col("frame_b").isNotNull()
    j = j.withColumn("diff_bytes", F.when(both & (n > 0), diff).otherwise(0).cast("long"))
    status = F.when(F.col("frame_a").isNull(), "RightOnly").when(F.col("frame_b").isNull(), "LeftOnly").when((F.col("diff_bytes") == 0) & (F.col("dlc_a") == F.col("dlc_b")), "Identical").otherwise("Different")
    return j.select("can_id", "k", "frame_a", "frame_b", "diff_bytes", status.alias("status"))


def dlc_anomalies(df: DataFrame) -> DataFrame:
    """Frames whose length isn't the identifier's most frequent (the shorter of equally frequent)."""
    modes = df.groupBy("can_id", "dlc").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("can_id").orderBy(F.desc("n"), "dlc"))).filter("r = 1")
    return df.join(modes.select("can_id", F.col("dlc").alias("usual_dlc")), "can_id").filter("dlc <> usual_dlc")


def interval_join(df: DataFrame, points: DataFrame, before_us: int, after_us: int) -> DataFrame:
    """(point columns, frame columns) of frames within [at - before, at + after] of a point (point_id, at_us).

    A range join as an equi-join: a point enters each bucket of time that its window touches, a frame just its own. A window is four buckets
    long, so at most two of five or six are met for frames outside it.
    """
    width = max(1, (before_us + after_us) // 4)
    b = lambda x: F.floor(x / width)
    wide = points.withColumn("_b", F.explode(F.sequence(b(F.col("at_us") - before_us), b(F.col("at_us") + after_us))))
    return df.withColumn("_b", b(F.col("ts_us"))).join(wide, "_b").filter(F.col("ts_us").between(F.col("at_us") - before_us, F.col("at_us") + after_us)).drop("_b")


def request_response(df: DataFrame, low_us: int = 10_000, high_us: int = 150_000, depth: int = 50, least: int = 5, chunk_us: int | None = None) -> DataFrame:
    """Pairs of identifiers where one follows the other within [low, high] among the last ``depth`` frames, at least ``least`` times.

    Frames are joined on buckets of ``depth`` positions in the global order, from counts of time chunks, so a frame meets at most twice as many whatever the bus's density.
    """
    rows = numbered(df, chunk_us or max(high_us, 1_000_000)).select("rn", "ts_us", "can_id")
    b = F.expr(f"rn div {depth}")
    later = rows.select(F.col("rn").alias("rn2"), F.col("ts_us").alias("ts2"), F.col("can_id").alias("resp_id"), F.explode(F.array(b, b - 1)).alias("b"))
    pairs = rows.withColumn("b", b).join(later, "b").filter((F.col("can_id") != F.col("resp_id")) & F.col("rn2").between(F.col("rn") + 1, F.col("rn") + depth) & (F.col("ts2") - F.col("ts_us")).between(low_us, high_us))
    return pairs.groupBy(F.col("can_id").alias("req_id"), "resp_id").agg(F.count(F.lit(1)).alias("hits"), (F.avg(F.col("ts2") - F.col("ts_us")) / 1000).alias("latency_ms")).filter(F.col("hits") >= least)


def gateway(df: DataFrame, white: list[int], black: list[int], remap: dict[int, int], mode: str = "white") -> DataFrame:
    """frames that pass a gateway, with their new identifiers. The black list wins in all modes; mode ``white`` passes only the white list, ``drop`` nothing, ``all`` the rest. Lists of rules are small literals."""
    passes = ~F.col("can_id").isin(black) if black else F.lit(True)
    if mode == "white":
        passes = passes & (F.col("can_id").isin(white) if white else F.lit(False))
    if mode == "drop":
        passes = F.lit(False)
    out = F.col("can_id")
    for src, dst in remap.items():
        out = F.when(F.col("can_id") == src, F.lit(dst)).otherwise(out)
    return df.withColumn("passes", passes).withColumn("out_id", out.cast("long"))


def gateway_stats(df: DataFrame, **rules) -> DataFrame:
    g = gateway(df, **rules)
    return g.agg(F.count_if("passes").alias("passed"), F.count_if(~F.col("passes")).alias("dropped"), F.count_if(F.col("passes") & (F.col("out_id") != F.col("can_id"))).alias("remapped"))


def replay_filter(df: DataFrame, rules: DataFrame) -> DataFrame:
    """replay rules (ord, src_id, use_ext, drop, dst_id, scale array, shift array) of each frame's first match.

    A byte i of the first 8 becomes clamp(round(x * scale[i] + shift[i]), 0, 255) where the rule has entries for it; frames of drop rules go. Rules number few and are joined on the identifier.
    """
    first = Window.partitionBy("frame_id").orderBy("ord")
    j = df.join(rules, (df["can_id"] == rules["src_id"]) & (~rules["use_ext"] | df["extended"]), "left").withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    moved = F.transform("data", lambda x, i: F.when((i < 8) & (i < F.size("scale")), F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round(x * F.get("scale", i) + F.get("shift", i))))).otherwise(x.cast("double")).cast("short"))
    out = j.filter(~F.coalesce("drop", F.lit(False))).withColumn("data", F.when(F.col("scale").isNotNull(), moved).otherwise(F.col("data")))
    return out.withColumn("can_id", F.coalesce("dst_id", "can_id")).select(*df.columns)


def edit_recording(df: DataFrame, edits: DataFrame, skips: DataFrame) -> DataFrame:
    """a recording with frames replaced by position (frame_id, new_id, new_data) or left out (frame_id); times stay."""
    kept = df.join(skips.select("frame_id"), "frame_id", "left_anti").join(edits, "frame_id", "left")
    data = F.coalesce("new_data", "data")
    return kept.withColumn("can_id", F.coalesce("new_id", "can_id")).withColumn("dlc", F.size(data).cast("short")).withColumn("data", data).select(*df.columns)


def match_nodes(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """The reply frames of simulated nodes (node, trig_id, id_mask, trig_data array, data_mask array, resp_id, resp_data array, delay_us).

    A node answers when the identifier agrees under its mask and the payload begins with its bytes under theirs. No key is equal there, so each frame meets each
    node; Spark broadcasts the nodes if their size allows.
    """
    at = lambda c, i: F.coalesce(F.get(c, i).cast("int"), F.lit(0))
    prefix = F.forall(F.sequence(F.lit(0), F.size("trig_data")), lambda i: (i >= F.size("trig_data")) | ((i < F.size("data")) & (at("data", i).bitwiseAND(at("data_mask", i)) == at("trig_data", i).bitwiseAND(at("data_mask", i)))))
    hit = F.col("can_id").bitwiseAND(F.col("id_mask")) == F.col("trig_id").bitwiseAND(F.col("id_mask"))
    j = df.join(nodes, hit & prefix)
    return j.select("frame_id", "node", F.col("resp_id").alias("can_id"), (F.col("ts_us") + F.col("delay_us")).alias("ts_us"), F.col("resp_data").alias("data"))


def dictionary_overlap(cells: DataFrame, signals: DataFrame) -> DataFrame:
    """(can_id, byte_idx) cells with the first signal whose bits touch the byte."""
    s = signals.select(F.col("msg_id").alias("can_id"), "sig_name", F.expr("start_bit div 8").alias("lo"), F.expr("(start_bit + length + 7) div 8").alias("hi"), "start_bit")
    j = cells.join(s, "can_id", "left").withColumn("sig_name", F.when((F.col("byte_idx") >= F.col("lo")) & (F.col("byte_idx") < F.col("hi")), F.col("sig_name")))
    return j.groupBy("can_id", "byte_idx").agg(F.min(F.when(F.col("sig_name").isNotNull(), F.struct("start_bit", "sig_name"))).alias("s")).select("can_id", "byte_idx", F.col("s.sig_name").alias("sig_name"))


def rule_match(truth: DataFrame, rules: DataFrame) -> DataFrame:
    """For each true signal (sig, can_id, byte_idx, discrete, bit_mask) the rule (ord, can_id, byte_idx, mask) that finds it, or null.

    A discrete signal wants a rule of exactly its bit; another one prefers a rule without mask, then the first.
    """
    r = rules.select("ord", "can_id", "byte_idx", "mask")
    j = truth.join(r, ["can_id", "byte_idx"], "left")
    fits = F.when(F.col("discrete"), (F.col("mask") == F.col("bit_mask")) & (F.bit_count("mask") == 1)).otherwise(F.col("ord").isNotNull())
    best = F.min(F.when(fits, F.struct((F.coalesce("mask", F.lit(0)) != 0).alias("masked"), "ord")))
    return j.groupBy("sig").agg(best.alias("b")).select("sig", F.col("b.ord").alias("ord"))


def detection_rate(trials: DataFrame) -> DataFrame:
    """The percentage of trials that detect each signal, and the count of errors; 0 where there are none."""
    return trials.groupBy("sig").agg(F.count(F.lit(1)).alias("trials"), F.count_if(~F.col("detected")).alias("misses"), ratio(100.0 * F.count_if("detected"), F.count(F.lit(1))).alias("rate"))


def confusion(rows: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """The four counts, precision, recall, F1 and accuracy; ratios without cases are 0."""
    a, p = actual, predicted
    counts = rows.agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"))
    c = F.col
    out = counts.withColumn("prec", ratio(c("tp") * 1.0, c("tp") + c("fp"))).withColumn("recall", ratio(c("tp") * 1.0, c("tp") + c("fn")))
    out = out.withColumn("f1", ratio(2.0 * c("prec") * c("recall"), c("prec") + c("recall")))
    return out.withColumn("accuracy", ratio((c("tp") + c("tn")) * 1.0, c("tp") + c("tn") + c("fp") + c("fn")))


def errors_of(rows: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """Mean squared error and its root."""
    return rows.agg(F.avg((actual - predicted) * (actual - predicted)).alias("mse")).withColumn("rmse", F.sqrt("mse"))


def flag_rules(verdicts: DataFrame) -> DataFrame:
    """Each byte judged to be flags gives one rule for each set bit of its mask."""
    return verdicts.filter("is_flags").select("can_id", "byte_idx", F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), b)) != 0)).alias("bit")).withColumn("bit_mask", F.expr("shiftleft(1, bit)"))


def loss_rate(steps: DataFrame) -> DataFrame:
    """Percent of sent frames that were not received, by step."""
    return steps.withColumn("loss_percent", F.when(F.col("n_sent") > 0, (1 - F.col("n_rcvd") / F.col("n_sent")) * 100).otherwise(0.0))


def buffer_limits(trials: DataFrame) -> DataFrame:
    """By buffer and rate the longest wait without loss and the shortest with loss."""
    return trials.groupBy("buffer_size", "frequency_hz").agg(F.max(F.when(~F.col("loss"), F.col("wait_ms"))).alias("max_safe_ms"), F.min(F.when(F.col("loss"), F.col("wait_ms"))).alias("min_lossy_ms"))


def auto_events(df: DataFrame, value: Column, threshold: float) -> DataFrame:
    """Frames where the value jumps by more than ``threshold`` from the identifier's frame before."""
    rows = previous(df.withColumn("value", value.cast("double")), {"prev": "value"})
    return rows.filter(F.abs(F.col("value") - F.col("prev")) > threshold)
