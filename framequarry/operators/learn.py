"""Association mining over observations: correlations, information, sequences, linear models, candidates.

Observations are (variable, obs_id, ts_us, value); their frames come by a bucketed range join and are averaged per byte, after which all is
grouped aggregation in long form. The noisy bytes are an anti join.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry.functions.signals import cosine
from framequarry.operators.diff import interval_join
from framequarry.operators.ordered import carried, position
from framequarry.operators.profile import auto_increment, cyclic_noise, ratio, zero
from framequarry.schema import bytes_long, payload_bytes, seq_order


def observation_bytes(df: DataFrame, obs: DataFrame, before_us: int, after_us: int, n_bytes: int | None = None) -> DataFrame:
    """(variable, obs_id, value, can_id, byte_idx, avg_byte): each byte's mean over the frames around an observation, rounded down; frames without the byte count as 0.

    There are as many bytes as the recording's longest payload has, 8 at least and 64 at most.
    """
    n_bytes = n_bytes or payload_bytes(df)
    points = obs.withColumnRenamed("ts_us", "at_us")
    near = interval_join(df.select("frame_id", "ts_us", "can_id", "data"), points, before_us, after_us)
    sums = near.groupBy("variable", "obs_id", "value", "can_id").agg(*(F.floor(F.sum(F.coalesce(F.get("data", F.lit(i)), F.lit(0)).cast("long")) / F.count(F.lit(1))).cast("int").alias(f"b{i}") for i in range(n_bytes)))
    return sums.select("variable", "obs_id", "value", "can_id", F.posexplode(F.array(*(f"b{i}" for i in range(n_bytes)))).alias("byte_idx", "avg_byte"))


def frequent_ids(obs_bytes: DataFrame) -> DataFrame:
    """(variable, can_id) present in at least max(3, half) of the variable's observations."""
    n = obs_bytes.groupBy("variable").agg(F.countDistinct("obs_id").alias("n_obs"))
    seen = obs_bytes.groupBy("variable", "can_id").agg(F.countDistinct("obs_id").alias("n_seen"))
    return seen.join(n, "variable").filter(F.col("n_seen") >= F.greatest(F.lit(3), F.expr("n_obs div 2"))).select("variable", "can_id")


def usable(obs_bytes: DataFrame, df: DataFrame) -> DataFrame:
    """The bytes of frequent identifiers that neither count nor flicker."""
    noisy = auto_increment(df).select("can_id", "byte_idx").unionByName(cyclic_noise(df).select("can_id", "byte_idx")).distinct()
    return obs_bytes.join(frequent_ids(obs_bytes), ["variable", "can_id"], "left_semi").join(noisy, ["can_id", "byte_idx"], "left_anti")


def correlation(x: str, y: str) -> Column:
    """r from the covariance, null where a side is constant (corr itself fails there under ANSI arithmetic)."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def pearson(x: str, y: str) -> Column:
    """Pearson's r; 0 for constant sides or fewer than three points."""
    return F.when((F.count(x) < 3) | (F.stddev_pop(x) < 1e-9) | (F.stddev_pop(y) < 1e-9), F.lit(0.0)).otherwise(correlation(x, y))


def byte_correlations(obs_bytes: DataFrame) -> DataFrame:
    """R between each byte and its variable, by falling |r| (O05: ties by identifier, then byte)."""
    x = obs_bytes.withColumn("x", F.col("avg_byte").cast("double"))
    out = x.groupBy("variable", "can_id", "byte_idx").agg(F.count(F.lit(1)).alias("n"), pearson("x", "value").alias("r"))
    return out.orderBy("variable", F.desc(F.abs("r")), "can_id", "byte_idx")


def online_correlations(obs_bytes: DataFrame) -> DataFrame:
    """The same r from running sums, which a stream can keep as state."""
    x, y = F.col("avg_byte").cast("double"), F.col("value")
    s = obs_bytes.groupBy("variable", "can_id", "byte_idx").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    c = F.col
    vx, vy = c("n") * c("sxx") - c("sx") * c("sx"), c("n") * c("syy") - c("sy") * c("sy")
    return s.select("variable", "can_id", "byte_idx", "n", F.when((c("n") < 3) | (vx <= 1e-9) | (vy <= 1e-9), F.lit(0.0)).otherwise((c("n") * c("sxy") - c("sx") * c("sy")) / F.sqrt(vx * vy)).alias("r"))


def cross_bytes(obs_bytes: DataFrame, ids: Column | None = None) -> DataFrame:
    """R between bytes of the same observations, both orders, constant bytes left out. Joined on the observation, so a byte meets only those seen with it:
    an observation's bytes squared, which identifiers and payload bound. The matrix is what is asked for."""
    a = obs_bytes if ids is None else obs_bytes.filter(ids)
    b = a.select("variable", "obs_id", F.col("can_id").alias("id2"), F.col("byte_idx").alias("byte2"), F.col("avg_byte").cast("double").alias("y"))
    j = a.withColumn("x", F.col("avg_byte").cast("double")).join(b, ["variable", "obs_id"])
    out = j.groupBy("variable", "can_id", "byte_idx", "id2", "byte2").agg(F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), correlation("x", "y").alias("r"))
    return out.filter("n >= 3 AND vx >= 1e-9 AND vy >= 1e-9").drop("vx", "vy")


def variable_matrix(obs: DataFrame) -> DataFrame:
    """R between variables over their common prefix of observations, diagonal included."""
    rows = position(obs.withColumn("frame_id", F.col("obs_id")), "k", ["variable"]).drop("frame_id")
    b = rows.select("k", F.col("variable").alias("variable2"), F.col("value").alias("value2"))
    return rows.join(b, "k").groupBy("variable", "variable2").agg(F.count(F.lit(1)).alias("n"), pearson("value", "value2").alias("r"))


def discover(obs_bytes: DataFrame, df: DataFrame, recent_us: int = 2_000_000) -> DataFrame:
    """Bytes with n >= 5 and |r| >= 0.5 among identifiers seen at the recording's end."""
    last = df.agg(F.max("ts_us").alias("last"))
    alive = df.join(F.broadcast(last), F.col("ts_us") >= F.col("last") - recent_us).select("can_id").distinct()
    return byte_correlations(obs_bytes.join(alive, "can_id", "left_semi")).filter("n >= 5 AND abs(r) >= 0.5")


def mutual_information(obs_bytes: DataFrame, bins: int | Column = 10, extra: list[str] | None = None, grids: Column | None = None) -> DataFrame:
    """Mutual information in nats of each byte and its variable over equal-width bins of both."""
    byte = ["variable", "can_id", "byte_idx"]
    key = [*byte, *(extra or [])]
    w = Window.partitionBy(*key)  # over the cells, at most bins squared a key
    n = F.lit(bins) if isinstance(bins, int) else bins
    x = obs_bytes.withColumn("x", F.col("avg_byte").cast("double"))
    bounds = x.groupBy(*byte).agg(*(f(c).alias(f"{name}_{c}") for c in ("x", "value") for name, f in (("lo", F.min), ("hi", F.max))))

    def cell(c: str) -> Column:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        return F.least(n - 1, F.floor((F.col(c) - lo) / (hi - lo + 1e-9) * n)).cast("int")

    # Equal pairs are counted first, so grids are laid over pairs and not over rows.
    pairs = x.groupBy(*byte, "x", "value").agg(F.count(F.lit(1)).alias("m")).join(bounds, byte)
    joint = (pairs if grids is None else pairs.withColumn("g", grids)).select(*key, cell("x").alias("i"), cell("value").alias("j"), "m").groupBy(*key, "i", "j").agg(F.sum("m").alias("c"))
    total = F.sum("c").over(w).cast("double")
    p, px, py = F.col("c") / total, F.sum("c").over(Window.partitionBy(*key, "i")) / total, F.sum("c").over(Window.partitionBy(*key, "j")) / total
    return joint.withColumn("term", p * F.log(p / (px * py))).groupBy(*key).agg(F.sum("c").alias("n"), F.sum("term").alias("mi"))


def maximal_information(obs_bytes: DataFrame, most: int = 8) -> DataFrame:
    """The greatest of MI / ln g over grids of g = 2 to ``most`` bins a side."""
    each = mutual_information(obs_bytes, F.col("g"), ["g"], F.explode(F.sequence(F.lit(2), F.lit(most))))
    return each.groupBy("variable", "can_id", "byte_idx").agg(F.max("n").alias("n"), F.max(F.col("mi") / F.log(F.col("g").cast("double"))).alias("mic"))


def linear_models(obs_bytes: DataFrame, least: float = 0.8) -> DataFrame:
    """value = slope * byte + intercept where |r| >= ``least``."""
    x = obs_bytes.withColumn("x", F.col("avg_byte").cast("double"))
    slope = F.covar_pop("x", "value") / F.nullif(F.var_pop("x"), F.lit(0.0))
    out = x.groupBy("variable", "can_id", "byte_idx").agg(F.count(F.lit(1)).alias("n"), pearson("x", "value").alias("r"), slope.alias("slope"), (F.avg("value") - slope * F.avg("x")).alias("intercept"))
    return out.filter(F.abs("r") >= least)


def predict(models: DataFrame, df: DataFrame) -> DataFrame:
    """Each model's value on the last frame of its identifier."""
    last = df.groupBy("can_id").agg(F.max_by("data", F.struct(*seq_order())).alias("data"))
    byte = F.coalesce(F.element_at(F.transform("data", lambda x: x.cast("double")), (F.col("byte_idx") + 1).cast("int")), F.lit(0.0))
    return models.join(last, "can_id").withColumn("predicted", F.col("slope") * byte + F.col("intercept")).drop("data")


def lag_correlations(obs_bytes: DataFrame, most: int = 10) -> DataFrame:
    """R of the k-th observation's byte with the variable ``byte_leads_by`` observations later, lags -most to most, n >= 5 and |r| > 0.3; bytes not seen read 0."""
    obs = carried(obs_bytes.select("variable", "obs_id", "value").distinct(), ["variable"], {"_n": (F.count(F.lit(1)), F.sum)}, F.expr("obs_id div 1048576"))
    obs = obs.withColumn("k", F.coalesce("_n", F.lit(0)) + F.row_number().over(Window.partitionBy("variable", "_chunk").orderBy("obs_id"))).drop("_chunk", "_n")
    cells = obs_bytes.select("variable", "can_id", "byte_idx").distinct().join(obs, "variable")
    full = cells.join(obs_bytes.select("variable", "obs_id", "can_id", "byte_idx", "avg_byte"), ["variable", "obs_id", "can_id", "byte_idx"], "left").withColumn("x", F.coalesce("avg_byte", F.lit(0)).cast("double"))
    shifted = full.withColumn("byte_leads_by", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("k2", F.col("k") + F.col("byte_leads_by"))
    later = obs.select("variable", F.col("k").alias("k2"), F.col("value").alias("y"))
    out = shifted.join(later, ["variable", "k2"]).groupBy("variable", "can_id", "byte_idx", "byte_leads_by").agg(F.count(F.lit(1)).alias("n"), pearson("x", "y").alias("r"))
    return out.filter("n >= 5 AND abs(r) > 0.3")


def weighted_pearson(obs_bytes: DataFrame, decay: float, now_us: Column) -> DataFrame:
    """R with weights exp(-decay * age in seconds)."""
    w, x, y = F.exp(-decay * (now_us - F.col("ts_us")) / 1e6), F.col("avg_byte").cast("double"), F.col("value")
    s = obs_bytes.groupBy("variable", "can_id", "byte_idx").agg(F.count(F.lit(1)).alias("n"), *(F.sum(e).alias(a) for a, e in (("sw", w), ("sx", w * x), ("sy", w * y), ("sxx", w * x * x), ("syy", w * y * y), ("sxy", w * x * y))))
    c = F.col
    mx, my = c("sx") / c("sw"), c("sy") / c("sw")
    vx, vy = c("sxx") / c("sw") - mx * mx, c("syy") / c("sw") - my * my
    return s.select("variable", "can_id", "byte_idx", "n", F.when((c("n") < 3) | (vx < 1e-9) | (vy < 1e-9), F.lit(0.0)).otherwise((c("sxy") / c("sw") - mx * my) / F.sqrt(vx * vy)).alias("r"))


def window_width(before_us: int, after_us: int) -> int:
    return max(1, before_us + after_us)


def event_chunk(x: Column, before_us: int, after_us: int) -> Column:
    """The chunk of an event's time; a chunk is as long as a window."""
    return F.floor(x / window_width(before_us, after_us))


def near_chunks(df: DataFrame, before_us: int, after_us: int) -> DataFrame:
    """df with _chunk: each frame once for each chunk with times of events whose window may hold it, two as a rule. So an event finds all frames of its window in its own chunk."""
    b = lambda x: event_chunk(x, before_us, after_us)
    return df.withColumn("_chunk", F.explode(F.sequence(b(F.col("ts_us") - after_us), b(F.col("ts_us") + before_us))))


def window_edges(before_us: int, after_us: int) -> Column:
    """Both ends of an event's window as rows (t, kind) that sort right before its first and right after its last frame, if frames have kind 1."""
    end = lambda t, kind: F.struct(t.cast("long").alias("t"), F.lit(kind).alias("kind"))
    return F.inline(F.array(end(F.col("at_us") - before_us, 0), end(F.col("at_us") + after_us, 2)))


def marked_events(df: DataFrame, events: DataFrame, before_us: int, after_us: int, least: int = 3) -> DataFrame:
    """The events (event_id, at_us and more) with at least ``least`` frames in their windows.

    The count is the difference of the running counts of frames at the window's two ends, so events and frames are sorted together and no pair is formed.
    """
    marks = events.select("event_id", event_chunk(F.col("at_us"), before_us, after_us).alias("_chunk"), window_edges(before_us, after_us))
    rows = near_chunks(df.select("ts_us"), before_us, after_us).select(F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"), "_chunk", F.col("ts_us").alias("t"), F.lit(1).alias("kind"))
    so_far = F.count_if(F.col("kind") == 1).over(Window.partitionBy("_chunk").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0))
    n = marks.unionByName(rows).withColumn("n", so_far).filter("kind <> 1").groupBy("event_id").agg(F.sum((F.col("kind") - 1) * F.col("n")).alias("n")).filter(F.col("n") >= least)
    return events.join(n.select(F.col("event_id").alias("_id")), F.col("event_id").eqNullSafe(F.col("_id")), "left_semi")


def event_frames(df: DataFrame, events: DataFrame, before_us: int, after_us: int) -> DataFrame:
    """The frames of each event's window (event_id, label, at_us), of events with at least 3 frames. Events are chosen beforehand, so pairs are neither shuffled nor sorted."""
    return window_pairs(df, marked_events(df, events, before_us, after_us), before_us, after_us)


#: Frames of a block of window_pairs, frames that a task gets of them, and tasks at most.
BLOCK, DEALT, TASKS = 128, 1 << 14, 1 << 15


def window_pairs(df: DataFrame, events: DataFrame, before_us: int, after_us: int) -> DataFrame:
    """(frame columns, event columns) of the frames in each event's window, as ``interval_join`` has them, in an order that takes little room in a file.

    Events are joined with blocks of frames that follow each other in time, and the blocks opened behind the join. So an event's rows come in runs, a
    block's frames repeat for each event, and a task has few of both, so that a Parquet dictionary holds them. All pairs come, in blocks or on their edges.
    """
    width = max(1, (before_us + after_us) // 4)
    b = lambda x: F.floor(x / width)
    first, last = F.col("at_us") - before_us, F.col("at_us") + after_us
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, min(df.count() // DEALT, TASKS))
    number = F.row_number().over(Window.partitionBy("_b").orderBy(*seq_order()))
    rows = df.withColumn("_b", b(F.col("ts_us"))).filter("_b IS NOT NULL").repartition(tasks, "_b").withColumn("_block", F.floor((number - 1) / BLOCK))
    blocks = rows.groupBy("_b", "_block").agg(F.min("ts_us").alias("_lo"), F.max("ts_us").alias("_hi"), F.collect_list(F.struct(*df.columns)).alias("_frames"))
    wide = events.withColumn("_b", F.explode(F.sequence(b(first), b(last))))
    pairs = blocks.join(wide, "_b").filter((F.col("_lo") <= last) & (F.col("_hi") >= first)).select(*events.columns, F.inline("_frames"))
    return pairs.filter(F.col("ts_us").between(first, last)).select(*df.columns, *events.columns)


def adaptive_window(df: DataFrame) -> DataFrame:
    """3 mean intervals, held between 0.1 and 2 seconds, as (before_us, after_us = before / 3)."""
    mean = (F.max("ts_us") - F.min("ts_us")) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))
    return df.agg(F.least(F.lit(2e6), F.greatest(F.lit(1e5), 3 * mean)).cast("long").alias("before_us")).withColumn("after_us", F.expr("before_us div 3"))


def event_features(df: DataFrame, events: DataFrame, before_us: int, after_us: int, n_bytes: int | None = None) -> DataFrame:
    """Per event (event_id is a key) with at least 3 frames and identifier the vector (count, mean interval ms, deviation ms, byte means / 255) as an array of doubles, with as many bytes as the longest payload has, 8 at least and 64 at most.

    All of it follows from running sums of the identifier's frames at both ends of the window: counts, bytes and squared intervals are differences, the
    sum of intervals is the time from first to last frame, and the interval that leads into the window is taken off. Sums are exact (longs and decimals).
    The rows are frames (twice) and two a result row instead of all frames of all windows.
    """
    n_bytes = n_bytes or payload_bytes(df)
    frames = near_chunks(df, before_us, after_us)
    values = [f"b{i}" for i in range(n_bytes)]
    marks = marked_events(df, events, before_us, after_us).select("event_id", "label", "at_us", event_chunk(F.col("at_us"), before_us, after_us).alias("_chunk"))
    marks = marks.join(frames.select("_chunk", "can_id").distinct(), "_chunk").select("event_id", "label", "can_id", "_chunk", window_edges(before_us, after_us))
    rows = frames.select("can_id", "_chunk", F.col("ts_us").alias("t"), F.lit(1).alias("kind"), "frame_id", F.col("ts_us").alias("at"), *(F.coalesce(F.get("data", F.lit(i)), F.lit(0)).cast("long").alias(c) for i, c in enumerate(values)))
    order = Window.partitionBy("can_id", "_chunk").orderBy("t", "kind", "frame_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    square = lambda x: x.cast("decimal(19,0)") * x.cast("decimal(19,0)")
    c = F.col
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("before", F.max("at").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("next", F.expr("lead(at) IGNORE NULLS OVER (PARTITION BY can_id, _chunk ORDER BY t, kind, frame_id)"))
    both = both.withColumn("square", square(c("at") - c("before")))
    sums = both.select("event_id", "label", "can_id", "_chunk", "kind", "before", "next", F.count("at").over(so_far).alias("n"), F.sum("square").over(so_far).alias("q"), *(F.sum(v).over(so_far).alias(v) for v in values)).filter("kind <> 1")
    within = lambda x: F.sum((c("kind") - 1) * F.coalesce(x, F.lit(0)))
    at_end = lambda kind, x: F.max(F.when(c("kind") == kind, c(x)))
    out = sums.groupBy("can_id", "_chunk", "event_id", "label").agg(within(c("n")).alias("n"), within(c("q")).alias("q"), at_end(0, "before").alias("before"), at_end(0, "next").alias("first"), at_end(2, "before").alias("last"), *(within(c(v)).alias(v) for v in values)).filter("n > 0")
    out = out.withColumn("m", c("n") - 1).withColumn("span", c("last") - c("first")).withColumn("q", c("q") - F.coalesce(square(c("first") - c("before")), F.lit(0)))
    some = lambda x: F.when(c("m") > 0, x).otherwise(F.lit(0.0))
    spread = (c("m").cast("decimal(19,0)") * c("q") - square(c("span"))).cast("double") / (c("m").cast("double") * c("m"))
    return out.select("event_id", "label", "can_id", F.array(c("n").cast("double"), some(c("span") / c("m") / 1000), some(F.sqrt(spread) / 1000), *(c(v) / c("n") / 255 for v in values)).alias("vec"))


def candidates(features: DataFrame) -> DataFrame:
    """Identifiers of all positive events, by mean pairwise cosine over those times (1 - half the mean cosine to negative ones). features has one row an event and identifier.

    Of vectors of length 1 the mean over all pairs follows from their sum: the square of its length less one for each vector, over the
    pairs. So no pair is formed; a vector without length counts as cosine 0.
    """
    n = features.filter("label").agg(F.countDistinct("event_id").alias("n_events"))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.when(length < 1e-6, F.transform("vec", lambda x: x * 0.0)).otherwise(F.transform("vec", lambda x: x / length))
    parts = features.select("can_id", "label", F.posexplode(unit).alias("dim", "u"))
    side = lambda own: (F.sum(F.when(own, F.col("u"))).alias, F.sum(F.when(own, F.col("u") * F.col("u"))).alias, F.count_if(own).alias)
    (ps, pq, pn), (ns, _, nn) = side(F.col("label")), side(~F.col("label"))
    sums = parts.groupBy("can_id", "dim").agg(ps("ps"), pq("pq"), pn("pn"), ns("ns"), nn("nn"))
    out = sums.groupBy("can_id").agg(F.sum(F.col("ps") * F.col("ps")).alias("pp"), F.sum("pq").alias("pq"), F.max("pn").alias("pn"), F.sum(F.col("ps") * F.col("ns")).alias("pns"), F.max("nn").alias("nn")).crossJoin(F.broadcast(n)).filter("pn = n_events AND pn >= 2")
    out = out.select("can_id", ((F.col("pp") - F.col("pq")) / (F.col("pn") * (F.col("pn") - 1))).alias("same"), (F.col("pns") / F.nullif(F.col("pn") * F.col("nn"), F.lit(0))).alias("diff"))
    return out.withColumn("score", F.col("same") * (1 - 0.5 * F.coalesce("diff", F.lit(0.0))))


def sequences(df: DataFrame, events: DataFrame, before_us: int, after_us: int, n: int) -> DataFrame:
    """Runs of n identifiers inside event windows; confidence is the count over the events, so it may exceed 1. Events have at least 3 frames.

    A run of n frames in a row is cut once from all frames; the events whose windows hold it lie between its last frame less ``after_us`` and its
    first plus ``before_us``, and are counted as a difference of running counts. So no frame is repeated for each event.
    """
    marked = marked_events(df, events, before_us, after_us)
    order = Window.partitionBy("_chunk").orderBy(*seq_order())
    ahead = lambda c, i: F.lead(c, i).over(order) if i else F.col(c)
    runs = near_chunks(df.select("ts_us", "frame_id", "can_id"), before_us, after_us).select("_chunk", F.array(*(ahead("can_id", i) for i in range(n))).alias("g"), F.col("ts_us").alias("first"), ahead("ts_us", n - 1).alias("last"))
    runs = runs.filter((F.col("last") - F.col("first") <= before_us + after_us) & F.forall("g", lambda x: x.isNotNull()))
    end = lambda t, kind: F.struct(t.cast("long").alias("t"), F.lit(kind).alias("kind"))
    ends = runs.select("_chunk", "g", F.inline(F.array(end(F.col("last") - after_us, 0), end(F.col("first") + before_us, 2))))
    points = marked.select(event_chunk(F.col("at_us"), before_us, after_us).alias("_chunk"), F.col("at_us").cast("long").alias("t"), F.lit(1).alias("kind"))
    so_far = F.count_if(F.col("kind") == 1).over(Window.partitionBy("_chunk").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0))
    out = ends.unionByName(points, allowMissingColumns=True).withColumn("n", so_far).filter("kind <> 1").groupBy("g").agg(F.sum((F.col("kind") - 1) * F.col("n")).alias("n")).filter("n > 0")
    events_n = marked.agg(F.countDistinct("event_id").alias("events"))
    return out.crossJoin(F.broadcast(events_n)).select(F.array_join(F.transform("g", lambda x: F.hex(x)), "→").alias("seq"), "n", (F.col("n") / F.col("events")).alias("confidence"))


def normal_model(features: DataFrame) -> DataFrame:
    """One row of means and deviations of the window features; empty under 10 windows."""
    names = ("frames", "ids", "entropy", "duration_ms")
    return features.agg(F.count(F.lit(1)).alias("windows"), *(x for c in names for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")))).filter("windows >= 10")


def anomaly_score(features: DataFrame, model: DataFrame) -> DataFrame:
    """The sum of squared z-scores of each window; features without spread are left out."""
    names = ("frames", "ids", "entropy", "duration_ms")
    z = sum((F.when(F.col(f"s_{c}") > 1e-9, F.pow((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}"), 2)).otherwise(0.0) for c in names[1:]), F.when(F.col("s_frames") > 1e-9, F.pow((F.col("frames") - F.col("m_frames")) / F.col("s_frames"), 2)).otherwise(0.0))
    return features.crossJoin(F.broadcast(model)).select("win", z.alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors (vec_id, embedding) of each query by cosine, itself excluded; ties by vec_id.

    The query set is stated by the caller. Spark broadcasts the queries if their size allows and deals both sides in blocks otherwise; each
    task keeps k of its vectors a query before the shuffle (a ranked window), and the norms are taken once a vector.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), norm("embedding").alias("qn"))
    dot = F.aggregate(F.zip_with("embedding", "q", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v = vectors.select("vec_id", "embedding", norm("embedding").alias("vn"))
    scored = v.join(q, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(ratio(dot, F.col("vn") * F.col("qn")), 6).alias("cosine"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))).filter(F.col("rank") <= k)


def matrix_cosine(features: DataFrame) -> DataFrame:
    """Cosine between the byte-mean vectors of every two identifiers: the matrix is the result, one row an identifier goes in."""
    b = features.select(F.col("can_id").alias("id2"), F.col("vec").alias("vec2"))
    return features.crossJoin(b).select("can_id", "id2", cosine(F.col("vec"), F.col("vec2")).alias("cosine"))


def byte_means(df: DataFrame, n_bytes: int | None = None) -> DataFrame:
    """The mean of each byte of an identifier, as many as the longest payload has, 8 at least and 64 at most."""
    return df.groupBy("can_id").agg(F.array(*(F.avg(F.coalesce(F.get("data", F.lit(i)), F.lit(0)).cast("double")) for i in range(n_bytes or payload_bytes(df)))).alias("vec"))


def mask_accuracy(rows: DataFrame) -> DataFrame:
    """Of bytes with true flag bits, how many masks the predicted bits (can_id, byte_idx, bit, truth, predicted) give exactly, pure (all bits flags) and mixed bytes apart."""
    bit = F.call_function("shiftleft", F.lit(1), F.col("bit").cast("int"))
    m = rows.groupBy("can_id", "byte_idx").agg(F.bit_or(F.when(F.col("truth"), bit).otherwise(0)).alias("t"), F.bit_or(F.when(F.col("predicted"), bit).otherwise(0)).alias("p"), F.count(F.lit(1)).alias("bits"))
    kind = F.when(F.bit_count("t") == F.col("bits"), "pure").otherwise("mixed")
    return m.filter("t <> 0").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") == F.col("p")).alias("exact"))


def fenced_json(text: Column) -> Column:
    """The JSON inside a text, in a code fence or bare."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1))


def observations(df: DataFrame, variable: str, every: int, value: Column) -> DataFrame:
    """Observations taken from a recording: each ``every``-th frame reads the variable from its bytes."""
    return df.filter(F.col("frame_id") % every == 0).select(F.lit(variable).alias("variable"), F.col("frame_id").alias("obs_id"), "ts_us", value.cast("double").alias("value"))


def long_bytes_of_frames(df: DataFrame, variable: str, value: Column) -> DataFrame:
    """Each frame as an observation of its own bytes, to relate bytes of one identifier to a value in the same frame."""
    v = df.select("frame_id", value.cast("double").alias("value"))
    return bytes_long(df).join(v, "frame_id").select(F.lit(variable).alias("variable"), F.col("frame_id").alias("obs_id"), "ts_us", "value", "can_id", "byte_idx", F.col("byte_val").alias("avg_byte"))


def p_value(r: float, n: int) -> float:
    """The two-sided p of Pearson's r, from the regularised incomplete beta function by its continued fraction; 1 under three points, 0 at |r| = 1."""
    import math

    if n < 3 or r != r:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    a, b, x = df / 2, 0.5, 1 - r * r
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    # Lentz's method; each pair of coefficients adds about a digit.
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    value = front * h / a
    return 1 - value if flip else value


def p_values(correlations: DataFrame) -> DataFrame:
    """Correlations with their p. One row a byte is left here, so an Arrow UDF is cheap."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([p_value(float(a), int(b)) for a, b in zip(r, n)], dtype=float)

    return correlations.withColumn("p", p("r", "n"))
