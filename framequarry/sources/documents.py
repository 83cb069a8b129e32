"""JSON documents: simulator, profile and mapper settings (S16), checkpoints (K14), linear models (K15), training rows (K18), publish messages (K10), and a traffic generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = "nodes array<struct<name: string, trigId: long, idMask: long, trigData: array<int>, dataMask: array<int>, respId: long, respData: array<int>, delayMs: long>>"


def parsed(texts: DataFrame, schema: str) -> DataFrame:
    """The JSON document of each row of column ``value``; what doesn't fit the schema is null."""
    return texts.select(F.from_json("value", schema).alias("d")).select("d.*")


def nodes_of(texts: DataFrame) -> DataFrame:
    """The nodes of simulator documents (column value), as match_nodes() takes them; masks default to all bits, the delay to 0."""
    rows = parsed(texts, NODE_SCHEMA).select(F.inline("nodes"))
    empty = F.array().cast("array<int>")
    return rows.select(F.col("name").alias("node"), F.col("trigId").alias("trig_id"), F.coalesce("idMask", F.lit(0x1FFFFFFF)).cast("long").alias("id_mask"), F.coalesce("trigData", empty).alias("trig_data"), F.coalesce("dataMask", F.transform(F.coalesce("trigData", empty), lambda x: F.lit(255))).alias("data_mask"), F.col("respId").alias("resp_id"), F.coalesce("respData", empty).alias("resp_data"), (F.coalesce("delayMs", F.lit(0)) * 1000).alias("delay_us"))


def profile_of(texts: DataFrame) -> DataFrame:
    """(module, can_id, period_ms, requires) of module profile documents."""
    return parsed(texts, "module string, ids array<struct<canId: long, periodMs: double, requires: array<long>>>").select("module", F.inline("ids")).select("module", F.col("canId").alias("can_id"), F.col("periodMs").alias("period_ms"), "requires")


def mapper_of(texts: DataFrame) -> DataFrame:
    """The signals of mapper documents as dictionary rows."""
    rows = parsed(texts, "signals array<struct<canId: long, name: string, startBit: int, length: int, littleEndian: boolean, signed: boolean, scale: double, offset: double, unit: string>>").select(F.inline("signals"))
    return rows.select(F.col("canId").alias("msg_id"), F.lit("mapper").alias("msg_name"), F.lit(8).alias("msg_dlc"), F.col("name").alias("sig_name"), F.col("startBit").alias("start_bit"), "length", F.coalesce("littleEndian", F.lit(True)).alias("little_endian"), F.coalesce("signed", F.lit(False)).alias("is_signed"), F.coalesce("scale", F.lit(1.0)).alias("scale"), F.coalesce("offset", F.lit(0.0)).alias("offset"), F.lit(0.0).alias("minimum"), F.lit(0.0).alias("maximum"), F.coalesce("unit", F.lit("")).alias("unit"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return nodes_of(spark.read.text(path, wholetext=True))


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    return profile_of(spark.read.text(path, wholetext=True))


def read_mapper(spark: SparkSession, path: str) -> DataFrame:
    return mapper_of(spark.read.text(path, wholetext=True))


def save_session(obs: DataFrame, path: str) -> None:
    """All observations of a session; load_session() gives all of them back."""
    obs.write.mode("overwrite").option("compression", "zstd").parquet(path)


def load_session(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def model_json(models: DataFrame) -> DataFrame:
    """One JSON a variable: its lines by identifier and byte, keys id << 8 | byte."""
    key = F.col("can_id") * 256 + F.col("byte_idx")
    rows = models.groupBy("variable").agg(F.sort_array(F.collect_list(F.struct(key.alias("key"), "slope", "intercept", "r"))).alias("models"))
    return rows.select("variable", F.to_json(F.struct("variable", "models")).alias("json"))


def training_rows(verdicts: DataFrame, truth: DataFrame) -> DataFrame:
    """One completion an identifier: flag bytes give a rule for each set bit, other bytes the true scale and offset (can_id, byte_idx, scale, offset)."""
    from framequarry.operators.diff import flag_rules

    none = F.lit(None)
    flags = flag_rules(verdicts).select("can_id", "byte_idx", F.col("bit_mask").cast("long").alias("bit_mask"), none.cast("double").alias("scale"), none.cast("double").alias("offset"))
    rest = truth.join(verdicts.filter("is_flags"), ["can_id", "byte_idx"], "left_anti").select("can_id", "byte_idx", none.cast("long").alias("bit_mask"), "scale", "offset")
    rules = flags.unionByName(rest).groupBy("can_id").agg(F.sort_array(F.collect_list(F.struct("byte_idx", "bit_mask", "scale", "offset"))).alias("rules"))
    return rules.select("can_id", F.to_json(F.struct("can_id", "rules")).alias("completion"))


def publish_messages(values: DataFrame) -> DataFrame:
    """The messages of published values (can_id, ts_us, value)."""
    return values.select(F.concat(F.lit("can/"), F.lower(F.hex("can_id"))).alias("topic"), F.to_json(F.struct("value", F.lit("").alias("unit"), F.col("ts_us").alias("timestamp"))).alias("payload"))


def synthetic_frames(spark: SparkSession, seed: int, n: int, ids: int = 8) -> DataFrame:
    """N frames of known make: byte 0 a counter, byte 1 a sine, byte 2 a step, byte 3 flags that toggle, byte 4 hashed noise, bytes 5 to 7 constant. Each row follows from its number and the seed."""
    k, c = F.col("id"), F.col("can_id")
    turn = F.floor(k / ids)
    noise = lambda salt, m: F.pmod(F.xxhash64(k, F.lit(seed), F.lit(salt)), F.lit(m))
    data = F.array(turn % 256, F.floor(127.5 + 120 * F.sin(turn / 16 + c)), F.when(turn % 64 < 32, 40).otherwise(200), noise(1, 2) + 4 * noise(2, 2) + 16 * noise(3, 2), noise(4, 256), F.lit(1), F.lit(2), F.lit(3)).cast("array<short>")
    off = F.lit(False)
    rows = spark.range(n).withColumn("can_id", F.lit(0x100) + k % ids)
    return rows.select(k.alias("frame_id"), F.lit(0).cast("long").alias("session_id"), (k * 1250).alias("ts_us"), "can_id", *(off.alias(x) for x in ("extended", "rtr", "error", "fd", "brs", "esi", "xl")), F.lit(8).cast("short").alias("dlc"), data.alias("data"))
