"""The registered queries of the training-data operators: thin, whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.llm import chat, decontam, htmlextract, langid, linededup, mixing, ngramjoin, quality, secrets, substring
from framequarry.llm.common import cut, read


def op1_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return langid.identify(read(spark, sf_dir, "documents"), held_out)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "links")


def op5_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.extract(read(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("text_hash").distinct()


def op7_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secrets.BASE]
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = secrets.span_text(F.filter("found", lambda x: x["kind"].isin(kinds)))
    return found.select("doc_id", *map(count, kinds), F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.span_text(F.col("found")).alias("spans"))


def op8_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    made = cut(chat.chats(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = made.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(said_all).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op9_dedup_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(read(spark, sf_dir, "documents")).drop("text_hash")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    f.__name__: f
    for f in (
        op1_identify_language, op2_mix_sources, op3_dedup_lines, op4_ngram_join, op5_extract_html,
        op6_decontaminate, op7_scan_secrets, op8_format_chats, op9_dedup_substrings, op10_quality_rules,
    )
}
ORACLE_SQL = {
    "op2_mix_sources": mixing.MIXING_SQL,
    "op3_dedup_lines": linededup.LINES_SQL,
    "op4_ngram_join": ngramjoin.NGRAM_SQL,
    "op8_format_chats": chat.CHAT_SQL,
}
