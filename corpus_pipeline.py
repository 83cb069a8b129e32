"""A corpus pipeline of five stages: quality rules, line dedup, near duplicates, decontamination, source mixing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the columns of documents
with its decisions applied; the last returns the mix. run() writes each stage's rows as Parquet and reads them again as the next
one's docs, in the shared folder that spark.checkpoint.dir names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.llm import decontam, linededup, mixing, ngramjoin, quality
from framequarry.llm.common import cut, read, released, remove, shared_dir, small_side


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified level reject go. Rows alike in doc_id, text and lang share their verdict.

    Null, empty and wordless texts go. Null doc_ids, null langs and clashing doc_ids are judged by their own text. Empty table: no rows. All columns stay.
    """
    judged = quality.judge(docs, read(spark, sf_dir, "labels")).filter("NOT kept")
    bad = small_side(cut(judged.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash"), F.col("stratum").alias("bad_stratum")).distinct()))
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (quality.text_hash(docs["text"]) == bad["bad_hash"]) & (quality.stratum(docs["lang"]) == bad["bad_stratum"])
    return docs.join(bad, same, "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents go from all; every document stays, n_chars follows the text.

    Null text becomes the empty one. Each row is a document, whatever its doc_id. Empty table: no rows. Other columns stay.
    """
    done = linededup.dedup_lines(docs).drop("n_lines", "n_dropped")
    return done.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the smallest doc_id (null last), of its texts one. Rows are told apart by doc_id and text.

    Null, empty and wordless texts are nobody's copies; of rows alike in doc_id and text one stays. Null and clashing doc_ids pull no other
    text out. Empty table: no rows. All columns stay.
    """
    rows = cut(ngramjoin.join(docs, keys=True).filter("n_shingles > 0").select("doc_id", "text_hash", "component"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    groups = rows.groupBy("component").agg(F.min(order).alias("best"), F.max(order).alias("other")).filter("NOT best <=> other")
    gone = rows.join(small_side(cut(groups.select("component", "best.text_hash"))).withColumnRenamed("text_hash", "stays"), "component").filter("text_hash <> stays")
    gone = small_side(cut(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()))
    left = docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (ngramjoin.row_hash(docs) == gone["gone_hash"]), "left_anti")
    again = left.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("again_id"))
    return _first_of_equal_ids(left, small_side(cut(again)))


def _first_of_equal_ids(docs: DataFrame, again: DataFrame) -> DataFrame:
    """docs without repeats of a row: of rows alike in doc_id and text one stays. Only doc_ids that occur twice are looked at."""
    twice = docs["doc_id"].eqNullSafe(again["again_id"])
    return docs.join(again, twice, "left_anti").unionByName(docs.join(again, twice, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go. Null and empty texts hold none; rows are told apart by doc_id and text. Empty table: no rows. All columns stay."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): the words that the mix takes of each document left. Null and empty texts have size 0, null is a source of its own. Empty table: no rows."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: The binomial bounds and the components aren't practical as one statement; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's checkpoints and its input go once its rows are written; the last stage's rows stay, since the result reads them."""
    shared_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with released(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs
