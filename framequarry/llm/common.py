"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.checkpoints import cut, released, remove, shared_dir, small_side  # noqa: F401

#: White space of every contract: blank and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches of texts, which Spark bounds by bytes, in slices of few rows, so that what Python makes of a slice stays small too."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for the row, also where body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; none of null."""
    blank = F.trim(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)))
    return F.when(blank == "", F.array().cast("array<string>")).otherwise(F.split(blank, " +"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def null_key(col: Column) -> Column:
    """A string key that is never null and sorts as col does by code point, null last."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("~"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns whose names an operator's own output takes, in any case."""
    taken = {n.lower() for n in names}
    return df.drop(*(c for c in df.columns if c.lower() in taken))
