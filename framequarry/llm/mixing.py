"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framequarry.llm.common import cut, null_key, words


def targets(sizes: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """(skey, source_size, target) from (skey, size): one row a source.

    Sources in code point order get the weights in turn and share the total; a source at most ``epochs`` times its size,
    and what that leaves is shared again by weight. With sources sorted by cap a weight the capped ones are a prefix, so
    running sums over the source table (one row a source) give the fixed point without a loop.
    """
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy("skey")) - 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * epochs).withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    upto, everything = Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    per = per.select(
        "*", F.sum("source_size").over(everything).alias("total"), F.sum("w").over(everything).alias("all_w"),
        (F.sum("cap").over(upto) - F.col("cap")).alias("cap_before"), (F.sum("w").over(upto) - F.col("w")).alias("w_before"),
    )
    share = (F.col("total") - F.col("cap_before")).cast("double") / (F.col("all_w") - F.col("w_before"))
    per = per.withColumn("full", share > F.col("ratio"))
    per = per.select("*", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything).alias("full_cap"), F.sum(F.when(F.col("full"), F.col("w")).otherwise(0)).over(everything).alias("full_w"))
    free = (F.col("total") - F.col("full_cap")).cast("double") * F.col("w") / (F.col("all_w") - F.col("full_w"))
    return per.select("skey", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(free, F.col("cap").cast("double"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, digits: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): the words that a mix of ``docs`` takes from each document.

    Documents of a source stand in the order of md5(doc_id), so reruns agree. The first ``digits`` hex digits cut that
    order into ranges: ranges are summed, the few range sums of a source give each range's offset, and a window inside
    (source, range) gives the rest. A hot source is thus spread over 16 ** digits groups of like size. A source's budget is
    its target rounded down; whole epochs take every document, the last part of an epoch takes the order's head, and the
    document at the cut gives only the words that the budget still lacks.

    Null or empty text: size 0, nothing taken. Null source: a source of its own, last in order. Null doc_id: one key for
    all such rows. Repeated rows count as often as they stand; rows alike in key, id and size are interchangeable. Empty
    table: no rows. Other columns are ignored.
    """
    narrow = cut(
        docs.select(
            F.col("doc_id"), F.col("source"), null_key(F.col("source")).alias("skey"),
            F.size(words(F.col("text"))).cast("long").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
        ).withColumn("range", F.substring("key", 1, digits))
    )
    sums = narrow.groupBy("skey", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    offsets = sums.withColumn("offset", F.sum("range_size").over(before) - F.col("range_size")).join(targets(sums.withColumnRenamed("range_size", "size"), weights, epochs), "skey").drop("range_size")
    inside = Window.partitionBy("skey", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = narrow.withColumn("upto", F.sum("size").over(inside)).join(offsets, ["skey", "range"])
    budget = F.col("target").cast("long")
    placed = placed.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("cast(target as bigint) div source_size")).otherwise(F.lit(0).cast("long")))
    left = budget - F.col("whole") * F.col("source_size") - (F.col("offset") + F.col("upto") - F.col("size"))
    taken = F.col("whole") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM s),
c AS (SELECT *, cap::DOUBLE / w AS ratio, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
        sum(cap) OVER o - cap AS cap_before, sum(w) OVER o - w AS w_before
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, (total - cap_before)::DOUBLE / (all_w - w_before) > ratio AS is_full FROM c),
g AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS full_cap, sum(CASE WHEN is_full THEN w ELSE 0 END) OVER () AS full_w FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE least((total - full_cap)::DOUBLE * w / (all_w - full_w), cap::DOUBLE) END AS target FROM g),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
        (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM p)
SELECT doc_id, size, source_size, target,
  (whole * size + greatest(0, least(size, budget - whole * source_size - before)))::BIGINT AS taken
FROM e
"""
