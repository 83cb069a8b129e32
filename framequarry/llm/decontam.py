"""Benchmark decontamination by spaced seeds: masked hashes join, substitution-tolerant windows decide."""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.llm.common import cut, let, small_side

#: Mask pairs, heaviest first where they hold: token offsets that each mask reads; the offsets between them may differ.
FAMILIES = (
    ((0, 1, 6, 7, 9), (0, 4, 6, 11, 12)),
    ((0, 1, 2, 3, 5), (0, 1, 4, 7, 8)),
    ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5)),
    ((0, 1, 2, 3), (0, 1, 2, 4)),
    ((0, 1, 2, 3), (0, 1, 3, 4)),
    ((0, 1, 2), (0, 1, 3)),
)
#: Letters of scripts written without blanks (Thai, Lao, Myanmar, Khmer, Han, kana): each is a token of its own.
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3041-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9D\x{20000}-\x{3FFFF}]"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, and single letters of scripts without blanks; none of null."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    spaced = F.when((F.octet_length(lower) > F.length(lower)) & lower.rlike(UNSPACED), F.regexp_replace(lower, f"({UNSPACED})", " $1 ")).otherwise(lower)
    return F.array_remove(F.split(spaced, r"[^\p{L}\p{N}]+"), "")


def least_equal(size: int, share: float) -> int:
    """How many of ``size`` aligned tokens must be equal."""
    return math.ceil(share * size - 1e-9)


def covers(masks: tuple[tuple[int, ...], ...], size: int, equal: int) -> bool:
    """Whether every choice of size - equal differing tokens in a window leaves a place where some mask reads equal tokens only."""
    places = [frozenset(at + o for o in m) for m in masks for at in range(size - m[-1])]
    return all(any(p.isdisjoint(other) for p in places) for other in combinations(range(size), size - equal))


@cache
def masks_for(size: int, equal: int) -> tuple[tuple[int, ...], ...]:
    """Masks that miss no window of ``size`` tokens of which ``equal`` agree: a family, proven by enumeration, else the longest run that must be equal."""
    if size <= 16:
        for family in FAMILIES:
            if covers(family, size, equal):
                return family
    return (tuple(range(max(1, -(-equal // (size - equal + 1))))),)


def seeds(text: Column, masks: list[tuple[int, ...]], window: int = 0, sizes: dict | None = None) -> Column:
    """array<array<long>>: for each mask the hash at every token position, null where the mask runs past the end.

    With ``sizes`` a mask is read only in texts whose token count, ``window`` at most, is among the mask's sizes.
    """

    def of(h: Column) -> Column:
        def one(m: int, mask: tuple[int, ...]) -> Column:
            each = F.transform(h, lambda x, i: F.when(i + mask[-1] < F.size(h), F.xxhash64(F.lit(m), x, *(F.get(h, i + o) for o in mask[1:]))))
            return each if sizes is None else F.when(F.least(F.lit(window), F.size(h)).isin(*sizes[mask]), each).otherwise(F.array().cast("array<bigint>"))

        return F.array(*(one(m, mask) for m, mask in enumerate(masks)))

    return let(F.transform(tokens(text), lambda x: F.xxhash64(x)), of)


def aligned(doc: Column, item: Column, shift: Column, window: int) -> Column:
    """The best count of equal tokens in a window of the alignment that puts item token j on document token j + shift."""
    size = F.least(F.lit(window), F.size(item))
    same = F.transform(item, lambda x, j: F.coalesce(F.get(doc, j + shift) == x, F.lit(False)).cast("int"))
    best = lambda e: F.array_max(F.transform(F.sequence(F.lit(0), F.size(item) - size), lambda s: F.aggregate(F.slice(e, s + 1, size), F.lit(0), lambda a, b: a + b)))
    return let(same, best)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 16, share: float = 0.8, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, text_hash, item_id, doc_token, item_window, matched): documents that hold a passage of a benchmark item.

    A hit is a masked hash that document and item share. Around it the two token sequences are laid over one another; the
    pair counts if some window of ``window`` tokens (the whole item if shorter) agrees in at least ``share`` of them. The
    row shows the best alignment of the pair, the earliest of equals.

    The seed table of the benchmark is broadcast only if it has at most ``broadcast_bytes``; beyond that the same join shuffles.
    Of a document only the stretch below an item goes on to be compared, so its length doesn't multiply with its hits. The masks come from the sizes of the benchmark's items and miss no allowed pattern, so every pair that counts is found; items of
    one to four tokens (at this share) must stand whole. Items without tokens match nothing.
    Null or empty texts match nothing. Documents are told apart by doc_id and text, so a repeated row is one document.
    Null doc_id is kept as null. Empty tables: no rows. Other columns are ignored.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    sizes: dict[tuple[int, ...], list[int]] = {}
    for (n,) in items.select(F.least(F.lit(window), F.size(tokens(F.col("text")))).alias("n")).filter("n > 0").distinct().collect():
        for mask in masks_for(n, least_equal(n, share)):
            sizes.setdefault(mask, []).append(n)
    sizes = sizes or {(0,): [1]}
    masks = sorted(sizes)
    masked = lambda df, how, *keys: df.select(*keys, F.explode(seeds(F.col("text"), masks, *how)).alias("s")).select(*keys, F.posexplode("s").alias("at", "seed")).filter(F.col("seed").isNotNull())
    listed = items.withColumn("length", F.size(tokens(F.col("text"))))
    table = cut(masked(listed, (window, sizes), "item_id", "length").groupBy("seed", "item_id", "length", "at").agg(F.count(F.lit(1)).alias("n")).select("seed", "item_id", "length", F.col("at").alias("item_at")))
    hits = masked(own, (), "doc_id", "text_hash").join(small_side(table, broadcast_bytes), "seed").select("doc_id", "text_hash", "item_id", "length", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = cut(hits)
    texts = own.join(small_side(hits.select("text_hash").distinct()), "text_hash", "left_semi").dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", tokens(F.col("text")).alias("doc"))
    h, t = hits.alias("h"), texts.alias("t")
    # Of a document only the stretch that lies below the item goes on, so long documents with many hits stay cheap.
    below = F.slice(F.col("t.doc"), F.greatest(F.col("h.shift"), F.lit(0)) + 1, F.greatest(F.col("h.length") + F.least(F.col("h.shift"), F.lit(0)), F.lit(0)))
    pairs = h.join(t, (F.col("h.text_hash") == F.col("t.text_hash")) & F.col("h.doc_id").eqNullSafe(F.col("t.doc_id"))).select("h.*", below.alias("doc"))
    laid = listed.select(F.col("item_id").alias("of_id"), F.col("length").alias("of_length"), tokens(F.col("text")).alias("item"))
    pairs = pairs.join(laid, F.col("item_id").eqNullSafe(F.col("of_id")) & (F.col("length") == F.col("of_length")))
    scored = pairs.select("doc_id", "text_hash", "item_id", "shift", F.least(F.lit(window), F.size("item")).alias("item_window"), aligned(F.col("doc"), F.col("item"), F.least(F.col("shift"), F.lit(0)), window).alias("matched"))
    found = scored.filter(F.col("matched") >= F.ceil(share * F.col("item_window") - 1e-9))
    best = found.groupBy("doc_id", "text_hash", "item_id").agg(F.min(F.struct(-F.col("matched"), "shift", "item_window")).alias("b"))
    return best.select("doc_id", "text_hash", "item_id", F.greatest(F.col("b.shift"), F.lit(0)).alias("doc_token"), F.col("b.item_window").alias("item_window"), (-F.col("b.col1")).alias("matched"))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that contaminated() doesn't name, all columns as they are."""
    bad = small_side(cut(contaminated(docs, benchmark, **how).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["bad_hash"]), "left_anti")
