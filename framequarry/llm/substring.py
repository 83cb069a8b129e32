"""Substring dedup by hashing of lines cut at sentence ends and of word windows; earliest occurrences stay, original offsets are retained.

Sentences find runs of repeated units, word windows find what repeats from mid-sentence to mid-sentence. A window's anchor is the least
hash of its short grams, so equal windows have equal anchors, and only windows whose anchor is found twice are looked at.
Neighbouring windows of one anchor travel as a segment.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry.llm.common import cut, slices, small_side
from framequarry.llm.shingles import U, scramble, word_hashes

#: A unit ends at a line's end or at a full stop, question or exclamation mark before white space.
_UNIT_END = re.compile(r"\n|[.!?](?=\s)")
_UNIT_COLUMNS = "doc_id long, text_hash long, unit long, start long, stop long, n_words long, word long, again boolean, h1 long, h2 long"
#: White space of other kinds than blank and U+0009 to U+000D.
_ODD_SPACE = re.compile(r"[^\S\t-\r ]")
#: Bytes that every text with such white space holds.
_ODD_MARKS = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_SEGMENT_COLUMNS = "doc_id long, text_hash long, anchor long, seg long, word long, wins array<long>, again array<boolean>, starts array<int>, stops array<int>"
#: Words of an anchor's gram.
GRAM = 8


#: The rank of a document without doc_id, and the bits of its text's hash that a rank holds.
LAST, HASH_BITS = (1 << 63) - 1, 60


def document_rank(doc_id: Column, text_hash: Column) -> Column:
    """A number that orders documents by doc_id, null last, and those of one doc_id by their text's hash."""
    return F.coalesce(doc_id, F.lit(LAST)).cast("decimal(20,0)") * F.lit(1 << HASH_BITS).cast("decimal(19,0)") + text_hash.bitwiseAND((1 << HASH_BITS) - 1).cast("decimal(19,0)")


def ranked_doc(rank: str) -> Column:
    """The doc_id of a rank, null for the last."""
    found = F.expr(f"if({rank} >= 0, {rank}, {rank} - {(1 << HASH_BITS) - 1}BD) div {1 << HASH_BITS}BD").cast("long")
    return F.when(found < LAST, found)


def _side(df: DataFrame, numbers: int = 4 << 20) -> DataFrame:
    """df, of numbers alone, for a broadcast if it holds at most about ``numbers`` of them; otherwise as it is."""
    return small_side(df, (32 + 8 * len(df.columns)) * (numbers // len(df.columns)))


def units(text: str | None, min_words: int) -> list[tuple[int, int, int, int, bool, bytes]]:
    """(start, stop, words, words before it, seen before in this text, digest) of each unit of at least ``min_words`` words, offsets in code points.

    The digest is of the unit's words, A-Z lower-cased, joined by single blanks.
    """
    out, seen, before, at, text = [], Counter(), 0, 0, text or ""
    for end in (*(m.end() for m in _UNIT_END.finditer(text)), len(text)):
        unit = text[at:end]
        tokens = unit.split()
        if len(tokens) >= min_words:
            key = xxhash.xxh3_128_digest(" ".join(tokens).encode("utf-8", "surrogatepass").lower())
            out.append((at + len(unit) - len(unit.lstrip()), at + len(unit.rstrip()), len(tokens), before, seen[key] > 0, key))
            seen[key] += 1
        before += len(tokens)
        at = end
    return out


def _units(batches: Iterator[pa.RecordBatch], min_words: int, short: bool) -> Iterator[pa.RecordBatch]:
    """All units, or (``short``) each text's distinct digests with a mark if the text repeats it."""
    for batch in batches:
        at, rows = [], []
        for doc, text in enumerate(batch["text"]):
            found = units(text.as_py(), min_words)
            if short:
                times = Counter(u[5] for u in found)
                found = [(0, 0, 0, 0, n > 1, k) for k, n in times.items()]
            rows += [(i, *u) for i, u in enumerate(found)]
            at += [doc] * len(found)
        digests = np.frombuffer(b"".join(r[6] for r in rows), dtype=np.int64).reshape(-1, 2)
        data = {"again": pa.array([r[5] for r in rows], pa.bool_()), "h1": np.ascontiguousarray(digests[:, 0]), "h2": np.ascontiguousarray(digests[:, 1])}
        of = pa.array(at, pa.int64())
        if short:
            yield pa.RecordBatch.from_pydict({"rank": batch["rank"].take(of)} | data)
            continue
        data |= {c: batch[c].take(of) for c in ("doc_id", "text_hash")} | {c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(("unit", "start", "stop", "n_words", "word"))}
        yield pa.RecordBatch.from_pydict({c.split()[0]: data[c.split()[0]] for c in _UNIT_COLUMNS.split(", ")})


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` neighbouring words, put together from grams of powers of two."""
    out, width, power, span = None, 0, h, 1
    while True:
        if size & span:
            out = power if out is None else scramble(out[: len(h) - width - span + 1] * U(0x9E3779B97F4A7C15) + power[width:])
            width += span
        if span * 2 > size:
            return out
        power, span = scramble(power[:-span] * U(0xD6E8FEB86659FD93) + power[span:]), span * 2


@cache
def _is_space() -> np.ndarray:
    return np.array([chr(i).isspace() for i in range(0x110000)])


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and stop, in code points."""
    space = np.ones(len(text) + 2, dtype=bool)
    space[1:-1] = _is_space()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    edges = np.flatnonzero(space[1:] != space[:-1]).astype(np.int32)
    return edges[::2], edges[1::2]


def plain_hashes(text: str) -> np.ndarray:
    """The hashes of a text's words, parted by white space of all kinds."""
    data = text.encode("utf-8", "surrogatepass")
    return word_hashes(_ODD_SPACE.sub(" ", text) if any(mark in data for mark in _ODD_MARKS) else text)


def window_least(g: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        g, span = np.minimum(g[:-span], g[span:]), span * 2
    return np.minimum(g[: len(g) - (width - span)], g[width - span :]) if span < width else g


def segments(text: str | None, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Of a text with windows: its word hashes, and for each run of windows with one anchor the anchor, the first window, and whether windows with that anchor may repeat without overlap.

    They may where the anchor has another run or more windows than one place of its gram can serve.
    """
    h = plain_hashes(text or "")
    if len(h) < size:
        return None
    gram = min(GRAM, size)
    least = window_least(grams(h, gram), size - gram + 1)
    begin = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    _, of, runs = np.unique(least[begin], return_inverse=True, return_counts=True)
    twice = runs > 1
    twice[of[np.diff(np.append(begin, len(least))) > size - gram + 1]] = True
    return h, least[begin], begin, twice[of]


def _anchors(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Each text's distinct anchors with a mark if their windows may repeat in it."""
    for batch in batches:
        of, out, twice = [], [np.empty(0, np.uint64)], [np.empty(0, bool)]
        for doc, text in enumerate(batch["text"]):
            if (found := segments(text.as_py(), size)) is None:
                continue
            anchor, first = np.unique(found[1], return_index=True)
            of.append(np.full(len(anchor), doc))
            out.append(anchor)
            twice.append(found[3][first])
        yield pa.RecordBatch.from_pydict({"rank": batch["rank"].take(pa.array(np.concatenate([np.empty(0, np.int64), *of]))), "anchor": np.concatenate(out).view(np.int64), "again": np.concatenate(twice)})


def _segments(batches: Iterator[pa.RecordBatch], size: int, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Of each text the segments: window hashes, marks of windows that stand earlier in it without overlap, offsets of windows; about ``most`` windows at a time."""
    for batch in batches:
        rows: list[tuple] = []
        many = 0

        def made() -> pa.RecordBatch:
            doc, anchor, seg, word, count, wins, again, starts, stops = (np.concatenate(x) for x in zip(*rows))
            offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
            listed = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x))
            data = {c: batch[c].take(pa.array(doc)) for c in ("doc_id", "text_hash")}
            data |= {"anchor": anchor.view(np.int64), "seg": seg.view(np.int64), "word": word, "wins": listed(wins.view(np.int64)), "again": listed(again), "starts": listed(starts), "stops": listed(stops)}
            return pa.RecordBatch.from_pydict(data)

        for doc, text in enumerate(batch["text"]):
            text = text.as_py()
            if (found := segments(text, size)) is None:
                continue
            h, anchor, begin, twice = found
            wins = grams(h, size)
            count = np.diff(np.append(begin, len(wins)))
            again = np.zeros(len(wins), dtype=bool)
            if twice.any():
                at = np.flatnonzero(np.repeat(twice, count))
                _, first, same = np.unique(wins[at], return_index=True, return_inverse=True)
                again[at] = at[first[same]] + size <= at
            start, stop = word_spans(text)
            rows.append((np.full(len(begin), doc), anchor, np.add.reduceat(scramble(wins), begin), begin, count, wins, again, start[: len(wins)], stop[size - 1 :]))
            many += len(wins)
            if many > most:
                yield made()
                rows, many = [], 0
        if rows:
            yield made()


def repeated_windows(own: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_hash, start, stop, word, n_words, first): word spans whose every window of ``size`` words stands earlier.

    Segments equal to one of an earlier document are settled whole; windows are compared one by one only where one anchor has
    different segments, at the ends of passages. Keys are counted with partial sums, as those of units are.
    """
    key, rank = ["doc_id", "text_hash"], document_rank(F.col("doc_id"), F.col("text_hash"))
    each = own.mapInArrow(lambda it: _anchors(slices(it), size), "rank decimal(38,0), anchor long, again boolean")
    known = each.groupBy("anchor").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.max(F.col("again").cast("int")).alias("twice"))
    known = cut(known.filter("low < high OR twice = 1").select("anchor"))
    segments = cut(own.mapInArrow(lambda it: _segments(slices(it), size), _SEGMENT_COLUMNS).join(_side(known), "anchor").withColumn("rank", rank))
    firsts = cut(segments.groupBy("anchor", "seg").agg(F.min("rank").alias("first"), F.max("rank").alias("high")))
    later = segments.join(_side(firsts.filter("first < high").select("anchor", "seg", "first")), ["anchor", "seg"], "left").withColumn("first", F.coalesce("first", "rank"))
    whole = later.filter("rank > first").select(*key, F.get("starts", F.lit(0)).cast("long").alias("start"), F.element_at("stops", -1).cast("long").alias("stop"), "word", (F.size("wins") + size - 1).cast("long").alias("n_words"), "first")

    unlike = cut(firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"))
    ends = later.filter("rank = first").join(_side(unlike.withColumn("mixed", F.lit(True))), "anchor", "left").filter("mixed OR array_contains(again, true)")
    ends = cut(ends.select(*key, "rank", "word", F.posexplode(F.arrays_zip("wins", "again", "starts", "stops")).alias("i", "x")).select(*key, "rank", (F.col("word") + F.col("i")).alias("word"), F.lit(size).cast("long").alias("n_words"), "x.*"))
    earlier = cut(ends.groupBy("wins").agg(F.min("rank").alias("first"), F.max("rank").alias("high")).filter("first < high").select("wins", "first"))
    single = ends.join(_side(earlier), "wins", "left").filter("again OR rank > first")
    single = single.select(*key, F.col("starts").cast("long").alias("start"), F.col("stops").cast("long").alias("stop"), "word", "n_words", F.least("rank", "first").alias("first"))
    return whole.unionByName(single)


def repeated_spans(docs: DataFrame, min_unit: int = 4, min_run: int = 30) -> DataFrame:
    """(doc_id, text_hash, start, stop, n_words, first_doc_id): the passages to remove, in offsets of the original text.

    Units are lines, cut further after sentence ends, so a passage set inside a line is found too. A unit that also stands
    earlier (documents rank by doc_id, inside a document by place) is a repeat; its first occurrence stays. Neighbouring repeats,
    with units under ``min_unit`` words between them, form a run; runs of at least ``min_run`` words are passages. So is any
    run of ``min_run`` words or more that stands earlier word by word, wherever in its sentences it starts and ends; passages that
    overlap or touch in words are one. n_words counts all its words, first_doc_id is the smallest of the documents found to hold a part of it earlier.

    Only digests found in two documents or twice in one are joined back, and they are counted before that with partial sums, so a unit that
    a third of all documents share costs one row a map task, and no group of its occurrences is gathered. Null, empty or all-short texts: no
    rows. Null doc_id ranks last. Documents of one doc_id, or of none, rank by a hash of their text; rows alike in both are one document.
    Empty table: no rows. Other columns are ignored.
    """
    own = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    rank = document_rank(F.col("doc_id"), F.col("text_hash"))
    own = own.withColumn("rank", rank)
    each = own.mapInArrow(lambda it: _units(slices(it), min_unit, True), "rank decimal(38,0), again boolean, h1 long, h2 long")
    firsts = each.groupBy("h1", "h2").agg(F.min("rank").alias("first"), F.max("rank").alias("other"), F.max(F.col("again").cast("int")).alias("again_any"))
    firsts = cut(firsts.filter("first < other OR again_any = 1").select("h1", "h2", "first"))
    spread = own.mapInArrow(lambda it: _units(slices(it), min_unit, False), _UNIT_COLUMNS).join(_side(firsts), ["h1", "h2"])
    repeats = spread.filter(F.col("again") | (rank > F.col("first"))).dropDuplicates(["doc_id", "text_hash", "unit"])
    document = Window.partitionBy("doc_id", "text_hash")
    runs = repeats.withColumn("run", F.col("unit") - F.row_number().over(document.orderBy("unit")))
    spans = runs.groupBy("doc_id", "text_hash", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("word").alias("word"), F.max(F.col("word") + F.col("n_words")).alias("end"), F.sum("n_words").alias("n_words"), F.min("first").alias("first"))
    spans = spans.filter(F.col("n_words") >= min_run).drop("run", "n_words")
    windows = repeated_windows(own, min_run).withColumn("end", F.col("word") + F.col("n_words")).drop("n_words")
    placed = document.orderBy("word", "end")
    every = spans.unionByName(windows).withColumn("reach", F.max("end").over(placed.rowsBetween(Window.unboundedPreceding, -1)))
    every = every.withColumn("passage", F.sum(F.when(F.col("word") <= F.col("reach"), 0).otherwise(1)).over(placed.rowsBetween(Window.unboundedPreceding, 0)))
    merged = every.groupBy("doc_id", "text_hash", "passage").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("end") - F.min("word")).alias("n_words"), F.min("first").alias("first"))
    return merged.select("doc_id", "text_hash", "start", "stop", "n_words", ranked_doc("first").alias("first_doc_id"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, kept = [], []
        for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
            at, pieces = 0, []
            for s in sorted(spans or [], key=lambda s: s["start"]):
                pieces.append((at, s["start"]))
                at = s["stop"]
            pieces = [(a, b) for a, b in [*pieces, (at, len(text or ""))] if a < b]
            texts.append(None if text is None else "".join(text[a:b] for a, b in pieces))
            kept.append([{"start": a, "stop": b} for a, b in pieces])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "text": pa.array(texts, pa.string()), "kept_spans": pa.array(kept, kind)})


def remove_repeats(docs: DataFrame, min_unit: int = 4, min_run: int = 30) -> DataFrame:
    """(doc_id, text, kept_spans): each text without the spans of repeated_spans(), and where what is left stood in the original."""
    spans = cut(repeated_spans(docs, min_unit, min_run)).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    own = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    s = spans.select(F.col("doc_id").alias("span_id"), F.col("text_hash").alias("span_hash"), "spans")
    joined = own.join(s, own["doc_id"].eqNullSafe(s["span_id"]) & (own["text_hash"] == s["span_hash"]), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(lambda it: _remove(slices(it)), "doc_id long, text string, kept_spans array<struct<start: long, stop: long>>")
