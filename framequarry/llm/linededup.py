"""Line dedup: sharded minimal perfect hashes over all distinct line hashes, probed by the documents."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.llm.common import SPACES, cut, slices, without
from framequarry.llm.shingles import U, scramble

_BLANK = SPACES.encode()


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def line_hashes(lines: list[bytes], min_chars: int) -> np.ndarray:
    """An (n, 2) array of the 128-bit hashes of the lines' keys (stripped, A-Z lower-cased); keys under ``min_chars`` code points get (0, 0)."""
    long = (lambda k: len(k) >= min_chars) if min_chars <= 1 else lambda k: len(k.decode("utf-8", "surrogatepass")) >= min_chars
    digest, none = xxhash.xxh3_128_digest, b"\0" * 16
    return np.frombuffer(b"".join([digest(k) if long(k) else none for k in [x.strip(_BLANK).lower() for x in lines]]), dtype=np.int64).reshape(-1, 2)


class LineIndex:
    """A minimal perfect hash of one shard's line hashes, with arrays of fingerprints and counts in its order.

    Levels of bit vectors: a key's place at a level is its bit if no other key fell there; the rest go on to the next level.
    The rank of its bit is the key's slot. The slot's fingerprint (32 bits of the hash) tells a foreign line apart. Counts stop at
    ``most``, in the narrowest type that holds it.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, most: int = (1 << 63) - 1):
        first, left, self.levels, base = hashes[:, 0].view(np.uint64), np.arange(len(hashes)), [], 0
        second = hashes[:, 1].view(np.uint64)
        slots = np.empty(len(hashes), dtype=np.int64)
        while len(left):
            size = max(64, 2 * len(left))
            place = self._place(first[left], second[left], len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            mine = alone[place]
            words = np.packbits(np.pad(alone, (0, -size % 64)), bitorder="little").view(np.uint64)
            ranks = base + np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1]
            self.levels.append((size, words, ranks))
            slots[left[mine]] = self._rank(words, ranks, place[mine])
            base, left = base + int(mine.sum()), left[~mine]
        self.prints, self.counts = np.empty(len(hashes), dtype=np.uint32), np.empty(len(hashes), dtype=np.min_scalar_type(most))
        self.prints[slots], self.counts[slots] = hashes[:, 1] & 0xFFFFFFFF, np.minimum(counts, most)

    @staticmethod
    def _place(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
        return (scramble(first + scramble(second + U(level + 1))) % U(size)).astype(np.int64)

    @staticmethod
    def _rank(words: np.ndarray, ranks: np.ndarray, place: np.ndarray) -> np.ndarray:
        below = (U(1) << (place & 63).astype(np.uint64)) - U(1)
        return ranks[place >> 6] + np.bitwise_count(words[place >> 6] & below)

    def count(self, hashes: np.ndarray) -> np.ndarray:
        """The indexed count of each hash, 0 where it isn't indexed."""
        out, left = np.zeros(len(hashes), dtype=np.int64), np.arange(len(hashes))
        first, second = (np.ascontiguousarray(hashes[:, i]).view(np.uint64) for i in (0, 1))
        for level, (size, words, ranks) in enumerate(self.levels):
            if not len(left):
                break
            place = self._place(first[left], second[left], level, size)
            hit = (words[place >> 6] >> (place & 63).astype(np.uint64)) & U(1) == 1
            slot, at = self._rank(words, ranks, place[hit]), left[hit]
            out[at] = np.where(self.prints[slot] == hashes[at, 1] & 0xFFFFFFFF, self.counts[slot], 0)
            left = left[~hit]
        return out


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes[:, 0].view(np.uint64) % U(shards)).astype(np.int64) if len(hashes) else np.empty(0, dtype=np.int64)


def _lines(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """One row for each distinct line key of each document."""
    for batch in batches:
        found = [np.unique(h[h.any(axis=1)], axis=0) for x in batch["text"] if len(h := line_hashes(lines_of(x.as_py()), min_chars))]
        rows = np.concatenate([np.empty((0, 2), np.int64), *found])
        yield pa.RecordBatch.from_pydict({"h1": np.ascontiguousarray(rows[:, 0]), "h2": np.ascontiguousarray(rows[:, 1])})


def _build(rows: pa.Table, most: int) -> pa.Table:
    hashes = np.column_stack([rows["h1"].to_numpy(), rows["h2"].to_numpy()])
    blob = pickle.dumps(LineIndex(hashes, rows["n"].to_numpy(), most), protocol=5)
    return pa.table({"shard": pa.array([rows["shard"][0].as_py()], pa.int64()), "blob": pa.array([blob], pa.binary())})


def _rewrite(lines: list[bytes], drop) -> tuple[bytes, int, int]:
    """The text without the lines that ``drop`` marks, its lines, and those dropped."""
    kept = [x for x, d in zip(lines, drop) if not d]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _emit(batch: pa.RecordBatch, made: list[tuple[bytes, int, int]], names: list[str]) -> pa.RecordBatch:
    data = {c: batch[c] for c in names if c != "text"}
    data |= {"text": pa.array([m[0] for m in made], pa.string()), "n_lines": pa.array([m[1] for m in made], pa.int64()), "n_dropped": pa.array([m[2] for m in made], pa.int64())}
    return pa.RecordBatch.from_pydict({c: data[c] for c in [*names, "n_lines", "n_dropped"]})


def _probe_all(batches: Iterator[pa.RecordBatch], blobs, shards: int, min_docs: int, min_chars: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Probes the whole index, which every executor holds."""
    index = {k: pickle.loads(v) for k, v in blobs.value.items()}

    for batch in batches:
        texts = [lines_of(x.as_py()) for x in batch["text"]]
        hashes = np.concatenate([np.empty((0, 2), np.int64), *(line_hashes(lines, min_chars) for lines in texts)])
        common, shard = np.zeros(len(hashes), dtype=bool), _shard(hashes, shards)
        for k in np.unique(shard):
            if k in index:
                common[shard == k] = index[k].count(hashes[shard == k]) >= min_docs
        common &= hashes.any(axis=1)
        drops = np.split(common, np.cumsum([len(lines) for lines in texts])[:-1])
        yield _emit(batch, [_rewrite(lines, drop) for lines, drop in zip(texts, drops)], names)


def _probes(batches: Iterator[pa.RecordBatch], shards: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    """The distinct line hashes of each slot's documents in a batch, with their shards."""
    for batch in batches:
        rows = [np.empty((0, 3), np.int64)]
        for slot, x in zip(batch["slot"].to_pylist(), batch["text"]):
            hashes = line_hashes(lines_of(x.as_py()), min_chars)
            rows.append(np.column_stack([np.full(len(hashes), slot), hashes])[hashes.any(axis=1)])
        rows = np.unique(np.concatenate(rows), axis=0)
        shard = _shard(np.ascontiguousarray(rows[:, 1:]), shards)
        yield pa.RecordBatch.from_pydict({"shard": shard, "slot": np.ascontiguousarray(rows[:, 0]), "h1": np.ascontiguousarray(rows[:, 1]), "h2": np.ascontiguousarray(rows[:, 2])})


def _answers(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (shard, part), each part's index before its probes, the probes that reach the floor. Holds one shard's index and one batch."""
    index = None
    for batch in batches:
        blobs = batch["blob"].is_valid().to_numpy(zero_copy_only=False)
        hashes = np.column_stack([batch["h1"].fill_null(0).to_numpy(), batch["h2"].fill_null(0).to_numpy()]).reshape(-1, 2)
        hit, at = np.zeros(len(hashes), dtype=bool), 0
        for end in (*np.flatnonzero(blobs), len(hashes)):
            if end > at:
                hit[at:end] = index.count(hashes[at:end]) >= min_docs
            if end < len(hashes):
                index = pickle.loads(batch["blob"][end].as_py())
            at = end + 1
        yield batch.select(["slot", "h1", "h2"]).filter(pa.array(hit))


def _merge(batches: Iterator[pa.RecordBatch], min_chars: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by slot with the slot's answers first, the documents without the lines answered."""
    slot, seen = None, set()
    for batch in batches:
        at, made = [], []
        for i, (s, h1, h2) in enumerate(zip(*(batch[c].to_pylist() for c in ("slot", "h1", "h2")))):
            if s != slot:
                slot, seen = s, set()
            if h1 is not None:
                seen.add((h1, h2))
            else:
                lines = lines_of(batch["doc"][i]["text"].as_py())
                at.append(i)
                made.append(_rewrite(lines, [tuple(h) in seen for h in line_hashes(lines, min_chars).tolist()]))
        docs = pa.RecordBatch.from_struct_array(batch["doc"].take(pa.array(at, pa.int64())))
        yield _emit(docs, made, names)


def counted_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, n): hashes of all line keys, and in how many rows of docs each is found."""
    each = docs.select("text").mapInArrow(lambda it: _lines(slices(it), min_chars), "h1 long, h2 long")
    return each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, shard_lines: int = 1_000_000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with text freed of common lines, and n_lines (before) and n_dropped as last columns.

    A line's key is the line stripped of white space with A-Z lower-cased; keys of at least ``min_chars`` code points found
    in at least ``min_docs`` documents lose all their lines. Each row is a document, so repeated rows count as often as they stand.

    Lines are hashed to 128 bits and counted; all distinct hashes go, in shards of about ``shard_lines``, into minimal perfect hashes
    with arrays of 32-bit fingerprints and of counts (which stop at ``min_docs``), about 6 bytes a line. If all shards take at
    most ``broadcast_bytes``, each executor gets them and documents probe in place without a shuffle. Beyond, documents fall
    into slots by hash, a slot's line hashes are sent to the shards, each shard's probes in as many parts as their number
    asks for, and what reaches the floor comes back to the slot, where a sorted stream merges it with the documents.

    Null or empty text: one empty line, kept, text "". Empty table: no rows. All other columns pass through; own columns
    named n_lines or n_dropped are replaced.
    """
    spark = docs.sparkSession
    docs = without(docs, "n_lines", "n_dropped")
    names = [f.name for f in docs.schema]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_dropped long"
    lines = cut(counted_lines(docs, min_chars))
    distinct, found = lines.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, -(-distinct // shard_lines))
    shard = F.expr(f"cast(pmod(cast(h1 as decimal(20,0)) + if(h1 < 0, 18446744073709551616BD, 0BD), {shards}) as long)")
    index = cut(lines.withColumn("shard", shard).groupBy("shard").applyInArrow(lambda rows: _build(rows, min_docs), "shard long, blob binary"))
    if (index.agg(F.sum(F.length("blob"))).first()[0] or 0) <= broadcast_bytes:
        blobs = spark.sparkContext.broadcast({r["shard"]: bytes(r["blob"]) for r in index.collect()})
        return docs.mapInArrow(lambda it: _probe_all(slices(it), blobs, shards, min_docs, min_chars, names), out)
    return _routed(docs, index, shards, max(1, -(-found // (4 * shards * shard_lines))), min_docs, min_chars, names, out)


def _routed(docs: DataFrame, index: DataFrame, shards: int, parts: int, min_docs: int, min_chars: int, names: list[str], out: str, slot_docs: int = 4096) -> DataFrame:
    """What dedup_lines() gives where the index is too large for every executor: ``parts`` groups of probes a shard, about ``slot_docs`` documents a slot."""
    slots = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // slot_docs))
    slotted = docs.select(F.pmod(F.xxhash64("text", *(c for c in names if c == "doc_id")), F.lit(slots)).alias("slot"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"))
    probes = slotted.select("slot", F.col("doc.text").alias("text")).mapInArrow(lambda it: _probes(slices(it), shards, min_chars), "shard long, slot long, h1 long, h2 long")
    probes = probes.select("shard", F.pmod("slot", F.lit(parts)).alias("part"), "slot", "h1", "h2", F.lit(None).cast("binary").alias("blob"))
    none = F.lit(None).cast("long")
    copies = index.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), none.alias("slot"), none.alias("h1"), none.alias("h2"), "blob")
    asked = probes.unionByName(copies).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("blob").isNull())
    answers = asked.mapInArrow(lambda it: _answers(it, min_docs), "slot long, h1 long, h2 long")
    both = answers.select("slot", "h1", "h2", F.lit(None).cast(slotted.schema["doc"].dataType).alias("doc")).unionByName(slotted.select("slot", none.alias("h1"), none.alias("h2"), "doc"))
    return both.repartition("slot").sortWithinPartitions("slot", F.col("h1").isNull()).mapInArrow(lambda it: _merge(slices(it), min_chars, names), out)


LINES_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i, len(l) AS n FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM u),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
j AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, any_value(n)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
