"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersections, components and link counts.

Documents with equal shingle sets form a class and travel as one. Sizes fall into bands (each 1.5 times the last). In the
scheme of a band a set of size n is cut by hash into k parts, and each non-empty part's content is the key of a tile.
Two sets over the threshold whose smaller one lies in the band differ in at most d shingles, so of a set's f non-empty parts
at least f - d are untouched by any difference, and the two meet in as many tiles. Sets where f - d is under 1 (short texts)
also enter tiles of their prefix, the n - ceil(t * n) + 1 lowest hashes, of which two such sets over the threshold share one.

So a set needs f - d tiles in common with each partner. One that shares fewer tiles with anybody has no partner and leaves; of
the others, all but the last f - d - 1 tiles (by tile size, largest last) hold the first tile that it shares with a partner,
and only those count. What unrelated texts share by chance or by common passages goes that way. Tiles that are left tie
classes to cells. A cell is compared as a whole, in blocks: size and bitmap (differing bits are differing shingles) bound the
overlap from above, sorted arrays decide. Blocks give counts and local components, never pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry.llm.common import cut, slices, small_side
from framequarry.llm.shingles import U, digest, scramble, shingle_set

BAND_GROWTH = 1.5
#: A block holds about so many classes, and so many shingles, at most.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 1 << 21


def most_differing(n: int, m: int, percent: int) -> int:
    """The most differing shingles of two linked sets of n and m."""
    return (n + m) * (100 - percent) // (100 + percent)


@cache
def bands(percent: int) -> tuple[tuple[int, int, int], ...]:
    """For each band: least size, largest size, k (parts)."""
    out, low = [], 1
    while low < 1 << 40:
        nxt = max(low + 1, int(low * BAND_GROWTH))
        high = nxt - 1
        d = most_differing(high, high * 100 // percent, percent)
        out.append((low, high, d + 1 + d // 6 + (1 if d else 0)))
        low = nxt
    return tuple(out)


def tile_keys(s: np.ndarray, percent: int = 80) -> tuple[np.ndarray, list[int]]:
    """The tiles that a sorted shingle set enters, and how many of them it shares at least with each partner.

    There are tiles of its own band, and of the band below where a partner may lie. A tile's lowest bit is its band's number
    modulo 2, at which place of the list the band's need stands.
    """
    n, out, need = len(s), [np.empty(0, dtype=np.uint64)], [1, 1]
    own = bisect_left(bands(percent), n, key=lambda b: b[1])
    mixed = scramble(s)
    for i in (own, own - 1) if n else ():
        low, high, k = bands(percent)[max(i, 0)]
        if i < 0 or (i < own and n > high * 100 // percent):
            continue
        tag = U((i + 1) * 0x632BE59BD9B4E019 % (1 << 64))
        part = (mixed % U(k)).view(np.int64)
        sums = np.zeros(k, dtype=np.uint64)
        np.add.at(sums, part, mixed)
        full = np.bincount(part, minlength=k) > 0
        keys = scramble(sums + scramble(np.arange(k, dtype=np.uint64) + tag))[full]
        spare = int(full.sum()) - most_differing(n, n * 100 // percent if i == own else high, percent)
        if spare < 1:
            keys = np.concatenate([keys, scramble(s[: n - -(-n * percent // 100) + 1] + ~tag)])
        need[i % 2] = max(1, spare)
        out.append(keys >> U(1) << U(1) | U(i % 2))
    return np.concatenate(out).view(np.int64), need


def bitmap(s: np.ndarray) -> np.ndarray:
    """A bitmap of 64 to 8192 bits as words, at least twice the set's size where that allows, one bit a shingle."""
    bits = 1 << min(13, max(6, int(2 * len(s) - 1).bit_length()))
    out = np.zeros(bits, dtype=bool)
    out[(scramble(s + U(77)) % U(bits)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def linked(n, m, shared, percent: int):
    return 100 * shared >= percent * (n + m - shared)


def compare(sets: list[np.ndarray], sides: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each of some sorted shingle sets, ordered by size: its links, its component (least place), and the arrays intersected in all.

    With ``sides`` only pairs of different sides are compared. Sizes bound the partners of a set to a run; bitmaps of equal
    width bound the overlap; the arrays, recoded to their ranks among all shingles here, are intersected by marking one's ranks.
    """
    g = len(sets)
    n = np.array([len(s) for s in sets])
    links, label, checked = np.zeros(g, dtype=np.int64), np.arange(g), 0
    maps = [bitmap(s) for s in sets]
    width = np.array([len(m) for m in maps])
    ends = np.cumsum(n)
    values, ranks = np.unique(np.concatenate(sets), return_inverse=True)
    codes, mark = np.split(ranks.astype(np.int32), ends[:-1]), np.zeros(len(values), dtype=bool)
    last = np.searchsorted(n, n * 100 // percent, side="right")
    for w in np.unique(width):
        first, to = np.searchsorted(width, [w, 2 * w], side="left")[0], np.searchsorted(width, 2 * w, side="right")
        level = np.vstack([m if len(m) == w else m[:w] | m[w:] for m in maps[first:to]])
        for i in range(first, np.searchsorted(width, w, side="right")):
            m = n[i + 1 : last[i]]
            if not len(m):
                continue
            apart = np.bitwise_count(level[i + 1 - first : last[i] - first] ^ level[i - first]).sum(axis=1, dtype=np.int64)
            fits = linked(n[i], m, np.minimum(n[i], (n[i] + m - apart) // 2), percent)
            if sides is not None:
                fits &= sides[i + 1 : last[i]] != sides[i]
            found = np.flatnonzero(fits) + i + 1
            if not len(found):
                continue
            checked += len(found)
            mark[codes[i]] = True
            starts = np.concatenate(([0], np.cumsum(n[found])[:-1]))
            shared = np.add.reduceat(mark[np.concatenate([codes[j] for j in found])], starts, dtype=np.int64)
            mark[codes[i]] = False
            found = found[linked(n[i], n[found], shared, percent)]
            if len(found):
                links[i] += len(found)
                links[found] += 1
                joined = np.unique(np.append(label[found], label[i]))
                if len(joined) > 1:
                    label[np.isin(label, joined)] = joined[0]
    return links, label, checked


def _sizes(batches: Iterator[pa.RecordBatch], percent: int, width: int) -> Iterator[pa.RecordBatch]:
    """(key_id, text_hash, n, cls, need0, need1) of each text."""
    for batch in batches:
        rows = [shingle_set(x.as_py(), width) for x in batch["text"]]
        need = [tile_keys(s, percent)[1] for s in rows]
        data = {"n": map(len, rows), "cls": map(digest, rows)} | {f"need{i}": [x[i] for x in need] for i in (0, 1)}
        yield pa.RecordBatch.from_pydict({c: batch[c] for c in ("key_id", "text_hash")} | {k: pa.array(list(v), pa.int64()) for k, v in data.items()})


def _tiles(batches: Iterator[pa.RecordBatch], percent: int, width: int) -> Iterator[pa.RecordBatch]:
    """(tile, cls) of each class of a task; what a task repeats of a class is left out."""
    seen: set[int] = set()
    for batch in batches:
        tiles, classes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for x in batch["text"]:
            s = shingle_set(x.as_py(), width)
            cls = digest(s)
            if cls not in seen:
                seen.add(cls)
                tiles.append(tile_keys(s, percent)[0])
                classes.append(np.full(len(tiles[-1]), cls))
        yield pa.RecordBatch.from_pydict({"tile": np.concatenate(tiles), "cls": np.concatenate(classes)})


def _shared_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (tile, cls), the distinct ones whose tile holds another class, with the tile's first class. Keeps one row between batches."""
    held_t, held_c, lead, before = None, None, None, False
    for batch in batches:
        t, c = batch["tile"].to_numpy(), batch["cls"].to_numpy()
        if not len(t):
            continue
        if held_t is not None:
            t, c = np.concatenate(([held_t], t)), np.concatenate(([held_c], c))
        new = np.ones(len(t), dtype=bool)
        new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        t, c = t[new], c[new]
        follows = np.zeros(len(t), dtype=bool)
        follows[0] = before
        follows[1:] = t[1:] == t[:-1]
        leads = c[np.maximum.accumulate(np.where(follows, 0, np.arange(len(t))))]
        if before:
            leads[: len(t) if follows.all() else int(np.argmin(follows))] = lead
        keep = follows.copy()
        keep[:-1] |= follows[1:]
        held_t, held_c, lead, before = t[-1], c[-1], leads[-1], bool(follows[-1])
        yield pa.RecordBatch.from_pydict({"tile": t[:-1][keep[:-1]], "cls": c[:-1][keep[:-1]], "lead": leads[:-1][keep[:-1]]})
    if before:
        yield pa.RecordBatch.from_pydict({"tile": np.array([held_t]), "cls": np.array([held_c]), "lead": np.array([lead])})


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that tie what the pairs (a, b) tie: each node but the least of its component, with that one."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (label[x], label[y], x, y):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[label[far]], nodes[far]


def _stars(batches: Iterator[pa.RecordBatch], names: tuple[str, str] = ("a", "b"), most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """What the pairs of a task tie together, as stars (a, b) over up to ``most`` rows at a time."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = forest(*(np.concatenate([np.empty(0, np.int64), *(x[c].to_numpy() for x in held)]) for c in names))
        return pa.RecordBatch.from_pydict({"a": a, "b": b})

    held, many = [], 0
    for batch in batches:
        held.append(batch)
        many += batch.num_rows
        if many >= most:
            yield stars(held)
            held, many = [], 0
    yield stars(held)


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (tile, cls), what the tiles of a task tie together, as stars (a, b)."""
    return _stars(_shared_tiles(batches), ("lead", "cls"))


def _arrays(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The sets of the classes wanted, once a task."""
    seen: set[int] = set()
    for batch in batches:
        rows = [shingle_set(x.as_py(), width) for x in batch["text"]]
        keep = []
        for i, (s, cls) in enumerate(zip(rows, batch["cls"].to_pylist())):
            if cls not in seen and digest(s) == cls:
                seen.add(cls)
                keep.append(i)
        taken = batch.select(["cls", "cell", "blocks", "block"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([rows[i].tobytes() for i in keep], pa.binary())], [*taken.schema.names, "set"])


def _blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (cell, lo, hi), each group's (cls, cell, label, links); holds one group, a pair of blocks, at a time."""

    def done(rows: dict[int, tuple[int, bytes]], key: tuple) -> pa.RecordBatch:
        classes = sorted(rows, key=lambda c: len(rows[c][1]))
        sets = [np.frombuffer(rows[c][1], dtype=np.uint64) for c in classes]
        sides = np.array([rows[c][0] for c in classes]) if key[1] != key[2] else None
        links, label, _ = compare(sets, sides, percent)
        names = np.array(classes, dtype=np.int64)
        return pa.RecordBatch.from_pydict({"cls": names, "cell": np.full(len(names), key[0]), "label": names[label], "links": links})

    key, rows = None, {}
    for batch in batches:
        for *at, cls, block, data in zip(*(batch[c].to_pylist() for c in ("cell", "lo", "hi", "cls", "block")), batch["set"]):
            if tuple(at) != key:
                if rows:
                    yield done(rows, key)
                key, rows = tuple(at), {}
            rows[cls] = (block, data.as_py())
    if rows:
        yield done(rows, key)


def components(links: DataFrame) -> DataFrame:
    """(cls, comp): the least class reachable over links (a, b). Min-label steps with pointer jumps, so depth shrinks fast; one checkpoint a step.

    Links first meet by their b, where a task turns those that hang together into stars, so a class that many tasks tied has about one link left.
    """
    links = links.repartition("b").mapInArrow(_stars, "a long, b long").distinct()
    edges = cut(links.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))))
    labels = edges.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("a"), F.min("b")).alias("comp"))
    while True:
        near = edges.join(labels.select(F.col("cls").alias("b"), "comp"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "cls").select("cls", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("cls").alias("comp"), F.col("comp").alias("far"))
        step = cut(step.join(jump, "comp").select("cls", "old", F.least("comp", "far").alias("comp")))
        labels = step.select("cls", "comp")
        if not step.filter("comp <> old").limit(1).count():
            return labels


def row_hash(docs: DataFrame) -> Column:
    """A key of a row's text and doc_id."""
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")), docs["doc_id"])


def join(docs: DataFrame, percent: int = 80, width: int = 5, block: int = BLOCK_CLASSES, block_shingles: int = BLOCK_SHINGLES, keys: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, links): a row for each row of ``docs``, in components of shingle-set Jaccard >= percent / 100.

    component_id is the smallest doc_id reachable over links, the document's own included; links counts the other classes
    (distinct shingle sets) that the document's set is linked with, all of them: each pair of classes that sizes and bitmaps
    allow is compared. Cells of more than ``block`` classes or ``block_shingles`` shingles are compared in blocks, each pair of
    blocks a task's group of its own, so that no task holds more than two blocks whatever a cell's size.

    Null, empty or wordless text: n_shingles 0, linked with nothing (component_id is the doc_id). Null doc_id: kept as a row,
    its component takes the smallest non-null doc_id, null if it has none. Repeated rows or texts: one class. Empty table: no rows. Other columns are
    ignored. Shingles, parts and classes are compared by 64-bit hashes. With ``keys`` two columns more: text_hash as row_hash() gives it, and
    component, which names the component also where doc_ids are null or repeated (null for n_shingles 0).
    """
    source = docs.select(F.col("doc_id").alias("key_id"), row_hash(docs).alias("text_hash"), "text")
    rows = cut(source.mapInArrow(lambda it: _sizes(slices(it), percent, width), "key_id long, text_hash long, n long, cls long, need0 long, need1 long"))
    some, none = rows.filter("n > 0"), rows.filter("n = 0")
    classes = cut(some.groupBy("cls").agg(F.min("key_id").alias("least"), F.min("text_hash").alias("text_hash"), *(F.first(c).alias(c) for c in ("n", "need0", "need1"))))

    tiles = source.select("text").mapInArrow(lambda it: _tiles(slices(it), percent, width), "tile long, cls long")
    together = lambda df: df.repartition("tile").sortWithinPartitions("tile", "cls")
    members = cut(together(tiles).mapInArrow(_shared_tiles, "tile long, cls long, lead long").select("tile", "cls"))
    sized = members.join(members.groupBy("tile").agg(F.count(F.lit(1)).alias("size")), "tile")
    wanting = sized.join(classes.select("cls", "need0", "need1"), "cls").select("tile", "cls", "size", F.expr("pmod(tile, 2)").alias("odd"), F.expr("if(pmod(tile, 2) = 0, need0, need1)").alias("need"))
    band = Window.partitionBy("cls", "odd")
    ranked = wanting.withColumn("spare", F.count(F.lit(1)).over(band) - F.col("need")).withColumn("rank", F.row_number().over(band.orderBy("size", "tile")))
    # A task ties what its tiles hold before anything is shuffled, so a group of near copies gives about one row a class and task.
    cells = components(together(ranked.filter("rank <= spare + 1").select("tile", "cls")).mapInArrow(_ties, "a long, b long"))

    placed = cells.select("cls", F.col("comp").alias("cell")).join(classes.select("cls", "text_hash", "n"), "cls")
    count = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / block_shingles)).cast("int")
    placed = placed.join(placed.groupBy("cell").agg(count.alias("blocks")), "cell").select("text_hash", "cls", "cell", "blocks", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block"))
    placed = cut(placed)
    sets = source.join(small_side(placed), "text_hash").select("text", "cls", "cell", "blocks", "block").mapInArrow(lambda it: _arrays(slices(it), width), "cls long, cell long, blocks int, block int, set binary")
    spread = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "cls", "set")
    spread = spread.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
    found = cut(spread.mapInArrow(lambda it: _blocks(it, percent), "cls long, cell long, label long, links long"))

    named = found.groupBy("cls").agg(F.min("label").alias("comp"), F.sum("links").alias("links"))
    large = placed.filter("blocks > 1").select("cell").distinct()
    if large.limit(1).count():
        ties = found.filter("label <> cls").join(small_side(large), "cell", "left_semi").select(F.col("label").alias("a"), F.col("cls").alias("b")).distinct()
        wide = components(ties).withColumnRenamed("comp", "wide")
        named = named.join(wide, "cls", "left").select("cls", F.coalesce("wide", "comp").alias("comp"), "links")
    named = classes.select("cls", "least").join(named, "cls", "left").select("cls", "least", F.coalesce("comp", "cls").alias("comp"), F.coalesce("links", F.lit(0)).alias("links"))
    named = named.join(named.groupBy("comp").agg(F.min("least").alias("component_id")), "comp")
    out = some.join(small_side(cut(named.select("cls", "comp", "component_id", "links"))), "cls")
    out = out.unionByName(none.select("*", F.lit(None).cast("long").alias("comp"), F.col("key_id").alias("component_id"), F.lit(0).cast("long").alias("links")))
    return out.select(F.col("key_id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "links", *([F.col("text_hash"), F.col("comp").alias("component")] if keys else []))


NGRAM_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN []::VARCHAR[] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
        ELSE list_distinct([array_to_string(t[i:i + 4], ' ') FOR i IN range(1, len(t) - 3)]) END AS g FROM w),
c AS (SELECT doc_id, g, len(g) AS n, md5(array_to_string(list_sort(g), chr(10))) AS k FROM s),
r AS (SELECT k, min(doc_id) AS rep, any_value(g) AS g, any_value(n) AS n FROM c WHERE n > 0 GROUP BY k),
u AS (SELECT rep, n, unnest(g) AS x FROM r),
f AS (SELECT x FROM u GROUP BY x HAVING count(*) > 1),
v AS (SELECT u.rep, u.n, u.x FROM u JOIN f USING (x)),
p AS (SELECT a.rep AS a, b.rep AS b FROM v a JOIN v b ON a.x = b.x AND a.rep <> b.rep AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
      GROUP BY a.rep, a.n, b.rep, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
z AS (SELECT rep AS a, rep AS b FROM r UNION SELECT z.a, p.b FROM z JOIN p ON z.b = p.a),
m AS (SELECT a, min(b) AS comp FROM z GROUP BY a),
q AS (SELECT a, count(*) AS links FROM p GROUP BY a)
SELECT c.doc_id, c.n::BIGINT AS n_shingles, coalesce(m.comp, c.doc_id) AS component_id, coalesce(q.links, 0)::BIGINT AS links
FROM c LEFT JOIN r ON c.k = r.k AND c.n > 0 LEFT JOIN m ON m.a = r.rep LEFT JOIN q ON q.a = r.rep
"""
