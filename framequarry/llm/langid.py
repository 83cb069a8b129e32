"""Language identification by rank-order n-gram profiles and the out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry.llm.common import cut, slices, small_side

#: n-grams of 1 to 3 letters, with one blank for whatever separates words; n-grams a profile; characters counted at a time.
PROFILE, _CHUNK = 400, 1 << 20


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a blank."""
    return np.array([ord(low) if (c := chr(i)).isalpha() and len(low := c.lower()) == 1 else i if chr(i).isalpha() else 32 for i in range(0x110000)], dtype=np.int64)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a text's n-grams; 21 bits a character, shorter n-grams in the low bits; no n-gram is blank alone."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    keys, counts, carry = np.empty(0, np.int64), np.empty(0, np.int64), np.array([32])
    for at in range(0, len(points), _CHUNK):
        c = np.concatenate((carry, _letters()[points[at : at + _CHUNK]], [32] if at + _CHUNK >= len(points) else []))
        c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))].astype(np.int64)
        # n-grams that end past the carry: the last two characters of the piece before, so a seam changes nothing.
        done = len(carry)
        pairs = (c[:-1] << 21) | c[1:]
        triples = (pairs[:-1] << 21) | c[2:]
        k, n = np.unique(np.concatenate((c[done:][c[done:] != 32], pairs[done - 1 :], triples[max(0, done - 2) :])), return_counts=True)
        if at:
            keys, where = np.unique(np.concatenate((keys, k)), return_inverse=True)
            counts = np.bincount(where, np.concatenate((counts, n))).astype(np.int64)
        else:
            keys, counts = k, n
        carry = c[-2:]
    return keys, counts


def ranked(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The PROFILE most frequent keys in order; equal counts stand by key."""
    return keys[np.argsort(-counts, kind="stable")[:PROFILE]]


def hashed_share(col: Column) -> Column:
    """A number from 0 to 1 that a hash of col fixes."""
    return F.pmod(F.xxhash64(F.lit(20), col), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, keys, counts = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            k, n = ngrams(text.as_py())
            keys.append(k)
            counts.append(n)
            langs += [lang] * len(k)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "gram": np.concatenate(keys), "n": np.concatenate(counts)})


def learn(docs: DataFrame, sample: int = 2000) -> dict[str, np.ndarray]:
    """The profile of each language: its PROFILE most frequent n-grams over a bounded sample of about ``sample`` labelled texts a language.

    The sample takes a text if a hash of its doc_id is under sample / texts of that language, so it is spread over all rows, is the same each
    time and doesn't grow with the input; the whole text of a sampled row counts. What comes back is PROFILE numbers a language.
    Rows with null text or lang teach nothing.
    """
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    # One row a language: small_side() sends it to the texts, which are filtered where they are read.
    rates = small_side(cut(rows.groupBy("lang").agg((F.lit(float(sample)) / F.count(F.lit(1))).alias("rate"))))
    taken = rows.join(rates, "lang").filter(hashed_share(F.coalesce(F.col("doc_id"), F.lit(0))) < F.col("rate")).select("lang", "text")
    grams = taken.mapInArrow(lambda it: _count(slices(it)), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = grams.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= PROFILE)
    out: dict[str, list[int]] = {}
    for r in sorted(best.collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


class Profiles:
    """All profiles in one table: sorted n-grams, and each one's rank in each language (PROFILE where it lacks it)."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.langs = sorted(profiles)
        self.grams = np.unique(np.concatenate([np.empty(0, np.int64), *profiles.values()]))
        self.ranks = np.full((len(self.grams), len(self.langs)), -1, dtype=np.int32)
        for i, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, profiles[lang]), i] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the least out-of-place distance and 1 - distance / the greatest possible; ('und', 0) without letters or profiles."""
        top = ranked(*ngrams(text))
        if not len(top) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        ranks = np.where((self.grams[at] == top)[:, None], self.ranks[at], -1)
        distance = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (PROFILE * len(top)))


def _predict(batches: Iterator[pa.RecordBatch], profiles: Profiles) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [profiles.predict(x.as_py()) for x in batch["text"]]
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64())})


def identify(docs: DataFrame, held_out: Column, sample: int = 2000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``, with profiles learnt from the rows that aren't held out.

    lang_pred depends on the whole text alone. Null, empty or letterless texts: 'und', score 0; so are all texts if no row can
    teach. Very long texts are counted in pieces; what is counted doesn't depend on them. Equal distances go to the first language in code point
    order. Repeated rows are judged alike. Empty table: no rows. Other columns are ignored.
    """
    own = docs.select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    profiles = Profiles(learn(own.filter(~F.col("held_out")), sample))
    return own.select("doc_id", "text", "held_out").mapInArrow(lambda it: _predict(slices(it), profiles), "doc_id long, held_out boolean, lang_pred string, score double")
