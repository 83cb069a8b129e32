"""Secret scans: trigram queries derived from each rule's regex, block postings, and verification of candidates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.llm.common import slices

ANY = None  # a trigram query that every text satisfies


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, and the least characters of one of its groups (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    regex: re.Pattern = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "regex", re.compile(self.pattern, re.ASCII))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Leftmost non-overlapping matches, less those whose group is too short; offsets in code points."""
        return [m.span() for m in self.regex.finditer(text) if len(m[self.group]) >= self.least]


# Fixed values of the contract: the base rules.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # runs of [0-9a-f]+ of 16 or more: shorter runs never match
)
# Public formats of keys and tokens. A token of the form jwt starts its run of characters, so a run is read once.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("basic_url", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{1,64}@"),
)


def trigram_query(pattern: str):
    """The Boolean trigram query of a regex over texts with A-Z lower-cased: ANY, a trigram, ('and', ...) or ('or', ...).

    Literal runs give their trigrams, all of them needed; alternatives give the "or" of theirs; optional parts, classes and repeats end a run and
    need nothing of their own unless they must occur. Every text that the regex matches satisfies the query.
    """

    def both(parts):
        parts = tuple(dict.fromkeys(p for p in parts if p is not ANY))
        return ANY if not parts else parts[0] if len(parts) == 1 else ("and", *parts)

    def run(chars: list[str]):
        text = "".join(chars).lower()
        return [text[i : i + 3] for i in range(len(text) - 2)]

    def exact(items) -> list[str] | None:
        """All strings that a short sequence can be, or None if they aren't few and fixed."""
        out = [""]
        for op, arg in items:
            if op is sre.LITERAL and arg < 128:
                more = [chr(arg)]
            elif op is sre.SUBPATTERN:
                more = exact(arg[3])
            elif op is sre.BRANCH:
                each = [exact(x) for x in arg[1]]
                more = None if None in each else [y for x in each for y in x]
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1:
                one = exact(arg[2])
                more = None if one is None else (["", *one] if arg[0] == 0 else one)
            else:
                more = None
            if more is None or len(out) * len(more) > 64:
                return None
            out = [a + b for a in out for b in more]
        return out

    def query(items):
        parts, chars = [], []
        for op, arg in items:
            if op is sre.LITERAL and arg < 128:
                chars.append(chr(arg))
                continue
            parts += run(chars)
            chars = []
            if op is sre.SUBPATTERN:
                parts.append(alternatives(arg[3]))
            elif op is sre.BRANCH:
                parts.append(alternatives([(op, arg)]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                parts.append(query(arg[2]))
        return both([*parts, *run(chars)])

    def alternatives(items):
        fixed = exact(items)
        if fixed is not None:
            each = [both(run(list(x))) for x in fixed]
        elif len(items) == 1 and items[0][0] is sre.BRANCH:
            each = [query(x) for x in items[0][1][1]]
        else:
            return query(items)
        each = tuple(dict.fromkeys(each))
        return ANY if ANY in each else each[0] if len(each) == 1 else ("or", *each)

    return query(sre_parser.parse(pattern))


def needed(query) -> set[str]:
    return set() if query is ANY else {query} if isinstance(query, str) else set().union(*map(needed, query[1:]))


@cache
def _numbered(trigrams: tuple[str, ...]) -> np.ndarray:
    """For each three bytes the number of the trigram asked for, from 1, or 0."""
    table = np.zeros(1 << 24, dtype=np.uint16)
    table[[int.from_bytes(t.encode(), "big") for t in trigrams]] = np.arange(1, len(trigrams) + 1)
    return table


class BlockIndex:
    """The inverted index of a block of texts: for each trigram asked for, the sorted numbers of the texts that hold it."""

    def __init__(self, texts: list[str], trigrams: list[str]):
        self.postings = {t: np.empty(0, dtype=np.int64) for t in trigrams}
        table = _numbered(tuple(trigrams))
        found: list[list[np.ndarray]] = [[], []]
        for i, text in enumerate(texts):
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
            if len(raw) < 3:
                continue
            low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw).astype(np.uint32)
            hits = table[(low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]]
            hits = np.unique(hits[hits > 0])
            found[0].append(hits)
            found[1].append(np.full(len(hits), i, dtype=np.int64))
        if found[0]:
            grams, texts_of = np.concatenate(found[0]), np.concatenate(found[1])
            order = np.argsort(grams, kind="stable")
            ends = np.searchsorted(grams[order], np.arange(1, len(trigrams) + 2))
            for k, t in enumerate(trigrams):
                self.postings[t] = texts_of[order[ends[k] : ends[k + 1]]]

    def candidates(self, query) -> np.ndarray:
        if isinstance(query, str):
            return self.postings[query]
        parts = [self.candidates(q) for q in query[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def scan_block(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text (start, rule number, end), sorted: what all rules find."""
    queries = [trigram_query(r.pattern) for r in rules]
    index = BlockIndex(texts, sorted(set().union(*map(needed, queries))))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries)):
        for i in range(len(texts)) if query is ANY else index.candidates(query):
            out[i] += [(a, k, b) for a, b in rule.spans(texts[i])]
    return [sorted(x) for x in out]


def _scan(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        found = scan_block([x or "" for x in batch["text"].to_pylist()], rules)
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "found": pa.array([[{"kind": rules[k].kind, "start": a, "stop": b} for a, k, b in x] for x in found], kind)})


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """(doc_id, found array<struct<kind, start, stop>>) of every row: spans in code points by start, then in the rules' order.

    Each 256 whole texts are a block with an inverted trigram index of its own; a rule's query intersects and unites postings and only
    the texts left are matched. A rule whose regex has no mandatory trigram (hex) matches every text. A text of the block is
    always in memory whole; nothing is shuffled, so lost executors cost their blocks alone.
    Null or empty text: nothing found. Repeated rows are scanned alike. Empty table: no rows. Other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda it: _scan(slices(it), rules), "doc_id long, found array<struct<kind: string, start: long, stop: long>>")


def span_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
