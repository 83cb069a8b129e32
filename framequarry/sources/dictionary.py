"""Signal dictionaries: the text format (S06, K12) and the XML format (S07, J19). Small files, read on the driver into a dimension table."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession

SIGNAL_SCHEMA = "msg_id long, msg_name string, msg_dlc int, sig_name string, start_bit int, length int, little_endian boolean, is_signed boolean, scale double, offset double, minimum double, maximum double, unit string"
#: Strings, words, numbers with an optional sign, and single marks of the dictionary text.
_TOKEN = re.compile(r'"[^"]*"|[A-Za-z_]\w*|[-+]?(?:0[xX][0-9A-Fa-f]+|(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|\S')


class _Malformed(ValueError):
    pass


class _Statement:
    """The tokens of one statement, taken from the left."""

    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def take(self, *wanted: str) -> str:
        """The next token, which must be one of ``wanted`` if any are given."""
        if self.at >= len(self.tokens) or wanted and self.tokens[self.at] not in wanted:
            raise _Malformed
        self.at += 1
        return self.tokens[self.at - 1]

    def word(self) -> str:
        found = self.take()
        if not (found[0].isalpha() or found[0] == "_"):
            raise _Malformed
        return found

    def number(self) -> float:
        try:
            return float(self.take())
        except ValueError:
            raise _Malformed from None

    def whole(self) -> int:
        found = self.take()
        try:
            return int(found, 16) if found[:2].lower() == "0x" else int(found)
        except ValueError:
            raise _Malformed from None


def _message(s: _Statement) -> tuple:
    """identifier name : length sender"""
    ident, name = s.whole(), s.word()
    s.take(":")
    return ident, name, s.whole()


def _signal(s: _Statement) -> tuple:
    """name [multiplexer mark] : start | length @ order sign ( factor , offset ) [ least | greatest ] "unit" receivers"""
    name = s.word()
    if s.take() != ":":
        s.take(":")
    start = s.whole()
    s.take("|")
    length = s.whole()
    s.take("@")
    order, sign = s.take("0", "1"), s.take("+", "-")
    pairs = []
    for left, between, right in ("(,)", "[|]"):
        s.take(left)
        pairs.append(s.number())
        s.take(between)
        pairs.append(s.number())
        s.take(right)
    unit = s.take()
    if unit[0] != '"':
        raise _Malformed
    return name, start, length, order == "1", sign == "-", *pairs, unit[1:-1]


def _statements(text: str) -> list[_Statement]:
    """The statements of the text, by lines; a string may run over several, and what it holds begins none."""
    out, tokens, end = [], [], 0
    for m in _TOKEN.finditer(text):
        if tokens and "\n" in text[end : m.start()]:
            out.append(_Statement(tokens))
            tokens = []
        tokens.append(m[0])
        end = m.end()
    return [*out, _Statement(tokens)] if tokens else out


def parse_dbc(text: str) -> list[tuple]:
    """The signals of a dictionary text; messages without signals give one row with null signal columns. Identifiers may be decimal or hex; marks of multiplexed signals are read over.

    Other sections and malformed signals are left out, as are the signals of a malformed message.
    """
    messages: list[tuple[tuple, list[tuple]]] = []
    current: list[tuple] | None = None
    for s in _statements(text):
        kind = s.take()
        try:
            if kind == "BO_":
                current = None
                messages.append((_message(s), []))
                current = messages[-1][1]
            elif kind == "SG_" and current is not None:
                current.append(_signal(s))
        except _Malformed:
            continue
    return [head + signal for head, signals in messages for signal in signals or [(None,) * 10]]


def serialize_dbc(signals: list[tuple]) -> str:
    """The text of a dictionary, messages by identifier, signals in the order given."""
    messages: dict[tuple, list[str]] = {}
    number = lambda x: f"{x:g}"
    for s in signals:
        lines = messages.setdefault(s[:3], [])
        if s[3] is not None:
            lines.append(f' SG_ {s[3]} : {s[4]}|{s[5]}@{int(s[6])}{"-" if s[7] else "+"} ({number(s[8])},{number(s[9])}) [{number(s[10])}|{number(s[11])}] "{s[12]}" Vector__XXX')
    return "".join(f"BO_ {m[0]} {m[1]}: {m[2]} Vector__XXX\n" + "".join(x + "\n" for x in lines) + "\n" for m, lines in sorted(messages.items()))


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def parse_arxml(text: str) -> list[tuple]:
    """The signals of an XML dictionary: frame triggers, their frames, the frames' units, the units' mappings and the signals, joined by short name.

    A trigger whose frame isn't defined is left out; a signal that isn't defined has 8 bits, scale 1 and the range of its bits.
    """
    root = ET.fromstring(text)
    below = lambda e, *names: [x for x in e.iter() if _tag(x) in names]
    first = lambda e, name, other="": next((x.text.strip() for x in below(e, name) if x.text), other)
    short = lambda ref: ref.strip().rpartition("/")[2]
    own_name = lambda e: next((x.text.strip() for x in e if _tag(x) == "SHORT-NAME" and x.text), "")
    big = lambda e, name: "MOST-SIGNIFICANT-BYTE-FIRST" in first(e, name)
    signals = {own_name(e): (int(first(e, "BIT-LENGTH", "8")), big(e, "BYTE-ORDER"), first(e, "UNIT-DISPLAY-NAME") or short(first(e, "UNIT-REF"))) for e in below(root, "I-SIGNAL")}
    units = {own_name(e): [(short(first(m, "I-SIGNAL-REF")), int(first(m, "START-POSITION", "0")), big(m, "PACKING-BYTE-ORDER")) for m in below(e, "I-SIGNAL-TO-I-PDU-MAPPING", "I-SIGNAL-TO-PDU-MAPPING")] for e in below(root, "I-SIGNAL-I-PDU")}
    frames = {own_name(e): (int(first(e, "FRAME-LENGTH", "8")), [short(x.text) for x in below(e, "PDU-REF") if x.text]) for e in below(root, "FRAME", "CAN-FRAME")}
    out = []
    for trigger in below(root, "CAN-FRAME-TRIGGERING"):
        name, ident = short(first(trigger, "FRAME-REF")), int(first(trigger, "IDENTIFIER", "0"), 0)
        if name not in frames:
            continue
        size, refs = frames[name]
        rows = [m for p in refs for m in units.get(p, [])]
        for sig, start, mapped_big in rows:
            bits, sig_big, unit = signals.get(sig, (8, False, ""))
            top = 0.0 if sig in signals else 2.0**bits - 1
            out.append((ident, name, size, sig, start, bits, not (mapped_big or sig_big), False, 1.0, 0.0, 0.0, top, unit))
        if not rows:
            out.append((ident, name, size) + (None,) * 10)
    return out


def dictionary(spark: SparkSession, signals: list[tuple]) -> DataFrame:
    """The dimension table of parsed signals, without messages that have none."""
    return spark.createDataFrame([s for s in signals if s[3] is not None], SIGNAL_SCHEMA)


def read_dbc(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary file, read through Spark so that any store works."""
    return dictionary(spark, parse_dbc("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())))


def read_arxml(spark: SparkSession, path: str) -> DataFrame:
    return dictionary(spark, parse_arxml(spark.read.text(path, wholetext=True).first()[0]))
