"""The filter language, compiled to a Column.

    or := and (('or' | '||') and)*      and := unary (('and' | '&&') unary)*
    unary := ('not' | '!') unary | '(' or ')' | comparison
    comparison := operand (op operand)?     op := == != < <= > >=
    operand := can.id | can.dlc | can.ext | can.fd | can.err | can.ts | can.data[N] | decimal | 0xHEX | true | false

Values are 64-bit integers, an operand alone is true where it isn't 0. A byte out of range is 0. An empty expression matches all frames; one that doesn't
parse matches none. Characters that begin no token are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.schema import byte_at

_TOKEN = re.compile(r"0[xX][0-9a-fA-F]+|\d+|[A-Za-z_][A-Za-z_.0-9]*|==|!=|<=|>=|&&|\|\||[<>!()\[\]]")
_FIELDS: dict[str, Callable[[], Column]] = {
    "can.id": lambda: F.col("can_id").cast("long"),
    "can.dlc": lambda: F.col("dlc").cast("long"),
    "can.ext": lambda: F.col("extended").cast("long"),
    "can.fd": lambda: F.col("fd").cast("long"),
    "can.err": lambda: F.col("error").cast("long"),
    "can.ts": lambda: F.col("ts_us").cast("long"),
}
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


class FilterError(ValueError):
    """The expression doesn't parse."""


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at = _TOKEN.findall(text), 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        token = self.peek()
        self.at += 1
        return token

    def expect(self, token: str) -> None:
        if (got := self.take()) != token:
            raise FilterError(f"expected {token!r}, got {got or 'the end'!r}")

    def chain(self, names: tuple[str, str], part: Callable[[], Column], join: Callable[[Column, Column], Column]) -> Column:
        out = part()
        while self.peek().lower() in names:
            self.take()
            out = join(out, part())
        return out

    def either(self) -> Column:
        return self.chain(("or", "||"), self.both, lambda a, b: a | b)

    def both(self) -> Column:
        return self.chain(("and", "&&"), self.unary, lambda a, b: a & b)

    def unary(self) -> Column:
        if self.peek().lower() in ("not", "!"):
            self.take()
            return ~self.unary()
        if self.peek() == "(":
            self.take()
            out = self.either()
            self.expect(")")
            return out
        left = self.operand()
        if self.peek() in _COMPARE:
            return _COMPARE[self.take()](left, self.operand())
        return left != 0

    def operand(self) -> Column:
        token = self.take()
        if re.fullmatch(r"0[xX][0-9a-fA-F]+|\d+", token):
            return F.lit(int(token, 0) if token[:2].lower() == "0x" else int(token)).cast("long")
        if token.lower() in ("true", "false"):
            return F.lit(int(token.lower() == "true")).cast("long")
        if token.lower() in _FIELDS:
            return _FIELDS[token.lower()]()
        if token.lower() == "can.data":
            self.expect("[")
            index = self.take()
            if not index.isdigit():
                raise FilterError(f"not a byte number: {index!r}")
            self.expect("]")
            return byte_at(int(index))
        raise FilterError(f"unknown name {token!r}" if token else "an operand is missing")


def compile_filter(text: str) -> tuple[Column, str | None]:
    """The predicate of an expression and what is wrong with it, if anything is."""
    if not text.strip():
        return F.lit(True), None
    reader = _Reader(text)
    try:
        out = reader.either()
        if reader.peek():
            raise FilterError(f"unexpected {reader.peek()!r}")
    except FilterError as e:
        return F.lit(False), str(e)
    return out, None


def filter_frames(df: DataFrame, text: str) -> DataFrame:
    return df.filter(compile_filter(text)[0])
