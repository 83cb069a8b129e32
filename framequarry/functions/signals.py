"""Bit fields in payloads: extraction, sign, physical values, encoding, checksums, rule decoding."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

def _byte(data: str, at: str) -> str:
    """The byte at a position as a long, 0 past the payload's end or before its start."""
    return f"coalesce(cast(get({data}, cast({at} as int)) as bigint), 0L)"


def _low_bits(word: str, length: str) -> Column:
    """The lowest ``length`` bits (1 to 64) of a long."""
    return F.expr(f"({word}) & shiftrightunsigned(-1L, cast(64 - ({length}) as int))")


def raw_little(data: str, start: str, length: str) -> Column:
    """A little-endian field of up to 64 bits; bits past the payload read 0. Arguments are SQL expressions.

    The nine bytes that it may touch are laid into a long and shifted as a whole, so no bit is looked at alone.
    """
    first, off = f"({start}) div 8", f"cast(({start}) % 8 as int)"
    word = " | ".join(f"shiftleft({_byte(data, f'{first} + {j}')}, {8 * j})" for j in range(8))
    over = f"if({off} = 0, 0L, shiftleft({_byte(data, f'{first} + 8')}, 64 - {off}))"
    return _low_bits(f"shiftrightunsigned({word}, {off}) | {over}", length)


def raw_motorola(data: str, start: str, length: str) -> Column:
    """A big-endian field whose start is its highest bit: down through the byte, then on from the next byte's bit 7."""
    first, off = f"({start}) div 8", f"cast(7 - ({start}) % 8 as int)"
    word = " | ".join(f"shiftleft({_byte(data, f'{first} + {j}')}, {56 - 8 * j})" for j in range(8))
    over = f"if({off} = 0, 0L, shiftright({_byte(data, f'{first} + 8')}, 8 - {off}))"
    return F.expr(f"shiftrightunsigned(shiftleft({word}, {off}) | {over}, cast(64 - ({length}) as int))")


def raw_descending(data: str, start: str, length: str) -> Column:
    """X03, ``compat="dbc"``: big-endian fields as the dictionary decoder reads them: chunks go to lower bytes and the first chunk is the lowest."""
    first = f"least(({start}) % 8 + 1, ({length}))"
    word = f"(shiftright({_byte(data, f'({start}) div 8')}, cast(({start}) % 8 + 1 - {first} as int)) & (shiftleft(1L, cast({first} as int)) - 1L))"
    for q in range(8):
        size = f"least(8, greatest(0, ({length}) - {first} - {8 * q}))"
        word += f" | if({size} = 0, 0L, shiftleft(shiftright({_byte(data, f'({start}) div 8 - {1 + q}')}, cast(8 - {size} as int)), cast(least(63, {first} + {8 * q}) as int)))"
    return F.expr(word)


def signed(raw: Column, bits: Column) -> Column:
    """raw with its sign bit, number bits - 1, extended; fields of 64 bits are signed as they are."""
    top = F.call_function("shiftleft", F.lit(1).cast("long"), (bits - 1).cast("int"))
    rest = F.call_function("shiftleft", F.lit(-1).cast("long"), bits.cast("int"))
    return F.when((bits < 64) & (raw.bitwiseAND(top) != 0), raw.bitwiseOR(rest)).otherwise(raw)


def raw_value(data: str = "data", compat: str = "mapper") -> Column:
    """The raw value of the signal columns (start_bit, length, little_endian)."""
    big = raw_descending(data, "start_bit", "length") if compat == "dbc" else raw_motorola(data, "start_bit", "length")
    return F.when(F.col("little_endian"), raw_little(data, "start_bit", "length")).otherwise(big)


def decimal_parts(most: int = 15) -> dict[str, Column]:
    """Of the signal columns (scale, offset): _den, the least power of ten up to 10^most that makes both whole, and _num and _add, both times it; null where there is none.

    Dictionaries state decimals, which doubles hold only nearly: 3 * 0.1 is above 0.3, 3 * 1 / 10 is not.
    """
    def whole(c: str, den: Column) -> Column:
        x = F.rint(F.col(c) * den)
        return (x / den == F.col(c)) & (F.abs(x) < 2.0**53)

    den = F.get(F.filter(F.array(*(F.lit(10.0**d) for d in range(most + 1))), lambda d: whole("scale", d) & whole("offset", d)), F.lit(0))
    return {"_den": den, "_num": F.rint(F.col("scale") * den), "_add": F.rint(F.col("offset") * den)}


def reached(data: str = "data") -> Column:
    """The bits of a signal (start_bit, length, little_endian) that a payload has: big-endian fields count whole."""
    return F.when(F.col("little_endian"), F.least(F.col("length"), 8 * F.size(data) - F.col("start_bit"))).otherwise(F.col("length"))


def in_payload(data: str = "data") -> Column:
    """Whether the signal columns give a value on a payload."""
    return (reached(data) > 0) & (F.expr("start_bit div 8") < F.size(data)) & F.col("scale").isNotNull() & F.col("offset").isNotNull()


def physical(raw: Column, data: str = "data") -> Column:
    """The physical value of a raw one and the signal columns (start_bit, length, little_endian, is_signed, scale, offset and decimal_parts()); null if it lies past the payload.

    It is the double nearest to the decimal value as long as whole numbers below 2^53 are met. Little-endian fields cut by the payload's end take
    their sign from the bits that are there. raw is read several times, so it should be a column of its own.
    """
    value = F.when(F.col("is_signed"), signed(raw, reached(data))).otherwise(raw).cast("double")
    whole = value * F.col("_num") + F.col("_add")
    exact = F.when((F.abs(value * F.col("_num")) < 2.0**53) & (F.abs(whole) < 2.0**53), whole / F.col("_den"))
    return F.when(in_payload(data), F.coalesce(exact, value * F.col("scale") + F.col("offset")))


def to_raw(value: Column) -> Column:
    """The raw value of a physical one: rounded half away from zero, held to the field's range; scale 0 gives 0."""
    raw = F.when(F.col("scale") == 0, F.lit(0.0)).otherwise(F.round((value - F.col("offset")) / F.nullif(F.col("scale"), F.lit(0.0))))
    n = F.least(F.col("length"), F.lit(63)).cast("int")
    low = F.when(F.col("is_signed"), -F.pow(F.lit(2.0), n - 1)).otherwise(F.lit(0.0))
    high = F.when(F.col("is_signed"), F.pow(F.lit(2.0), n - 1) - 1).otherwise(F.pow(F.lit(2.0), n) - 1)
    return F.least(high, F.greatest(low, raw)).cast("long")


def insert_little(data: Column, start: Column, length: Column, raw: Column) -> Column:
    """Data with a little-endian field replaced."""
    def byte(x: Column, j: Column) -> Column:
        def bit(a: Column, s: Column) -> Column:
            i = j * 8 + s - start
            mine = (i >= 0) & (i < length)
            new = F.call_function("shiftright", raw, F.when(mine, i).otherwise(0).cast("int")).bitwiseAND(F.lit(1).cast("long"))
            old = F.call_function("shiftright", x.cast("long"), s).bitwiseAND(F.lit(1).cast("long"))
            return a + F.call_function("shiftleft", F.when(mine, new).otherwise(old), s)

        return F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), bit).cast("short")

    return F.transform(data, byte)


def insert_motorola(data: Column, start: Column, length: Column, raw: Column) -> Column:
    """Data with a big-endian field (start is its highest bit) replaced."""
    def byte(x: Column, j: Column) -> Column:
        def bit(a: Column, s: Column) -> Column:
            i = j * 8 + (7 - s) - (F.floor(start / 8) * 8 + 7 - start % 8)
            mine = (i >= 0) & (i < length)
            new = F.call_function("shiftright", raw, F.when(mine, length - 1 - i).otherwise(0).cast("int")).bitwiseAND(F.lit(1).cast("long"))
            old = F.call_function("shiftright", x.cast("long"), s).bitwiseAND(F.lit(1).cast("long"))
            return a + F.call_function("shiftleft", F.when(mine, new).otherwise(old), s)

        return F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("long"), bit).cast("short")

    return F.transform(data, byte)


def rule_value() -> Column:
    """The value of a byte rule's columns (byte_idx, byte_len 1..4, little_endian, mask or null, is_signed, scale, offset) on ``data``; missing bytes read 0, a mask is shifted down to its lowest bit."""
    at = "cast(coalesce(get(data, byte_idx + if(little_endian, i, byte_len - 1 - i)), 0) as bigint)"
    raw = F.expr(f"aggregate(sequence(0, byte_len - 1), 0L, (a, i) -> a | shiftleft({at}, cast(8 * i as int)))")
    shift = F.expr("aggregate(sequence(0, 31), 32, (a, i) -> if(a = 32 AND (shiftright(mask, cast(i as int)) & 1L) = 1L, i, a))")
    cut = F.when(F.col("mask").isNull(), raw).when(F.col("mask") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", raw.bitwiseAND(F.col("mask")), shift.cast("int")))
    value = F.when(F.col("is_signed"), signed(cut, F.col("byte_len") * 8)).otherwise(cut)
    return value.cast("double") * F.col("scale") + F.col("offset")


@cache
def crc_table(poly: int) -> tuple[int, ...]:
    """The 256 steps of an 8-bit CRC, highest bit first."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = (x << 1 ^ poly if x & 0x80 else x << 1) & 0xFF
        out.append(x)
    return tuple(out)


#: Polynomial, first value, final XOR.
CRCS = {"crc8_j1850": (0x1D, 0xFF, 0x00), "crc8_autosar": (0x2F, 0xFF, 0xFF)}


def checksum(kind: str, start: int, stop: int, data: str = "data") -> Column:
    """A checksum over bytes start..stop (inclusive); 0 if the range isn't inside the payload. Kinds: xor, sum8, crc8_j1850, crc8_autosar."""
    part = F.transform(F.slice(data, start + 1, stop - start + 1), lambda x: x.cast("int"))
    if kind == "xor":
        value = F.aggregate(part, F.lit(0), lambda a, x: a.bitwiseXOR(x))
    elif kind == "sum8":
        value = F.aggregate(part, F.lit(0), lambda a, x: (a + x) % 256)
    else:
        poly, first, last = CRCS[kind]
        table = F.array(*map(F.lit, crc_table(poly)))
        value = F.aggregate(part, F.lit(first), lambda a, x: F.get(table, a.bitwiseXOR(x))).bitwiseXOR(F.lit(last))
    if start < 0 or stop < start or stop >= 64:
        return F.lit(0)
    return F.when(F.size(data) > stop, value).otherwise(0)


def checksum_ok(kind: str, at: int, start: int, stop: int, data: str = "data") -> Column:
    """Whether byte ``at`` holds the checksum of the range."""
    return F.coalesce(F.get(data, F.lit(at)).cast("int") == checksum(kind, start, stop, data), F.lit(False))


def hamming(a: str, b: str) -> Column:
    """Differing bits of two payloads, missing bytes 0."""
    at = lambda c, i: F.coalesce(F.get(c, i).cast("int"), F.lit(0))
    n = F.greatest(F.size(a), F.size(b))
    return F.when(n <= 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(0), lambda acc, i: acc + F.bit_count(at(a, i).bitwiseXOR(at(b, i))))).cast("long")


def cosine(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """Cosine of two vectors of doubles; 0 if either norm is under eps."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm(a) < eps) | (norm(b) < eps), F.lit(0.0)).otherwise(dot / (norm(a) * norm(b)))


def kph_to_mph(x: Column) -> Column:
    """X20."""
    return x * 0.6213751
