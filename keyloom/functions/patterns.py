"""Wildcards, hex patterns, binary decoding and normalisation, as Columns."""

from __future__ import annotations

import re
from decimal import Context, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Integer slices: bytes, signed, and the type they are compared as.
INTEGERS = {"sbyte": (1, True), "byte": (1, False), "int16": (2, True), "uint16": (2, False), "int32": (4, True), "uint32": (4, False), "int64": (8, True), "uint64": (8, False)}
CHARSETS = {"utf8": "UTF-8", "latin1": "ISO-8859-1", "utf16": "UTF-16LE", "ascii": "US-ASCII", "utf32": "UTF-32"}
#: Hex digits of well-formed text: surrogates in pairs, code points up to 10FFFF that are no surrogates.
WELL_FORMED = {
    "latin1": r"\A(?:..)*\z", "ascii": r"\A(?:[0-7].)*\z", "utf16": r"\A(?:..(?:[0-9A-CEF].|D[0-7])|..D[89AB]..D[C-F])*\z",
    "utf32": r"\A(?:..(?:[0-9A-CEF].|D[0-7])0000|....(?:0[1-9A-F]|10)00)*\z",
}
#: Integers of over 64 bits (bytes, signed; a bigint's bytes are the slice's length), and counts of 100 ns: since 0001-01-01, or of a span.
BIG = {"int128": (16, True), "uint128": (16, False), "bigint": (0, True)}
WIDE = Context(prec=60)
TICKS = ("datetime", "timespan")
EPOCH_MICROS = 62_135_596_800_000_000


def wildcard(k: Column, pattern: str) -> Column:
    """Whole-text match: * any text, ? one character, \\* and \\? themselves. Simple shapes become comparisons that scans can use."""
    parts = re.findall(r"\\[*?]|[*?]|(?:\\(?![*?])|[^*?\\])+", pattern)
    literal = lambda ps: "".join(p[1] if re.fullmatch(r"\\[*?]", p) else p for p in ps)
    special = [p for p in parts if p in ("*", "?")]
    if not special:
        return k == literal(parts)
    if special == ["*"] and parts[-1] == "*":
        return k.startswith(literal(parts[:-1]))
    if special == ["*"] and parts[0] == "*":
        return k.endswith(literal(parts[1:]))
    if special == ["*", "*"] and parts[0] == parts[-1] == "*":
        return k.contains(literal(parts[1:-1]))
    return k.rlike("(?s)\\A" + "".join({"*": ".*", "?": "."}.get(p) or java_quote(literal([p])) for p in parts) + "\\z")


def java_quote(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|\-&#~<>=!])", r"\\\1", text)


def literal_head(pattern: str) -> str:
    """Text that every match of an anchored regex starts with."""
    m = re.match(r"\^([A-Za-z0-9 _,:;@/%-]+)", pattern)
    if not m or "|" in pattern:
        return ""
    head, rest = m[1], pattern[m.end() :]
    return head[:-1] if rest[:1] in ("*", "?", "{") else head


def hex_regex(pattern: str) -> str:
    """Hex digits with ? or x for one digit and * for any bytes."""
    return "(?s)\\A" + "".join({"?": "[0-9A-F]", "X": "[0-9A-F]", "*": "(?:[0-9A-F]{2})*"}.get(c, c) for c in pattern.upper() if c not in " -") + "\\z"


def nibbles(pattern: str) -> str:
    return "".join("[0-9a-f]" if c == "x" else c for c in pattern.lower() if c in "0123456789abcdefx")


@F.pandas_udf(T.StringType())
def nfc(x: pd.Series) -> pd.Series:
    import unicodedata

    return x.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(T.DoubleType())
def _double(x: pd.Series) -> pd.Series:
    import struct

    return x.map(lambda b: None if b is None else struct.unpack({4: "<f", 8: "<d"}[len(b)], b)[0])


def _big(raw: Column, signed: bool, canonical: Column) -> Column:
    """An integer of any number of bytes, least first (canonical: most first, sign bit flipped); null where 38 digits don't hold it."""

    @F.pandas_udf(T.DecimalType(38, 0))
    def whole(x: pd.Series, c: pd.Series) -> pd.Series:
        def one(b, flip):
            if b is None:
                return None
            v = int.from_bytes(b, "big" if flip else "little", signed=signed and not flip)
            v -= 1 << (8 * len(b) - 1) if flip and signed else 0
            return Decimal(v) if abs(v) < 10**38 else None

        return pd.Series([one(b, f) for b, f in zip(x, c)], dtype=object)

    return whole(raw, canonical)


@F.pandas_udf(T.DecimalType(38, 18))
def _decimal(x: pd.Series) -> pd.Series:
    """96 bits, then a word with the scale in its third byte and the sign in its highest bit; null where it is no such number or too long."""

    def one(b):
        if b is None:
            return None
        flags = int.from_bytes(b[12:], "little")
        scale = flags >> 16 & 0xFF
        if scale > 28 or flags & 0x7F00FFFF:
            return None
        v = Decimal(f"{'-' * (flags >> 31)}{int.from_bytes(b[:12], 'little')}E-{scale}")
        return v.quantize(Decimal("1E-18"), context=WIDE) if abs(v) < 10**20 else None

    return x.map(one)


def decoded(k: Column, offset: int, what: str, length: int | None = None, canonical: bool = False) -> tuple[Column, T.DataType]:
    """A slice as a value; null if the key is too short or, for text, malformed. canonical: big-endian with the sign bit flipped."""
    if what in INTEGERS:
        size, signed = INTEGERS[what]
        raw = F.substring(k, offset + 1, size)
        digits = F.hex(raw) if canonical else F.concat(*[F.substring(F.hex(raw), 2 * i + 1, 2) for i in reversed(range(size))])
        wide = F.conv(digits, 16, 10).cast("decimal(20,0)")
        half = 1 << (8 * size - 1)
        if signed:
            wide = wide - F.lit(Decimal(half)) if canonical else F.when(wide >= F.lit(Decimal(half)), wide - F.lit(Decimal(2 * half))).otherwise(wide)
        value = wide.cast("decimal(20,0)") if what == "uint64" else wide.cast("long")
        return F.when(F.octet_length(k) >= offset + size, value), T.DecimalType(20, 0) if what == "uint64" else T.LongType()
    if what in ("single", "double"):
        size = {"single": 4, "double": 8}[what]
        return _double(F.when(F.octet_length(k) >= offset + size, F.substring(k, offset + 1, size))), T.DoubleType()
    if what == "guid":
        h = F.lower(F.hex(F.substring(k, offset + 1, 16)))
        return F.when(F.octet_length(k) >= offset + 16, h), T.StringType()
    if what in BIG:
        size, signed = BIG[what] if what != "bigint" else (length, True)
        raw = F.substring(k, offset + 1, size)
        return F.when(F.octet_length(k) >= offset + size, _big(raw, signed, F.lit(canonical))), T.DecimalType(38, 0)
    if what == "decimal":
        return F.when(F.octet_length(k) >= offset + 16, _decimal(F.substring(k, offset + 1, 16))), T.DecimalType(38, 18)
    if what in TICKS:
        ticks, _ = decoded(k, offset, "int64", None, canonical)
        ticks = ticks.bitwiseAND(F.lit((1 << 62) - 1)) if what == "datetime" else ticks  # the two highest bits tell the kind
        micros = F.floor(ticks / F.lit(Decimal(10))).cast("long") - F.lit(EPOCH_MICROS if what == "datetime" else 0)
        return (F.timestamp_micros(micros).cast("timestamp_ntz"), T.TimestampNTZType()) if what == "datetime" else (micros, T.LongType())
    if what == "date":  # days since 0001-01-01
        days, _ = decoded(k, offset, "int32", None, canonical)
        return F.date_add(F.lit("0001-01-01").cast("date"), days.cast("int")), T.DateType()
    if what in ("char", "rune"):
        unit, _ = decoded(k, offset, "uint16" if what == "char" else "uint32", None, canonical)
        fine = (unit < 0xD800) | ((unit > 0xDFFF) & (unit <= 0x10FFFF))
        return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(unit), 8, "0")), "UTF-32")), T.StringType()
    raw = F.substring(k, offset + 1, length if length is not None else 1 << 30)
    whole = F.octet_length(k) >= offset + (length or 0)
    if what == "utf8":
        return F.when(whole, F.try_validate_utf8(raw.cast("string"))), T.StringType()
    # Spark's decoder fails on malformed bytes, so it gets well-formed ones only.
    fine = whole & F.hex(raw).rlike(WELL_FORMED[what])
    if what == "utf32":  # the decoder wants the highest byte first
        raw = F.unhex(F.regexp_replace(F.hex(raw), "(..)(..)(..)(..)", "$4$3$2$1"))
    return F.when(fine, F.decode(raw, CHARSETS[what])), T.StringType()
