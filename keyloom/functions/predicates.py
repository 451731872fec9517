"""One function per leaf operator: from a key column (and its type) to a boolean Column about one entry.

A predicate never is NULL: callers see two-valued logic. Floats: NaN equals NaN, takes part in no ordered relation. Text
patterns never match a null key, not even negated ones; the empty string is an ordinary key.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns

Predicate = Callable[..., Column]
KINDS: dict[str, Predicate] = {}
#: Operators whose result is a complement of identities, with the operator that they complement.
COMPLEMENTS = {"NotInSet": "InSet", "YearNotIn": "YearIn"}
#: What `not` before a leaf turns its operator into; all others have no direct negation.
NEGATIONS: dict[str, str] = {}
#: Operators that compare text by a policy if they are given one.
ORDERED = {"EqualTo", "NotEqualTo", "GreaterThan", "GreaterOrEqual", "LessThan", "LessOrEqual", "Between", "NotBetween"}


def kind(name: str, negation: str | None = None) -> Callable[[Predicate], Predicate]:
    def put(f: Predicate) -> Predicate:
        KINDS[name] = f
        if negation:
            NEGATIONS[name], NEGATIONS[negation] = negation, name
        return f

    return put


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _real(k: Column, t: T.DataType) -> Column:
    """True where the key takes part in ordered relations."""
    return ~F.isnan(k) if isinstance(t, (T.FloatType, T.DoubleType)) else F.lit(True)


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _lit(v: Any, t: T.DataType) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, int) and abs(v) >= 1 << 63:
        v = Decimal(v)
    return F.lit(v).cast(t) if isinstance(t, (T.TimestampNTZType, T.TimestampType, T.DateType, T.DecimalType)) else F.lit(v)


# Comparisons and membership ------------------------------------------------------------------------------------------


@kind("All")
def everything(k: Column, t: T.DataType) -> Column:
    return F.lit(True)


@kind("EqualTo", "NotEqualTo")
def equal_to(k: Column, t: T.DataType, v: Any) -> Column:
    return k.isNull() if v is None else _true(k == _lit(v, t))


@kind("NotEqualTo")
def not_equal_to(k: Column, t: T.DataType, v: Any) -> Column:
    if v is None:
        return k.isNotNull()
    if isinstance(v, float) and v != v:
        return _true(~F.isnan(k))
    return _true(((k < _lit(v, t)) | (k > _lit(v, t))) & _real(k, t))


def _ordered(name: str, negation: str, test: Callable[[Column, Column], Column]) -> None:
    kind(name, negation)(lambda k, t, v: _true(test(k, _lit(v, t)) & _real(k, t)))


_ordered("GreaterThan", "LessOrEqual", lambda k, v: k > v)
_ordered("GreaterOrEqual", "LessThan", lambda k, v: k >= v)
_ordered("LessThan", "GreaterOrEqual", lambda k, v: k < v)
_ordered("LessOrEqual", "GreaterThan", lambda k, v: k <= v)


@kind("Between", "NotBetween")
def between(k: Column, t: T.DataType, lo: Any, hi: Any) -> Column:
    return _true(k.between(_lit(lo, t), _lit(hi, t)) & _real(k, t))


@kind("NotBetween")
def not_between(k: Column, t: T.DataType, lo: Any, hi: Any) -> Column:
    return _true(((k < _lit(lo, t)) | (k > _lit(hi, t))) & _real(k, t))


@kind("InSet", "NotInSet")
def in_set(k: Column, t: T.DataType, values: Iterable[Any]) -> Column:
    values = list(values)
    some = [_lit(v, t) for v in values if v is not None]
    hit = _true(k.isin(some)) if some else F.lit(False)
    return hit | k.isNull() if len(some) < len(values) else hit


@kind("ScalarNullState")
@kind("NullState")
def null_state(k: Column, t: T.DataType, state: str = "null") -> Column:
    """state: null, empty, null_or_empty, or one of these after ``not_``."""
    size = F.octet_length(k) if isinstance(t, (T.StringType, T.BinaryType)) else F.lit(1)
    empty = _true(size == 0)
    tests = {"null": k.isNull(), "empty": empty, "null_or_empty": k.isNull() | empty}
    return ~tests[state[4:]] if state.startswith("not_") else tests[state]


@kind("FloatClass")
def float_class(k: Column, t: T.DataType, name: str) -> Column:
    top = F.lit(float("inf"))
    infinite = (k == top) | (k == -top)
    return _true({"nan": F.isnan(k), "finite": ~F.isnan(k) & ~infinite, "infinity": infinite, "positive_infinity": k == top, "negative_infinity": k == -top, "non_finite": F.isnan(k) | infinite}[name])


@kind("BitAndEqualTo", "BitAndNotEqualTo")
def bits(k: Column, t: T.DataType, mask: int, value: int | None = None) -> Column:
    return _true(k.bitwiseAND(F.lit(mask)) == F.lit(mask if value is None else value))


@kind("BitAndNotEqualTo")
def bits_not(k: Column, t: T.DataType, mask: int, value: int = 0) -> Column:
    return _true(k.bitwiseAND(F.lit(mask)) != F.lit(value))


# Numbers, transformed first ------------------------------------------------------------------------------------------


def transformed(k: Column, how: str, digits: int = 0) -> Column:
    """how: floor, ceiling, truncate, or round_<to_even|away|to_zero|down|up>."""
    scale = F.lit(10**digits)
    toward_zero = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    whole = {"floor": F.floor, "ceiling": F.ceil, "truncate": toward_zero, "round_to_zero": toward_zero, "round_down": F.floor, "round_up": F.ceil}
    if how in whole:
        return whole[how](k) if not digits else whole[how](k * scale) / scale
    return {"round_to_even": F.bround, "round_away": F.round}[how](k, digits)


@kind("Transformed")
def compare_transformed(k: Column, t: T.DataType, how: str, digits: int, name: str, *values: Any) -> Column:
    x = transformed(k, how, digits)
    if name == "NotEqualTo":  # plain inequality, which a NaN key meets
        return _true(x != F.lit(values[0])) | (_true(F.isnan(k)) if isinstance(t, (T.FloatType, T.DoubleType)) else F.lit(False))
    inner = {"NotInSet": lambda: k.isNotNull() & ~in_set(x, T.LongType(), *values)}.get(name, lambda: KINDS[name](x, T.LongType(), *values))()
    return inner & _true(_real(k, t)) if name not in ("NotInSet",) else inner


# Text and binary patterns --------------------------------------------------------------------------------------------


def folded(policy: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    """What a policy compares instead of the text: ``ordinal`` (itself), ``ignore_case``, ``invariant_ignore_case``, ``unicode_ci``,
    ``normalized`` (NFC), ``sort_key`` (Unicode's order), ``culture:<locale>`` with a collation such as ``de_CI``, or a function of the key."""
    if callable(policy):
        return policy
    if policy.startswith("culture:"):
        return lambda c: F.collate(c, policy[8:])
    return {
        "ordinal": lambda c: c, "ignore_case": F.lower, "invariant_ignore_case": lambda c: F.collate(c, "UNICODE_CI"), "unicode_ci": lambda c: F.collate(c, "UNICODE_CI"),
        "normalized": patterns.nfc, "sort_key": lambda c: F.collate(c, "UNICODE"),
    }[policy]


def _fold(k: Column, v: Any, policy: str | Callable[[Column], Column]) -> tuple[Column, Any]:
    if policy == "ordinal":
        return k, v
    fold = folded(policy)
    return fold(k), fold(F.lit(v)) if not isinstance(v, list) else [fold(F.lit(x)) for x in v]


def _value(v: Any) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _text(name: str, negated: str, test: Callable[[Column, Any], Column]) -> None:
    def plain(k: Column, t: T.DataType, v: Any, policy: str = "ordinal") -> Column:
        a, b = _fold(k, v, policy)
        return _true(test(a, b))

    kind(name, negated)(plain)
    kind(negated)(lambda k, t, v, policy="ordinal": k.isNotNull() & ~plain(k, t, v, policy))


_text("StartsWith", "NotStartsWith", lambda k, v: k.startswith(_value(v)))
_text("EndsWith", "NotEndsWith", lambda k, v: k.endswith(_value(v)))
_text("Contains", "NotContains", lambda k, v: k.contains(_value(v)))


@kind("TextEquals")
def text_equals(k: Column, t: T.DataType, v: str, policy: str = "ignore_case") -> Column:
    a, b = _fold(k, v, policy)
    return _true(a == b)


@kind("TextInSet")
def text_in_set(k: Column, t: T.DataType, values: list[str], policy: str = "ignore_case") -> Column:
    a, b = _fold(k, [v for v in values if v is not None], policy)
    return _true(a.isin(b)) | (k.isNull() if None in values else F.lit(False))


@kind("MatchesPattern", "NotMatchesPattern")
def matches_pattern(k: Column, t: T.DataType, pattern: str, policy: str = "ordinal") -> Column:
    return _true(patterns.wildcard(F.lower(k) if policy == "ignore_case" else k, pattern.lower() if policy == "ignore_case" else pattern))


@kind("NotMatchesPattern")
def not_matches_pattern(k: Column, t: T.DataType, pattern: str, policy: str = "ordinal") -> Column:
    return k.isNotNull() & ~matches_pattern(k, t, pattern, policy)


@kind("RegexMatches", "NotRegexMatches")
def regex(k: Column, t: T.DataType, pattern: str) -> Column:
    head = patterns.literal_head(pattern)
    return _true(k.startswith(head) & k.rlike(pattern) if head else k.rlike(pattern))


@kind("NotRegexMatches")
def not_regex(k: Column, t: T.DataType, pattern: str) -> Column:
    return k.isNotNull() & ~regex(k, t, pattern)


@kind("MatchesInSet", "NotMatchesInSet")
def captured_in(k: Column, t: T.DataType, pattern: str, values: Iterable[str], group: int = 1) -> Column:
    return _true(k.rlike(pattern) & F.regexp_extract(k, pattern, group).isin(list(values)))


@kind("NotMatchesInSet")
def captured_not_in(k: Column, t: T.DataType, pattern: str, values: Iterable[str], group: int = 1) -> Column:
    return k.isNotNull() & ~captured_in(k, t, pattern, values, group)


@kind("MatchesWith", "NotMatchesWith")
def captured(k: Column, t: T.DataType, pattern: str, value: str, group: int = 1) -> Column:
    return captured_in(k, t, pattern, [value], group)


@kind("NotMatchesWith")
def not_captured(k: Column, t: T.DataType, pattern: str, value: str, group: int = 1) -> Column:
    return captured_not_in(k, t, pattern, [value], group)


@kind("HexPattern")
def hex_pattern(k: Column, t: T.DataType, pattern: str) -> Column:
    return _true(F.hex(k).rlike(patterns.hex_regex(pattern)))


@kind("BinarySliceEqual")
def slice_equal(k: Column, t: T.DataType, offset: int, value: bytes) -> Column:
    return _true((F.octet_length(k) >= offset + len(value)) & (F.substring(k, offset + 1, len(value)) == F.lit(value)))


def _typed(name: str, inner: str) -> None:
    def test(k: Column, t: T.DataType, offset: int, what: str, *values: Any, length: int | None = None, canonical: bool = False) -> Column:
        x, x_type = patterns.decoded(k, offset, what, length, canonical)
        return _true(x.isNotNull()) & KINDS[inner](x, x_type, *values)

    kind(name)(test)


for _name in ("EqualTo", "GreaterThan", "GreaterOrEqual", "LessThan", "LessOrEqual", "Between", "StartsWith", "Contains", "BitAndEqualTo", "BitAndNotEqualTo"):
    _typed(f"BinaryTypedSlice{_name}", _name)


@kind("GuidText")
def guid_text(k: Column, t: T.DataType, how: str, pattern: str) -> Column:
    """how: starts_with, ends_with, contains or matches; over hex digits alone, with x for any of them."""
    digits, p = F.lower(F.regexp_replace(k, "[^0-9A-Fa-f]", "")), patterns.nibbles(pattern)
    return _true(digits.rlike({"starts_with": f"^{p}", "ends_with": f"{p}$", "contains": p, "matches": f"^{p}$"}[how]))


@kind("GuidSlice")
def guid_slice(k: Column, t: T.DataType, first: int, count: int, value: str | int | bytes) -> Column:
    digits = F.lower(F.substring(F.regexp_replace(k, "-", ""), first + 1, count))
    want = value.hex() if isinstance(value, bytes) else f"{value:0{count}x}" if isinstance(value, int) else value.replace("-", "").lower()
    return _true(digits == want)


# Dates ---------------------------------------------------------------------------------------------------------------


def _span(k: Column, t: T.DataType, lo: dt.datetime | dt.date, hi: dt.datetime | dt.date) -> Column:
    """lo <= k < hi, as a range that scans can prune by."""
    return (k >= _lit(lo, t)) & (k < _lit(hi, t))


def _year(y: int) -> dt.datetime:
    return dt.datetime(y, 1, 1)


def _month(y: int, m: int) -> dt.datetime:
    return dt.datetime(y + (m - 1) // 12, (m - 1) % 12 + 1, 1)


def _date(name: str, test: Callable[..., Column], negation: str | None = None) -> None:
    kind(name, negation)(lambda k, t, *v, **o: _true(test(k, t, *v, **o)))


_date("YearEqualTo", lambda k, t, y: _span(k, t, _year(y), _year(y + 1)), "YearNotEqualTo")
_date("YearNotEqualTo", lambda k, t, y: ~_span(k, t, _year(y), _year(y + 1)))
_date("YearIn", lambda k, t, ys: _any(_span(k, t, _year(y), _year(y + 1)) for y in ys), "YearNotIn")
_date("YearRange", lambda k, t, a, b: _span(k, t, _year(a), _year(b + 1)), "YearNotRange")
_date("YearNotRange", lambda k, t, a, b: ~_span(k, t, _year(a), _year(b + 1)))
_date("YearOnOrAfter", lambda k, t, y: k >= _lit(_year(y), t))
_date("YearOnOrBefore", lambda k, t, y: k < _lit(_year(y + 1), t))
_date("YearMonth", lambda k, t, y, m: _span(k, t, _month(y, m), _month(y, m + 1)))
_date("YearMonthIn", lambda k, t, yms: _any(_span(k, t, _month(y, m), _month(y, m + 1)) for y, m in yms))
_date("YearMonthDay", lambda k, t, y, m, d: _span(k, t, dt.datetime(y, m, d), dt.datetime(y, m, d) + dt.timedelta(1)))
_date("YearMonthDayIn", lambda k, t, days: _any(_span(k, t, dt.datetime(*d), dt.datetime(*d) + dt.timedelta(1)) for d in days))
_date("YearInMonths", lambda k, t, y, ms: _any(_span(k, t, _month(y, m), _month(y, m + 1)) for m in ms))
_date("YearQuarter", lambda k, t, y, q: _span(k, t, _month(y, 3 * q - 2), _month(y, 3 * q + 1)))


def _component(prefix: str, part: Callable[[Column], Column], negated_range: str) -> None:
    _date(f"{prefix}EqualTo", lambda k, t, v: part(k) == v, f"{prefix}NotEqualTo")
    _date(f"{prefix}NotEqualTo", lambda k, t, v: part(k) != v)
    _date(f"{prefix}In", lambda k, t, vs: part(k).isin(list(vs)), f"{prefix}NotIn")
    _date(f"{prefix}NotIn", lambda k, t, vs: ~part(k).isin(list(vs)))
    _date(f"{prefix}Range", lambda k, t, a, b: part(k).between(a, b), negated_range)
    _date(negated_range, lambda k, t, a, b: ~part(k).between(a, b))


_component("Month", F.month, "MonthNotRange")
_component("Day", F.dayofmonth, "DayNotRange")
_component("Hour", F.hour, "HourNotRange")
_date("QuarterEqualTo", lambda k, t, q: F.quarter(k) == q)
_date("InQuarter", lambda k, t, q: F.quarter(k) == q)
_date("InQuarterRange", lambda k, t, a, b: F.quarter(k).between(a, b))
_date("MonthDay", lambda k, t, m, d: (F.month(k) == m) & (F.dayofmonth(k) == d))
_starts = lambda ms: lambda k, t: F.month(k).isin(ms) & (F.dayofmonth(k) == 1)
_ends = lambda ms: lambda k, t: F.month(k).isin(ms) & (F.to_date(k) == F.last_day(k))
_date("IsQuarterStart", _starts([1, 4, 7, 10]))
_date("IsQuarterEnd", _ends([3, 6, 9, 12]))
_date("IsHalfYearStart", _starts([1, 7]))
_date("IsHalfYearEnd", _ends([6, 12]))
_date("IsFirstOfMonth", lambda k, t: F.dayofmonth(k) == 1)
_date("IsLastOfMonth", lambda k, t: F.to_date(k) == F.last_day(k))
_date("IsWeekend", lambda k, t: F.weekday(k) >= 5, "IsWeekday")
_date("IsWeekday", lambda k, t: F.weekday(k) < 5)
_date("IsMorning", lambda k, t: F.hour(k).between(5, 11))
_date("IsAfternoon", lambda k, t: F.hour(k).between(12, 16))
_date("IsEvening", lambda k, t: F.hour(k).between(17, 21))
_date("IsNight", lambda k, t: (F.hour(k) >= 22) | (F.hour(k) <= 4))


def _now(now: dt.datetime | None) -> dt.datetime:
    return now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _day(now: dt.datetime | None, back: int = 0) -> dt.datetime:
    return dt.datetime.combine(_now(now).date(), dt.time()) - dt.timedelta(back)


def _since(k: Column, t: T.DataType, now: dt.datetime | None, ago: dt.timedelta) -> Column:
    if isinstance(t, T.DateType):  # dates end today
        return (k >= F.lit((_now(now) - ago).date())) & (k <= F.lit(_now(now).date()))
    return k >= _lit(_now(now) - ago, t)


_date("IsToday", lambda k, t, now=None: _span(k, t, _day(now), _day(now, -1)))
_date("IsYesterday", lambda k, t, now=None: _span(k, t, _day(now, 1), _day(now)))
_date("IsInLastDays", lambda k, t, n, now=None: _since(k, t, now, dt.timedelta(days=n)))
_date("IsInLastHours", lambda k, t, n, now=None: _since(k, t, now, dt.timedelta(hours=n)))
_date("IsInLastMinutes", lambda k, t, n, now=None: _since(k, t, now, dt.timedelta(minutes=n)))
