"""Immutable conditions: leaves over named indexes, joined left to right without precedence.

    where("age").greater_or_equal(18).and_("status").equal_to(1)
    (where("age") >= 18) & (where("status") == 1)        # the same
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame

from ..functions.predicates import COMPLEMENTS, KINDS, NEGATIONS


class Parameter:
    """An operand whose value is looked up once per execution."""

    def __init__(self, value: Any = None):
        self.value = value


@dataclass(frozen=True)
class Condition:
    def __and__(self, other: Condition) -> Condition:
        return Both(self, other)

    def __or__(self, other: Condition) -> Condition:
        return Either(self, other)

    def __invert__(self) -> Condition:
        return Not(self)

    def except_(self, other: Condition) -> Condition:
        return Except(self, other)

    def and_(self, index: str) -> Selector:
        return Selector(index, before=self, join=Both)

    def or_(self, index: str) -> Selector:
        return Selector(index, before=self, join=Either)

    def children(self) -> tuple[Condition, ...]:
        return ()

    def indexes(self) -> list[str]:
        return sorted({i for c in self.children() for i in c.indexes()})


@dataclass(frozen=True)
class Leaf(Condition):
    index: str
    kind: str
    args: tuple = ()
    options: tuple = ()
    guarded: bool = False
    part: str | None = None

    def indexes(self) -> list[str]:
        return [self.index]


@dataclass(frozen=True)
class KeysExistAll(Condition):
    index: str
    keys: tuple

    def indexes(self) -> list[str]:
        return [self.index]


@dataclass(frozen=True)
class External(Condition):
    """Identities from outside: a DataFrame whose first column they are."""

    ids: DataFrame = field(compare=False)


@dataclass(frozen=True)
class ExternalTest(Condition):
    """A Column function of the identity, over the identities that another condition leaves."""

    test: Callable[[Column], Column] = field(compare=False)


@dataclass(frozen=True)
class ExternalKeys(Condition):
    """A predicate over entries from outside: a DataFrame of identity and key, in this order."""

    entries: DataFrame = field(compare=False)
    kind: str = "All"
    args: tuple = ()
    options: tuple = ()


@dataclass(frozen=True)
class CorrelatedKeys(Condition):
    """A predicate over keys made for each identity that another condition leaves: a Column function from identity to an array."""

    keys: Callable[[Column], Column] = field(compare=False)
    kind: str = "All"
    args: tuple = ()
    options: tuple = ()


@dataclass(frozen=True)
class OrdinalTest(Condition):
    """A Column function of (identity, its number in ascending order, if it is the first) over the identities of another condition."""

    test: Callable[[Column, Column, Column], Column] = field(compare=False)


class PreparedSet:
    """Keys for ``in_set`` or ``not_in_set`` that are met in a join instead of written into the plan: a DataFrame's first column, made
    distinct once and, with ``cached``, kept until ``release``."""

    def __init__(self, keys: DataFrame, cached: bool = False):
        self.column = keys.columns[0]
        self.keys = keys.select(self.column).distinct()
        if cached:
            self.keys = self.keys.persist()

    def count(self) -> int:
        return self.keys.count()

    def release(self) -> None:
        self.keys.unpersist()


@dataclass(frozen=True)
class ByIdentity(Condition):
    """A predicate on the identity itself, over the identities of the set."""

    kind: str
    args: tuple = ()


@dataclass(frozen=True)
class CompareKeys(Condition):
    """Keys of two indexes of one identity; an identity without a key in either never matches."""

    left: str
    right: str
    op: str

    def indexes(self) -> list[str]:
        return sorted({self.left, self.right})


@dataclass(frozen=True)
class Composite(Condition):
    """A test of several parts of one composite entry; ``test`` gets the parts as Columns."""

    index: str
    test: Callable[[dict[str, Column]], Column] = field(compare=False)

    def indexes(self) -> list[str]:
        return [self.index]


@dataclass(frozen=True)
class _Pair(Condition):
    left: Condition
    right: Condition

    def children(self) -> tuple[Condition, ...]:
        return self.left, self.right


class Both(_Pair):
    pass


class Either(_Pair):
    pass


class Except(_Pair):
    pass


@dataclass(frozen=True)
class Not(Condition):
    inner: Condition

    def children(self) -> tuple[Condition, ...]:
        return (self.inner,)


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name).lstrip("_")


#: Builder method for each operator kind.
METHODS = {_snake(k): k for k in (*KINDS, *COMPLEMENTS)}


class Selector:
    """An index, waiting for its operator: every operator kind is a method in snake case."""

    def __init__(self, index: str, before: Condition | None = None, join: type[_Pair] = Both, negated: bool = False, guarded: bool = False, part: str | None = None):
        self._s = (index, before, join, negated, guarded, part)

    def _done(self, made: Condition) -> Condition:
        _, before, join, negated, _, _ = self._s
        if negated:
            if not (isinstance(made, Leaf) and made.kind in NEGATIONS):
                raise ValueError(f"{getattr(made, 'kind', made)} has no direct negation; negate the whole condition")
            made = Leaf(made.index, NEGATIONS[made.kind], made.args, made.options, made.guarded, made.part)
        return made if before is None else join(before, made)

    def __getattr__(self, name: str) -> Callable[..., Condition]:
        if name not in METHODS:
            raise AttributeError(name)
        index, _, _, _, guarded, part = self._s
        return lambda *a, **o: self._done(Leaf(index, METHODS[name], a, tuple(o.items()), guarded, part))

    @property
    def not_(self) -> Selector:
        index, before, join, _, guarded, part = self._s
        return Selector(index, before, join, True, guarded, part)

    @property
    def exists(self) -> Selector:
        """Without such an index the leaf is empty, not an error."""
        index, before, join, negated, _, part = self._s
        return Selector(index, before, join, negated, True, part)

    def __eq__(self, v: Any) -> Condition:  # type: ignore[override]
        return self.equal_to(v)

    def __ne__(self, v: Any) -> Condition:  # type: ignore[override]
        return self.not_equal_to(v)

    def __gt__(self, v: Any) -> Condition:
        return self.greater_than(v)

    def __ge__(self, v: Any) -> Condition:
        return self.greater_or_equal(v)

    def __lt__(self, v: Any) -> Condition:
        return self.less_than(v)

    def __le__(self, v: Any) -> Condition:
        return self.less_or_equal(v)

    __hash__ = None  # type: ignore[assignment]

    def is_null(self) -> Condition:
        return self.null_state("null")

    def is_not_null(self) -> Condition:
        return self.null_state("not_null")

    def is_empty(self) -> Condition:
        return self.null_state("empty")

    def is_not_empty(self) -> Condition:
        return self.null_state("not_empty")

    def is_null_or_empty(self) -> Condition:
        return self.null_state("null_or_empty")

    def is_not_null_or_empty(self) -> Condition:
        return self.null_state("not_null_or_empty")

    def is_nan(self) -> Condition:
        return self.float_class("nan")

    def is_finite(self) -> Condition:
        return self.float_class("finite")

    def is_infinity(self) -> Condition:
        return self.float_class("infinity")

    def is_non_finite(self) -> Condition:
        return self.float_class("non_finite")

    def all_bits_set(self, mask: int) -> Condition:
        return self.bit_and_equal_to(mask, mask)

    def any_bits_set(self, mask: int) -> Condition:
        return self.bit_and_not_equal_to(mask, 0)

    def no_bits_set(self, mask: int) -> Condition:
        return self.bit_and_equal_to(mask, 0)

    def like(self, pattern: str, **o: Any) -> Condition:
        return self.matches_pattern(pattern, **o)

    def exists_any(self, keys: list) -> Condition:
        """Identities that hold any of the keys; no keys: all identities."""
        return self.in_set(keys if isinstance(keys, PreparedSet) else list(keys)) if keys else self.all()

    def exists_all(self, keys: list) -> Condition:
        return self._done(KeysExistAll(self._s[0], tuple(dict.fromkeys(keys)))) if keys else self.all()


def where(index: str, part: str | None = None) -> Selector:
    """``part``: of a composite index."""
    return Selector(index, part=part)


def group(condition: Condition) -> Condition:
    return condition


def external(ids: DataFrame) -> Condition:
    return External(ids)


class ExternalSelector:
    """Entries from outside, or keys made for each identity, waiting for their operator."""

    def __init__(self, make: type[Condition], source: Any):
        self._make, self._source = make, source

    def __getattr__(self, name: str) -> Callable[..., Condition]:
        if name not in METHODS:
            raise AttributeError(name)
        return lambda *a, **o: self._make(self._source, METHODS[name], a, tuple(o.items()))


def external_keys(entries: DataFrame) -> ExternalSelector:
    """``external_keys(df).greater_than(5)``: identities of df's entries (identity, key) whose key matches."""
    return ExternalSelector(ExternalKeys, entries)


def correlated_keys(keys: Callable[[Column], Column]) -> ExternalSelector:
    """``where(...) & correlated_keys(lambda i: F.array(i % 7)).equal_to(3)``: for each identity the keys that a function makes."""
    return ExternalSelector(CorrelatedKeys, keys)


class MultiKey:
    """Several indexes, selected by their place: ``MultiKey("age", "status").where(0) > 18``."""

    def __init__(self, *indexes: str):
        self.indexes = indexes

    def where(self, ordinal: int, part: str | None = None) -> Selector:
        if not 0 <= ordinal < len(self.indexes):
            raise IndexError(f"no index at {ordinal}")
        return where(self.indexes[ordinal], part)
