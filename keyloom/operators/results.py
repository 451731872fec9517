"""Executing conditions: identities, counts, keys of other indexes, orders, pages, groups and their representatives."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import folded
from ..plans import conditions as C
from ..plans.compiler import Compiler, classify, ordinals
from ..sources.catalog import IndexSet


class ResultError(ValueError):
    """An identity has no key, or several, where a result needs exactly one."""


def _down(column: Column, descending: bool) -> Column:
    return column.desc() if descending else column.asc()


@dataclass(frozen=True)
class Bookmark:
    """Where a page ended: the order value and identity of its last row."""

    key: Any
    identity: Any
    descending: bool = False
    #: State of the ordering index (its version in the catalog) that the page was read from.
    version: int | None = None


class BookmarkError(ValueError):
    """A bookmark is of another order, or of another state of its index."""


class Query:
    """A condition over an index set. Methods return DataFrames; nothing runs before they are used."""

    def __init__(self, indexes: IndexSet, condition: C.Condition, plan: str = "auto"):
        self.set, self.condition, self.plan = indexes, condition, plan

    def identities(self, preserve: bool = False, order: str | None = None, skip: int = 0, take: int | None = None) -> DataFrame:
        """order: None, "asc" or "desc"; skip and take come after duplicates are gone."""
        if skip < 0 or take is not None and take < 0:
            raise ValueError("skip and take are not negative")
        out = Compiler(self.set).identities(self.condition, preserve, self.plan)
        if order:
            out = out.orderBy(_down(F.col("identity"), order == "desc"))
        out = out.offset(skip) if skip else out
        return out.limit(take) if take is not None else out

    def combined(self, how: str, *others: Query) -> DataFrame:
        """Identities of this query joined to those of others, each once; how: union, intersect or except. The sets may differ, their identity type not."""
        step = {"union": lambda a, b: a.unionByName(b), "intersect": lambda a, b: a.join(b, "identity", "left_semi"), "except": lambda a, b: a.join(b, "identity", "left_anti")}[how]
        return reduce(step, [q.identities() for q in (self, *others)]).distinct()

    def count(self, preserve: bool = False) -> DataFrame:
        return self.identities(preserve).agg(F.count(F.lit(1)).alias("n"))

    def exists(self) -> bool:
        return not self.identities(preserve=True).isEmpty()

    def iterate(self, **o: Any) -> Iterator[Any]:
        return (r[0] for r in self.identities(**o).toLocalIterator())

    # Keys of other indexes

    def tuples(self, index: str) -> DataFrame:
        """Entries of one index whose identity matches."""
        e = self.set[index].entries()
        if self.set[index].wide and Compiler(self.set).can_be_wide(self.condition):
            return self.set.base.where(Compiler(self.set).test(self.condition)).select(F.col(self.set.identity).alias("identity"), F.col(self.set[index].column).alias("key"))
        return e.join(self.identities(), "identity", "left_semi")

    def returning(self, *indexes: str, strict: bool | None = None) -> DataFrame:
        """identity and one key of each index. An identity without exactly one key in each fails the query when it is run; ``strict``
        looks for such identities here and raises ResultError; ``strict=False`` gives a row for each of several keys, none for none."""
        c = Compiler(self.set)
        if all(self.set[i].wide for i in indexes) and c.can_be_wide(self.condition):
            return self.set.base.where(c.test(self.condition)).select(F.col(self.set.identity).alias("identity"), *[F.col(self.set[i].column).alias(f"key{n}") for n, i in enumerate(indexes, 1)])
        ids = out = self.identities()
        for n, i in enumerate(indexes, 1):
            e = self.set[i].entries()
            if strict is False:
                out = out.join(e.distinct().withColumnRenamed("key", f"key{n}"), "identity")
                continue
            keys = e.join(ids, "identity", "left_semi").groupBy("identity").agg(F.min(F.struct("key")).alias("lo"), F.max(F.struct("key")).alias("hi"))
            one = F.coalesce(F.col("lo").eqNullSafe(F.col("hi")) & F.col("lo").isNotNull(), F.lit(False))
            if strict and not out.select("identity").join(keys, "identity", "left").where(~one).isEmpty():
                raise ResultError(f"not one key of {i} for each identity")
            wrong = F.raise_error(F.concat(F.lit(f"not one key of {i} for identity "), F.col("identity").cast("string")))
            key = F.when(one, F.col("lo.key")).otherwise(wrong.cast(e.schema["key"].dataType))
            out = out.join(keys, "identity", "left").withColumn(f"key{n}", key).drop("lo", "hi")
        return out

    def transform(self, index: str, change: Callable[[Column], Column]) -> DataFrame:
        """(identity, value): a function of each matching entry's key, as a Column function (a pandas UDF is one, too)."""
        return self.tuples(index).select("identity", change(F.col("key")).alias("value"))

    def _one_key_each(self, index: str) -> None:
        """An order by an index is defined only where no matching identity has several keys in it."""
        if not self.set[index].single_key and not self.tuples(index).distinct().groupBy("identity").count().where("count > 1").isEmpty():
            raise ResultError(f"{index} has several keys for an identity and can't order results")

    def ordered(self, index: str, descending: bool = False, top: int | None = None, bottom: int | None = None, skip: int = 0, by: Callable[[Column], Column] | None = None) -> DataFrame:
        """(identity, key) by the key of an index, or by a function of it (a comparer's sort key); bottom: the last n, in the order asked for."""
        if any(n is not None and n < 1 for n in (top, bottom)) or skip < 0:
            raise ValueError("top and bottom are 1 at least, skip is not negative")
        self._one_key_each(index)
        rows = self.tuples(index).distinct() if not self.set[index].single_key else self.tuples(index)
        key = by(F.col("key")) if by else F.col("key")
        order = lambda d: [_down(key, d), _down(F.col("identity"), d)]
        if bottom is not None:
            return rows.orderBy(*order(not descending)).limit(bottom).orderBy(*order(descending))
        rows = rows.orderBy(*order(descending))
        rows = rows.offset(skip) if skip else rows
        return rows.limit(top) if top is not None else rows

    def page(self, index: str, size: int, after: Bookmark | None = None, descending: bool = False) -> tuple[list, Bookmark | None]:
        """A page of (identity, key) and the bookmark to go on from; the filter skips what came before without reading it in order."""
        version = self.set[index].version
        if after is not None and (after.descending != descending or after.version != version):
            raise BookmarkError("the bookmark is of another order" if after.descending != descending else f"{index} has changed since the bookmark")
        rows = self.tuples(index)
        if after is not None:
            k, i, key, identity = F.lit(after.key), F.lit(after.identity), F.col("key"), F.col("identity")
            beyond = identity < i if descending else identity > i
            if after.key is None:  # nulls are first, or last if descending
                later = key.isNull() & beyond if descending else key.isNotNull() | beyond
            else:
                later = (key < k) | key.isNull() if descending else key > k
                later = later | (key.eqNullSafe(k) & beyond)
            rows = rows.where(later)
        got = rows.orderBy(_down(F.col("key"), descending), _down(F.col("identity"), descending)).limit(size).collect()
        return got, Bookmark(got[-1].key, got[-1].identity, descending, version) if got else None

    # Groups

    def group_by(self, index: str, fold: str | Callable[[Column], Column] = "exact") -> Groups:
        return Groups(self, index, fold)

    # Diagnostics

    def explain(self) -> str:
        return self.identities()._jdf.queryExecution().explainString(self.set_mode("formatted"))

    def set_mode(self, mode: str):
        any_index = next(iter(self.set.names()))
        jvm = self.set[any_index].entries().sparkSession._jvm
        return jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)

    def classify(self) -> list[tuple[str, str, str]]:
        return classify(self.set, self.condition)

    def measure(self) -> dict[str, Any]:
        began = time.perf_counter()
        n = self.count().first().n
        return {"rows": n, "seconds": time.perf_counter() - began, "leaves": self.classify()}


class Groups:
    """Matching identities by the keys of a grouping index. Columns: key, identity. ``fold``: exact, folded, date, or a text policy."""

    def __init__(self, query: Query, index: str, fold: str | Callable[[Column], Column] = "exact", having: Column | None = None):
        self.query, self.index, self.fold, self.having = query, index, fold, having

    def rows(self) -> DataFrame:
        return self.query.tuples(self.index).withColumn("key", self._fold(F.col("key")))

    def _fold(self, key: Column) -> Column:
        return {"exact": lambda c: c, "folded": F.lower, "date": F.to_date}[self.fold](key) if self.fold in ("exact", "folded", "date") else folded(self.fold)(key)

    def _with(self, index: str, name: str) -> DataFrame:
        """(key, identity, name): the group's entries with each key of another index; one scan where both are columns of one table."""
        q, c = self.query, Compiler(self.query.set)
        if q.set[self.index].wide and q.set[index].wide and c.can_be_wide(q.condition) and self.having is None:
            row = q.set.base.where(c.test(q.condition))
            return row.select(self._fold(F.col(q.set[self.index].column)).alias("key"), F.col(q.set.identity).alias("identity"), F.col(q.set[index].column).alias(name))
        return self._kept().distinct().join(q.set[index].entries().withColumnRenamed("key", name), "identity").select("key", "identity", name)

    def counts(self, order: str = "key", descending: bool = False, top: int | None = None) -> DataFrame:
        """(key, n): entries of each group; order: key or count (ties by key)."""
        out = self.rows().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        out = out if self.having is None else out.where(self.having)
        by = [_down(F.col("key"), descending)] if order == "key" else [_down(F.col("n"), descending), F.col("key").asc()]
        return out.orderBy(*by).limit(top) if top is not None else out

    def having_count(self, least: int | None = None, most: int | None = None, exactly: int | None = None) -> Groups:
        n, test = F.col("n"), F.lit(True)
        for v, t in ((least, lambda: n >= least), (most, lambda: n <= most), (exactly, lambda: n == exactly)):
            test = test & t() if v is not None else test
        return Groups(self.query, self.index, self.fold, test)

    def duplicates(self) -> Groups:
        return self.having_count(least=2)

    def singletons(self) -> Groups:
        return self.having_count(exactly=1)

    def _kept(self) -> DataFrame:
        return self.rows() if self.having is None else self.rows().join(self.counts().select(F.col("key").alias("k")), F.col("key").eqNullSafe(F.col("k")), "left_semi")

    def extreme(self, index: str, largest: bool = False) -> DataFrame:
        """(key, value, identity): the least or largest value of each group, and the least identity that has it; null counts as lowest.

        One aggregate: an identity's own extreme can't beat the group's, so entries need not be reduced by identity first.
        """
        rows = self._with(index, "value")
        v = F.struct(F.col("value").isNotNull().alias("p"), F.col("value").alias("value"))
        whole = rows.schema["identity"].dataType.typeName() in ("byte", "short", "integer", "long")
        if not largest:
            best = rows.groupBy("key").agg(F.min(F.struct(v.alias("v"), "identity")).alias("b"))
            return best.select("key", F.col("b.v.value").alias("value"), F.col("b.identity").alias("identity"))
        if whole:  # the complement turns the order of identities around
            best = rows.groupBy("key").agg(F.max(F.struct(v.alias("v"), F.bitwise_not("identity").alias("i"))).alias("b"))
            return best.select("key", F.col("b.v.value").alias("value"), F.bitwise_not("b.i").alias("identity"))
        of = rows.groupBy("key", "value").agg(F.min("identity").alias("identity"))
        best = of.groupBy("key").agg(F.max_by(F.struct("value", "identity"), v).alias("b"))
        return best.select("key", "b.value", "b.identity")

    def representatives(self, first: bool = True) -> DataFrame:
        """(key, identity): the first or last identity of each group; with combiners, not a sort of the group."""
        return self._kept().groupBy("key").agg((F.min if first else F.max)("identity").alias("identity"))

    def metadata(self) -> DataFrame:
        return self._kept().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("identity").alias("first"), F.max("identity").alias("last"))

    def sums(self, index: str) -> DataFrame:
        return self._with(index, "v").groupBy("key").agg(F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"))

    def items(self) -> DataFrame:
        """(key, identities) with the identities in order: meant for groups that fit a row."""
        return self._kept().groupBy("key").agg(F.sort_array(F.collect_list("identity")).alias("identities"))

    def numbered(self) -> DataFrame:
        """(key, identity, group, item, is_first): ordinals of groups and within them, from 0."""
        number = ordinals(self._kept().select("key").distinct(), "key", "group")
        rows = self._kept().withColumn("item", F.row_number().over(Window.partitionBy("key").orderBy("identity")) - 1)
        return rows.join(number.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k"))).select("key", "identity", "group", "item", (F.col("item") == 0).alias("is_first"))

    def fold_column(self, seed: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
        """(key, value): a fold over each group's identities in ascending order, as Column functions; for groups that fit a row."""
        return self._kept().groupBy("key").agg(F.aggregate(F.sort_array(F.collect_list("identity")), seed, step).alias("value"))

    def fold_with(self, seed: Any, step: Callable[[Any, Any], Any], kind: str) -> DataFrame:
        """(key, value): a caller's Python fold over each group's identities in ascending order; the group is streamed, not gathered.

        Keys come back as they went in: nulls and NaNs make one group each, and long numbers keep all digits.
        """
        rows = self._kept().repartition("key").sortWithinPartitions("key", "identity").select("key", "identity")
        out = T.StructType([rows.schema["key"], T.StructField("value", T.DataType.fromDDL(kind))])

        def run(batches):
            import pyarrow as pa

            from pyspark.sql.pandas.types import to_arrow_type

            held, value, key_type = [], seed, None  # held: the open group's key, as an array of one
            made = to_arrow_type(out["value"].dataType)
            packed = lambda ks, vs: pa.RecordBatch.from_arrays([pa.concat_arrays(ks), pa.array(vs, made)], names=["key", "value"])
            for b in batches:
                key, ks, vs = b.column("key"), [], []
                key_type = key.type
                for k, (x, i) in enumerate(zip(key.to_pylist(), b.column("identity").to_pylist())):
                    if held and not _same(held[0], x):
                        ks.append(held[1])
                        vs.append(value)
                        held, value = [], seed
                    if not held:
                        held = [x, key.slice(k, 1)]
                    value = step(value, i)
                if ks:
                    yield packed(ks, vs)
            if held:
                yield packed([held[1]], [value])

        return rows.mapInArrow(run, out)


def _same(a: Any, b: Any) -> bool:
    return a is b or a == b or (a != a and b != b)
