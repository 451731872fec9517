"""Exact lookups, existence, duplicates and singletons of one index, and inverse maps."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..plans.compiler import Compiler
from ..plans.conditions import Condition
from ..sources.catalog import Index, IndexSet


def get_by_keys(index: Index, keys: DataFrame) -> DataFrame:
    """(key, identity) of each distinct requested key that has entries; ``keys``: one column."""
    wanted = keys.select(F.col(keys.columns[0]).alias("k")).distinct()
    return index.entries().join(wanted, F.col("key").eqNullSafe(F.col("k")), "left_semi").select("key", "identity")


def count_by_keys(index: Index, keys: DataFrame) -> DataFrame:
    """(key, n) of every distinct requested key, 0 where there is none."""
    wanted = keys.select(F.col(keys.columns[0]).alias("k")).distinct()
    counts = index.entries().groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    return wanted.join(counts, F.col("key").eqNullSafe(F.col("k")), "left").select(F.col("k").alias("key"), F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def check(index: Index, probes: DataFrame, on: tuple[str, ...] = ("key",)) -> DataFrame:
    """``probes`` (columns ``on``: key, identity or both) with a flag, found."""
    have = index.entries().select(*[F.col(c).alias(f"__{c}") for c in on]).distinct().withColumn("__hit", F.lit(True))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on])
    return probes.join(have, same, "left").select(*probes.columns, F.coalesce("__hit", F.lit(False)).alias("found"))


def exists_any(index: Index, probes: DataFrame, on: tuple[str, ...] = ("key",)) -> bool:
    return not check(index, probes, on).where("found").isEmpty()


def exists_all(index: Index, probes: DataFrame, on: tuple[str, ...] = ("key",)) -> bool:
    return check(index, probes, on).where("not found").isEmpty()


def exists_other_identity(index: Index, key: object, identity: object) -> bool:
    return not index.entries().where(F.col("key").eqNullSafe(F.lit(key)) & (F.col("identity") != F.lit(identity))).isEmpty()


def repeated(index: Index, by: str = "key", single: bool = False, projection: Column | None = None) -> DataFrame:
    """(by, n): keys of two or more distinct identities (by="key"), or identities of two or more distinct keys; ``single``: of exactly one.

    ``projection`` groups by an expression over the key instead."""
    e = index.entries()
    if projection is not None:
        e = e.withColumn("key", projection)
    other = "identity" if by == "key" else "key"
    pairs = e.select(by, F.struct(other).alias("o")).distinct()  # a struct, so that a null key counts
    n = pairs.groupBy(by).agg(F.count("o").alias("n"))
    return n.where("n = 1" if single else "n >= 2")


def entries_of_repeated(index: Index, by: str = "key", single: bool = False) -> DataFrame:
    r = repeated(index, by, single).select(F.col(by).alias("r"))
    return index.entries().join(r, F.col(by).eqNullSafe(F.col("r")), "left_semi")


def distinct_keys(index: Index) -> DataFrame:
    return index.entries().select("key").distinct()


def inverse(indexes: IndexSet, names: list[str], condition: Condition | None = None) -> DataFrame:
    """(identity, one sorted array of distinct keys for each index), of all identities or those that match.

    Indexes over one table are read in one pass and one aggregation, after the others' identities are gone.
    """
    ids = None if condition is None else Compiler(indexes).identities(condition)
    source = indexes[names[0]].source
    together = source is not None and all(indexes[n].source is source for n in names)
    if together:
        rows = source.select(F.col(indexes[names[0]].identity).alias("identity"), *[F.col(indexes[n].column).alias(n) for n in names])
        rows = rows if ids is None else rows.join(ids, "identity", "left_semi")
        keys = rows.groupBy("identity").agg(*[F.sort_array(F.collect_set(n)).alias(n) for n in names])
        asked = list(indexes.names()) if condition is None else condition.indexes()
        if asked and all(i in indexes and indexes[i].source is source for i in asked):
            return keys  # every identity has a row in the table
        return (Compiler(indexes).universe(list(indexes.names())) if ids is None else ids).join(keys, "identity", "left")
    out = Compiler(indexes).universe(list(indexes.names())) if ids is None else ids
    for n in names:
        e = indexes[n].entries() if ids is None else indexes[n].entries().join(ids, "identity", "left_semi")
        out = out.join(e.groupBy("identity").agg(F.sort_array(F.collect_set("key")).alias(n)), "identity", "left")
    return out


class Inverse:
    """An inverse map kept as a table: made when first read (or by ``rebuild``), read until it is dropped."""

    def __init__(self, indexes: IndexSet, names: list[str], path: str):
        self.indexes, self.names, self.path = indexes, list(names), path
        self._made = False

    def include(self, name: str) -> None:
        """One index more; the table is made anew when next read."""
        if name not in self.names:
            self.names.append(name)
            self._made = False

    def rebuild(self) -> None:
        inverse(self.indexes, self.names).write.mode("overwrite").parquet(self.path)
        self._made = True

    def read(self) -> DataFrame:
        if not self._made:
            self.rebuild()
        any_index = self.indexes[self.names[0]].entries()
        return any_index.sparkSession.read.parquet(self.path)

    def keys_of(self, identity: object) -> DataFrame:
        return self.read().where(F.col("identity") == F.lit(identity))

    def validate(self) -> bool:
        """Whether the table still says what the indexes say."""
        now, kept = inverse(self.indexes, self.names), self.read()
        return now.exceptAll(kept).isEmpty() and kept.exceptAll(now).isEmpty()

    def drop(self) -> None:
        if self._made:
            spark = self.read().sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            self._made = False


def visit(index: Index, each: Callable[[Row], None]) -> None:
    """Call a function for every entry, where the entry is."""
    index.entries().foreachPartition(lambda rows: [each(r) for r in rows] and None)


def full_key(index: Index, delimiter: str, parts: list[str] | None = None, without: list[str] | None = None) -> Column:
    """Text of a composite key's parts, in order."""
    use = [p for p in (parts or index.parts) if p not in (without or [])]
    return F.concat_ws(delimiter, *[F.col(p).cast("string") for p in use])
