"""Writes: each makes a new entry table; ``Catalog.publish`` makes one or several visible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import Compiler
from ..plans.conditions import Condition
from ..sources.catalog import Catalog, ContractError, Index, IndexSet


def _parts(index: Index) -> list[str]:
    return list(index.parts or ("key",))


def inserted(index: Index, rows: DataFrame) -> DataFrame:
    """Entries with the new ones; an entry that exists already stays one. Contracts are checked on what is new against all."""
    cols = ["identity", *_parts(index)]
    out = index.entries().select(*cols).unionByName(rows.select(*cols)).distinct()
    for what, on, wanted in (("key", _parts(index), index.unique), ("identity", ["identity"], index.single_key)):
        touched = rows.select(*[F.col(c).alias(f"__{c}") for c in on]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on])
        if wanted and not out.join(touched, same, "left_semi").groupBy(*on).count().where("count > 1").isEmpty():
            raise ContractError(f"several entries for one {what}")
    return out


def deleted(index: Index, rows: DataFrame) -> DataFrame:
    """Entries without those in ``rows``."""
    cols = ["identity", *_parts(index)]
    gone = rows.select(*[F.col(c).alias(f"__{c}") for c in cols])
    same = None
    for c in cols:
        t = F.col(c).eqNullSafe(F.col(f"__{c}"))
        same = t if same is None else same & t
    return index.entries().join(gone, same, "left_anti")


def deleted_where(index: Index, indexes: IndexSet, condition: Condition) -> DataFrame:
    """Entries of the target index whose identity doesn't match."""
    return index.entries().join(Compiler(indexes).identities(condition), "identity", "left_anti")


def rekeyed_where(index: Index, indexes: IndexSet, condition: Condition, change: Column) -> DataFrame:
    """Entries of matching identities get ``change`` (over ``key``) as their key; ones that come to be equal are one."""
    ids = Compiler(indexes).identities(condition).withColumn("__hit", F.lit(True))
    e = index.entries()
    new = F.when(F.col("__hit"), change.cast(e.schema["key"].dataType)).otherwise(F.col("key"))
    return e.join(ids, "identity", "left").select("identity", new.alias("key")).distinct()


#: Stands for any old key of an identity.
ANY = object()


def rekeyed(index: Index, identity: object, new: object, old: object = ANY) -> DataFrame:
    """Entries with a new key (null, too) for an identity: for its old key, if one is given, which may be null."""
    hit = F.col("identity") == F.lit(identity)
    hit = hit & F.col("key").eqNullSafe(F.lit(old)) if old is not ANY else hit
    e = index.entries()
    return e.withColumn("key", F.when(hit, F.lit(new).cast(e.schema["key"].dataType)).otherwise(F.col("key"))).distinct()


def apply(catalog: Catalog, target: str, indexes: IndexSet, condition: Condition, change: Column | None = None) -> tuple[int, int]:
    """Delete (no change given) or re-key in a catalog; (identities matched, entries changed)."""
    index = catalog.open(target)
    matched = Compiler(indexes).identities(condition)
    touched = index.entries().join(matched, "identity", "left_semi")
    n, changed = matched.count(), (touched if change is None else touched.where(~F.col("key").eqNullSafe(change))).count()
    new = deleted_where(index, indexes, condition) if change is None else rekeyed_where(index, indexes, condition, change)
    catalog.publish({target: new})
    return n, changed
