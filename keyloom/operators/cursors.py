"""Cursors over ordered results: rows are pulled one by one, and changes to them are gathered and applied together."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..sources.catalog import Index
from .results import Bookmark, Query


class Cursor:
    """Matching entries of an index in key order. ``delete_current`` and ``set_key`` note changes; ``changed`` is the index with them.

    Rows come a partition at a time; what is noted is what a caller touched by hand.
    """

    def __init__(self, query: Query, index: str, descending: bool = False):
        self.query, self.index, self.ordinal, self.current = query, query.set[index], -1, None
        self._descending = descending
        down = (lambda c: c.desc()) if descending else (lambda c: c.asc())
        self._rows = query.tuples(index).orderBy(down(F.col("key")), down(F.col("identity"))).toLocalIterator()
        self._deleted: list[Row] = []
        self._set: list[tuple[Row, Any]] = []
        self._rest = False

    def next(self) -> Row | None:
        self.current = next(self._rows, None)
        self.ordinal += self.current is not None
        return self.current

    def skip(self, n: int) -> int:
        """Rows passed, fewer than n at the end."""
        passed = 0
        while passed < n and self.next() is not None:
            passed += 1
        return passed

    def pull(self, n: int) -> list[Row]:
        out = []
        while len(out) < n and self.next() is not None:
            out.append(self.current)
        return out

    @property
    def bookmark(self) -> Bookmark | None:
        return None if self.current is None else Bookmark(self.current.key, self.current.identity, self._descending, self.index.version)

    def _here(self) -> Row:
        if self.current is None:
            raise LookupError("the cursor is not on a row")
        return self.current

    def delete_current(self) -> None:
        self._deleted.append(self._here())

    def set_key(self, key: Any) -> None:
        self._set.append((self._here(), key))

    def delete_remaining(self) -> None:
        """All rows after the current one go, too; they are not read."""
        self._rest = True

    def changed(self) -> DataFrame:
        """The index's entries with the changes noted."""
        e = self.index.entries()
        kind, spark = e.schema, e.sparkSession
        if self._rest:
            after, key, identity = self.current, F.col("key"), F.col("identity")
            rest = self.query.tuples(self.index.name)
            if after is not None:
                k, i = F.lit(after.key), F.lit(after.identity)
                beyond = identity < i if self._descending else identity > i
                further = (key < k) | key.isNull() if self._descending else key > k
                if after.key is None:
                    further = F.lit(False) if self._descending else key.isNotNull()
                rest = rest.where(F.coalesce(further, F.lit(False)) | (key.eqNullSafe(k) & beyond))
            e = _without(e, rest)
        gone = self._deleted + [r for r, _ in self._set]
        if gone:
            e = _without(e, spark.createDataFrame([(r.identity, r.key) for r in gone], e.select("identity", "key").schema))
        if self._set:
            e = e.unionByName(spark.createDataFrame([(r.identity, k) for r, k in self._set], e.select("identity", "key").schema)).distinct()
        return e.select(*kind.names)


def _without(entries: DataFrame, rows: DataFrame) -> DataFrame:
    gone = rows.select(F.col("identity").alias("__i"), F.col("key").alias("__k"))
    return entries.join(gone, F.col("identity").eqNullSafe(F.col("__i")) & F.col("key").eqNullSafe(F.col("__k")), "left_anti")
