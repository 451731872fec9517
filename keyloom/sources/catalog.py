"""Catalogs of index sets. An index is an ordered multimap from keys to identities, kept as an entry table.

A catalog is a folder of Parquet snapshots or, without a path, in memory only. A write makes a new snapshot folder and then swaps the
one small metadata file that names it, so readers see all of a batch or nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A write broke a uniqueness or single-key contract, or an index was opened as something it isn't."""


class ConflictError(RuntimeError):
    """Another writer published what this one built on."""


@dataclass
class Index:
    name: str
    frame: DataFrame | None = None
    unique: bool = False
    single_key: bool = False
    descending: bool = False
    column: str | None = None
    parts: tuple[str, ...] = ()
    base: DataFrame | None = field(default=None, repr=False)
    identity: str = "identity"
    #: A table with ``column`` and ``identity``, of which the entries are two columns; several indexes may share it.
    source: DataFrame | None = field(default=None, repr=False)
    version: int | None = None

    @property
    def wide(self) -> bool:
        return self.base is not None and self.column is not None

    def entries(self) -> DataFrame:
        """(identity, key), or (identity, parts...) of a composite index."""
        if self.frame is not None:
            return self.frame
        return self.base.select(F.col(self.identity).alias("identity"), F.col(self.column).alias("key"))

    def ordered(self, descending: bool | None = None) -> DataFrame:
        """Entries in key order; null keys first, then NaN, then the others (all reversed if descending)."""
        e, down = self.entries(), self.descending if descending is None else descending
        keys = self.parts or ("key",)
        floats = {f.name for f in e.schema if f.dataType.typeName() in ("float", "double")}
        order = [c for k in keys for c in ([F.col(k).isNotNull(), ~F.isnan(k)] if k in floats else []) + [F.col(k)]]
        return e.orderBy(*[c.desc() if down else c.asc() for c in order], F.col("identity").desc() if down else F.col("identity").asc())


class IndexSet:
    """Indexes that share one identity type."""

    def __init__(self, base: DataFrame | None = None, identity: str = "identity"):
        self.base, self.identity, self._all = base, identity, {}

    @classmethod
    def from_table(cls, df: DataFrame, identity: str, keys: list[str] | None = None, unique: bool | None = None) -> IndexSet:
        """Every column is a single-key index over the identity column, of which each row has its own.

        ``unique``: the caller knows that identities don't repeat (a declared key). If not told (None) that is looked up once, here;
        where identities do repeat, columns are multi-key indexes, as in ``from_rows``.
        """
        names = list(keys or df.columns)
        if unique is None and not df.isStreaming:
            unique = df.groupBy(identity).count().where("count > 1").isEmpty()
        if unique is False:
            return cls.from_rows(df, identity, names)
        s = cls(df, identity)
        for k in names:
            s._all[k] = Index(k, single_key=True, column=k, base=df, identity=identity, source=df)
        return s

    @classmethod
    def from_rows(cls, df: DataFrame, identity: str, keys: list[str]) -> IndexSet:
        """Identities may repeat: each column is a multi-key index."""
        s = cls()
        for k in keys:
            s.add(k, df.select(F.col(identity).alias("identity"), F.col(k).alias("key")))
            s._all[k].source, s._all[k].column, s._all[k].identity = df, k, identity
        return s

    def add_path(self, name: str, df: DataFrame, identity: str, path: str, text: str | None = None) -> IndexSet:
        """An index over a value path such as ``a.b[0].c`` of nested columns, or, with ``text``, of the JSON in that column.

        A path that a row doesn't have is a null key.
        """
        key = F.col(path) if text is None else F.get_json_object(text, f"$.{path}")
        return self.add(name, df.select(F.col(identity).alias("identity"), key.alias("key")))

    def add(self, name: str, entries: DataFrame, parts: tuple[str, ...] = (), **contract: bool) -> IndexSet:
        types = {i.entries().schema["identity"].dataType for i in self._all.values()} | {entries.schema["identity"].dataType}
        if len(types) > 1:
            raise ContractError(f"identities of {name} are of another type than those of its set")
        self._all[name] = Index(name, entries, parts=tuple(parts), **contract)
        return self

    def __getitem__(self, name: str) -> Index:
        if name not in self._all:
            raise KeyError(f"no index named {name}")
        return self._all[name]

    def __contains__(self, name: str) -> bool:
        return name in self._all

    def names(self) -> Iterator[str]:
        return iter(self._all)

    def drop(self, name: str) -> None:
        del self._all[name]


def check_contract(entries: DataFrame, unique: bool, single_key: bool, parts: tuple[str, ...] | list[str] = ()) -> None:
    """A composite key is unique as a whole."""
    for what, on, wanted in (("key", list(parts or ["key"]), unique), ("identity", ["identity"], single_key)):
        if wanted and not entries.groupBy(*on).count().where("count > 1").isEmpty():
            raise ContractError(f"several entries for one {what}")


class Catalog:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self._memory, self._number = spark, path, {}, 0

    # The metadata file is text in the same store as the data: Spark's file system layer reaches both.
    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _newest(self) -> tuple[int, object]:
        """(number, path) of the newest metadata file; 0 without any."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return 0, None
        found = {f.getPath().getName(): f.getPath() for f in fs.listStatus(path(self.path))}
        numbers = {int(n[8:-5]): p for n, p in found.items() if n.startswith("catalog-") and n.endswith(".json")}
        return max(numbers.items(), key=lambda x: x[0], default=(0, None))

    def _read(self) -> tuple[int, dict]:
        """Number of the state that readers see now, and its metadata."""
        if self.path is None:
            return self._number, self._memory
        number, at = self._newest()
        return number, json.loads("\n".join(r.value for r in self.spark.read.text(at.toString(), wholetext=True).collect())) if at else {}

    def _meta(self) -> dict:
        return self._read()[1]

    def _swap(self, meta: dict, number: int) -> None:
        """Publish ``meta`` as the state after ``number``. The store refuses a second file of one number, so of two writers one fails."""
        if self.path is None:
            if number != self._number:
                raise ConflictError(f"state {number} is not the newest")
            self._memory, self._number = meta, number + 1
            return
        fs, path = self._fs()
        new = path(f"{self.path}/new-{uuid.uuid4().hex}.tmp")
        out = fs.create(new)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri())
        none = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(new), fs.makeQualified(path(f"{self.path}/catalog-{number + 1}.json")), none)
        except Exception as e:
            fs.delete(new, False)
            raise ConflictError(f"state {number} is not the newest") from e

    def names(self) -> list[str]:
        return sorted(self._meta())

    def info(self, name: str) -> dict | None:
        return self._meta().get(name)

    def exists(self, name: str) -> bool:
        return name in self._meta()

    def create(self, name: str, entries: DataFrame, unique: bool = False, single_key: bool = False, parts: tuple[str, ...] = (), sort_key: str | None = None) -> Index:
        """``sort_key``: an expression over the key that snapshots are laid out by (default: the key), kept with the index's shape."""
        if self.exists(name):
            raise ContractError(f"{name} exists")
        return self.publish({name: entries}, {name: {"unique": unique, "single_key": single_key, "parts": list(parts), "sort_key": sort_key}})[name]

    def shape(self, name: str) -> dict:
        """Types and contract of an index, without reading its entries."""
        spec = self._meta()[name]
        types = {f["name"]: f["type"] for f in json.loads(spec["schema"])["fields"]}
        return {"types": types} | {k: spec.get(k) for k in ("unique", "single_key", "parts", "sort_key", "version")}

    def batch(self) -> Batch:
        return Batch(self)

    def publish(self, batch: dict[str, DataFrame], contracts: dict[str, dict] | None = None) -> dict[str, Index]:
        """New contents of several indexes, visible together. Contracts are checked first; nothing is swapped if one is broken."""
        return self._publish(batch, contracts, None)

    def _publish(self, batch: dict[str, DataFrame], contracts: dict[str, dict] | None, built_on: int | None) -> dict[str, Index]:
        number, now = self._read()
        if built_on is not None and built_on != number:
            raise ConflictError(f"state {built_on} is not the newest")
        meta = dict(now)
        for name, df in batch.items():
            spec = dict((contracts or {}).get(name) or meta[name])
            check_contract(df, spec["unique"], spec["single_key"], spec["parts"])
            spec |= {"schema": df.schema.json(), "version": meta.get(name, {}).get("version", 0) + 1}
            if self.path is None:
                spec["frame"] = df
            else:
                spec["snapshot"] = f"{self.path}/{name}/{uuid.uuid4().hex}"
                order = [F.expr(spec["sort_key"])] if spec.get("sort_key") else []
                df.sortWithinPartitions(*order, *(spec["parts"] or ["key"])).write.parquet(spec["snapshot"])
            meta[name] = spec
        self._swap(meta, number)
        return {name: self.open(name) for name in batch}

    def open(self, name: str, key_type: str | None = None) -> Index:
        spec = self._meta().get(name)
        if spec is None:
            raise KeyError(f"no index named {name}")
        df = spec["frame"] if self.path is None else self.spark.read.parquet(spec["snapshot"])
        if key_type and dict(df.dtypes).get("key") != key_type:
            raise ContractError(f"keys of {name} are {dict(df.dtypes).get('key')}, not {key_type}")
        return Index(name, df, spec["unique"], spec["single_key"], parts=tuple(spec["parts"]), version=spec["version"])

    def count(self, name: str) -> int:
        """Entries of an index; a snapshot's are counted by its files' footers alone."""
        return self.open(name).entries().count()

    def index_set(self, *names: str) -> IndexSet:
        s = IndexSet()
        for n in names or self.names():
            s._all[n] = self.open(n)
        return s

    def drop(self, name: str) -> None:
        number, meta = self._read()
        self._swap({k: v for k, v in meta.items() if k != name}, number)

    def compact(self, name: str, files: int | None = None) -> Index:
        """Rewrite an index in key order, in so many files (None: as many as Spark finds fit)."""
        index = self.open(name)
        by = list(index.parts or ("key",))
        e = index.entries()
        return self.publish({name: e.repartitionByRange(*([files] if files else []), *by)})[name]

    def backup(self, path: str) -> Catalog:
        copy = Catalog(self.spark, path)
        copy.publish({n: self.open(n).entries() for n in self.names()}, {n: {k: self.info(n)[k] for k in ("unique", "single_key", "parts")} for n in self.names()})
        return copy

    def validate(self) -> list[str]:
        """Names of indexes whose contents break their contract."""
        bad = []
        for n in self.names():
            i = self.open(n)
            try:
                check_contract(i.entries(), i.unique, i.single_key, i.parts)
            except ContractError:
                bad.append(n)
        return bad


class Batch:
    """Changes to several indexes that become visible together, or not at all.

        with catalog.batch() as b:
            b.put("name", changes.inserted(b.open("name"), rows))
    """

    def __init__(self, catalog: Catalog):
        self.catalog, self._new, self._done = catalog, {}, False
        self._number, _ = catalog._read()

    def open(self, name: str) -> Index:
        """The index as this batch sees it: with its own changes."""
        index = self.catalog.open(name)
        if name in self._new:
            index.frame = self._new[name]
        return index

    def put(self, name: str, entries: DataFrame) -> None:
        if self._done:
            raise ContractError("the batch is over")
        self._new[name] = entries

    def commit(self) -> dict[str, Index]:
        """Raises ConflictError, and changes nothing, if another writer published since the batch began."""
        if self._done:
            raise ContractError("the batch is over")
        self._done = True
        return self.catalog._publish(self._new, None, self._number) if self._new else {}

    def abort(self) -> None:
        self._done, self._new = True, {}

    def __enter__(self) -> Batch:
        return self

    def __exit__(self, kind, *_) -> None:
        if not self._done:
            self.abort() if kind else self.commit()
