"""From conditions to DataFrames of identities.

Set plan, always right: a leaf is a filtered entry table, And a semi join, Or a union, Except and Not anti joins. Wide plan: where every
index of a condition is a column of one base table with one row an identity, the whole condition is one filter, which Catalyst
pushes into the scan; there is no join and no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import COMPLEMENTS, KINDS, ORDERED, folded, in_set
from ..sources.catalog import IndexSet
from . import conditions as C


class Compiler:
    def __init__(self, indexes: IndexSet):
        self.set = indexes
        self._values: dict[int, object] = {}

    def _operand(self, v: object) -> object:
        """Parameters and functions are looked up once per execution."""
        if isinstance(v, C.Parameter):
            return self._values.setdefault(id(v), v.value)
        if callable(v) and not isinstance(v, Column):
            return self._values.setdefault(id(v), v())
        return v

    def _predicate(self, leaf: C.Leaf, kind: str, key: Column, key_type) -> Column:
        args, options = [*map(self._operand, leaf.args)], dict(leaf.options)
        if kind in ORDERED and "policy" in options:  # text compared by a policy's sort keys
            by = folded(options.pop("policy"))
            key, args = by(key), [a if a is None else by(a if isinstance(a, Column) else F.lit(a)) for a in args]
        return KINDS[kind](key, key_type, *args, **options)

    # Set plan

    def universe(self, names: list[str]) -> DataFrame:
        """All identities a complement is taken of: of the one index, or of all indexes of the set."""
        if not names:
            raise ValueError("a condition without an index has no universe")
        use = names if len(names) == 1 else list(self.set.names())
        if self.set.base is not None and all(self.set[n].wide for n in use):
            return self.set.base.select(F.col(self.set.identity).alias("identity")).distinct()
        return reduce(DataFrame.unionByName, [self.set[n].entries().select("identity") for n in use]).distinct()

    def _empty(self) -> DataFrame:
        return self.universe(list(self.set.names())).limit(0)

    def entries_of(self, leaf: C.Leaf, kind: str | None = None) -> DataFrame:
        index = self.set[leaf.index]
        e = index.entries()
        name = leaf.part or "key"
        return e.where(self._predicate(leaf, kind or leaf.kind, F.col(name), e.schema[name].dataType))

    # One-index plan

    def only_index(self, c: C.Condition) -> str | None:
        """The index of a condition made of whole-key leaves over that one only."""
        names = {n for n in self._leaf_indexes(c)}
        return next(iter(names)) if len(names) == 1 and None not in names and next(iter(names)) in self.set else None

    def _leaf_indexes(self, c: C.Condition):
        if isinstance(c, C.Leaf):
            yield c.index if c.part is None and not any(isinstance(a, C.PreparedSet) for a in c.args) else None
        elif isinstance(c, C.KeysExistAll):
            yield c.index if 0 < len(c.keys) < 64 else None
        elif isinstance(c, (C.Both, C.Either, C.Except, C.Not)):
            for child in c.children():
                yield from self._leaf_indexes(child)
        else:
            yield None

    def _of_identity(self, c: C.Condition, key_type, single: bool) -> Column:
        """A one-index condition as an aggregate over an identity's entries; as a plain test of its only one, if ``single``."""
        key = F.col("key")
        if isinstance(c, C.Leaf):
            test = self._predicate(c, COMPLEMENTS.get(c.kind, c.kind), key, key_type)
            some = test if single else F.bool_or(test)
            return ~some if c.kind in COMPLEMENTS else some
        if isinstance(c, C.KeysExistAll):
            if single:
                return in_set(key, key_type, c.keys) if len(c.keys) == 1 else F.lit(False)
            bits = [F.when(in_set(key, key_type, [k]), F.lit(1 << i).cast("long")) for i, k in enumerate(c.keys)]
            return F.coalesce(F.bit_or(F.coalesce(*bits)) == (1 << len(c.keys)) - 1, F.lit(False))
        if isinstance(c, C.Not):
            return ~self._of_identity(c.inner, key_type, single)
        a, b = self._of_identity(c.left, key_type, single), self._of_identity(c.right, key_type, single)
        return a & b if isinstance(c, C.Both) else a | b if isinstance(c, C.Either) else a & ~b

    def _by_identity(self, c: C.Condition, name: str) -> DataFrame:
        """One pass over the index: an identity's entries are reduced to a boolean for each leaf, before the shuffle."""
        e, single = self.set[name].entries(), self.set[name].single_key
        hit = self._of_identity(c, e.schema["key"].dataType, single)
        return (e.where(hit) if single else e.groupBy("identity").agg(hit.alias("hit")).where("hit")).select("identity")

    def ids(self, c: C.Condition, preserve: bool = False) -> DataFrame:
        """One column, identity; ``preserve`` keeps what leaves and unions repeat."""
        once = (lambda d: d) if preserve else (lambda d: d.distinct())
        several = not isinstance(c, C.Leaf) or c.kind in COMPLEMENTS
        if several and not preserve and (name := self.only_index(c)):
            return self._by_identity(c, name)
        if isinstance(c, C.Leaf):
            if c.index not in self.set:
                if c.guarded:
                    return self._empty()
                raise KeyError(f"no index named {c.index}")
            prepared = next((a for a in c.args if isinstance(a, C.PreparedSet)), None)
            if prepared is not None and c.kind in ("InSet", "NotInSet"):
                e, keys = self.set[c.index].entries(), prepared.keys
                found = e.join(keys, e[c.part or "key"].eqNullSafe(keys[prepared.column]), "left_semi").select("identity")
                return once(found) if c.kind == "InSet" else self.universe([c.index]).join(found, "identity", "left_anti")
            if c.kind in COMPLEMENTS:
                return self.universe([c.index]).join(self.entries_of(c, COMPLEMENTS[c.kind]).select("identity"), "identity", "left_anti")
            found = self.entries_of(c).select("identity")
            return found if self.set[c.index].single_key else once(found)
        if isinstance(c, C.KeysExistAll):
            e = self.set[c.index].entries()
            if self.set[c.index].single_key and len(c.keys) > 1:
                return self._empty()
            hit = e.where(in_set(F.col("key"), e.schema["key"].dataType, c.keys)).withColumn("k", F.struct("key"))
            return hit.groupBy("identity").agg(F.countDistinct("k").alias("n")).where(F.col("n") == len(c.keys)).select("identity")
        if isinstance(c, C.External):
            return once(c.ids.select(F.col(c.ids.columns[0]).alias("identity")))
        if isinstance(c, C.ExternalKeys):
            e = c.entries.select(F.col(c.entries.columns[0]).alias("identity"), F.col(c.entries.columns[1]).alias("key"))
            leaf = C.Leaf("", c.kind, c.args, c.options)
            hit = self._predicate(leaf, COMPLEMENTS.get(c.kind, c.kind), F.col("key"), e.schema["key"].dataType)
            found = e.where(hit).select("identity")
            return once(found) if c.kind not in COMPLEMENTS else e.select("identity").distinct().join(found, "identity", "left_anti")
        if isinstance(c, C.ByIdentity):
            u = self.universe(list(self.set.names()))
            return u.where(KINDS[c.kind](F.col("identity"), u.schema["identity"].dataType, *c.args))
        if isinstance(c, C.CompareKeys):
            a, b = self.set[c.left].entries().select("identity", F.col("key").alias("a")), self.set[c.right].entries().select("identity", F.col("key").alias("b"))
            test = F.col("a") == F.col("b")
            return once(a.join(b, "identity").where(F.coalesce(test if c.op == "=" else ~test, F.lit(False))).select("identity"))
        if isinstance(c, C.Composite):
            e = self.set[c.index].entries()
            return once(e.where(F.coalesce(c.test({p: F.col(p) for p in self.set[c.index].parts}), F.lit(False))).select("identity"))
        if isinstance(c, C.Both):
            # A test of identities needs candidates: those of the other side.
            for test, other in ((c.right, c.left), (c.left, c.right)):
                if isinstance(test, C.ExternalTest):
                    return self.ids(other, preserve).where(F.coalesce(test.test(F.col("identity")), F.lit(False)))
                if isinstance(test, C.CorrelatedKeys):
                    near = self.ids(other, preserve).withColumn("keys", test.keys(F.col("identity"))).withColumn("key", F.explode("keys"))
                    hit = self._predicate(C.Leaf("", test.kind, test.args, test.options), test.kind, F.col("key"), near.schema["key"].dataType)
                    return near.where(hit).select("identity").distinct()
                if isinstance(test, C.OrdinalTest):
                    ranked = ordinals(self.ids(other).distinct(), "identity", "ordinal")
                    return ranked.where(F.coalesce(test.test(F.col("identity"), F.col("ordinal"), F.col("ordinal") == 0), F.lit(False))).select("identity")
            return self.ids(c.left, preserve).join(self.ids(c.right, True), "identity", "left_semi")
        if isinstance(c, C.Either):
            return once(self.ids(c.left, True).unionByName(self.ids(c.right, True)))
        if isinstance(c, C.Except):
            return self.ids(c.left, preserve).join(self.ids(c.right, True), "identity", "left_anti")
        if isinstance(c, C.Not):
            return self.universe(c.indexes()).join(self.ids(c.inner, True), "identity", "left_anti")
        raise ValueError(f"{type(c).__name__} needs a sibling with an index")

    # Wide plan

    def can_be_wide(self, c: C.Condition) -> bool:
        if isinstance(c, C.Leaf):
            return c.index in self.set and self.set[c.index].wide and c.part is None and not any(isinstance(a, C.PreparedSet) for a in c.args)
        if isinstance(c, (C.External, C.ExternalKeys, C.CorrelatedKeys, C.OrdinalTest, C.Composite, C.KeysExistAll)):
            return False
        if isinstance(c, C.CompareKeys):
            return self.set[c.left].wide and self.set[c.right].wide
        return self.set.base is not None and all(map(self.can_be_wide, c.children()))

    def test(self, c: C.Condition) -> Column:
        """The condition as one predicate over the base table's rows."""
        if isinstance(c, C.Leaf):
            name = self.set[c.index].column
            negate = c.kind in COMPLEMENTS
            p = self._predicate(c, COMPLEMENTS.get(c.kind, c.kind), F.col(name), self.set.base.schema[name].dataType)
            return ~p if negate else p
        if isinstance(c, C.CompareKeys):
            a, b = F.col(self.set[c.left].column), F.col(self.set[c.right].column)
            return F.coalesce(a == b if c.op == "=" else a != b, F.lit(False))
        if isinstance(c, C.ByIdentity):
            return KINDS[c.kind](F.col(self.set.identity), self.set.base.schema[self.set.identity].dataType, *c.args)
        if isinstance(c, C.ExternalTest):
            return F.coalesce(c.test(F.col(self.set.identity)), F.lit(False))
        if isinstance(c, C.Both):
            return self.test(c.left) & self.test(c.right)
        if isinstance(c, C.Either):
            return self.test(c.left) | self.test(c.right)
        if isinstance(c, C.Except):
            return self.test(c.left) & ~self.test(c.right)
        return ~self.test(c.inner)

    def identities(self, c: C.Condition, preserve: bool = False, plan: str = "auto") -> DataFrame:
        if plan == "wide" or plan == "auto" and self.can_be_wide(c):
            return self.set.base.where(self.test(c)).select(F.col(self.set.identity).alias("identity"))
        return self.ids(c, preserve)


#: Keys that part all keys into ranges when rows are numbered.
BOUNDS = 200


def ordinals(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows`` (distinct in ``by``) with their number from 0 in the order of ``by``, nulls first; no task orders all of them.

    Ranges are parted by keys of a sample (at most BOUNDS), so a key's range depends on its value alone; rows are numbered in their
    range, and the ranges' counts, a row each, say where each begins.
    """
    n = rows.count()
    seen = rows.where(F.col(by).isNotNull()).select(by).sample(min(1.0, BOUNDS / max(n, 1)), seed=1).limit(2 * BOUNDS).collect()
    bounds = sorted({r[0] for r in seen})[:: max(1, len(seen) // BOUNDS)]
    kind = rows.schema[by].dataType
    marks = F.array(*[F.lit(b).cast(kind) for b in bounds]) if bounds else F.array().cast(f"array<{kind.simpleString()}>")
    ranged = rows.withColumn("__range", F.when(F.col(by).isNull(), -1).otherwise(F.size(F.filter(marks, lambda b: b <= F.col(by)))))
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select("__range", before.alias("__before"))  # one row a range
    number = F.row_number().over(Window.partitionBy("__range").orderBy(by)) - 1
    return ranged.withColumn(name, number).join(F.broadcast(begins), "__range").withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__range", "__before")


def classify(indexes: IndexSet, c: C.Condition) -> list[tuple[str, str, str]]:
    """(index, operator, how it is answered) of each leaf."""
    if isinstance(c, C.Leaf):
        if c.index not in indexes:
            return [(c.index, c.kind, "guarded: empty" if c.guarded else "no such index")]
        how = "composite" if c.part else "complement" if c.kind in COMPLEMENTS else "column" if indexes[c.index].wide else "entries"
        return [(c.index, c.kind, how)]
    return [x for child in c.children() for x in classify(indexes, child)] or [("", type(c).__name__, "entries" if c.indexes() else "outside")]
