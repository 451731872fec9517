"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., 2014).

Every star is an aggregation over the edges and is written to the shared folder; hubs are never gathered: only
minima by node are, which combine before the shuffle. A small star over an unwritten large one would hold its plan six times, and the
driver a thread for each of their shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each larger neighbour of u is linked to the least node near u; small star: each smaller one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    near = (both.where("b > a") if large else both.where("b < a")).join(least, "a")
    links = near.select(F.col("m").alias("a"), "b")
    if not large:  # u itself, too
        links = links.unionByName(least.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b")))
    return links.where("a < b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (a long, b long); label is the least node of the component."""
    e = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        e = materialize(_star(materialize(_star(e, True), "stars"), False), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.groupBy("b").agg(F.min("a").alias("label")).select(F.col("b").alias("node"), "label").unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def bucket_links(bands: DataFrame, prepare: Callable[[DataFrame], Any], check: Callable[[DataFrame, Any], DataFrame], across: Callable[[DataFrame, Any], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between members c of the buckets k of ``bands`` that ``check`` lets pass, without all pairs of a bucket.

    ``bands`` is read twice: written, or cheap to make. First each member against the least of its bucket. Members of buckets that are
    not in one component after that are compared with the next least; in buckets that are still not in one component, members of
    different components are compared with each other. ``prepare`` gets the members that met another one and makes what ``check``
    needs. ``across`` makes the last pairs (a, b) from (k, c, label) of the members left, at least those of different labels that
    share a bucket and could be linked. Returns the links and the components (node, label) they make.
    """
    # Written first, so that its size is known: a small one is broadcast and the bands stay where they are.
    heads = materialize(bands.groupBy("k").agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "heads")
    met = materialize(bands.join(heads, "k"), "buckets")
    star = materialize(met.where("c <> least").select(F.col("least").alias("a"), F.col("c").alias("b")).distinct(), "star")
    state = prepare(met.select("c").distinct())
    found = materialize(check(star, state), "links")
    label = components(found)
    # The least has met all others: what is left is between the others.
    mixed = _mixed(met.where("c <> least").select("k", "c"), label)
    heads = mixed.groupBy("k").agg(F.min(F.struct("c", "label")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(mixed.join(heads, "k").select("k", "c", "label", "least"), "buckets")
    # Members that a link joins already need no other.
    next_star = met.where("label <> least.label").select(F.col("least.c").alias("a"), F.col("c").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    next_star = materialize(next_star, "star")
    found, label = _joined(found, label, check(next_star, state))
    mixed = _mixed(met.where("c <> least.c").select("k", "c"), label)
    cross = across(mixed, state)
    cross = materialize(cross.join(star.unionByName(next_star), ["a", "b"], "left_anti"), "cross")
    return _joined(found, label, check(cross, state))


def in_buckets(mixed: DataFrame, fits: Column) -> DataFrame:
    """Pairs (a, b) of different labels that share a bucket, if ``fits`` (over size and size2) says so; made in their first bucket only."""
    keys = mixed.groupBy("c").agg(F.collect_list("k").alias("ks"))  # a member has few keys
    mixed = materialize(mixed.join(keys, "c"), "mixed")
    other = mixed.select("k", F.col("c").alias("b"), F.col("label").alias("to"), F.col("size").alias("size2"), F.col("ks").alias("others"))
    first = F.array_min(F.array_intersect("ks", "others")) == F.col("k")
    return mixed.withColumnRenamed("c", "a").join(other, "k").where("label < to").where(fits).where(first).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _joined(found: DataFrame, label: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and components with ``more`` links; without any, as they were."""
    more = materialize(more, "links")
    if more.isEmpty():
        return found, label
    found = found.unionByName(more)
    return found, components(found)


def _mixed(met: DataFrame, label: DataFrame) -> DataFrame:
    """(k, c, label) of the buckets whose members are in several components."""
    named = met.join(label.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    several = named.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("k")
    return materialize(named.join(several, "k").select("k", "c", "label"), "mixed")
