"""Near-duplicate documents by DartMinHash signatures (Christiani, 2020) and banded joining.

A document is the multiset of its runs of five words (lower case, split at white space; fewer words make one run). Weighted
elements are regions of unit cells; hashed darts fall on (cell, rank) as a Poisson process that only the hash decides, so all
documents see the same darts. A document keeps, of the darts in its cells below a rank chosen so that about DARTS are met,
the earliest in each of K coordinates: the work is its length plus DARTS, not length times K.

Equal texts are one from the start. Signatures are cut into BANDS bands; texts that share a band meet in a bucket. Each is
compared with the bucket's least member; the links found make components. Texts in buckets that are not of one component then are
compared with the next least. Texts in buckets that are still not of one
component are compared with those of other components that they share a prefix element with (Xiao et al., 2008): elements sorted
from rare to common, two texts that are similar enough must share one among the first few of each, and have enough left after it.
That loses no pair, and texts that drifted apart in a large group share common elements only, which their prefixes don't reach.
Every candidate is checked by exact weighted Jaccard similarity. A pair at similarity 0.8 shares a band with probability 0.99995.

Edge cases: null text is empty; texts without words are no one's near-duplicates, not even each other's; one-word texts are
equal or not. Repeated rows share a class. The class id is the least doc_id in the class (null ids are below all: the class id is
null only if all its ids are).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .common import bounded_batches, id_back, id_of, materialize, packed, spread, text_of, unpacked
from .components import bucket_links

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
#: Ratio of the bounds of a size class.
WIDTH = 1.05


def shingle_hashes(texts, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of k words; a text of fewer words has one run."""
    raw, edges = flat.joined([(t or "").lower() for t in texts])
    starts, ends, at = flat.words(raw, edges)
    w = flat.word_hashes(raw, starts, ends)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    pad = np.concatenate([w, np.zeros(k, np.uint64)])
    last = at[1:][doc]
    total = np.zeros(len(w), np.uint64)
    for j in range(k):  # words after the text's end count as nothing
        total = total * np.uint64(flat.BASE) + np.where(np.arange(len(w)) + j < last, pad[j : j + len(w)], np.uint64(0))
    keep = np.arange(len(w)) <= np.maximum(last - k, at[:-1][doc])
    return doc[keep], flat.mix(total[keep])


def as_multiset(doc: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, element, copy number) as one hash for each copy, sorted within documents."""
    order = np.lexsort((element, doc))
    doc, element = doc[order], element[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (element[1:] != element[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    copy = (np.arange(len(doc)) - head).astype(np.uint64)
    return doc, flat.mix(element + copy * np.uint64(0x9E3779B97F4A7C15))


def dart_signatures(doc: np.ndarray, cell: np.ndarray, n_docs: int, k: int, seed: int = 0, share: np.ndarray | None = None) -> np.ndarray:
    """Signatures, n_docs x k; documents without cells get zeros. ``doc`` is sorted; ``share``: which part of the cell the element fills (1 if None)."""
    size = np.bincount(doc, share, minlength=n_docs) if share is not None else np.bincount(doc, minlength=n_docs).astype(float)
    darts = k * math.log(k) + 2 * k
    limit = darts / np.maximum(size, 1e-9)
    sig = np.full((n_docs, k), np.iinfo(np.uint64).max, np.uint64)
    todo = size > 0
    while todo.any():
        use = np.flatnonzero(todo[doc])
        rank = np.zeros(len(use))
        turn = np.uint64(0)
        while len(use):
            h = flat.mix(cell[use] ^ flat.mix(np.full(1, (seed << 32) + 1, np.uint64) + turn))
            rank = rank - np.log((h >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54)
            low = rank < limit[doc[use]]
            use, rank, h = use[low], rank[low], flat.mix(h[low])
            hit = slice(None) if share is None else (flat.mix(h) >> np.uint64(11)).astype(float) * 2.0**-53 < share[use]
            value = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
            place = doc[use] * k + ((h >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(sig.reshape(-1), place[hit], value[hit])
            turn += np.uint64(1)
        todo &= (sig == np.iinfo(np.uint64).max).any(axis=1)
        limit[todo] *= 4
    sig[size == 0] = 0
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), np.uint64)
    for j in range(rows):
        out = out * np.uint64(flat.BASE) + sig[:, j : bands * rows : rows]
    return flat.mix(out + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        doc, cell = as_multiset(*shingle_hashes(b["text"]))
        has = np.bincount(doc, minlength=len(b)) > 0
        keys = band_keys(dart_signatures(doc, cell, len(b), BANDS * ROWS), BANDS, ROWS)[has]
        yield pd.DataFrame({"k": keys.reshape(-1).view(np.int64), "c": np.repeat(b["c"].to_numpy()[has], BANDS)})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        doc, cell = as_multiset(*shingle_hashes(b["text"]))
        cuts = np.searchsorted(doc, np.arange(len(b) + 1))
        yield pd.DataFrame({"c": b["c"], "cells": [np.sort((cell[i:j] >> np.uint64(32)).astype(np.uint32)).tobytes() for i, j in zip(cuts, cuts[1:])]})


def _elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        parts = [np.frombuffer(x, np.uint32) for x in b["cells"]]
        n = np.array([len(p) for p in parts], np.int64)
        yield pd.DataFrame({"c": np.repeat(b["c"].to_numpy(), n), "label": np.repeat(b["label"].to_numpy(), n), "n": np.repeat(n, n), "cell": np.concatenate(parts).astype(np.int64)})


def odd_bits() -> Column:
    """For each bit of 4 longs, if the number of elements (column cell) that hash to it is odd, as an aggregate."""
    h = F.xxhash64("cell")
    of = lambda i: F.when(F.shiftrightunsigned(h, 6).bitwiseAND(3) == i, F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))).otherwise(F.lit(0).cast("long"))
    return F.array(*[F.bit_xor(of(i)) for i in range(4)])


def prefix_pairs(named: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a < b, of texts of different labels that may be similar; ``named``: c, label. No pair at ``least`` or more is lost.

    Two sets of sizes m and n that are similar enough share least / (1 + least) * (m + n) elements or more. The first that they
    share, in one order of all elements, has so many places from it to the end of each. Places are joined by element and by the
    size classes of both sets, so that a place is dealt out only where it is early enough for sets of that class; elements of one
    set only take up the first places, but are not dealt out. A bit that is odd in one set only stands for an element or more that
    only one of them has: there may be no more such bits than sets so similar have such elements (Sandes et al., 2020).
    """
    share = least / (1 + least)
    cells = materialize(sets.join(named, "c").mapInPandas(_elements, "c long, label long, n long, cell long"), "elements")
    often = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    bits = cells.groupBy("c").agg(odd_bits().alias("bits"))
    own = cells.join(often, "cell").groupBy("c", "label", "n").agg(F.sort_array(F.collect_list(F.struct("times", "cell"))).alias("cells"))
    reach = math.ceil(-math.log(least) / math.log(WIDTH))
    z = F.floor(F.log("n") / math.log(WIDTH)).cast("long")
    smallest = F.greatest(F.ceil(F.pow(F.lit(WIDTH), "p") - 1e-6), F.ceil(least * F.col("n") - 1e-6))
    last = F.col("n") - F.ceil(share * (F.col("n") + smallest) - 1e-6)
    skipped = F.col("n") - F.size("cells")
    dealt = own.withColumn("z", z).withColumn("p", F.explode(F.sequence(F.col("z") - reach, F.col("z") + reach)))
    dealt = dealt.select("c", "label", "n", "z", "p", skipped.alias("skipped"), F.posexplode(F.slice("cells", F.lit(1), F.greatest(last - skipped + 1, F.lit(0)).cast("int"))).alias("i", "x"))
    key = F.xxhash64(F.least("z", "p"), F.greatest("z", "p"), "x.cell")
    dealt = materialize(dealt.select(key.alias("k"), "c", "label", "n", "z", "p", (F.col("n") - F.col("skipped") - F.col("i")).alias("rest")), "places")
    several = dealt.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("k")
    dealt = materialize(dealt.join(several, "k").join(bits, "c"), "places")
    y = dealt.where("z >= p").select("k", F.col("c").alias("d"), F.col("label").alias("to"), F.col("n").alias("m"), F.col("z").alias("zz"), F.col("rest").alias("left"), F.col("bits").alias("bits2"))
    apart = sum((F.bit_count(F.get("bits", i).bitwiseXOR(F.get("bits2", i))) for i in range(4)), F.lit(0))
    both = dealt.where("z <= p").join(y, "k").where("label <> to and (z < zz or c < d)").where(F.least("rest", "left") >= share * (F.col("n") + F.col("m")) - 1e-6).where(apart <= (1 - 2 * share) * (F.col("n") + F.col("m")) + 1e-6)
    return both.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()


def _similar(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = np.zeros(len(b), bool)
            for i, (x, y) in enumerate(zip(b["x"], b["y"])):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                if min(len(x), len(y)) < least * max(len(x), len(y)):
                    continue
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                good[i] = shared >= least * (len(x) + len(y) - shared) - 1e-9
            yield b.loc[good, ["a", "b"]]

    return run


def _checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    x, y = sets.select(F.col("c").alias("a"), F.col("cells").alias("x")), sets.select(F.col("c").alias("b"), F.col("cells").alias("y"))
    return spread(pairs).join(x, "a").join(y, "b").mapInPandas(_similar(least), "a long, b long")


def links(rows: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(a, b) links between different texts, and their components (node, label); ``rows``: id, c (hash of the text), text."""
    bands = materialize(rows.select("c", "text").mapInPandas(_bands, "k long, c long").distinct(), "bands")

    def sets(wanted: DataFrame) -> DataFrame:
        # One document of each text: copies don't gather.
        one = rows.groupBy("c").agg(F.min("id").alias("id")).join(wanted, "c")
        return materialize(rows.join(one, ["id", "c"]).select("c", "text").mapInPandas(_sets, "c long, cells binary").dropDuplicates(["c"]), "sets")

    across = lambda mixed, s: prefix_pairs(mixed.select("c", "label").distinct(), s, least)
    return bucket_links(bands, sets, lambda pairs, s: _checked(pairs, s, least), across)


def near_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per row: doc_id, class_id, class_size, links_found.

    ``links_found`` is the number of links of the row's text that were checked and found while classes were made: at least one where
    a class has different texts, but not all links, as texts of one component are not compared again.
    """
    return _classes(docs, least).select(id_back("id").alias("doc_id"), id_back("class").alias("class_id"), "class_size", "links_found")


def _classes(docs: DataFrame, least: float) -> DataFrame:
    bounded_batches(docs.sparkSession)
    rows = docs.select(id_of().alias("id"), text_of().alias("text")).withColumn("c", F.xxhash64("text"))
    found, label = links(rows, least)
    label = label.withColumnRenamed("node", "c")
    degree = found.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("links_found"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    narrow = materialize(rows.select("id", "c", blank.alias("blank")), "near-rows")
    group = F.when(F.col("blank"), F.struct(F.lit(1).alias("kind"), F.col("id").alias("of"))).otherwise(F.struct(F.lit(0).alias("kind"), F.coalesce("label", "c").alias("of")))
    named = narrow.join(label, "c", "left").join(degree, "c", "left").withColumn("g", group)
    size = named.groupBy("g").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("class_size"))
    return named.join(size, "g").select("id", "c", "class", "class_size", F.coalesce("links_found", F.lit(0)).cast("long").alias("links_found"))


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents with the least id of each class, with all their columns; of rows alike in id and text one stays."""
    kept = _classes(docs, least).where("id = class").groupBy("class").agg(F.min("c").alias("c")).withColumnRenamed("class", "id")
    rows = packed(docs, id_of().alias("id"), F.xxhash64(text_of()).alias("c"))
    turn = F.row_number().over(Window.partitionBy("id", "c").orderBy(F.lit(0)))
    return unpacked(rows.join(kept, ["id", "c"], "left_semi").withColumn("turn", turn).where("turn = 1"))
