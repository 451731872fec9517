"""Benchmark decontamination by greedy string tiling, so that reordered passages are caught too.

Words are runs of letters and digits, in lower case. A document and an item that share a seed of MATCH words are compared:
running Karp-Rabin hashes over both give all common runs; the longest match whose words are still free in both is marked, again
and again, until none of MATCH words is left. The marked share of the item's words is its coverage; from COVERAGE on the
document is contaminated.

The seeds of a benchmark of at most SEEDS words (counted first) go to every task, and documents are tiled where they are
read, without a shuffle. A larger one is joined by seed instead, and only documents that share one are gathered with the item.

Edge cases: null texts are empty; items of fewer than MATCH words can't be told from common speech and match nothing; equal
item ids are separate items; rows alike are reported each: a document given twice, and an item given twice, four times. Both ways give the
same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import bounded_batches, id_back, id_of, materialize, packed, text_of, unpacked

MATCH = 5
COVERAGE = 0.5
SEEDS = 2_000_000
#: ASCII characters that are no letters or digits end words.
ENDS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def hashed_words(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's begin (and the end)."""
    parts = [(t or "").lower().encode().translate(ENDS) for t in texts]
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    raw = b"".join(parts)
    starts, ends, at = flat.words(raw, edges)
    return flat.word_hashes(raw, starts, ends), at


class _Free:
    """Windows of a text whose words are still free, by the hash of any number of words."""

    def __init__(self, words: np.ndarray):
        self.words, self.taken = words, np.zeros(len(words), bool)
        self.hashed: dict[int, np.ndarray] = {}

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the free windows of n words."""
        if n not in self.hashed:
            self.hashed[n] = flat.run_hashes(self.words, n)
        before = np.concatenate([[0], np.cumsum(self.taken)])
        at = np.flatnonzero(before[n:] == before[:-n])
        return at, self.hashed[n][at]


def tiles(doc: np.ndarray, item: np.ndarray, match: int = MATCH) -> list[tuple[int, int, int]]:
    """(place in doc, place in item, length): greedy tiling, longest first; ties go to the earlier place in the item, then the document.

    The longest common run of free words is found by halving its length, with running Karp-Rabin hashes of each length that is tried
    (a common run of n words has one of n - 1); lengths only fall from tile to tile. So a round costs the words of both, times the
    logarithm of the item's: no pairs of places are made, whatever repeats in either.
    """
    d, t, out = _Free(doc), _Free(item), []
    longest = min(len(doc), len(item))

    def common(n: int) -> tuple[int, int] | None:
        (i, x), (j, y) = d.windows(n), t.windows(n)
        hit = np.flatnonzero(np.isin(y, x))
        if not len(hit):
            return None
        return int(i[np.argmax(x == y[hit[0]])]), int(j[hit[0]])

    while longest >= match:
        found = common(longest)
        if found is None:
            low, high, found = match - 1, longest, None  # a run of low words is there (or match - 1), none of high
            while high - low > 1:
                middle = (low + high) // 2
                at = common(middle)
                low, high, found = (middle, high, at) if at else (low, middle, found)
            longest = low
            if found is None:
                break
        a, b = found
        d.taken[a : a + longest] = t.taken[b : b + longest] = True
        out.append((a, b, longest))
    return out


def _covered(doc: np.ndarray, item: np.ndarray, match: int) -> tuple[float, int]:
    found = tiles(doc, item, match)
    return sum(x[2] for x in found) / len(item), len(found)


def _tile_here(ids: list, items: list[np.ndarray], match: int, least: float):
    """Tiles each text against the items it shares seeds with; ``items`` and their seeds are in the task."""
    seeds = np.concatenate([flat.run_hashes(x, match) for x in items] or [np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(items)), [max(0, len(x) - match + 1) for x in items])
    turn = np.argsort(seeds, kind="stable")
    seeds, owner = seeds[turn], owner[turn]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w, at = hashed_words(b["text"])
            runs, out = flat.run_hashes(w, match), []
            hit = np.flatnonzero(np.isin(runs, seeds)) if len(seeds) else np.empty(0, np.int64)
            text = np.searchsorted(at, hit, "right") - 1
            inside = hit + match <= at[text + 1]
            hit, text = hit[inside], text[inside]
            for x in np.unique(text):
                doc, found = w[at[x] : at[x + 1]], np.unique(runs[hit[text == x]])
                near = owner[np.concatenate([np.arange(p, q) for p, q in zip(np.searchsorted(seeds, found, "left"), np.searchsorted(seeds, found, "right"))])]
                for k, n in zip(*np.unique(near, return_counts=True)):
                    if n * match < least * len(items[k]):  # not even if no two seeds overlapped
                        continue
                    c, m = _covered(doc, items[k], match)
                    if c >= least:
                        out.append((b["id"].iat[x], b["h"].iat[x], ids[k], c, m))
            yield pd.DataFrame(out, columns=["id", "h", "item_id", "coverage", "n_tiles"])

    return run


def _seeds(match: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w, at = hashed_words(b["text"])
            runs = flat.run_hashes(w, match)
            text = np.searchsorted(at, np.arange(len(runs)), "right") - 1
            ok = np.arange(len(runs)) + match <= at[text + 1]
            out = pd.DataFrame({"g": runs[ok].view(np.int64), "id": b["id"].to_numpy()[text[ok]], "h": b["h"].to_numpy()[text[ok]]})
            yield out.drop_duplicates()

    return run


def _tile_pairs(match: int, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w, at = hashed_words(b["text"])
            v, to = hashed_words(b["item"])
            out = [(b["id"].iat[i], b["h"].iat[i], b["item_id"].iat[i], *_covered(w[at[i] : at[i + 1]], v[to[i] : to[i + 1]], match), b["ih"].iat[i]) for i in range(len(b))]
            out = pd.DataFrame(out, columns=["id", "h", "item_id", "coverage", "n_tiles", "ih"])
            yield out[out["coverage"] >= least]

    return run


OUT = "id long, h long, item_id long, coverage double, n_tiles long"


def _leaks(rows: DataFrame, benchmark: DataFrame, match: int, least: float, seeds: int) -> DataFrame:
    bounded_batches(rows.sparkSession)
    items = benchmark.select(id_of("item_id").alias("item_id"), text_of().alias("item"))
    size = items.agg(F.sum(F.size(F.split("item", "[^\\p{L}\\p{N}]+"))), F.sum(F.octet_length("item"))).first()
    if (size[0] or 0) <= seeds and (size[1] or 0) <= 16 * seeds:
        got = items.orderBy("item_id", "item").collect()  # within the bound just counted
        w, at = hashed_words([x.item for x in got])
        return rows.mapInPandas(_tile_here([x.item_id for x in got], [w[i:j] for i, j in zip(at, at[1:])], match, least), OUT)
    # Rows alike count once here and are told apart again at the end, as they are where nothing is joined.
    doc = rows.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n_docs"))
    keyed = items.withColumn("ih", F.xxhash64("item"))
    item = keyed.groupBy("item_id", "ih").agg(F.first("item").alias("item"), F.count(F.lit(1)).alias("n_items"))
    grams = item.select(F.col("item_id").alias("id"), F.col("ih").alias("h"), F.col("item").alias("text")).mapInPandas(_seeds(match), "g long, id long, h long").select("g", F.col("id").alias("item_id"), F.col("h").alias("ih"))
    # A seed that very many texts hold is dealt over tasks by skew joins: neither side is an aggregate.
    pairs = rows.mapInPandas(_seeds(match), "g long, id long, h long").join(materialize(grams, "seeds"), "g").select("id", "h", "item_id", "ih").distinct()
    both = materialize(pairs, "seed-pairs").join(rows.dropDuplicates(["id", "h"]), ["id", "h"]).join(item.drop("n_items"), ["item_id", "ih"])
    found = materialize(both.mapInPandas(_tile_pairs(match, least), OUT + ", ih long"), "leaks")
    times = found.join(doc, ["id", "h"]).join(item.drop("item"), ["item_id", "ih"]).withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_docs") * F.col("n_items"))))
    return times.select(*[c.split()[0] for c in OUT.split(", ")])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(id_of().alias("id"), text_of().alias("text")).withColumn("h", F.xxhash64("text"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, least: float = COVERAGE, seeds: int = SEEDS) -> DataFrame:
    """One row for each contaminated document and item: doc_id, item_id, coverage, n_tiles."""
    out = _leaks(_rows(docs), benchmark, match, least, seeds)
    return out.select(id_back("id").alias("doc_id"), id_back("item_id").alias("item_id"), "coverage", "n_tiles")


def keep_clean(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, least: float = COVERAGE, seeds: int = SEEDS) -> DataFrame:
    """The documents that no item leaks into, with all their columns."""
    bad = _leaks(_rows(docs), benchmark, match, least, seeds).select("id", "h").distinct()
    return unpacked(packed(docs, id_of().alias("id"), F.xxhash64(text_of()).alias("h")).join(bad, ["id", "h"], "left_anti"))
