"""Exact removal of repeated windows, for any unit (bytes or words) and any in-memory index of repeats.

Which windows repeat is decided on the input: a unit goes if a window of W units over it also starts earlier (smaller id,
or same document, earlier start). The corpus is never sorted as a whole:

1. every document gives sparse anchors (about 2 / (W - k) of its units): content chosen, so equal windows share theirs;
2. anchors that occur once are dropped (counted by hash, after each batch has reduced its repeated ones to one);
3. around the others, the windows of an anchor are a segment, known by its hash; equal segments are reduced to their first
   place, so thousands of copies cost one;
4. where an anchor has several distinct segments, these are cut out, and meet in one task, in blocks of bounded bytes, where the operator's own index
   (suffix array or suffix trees) finds the windows that occur more than once; the segments of an anchor with more bytes than a block
   (a common phrase) are dealt out by longer runs around it first, again and again until they fit;
5. spans go back to their documents.

Texts with such anchors are written once, bucketed by a hash of their key, and joined in place after that. Rows are told
apart by (doc_id, hash of the text); rows alike in both are repeats of each other, the first stays. Null
ids come before all others. Null or empty texts, and texts below W units, lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .common import bounded_batches, bucketed, id_back, id_of, materialize, text_of

#: Bytes of distinct segments indexed at once.
BLOCK_BYTES = 2_000_000
#: A segment: its anchor's key, the bytes, where they are from, first window, number of windows, and the place of the anchor in it.
SEGMENTS = "a long, seg binary, id long, h long, lo int, n int, o int"
SEGMENT_COLUMNS = [c.split()[0] for c in SEGMENTS.split(", ")]
SPACES = r"[\x20\x09-\x0D]+"

#: An index takes (segments, window) and returns, for the windows found more than once: segment, offset, class.
Index = Callable[[list[bytes], int], tuple[np.ndarray, np.ndarray, np.ndarray]]


class Texts:
    """A batch of texts (str, or bytes of UTF-8 text) as units: bytes, or words."""

    def __init__(self, texts, unit: str):
        self.raw, self.edges = flat.joined(texts)
        self.unit = unit
        if unit == "byte":
            self.units, self.at = np.frombuffer(self.raw, np.uint8), self.edges
        else:
            self.starts, self.ends, self.at = flat.words(self.raw, self.edges)
            self.units = flat.word_hashes(self.raw, self.starts, self.ends)

    def cut(self, lo: int, hi: int) -> bytes:
        if self.unit == "byte":
            return self.raw[lo:hi]
        return b" ".join(self.raw[s:e] for s, e in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist()))


def _find_anchors(unit: str, window: int, k: int):
    """(a, key, p, known, sure): of anchors that a batch has twice or more, all are known to repeat, but only the first goes on
    to be counted; so a common anchor costs a row a batch, not a row an occurrence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t = Texts(b["text"], unit)
            keys, parts = b["key"].to_numpy(), []
            for text, place, hashed, _, _ in flat.anchors(t.units, t.at, window, k):
                parts.append(((hashed >> np.uint64(16)).view(np.int64), keys[text], place - t.at[text]))
            if not parts:
                continue
            a, key, p = (np.concatenate(x) for x in zip(*parts))
            _, first, of, times = np.unique(a, return_index=True, return_inverse=True, return_counts=True)
            lead = first[of] == np.arange(len(a))
            yield pd.DataFrame({"a": a, "key": key, "p": p.astype(np.int32), "known": ~lead, "sure": times[of] > 1})

    return run


def _note_segments(unit: str, window: int, k: int):
    """Segments by hashes alone: (a, s, id, h, lo, n, known). Of equal segments in a batch only the first goes on to be compared; the others are known to be later copies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t = Texts(b["text"], unit)
            ids, hs = b["id"].to_numpy(), b["h"].to_numpy()
            known, parts = np.unique(np.concatenate([np.asarray(p) + o for p, o in zip(b["places"], t.at.tolist())])), []
            for text, place, hashed, first, last in flat.anchors(t.units, t.at, window, k):
                use = np.flatnonzero(known[np.minimum(np.searchsorted(known, place), len(known) - 1)] == place)
                lo, hi, x = first[use], last[use] + window, text[use]
                if not len(use):
                    continue
                units, o = t.units[lo[0] : hi.max()].astype(np.uint64), lo[0]
                pw, inv = flat.powers(len(units) + 1)
                c = np.zeros(len(units) + 1, np.uint64)
                np.cumsum((flat.mix(units) + np.uint64(1)) * pw[:-1], out=c[1:])
                s = flat.mix((c[hi - o] - c[lo - o]) * inv[lo - o] + (hi - lo).astype(np.uint64)) ^ hashed[use]
                parts.append((hashed[use].view(np.int64), s.view(np.int64), ids[x], hs[x], lo - t.at[x], hi - lo - window + 1, place[use] - lo))
            if not parts:
                continue
            a, s, i, h, lo, n, o = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((lo, h, i, s))
            known = np.zeros(len(s), bool)
            known[order[1:]] = s[order[1:]] == s[order[:-1]]
            yield pd.DataFrame({"a": a, "s": s, "id": i, "h": h, "lo": lo.astype(np.int32), "n": n.astype(np.int32), "o": o.astype(np.int32), "known": known})

    return run


def _cut_segments(unit: str, window: int):
    """The segments asked for, as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t, out = Texts(b["text"], unit), []
            for i, wanted in enumerate(b["wanted"]):
                key, o = (b["id"].iat[i], b["h"].iat[i]), int(t.at[i])
                out += [(x["a"], t.cut(o + x["lo"], o + x["lo"] + x["n"] + window - 1), *key, x["lo"], x["n"], x["o"]) for x in wanted if (x["id"], x["h"]) == key]
            yield pd.DataFrame(out, columns=SEGMENT_COLUMNS)

    return run


def _runs(*cols: np.ndarray) -> np.ndarray:
    """Where sorted rows change in the first columns or the last one doesn't follow on."""
    new = np.ones(len(cols[0]), bool)
    if len(new) > 1:
        new[1:] = cols[-1][1:] != cols[-1][:-1] + 1
        for c in cols[:-1]:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _extended(rows: pd.DataFrame, unit: str, window: int, k: int) -> np.ndarray:
    """Segments worth indexing: a window holds its anchor and, left or right of it, half of what it has besides; so one of these
    longer runs has to occur in another segment of the anchor."""
    half = -(-(window - k) // 2)
    t = Texts(rows["seg"], unit)
    units = flat.mix(t.units.astype(np.uint64)) if unit == "byte" else t.units
    pw, inv = flat.powers(len(units) + 1)
    c = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units + np.uint64(1)) * pw[:-1], out=c[1:])
    at, a = t.at[:-1] + rows["o"].to_numpy(), rows["a"].to_numpy().view(np.uint64)
    worth = np.zeros(len(rows), bool)
    for lo, hi, salt in ((at - half, at + k, 1), (at, at + k + half, 2)):
        fits = np.flatnonzero((lo >= t.at[:-1]) & (hi <= t.at[1:]))
        lo, hi = lo[fits], hi[fits]
        h = flat.mix((c[hi] - c[lo]) * inv[lo] + np.uint64(salt)) ^ a[fits]
        _, of, times = np.unique(h, return_inverse=True, return_counts=True)
        worth[fits[times[of] > 1]] = True
    return worth


def _index_blocks(index: Index, unit: str, window: int, k: int, most: int):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[_extended(rows, unit, window, k)]
        if not len(rows):
            return pd.DataFrame(columns=["id", "h", "lo", "n"]).astype("int64")
        seg, off, cls = index(rows["seg"].tolist(), window)
        ids, hs, at = rows["id"].to_numpy()[seg], rows["h"].to_numpy()[seg], rows["lo"].to_numpy()[seg] + off
        order = np.lexsort((at, hs, ids, cls))
        first = np.ones(len(order), bool)
        first[1:] = cls[order][1:] != cls[order][:-1]
        later = order[~first]
        later = later[np.lexsort((at[later], hs[later], ids[later]))]
        ids, hs, at = ids[later], hs[later], at[later]
        heads = _runs(ids, hs, at)
        return pd.DataFrame({"id": ids[heads], "h": hs[heads], "lo": at[heads], "n": np.diff(np.append(heads, len(at)))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if sum(x["seg"].map(len).sum() for x in held) < most:
                continue
            rows = pd.concat(held, ignore_index=True)
            # The last anchor may go on in the next batch.
            whole = int(np.searchsorted(rows["a"].to_numpy(), rows["a"].iat[-1], "left"))
            sizes = np.cumsum(rows["seg"].map(len).to_numpy())
            done = 0
            while done < whole:
                stop = int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + most, "right"))
                stop = min(max(stop, done + 1), whole)
                if stop < whole:  # up to a border between anchors
                    anchor = rows["a"].to_numpy()
                    stop = max(int(np.searchsorted(anchor, anchor[stop], "left")), done) if anchor[stop] == anchor[stop - 1] else stop
                    stop = int(np.searchsorted(anchor, anchor[done], "right")) if stop == done else stop
                yield solve(rows.iloc[done:stop])
                done = stop
            held = [rows.iloc[whole:]]
        rows = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        if len(rows):
            yield solve(rows)

    return run


def _redeal(unit: str, window: int, core: int, more: int):
    """Each segment as two, by longer runs around its anchor: those of its windows that hold ``more`` units left of the run, and right of it.

    A window holds the anchor's run of ``core`` units and, on one side at least, half of what it has besides.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for a, seg, i, h, lo, n, o in zip(*(b[c].tolist() for c in SEGMENT_COLUMNS)):
                w = seg if unit == "byte" else seg.split(b" ")
                for side, first, last, begin in ((1, 0, min(n - 1, o - more), o - more), (2, max(0, o + core + more - window), n - 1, o)):
                    if first > last:
                        continue
                    run_of, cut = w[begin : begin + core + more], w[first : last + window]
                    run_of, cut = (run_of, cut) if unit == "byte" else (b" ".join(run_of), b" ".join(cut))
                    key = hashlib.blake2b(run_of, digest_size=8, key=a.to_bytes(8, "little", signed=True), salt=bytes([side])).digest()
                    out.append((int.from_bytes(key, "little", signed=True), cut, i, h, lo + first, last - first + 1, begin - first))
            yield pd.DataFrame(out, columns=SEGMENT_COLUMNS)

    return run


def _indexed(segments: DataFrame, unit: str, window: int, core: int, index: Index) -> DataFrame:
    """(id, h, lo, n): runs of windows of the segments that start elsewhere earlier, all found by the index.

    Anchors with up to BLOCK_BYTES of segments are indexed in blocks. The segments of others are dealt out again by longer runs, of which
    equal ones are reduced to the first again, until each fits; runs as long as a window leave nothing to compare.
    """
    found = None
    while True:
        size = segments.groupBy("a").agg(F.sum(F.octet_length("seg")).alias("bytes"))
        large = materialize(size.where(F.col("bytes") > BLOCK_BYTES).select("a"), "repeat-large")
        last = core == window or large.isEmpty()
        here = segments if last else segments.join(large, "a", "left_anti")
        blocks = here.repartition("a").sortWithinPartitions("a").mapInPandas(_index_blocks(index, unit, window, core, BLOCK_BYTES), "id long, h long, lo int, n int")
        found = blocks if found is None else found.unionByName(blocks)
        if last:
            return found
        more = -(-(window - core) // 2)
        dealt = segments.join(large, "a", "left_semi").select(*SEGMENT_COLUMNS).mapInPandas(_redeal(unit, window, core, more), SEGMENTS)
        place = F.struct("id", "h", "lo")
        first = dealt.groupBy("a", F.xxhash64("seg").alias("s"), F.octet_length("seg").alias("long")).agg(F.min(place).alias("first"))
        dealt = dealt.withColumns({"s": F.xxhash64("seg"), "long": F.octet_length("seg")}).join(first, ["a", "s", "long"])
        dealt = materialize(dealt.select(*SEGMENT_COLUMNS, (place == F.col("first")).alias("lead")), "repeat-dealt")
        found = found.unionByName(dealt.where("not lead").select("id", "h", "lo", "n"))
        lead = dealt.where("lead").drop("lead")
        several = lead.groupBy("a").agg(F.count(F.lit(1)).alias("g")).where("g > 1").select("a")
        segments, core = lead.join(several, "a", "left_semi"), core + more


def _later_windows(docs: DataFrame, unit: str, window: int, k: int, index: Index) -> tuple[DataFrame, DataFrame, Callable[[], None]]:
    """(id, h, lo, n): runs of windows that start elsewhere earlier; the texts they can be in, a table bucketed by key; and what drops it."""
    spark = docs.sparkSession
    keys = "id long, h long, "
    found = docs.select("key", "text").mapInPandas(_find_anchors(unit, window, k), "a long, key int, p int, known boolean, sure boolean")
    deal = F.when(F.col("known"), F.xxhash64("key", "p")).otherwise(F.col("a"))
    times = F.count(F.lit(1)).over(Window.partitionBy("deal", "known"))
    often = found.withColumn("deal", deal).drop("a").withColumn("c", times).where("known or sure or c > 1")
    places = often.groupBy("key").agg(F.collect_set("p").alias("places"))
    # Texts move once: by key, into buckets that the later joins read where they are.
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts, drop = bucketed(docs.repartition(buckets, "key").join(places, "key").dropDuplicates(["key", "id", "h"]), "repeat_texts", "key")
    segs = texts.select("id", "h", "text", "places").mapInPandas(_note_segments(unit, window, k), "a long, s long, " + keys + "lo int, n int, o int, known boolean")
    place = F.struct("id", "h", "lo")
    first = F.min(place).over(Window.partitionBy("deal", "a", "known"))
    segs = segs.withColumn("deal", F.when(F.col("known"), F.xxhash64("id", "h", "lo")).otherwise(F.col("s"))).drop("s").withColumn("first", first)
    segs = materialize(segs.select("a", "id", "h", "lo", "n", "o", (~F.col("known") & (place == F.col("first"))).alias("lead")), "repeat-segments")
    # Each later copy of a whole segment.
    again, once = segs.where("not lead").select("id", "h", "lo", "n"), segs.where("lead")
    # Anchors with several segments: these are cut out of the texts.
    groups = once.groupBy("a").agg(F.count(F.lit(1)).alias("g")).where("g > 1")
    wanted = once.join(groups, "a").select(F.hash("id", "h").alias("key"), F.struct("a", "id", "h", "lo", "n", "o").alias("w"))
    wanted = wanted.groupBy("key").agg(F.collect_list("w").alias("wanted"))
    split = materialize(texts.select("key", "id", "h", "text").join(wanted, "key").select("id", "h", "text", "wanted").mapInPandas(_cut_segments(unit, window), SEGMENTS), "repeat-cuts")
    return again.unionByName(_indexed(split, unit, window, k, index)), texts, drop


def _remove(unit: str, window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b, out = b[(b["id"] == b["of"]) & (b["h"] == b["of_h"])], []
            t = Texts(b["text"], unit)
            for j, runs in enumerate(b["runs"]):
                lo, hi = int(t.at[j]), int(t.at[j + 1])
                runs = np.asarray(runs, np.int64)
                begin, n = runs >> 32, runs & 0xFFFFFFFF
                edge = np.bincount(begin, minlength=hi - lo + 1) - np.bincount(begin + n + window - 1, minlength=hi - lo + 1)
                gone = np.cumsum(edge)[:-1] > 0
                if unit == "byte":
                    kept = t.units[lo:hi][~gone].tobytes()
                else:
                    kept = b" ".join(t.raw[s:e] for s, e in zip(t.starts[lo:hi][~gone].tolist(), t.ends[lo:hi][~gone].tolist()))
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((b["id"].iat[j], b["h"].iat[j], int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["id", "h", "gone", "spans", "sha", "kept"])

    return run


def remove_repeats(docs: DataFrame, unit: str, window: int, k: int, index: Index, with_text: bool = False) -> DataFrame:
    """One row per row: doc_id, n, n_removed, n_spans, kept_sha256 and, if asked for, the kept text (bytes that are no UTF-8 after the cut are replaced there)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(id_of().alias("id"), text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    later, texts, drop = _later_windows(rows.select(F.hash("id", "h").alias("key"), "id", "h", "text"), unit, window, k, index)
    packed = F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    runs = later.groupBy(F.hash("id", "h").alias("key"), F.col("id").alias("of"), F.col("h").alias("of_h")).agg(F.collect_list(packed).alias("runs"))
    cut = texts.select("key", "id", "h", "text").join(runs, "key").drop("key").mapInPandas(_remove(unit, window), "id long, h long, gone long, spans long, sha string, kept string")
    cut = materialize(cut if with_text else cut.drop("kept"), "repeats-cut")
    drop()
    if unit == "byte":
        whole, n = F.col("text"), F.octet_length("text")
    else:
        words = F.filter(F.split("text", SPACES, -1), lambda x: x != "")
        whole, n = F.concat_ws(" ", words), F.size(words)
    base = rows.select("id", "h", n.cast("long").alias("n"), F.sha2(whole, 256).alias("whole"), *([whole.alias("all")] if with_text else []))
    turn = F.row_number().over(Window.partitionBy("id", "h").orderBy(F.lit(0)))
    both = base.withColumn("turn", turn).join(cut, ["id", "h"], "left")
    copy = (F.col("turn") > 1) & (F.col("n") >= window)
    pick = lambda full, part, none: F.when(copy, full).otherwise(F.coalesce(part, none))
    return both.select(
        id_back("id").alias("doc_id"), "n", pick(F.col("n"), F.col("gone"), F.lit(0)).alias("n_removed"), pick(F.lit(1), F.col("spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.sha2(F.lit(""), 256), F.col("sha"), F.col("whole")).alias("kept_sha256"), *([pick(F.lit(""), F.col("kept"), F.col("all")).alias("kept_text")] if with_text else []),
    )
