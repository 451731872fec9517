"""Substring dedup by suffix arrays built with two-stage sorting.

In a block, suffixes smaller than their successors are sorted directly; every other suffix is induced from them by one scan
over the buckets of first bytes; then the common prefix of each adjacent pair shows which windows occur more than once.
How blocks come about, and what happens on odd input, is told in ``repeats``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import remove_repeats

WINDOW = 100
#: Bytes hashed for an anchor: one anchor in about 27 bytes.
ANCHOR = 48
#: Stands between segments; no UTF-8 text has it.
BETWEEN = b"\xff"


def _packed(s: np.ndarray) -> np.ndarray:
    """At each place the next 8 bytes as one number, in big-endian order; zeros after the end."""
    x = np.zeros(len(s) + 8, np.uint64)
    x[: len(s)] = s
    out = np.zeros(len(s), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | x[i : i + len(s)]
    return out


def smaller_than_next(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the empty suffix is the least."""
    ends = np.append(np.flatnonzero(s[1:] != s[:-1]), len(s) - 1)
    up = np.append(s[ends[:-1]] < s[ends[:-1] + 1], False)
    return np.repeat(up, np.diff(np.append(-1, ends)))


def sort_directly(eight: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of their suffixes' first ``depth`` bytes (rounded up to 8), ties by place."""
    order = places[np.argsort(eight[places], kind="stable")]
    group = np.concatenate([[0], np.cumsum(eight[order][1:] != eight[order][:-1])]) if len(order) else np.empty(0, np.int64)
    tied = np.arange(len(order))
    for off in range(8, depth, 8):
        g = group[tied]
        same = np.zeros(len(tied) + 1, bool)
        same[1:-1] = g[1:] == g[:-1]
        tied = tied[same[1:] | same[:-1]]
        if not len(tied):
            break
        key = eight[np.minimum(order[tied] + off, len(eight) - 1)]
        key[order[tied] + off >= len(eight)] = 0
        turn = np.lexsort((key, group[tied]))
        order[tied], key, g = order[tied][turn], key[turn], group[tied]
        new = np.ones(len(tied), bool)
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        # Groups keep distinct numbers: the place of a group's first member.
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
    return order


def suffix_array(s: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``s`` in the order of (at least) their first ``depth`` bytes; and the packed bytes."""
    n, eight = len(s), _packed(s)
    small = smaller_than_next(s)
    total, n_small = np.bincount(s, minlength=256), np.bincount(s[small], minlength=256)
    begin = np.concatenate([[0], np.cumsum(total)[:-1]])
    middle = begin + total - n_small  # of each bucket: larger ones first, then the smaller ones
    out = np.full(n, -1, np.int64)
    direct = sort_directly(eight, np.flatnonzero(small), depth)
    first = np.concatenate([[0], np.cumsum(n_small)[:-1]])
    out[middle[s[direct]] + np.arange(len(direct)) - first[s[direct]]] = direct
    head = begin.copy()

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~small[before]]
        c = s[before]
        turn = np.argsort(c, kind="stable")
        before, c = before[turn], c[turn]
        n_each = np.bincount(c, minlength=256)
        at = np.concatenate([[0], np.cumsum(n_each)[:-1]])
        out[head[c] + np.arange(len(c)) - at[c]] = before
        head[:] += n_each

    out[head[s[n - 1]]] = n - 1  # the last byte's suffix comes before all that start with it
    head[s[n - 1]] += 1
    for c in np.flatnonzero(total):
        done = begin[c]
        while done < head[c]:  # a scan may add to the bucket it reads
            stop = head[c]
            induce(out[done:stop])
            done = stop
        induce(out[middle[c] : begin[c] + total[c]])
    return out, eight


def common_prefixes(order: np.ndarray, eight: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes each suffix has in common with the one before it, counted up to ``depth``; 0 for the first."""
    length = np.zeros(len(order), np.int64)
    pairs = np.arange(1, len(order))
    for off in range(0, depth, 8):
        a, b = order[pairs - 1] + off, order[pairs] + off
        inside = np.maximum(a, b) < len(eight)
        pairs = pairs[inside]
        apart = eight[a[inside]] ^ eight[b[inside]]
        # Eight bytes more where nothing differs, else those before the highest byte that does.
        more = np.full(len(pairs), 8)
        differ = np.flatnonzero(apart)
        more[differ] = sum((apart[differ] < np.uint64(1 << 8 * i)).astype(np.int64) for i in range(1, 8))
        length[pairs] += more
        pairs = pairs[apart == 0]
    return np.minimum(length, depth)


def repeated_windows(segments: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in segments], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    s = np.frombuffer(BETWEEN.join(segments) + BETWEEN, np.uint8)
    order, eight = suffix_array(s, window)
    # Of the suffixes, those that start a window; they are still in order.
    seg_of = np.repeat(np.arange(len(sizes)), sizes + 1)
    n_windows = np.maximum(sizes - window + 1, 0)
    edge = np.bincount(begin, minlength=len(s) + 1) - np.bincount(begin + n_windows, minlength=len(s) + 1)
    starts = np.cumsum(edge)[:-1] > 0
    order = order[starts[order]]
    cls = np.cumsum(common_prefixes(order, eight, window) < window) if len(order) else order
    seg = seg_of[order]
    off = order - begin[seg]
    often = np.bincount(cls)[cls] > 1
    return seg[often], off[often], cls[often]


def dedup_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    out = remove_repeats(docs, "byte", window, anchor, repeated_windows, with_text)
    return out.withColumnRenamed("n", "n_bytes")
