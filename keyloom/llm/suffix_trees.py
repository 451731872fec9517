"""Substring dedup by prefix-partitioned suffix trees over words.

The suffixes of a block are parted by prefixes of varying length: a group with more than GROUP suffixes takes one more word
into its prefix, until it fits or the prefix is as long as a window. Each group's subtree is built on its own, as the
intervals of its sorted suffixes; internal nodes at least a window deep give the repeats. ``repeats`` tells how blocks come
about, and what happens on odd input.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import flat
from .repeats import remove_repeats

WINDOW = 20
#: Words hashed for an anchor: one anchor in about 7 words.
ANCHOR = 8
GROUP = 20_000


def _part(words: np.ndarray, starts: np.ndarray, window: int, most: int) -> list[tuple[int, np.ndarray]]:
    """(prefix length, suffixes) of groups of two or more suffixes with one prefix."""
    done, open_groups = [], [(0, starts)]
    while open_groups:
        depth, group = open_groups.pop()
        if len(group) < 2:
            continue
        if depth == window or len(group) <= most:
            done.append((depth, group))
            continue
        key = words[group + depth]
        turn = np.argsort(key, kind="stable")
        group, key = group[turn], key[turn]
        parts = np.split(group, np.flatnonzero(key[1:] != key[:-1]) + 1)
        sizes = np.array([len(p) for p in parts])
        open_groups += [(depth + 1, parts[i]) for i in np.flatnonzero(sizes > most)]
        # Small neighbours share a build: their prefixes differ, so no node spans two of them.
        held: list[np.ndarray] = []
        for i in np.flatnonzero((sizes <= most) & (sizes > 1)):
            if sum(map(len, held)) + sizes[i] > most:
                done.append((0 if len(held) > 1 else depth + 1, np.concatenate(held)))
                held = []
            held.append(parts[i])
        if held:
            done.append((0 if len(held) > 1 else depth + 1, np.concatenate(held)))
    return done


def _deep_nodes(words: np.ndarray, suffixes: np.ndarray, depth: int, window: int) -> np.ndarray:
    """A number for each suffix: that of the node ``window`` words deep above it. The subtree below ``depth`` is split level by level, only where a node has two leaves left."""
    node = np.zeros(len(suffixes), np.int64)
    live = np.arange(len(suffixes))
    while depth < window and len(live):
        key = words[suffixes[live] + depth].astype(np.uint64)
        if depth + 1 < window:  # two words at a time
            key = (key << np.uint64(32)) | words[suffixes[live] + depth + 1].astype(np.uint64)
        turn = np.lexsort((key, node[live]))
        live, key = live[turn], key[turn]
        n = node[live]
        new = np.ones(len(live), bool)
        new[1:] = (n[1:] != n[:-1]) | (key[1:] != key[:-1])
        node[live] = live[np.flatnonzero(new)][np.cumsum(new) - 1]
        alone = new & np.append(new[1:], True)
        node[live[alone]] = -1 - live[alone]
        live = live[~alone]
        depth += 2
    return node


def repeated_windows(segments: list[bytes], window: int, most: int = GROUP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = b" ".join(segments)
    sizes = np.array([len(x) for x in segments], np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes + 1)])
    edges[-1] = len(raw)
    starts, ends, at = flat.words(raw, edges)
    _, words = np.unique(flat.word_hashes(raw, starts, ends), return_inverse=True)
    n_windows = np.maximum(np.diff(at) - window + 1, 0)
    seg = np.repeat(np.arange(len(segments)), n_windows)
    off = np.arange(len(seg)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    begin = at[seg] + off
    where = np.full(len(words) + 1, -1, np.int64)
    where[begin] = np.arange(len(begin))
    rows, cls, seen = [], [], 0
    for depth, group in _part(words, begin, window, most):
        node = _deep_nodes(words, group, depth, window)
        deep = node >= 0
        rows.append(where[group[deep]])
        cls.append(node[deep] + seen)
        seen += len(group)
    if not rows:
        none = np.empty(0, np.int64)
        return none, none, none
    r = np.concatenate(rows)
    return seg[r], off[r], np.concatenate(cls)


def dedup_words(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    out = remove_repeats(docs, "word", window, anchor, repeated_windows, with_text)
    return out.withColumnRenamed("n", "n_words")
