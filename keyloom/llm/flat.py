"""Texts of a batch as flat numpy arrays: bytes, words, hashes of runs of units, and minimizer anchors."""

from __future__ import annotations

import functools

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Units handled at once; more are taken in overlapping pieces, so one very long text needs no more memory than many short ones.
PIECE = 1 << 19
PLACE = np.uint64((1 << 21) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
    p[0] = q[0] = 1
    return np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = _powers(1 << max(10, (n - 1).bit_length()))
    return p[:n], q[:n]


def run_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of units[i : i + k] for every i with k units; fewer units than k give none."""
    n = len(units)
    if n < k:
        return np.empty(0, np.uint64)
    p, q = powers(n + 1)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum((units + np.uint64(1)) * p[:n], out=c[1:])
    return mix((c[k:] - c[:-k]) * q[: n - k + 1])


def joined(texts) -> tuple[bytes, np.ndarray]:
    """UTF-8 bytes one after another and the place where each text starts (and the end)."""
    parts = [t if isinstance(t, bytes) else (t or "").encode() for t in texts]
    return b"".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def words(raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (runs of bytes other than \\x20 and \\x09-\\x0D; texts' borders end words), and the index of each text's first word."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(b) + 1, bool)
    inside[:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = at[:-1]
    first[cut[cut < len(b)]] = inside[cut[cut < len(b)]]
    starts = np.flatnonzero(first)
    stop = ~inside
    stop[at] = True
    ends = np.flatnonzero(stop)
    ends = ends[np.searchsorted(ends, starts, "right")] if len(starts) else starts
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    b, lo = np.frombuffer(raw, np.uint8), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + PIECE, "right")))
        o, e = starts[lo], ends[hi - 1]
        p, q = powers(int(e - o) + 1)
        c = np.zeros(e - o + 1, np.uint64)
        np.cumsum((b[o:e].astype(np.uint64) + np.uint64(1)) * p[: e - o], out=c[1:])
        out[lo:hi] = mix((c[ends[lo:hi] - o] - c[starts[lo:hi] - o]) * q[starts[lo:hi] - o] + (ends[lo:hi] - starts[lo:hi]).astype(np.uint64))
        lo = hi
    return out


def anchors(units: np.ndarray, at: np.ndarray, window: int, k: int):
    """Yields (text, place of the anchor, its hash, first window, last window), arrays of runs of windows with one anchor.

    A window's anchor is the leftmost of the least-hashed k units in it, so equal windows have equal anchors wherever they
    are. ``units``: of all texts; ``at``: where each text's units start, and the end.
    """
    width = window - k + 1
    for lo in range(0, len(units) - window + 1, PIECE):
        piece = units[lo : lo + PIECE + window - 1].astype(np.uint64)
        h = run_hashes(piece, k)
        n = len(piece) - window + 1
        m = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span < width:  # a minimum of minima over twice the span
            s = min(span, width - span)
            m = np.minimum(m[: len(m) - s], m[s:])
            span += s
        place = (m[:n] & PLACE).astype(np.int64)
        heads = np.flatnonzero(np.diff(place, prepend=-1))
        anchor = place[heads] + lo
        text = np.searchsorted(at, anchor, "right") - 1
        # Windows that cross texts drop out: those of an anchor lie in its text.
        first = np.maximum(heads + lo, at[text])
        last = np.minimum(np.append(heads[1:], n) - 1 + lo, at[text + 1] - window)
        use = first <= last
        if use.any():
            yield text[use], anchor[use], h[place[heads]][use], first[use], last[use]
