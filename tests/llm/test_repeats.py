import random

import numpy as np
import pandas as pd
import pytest

from keyloom.llm import flat, repeats, suffix_array, suffix_trees

from . import brute
from .test_native import EDGE, frame


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 8)))
    passages = [" ".join(word() for _ in range(r.randint(18, 80))) for _ in range(8)]
    texts = [" ".join(r.choice([word(), word(), r.choice(passages), "\n", "a  b"]) for _ in range(r.randint(0, 25))) for _ in range(n)]
    return texts + [texts[3], texts[3], texts[5] + " x", "ab" * 400, "ab" * 300, "the same " * 70, "z" * 99, "z" * 100, *EDGE]


def test_two_stage_sorting_orders_all_suffixes():
    r = random.Random(0)
    for n in (1, 2, 7, 60, 400):
        for letters in ("a", "ab", "abcdefgh"):
            t = "".join(r.choice(letters) for _ in range(n)).encode()
            got, _ = suffix_array.suffix_array(np.frombuffer(t, np.uint8), n + 8)
            assert got.tolist() == sorted(range(n), key=lambda i: t[i:])


@pytest.mark.parametrize("index,unit,window", [(suffix_array.repeated_windows, "byte", 12), (suffix_trees.repeated_windows, "word", 3)])
def test_blocks_find_each_repeated_window(index, unit, window):
    r = random.Random(1)
    segs = [" ".join(r.choice(["aa", "b", "ccc"]) for _ in range(r.randint(8, 30))).encode() for _ in range(40)]
    places = {}
    for i, s in enumerate(segs):
        u = s if unit == "byte" else s.split(b" ")
        for j in range(len(u) - window + 1):
            places.setdefault(bytes(u[j : j + window]) if unit == "byte" else tuple(u[j : j + window]), []).append((i, j))
    want = {tuple(v) for v in places.values() if len(v) > 1}
    for extra in [()] if unit == "byte" else [(), (7,)]:
        got = {}
        for a, b, c in zip(*index(segs, window, *extra)):
            got.setdefault(int(c), []).append((int(a), int(b)))
        assert {tuple(sorted(v)) for v in got.values()} == want


def test_words_and_hashes_do_not_depend_on_the_batch(monkeypatch):
    texts = ["", "a b", "b a\tb", " ", "é\x0bb", "b"]
    raw, at = flat.joined(texts)
    s, e, w = flat.words(raw, at)
    assert [[raw[i:j].decode() for i, j in zip(s[x:y], e[x:y])] for x, y in zip(w, w[1:])] == [brute.WORD.findall(t) for t in texts]
    h = flat.word_hashes(raw, s, e)
    assert h[1] == h[2] == h[4] == h[6] and h[0] == h[3] != h[1]
    monkeypatch.setattr(flat, "PIECE", 3)
    assert (flat.word_hashes(raw, s, e) == h).all()


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    r = np.random.default_rng(4)
    units, at = r.integers(0, 5, 900).astype(np.uint64), np.array([0, 3, 3, 500, 520, 900])
    windows = lambda: {(int(t), i): (int(p), int(h)) for x in flat.anchors(units, at, 20, 6) for t, p, h, a, b in zip(*x) for i in range(a, b + 1)}
    want = windows()
    assert len(want) == (497 - 19) + 1 + (380 - 19) and all(i <= p <= i + 14 for (_, i), (p, _) in want.items())
    monkeypatch.setattr(flat, "PIECE", 64)
    assert windows() == want


@pytest.mark.parametrize("op,unit,window,k", [(suffix_array.dedup_substrings, "byte", 100, 32), (suffix_trees.dedup_words, "word", 20, 5)])
@pytest.mark.parametrize("small", [False, True])
def test_repeats_equal_brute_force(spark, monkeypatch, op, unit, window, k, small):
    if small:  # blocks of few bytes: the segments of most anchors are dealt out again
        monkeypatch.setattr(repeats, "BLOCK_BYTES", 600)
    texts = corpus(2 if small else 3)
    got = {x[0]: tuple(x[1:]) for x in op(frame(spark, texts)).collect()}
    assert got == brute.repeats(list(enumerate(texts)), unit, window)


def test_common_prefixes_are_counted():
    r = random.Random(4)
    for _ in range(100):
        x = bytes(r.choice(b"ab") for _ in range(r.randint(1, 200))) + b"\xff"
        depth = r.choice([3, 8, 20, 100])
        order, eight = suffix_array.suffix_array(np.frombuffer(x, np.uint8), depth)
        got = suffix_array.common_prefixes(order, eight, depth)
        for i in range(1, len(order)):
            a, b = x[order[i - 1] :], x[order[i] :]
            assert got[i] == min(depth, next((k for k, (u, v) in enumerate(zip(a, b)) if u != v), min(len(a), len(b))))


@pytest.mark.parametrize("unit,window,k", [("byte", 12, 5), ("word", 6, 2)])
def test_dealt_segments_hold_every_window_by_longer_runs(unit, window, k):
    words = [b"w%d" % (i * i % 7) for i in range(40)]
    seg = bytes(range(60, 100)) if unit == "byte" else b" ".join(words)
    units = list(seg) if unit == "byte" else words
    o = 15
    first, last = max(0, o + k - window), min(o, len(units) - window)
    part = units[first : last + window]
    row = (3, bytes(part) if unit == "byte" else b" ".join(part), 1, 2, first, last - first + 1, o - first)
    core, rows = k, [row]
    while core < window:
        more = -(-(window - core) // 2)
        out = next(repeats._redeal(unit, window, core, more)(iter([pd.DataFrame(rows, columns=repeats.SEGMENT_COLUMNS)])))
        rows, core = list(out.itertuples(index=False, name=None)), core + more
        assert {x for _, _, _, _, lo, n, _ in rows for x in range(lo, lo + n)} == set(range(first, last + 1))
        for _, cut, _, _, lo, n, at in rows:
            got = list(cut) if unit == "byte" else cut.split(b" ")
            assert got == units[lo : lo + n - 1 + window] and all(lo + j <= lo + at and lo + at + core <= lo + j + window for j in range(n))


def test_repeats_of_odd_rows(spark):
    long = "abc def " * 50
    df = frame(spark, [long, long, long, None], [5, 5, 5, 5]).unionByName(frame(spark, [long], [None]))
    rows = sorted((x.doc_id or -1, x.n_removed) for x in suffix_array.dedup_substrings(df).collect())
    assert [n for _, n in rows].count(400) == 3 and len(rows) == 5
    assert suffix_array.dedup_substrings(frame(spark, [])).count() == 0
    assert suffix_trees.dedup_words(frame(spark, [])).count() == 0
    kept = suffix_trees.dedup_words(frame(spark, ["w" * 3 + " x"]), with_text=True).first()
    assert kept.kept_text == "www x"
