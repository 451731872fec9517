import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keyloom.llm import decontaminate, flat, line_dedup, packing

from .test_native import EDGE, frame

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        up, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            up, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, up + (x != y))
    return row[-1]


def brute_lines(texts):
    """Removed lines by (text, line): every pair of lines compared."""
    lines = []
    for d, t in enumerate(texts):
        for n, x in enumerate((t or "").split("\n")):
            w = x.lower().encode().translate(line_dedup.PLAIN).decode().split()
            if sum(len(y.encode()) for y in w) >= line_dedup.MIN_CHARS:
                lines.append((d, n, " ".join(w)))
    up = list(range(len(lines)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            a, b = lines[i][2], lines[j][2]
            if abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and top(i) != top(j) and edit(a, b) <= int(0.2 * max(len(a), len(b))):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return {lines[i][:2] for i in range(len(lines)) if top(i) != i}


def line_corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    pool = [" ".join(word() for _ in range(r.randint(25, 40))) for _ in range(12)]

    def variant(x):
        w = x.split()
        if r.random() < 0.5:
            return x.upper().replace(" ", r.choice([", ", "  "]), 3)
        return x if r.random() < 0.5 else " ".join(w[:-1] + [w[-1][:1]])

    return ["\n".join(r.choice([variant(r.choice(pool)), word(), ""]) for _ in range(r.randint(0, 6))) for _ in range(45)]


def test_lines_equal_brute_force_on_close_copies(spark):
    texts = line_corpus(1) + EDGE
    gone = brute_lines(texts)
    rows = {x.doc_id: x for x in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    wrong = 0
    for d, t in enumerate(texts):
        want = "\n".join(x for n, x in enumerate((t or "").split("\n")) if (d, n) not in gone)
        wrong += rows[d].text != want
        assert rows[d].n_lines - rows[d].n_removed == (len(rows[d].text.split("\n")) if rows[d].n_removed < rows[d].n_lines else 0)
    assert wrong <= 1 and len(gone) > 20  # blocks find close copies for certain, others as often as not


def test_normalised_copies_are_always_found(spark):
    line = "The Quick brown fox, 17 of them, jumps over the lazy dog"
    docs = frame(spark, [f"head\n{line}", f"{line.upper().replace('17', '42')}!\ntail", "other words entirely in this line here\n" + line.replace(",", " ;")])
    rows = {x.doc_id: x.text for x in line_dedup.dedup_lines(docs).collect()}
    assert rows == {0: f"head\n{line}", 1: "tail", 2: "other words entirely in this line here"}
    out = line_dedup.with_lines_deduped(docs)
    assert out.columns == docs.columns and {x.n_chars for x in out.collect()} == {len(t) for t in rows.values()}
    assert line_dedup.with_lines_deduped(frame(spark, [])).count() == 0


def test_tiles_are_the_longest_first_and_do_not_overlap():
    w = lambda s: flat.mix(np.array([ord(c) for c in s], np.uint64))
    assert sorted(decontaminate.tiles(w("xxabcdefghyyklmnop"), w("klmnopabcdefgh"), 5)) == [(2, 6, 8), (12, 0, 6)]
    assert decontaminate.tiles(w("abcdeabcde"), w("abcde"), 5) == [(0, 0, 5)]
    assert decontaminate.tiles(w("abcd"), w("abcd"), 5) == []
    r = random.Random(3)
    for _ in range(50):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 40))) for _ in range(2))
        got = decontaminate.tiles(w(a), w(b), 3)
        assert all(a[i : i + n] == b[j : j + n] and n >= 3 for i, j, n in got)
        for k, size in ((0, len(a)), (1, len(b))):
            assert sum(x[2] for x in got) == len({p for x in got for p in range(x[k], x[k] + x[2])})
        free_a, free_b = list(a), list(b)
        for i, j, n in got:
            free_a[i : i + n], free_b[j : j + n] = "x" * n, "y" * n
        assert not {"".join(free_a[i : i + 3]) for i in range(len(a) - 2)} & {"".join(free_b[i : i + 3]) for i in range(len(b) - 2)}


def brute_tiles(a, b, match):
    """Every pair of places, again and again: the longest common run of free words, at the earliest place in b, then in a."""
    used_a, used_b, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < match:
            return out
        used_a[i : i + n] = used_b[j : j + n] = [True] * n
        out.append((i, j, n))


def test_tiles_equal_brute_force():
    r = random.Random(12)
    w = lambda s: flat.mix(np.array([ord(c) for c in s], np.uint64))
    for _ in range(150):
        letters = r.choice(["a", "ab", "abcd"])
        a, b = ("".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(2))
        match = r.choice([1, 2, 4])
        assert decontaminate.tiles(w(a), w(b), match) == brute_tiles(a, b, match), (a, b, match)
    same = w("a" * 3000)
    assert decontaminate.tiles(same, same[:2000], 5) == [(0, 0, 2000)]


@pytest.mark.parametrize("seeds", [2_000_000, 0])
def test_rows_alike_are_reported_each(spark, seeds):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "other"), (None, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, text), (7, text), (None, text)], "item_id long, text string")
    got = sorted(((x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs, bench, seeds=seeds).collect()), key=str)
    assert got == sorted([(d, i) for d in (1, 1, None) for i in (7, 7, None)], key=str)


@pytest.mark.parametrize("seeds", [2_000_000, 0])
def test_reordered_and_recased_passages_are_found(spark, seeds):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(30)] for _ in range(6)] + [["few", "words"], []]
    say = lambda n: " ".join(word() for _ in range(n))
    texts = [say(50), say(20) + " " + " ".join(items[0]).upper() + "! " + say(9), " ".join(items[1][15:]) + " " + say(30) + " " + ", ".join(items[1][:15]), " ".join(items[2][:8]) + say(40), "few words", *EDGE]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(9, None)], "item_id long, text string")
    docs = frame(spark, texts)
    got = sorted((x.doc_id, x.item_id, x.coverage) for x in decontaminate.find_leaks(docs, bench, seeds=seeds).collect())
    assert got == [(1, 0, 1.0), (2, 1, 1.0)]
    clean = decontaminate.keep_clean(docs, bench, seeds=seeds)
    assert {x.doc_id for x in clean.collect()} == set(range(len(texts))) - {1, 2} and clean.columns == docs.columns
    assert decontaminate.find_leaks(docs, bench.limit(0), seeds=seeds).count() == 0
    assert decontaminate.find_leaks(frame(spark, []), bench, seeds=seeds).count() == 0


def test_ids_are_those_of_whole_texts():
    texts = ["Hello  world's\n\nÉté <|endoftext|> x", "", " \t a b c ́ d", "ΑΣ ΣΑΣ. ﬁ Ⅳ 12", "'ll 's 't", *[t for t in EDGE if t]]
    tok = Tokenizer.from_file(TOKENIZER)
    for t, b in zip(texts, packing.token_bytes(texts, TOKENIZER)):
        assert np.frombuffer(b, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids + [packing.END_ID], t


def test_ids_of_letters_with_marks_are_those_of_whole_texts(monkeypatch):
    # Letters that are normalised to a letter and a sign: the marks after them belong to the sign.
    texts = ["aİ.", "क़!", "שׁ; x", "Word*** word.\" WORD?! it's. 's.", "é&&& É, ǅ: \u0301. a\u0301.", "x_1. ** (a) [b]"]
    tok = Tokenizer.from_file(TOKENIZER)
    ids = lambda t: tok.encode(t, add_special_tokens=False).ids + [packing.END_ID]
    monkeypatch.setattr(packing, "KNOWN", 8)  # some are kept, some come back, some are taken anew
    for t in [*texts, *texts[::-1], *[f"{a} {b}" for a, b in zip(texts, texts[1:])], *texts]:
        assert np.frombuffer(packing.token_bytes([t], TOKENIZER)[0], "<u4").tolist() == ids(t), t


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece_near_the_bound(seed):
    r = random.Random(seed)
    h = Counter(min(4096, 1 + int(r.expovariate(1 / 600))) for _ in range(r.choice([1, 30, 3000])))
    h[4096] += 2
    many = r.choice([1, 50])
    h = {n: c * many for n, c in h.items()}
    got = packing.plan(h)
    assert Counter(n for contents, m in got for n in contents * m) == Counter(h)
    assert all(sum(c) <= 4096 for c, _ in got)
    bound = -(-sum(n * c for n, c in h.items()) // 4096)
    assert sum(m for _, m in got) <= bound * 1.02 + 2


def test_packing_is_gapless_and_whole(spark):
    r = random.Random(7)
    texts = [" ".join("word" * r.randint(1, 3) for _ in range(int(r.expovariate(1 / 300)))) for _ in range(150)] + ["long " * 9000, *EDGE]
    rows = packing.pack(frame(spark, texts), TOKENIZER).collect()
    sizes = [len(b) // 4 for b in packing.token_bytes(texts, TOKENIZER)]
    by = {}
    for x in rows:
        by.setdefault(x.doc_id, []).append(x)
    for d, n in enumerate(sizes):
        ps = sorted(by[d], key=lambda x: x.piece)
        assert [x.start for x in ps] == [4096 * k for k in range(len(ps))] and sum(x.length for x in ps) == n
    seqs = {}
    for x in rows:
        seqs.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for v in seqs.values():
        end = 0
        for o, n in sorted(v):
            assert o == end
            end += n
        assert end <= 4096
    assert len(seqs) <= -(-sum(sizes) // 4096) * 1.05 + 2
    assert packing.pack(frame(spark, []), TOKENIZER).count() == 0
