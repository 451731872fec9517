import random

import numpy as np

from keyloom.llm import common, components, flat, minhash

from . import brute
from .test_native import EDGE, frame


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(r.randint(3, 200))]
        for _ in range(r.randint(1, 6)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 30))):
                t[r.randrange(len(t))] = word()
            texts.append(" ".join(t))
    return texts


def test_signatures_estimate_weighted_similarity():
    r = random.Random(0)
    a = [r.randrange(10**9) for _ in range(300)]
    b = a[:240] + [r.randrange(10**9) for _ in range(60)] + a[:30]
    doc, cell = minhash.as_multiset(np.repeat([0, 1], [len(a), len(b)]), flat.mix(np.array(a + b, np.uint64)))
    sig = minhash.dart_signatures(doc, cell, 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - 240 / (300 + 330 - 240)) < 0.04
    half = minhash.dart_signatures(np.array([0, 1]), flat.mix(np.array([5, 5], np.uint64)), 2, 4000, share=np.array([1.0, 0.5]))
    assert abs((half[0] == half[1]).mean() - 0.5) < 0.04


def test_rounds_of_components_have_small_plans(spark, monkeypatch):
    # The driver has a thread for each shuffle of a plan at once: a star reads the edges a few times, not each of them anew for the star after it.
    reads, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: reads.append(str(df._jdf.queryExecution().analyzed()).count("Relation [")) or write(df, name))
    components.components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long"))
    assert len(reads) > 4 and 0 < max(reads) <= 6


def test_a_grown_heap_of_the_driver_is_given_back(spark, monkeypatch):
    full = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Young" not in b.getName() and "Concurrent" not in b.getName())
    before = full()
    monkeypatch.setattr(common, "HEAP", 2.0)
    common.materialize(spark.range(3), "small")
    assert full() == before
    monkeypatch.setattr(common, "HEAP", 0.0)
    common.materialize(spark.range(3), "grown")
    assert full() > before


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200)]
    got = {x.node: x.label for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute.classes(edges, {x for e in edges if e[0] != e[1] for x in e})
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_equal_brute_force(spark):
    texts = corpus(1) + [corpus(1)[0]] * 3 + ["one", "one", "ONE", "two words"]
    got = {x.doc_id: x.class_id for x in minhash.near_classes(frame(spark, texts)).collect()}
    assert got == brute.near(list(enumerate(texts)))


def test_shared_passages_lose_no_link(spark):
    r = random.Random(9)
    shared = " ".join(str(r.random()) for _ in range(60))
    texts = [shared + " " + " ".join(str(r.random()) for _ in range(r.choice([3, 25, 60]))) for _ in range(60)] + corpus(2)
    got = {x.doc_id: x.class_id for x in minhash.near_classes(frame(spark, texts)).collect()}
    assert got == brute.near(list(enumerate(texts)))


def test_prefixes_lose_no_pair(spark):
    r = random.Random(4)
    sets = []
    for _ in range(12):
        base = [r.randrange(2**32) for _ in range(r.choice([1, 4, 30, 90]))]
        for _ in range(10):
            kept = [x for x in base if r.random() > r.choice([0, 0.05, 0.2])] or base
            sets.append(sorted(set(kept + [r.randrange(2**32) for _ in range(r.choice([0, 1, len(base) // 8]))])))
    frame_of = spark.createDataFrame([(i, bytearray(np.array(x, np.uint32).tobytes())) for i, x in enumerate(sets)], "c long, cells binary")
    named = spark.createDataFrame([(i, i) for i in range(len(sets))], "c long, label long")
    got = {(x.a, x.b) for x in minhash.prefix_pairs(named, frame_of, 0.8).collect()}
    near = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})}
    assert near and near <= got and len(got) < 3 * len(near)


def test_odd_rows(spark):
    rows = minhash.near_classes(frame(spark, EDGE)).collect()
    assert len(rows) == len(EDGE) and len({x.class_id for x in rows}) == len(EDGE)
    same = frame(spark, ["a b c d e f"] * 3, [4, 4, None])
    assert {x.class_id for x in minhash.near_classes(same).collect()} == {None}
    assert minhash.keep_one(same).count() == 1
    assert minhash.keep_one(frame(spark, ["a b c d e f"] * 3 + [None, ""], [4, 4, 5, 6, 7])).columns == same.columns
    assert minhash.keep_one(frame(spark, [])).count() == 0


def test_members_of_a_mixed_bucket_need_no_second_band(spark, monkeypatch):
    # All texts in one bucket, the least and the next one like no other: every similar pair is joined.
    texts = corpus(5)
    monkeypatch.setattr(minhash, "_bands", lambda batches: (b.assign(k=1)[["k", "c"]] for b in batches))
    got = {x.doc_id: x.class_id for x in minhash.near_classes(frame(spark, texts)).collect()}
    assert got == brute.near(list(enumerate(texts)))


def test_links_found_are_evidence_of_the_class(spark):
    texts = corpus(6) + ["one", "one"]
    rows = minhash.near_classes(frame(spark, texts)).collect()
    assert rows[0].__fields__ == ["doc_id", "class_id", "class_size", "links_found"]
    kinds = {}
    for x in rows:
        kinds.setdefault(x.class_id, set()).add(texts[x.doc_id])
    assert all((x.links_found > 0) == (len(kinds[x.class_id]) > 1) for x in rows)
    near = {x.doc_id: sum(brute.near([(0, texts[x.doc_id]), (1, t)])[1] == 0 for t in {*texts} - {texts[x.doc_id]}) for x in rows[:40]}
    assert all(x.links_found <= near[x.doc_id] for x in rows[:40])
