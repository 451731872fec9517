import datetime as dt
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keyloom.operators import changes, lookups
from keyloom.operators.cursors import Cursor
from keyloom.operators.results import BookmarkError, Query, ResultError
from keyloom.operators.stats import Stats
from keyloom.plans.conditions import PreparedSet, where
from keyloom.sources.catalog import Catalog, ConflictError, ContractError, IndexSet


def entries(spark, rows, kind):
    return spark.createDataFrame(rows, f"identity long, key {kind}")


def ids(s, c, **o):
    return sorted(r.identity for r in Query(s, c, **o).identities().collect())


def test_folds_keep_null_and_long_keys(spark):
    big = 9007199254740993
    s = IndexSet().add("k", entries(spark, [(1, None), (2, None), (3, 7), (4, big), (5, big - 1)], "long"))
    g = Query(s, where("k").all()).group_by("k")
    want = {(None, "12"), (7, "3"), (big, "4"), (big - 1, "5")}
    assert {tuple(r) for r in g.fold_with("", lambda a, i: a + str(i), "string").collect()} == want
    assert {tuple(r) for r in g.fold_column(F.lit(""), lambda a, i: F.concat(a, i.cast("string"))).collect()} == want
    f = IndexSet().add("f", entries(spark, [(1, float("nan")), (2, 1.5), (3, float("nan")), (4, None)], "double"))
    got = Query(f, where("f").all()).group_by("f").fold_with(0, lambda a, i: a + i, "long").collect()
    assert sorted((repr(r.key), r.value) for r in got) == [("1.5", 2), ("None", 4), ("nan", 4)]


def test_malformed_slices_are_null(spark):
    rows = [(1, b"ab\x80d"), (2, b"abcd"), (3, "a\U0001f600".encode("utf-16-le")), (4, b"\x00\xd8a\x00"), (5, b"a\x00\x00\x00"), (6, b"\x00\xd8\x00\x00")]
    s = IndexSet().add("b", entries(spark, rows, "binary"))
    assert ids(s, where("b").binary_typed_slice_starts_with(0, "ascii", "ab", length=4)) == [2]
    assert ids(s, where("b").binary_typed_slice_starts_with(0, "utf16", "a", length=6)) == [3]
    assert ids(s, where("b").binary_typed_slice_equal_to(0, "utf32", "a", length=4)) == [5]
    assert 4 not in ids(s, where("b").binary_typed_slice_contains(0, "utf16", "a", length=4)) and ids(s, where("b").binary_typed_slice_starts_with(0, "latin1", "ab", length=4)) == [1, 2]


def test_wide_numbers_dates_and_characters_in_slices(spark):
    day = dt.date(2024, 2, 29)
    ticks = (dt.datetime(2024, 2, 29, 12) - dt.datetime(1, 1, 1)) // dt.timedelta(microseconds=1) * 10
    decimal = (12345).to_bytes(12, "little") + struct.pack("<I", 2 << 16 | 1 << 31)
    rows = [(1, (-5).to_bytes(16, "little", signed=True)), (2, (1 << 90).to_bytes(16, "little")), (3, decimal), (4, struct.pack("<q", ticks | 1 << 62)), (5, struct.pack("<i", day.toordinal() - 1)), (6, b"\xff" * 16), (7, "é".encode("utf-16-le")), (8, struct.pack("<I", 0x1F600))]
    s = IndexSet().add("b", entries(spark, rows, "binary"))
    typed = lambda kind, what, *v, **o: ids(s, getattr(where("b"), f"binary_typed_slice_{kind}")(0, what, *v, **o))
    assert typed("equal_to", "int128", -5) == [1] and typed("equal_to", "int128", -1) == [6] and typed("equal_to", "uint128", 1 << 90) == [2]
    assert typed("equal_to", "bigint", -5, length=16) == [1] and typed("equal_to", "decimal", Decimal("-123.45")) == [3]
    assert typed("equal_to", "datetime", dt.datetime(2024, 2, 29, 12)) == [4] and 5 in typed("equal_to", "date", day)
    assert typed("equal_to", "char", "é") == [7] and typed("equal_to", "rune", "\U0001f600") == [8]
    assert typed("equal_to", "timespan", ticks // 10 + (1 << 62) // 10) == [4]


def test_composite_keys_are_unique_as_a_whole(spark):
    rows = spark.createDataFrame([(10, 1, "a"), (11, 1, "b")], "identity long, p long, q string")
    c = Catalog(spark)
    i = c.create("pq", rows, unique=True, parts=("p", "q"))
    more = lambda *x: spark.createDataFrame([x], rows.schema)
    assert changes.inserted(i, more(12, 2, "a")).count() == 3
    for broken in (lambda: changes.inserted(i, more(12, 1, "a")), lambda: c.publish({"pq": rows.unionByName(more(12, 1, "a"))})):
        with pytest.raises(ContractError):
            broken()
    assert c.shape("pq")["parts"] == ["p", "q"] and c.shape("pq")["types"]["q"] == "string" and c.count("pq") == 2


def test_repeated_identities_take_the_set_plan(spark):
    t = spark.createDataFrame([(1, 5), (1, 25), (2, 15)], "id long, k int")
    assert ids(IndexSet.from_table(t, "id"), (where("k") > 20) & (where("k") < 10)) == [1]
    assert IndexSet.from_table(t.where("k > 5"), "id")["k"].wide and not IndexSet.from_table(t, "id")["k"].wide


def test_of_two_writers_one_fails(spark, tmp_path):
    for c, other in ((Catalog(spark, f"{tmp_path}/c"),) * 2, (Catalog(spark),) * 2):
        c.create("a", entries(spark, [(1, 1)], "int"))
        with pytest.raises(ConflictError):
            with c.batch() as b:
                b.put("a", changes.inserted(b.open("a"), entries(spark, [(2, 2)], "int")))
                other.publish({"a": entries(spark, [(3, 3)], "int")})
        assert [r.identity for r in c.open("a").entries().collect()] == [3]
        with c.batch() as b:
            b.put("a", changes.inserted(b.open("a"), entries(spark, [(4, 4)], "int")))
            assert b.open("a").entries().count() == 2 and c.open("a").entries().count() == 1
        dropped = c.batch()
        dropped.put("a", entries(spark, [], "int"))
        dropped.abort()
        assert c.open("a").entries().count() == 2
        with pytest.raises(ContractError):
            dropped.commit()


def test_bookmarks_end_with_their_index(spark):
    c = Catalog(spark)
    c.create("n", entries(spark, [(i, i % 5 or None) for i in range(12)], "int"), single_key=True)
    for descending in (False, True):
        q, seen, mark = Query(c.index_set(), where("n").all()), [], None
        while True:
            rows, mark = q.page("n", 5, mark, descending)
            if not rows:
                break
            seen += [r.identity for r in rows]
            last = mark
        want = sorted(range(12), key=lambda i: (i % 5, i), reverse=descending)
        assert seen == want
    with pytest.raises(BookmarkError):
        q.page("n", 5, last)
    c.publish({"n": entries(spark, [(1, 1)], "int")})
    with pytest.raises(BookmarkError):
        Query(c.index_set(), where("n").all()).page("n", 5, last, True)


def test_results_need_one_key(spark):
    s = IndexSet().add("k", entries(spark, [(1, 5), (1, 25), (2, 15)], "int")).add("x", entries(spark, [(1, "a"), (2, "b"), (3, "c")], "string"))
    q = Query(s, where("x").all())
    for run in (lambda: q.ordered("k"), lambda: q.returning("k", strict=True)):
        with pytest.raises(ResultError):
            run()
    with pytest.raises(Exception, match="not one key of k"):
        q.returning("k").collect()
    assert sorted(map(tuple, Query(s, where("x") == "b").returning("k", "x").collect())) == [(2, 15, "b")]
    assert len(q.returning("k", strict=False).collect()) == 3
    for run in (lambda: q.ordered("x", top=0), lambda: q.ordered("x", bottom=0), lambda: q.identities(skip=-1)):
        with pytest.raises(ValueError):
            run()


def test_cursors_change_what_they_passed(spark):
    s = IndexSet().add("k", entries(spark, [(i, i * 10 if i else None) for i in range(6)], "int"))
    c = Cursor(Query(s, where("identity" if False else "k").all()), "k")
    assert c.next().identity == 0 and c.skip(1) == 1
    c.delete_current()
    assert [r.identity for r in c.pull(2)] == [2, 3] and c.ordinal == 3 and c.bookmark.key == 30
    c.set_key(-1)
    assert sorted(((r.identity, r.key) for r in c.changed().collect()), key=str) == sorted([(0, None), (2, 20), (3, -1), (4, 40), (5, 50)], key=str)
    c.delete_remaining()
    assert sorted(r.identity for r in c.changed().collect()) == [0, 2, 3]
    down = Cursor(Query(s, where("k").all()), "k", descending=True)
    assert down.next().identity == 5
    down.delete_remaining()
    assert [r.identity for r in down.changed().collect()] == [5]
    with pytest.raises(LookupError):
        Cursor(Query(s, where("k").all()), "k").delete_current()


def test_inverse_tables_and_prepared_sets(spark, tmp_path):
    s = IndexSet().add("a", entries(spark, [(1, 5), (1, 3), (2, 7)], "int")).add("b", entries(spark, [(1, "x"), (3, "y")], "string"))
    i = lookups.Inverse(s, ["a"], f"{tmp_path}/inv")
    assert {r.identity: r.a for r in i.read().collect()} == {1: [3, 5], 2: [7], 3: None} and i.validate()
    i.include("b")
    assert i.keys_of(1).first().b == ["x"]
    s.add("a", entries(spark, [(9, 9)], "int"))
    assert not i.validate()
    i.drop()
    assert i.keys_of(9).first().a == [9]
    p = PreparedSet(spark.createDataFrame([(5,), (5,), (None,)], "k int"), cached=True)
    t = IndexSet().add("a", entries(spark, [(1, 5), (2, 7), (3, None), (3, 7)], "int"))
    assert p.count() == 2 and ids(t, where("a").in_set(p)) == [1, 3] and ids(t, where("a").not_in_set(p)) == [2]
    p.release()
    seen = spark.sparkContext.accumulator(0)
    lookups.visit(t["a"], lambda r: seen.add(r.identity))
    assert seen.value == 9


def test_one_index_plan_equals_the_set_plan(spark):
    e = entries(spark, [(i % 7, i * 5 % 11 if i % 4 else None) for i in range(30)], "int")
    many, k = IndexSet().add("k", e).add("other", e), where("k")
    for c in [(k > 3) & (k < 3), (k > 9) & ~(k == 2), k.not_in_set([1, None]) | (k == 4), (k > 5).except_(k == 0), k.exists_all([0, 5]) & (k < 9), ~k.is_null()]:
        by_rows = {}
        for r in e.collect():
            by_rows.setdefault(r.identity, []).append(r.key)
        both = Query(many, c & where("other").all()).identities()  # two indexes: joins of sets
        assert ids(many, c) == sorted(r.identity for r in both.collect())
    assert "Join" not in Query(many, (k > 3) & (k < 3)).explain()


def test_stats_count_since_a_mark(spark):
    s, stats = IndexSet().add("k", entries(spark, [(1, 5), (2, 7)], "int")), Stats()
    stats.run(Query(s, where("k") > 1))
    mark = stats.mark()
    stats.run(Query(s, (where("k") > 6) | (where("k") == 5)))
    got = stats.since(mark)
    assert (got["queries"], got["rows"], got["operator:EqualTo"], got["answered:entries"]) == (1, 2, 1, 2) and stats.totals["queries"] == 2
