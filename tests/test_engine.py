import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from keyloom.functions import patterns
from keyloom.operators import changes, lookups
from keyloom.operators.results import Query, ResultError
from keyloom.plans import conditions as C
from keyloom.plans.conditions import Parameter, where
from keyloom.sources.catalog import Catalog, ContractError, Index, IndexSet
from keyloom.sources.files import crawl
from keyloom.streaming.filters import matching


def entries(spark, rows, kind):
    return spark.createDataFrame(rows, f"identity long, key {kind}")


def ids(s, c, **o):
    return sorted(r.identity for r in Query(s, c, **o).identities().collect())


@pytest.fixture(scope="module")
def people(spark):
    s = IndexSet()
    s.add("age", entries(spark, [(1, 20), (2, 17), (3, 30), (4, 40)], "int"))
    s.add("status", entries(spark, [(1, 1), (2, 2), (3, 1), (4, 0)], "int"))
    return s


def test_composition(people):
    assert ids(people, where("age").greater_or_equal(18).and_("status").equal_to(1)) == [1, 3]
    assert ids(people, (where("age") < 18) | (where("status") == 0)) == [2, 4]
    assert ids(people, ~((where("age") >= 18) & (where("status") == 1))) == [2, 4]
    assert ids(people, where("age").not_.greater_than(20)) == [1, 2]
    assert not Query(people, where("age") > 99).exists() and Query(people, where("age") > 39).exists()
    p = Parameter(30)
    assert ids(people, where("age").equal_to(p)) == [3]
    p.value = 40
    assert ids(people, where("age").equal_to(p)) == [4] == ids(people, where("age").equal_to(lambda: 40))
    with pytest.raises(ValueError):
        where("age").not_.is_nan()
    with pytest.raises(KeyError):
        ids(people, where("none").equal_to(1))
    with pytest.raises(ValueError):
        ids(people, ~C.ExternalTest(lambda i: i > 1))
    assert ids(people, where("none").exists.equal_to(1) & where("age").all()) == []


def test_several_keys_for_one_identity(spark):
    s = IndexSet().add("k", entries(spark, [(1, 5), (1, 25), (2, 15), (3, 10), (3, None)], "int"))
    assert ids(s, (where("k") >= 10) & (where("k") <= 20)) == [1, 2, 3]  # 25 meets one side and 5 the other
    assert ids(s, (where("k") >= 20) & (where("k") <= 10)) == [1]  # each side by another key
    assert ids(s, where("k").between(10, 20)) == [2, 3]
    assert ids(s, where("k").not_equal_to(5)) == [1, 2, 3] and ids(s, where("k").not_in_set([5])) == [2, 3]
    assert ids(s, where("k").in_set([None, 15])) == [2, 3] and ids(s, where("k").not_in_set([None])) == [1, 2]
    assert ids(s, where("k").exists_all([5, 25])) == [1] and ids(s, where("k").exists_all([])) == [1, 2, 3]
    assert ids(s, where("k").exists_all([10, None])) == [3]
    assert ids(s, where("k").is_null()) == [3] == ids(s, where("k").equal_to(None))
    assert Query(s, where("k") > 0).count().first().n == 3 and Query(s, where("k") > 0).identities(preserve=True).count() == 4
    with pytest.raises(ResultError):
        Query(s, where("k") > 0).returning("k", strict=True)
    assert [tuple(r) for r in s["k"].ordered().collect()][:2] == [(3, None), (1, 5)]


def test_text_states(spark):
    rows = list(enumerate([None, "", "a", "B", "\u00e9", "e\u0301", "a*b", "a?b", "a\\b", "x\ny", "m"]))
    s = IndexSet().add("t", entries(spark, rows, "string"))
    assert ids(s, where("t").is_null()) == [0] and ids(s, where("t").is_empty()) == [1] and ids(s, where("t").is_null_or_empty()) == [0, 1]
    assert ids(s, where("t").not_starts_with("a")) == [1, 3, 4, 5, 9, 10]
    assert ids(s, where("t").less_than("a")) == [1, 3]
    assert ids(s, where("t").like("a\\*b")) == [6] and ids(s, where("t").like("a?b")) == [6, 7, 8] and ids(s, where("t").like("x?y")) == [9]
    assert ids(s, where("t").like("a*")) == [2, 6, 7, 8] and ids(s, where("t").like("?")) == [2, 3, 4, 10] and ids(s, where("t").like("a\\b")) == [8]
    assert ids(s, where("t").text_equals("é", policy="normalized")) == [4, 5] and ids(s, where("t").text_equals("b")) == [3]
    assert ids(s, where("t").contains("", policy="ordinal")) == list(range(1, 11))
    assert patterns.literal_head("^abc*d") == "ab" and patterns.literal_head("^a|b") == ""


def test_floats(spark):
    rows = list(enumerate([float("nan"), float("-inf"), -0.0, 0.0, 1.5, float("inf"), -2.5, 2.5, None]))
    s = IndexSet().add("f", entries(spark, rows, "double"))
    assert ids(s, where("f") > 1.0) == [4, 5, 7] and ids(s, where("f").equal_to(float("nan"))) == [0] and ids(s, where("f") == 0.0) == [2, 3]
    assert ids(s, where("f").not_equal_to(1.5)) == [1, 2, 3, 5, 6, 7] and ids(s, where("f").between(-1.0, float("inf"))) == [2, 3, 4, 5, 7]
    assert ids(s, where("f").is_nan()) == [0] and ids(s, where("f").is_infinity()) == [1, 5] and ids(s, where("f").is_finite()) == [2, 3, 4, 6, 7]
    f = lambda how, v, op="EqualTo": ids(s, where("f").transformed(how, 0, op, v))
    assert f("floor", -3) == [6] and f("ceiling", -2) == [6] and f("truncate", 2) == [7] and f("round_to_even", 2) == [4, 7] and f("round_away", 3) == [7]
    assert 0 in f("round_away", 1.0, "NotEqualTo") and f("truncate", 1.0, "GreaterThan") == [5, 7]
    assert [r.identity for r in s["f"].ordered().collect()][:3] == [8, 0, 1]


def test_typed_slices(spark):
    rows = [(1, struct.pack("<hIq", -5, 7, -(2**60))), (2, struct.pack("<hIq", 300, 2**31, 9)), (3, b"\x01"), (4, struct.pack("<d", 2.5) + b"\xc3\xa9!\xff\xff\xff")]
    s = IndexSet().add("b", entries(spark, rows, "binary"))
    assert ids(s, where("b").binary_typed_slice_less_than(0, "int16", 0)) == [1] and ids(s, where("b").binary_typed_slice_equal_to(2, "uint32", 2**31)) == [2]
    assert ids(s, where("b").binary_typed_slice_equal_to(6, "int64", -(2**60))) == [1] and ids(s, where("b").binary_typed_slice_equal_to(0, "double", 2.5)) == [4]
    assert ids(s, where("b").binary_typed_slice_starts_with(8, "utf8", "é", length=3)) == [4] and ids(s, where("b").binary_typed_slice_contains(8, "utf8", "é", length=5)) == []
    assert ids(s, where("b").binary_slice_equal(0, b"\x01")) == [3]
    flipped = IndexSet().add("b", entries(spark, [(1, struct.pack(">I", 2**31 - 5)), (2, struct.pack(">I", 2**31 + 5))], "binary"))
    assert ids(flipped, where("b").binary_typed_slice_equal_to(0, "int32", -5, canonical=True)) == [1]


def test_plans_agree(spark):
    t = spark.createDataFrame([(i, i % 7 if i % 5 else None, chr(97 + i % 4) if i % 6 else "") for i in range(60)], "id long, a int, b string")
    wide = IndexSet.from_table(t, "id")
    narrow = IndexSet()
    for c in ("a", "b"):
        narrow.add(c, t.select(F.col("id").alias("identity"), F.col(c).alias("key")))
    a, b = where("a"), where("b")
    for c in [(a > 3) & ~b.starts_with("a"), ~(a == 2), ~(a.is_null() | (b != "c")), a.not_in_set([1, None]) & b.is_not_empty(), (a <= 2).except_(b.in_set(["a"])), (a.not_between(1, 3) | b.not_matches_pattern("c*")) & (a != 5)]:
        assert ids(wide, c) == ids(narrow, c) == ids(wide, c, plan="set")
    plan = Query(wide, (a > 3) & (b == "a")).explain()
    assert "Exchange" not in plan and "Join" not in plan
    assert ("a", "GreaterThan", "column") in Query(wide, a > 3).classify()


def test_calendar(spark):
    days = [dt.datetime(2024, 2, 29, 4), dt.datetime(2024, 3, 31, 5), dt.datetime(2024, 4, 1, 11), dt.datetime(2024, 6, 30, 12), dt.datetime(2024, 7, 1, 16), dt.datetime(2024, 12, 31, 17), dt.datetime(2025, 1, 1, 22), dt.datetime(2024, 3, 30, 21)]
    s = IndexSet().add("t", entries(spark, list(enumerate(days)), "timestamp_ntz"))
    t = where("t")
    assert ids(s, t.is_quarter_end()) == [1, 3, 5] and ids(s, t.is_half_year_start()) == [4, 6] and ids(s, t.is_last_of_month()) == [0, 1, 3, 5]
    assert ids(s, t.is_night()) == [0, 6] and ids(s, t.is_morning()) == [1, 2] and ids(s, t.is_afternoon()) == [3, 4] and ids(s, t.is_evening()) == [5, 7] and ids(s, t.is_weekend()) == [1, 3, 7]
    now = dt.datetime(2025, 1, 1, 0, 30)
    assert ids(s, t.is_today(now=now)) == [6] and ids(s, t.is_yesterday(now=now)) == [5] and ids(s, t.is_in_last_hours(8, now=now)) == [5, 6]


def test_pages_and_groups(spark):
    s = IndexSet().add("name", entries(spark, [(2001, "Smith"), (2002, "Stone"), (2003, "Swan"), (9, None)], "string"))
    q = Query(s, where("name").starts_with("S"))
    first, mark = q.page("name", 1)
    rest, _ = q.page("name", 9, mark)
    assert [r.identity for r in first] == [2001] and [r.identity for r in rest] == [2002, 2003]
    null_first, mark = Query(s, where("name").all()).page("name", 1)
    assert null_first[0].identity == 9 and len(Query(s, where("name").all()).page("name", 9, mark)[0]) == 3
    d = IndexSet().add("dev", entries(spark, list(enumerate(["Device-A", "device-a", "Device-B", "Device-B", "Device-C", "Device-C"], 1)), "string"))
    d.add("time", entries(spark, list(enumerate([100, 200, 900, 120, 300, 300], 1)), "long")).add("on", entries(spark, list(enumerate([1, 1, 0, 1, 1, 1], 1)), "int"))
    g = Query(d, where("on") == 1).group_by("dev", "folded")
    assert sorted(map(tuple, g.representatives().collect())) == [("device-a", 1), ("device-b", 4), ("device-c", 5)]
    assert sorted(map(tuple, g.representatives(first=False).collect())) == [("device-a", 2), ("device-b", 4), ("device-c", 6)]
    assert sorted(map(tuple, g.extreme("time", largest=True).collect())) == [("device-a", 200, 2), ("device-b", 120, 4), ("device-c", 300, 5)]
    assert {r.key: r.identities for r in g.items().collect()}["device-c"] == [5, 6]
    assert sorted(map(tuple, g.fold_with("", lambda a, i: a + str(i), "string").collect())) == [("device-a", "12"), ("device-b", "4"), ("device-c", "56")]


def test_lookups(spark):
    i = Index("k", entries(spark, [(1, 5), (2, 5), (3, 7), (4, None)], "int"))
    keys = spark.createDataFrame([(5,), (5,), (8,), (None,)], "key int")
    assert sorted(map(tuple, lookups.count_by_keys(i, keys).collect()), key=str) == [(5, 2), (8, 0), (None, 1)]
    assert lookups.exists_any(i, keys) and not lookups.exists_all(i, keys) and lookups.exists_other_identity(i, 5, 1) and not lookups.exists_other_identity(i, 7, 3)
    assert [r.identity for r in lookups.entries_of_repeated(i).orderBy("identity").collect()] == [1, 2]


def test_catalog(spark, tmp_path):
    for c in (Catalog(spark, f"{tmp_path}/c"), Catalog(spark)):
        c.create("sku", entries(spark, [(501, 100042), (502, 100042)], "long"))
        c.create("name", entries(spark, [(501, "a"), (502, "b")], "string"), unique=True, single_key=True)
        assert c.names() == ["name", "sku"] and c.open("sku", "bigint").entries().count() == 2
        with pytest.raises(ContractError):
            c.open("sku", "string")
        with pytest.raises(ContractError):
            c.create("sku", entries(spark, [], "long"))
        with pytest.raises(ContractError):
            changes.inserted(c.open("name"), entries(spark, [(503, "a")], "string"))
        with pytest.raises(ContractError):
            c.publish({"sku": entries(spark, [], "long"), "name": entries(spark, [(1, "x"), (1, "y")], "string")})
        assert c.open("sku").entries().count() == 2  # nothing of a broken batch is seen
        s = c.index_set()
        assert changes.apply(c, "sku", s, where("name") == "b", F.col("key") + 1) == (1, 1)
        assert sorted(map(tuple, c.open("sku").entries().collect())) == [(501, 100042), (502, 100043)]
        assert changes.apply(c, "sku", c.index_set(), where("name") == "a") == (1, 1) and c.open("sku").entries().count() == 1
        assert changes.deleted(c.open("name"), entries(spark, [(501, "a"), (502, "zz")], "string")).count() == 1
        assert changes.rekeyed(c.open("name"), 501, "q", old="a").where("key = 'q'").count() == 1
        assert c.compact("sku").entries().count() == 1 and c.validate() == [] and c.info("sku")["version"] == 4
        c.drop("name")
        assert not c.exists("name")
    assert Catalog(spark, f"{tmp_path}/c").backup(f"{tmp_path}/d").names() == ["sku"]
    with pytest.raises(ContractError):
        IndexSet().add("a", entries(spark, [], "int")).add("b", spark.createDataFrame([], "identity string, key int"))


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text("hello")
    (tmp_path / "x" / "b.bin").write_text("x" * 9)
    assert [r.identity.rsplit("/", 1)[1] for r in Query(crawl(spark, str(tmp_path / "x")), (where("size") > 5) & where("file_name").like("b*")).identities().collect()] == ["b.bin"]
    spark.createDataFrame([(i, i % 3) for i in range(9)], "id long, v int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, v int").parquet(f"{tmp_path}/in")
    q = matching(stream, "id", (where("v") == 1) & ~(where("id") > 5)).writeStream.format("memory").queryName("hits").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination()
    assert sorted(r.id for r in spark.table("hits").collect()) == [1, 4]
