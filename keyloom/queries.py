"""Queries over the test tables: each operator once, beside the SQL that says the same."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from .operators import changes, lookups
from .operators.results import Query
from .plans.conditions import ByIdentity, CompareKeys, Composite, Condition, Except, ExternalTest, MultiKey, OrdinalTest, PreparedSet, correlated_keys, external, external_keys, where
from .sources.catalog import IndexSet

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}
IDENTITY = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "events": "event_id", "documents": "doc_id", "pages": "page_id", "nation": "n_nationkey"}
NOW = dt.datetime(1998, 1, 1, 12)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _set(spark: SparkSession, sf_dir: str, name: str) -> IndexSet:
    return IndexSet.from_table(_table(spark, sf_dir, name), IDENTITY[name], unique=True)


def _put(name: str, run: Run, sql: str) -> None:
    QUERIES[name], SQL[name] = run, sql


def _filter(name: str, table: str, condition: Callable[[], Condition], sql: str) -> None:
    """Identities of a table's rows that match."""
    _put(name, lambda s, d: Query(_set(s, d, table), condition()).identities(), f"select {IDENTITY[table]} as identity from {table} where {sql}")


def _shape(name: str, table: str, shape: Callable[[IndexSet], DataFrame], sql: str) -> None:
    _put(name, lambda s, d: shape(_set(s, d, table)), sql)


def _multi(name: str, keys: list[str], shape: Callable[[IndexSet], DataFrame], sql: str) -> None:
    """Over lineitem, where an order has several keys in each index."""
    _put(name, lambda s, d: shape(IndexSet.from_rows(_table(s, d, "lineitem"), "l_orderkey", keys)), sql)


# Comparisons, membership, algebra
_filter("flt_between_and_eq", "orders", lambda: where("o_orderstatus").equal_to("F").and_("o_totalprice").between(100000.0, 200000.0), "o_orderstatus = 'F' and o_totalprice between 100000 and 200000")
for _n, _op, _m in (("eq", "=", "equal_to"), ("ne", "<>", "not_equal_to"), ("gt", ">", "greater_than"), ("ge", ">=", "greater_or_equal"), ("lt", "<", "less_than"), ("le", "<=", "less_or_equal")):
    _filter(f"cmp_{_n}", "part", lambda m=_m: getattr(where("p_size"), m)(20), f"p_size {_op} 20")
_filter("cmp_not_between", "customer", lambda: where("c_acctbal").not_between(0.0, 5000.0), "c_acctbal not between 0 and 5000")
_filter("cmp_all", "part", lambda: where("p_size").all(), "true")
_filter("set_in", "orders", lambda: where("o_orderpriority").in_set(["1-URGENT", "2-HIGH", None]), "o_orderpriority in ('1-URGENT', '2-HIGH') or o_orderpriority is null")
_filter("set_not_in", "orders", lambda: where("o_orderpriority").not_in_set(["1-URGENT", "2-HIGH"]), "o_orderpriority not in ('1-URGENT', '2-HIGH')")
_filter("null_states", "documents", lambda: where("lang").is_not_null_or_empty() & ~where("text").is_null(), "lang is not null and lang <> '' and text is not null")
_filter("float_finite", "customer", lambda: where("c_acctbal").is_finite() & ~where("c_acctbal").is_nan(), "isfinite(c_acctbal)")
_filter("flt_or_not", "customer", lambda: ~(where("c_mktsegment").equal_to("BUILDING") | where("c_nationkey").less_than(10)), "not (c_mktsegment = 'BUILDING' or c_nationkey < 10)")
_filter("flt_left_fold", "orders", lambda: where("o_orderstatus").equal_to("F").or_("o_orderstatus").equal_to("O").and_("o_totalprice").greater_than(250000.0), "(o_orderstatus = 'F' or o_orderstatus = 'O') and o_totalprice > 250000")
_filter("flt_except", "part", lambda: Except(where("p_size").less_than(10), where("p_brand").equal_to("Brand#11")), "p_size < 10 and p_brand <> 'Brand#11'")
_filter("flt_negated_leaf", "part", lambda: where("p_name").not_.starts_with("a").and_("p_size").not_.greater_than(30), "not starts_with(p_name, 'a') and p_size <= 30")
_filter("bit_and_eq", "part", lambda: where("p_size").bit_and_equal_to(6, 2), "(p_size & 6) = 2")
_filter("bit_any", "part", lambda: where("p_size").any_bits_set(24), "(p_size & 24) <> 0")
_filter("bit_all", "part", lambda: where("p_size").all_bits_set(24), "(p_size & 24) = 24")
_filter("bit_none", "part", lambda: where("p_size").no_bits_set(24), "(p_size & 24) = 0")
_filter("by_identity", "part", lambda: ByIdentity("Between", (100, 200)) & where("p_size").greater_than(5), "p_partkey between 100 and 200 and p_size > 5")
_filter("ext_test", "part", lambda: where("p_size").greater_than(5) & ExternalTest(lambda i: i % 7 == 0), "p_size > 5 and p_partkey % 7 = 0")

# Text
_filter("str_starts_with", "part", lambda: where("p_name").starts_with("b"), "starts_with(p_name, 'b')")
_filter("str_ends_with", "supplier", lambda: where("s_name").ends_with("7"), "suffix(s_name, '7')")
_filter("str_contains", "part", lambda: where("p_type").contains("ROM"), "contains(p_type, 'ROM')")
_filter("str_not_contains", "part", lambda: where("p_type").not_contains("AR"), "not contains(p_type, 'AR')")
_filter("str_no_case", "part", lambda: where("p_type").contains("Rom", policy="ignore_case"), "contains(lower(p_type), 'rom')")
_filter("str_text_equals", "orders", lambda: where("o_orderpriority").text_equals("1-urgent"), "lower(o_orderpriority) = '1-urgent'")
_filter("str_text_in", "orders", lambda: where("o_orderpriority").text_in_set(["1-urgent", "5-low"]), "lower(o_orderpriority) in ('1-urgent', '5-low')")
_filter("str_wildcard", "supplier", lambda: where("s_name").like("S*0?"), "regexp_full_match(s_name, 'S.*0.')")
_filter("str_not_wildcard", "part", lambda: where("p_brand").not_matches_pattern("Brand#1*"), "p_brand not like 'Brand#1%'")
_filter("str_regex", "pages", lambda: where("url").regex_matches("^http.*[0-9]5"), "regexp_matches(url, '^http.*[0-9]5')")
_filter("str_not_regex", "pages", lambda: where("url").not_regex_matches("[02468]$"), "not regexp_matches(url, '[02468]$')")
_filter("str_captured", "part", lambda: where("p_brand").matches_with("Brand#(.)", "2"), "regexp_extract(p_brand, 'Brand#(.)', 1) = '2'")
_filter("str_captured_in", "part", lambda: where("p_brand").matches_in_set("Brand#(.)", ["1", "3"]), "regexp_extract(p_brand, 'Brand#(.)', 1) in ('1', '3')")
_filter("str_not_captured_in", "part", lambda: where("p_brand").not_matches_in_set("Brand#(.)", ["1", "3"]), "regexp_extract(p_brand, 'Brand#(.)', 1) not in ('1', '3')")

# Dates
_D = "o_orderdate"
_DATES: dict[str, tuple[Callable[[], Condition], str]] = {
    "year": (lambda: where(_D).year_equal_to(1995), "year(t) = 1995"), "year_not": (lambda: where(_D).year_not_equal_to(1995), "year(t) <> 1995"), "year_in": (lambda: where(_D).year_in([1993, 1996]), "year(t) in (1993, 1996)"),
    "year_not_in": (lambda: where(_D).year_not_in([1993, 1996]), "year(t) not in (1993, 1996)"), "year_range": (lambda: where(_D).year_range(1996, 1997), "year(t) between 1996 and 1997"), "year_not_range": (lambda: where(_D).year_not_range(1996, 1997), "year(t) not between 1996 and 1997"),
    "year_from": (lambda: where(_D).year_on_or_after(1996), "year(t) >= 1996"), "year_to": (lambda: where(_D).year_on_or_before(1996), "year(t) <= 1996"), "year_month": (lambda: where(_D).year_month(1995, 12), "year(t) = 1995 and month(t) = 12"),
    "year_month_in": (lambda: where(_D).year_month_in([(1995, 12), (1996, 2)]), "strftime(t, '%Y%m') in ('199512', '199602')"), "day_of": (lambda: where(_D).year_month_day(1995, 3, 5), "t::date = date '1995-03-05'"),
    "days_of": (lambda: where(_D).year_month_day_in([(1995, 3, 5), (1996, 2, 29)]), "t::date in (date '1995-03-05', date '1996-02-29')"), "year_months": (lambda: where(_D).year_in_months(1996, [1, 6]), "year(t) = 1996 and month(t) in (1, 6)"),
    "year_quarter": (lambda: where(_D).year_quarter(1996, 4), "year(t) = 1996 and quarter(t) = 4"), "month": (lambda: where(_D).month_equal_to(2), "month(t) = 2"), "month_not": (lambda: where(_D).month_not_equal_to(2), "month(t) <> 2"),
    "month_in": (lambda: where(_D).month_in([2, 3]), "month(t) in (2, 3)"), "month_not_in": (lambda: where(_D).month_not_in([2, 3]), "month(t) not in (2, 3)"), "month_range": (lambda: where(_D).month_range(4, 6), "month(t) between 4 and 6"),
    "month_not_range": (lambda: where(_D).month_not_range(4, 6), "month(t) not between 4 and 6"), "day": (lambda: where(_D).day_equal_to(31), "day(t) = 31"), "day_not": (lambda: where(_D).day_not_equal_to(31), "day(t) <> 31"), "day_in": (lambda: where(_D).day_in([1, 15]), "day(t) in (1, 15)"),
    "day_not_in": (lambda: where(_D).day_not_in([1, 15]), "day(t) not in (1, 15)"), "day_range": (lambda: where(_D).day_range(10, 12), "day(t) between 10 and 12"), "day_not_range": (lambda: where(_D).day_not_range(10, 12), "day(t) not between 10 and 12"),
    "month_day": (lambda: where(_D).month_day(2, 29), "month(t) = 2 and day(t) = 29"), "quarter": (lambda: where(_D).quarter_equal_to(2), "quarter(t) = 2"), "in_quarter": (lambda: where(_D).in_quarter(3), "quarter(t) = 3"), "quarter_range": (lambda: where(_D).in_quarter_range(2, 3), "quarter(t) between 2 and 3"),
    "quarter_start": (lambda: where(_D).is_quarter_start(), "day(t) = 1 and month(t) in (1, 4, 7, 10)"), "quarter_end": (lambda: where(_D).is_quarter_end(), "t::date = last_day(t) and month(t) in (3, 6, 9, 12)"), "half_start": (lambda: where(_D).is_half_year_start(), "day(t) = 1 and month(t) in (1, 7)"),
    "half_end": (lambda: where(_D).is_half_year_end(), "t::date = last_day(t) and month(t) in (6, 12)"), "first_of_month": (lambda: where(_D).is_first_of_month(), "day(t) = 1"), "last_of_month": (lambda: where(_D).is_last_of_month(), "t::date = last_day(t)"),
    "weekend": (lambda: where(_D).is_weekend(), "isodow(t) >= 6"), "weekday": (lambda: where(_D).is_weekday(), "isodow(t) < 6"), "today": (lambda: where(_D).is_today(now=NOW), "t::date = date '1998-01-01'"), "yesterday": (lambda: where(_D).is_yesterday(now=NOW), "t::date = date '1997-12-31'"),
    "last_days": (lambda: where(_D).is_in_last_days(30, now=NOW), "t >= timestamp '1997-12-02 12:00:00'"), "last_hours": (lambda: where(_D).is_in_last_hours(48, now=NOW), "t >= timestamp '1997-12-30 12:00:00'"), "last_minutes": (lambda: where(_D).is_in_last_minutes(1440, now=NOW), "t >= timestamp '1997-12-31 12:00:00'"),
}
for _n, (_c, _q) in _DATES.items():
    _put(f"date_{_n}", lambda s, d, c=_c: Query(_set(s, d, "orders"), c()).identities(), f"select o_orderkey as identity from (select *, o_orderdate as t from orders) where {_q}")
for _n, _m, _a, _q in (("hour", "hour_equal_to", (7,), "hour(ts) = 7"), ("hour_in", "hour_in", ([1, 2],), "hour(ts) in (1, 2)"), ("hour_not_in", "hour_not_in", ([1, 2],), "hour(ts) not in (1, 2)"), ("hour_range", "hour_range", (9, 17), "hour(ts) between 9 and 17"), ("hour_not_range", "hour_not_range", (9, 17), "hour(ts) not between 9 and 17"), ("morning", "is_morning", (), "hour(ts) between 5 and 11"), ("afternoon", "is_afternoon", (), "hour(ts) between 12 and 16"), ("evening", "is_evening", (), "hour(ts) between 17 and 21"), ("night", "is_night", (), "hour(ts) >= 22 or hour(ts) <= 4")):
    _filter(f"date_{_n}", "events", lambda m=_m, a=_a: getattr(where("ts"), m)(*a), _q)

# Numbers
for _n, _how, _q in (("floor", "floor", "floor(p_retailprice) = 950"), ("ceiling", "ceiling", "ceil(p_retailprice) = 950"), ("truncate", "truncate", "trunc(p_retailprice) = 950")):
    _filter(f"num_{_n}", "part", lambda h=_how: where("p_retailprice").transformed(h, 0, "EqualTo", 950), _q)
_filter("num_round_range", "part", lambda: where("p_retailprice").transformed("round_away", 0, "Between", 950.0, 1000.0), "round(p_retailprice) between 950 and 1000")

# Binary: the name's bytes


def _binary(name: str, condition: Callable[[], Condition], sql: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        t = _table(s, d, "customer").withColumn("b", F.encode("c_name", "UTF-8")).withColumn("guid", F.md5("c_name"))
        return Query(IndexSet.from_table(t, "c_custkey", unique=True), condition()).identities()

    _put(name, run, f"select c_custkey as identity from (select *, hex(c_name::blob) as hex, md5(c_name) as guid from customer) where {sql}")


_binary("bin_slice", lambda: where("b").binary_slice_equal(0, b"Cust"), "starts_with(hex, '43757374')")
_binary("bin_starts", lambda: where("b").starts_with(b"Cu"), "starts_with(hex, '4375')")
_binary("bin_hex_pattern", lambda: where("b").hex_pattern("43 ?? 73 *"), "regexp_full_match(hex, '43..73.*')")
_binary("bin_uint16", lambda: where("b").binary_typed_slice_equal_to(0, "uint16", 0x7543), "starts_with(hex, '4375')")
_binary("bin_int32_range", lambda: where("b").binary_typed_slice_between(0, "int32", 0, 0x7FFFFFFF), "substr(hex, 7, 1) < '8'")
_binary("bin_bits", lambda: where("b").binary_typed_slice_bit_and_equal_to(17, "byte", 1, 1), "ascii(substr(c_name, 18, 1)) % 2 = 1")
_binary("bin_text", lambda: where("b").binary_typed_slice_starts_with(4, "utf8", "omer", length=8), "substr(c_name, 5, 4) = 'omer'")
_binary("guid_text", lambda: where("guid").guid_text("starts_with", "ax"), "starts_with(guid, 'a')")
_binary("guid_slice", lambda: where("guid").guid_slice(2, 1, "f"), "substr(guid, 3, 1) = 'f'")

# Several keys for one identity
_multi("multi_key_and", ["l_partkey", "l_quantity"], lambda s: Query(s, where("l_quantity").less_than(5.0) & where("l_quantity").greater_than(45.0)).identities(), "select l_orderkey as identity from lineitem where l_quantity < 5 intersect select l_orderkey from lineitem where l_quantity > 45")
_multi("multi_not_equal", ["l_returnflag"], lambda s: Query(s, where("l_returnflag").not_equal_to("N")).identities(), "select distinct l_orderkey as identity from lineitem where l_returnflag <> 'N'")
_multi("multi_not_in", ["l_returnflag"], lambda s: Query(s, where("l_returnflag").not_in_set(["N"])).identities(), "select distinct l_orderkey as identity from lineitem except select l_orderkey from lineitem where l_returnflag = 'N'")
_multi("multi_keys_all", ["l_returnflag"], lambda s: Query(s, where("l_returnflag").exists_all(["A", "N", "R"])).identities(), "select l_orderkey as identity from lineitem where l_returnflag in ('A', 'N', 'R') group by 1 having count(distinct l_returnflag) = 3")
_multi("multi_keys_any", ["l_returnflag"], lambda s: Query(s, where("l_returnflag").exists_any(["A", "R"])).identities(), "select distinct l_orderkey as identity from lineitem where l_returnflag in ('A', 'R')")
_multi("multi_or_preserve", ["l_quantity"], lambda s: Query(s, where("l_quantity").less_than(3.0) | where("l_quantity").less_than(5.0)).count(preserve=True), "select count(*) filter (l_quantity < 3) + count(*) filter (l_quantity < 5) as n from lineitem")
_multi("multi_or", ["l_quantity", "l_partkey"], lambda s: Query(s, where("l_quantity").less_than(3.0) | where("l_partkey").less_than(50)).identities(), "select distinct l_orderkey as identity from lineitem where l_quantity < 3 or l_partkey < 50")
_multi("multi_not_and", ["l_returnflag"], lambda s: Query(s, where("l_returnflag").equal_to("A") & ~where("l_returnflag").equal_to("R")).identities(), "select l_orderkey as identity from lineitem where l_returnflag = 'A' except select l_orderkey from lineitem where l_returnflag = 'R'")
_multi("multi_preserve", ["l_quantity"], lambda s: Query(s, where("l_quantity").less_than(3.0)).identities(preserve=True), "select l_orderkey as identity from lineitem where l_quantity < 3")
_multi("multi_complement", ["l_shipdate"], lambda s: Query(s, ~where("l_shipdate").year_equal_to(1995)).identities(), "select distinct l_orderkey as identity from lineitem except select l_orderkey from lineitem where year(l_shipdate) = 1995")
_multi("cmp_keys", ["l_partkey", "l_suppkey"], lambda s: Query(s, CompareKeys("l_partkey", "l_suppkey", "=")).identities(), "select distinct a.l_orderkey as identity from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey = b.l_suppkey")
_multi("single_identities", ["l_returnflag"], lambda s: lookups.repeated(s["l_returnflag"], "identity", single=True), "select l_orderkey as identity, count(distinct l_returnflag) as n from lineitem group by 1 having count(distinct l_returnflag) = 1")
_multi("dup_identities", ["l_returnflag"], lambda s: lookups.repeated(s["l_returnflag"], "identity"), "select l_orderkey as identity, count(distinct l_returnflag) as n from lineitem group by 1 having count(distinct l_returnflag) >= 2")
_multi("inv_keys", ["l_returnflag", "l_linestatus"], lambda s: lookups.inverse(s, ["l_returnflag", "l_linestatus"], where("l_returnflag").equal_to("A")).select("identity", F.array_join("l_returnflag", ",").alias("flags"), F.array_join("l_linestatus", ",").alias("states")), "select l_orderkey as identity, string_agg(distinct l_returnflag, ',' order by l_returnflag) as flags, string_agg(distinct l_linestatus, ',' order by l_linestatus) as states from lineitem group by 1 having bool_or(l_returnflag = 'A')")

# Results
_POOR = "o_totalprice < 50000"
_poor = lambda: where("o_totalprice").less_than(50000.0)
_shape("ret_count", "orders", lambda s: Query(s, _poor()).count(), f"select count(*) as n from orders where {_POOR}")
_shape("ret_keys4", "orders", lambda s: Query(s, _poor()).returning("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), f"select o_orderkey as identity, o_custkey as key1, o_orderstatus as key2, o_totalprice as key3, o_orderpriority as key4 from orders where {_POOR}")
_shape("ret_tuples", "orders", lambda s: Query(s, _poor()).tuples("o_custkey"), f"select o_orderkey as identity, o_custkey as key from orders where {_POOR}")
_shape("top", "orders", lambda s: Query(s, where("o_orderstatus").equal_to("F")).ordered("o_totalprice", descending=True, top=20), "select o_orderkey as identity, o_totalprice as key from orders where o_orderstatus = 'F' order by 2 desc, 1 desc limit 20")
_shape("bottom", "orders", lambda s: Query(s, where("o_orderstatus").equal_to("F")).ordered("o_totalprice", bottom=20), "select o_orderkey as identity, o_totalprice as key from orders where o_orderstatus = 'F' order by 2 desc, 1 desc limit 20")
_shape("skip_take", "part", lambda s: Query(s, where("p_size").greater_than(10)).identities(order="asc", skip=15, take=30), "select p_partkey as identity from part where p_size > 10 order by 1 limit 30 offset 15")

# Groups
_shape("grp_count", "orders", lambda s: Query(s, _poor()).group_by("o_orderpriority").counts(), f"select o_orderpriority as key, count(*) as n from orders where {_POOR} group by 1")
_shape("grp_count_top", "orders", lambda s: Query(s, _poor()).group_by("o_custkey").counts("count", descending=True, top=10), f"select o_custkey as key, count(*) as n from orders where {_POOR} group by 1 order by 2 desc, 1 limit 10")
_shape("grp_folded", "part", lambda s: Query(s, where("p_size").all()).group_by("p_brand", "folded").counts(), "select lower(p_brand) as key, count(*) as n from part group by 1")
_EXTREME = "select o_custkey as key, {0}(o_totalprice) as value, min(o_orderkey) filter (o_totalprice = m) as identity from (select *, {0}(o_totalprice) over (partition by o_custkey) as m from orders where o_orderstatus = 'F') group by 1"
_shape("grp_min", "orders", lambda s: Query(s, where("o_orderstatus").equal_to("F")).group_by("o_custkey").extreme("o_totalprice"), _EXTREME.format("min"))
_shape("grp_max", "orders", lambda s: Query(s, where("o_orderstatus").equal_to("F")).group_by("o_custkey").extreme("o_totalprice", largest=True), _EXTREME.format("max"))
_shape("grp_rep_first", "events", lambda s: Query(s, where("value").greater_than(10.0)).group_by("user_id").representatives(), "select user_id as key, min(event_id) as identity from events where value > 10 group by 1")
_shape("grp_rep_last", "events", lambda s: Query(s, where("value").greater_than(10.0)).group_by("user_id").representatives(first=False), "select user_id as key, max(event_id) as identity from events where value > 10 group by 1")
_shape("grp_metadata", "events", lambda s: Query(s, where("event_id").all()).group_by("event_type").metadata(), "select event_type as key, count(*) as n, min(event_id) as first, max(event_id) as last from events group by 1")
_shape("grp_having", "orders", lambda s: Query(s, _poor()).group_by("o_custkey").having_count(least=2, most=3).counts(), f"select o_custkey as key, count(*) as n from orders where {_POOR} group by 1 having count(*) between 2 and 3")
_shape("grp_duplicates", "orders", lambda s: Query(s, _poor()).group_by("o_custkey").duplicates().representatives(), f"select o_custkey as key, min(o_orderkey) as identity from orders where {_POOR} group by 1 having count(*) >= 2")
_shape("grp_singletons", "orders", lambda s: Query(s, _poor()).group_by("o_custkey").singletons().representatives(), f"select o_custkey as key, min(o_orderkey) as identity from orders where {_POOR} group by 1 having count(*) = 1")
_shape("grp_sums", "part", lambda s: Query(s, where("p_size").all()).group_by("p_brand").sums("p_size"), "select p_brand as key, sum(p_size)::bigint as sum, min(p_size) as min, max(p_size) as max from part group by 1")
_shape("grp_numbered", "customer", lambda s: Query(s, where("c_acctbal").less_than(0.0)).group_by("c_mktsegment").numbered().select("key", "identity", F.col("group").cast("long").alias("group"), F.col("item").cast("long").alias("item"), "is_first"), "select *, item = 0 as is_first from (select c_mktsegment as key, c_custkey as identity, dense_rank() over (order by c_mktsegment) - 1 as \"group\", row_number() over (partition by c_mktsegment order by c_custkey) - 1 as item from customer where c_acctbal < 0)")
_shape("grp_fold", "customer", lambda s: Query(s, where("c_acctbal").less_than(0.0)).group_by("c_mktsegment").fold_with(0, lambda a, i: a + i, "long"), "select c_mktsegment as key, sum(c_custkey)::bigint as value from customer where c_acctbal < 0 group by 1")

# Lookups, duplicates, external sources, composites, changes
_shape("dup_keys", "orders", lambda s: lookups.repeated(s["o_custkey"]), "select o_custkey as key, count(distinct o_orderkey) as n from orders group by 1 having count(distinct o_orderkey) >= 2")
_shape("single_keys", "orders", lambda s: lookups.repeated(s["o_custkey"], single=True), "select o_custkey as key, count(distinct o_orderkey) as n from orders group by 1 having count(distinct o_orderkey) = 1")
_shape("dup_projected", "part", lambda s: lookups.repeated(s["p_name"], projection=F.substring("key", 1, 1)), "select p_name[1] as key, count(*) as n from part group by 1 having count(*) >= 2")
_shape("dup_entries", "customer", lambda s: lookups.entries_of_repeated(s["c_nationkey"]), "select c_custkey as identity, c_nationkey as key from customer where c_nationkey in (select c_nationkey from customer group by 1 having count(*) >= 2)")
_shape("distinct_keys", "part", lambda s: lookups.distinct_keys(s["p_brand"]), "select distinct p_brand as key from part")
_put("lookup_keys", lambda s, d: lookups.get_by_keys(_set(s, d, "orders")["o_custkey"], _table(s, d, "customer").where("c_acctbal < 0").select("c_custkey")), "select o_custkey as key, o_orderkey as identity from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)")
_put("lookup_counts", lambda s, d: lookups.count_by_keys(_set(s, d, "orders")["o_custkey"], _table(s, d, "customer").select("c_custkey")), "select c_custkey as key, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1")
_put("exist_check", lambda s, d: lookups.check(_set(s, d, "orders")["o_custkey"], _table(s, d, "customer").select(F.col("c_custkey").alias("key"))), "select c_custkey as key, c_custkey in (select o_custkey from orders) as found from customer")
_put("ext_source", lambda s, d: Query(_set(s, d, "documents"), where("lang").equal_to("en") & external(_table(s, d, "labels").where("quality = 1").select("doc_id"))).identities(), "select doc_id as identity from documents where lang = 'en' and doc_id in (select doc_id from labels where quality = 1)")
_put("partial_index", lambda s, d: Query(_set(s, d, "documents").add("toxic", _table(s, d, "labels").select(F.col("doc_id").alias("identity"), F.col("toxic").alias("key"))), ~where("toxic").equal_to(0)).identities(), "select distinct doc_id as identity from labels where doc_id not in (select doc_id from labels where toxic = 0)")
_put("guard_missing", lambda s, d: Query(_set(s, d, "part"), where("p_size").less_than(5) | where("no_such").exists.equal_to(1)).identities(), "select p_partkey as identity from part where p_size < 5")


def _lines(s: SparkSession, d: str) -> IndexSet:
    rows = _table(s, d, "lineitem").select(F.col("l_orderkey").alias("identity"), F.col("l_orderkey").alias("p1"), F.col("l_linenumber").alias("p2"), F.col("l_returnflag").alias("p3"), F.col("l_shipdate").alias("p4"))
    return IndexSet().add("line", rows, parts=("p1", "p2", "p3", "p4"))


_put("composite_parts", lambda s, d: Query(_lines(s, d), Composite("line", lambda p: (p["p2"] >= 6) & (p["p3"] == "A"))).identities(), "select distinct l_orderkey as identity from lineitem where l_linenumber >= 6 and l_returnflag = 'A'")
_put("composite_part_leaf", lambda s, d: Query(_lines(s, d), where("line", part="p4").year_equal_to(1996) & where("line", part="p3").equal_to("R")).identities(), "select l_orderkey as identity from lineitem where year(l_shipdate) = 1996 intersect select l_orderkey from lineitem where l_returnflag = 'R'")
_put("composite_compare", lambda s, d: Query(_lines(s, d), Composite("line", lambda p: p["p1"] == p["p2"])).identities(), "select distinct l_orderkey as identity from lineitem where l_orderkey = l_linenumber")
_put("composite_full_key", lambda s, d: Query(_lines(s, d), Composite("line", lambda p: lookups.full_key(_lines(s, d)["line"], "/", without=["p4"]).endswith("7/N"))).identities(), "select distinct l_orderkey as identity from lineitem where suffix(concat_ws('/', l_orderkey, l_linenumber, l_returnflag), '7/N')")
_put("chg_delete", lambda s, d: changes.deleted_where(_set(s, d, "part")["p_brand"], _set(s, d, "part"), where("p_size").less_than(40)), "select p_partkey as identity, p_brand as key from part where p_size >= 40")
_put("chg_set_key", lambda s, d: changes.rekeyed_where(_set(s, d, "part")["p_size"], _set(s, d, "part"), where("p_brand").starts_with("Brand#1"), F.col("key") + 100), "select p_partkey as identity, case when starts_with(p_brand, 'Brand#1') then p_size + 100 else p_size end as key from part")
_put("chg_insert", lambda s, d: changes.inserted(IndexSet.from_rows(_table(s, d, "nation"), "n_nationkey", ["n_name"])["n_name"], _table(s, d, "region").select(F.col("r_regionkey").alias("identity"), F.col("r_name").alias("key"))), "select n_nationkey as identity, n_name as key from nation union select r_regionkey, r_name from region")


# Further results, text policies, outside keys, numbers and slices
_cheap = lambda: where("p_size").less_than(5)
_put("exists", lambda s, d: s.createDataFrame([(Query(_set(s, d, "part"), _cheap()).exists(), Query(_set(s, d, "part"), where("p_size").less_than(-5)).exists())], "some boolean, none boolean"), "select exists (from part where p_size < 5) as some, exists (from part where p_size < -5) as none")


def _second_page(s: SparkSession, d: str, descending: bool) -> DataFrame:
    q = Query(_set(s, d, "customer"), where("c_acctbal").greater_than(0.0))
    _, mark = q.page("c_nationkey", 25, descending=descending)
    rows, _ = q.page("c_nationkey", 25, mark, descending=descending)
    return s.createDataFrame(rows, "identity long, key int")


_put("page_second", lambda s, d: _second_page(s, d, False), "select c_custkey as identity, c_nationkey as key from customer where c_acctbal > 0 order by 2, 1 limit 25 offset 25")
_put("page_second_down", lambda s, d: _second_page(s, d, True), "select c_custkey as identity, c_nationkey as key from customer where c_acctbal > 0 order by 2 desc, 1 desc limit 25 offset 25")
_shape("grp_items", "customer", lambda s: Query(s, where("c_acctbal").less_than(0.0)).group_by("c_nationkey").items().select("key", F.array_join("identities", ",").alias("identities")), "select c_nationkey as key, string_agg(c_custkey::varchar, ',' order by c_custkey) as identities from customer where c_acctbal < 0 group by 1")
_shape("grp_numbered_many", "orders", lambda s: Query(s, _poor()).group_by("o_custkey").numbered().select("key", "identity", "group", F.col("item").cast("long").alias("item"), "is_first"), f"select o_custkey as key, o_orderkey as identity, dense_rank() over (order by o_custkey) - 1 as group, row_number() over (partition by o_custkey order by o_orderkey) - 1 as item, row_number() over (partition by o_custkey order by o_orderkey) = 1 as is_first from orders where {_POOR}")
_shape("grp_fold_column", "customer", lambda s: Query(s, where("c_acctbal").less_than(0.0)).group_by("c_nationkey").fold_column(F.lit(0).cast("long"), lambda a, i: (a * 31 + i) % 1000003), "select c_nationkey as key, list_reduce(list_prepend(0::bigint, list(c_custkey order by c_custkey)), lambda a, i: (a * 31 + i) % 1000003) as value from customer where c_acctbal < 0 group by 1")
_shape("grp_policy", "documents", lambda s: Query(s, where("doc_id").all()).group_by("lang", "normalized").counts(), "select nfc_normalize(lang) as key, count(*) as n from documents group by 1")
_shape("ret_transform", "orders", lambda s: Query(s, _poor()).transform("o_totalprice", lambda k: F.floor(k / 1000)), f"select o_orderkey as identity, floor(o_totalprice / 1000)::bigint as value from orders where {_POOR}")
_shape("ordered_by_comparer", "part", lambda s: Query(s, _cheap()).ordered("p_name", top=15, by=F.reverse), "select p_partkey as identity, p_name as key from part where p_size < 5 order by reverse(p_name), 1 limit 15")
_filter("str_normalized", "documents", lambda: where("lang").text_equals("en", policy="normalized"), "nfc_normalize(lang) = 'en'")
_filter("str_policy_less", "orders", lambda: where("o_orderpriority").less_than("3-medium", policy="ignore_case"), "lower(o_orderpriority) < '3-medium'")
_filter("str_policy_unicode", "orders", lambda: where("o_orderpriority").equal_to("2-high", policy="unicode_ci"), "lower(o_orderpriority) = '2-high'")
_filter("str_not_captured", "part", lambda: where("p_brand").not_matches_with("Brand#(.)", "2"), "regexp_extract(p_brand, 'Brand#(.)', 1) <> '2'")
for _n, _how, _q in (("to_even", "round_to_even", "round_even(p_retailprice, 0) = 950"), ("to_zero", "round_to_zero", "trunc(p_retailprice) = 950"), ("down", "round_down", "floor(p_retailprice) = 950"), ("up", "round_up", "ceil(p_retailprice) = 950"), ("away", "round_away", "round(p_retailprice) = 950")):
    _filter(f"num_round_{_n}", "part", lambda h=_how: where("p_retailprice").transformed(h, 0, "EqualTo", 950.0), _q)
_binary("bin_ends", lambda: where("b").ends_with(b"7"), "suffix(hex, '37')")
_binary("bin_contains", lambda: where("b").contains(b"#0"), "contains(hex, '2330')")
_binary("bin_ascii", lambda: where("b").binary_typed_slice_starts_with(4, "ascii", "omer", length=8), "substr(c_name, 5, 4) = 'omer'")
_binary("bin_uint128", lambda: where("b").binary_typed_slice_greater_than(2, "uint128", 0x35 << 120), "right(c_name, 1) >= '5'")
_binary("bin_char", lambda: where("b").binary_typed_slice_equal_to(16, "uint16", 0x3130), "suffix(c_name, '01')")
_put("ext_keys", lambda s, d: Query(_set(s, d, "documents"), where("lang").equal_to("en") & external_keys(_table(s, d, "labels").select("doc_id", "quality")).equal_to(1)).identities(), "select doc_id as identity from documents where lang = 'en' and doc_id in (select doc_id from labels where quality = 1)")
_filter("ext_correlated", "part", lambda: where("p_size").greater_than(5) & correlated_keys(lambda i: F.array(i % 7, i % 11)).equal_to(3), "p_size > 5 and (p_partkey % 7 = 3 or p_partkey % 11 = 3)")
_shape("ext_ordinal", "part", lambda s: Query(s, where("p_size").greater_than(40) & OrdinalTest(lambda i, n, first: (n % 3 == 1) | first)).identities(), "select identity from (select p_partkey as identity, row_number() over (order by p_partkey) - 1 as n from part where p_size > 40) where n % 3 = 1 or n = 0")
for _n, _q in (("union", "p_size < 5 or p_brand = 'Brand#2'"), ("intersect", "p_size < 5 and p_brand = 'Brand#2'"), ("except", "p_size < 5 and p_brand <> 'Brand#2'")):
    _shape(f"set_{_n}", "part", lambda s, how=_n: Query(s, _cheap()).combined(how, Query(s, where("p_brand").equal_to("Brand#2"))), f"select p_partkey as identity from part where {_q}")
_put("set_prepared", lambda s, d: Query(_set(s, d, "orders"), where("o_custkey").in_set(PreparedSet(_table(s, d, "customer").where("c_acctbal < 0").select("c_custkey")))).identities(), "select o_orderkey as identity from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)")
_put("set_prepared_not", lambda s, d: Query(_set(s, d, "orders"), where("o_custkey").not_in_set(PreparedSet(_table(s, d, "customer").where("c_acctbal > 0").select("c_custkey")))).identities(), "select o_orderkey as identity from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
_put("value_path", lambda s, d: Query(IndexSet().add_path("k", _table(s, d, "events"), "event_id", "k", text="props"), where("k").in_set(["69", "7"])).identities(), "select event_id as identity from events where props in ('{\"k\": 69}', '{\"k\": 7}')")
_shape("multi_key_builder", "part", lambda s, k=MultiKey("p_size", "p_brand"): Query(s, k.where(0).less_than(9) & k.where(1).starts_with("Brand#1")).identities(), "select p_partkey as identity from part where p_size < 9 and starts_with(p_brand, 'Brand#1')")
_put("chg_rekey", lambda s, d: changes.rekeyed(_set(s, d, "part")["p_size"], 5, 99), "select p_partkey as identity, case when p_partkey = 5 then 99 else p_size end as key from part")
_put("chg_delete_rows", lambda s, d: changes.deleted(_set(s, d, "part")["p_size"], _table(s, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("identity"), F.col("p_size").alias("key"))), "select p_partkey as identity, p_size as key from part where p_partkey % 3 <> 0")
_put("inv_all", lambda s, d: lookups.inverse(IndexSet.from_rows(_table(s, d, "lineitem"), "l_orderkey", ["l_linestatus"]), ["l_linestatus"]).select("identity", F.array_join("l_linestatus", ",").alias("status")), "select l_orderkey as identity, string_agg(distinct l_linestatus, ',' order by l_linestatus) as status from lineitem group by 1")


def queries() -> dict[str, Run]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
