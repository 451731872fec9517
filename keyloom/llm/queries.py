"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from . import decontaminate, line_dedup, minhash, packing, quality_rules, secrets, sharding, suffix_array, suffix_trees, warc
from .common import table

#: Small enough that the smallest table splits too.
SHARD_BYTES = 1_000_000


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op2_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.dedup_substrings(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_trees.dedup_words(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(table(spark, sf_dir, "documents"))


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


OP2_SQL = f"""
with r as (
  select doc_id, strlen(coalesce(text, ''))::bigint as n_bytes,
    ((('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint >> 2) << 30)
      | (('0x' || substr(md5(coalesce(text, '')), 1, 8))::bigint >> 2) as bits
  from documents),
l as (select r.*, d.d, bits >> (60 - d.d) as q from r, range(0, 61) d(d)),
s as (select d, q, sum(n_bytes)::bigint as b from l group by d, q),
c as (select l.doc_id, l.bits, l.n_bytes, min(l.d) as d from l join s using (d, q) where s.b <= {SHARD_BYTES} or l.d = 60 group by all)
select c.doc_id, case when c.d = 0 then '' else lpad(bin(bits >> (60 - c.d)), c.d::int, '0') end as shard, 0::bigint as part,
  c.d::int as depth, c.n_bytes, s.b as shard_bytes, c.n_bytes > {SHARD_BYTES} as oversize
from c join s on s.d = c.d and s.q = bits >> (60 - c.d)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_extendible_shards": OP2_SQL}
