"""Sharding by extendible hashing (native: DataFrame functions only).

Each row gets 60 hash bits, 30 from the key and 30 from the text. The directory starts with the empty prefix; a
bucket over the byte limit splits on its next bit, all others stay, so a row's shard is the shortest prefix of its
bits whose bucket fits. Only sums of bytes by prefix are shuffled, pre-aggregated in each task, never texts.

Edge cases: null texts count 0 bytes and null keys hash as the empty string; rows that agree in key and text cannot be
told apart by bits: where one such group alone is over the limit at the last bit, it is counted off into ``part``s that
fit (a single document over the limit stays whole, ``oversize``). An empty table gives no rows. With all rows equal to fewer than ``limit`` bytes there is one shard, with the empty prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, packed, text_of

BITS = 60
#: Bits by which the directory deepens in one pass over the sums.
STEP = 12


def hash_bits(key: Column, text: Column) -> Column:
    """30 bits of md5(key), then 30 bits of md5(text)."""
    part = lambda c: F.shiftright(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long"), 2)
    return F.shiftleft(part(F.coalesce(key.cast("string"), F.lit(""))), 30).bitwiseOR(part(text))


def _prefix(bits: Column, drop: Column | int) -> Column:
    return F.call_function("shiftright", bits, F.lit(drop) if isinstance(drop, int) else drop)


def _directory(rows: DataFrame, limit_bytes: int) -> DataFrame:
    """(at, p, depth, prefix, shard_bytes): for each prefix p of ``at`` bits in use, the shard that holds it.

    One pass deepens the directory by STEP bits and reads only rows of buckets still too large.
    """
    found, left, depth = None, rows.select("__bits", F.col("n_bytes").alias("b")), 0
    while True:
        last = min(depth + STEP, BITS)
        finest = materialize(left.groupBy(_prefix(F.col("__bits"), BITS - last).alias("p")).agg(F.sum("b").alias("b")), "shard-sums")
        levels = finest.select("p", "b", F.explode(F.sequence(F.lit(depth), F.lit(last))).alias("d")).withColumn("q", _prefix(F.col("p"), F.lit(last) - F.col("d")))
        fits = levels.groupBy("d", "q").agg(F.sum("b").alias("sb")).where((F.col("sb") <= limit_bytes) | (F.col("d") == BITS))
        shortest = levels.join(fits, ["d", "q"]).groupBy("p").agg(F.min(F.struct("d", "q", "sb")).alias("c"))
        part = materialize(shortest.select(F.lit(last).alias("at"), "p", F.col("c.d").alias("depth"), F.col("c.q").alias("prefix"), F.col("c.sb").alias("shard_bytes")), "shard-directory")
        found = part if found is None else found.unionByName(part)
        if last == BITS or part.count() == finest.count():
            return found
        left = left.withColumn("p", _prefix(F.col("__bits"), BITS - last)).join(part.select("p"), "p", "left_anti").select("__bits", "b")
        depth = last


def shard(docs: DataFrame, limit_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, ``shard`` (the prefix as a string of bits), ``part``, ``depth``, ``n_bytes``, ``shard_bytes`` (of all parts), ``oversize``."""
    out = _placed(docs.select(F.col(key).alias("__key"), text_of(text).alias("__text"), F.monotonically_increasing_id().alias("__uid")), limit_bytes)
    return out.select(F.col("__key").alias(key), "shard", "part", "depth", "n_bytes", "shard_bytes", "oversize")


def _placed(docs: DataFrame, limit_bytes: int) -> DataFrame:
    """(__uid, __key, shard, part, depth, n_bytes, shard_bytes, oversize), one for each __uid of ``docs``: __key, __text, __uid."""
    rows = materialize(docs.select("__key", hash_bits(F.col("__key"), F.col("__text")).alias("__bits"), F.octet_length("__text").cast("long").alias("n_bytes"), "__uid"), "shard-rows")
    found = _directory(rows, limit_bytes)
    steps = sorted(r["at"] for r in found.select("at").distinct().collect())  # BITS / STEP rows at most
    placed = rows
    for at in steps:
        here = found.where(F.col("at") == at).select("p", F.struct("depth", "prefix", "shard_bytes").alias(f"__s{at}"))
        placed = placed.withColumn("p", _prefix(F.col("__bits"), BITS - at)).join(maybe_broadcast(here), "p", "left").drop("p")
    placed = placed.withColumn("__s", F.coalesce(*[F.col(f"__s{at}") for at in steps]) if steps else F.lit(None).cast("struct<depth:int,prefix:bigint,shard_bytes:bigint>"))
    alike = (F.col("__s.depth") == BITS) & (F.col("__s.shard_bytes") > limit_bytes) & (F.col("n_bytes") < F.col("__s.shard_bytes"))
    # Rows alike in all bits: counted off within their input partition, so no task gathers the group.
    source = F.shiftright("__uid", 33)
    turn = F.row_number().over(Window.partitionBy("__bits", source).orderBy("__uid")) - 1
    each = F.greatest(F.floor(F.lit(limit_bytes) / F.greatest(F.col("n_bytes"), F.lit(1))), F.lit(1))
    cut = placed.where(alike).withColumn("part", F.shiftleft(source, 32) + F.floor(turn / each))
    placed = placed.where(~F.coalesce(alike, F.lit(False))).withColumn("part", F.lit(0).cast("long")).unionByName(cut)
    label = F.when(F.col("__s.depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("__s.prefix"), F.col("__s.depth"), F.lit("0")))
    return placed.select("__uid", "__key", label.alias("shard"), "part", F.col("__s.depth").cast("int").alias("depth"), "n_bytes", F.col("__s.shard_bytes").alias("shard_bytes"), (F.col("n_bytes") > limit_bytes).alias("oversize"))


def write_shards(docs: DataFrame, path: str, limit_bytes: int, key: str = "doc_id", text: str = "text") -> tuple[str, str]:
    """Write the rows, by shard and part, as Parquet folders ``shard=b<bits>/part=<number>``: each row goes where ``shard`` puts it.

    The rows are written once with a number of their own, by which they meet their places: keys may be null or repeated. The bits follow
    a letter, so that no reader takes them for a number. Returns the names of the two folder columns: a table with columns
    of these names keeps them, and the folders' get an underscore more.
    """
    names = []
    for name in ("shard", "part"):
        while name.lower() in map(str.lower, docs.columns):
            name += "_"
        names.append(name)
    rows = materialize(packed(docs, F.col(key).alias("__key"), F.monotonically_increasing_id().alias("__uid")), "shard-docs")
    placed = _placed(rows.select("__key", text_of(f"__row.`{text}`").alias("__text"), "__uid"), limit_bytes)
    placed = placed.select("__uid", F.concat(F.lit("b"), "shard").alias(names[0]), F.col("part").alias(names[1]))
    rows.join(placed, "__uid").select("__row.*", *names).repartition(*names).write.partitionBy(*names).parquet(path)
    return names[0], names[1]
