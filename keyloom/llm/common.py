"""What the operators share: the shared folder, row keys, let-bindings and checked broadcasts."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after it was counted and found to have no more rows than this.
BROADCAST_ROWS = 20_000
#: Most keys that can hold a share of 1 / HOT of all rows each.
HOT = 1000
#: Share of the driver's heap from which it is collected and given back after a table was written.
HEAP = 0.5
#: Stands for a null id, so that null ids join and sort first.
NULL_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one is set only where the session names none and all run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (named or _own_dir()).rstrip("/")


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="keyloom-shared-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run in here go when it ends, not when the driver comes to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def give_back(spark: SparkSession) -> None:
    """What plans leave in the driver's heap goes, and the heap shrinks: it else grows to its limit, beside threads and classes that grow, too."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP * heap.maxMemory():
        spark._jvm.java.lang.System.gc()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, lost executors don't matter."""
    path = new_path(df.sparkSession, name)
    with own_shuffles(df.sparkSession):
        df.write.parquet(path)
    give_back(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """The files of a table that ``materialize`` wrote and nothing reads any more."""
    spark = df.sparkSession
    for path in {name.rpartition("/")[0] for name in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bucketed(df: DataFrame, name: str, key: str) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a table bucketed by ``key``, which later joins on it read where it is; and what drops it, files and all."""
    spark = df.sparkSession
    buckets, table_name, path = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), f"{name}_{uuid.uuid4().hex}", new_path(spark, name)
    with own_shuffles(spark):
        df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(table_name)

    def drop() -> None:
        spark.sql(f"drop table if exists {table_name}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return spark.table(table_name), drop


def spread(df: DataFrame) -> DataFrame:
    """Narrow rows that much work follows, over all cores: a small table is else read by few tasks."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *df.columns)


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if a count (of a materialised, narrow table) shows at most ``limit`` rows; else leave the join to AQE."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_hot(rows: DataFrame, side: DataFrame, on: str, weight: str) -> DataFrame:
    """``rows`` joined with ``side`` (one row a key, ``weight``: how many rows have it); ``weight`` is dropped.

    Keys with a thousandth of all weight or more, of which there are at most HOT, go to every task, so none of them gathers in one;
    the others are shuffled.
    """
    total = side.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT >= total
    heavy, rest = F.broadcast(side.where(hot).drop(weight)), side.where(~hot).drop(weight)
    return rows.join(heavy, on).unionByName(rows.join(rest, on))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_of(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def id_back(col: str) -> Column:
    return F.when(F.col(col) != NULL_ID, F.col(col))


def packed(df: DataFrame, *named: Column) -> DataFrame:
    """All columns as one struct ``__row`` beside the columns in ``named``, so that no name of theirs can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *named)


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("__row.*")


def bounded_batches(spark: SparkSession, rows: int = 500, size: str = "16m") -> None:
    """Arrow batches of at most so many rows and bytes (one row at least): a batch of whole texts has to fit a Python worker several
    times over. A session that sets smaller ones keeps them."""
    for key, most in (("maxRecordsPerBatch", str(rows)), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(name).rstrip("bB")) if spark.conf.get(name).rstrip("bB").lstrip("-").isdigit() else 0
        if key == "maxRecordsPerBatch" and not 0 < now <= rows or key == "maxBytesPerBatch" and spark.conf.get(name) != most:
            spark.conf.set(name, most)
