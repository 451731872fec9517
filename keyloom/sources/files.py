"""A folder's files as an index set: name, extension, size and time of change."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .catalog import IndexSet


def crawl(spark: SparkSession, path: str) -> IndexSet:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).drop("content")
    name = F.element_at(F.split("path", "/"), -1)
    table = files.select("path", name.alias("file_name"), F.regexp_extract(name, r"\.([^.]+)$", 1).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return IndexSet.from_table(table, "path", ["file_name", "extension", "size", "modified"], unique=True)
