import random

from pyspark.sql import functions as F

from keyloom.llm import sharding


def test_written_shards_hold_every_row_within_the_limit(spark, tmp_path):
    r = random.Random(3)
    rows = [(None if i % 10 == 0 else 7 if i % 3 == 0 else i, "z" * r.randint(0, 90) + str(i % 250), i) for i in range(500)] + [(7, "same text " * 4, 0)] * 60 + [(None, None, 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(3)
    sharding.write_shards(df, f"{tmp_path}/out", 400)
    back = spark.read.parquet(f"{tmp_path}/out").withColumn("file", F.col("_metadata.file_path")).collect()
    plain = lambda xs: sorted(xs, key=repr)
    assert plain((x.doc_id, x.text, x.extra) for x in back) == plain(rows)
    size = {}
    for x in back:
        at = x.file.rsplit("/", 1)[0]
        size[at] = size.get(at, 0) + len((x.text or "").encode())
    assert max(size.values()) <= 400


def test_shard_folders_are_text_and_clash_with_no_column(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 50, "mine", i) for i in range(60)], "doc_id long, text string, shard string, Part int")
    assert sharding.write_shards(df, f"{tmp_path}/out", 300) == ("shard_", "part_")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert dict(back.dtypes)["shard_"] == "string" and {x.shard for x in back.collect()} == {"mine"} and back.count() == 60
    want = {x.doc_id: "b" + x.shard for x in sharding.shard(df, 300).collect()}
    assert {x.doc_id: x.shard_ for x in back.collect()} == want
    sharding.write_shards(df.limit(0), f"{tmp_path}/none", 300)
