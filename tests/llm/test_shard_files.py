"""Files of shards hold every row once, whatever the ids."""

from cellvote.llm import sharding
from cellvote.settings import new_table_path

ROWS = [(1, "a b"), (1, "c"), (None, "d"), (2, "e f g"), (2, "e f g"), (None, None), (3, "")]


def test_every_row_is_written_once(spark):
    docs = spark.createDataFrame(ROWS, "doc_id BIGINT, text STRING").selectExpr("*", "7 AS slot", "8 AS shard", "9 AS range")
    path = new_table_path(spark, "shards")
    sharding.write_shards(docs, path, shards=3, files_per_shard=2)
    found = spark.read.parquet(path)
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=repr) == sorted(ROWS, key=repr)
    assert {(r.slot, r.shard_in, r.range) for r in found.collect()} == {(7, 8, 9)}
    sizes = {r.shard: r.n for r in found.selectExpr("shard", "coalesce(octet_length(text), 0) + 1 AS s").groupBy("shard").agg({"s": "sum"}).withColumnRenamed("sum(s)", "n").collect()}
    assert max(sizes.values()) - min(sizes.values()) <= 6


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    path = new_table_path(spark, "shards")
    sharding.write_shards(docs, path, shards=3)
    assert spark.read.schema("doc_id BIGINT, text STRING, shard INT").parquet(path).count() == 0
