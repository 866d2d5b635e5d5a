"""Batches of an index merged in place."""

import pytest
from pyspark.sql import functions as F

from cellvote import Index, build_index, fit_tree, search
from cellvote.__main__ import run
from cellvote.operators.votes import answers
from cellvote.plans import index as module
from cellvote.plans.index import append_postings, joined, stretches
from cellvote.settings import new_table_path
from cellvote.streaming import jobs
from tests.conftest import clustered

ROWS = clustered(60, 3, seed=8)
KEY = ("leaf", "image_id", "desc_no")


@pytest.fixture(scope="module")
def points(spark):
    path = new_table_path(spark, "points")
    rows = [(f"{i:016x}", d, bytearray(v)) for i, d, v in ROWS]
    spark.createDataFrame(rows, jobs.POINTS_SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def tree(points):
    return fit_tree(points, k=2, depth=2, iterations=1)


def parts(points, tree, spark):
    """An index of three batches."""
    index = build_index(points.where("desc_no = 0"), tree, new_table_path(spark, "index"))
    append_postings(points.where("desc_no = 1"), tree, index.path, batch=7)
    append_postings(points.where("desc_no > 1"), tree, index.path, batch=8)
    return index


def rows(frame):
    return sorted(map(tuple, frame.select(*KEY).collect()))


def test_ranges_of_numbers():
    assert stretches([1, 2, 3, 5, 7, 8]) == [(1, 3), (5, 5), (7, 8)]
    assert joined([(4, 9), (1, 2), (3, 3), (12, 12), (5, 6)]) == [(1, 9), (12, 12)]


def test_merged_batches_hold_the_same(spark, points, tree):
    index, whole = parts(points, tree, spark), build_index(points, tree, new_table_path(spark, "whole"))
    reader = index.postings()  # begun before the merge
    asked = points.selectExpr("conv(image_id, 16, 10) AS query_id", "desc_no", "v")
    before = sorted(search(asked, index).collect())
    assert index.compact() == -1 and index.batches() == [-1]
    assert rows(reader) == rows(index.postings()) == rows(whole.postings())
    assert index.numbered().select("cell", "ord", *KEY[1:]).exceptAll(whole.numbered().select("cell", "ord", *KEY[1:])).isEmpty()
    assert sorted(index.cell_sizes().collect()) == sorted(whole.cell_sizes().collect())
    assert sorted(index.radii().collect()) == sorted(whole.radii().collect())
    assert index.vacuum() == [0, 7, 8] and index.vacuum() == []
    assert rows(index.postings()) == rows(whole.postings())
    assert sorted(search(asked, Index.open(spark, index.path)).collect()) == before
    assert answers(search(asked, index), asked).count() == 12
    assert index.compact() is None


def test_generations_follow_one_another(spark, points, tree):
    index = parts(points, tree, spark)
    index.compact()
    late = points.limit(0).unionByName(points.where("desc_no = 4").withColumn("desc_no", F.lit(99).cast("bigint")))
    append_postings(late, tree, index.path, batch=9)
    assert index.batches() == [-1, 9]
    # batch 8 written again, as a stream does after a failure, stays replaced
    append_postings(points.where("desc_no > 1"), tree, index.path, batch=8)
    assert index.batches() == [-1, 9]
    assert index.compact() == -2 and index.batches() == [-2]
    assert index.vacuum() == [-1, 0, 7, 8, 9]
    assert index.postings().count() == 60 + late.count()
    assert index.known(8, 8) and not index.known(10, 20)


def test_a_merge_that_dies_has_no_effect(spark, points, tree, monkeypatch):
    index = parts(points, tree, spark)
    expected = rows(index.postings())

    def half(*args, **options):
        write(*args, **options)
        raise RuntimeError("lost")

    write = module.write_postings
    monkeypatch.setattr(module, "write_postings", half)
    with pytest.raises(RuntimeError, match="lost"):
        index.compact()
    assert index.batches() == [0, 7, 8] and rows(index.postings()) == expected and index.vacuum() == []
    monkeypatch.undo()
    assert index.compact() == -1 and rows(index.postings()) == expected


def test_a_thousand_batches_are_one_range(spark, points, tree):
    index = build_index(points.where("desc_no = 0"), tree, new_table_path(spark, "index"))
    few = index.postings()._jdf.queryExecution().analyzed().toString()
    many = spark.range(1, 1001).select(
        F.lit(0).alias("leaf"), F.col("id").alias("batch"), F.lit(0).cast("bigint").alias("part"),
        F.lit(0).cast("bigint").alias("first_row"), F.lit(1).cast("bigint").alias("n"),
    )
    many.coalesce(1).write.mode("append").partitionBy("batch").parquet(f"{index.path}/runs")
    filed = many.select(
        "leaf", F.lit(0).cast("bigint").alias("row"), F.lpad(F.hex("batch"), 16, "0").alias("image_id"),
        F.lit(0).cast("bigint").alias("desc_no"), F.unhex(F.lit("010203")).alias("v"), "batch", F.lit(0).alias("cell0"),
    )
    filed.coalesce(1).write.mode("append").partitionBy("batch", "cell0").parquet(f"{index.path}/postings")
    text = index.postings()._jdf.queryExecution().analyzed().toString()
    assert len(index.batches()) == 1001 and len(text) < len(few) + 200
    assert index.postings().count() == 1012
    index.compact()
    assert index.batches() == [-1] and index.postings().count() == 1012
    generation = spark.read.parquet(f"{index.path}/merges").collect()
    assert [(row.first, row.last, row.batch) for row in generation] == [(0, 1000, -1)]


def test_ingest_and_compaction_from_the_shell(spark, points, tree, tmp_path):
    index = build_index(points.where("desc_no = 0"), tree, new_table_path(spark, "index"))
    source, state = (new_table_path(spark, name) for name in ("in", "state"))
    points.where("desc_no > 0").write.parquet(source)
    run(spark, ["ingest", source, index.path, state, "--once"])
    assert len(index.batches()) == 2 and index.postings().count() == 60
    run(spark, ["compact", index.path, "--vacuum"])
    assert index.batches() == [-1] and index.postings().count() == 60


def test_listing_from_the_shell(spark, tmp_path, capsys):
    for name in ("0123456789abcdef.jpg", "1123456789abcdef.jpg", "bad.jpg"):
        (tmp_path / name).write_bytes(b"x")
    listed = new_table_path(spark, "listed")
    run(spark, ["images", str(tmp_path), listed, "--marker", "1123456789abcdef.jpg"])
    assert [row.image_id for row in spark.read.parquet(listed).collect()] == ["1123456789abcdef"]
    assert "1 listed, 1 rejected" in capsys.readouterr().out
