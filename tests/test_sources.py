import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cellvote.operators import ingest
from cellvote.operators.levels import CENTERS_SCHEMA
from cellvote.settings import new_table_path
from cellvote.sources import descriptors, images, text
from tests.conftest import clustered


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_binary_scan_of_hand_made_records(spark, folder):
    with open(f"{folder}/a.bin", "wb") as out:
        out.write(bytes.fromhex("efcdab8967452301") + bytes([1, 255]) + b"\xff" * 8 + bytes([0, 7]))
    rows = descriptors.scan_descriptors(spark, folder, dim=2).orderBy("desc_no").collect()
    assert [(r.image_id, r.desc_no, list(r.v)) for r in rows] == [
        ("0123456789abcdef", 0, [1, 255]),
        ("ffffffffffffffff", 1, [0, 7]),
    ]


def test_short_file_is_an_error(spark, folder):
    with open(f"{folder}/a.bin", "wb") as out:
        out.write(b"\x00" * (2 * 136 + 5))
    with pytest.raises(Exception, match="not a multiple of 136"):
        descriptors.scan_descriptors(spark, folder).collect()


def test_files_are_split_at_records(spark, folder, make_points):
    rows = clustered(25, 4, seed=3)
    with open(f"{folder}/all.bin", "wb") as out:
        for image, _, v in rows:
            out.write(image.to_bytes(8, "little") + bytes(v))
    back = descriptors.scan_descriptors(spark, folder, dim=4, split_bytes=100)
    assert back.rdd.getNumPartitions() == 4
    got = [(int(r.image_id, 16), list(r.v)) for r in back.orderBy("desc_no").collect()]
    assert got == [(image, v) for image, _, v in rows]


def test_empty_folder_gives_no_rows(spark, folder):
    assert descriptors.scan_descriptors(spark, folder).count() == 0


def test_binary_round_trip(spark, make_points):
    points = make_points(clustered(50, 128, seed=1))
    path = new_table_path(spark, "bin")
    descriptors.write_descriptors(points, path)
    back = descriptors.scan_descriptors(spark, path)
    assert sorted(back.select("image_id", "v").collect()) == sorted(points.select("image_id", "v").collect())
    assert not [name for name in os.listdir(path) if not name.endswith(".bin")]


def test_failed_export_leaves_no_file(spark, make_points):
    points = make_points([(0, 0, [1, 2]), (1, 0, [1, 2, 3])])
    path = new_table_path(spark, "bin")
    with pytest.raises(Exception, match="exactly 2"):
        descriptors.write_descriptors(points, path, dim=2)
    assert not os.path.exists(path) or not os.listdir(path)


def test_text_forms(spark, folder):
    with open(f"{folder}/query.txt", "w") as out:
        out.write("0\t0\t1 2 3 \n1\t0\t4 5.0 255 \n")
    rows = text.read_queries(spark, folder).orderBy("desc_no").collect()
    assert [(r.query_id, r.desc_no, list(r.v)) for r in rows] == [("query.txt", 0, [1, 2, 3]), ("query.txt", 1, [4, 5, 255])]


def test_center_and_index_lines(spark):
    path = new_table_path(spark, "lines")
    rows = [(0, 1, 0, 7, bytearray([1, 2])), (0, 0, 0, 3, bytearray([9, 0]))]
    centers = spark.createDataFrame(rows, CENTERS_SCHEMA)
    text.write_centers(centers, f"{path}/c")
    assert [r.value for r in spark.read.text(f"{path}/c").orderBy("value").collect()] == ["0\t3\t9 0", "1\t7\t1 2"]
    assert sorted(text.read_centers(spark, f"{path}/c", 0, 2).collect()) == sorted(centers.collect())
    rows = [(3, 1, "00000000000000ab", bytearray([5, 6]))]
    postings = spark.createDataFrame(rows, "cell INT, ord BIGINT, image_id STRING, v BINARY")
    text.write_index(postings, f"{path}/i")
    assert spark.read.text(f"{path}/i").head().value == "3\t1 00000000000000ab  5 6"
    assert text.read_index(spark, f"{path}/i").collect() == postings.collect()
    text.write_counts(spark.createDataFrame([(3, 9)], "cell INT, n BIGINT"), f"{path}/n")
    assert spark.read.text(f"{path}/n").head().value == "3\t9"


def test_listing_resumes_at_the_marker(spark, folder):
    for name in "abc":
        with open(f"{folder}/{name}", "wb") as out:
            out.write(b"xy")
    assert sorted(r.name for r in images.list_images(spark, folder).collect()) == ["a", "b", "c"]
    resumed = images.list_images(spark, folder, marker="b")
    assert sorted((r.name, r.length) for r in resumed.collect()) == [("b", 2), ("c", 2)]
    assert "content" not in resumed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_names_are_split_and_counted(spark):
    names = ["0123456789abcdef.jpg", "0123456789ABCDEF.png", "bad.jpg", "1" * 16]
    files = spark.createDataFrame([(n,) for n in names], "name STRING")
    valid, rejected = ingest.split_names(files)
    assert valid.count() == 3 and [r.name for r in rejected.collect()] == ["bad.jpg"]
    assert [tuple(r) for r in ingest.merged_ids(files).collect()] == [("0123456789abcdef", 2)]
    loaded = spark.createDataFrame([("1" * 16,)], "image_id STRING")
    assert {r.image_id for r in ingest.not_loaded(files, loaded).collect()} == {"0123456789abcdef"}


def test_matrices_become_descriptors(spark):
    frame = spark.createDataFrame([(7, [[1.9, 2.0], [255.0, 0.5]])], "query_id BIGINT, m ARRAY<ARRAY<FLOAT>>")
    rows = ingest.explode_descriptors(frame, "query_id", "m").orderBy("desc_no").collect()
    assert [(r.query_id, r.desc_no, list(r.v)) for r in rows] == [(7, 0, [1, 2]), (7, 1, [255, 0])]


def test_totals(spark, make_points):
    points = make_points(clustered(23, 2, seed=2))
    assert tuple(ingest.ingest_totals(points).head()) == (5, 23)
    assert tuple(ingest.ingest_totals(points.where(F.lit(False))).head()) == (0, 0)


def test_subfolders_are_scanned(spark, folder):
    for day in ("day1", "day2", "_hidden"):
        os.mkdir(f"{folder}/{day}")
        with open(f"{folder}/{day}/a.bin", "wb") as out:
            out.write(bytes(8) + bytes([1, 2]))
    assert descriptors.scan_descriptors(spark, folder, dim=2).count() == 2


def test_paths_are_qualified():
    assert descriptors.qualified("/a/b", "file:///") == "/a/b"
    assert descriptors.qualified("/a/b", "hdfs://name:8020") == "hdfs://name:8020/a/b"
    assert descriptors.qualified("s3a://bucket/a", "hdfs://name:8020") == "s3://bucket/a"
    with pytest.raises(ValueError, match="cannot open"):
        descriptors.qualified("dbfs:/a", None)


def test_exports_refuse_append_or_overwrite(spark, make_points):
    points = make_points(clustered(10, 2, seed=5))
    path = new_table_path(spark, "bin")

    def count():
        return descriptors.scan_descriptors(spark, path, dim=2).count()

    descriptors.write_descriptors(points, path, dim=2)
    with pytest.raises(ValueError, match="holds files"):
        descriptors.write_descriptors(points, path, dim=2)
    assert count() == 10
    descriptors.write_descriptors(points, path, dim=2, mode="append")
    assert count() == 20
    descriptors.write_descriptors(points.where("desc_no = 0"), path, dim=2, mode="overwrite")
    assert count() == 2
    with pytest.raises(Exception, match="exactly 3"):
        descriptors.write_descriptors(points, path, dim=3, mode="overwrite")
    assert count() == 2
    with pytest.raises(ValueError, match="mode is one of"):
        descriptors.write_descriptors(points, path, dim=2, mode="ignore")


def test_scans_stay_in_the_jvm(spark, folder):
    with open(f"{folder}/a.bin", "wb") as out:
        out.write(bytes(8) + bytes([1, 2]))
    text = descriptors.scan_descriptors(spark, folder, dim=2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "MapInArrow" not in text


def test_positions_count_within_each_file(spark, folder):
    for name, rows in (("a", 7), ("b", 5), ("empty", 0)):
        with open(f"{folder}/{name}.bin", "wb") as out:
            out.write(b"".join(i.to_bytes(8, "little") + bytes([i, ord(name[0])]) for i in range(rows)))
    rows = descriptors.scan_descriptors(spark, folder, dim=2, split_bytes=30)
    got = sorted((chr(r.v[1]), r.desc_no, r.v[0]) for r in rows.repartition(3).collect())
    assert got == [("a", i, i) for i in range(7)] + [("b", i, i) for i in range(5)]
