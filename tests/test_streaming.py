import pytest

from cellvote import build_index, fit_tree, search
from cellvote.settings import new_table_path
from cellvote.sources.text import write_queries
from cellvote.streaming import jobs
from tests.conftest import clustered

ROWS = clustered(60, 3, seed=21)


@pytest.fixture(scope="module")
def index(spark):
    points = spark.createDataFrame([(f"{i:016x}", d, bytearray(v)) for i, d, v in ROWS], jobs.POINTS_SCHEMA)
    tree = fit_tree(points, k=2, depth=2, iterations=1)
    return build_index(points, tree, new_table_path(spark, "stream-index"))


def queries(spark, images):
    rows = [(i, d, bytearray(v)) for i, d, v in ROWS if i in images]
    return spark.createDataFrame(rows, jobs.QUERY_SCHEMA)


def test_answers_equal_the_batch_and_restart_adds_nothing_twice(spark, index):
    source, out, state = (new_table_path(spark, name) for name in ("in", "out", "state"))

    def drain():
        stream = jobs.query_stream(spark, source, files_per_batch=1)
        jobs.stream_search(stream, index, out, state).awaitTermination()
        return sorted(spark.read.parquet(out).select("query_id", "rank", "image_id", "votes").collect())

    for images in ({0, 1}, {2}):
        queries(spark, images).coalesce(1).write.mode("append").parquet(source)
    assert drain() == sorted(search(queries(spark, {0, 1, 2}), index).collect())
    queries(spark, {5}).coalesce(1).write.mode("append").parquet(source)
    expected = sorted(search(queries(spark, {0, 1, 2, 5}), index).collect())
    assert drain() == expected
    assert drain() == expected


def test_text_query_files(spark, index):
    source, out, state = (new_table_path(spark, name) for name in ("in", "out", "state"))
    write_queries(queries(spark, {4}).coalesce(1), source)
    stream = jobs.text_query_stream(spark, f"{source}/query_id=4")
    jobs.stream_search(stream, index, out, state).awaitTermination()
    got = sorted((r["rank"], r.image_id, r.votes) for r in spark.read.parquet(out).collect())
    assert got == sorted((r["rank"], r.image_id, r.votes) for r in search(queries(spark, {4}), index).collect())
    assert got


def test_ingest_appends_each_file_once(spark, index):
    points = index.postings().select("image_id", "desc_no", "v")
    path, source, state = (new_table_path(spark, name) for name in ("index", "in", "state"))
    grown = build_index(points.where("desc_no = 0"), index.tree, path)
    for n in (1, 2):
        points.where(f"desc_no = {n}").coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        jobs.stream_ingest(jobs.point_stream(spark, source, files_per_batch=1), grown, state).awaitTermination()
    points.where("desc_no > 2").coalesce(1).write.mode("append").parquet(source)
    jobs.stream_ingest(jobs.point_stream(spark, source), grown, state).awaitTermination()
    key = ("leaf", "image_id", "desc_no")
    assert sorted(grown.postings().select(*key).collect()) == sorted(index.postings().select(*key).collect())
    assert sorted(grown.cell_sizes().collect()) == sorted(index.cell_sizes().collect())


def test_two_streams_share_a_target(spark, index):
    points = index.postings().select("image_id", "desc_no", "v")
    grown = build_index(points.where("desc_no = 0"), index.tree, new_table_path(spark, "index"))
    for n in (1, 2):
        source, state = (new_table_path(spark, name) for name in ("in", "state"))
        points.where(f"desc_no = {n}").write.parquet(source)
        jobs.stream_ingest(jobs.point_stream(spark, source), grown, state).awaitTermination()
    assert grown.postings().count() == points.where("desc_no < 3").count()
    out = new_table_path(spark, "out")
    for images in ({0}, {1}):
        source, state = (new_table_path(spark, name) for name in ("in", "state"))
        queries(spark, images).coalesce(1).write.parquet(source)
        jobs.stream_search(jobs.query_stream(spark, source), index, out, state).awaitTermination()
    answered = {r.query_id for r in spark.read.parquet(out).collect()}
    assert answered == {0, 1}


def test_an_index_folder_is_not_built_over(spark, index):
    with pytest.raises(ValueError, match="holds an index"):
        build_index(index.postings().select("image_id", "desc_no", "v"), index.tree, index.path)


def test_text_queries_from_the_root_folder(spark, index):
    source, out, state = (new_table_path(spark, name) for name in ("in", "out", "state"))
    write_queries(queries(spark, {3, 4, 5}).repartition(3), source)
    jobs.stream_search(jobs.text_query_stream(spark, source), index, out, state).awaitTermination()
    got = sorted((int(r.query_id), r["rank"], r.image_id, r.votes) for r in spark.read.parquet(out).collect())
    assert got == sorted(map(tuple, search(queries(spark, {3, 4, 5}), index).collect()))


def test_every_query_gets_a_reply(spark, index):
    source, out, state, replies = (new_table_path(spark, name) for name in ("in", "out", "state", "replies"))
    far = spark.createDataFrame([(77, 0, bytearray([255] * index.tree.dim))], jobs.QUERY_SCHEMA)
    queries(spark, {0, 1}).unionByName(far).coalesce(1).write.parquet(source)
    stream = jobs.query_stream(spark, source)
    jobs.stream_search(stream, index, out, state, vote_limit=0, replies_path=replies).awaitTermination()
    got = {r.query_id: r.answer for r in spark.read.parquet(replies).collect()}
    assert got.keys() == {0, 1, 77} and got[77] == ""


def test_streams_keep_their_number_when_moved_and_lose_it_with_their_state(spark, tmp_path):
    here, there = str(tmp_path / "here"), str(tmp_path / "there")
    number = jobs.stream_number(spark, here, lambda n: False)
    assert jobs.stream_number(spark, here + "/", lambda n: True) == number
    assert jobs.stream_number(spark, f"file://{here}", lambda n: True) == number
    (tmp_path / "here").rename(tmp_path / "there")
    assert jobs.stream_number(spark, there, lambda n: True) == number
    tried = []
    fresh = jobs.stream_number(spark, here, lambda n: tried.append(n) or len(tried) < 3)
    assert len(tried) == 3 and fresh == tried[-1] != number


def test_a_lost_checkpoint_overwrites_nothing(spark, index):
    points = index.postings().select("image_id", "desc_no", "v")
    path, one, two = (new_table_path(spark, name) for name in ("index", "in", "in"))
    grown = build_index(points.where("desc_no = 0"), index.tree, path)
    for source, number in ((one, 1), (two, 2)):  # two states, each counting from 0
        points.where(f"desc_no = {number}").coalesce(1).write.parquet(source)
        state = new_table_path(spark, "state")
        jobs.stream_ingest(jobs.point_stream(spark, source), grown, state).awaitTermination()
    assert grown.postings().count() == points.where("desc_no < 3").count()
