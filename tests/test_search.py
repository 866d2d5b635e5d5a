import random
import re

import pytest
from pyspark.sql import functions as F

from cellvote import Index, Limits, build_index, fit_tree, search, search_votes
from cellvote.operators import votes
from cellvote.plans.index import append_postings, leaf_ranges
from cellvote.plans.search import leaves_hit, nearest_candidates, route
from cellvote.settings import new_table_path
from tests import model
from tests.conftest import clustered

# Broadcast only what fits 0 bytes, and cut every leaf into blocks of 4 rows.
SHUFFLED = Limits(broadcast_bytes=0, block_rows=4)


@pytest.fixture(scope="module")
def stored(spark):
    rows = clustered(120, 4, seed=11)
    data = [(f"{i:016x}", d, bytearray(v)) for i, d, v in rows]
    points = spark.createDataFrame(data, "image_id STRING, desc_no BIGINT, v BINARY")
    tree = fit_tree(points, k=3, depth=2, iterations=2)
    return rows, points, build_index(points, tree, new_table_path(spark, "index-test"))


def query_frame(spark, rows):
    data = [(q, d, bytearray(v)) for q, d, v in rows]
    return spark.createDataFrame(data, "query_id BIGINT, desc_no BIGINT, v BINARY").repartition(3)


def levels_of(index):
    return [lv.array.astype(int).tolist() for lv in index.tree.levels]


@pytest.mark.parametrize("limits", [Limits(), SHUFFLED], ids=["broadcast", "shuffled"])
@pytest.mark.parametrize("limit", [0, 5, 1000])
def test_search_equals_the_plain_model(spark, stored, limits, limit):
    rows, _, index = stored
    queries = [(i, d, v) for i, d, v in rows if i % 2 == 0]
    found = search(query_frame(spark, queries), index, vote_limit=limit, limits=limits)
    got = sorted((r.query_id, r["rank"], int(r.image_id, 16), r.votes) for r in found.collect())
    assert got == model.search(rows, queries, levels_of(index), 3, limit)


def test_both_plans_give_the_same_candidates_with_a_beam(spark, stored):
    rows, _, index = stored
    queries = query_frame(spark, [(i, d, v) for i, d, v in rows])
    frames = [
        nearest_candidates(queries, index, vote_limit=3, n_probe=4, limits=limits).collect()
        for limits in (Limits(), SHUFFLED)
    ]
    assert sorted(frames[0]) == sorted(frames[1]) and frames[0]


def test_probing_every_leaf_is_the_exact_search(spark, stored):
    rows, _, index = stored
    queries = [(i, d, v) for i, d, v in rows]
    got = nearest_candidates(query_frame(spark, queries), index, vote_limit=4, n_probe=9)
    found = {(r.query_id, r.desc_no, int(r.image_id, 16)) for r in got.collect()}
    expected = {
        (q, d, image)
        for q, d, v in queries
        for image in model.vote_cut([(model.l1(v, w), i) for i, _, w in rows], 4)
    }
    assert found == expected


def test_indexed_image_finds_itself(spark, stored):
    rows, _, index = stored
    queries = query_frame(spark, rows)
    own = nearest_candidates(queries, index).where((F.col("dist") == 0) & (F.conv("image_id", 16, 10) == F.col("query_id")))
    assert own.select("query_id", "desc_no").distinct().count() == len(rows)


def test_votes_grow_with_the_limit(spark, stored):
    rows, _, index = stored
    queries = query_frame(spark, rows[:40])
    small, large = (set(search_votes(queries, index, vote_limit=n).collect()) for n in (1, 8))
    assert small < large


def candidate_frame(spark, pairs):
    data = [(0, 0, dist, image) for dist, image in pairs]
    return spark.createDataFrame(data, "query_id BIGINT, desc_no BIGINT, dist INT, image_id STRING")


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("limit, images", [(1, "a"), (2, "abc"), (0, "a"), (-1, "a"), (4, "abcd"), (99, "abcd")])
def test_vote_cut_takes_whole_distance_groups(spark, limit, images, small):
    rows = candidate_frame(spark, [(3, "a"), (3, "a"), (5, "b"), (5, "c"), (7, "d")])
    kept = votes.votes_of(votes.cut_candidates(rows, limit, small_queries=small))
    assert sorted(r.image_id for r in kept.collect()) == list(images)


def test_vote_cut_equals_the_loop_on_random_data(spark):
    rng = random.Random(5)
    data = [
        (q, d, rng.randrange(12), f"i{rng.randrange(6)}") for q in range(3) for d in range(4) for _ in range(rng.randrange(1, 40))
    ]
    frame = spark.createDataFrame(data, "query_id BIGINT, desc_no BIGINT, dist INT, image_id STRING").repartition(5)
    for limit in (-1, 0, 1, 5, 10, 100):
        kept = votes.votes_of(votes.cut_candidates(frame, limit, small_queries=True)).collect()
        expected = {
            (q, d, i)
            for q in range(3)
            for d in range(4)
            for i in model.vote_cut([(x, image) for a, b, x, image in data if (a, b) == (q, d)], limit)
        }
        assert {tuple(r) for r in kept} == expected


def test_top_images(spark):
    counts = spark.createDataFrame(
        [(1, "a", 3), (1, "b", 1), (1, "c", 2), (1, "d", 2)] + [(2, f"i{n:02}", 2) for n in range(12)],
        "query_id BIGINT, image_id STRING, votes BIGINT",
    )
    ranked = votes.top_images(counts)
    got = [(r["rank"], r.image_id, r.votes) for r in ranked.where("query_id = 1").orderBy("rank").collect()]
    assert got == [(1, "a", 3), (2, "c", 2), (3, "d", 2)]
    ten = [r.image_id for r in ranked.where("query_id = 2").orderBy("rank").collect()]
    assert ten == [f"i{n:02}" for n in range(10)]
    assert {r.answer for r in votes.answers(ranked).where("query_id = 1").collect()} == {"a:3 c:2 d:2"}
    assert sorted(votes.parsed_answers(votes.answers(ranked)).collect()) == sorted(ranked.collect())


@pytest.mark.parametrize("limits", [Limits(), SHUFFLED], ids=["broadcast", "shuffled"])
def test_empty_queries_give_an_empty_answer(spark, stored, limits):
    _, _, index = stored
    found = search(query_frame(spark, [(0, 0, [1, 2, 3, 4])]).where("false"), index, limits=limits)
    assert found.columns == ["query_id", "rank", "image_id", "votes"] and found.count() == 0


def test_leaf_without_postings_gives_no_candidates(spark, make_points):
    points = make_points(clustered(40, 2, seed=12))
    tree = fit_tree(points, k=2, depth=1, iterations=1)
    cell = tree.levels[0].array.tolist()
    path = new_table_path(spark, "one-leaf")
    index = build_index(points.where("false"), tree, path)
    append_postings(make_points([(1, 0, cell[0])]), tree, path, batch=1)
    queries = query_frame(spark, [(0, 0, cell[1]), (0, 1, cell[0])])
    assert [r.desc_no for r in search_votes(queries, index).collect()] == [1]


def test_null_ids_and_vectors_are_not_filed(spark, stored):
    _, _, index = stored
    for row, reason in (((None, 0, bytearray(4)), "null image id"), (("a" * 16, 0, None), "null descriptor")):
        points = spark.createDataFrame([row], "image_id STRING, desc_no BIGINT, v BINARY")
        with pytest.raises(Exception, match=reason):
            append_postings(points, index.tree, new_table_path(spark, "nulls"), batch=0)


def test_string_query_ids(spark, stored):
    rows, _, index = stored
    queries = query_frame(spark, rows[:20]).withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    assert {r.query_id for r in search(queries, index).collect()} <= {f"q{n}" for n in range(4)}


def test_index_ordinals_sizes_and_order(spark, stored):
    rows, points, index = stored
    numbered = index.numbered().collect()
    assert len(numbered) == len(rows)
    by_cell = {}
    for r in numbered:
        by_cell.setdefault(r.cell, []).append((r["ord"], r.image_id, r.desc_no))
    for members in by_cell.values():
        members.sort()
        assert [m[0] for m in members] == list(range(1, len(members) + 1))
        assert [m[1:] for m in members] == sorted(m[1:] for m in members)
    sizes = {r.cell: r.n for r in index.cell_sizes().collect()}
    assert sizes == {cell: len(m) for cell, m in by_cell.items()}
    top = {r.cell: r.n for r in index.cell_sizes(0).collect()}
    assert top == {c: sum(n for leaf, n in sizes.items() if leaf // 3 == c) for c in top}


def test_ordinals_over_several_files_and_batches(spark, make_points):
    rows = clustered(100, 3, seed=13)
    points = make_points(rows)
    tree = fit_tree(points, k=2, depth=1, iterations=1)
    path = new_table_path(spark, "many-files")
    index = build_index(points.where("desc_no < 3"), tree, path, limits=Limits(rows_per_file=7))
    append_postings(points.where("desc_no >= 3"), tree, path, batch=1, limits=Limits(rows_per_file=7))
    append_postings(points.where("desc_no >= 3"), tree, path, batch=1, limits=Limits(rows_per_file=7))
    numbered = index.numbered().collect()
    for cell in (0, 1):
        mine = sorted(r["ord"] for r in numbered if r.cell == cell)
        assert mine == list(range(1, len(mine) + 1))
    assert len(numbered) == 100 and len(index.postings().inputFiles()) > 8


def test_reopened_index_answers_the_same(spark, stored):
    rows, _, index = stored
    queries = query_frame(spark, rows[:30])
    again = Index.open(spark, index.path)
    assert sorted(search(queries, again).collect()) == sorted(search(queries, index).collect())


def test_scan_is_pruned_by_directory_and_leaf(spark, stored):
    _, _, index = stored
    plan = index.postings([0, 2])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*cell0", plan)
    assert re.search(r"PushedFilters: \[.*In\(leaf, \[0,2\]\)", plan)
    assert {r.leaf for r in index.postings([0, 2]).collect()} <= {0, 2}


def test_postings_are_read_once(spark, stored):
    rows, _, index = stored
    found = search(query_frame(spark, rows[:30]), index)
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("ReusedExchange") == 1
    assert "CartesianProduct" not in final and "BroadcastNestedLoopJoin" not in final


def test_leaf_ranges_cover_exactly_the_gaps(spark):
    leaves = [1, 2, 3, 10, 11, 50]
    ids = spark.range(60).select(F.col("id").cast("int").alias("leaf"))
    kept = [r.leaf for r in ids.where(leaf_ranges(F.col("leaf"), leaves, most=3)).collect()]
    assert kept == leaves
    two = [r.leaf for r in ids.where(leaf_ranges(F.col("leaf"), leaves, most=2)).collect()]
    assert two == [*range(1, 12), 50]
    assert ids.where(leaf_ranges(F.col("leaf"), [])).count() == 0


def test_leaves_hit(spark, stored):
    rows, _, index = stored
    queries = query_frame(spark, rows[:5])
    hit = {r.leaf for r in route(queries, index).collect()}
    assert {r.leaf for r in leaves_hit(route(queries, index), index).collect()} == hit
