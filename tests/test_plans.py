"""The physical plans keep the shape the design relies on."""

import re

import pytest

from cellvote import Limits, build_index, fit_tree, search
from cellvote.operators.assign import assign_cells
from cellvote.operators.passes import Clustered
from cellvote.operators.rounds import mean_centers, partial_sums
from cellvote.operators.seeds import find_seeds
from cellvote.operators.words import word_count
from cellvote.plans.search import route
from cellvote.settings import new_table_path
from tests.conftest import clustered


@pytest.fixture(scope="module")
def stored(spark):
    rows = [(f"{i:016x}", d, bytearray(v)) for i, d, v in clustered(100, 4, seed=31)]
    path = new_table_path(spark, "points")
    spark.createDataFrame(rows, "image_id STRING, desc_no BIGINT, v BINARY").write.parquet(path)
    points = spark.read.parquet(path)
    return points, fit_tree(points, k=2, depth=2, iterations=1)


def plan(frame):
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    return text


def exchanges(text):
    return len(re.findall(r"- Exchange ", text))


def test_round_reads_one_column_and_shuffles_once(stored):
    points, tree = stored
    text = plan(mean_centers(partial_sums(points, tree.levels), tree.dim))
    assert "ReadSchema: struct<v:binary>" in text and exchanges(text) == 1


def test_assignment_and_routing_do_not_shuffle(stored, spark):
    points, tree = stored
    assert exchanges(plan(assign_cells(points, tree.levels))) == 0
    index = build_index(points, tree, new_table_path(spark, "index"))
    queries = points.selectExpr("conv(image_id, 16, 10) AS query_id", "desc_no", "v")
    assert exchanges(plan(route(queries, index))) == 0


def test_deep_levels_are_walked_without_joins_or_shuffles(stored):
    points, tree = stored
    deep = Limits(broadcast_bytes=0, pass_bytes=1)
    clustered = Clustered.of(points, tree.levels, deep)
    text = plan(partial_sums(points, tree.levels, limits=deep, clustered=clustered))
    assert exchanges(text) == 0 and "Join" not in text
    assert exchanges(plan(assign_cells(points, tree.levels, limits=deep))) == 0
    assert clustered.parents == 1


def test_seeds_are_limited_before_the_shuffle(stored):
    points, tree = stored
    text = plan(find_seeds(points, tree.levels, 2, tree.dim))
    assert re.search(r"WindowGroupLimit .*Partial", text) and re.search(r"WindowGroupLimit .*Final", text)


def test_postings_are_not_shuffled_by_a_small_query_batch(stored, spark):
    points, tree = stored
    index = build_index(points, tree, new_table_path(spark, "index"))
    queries = points.selectExpr("conv(image_id, 16, 10) AS query_id", "desc_no", "v")
    text = plan(search(queries, index))
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert scans and all("ReadSchema: struct<leaf:int,image_id:string,v:binary>" in line for line in scans)
    # straight from the scan into the kernel
    assert re.search(r"MapInArrow scan[^\n]*\n(?:(?!Exchange).*\n)*?[^\n]*FileScan", text)


def test_small_searches_exchange_three_times(stored, spark):
    points, tree = stored
    index = build_index(points, tree, new_table_path(spark, "index"))
    queries = points.selectExpr("conv(image_id, 16, 10) AS query_id", "desc_no", "v")
    found = search(queries, index)
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"- Exchange hashpartitioning", final)) == 3


@pytest.mark.parametrize("limits", [Limits(broadcast_bytes=0), Limits(broadcast_bytes=4 * 64)])
def test_large_batches_prune_the_postings_and_route_once(stored, spark, limits):
    points, tree = stored
    index = build_index(points, tree, new_table_path(spark, "index"))
    queries = points.selectExpr("conv(image_id, 16, 10) AS query_id", "desc_no", "v")
    text = plan(search(queries, index, limits=limits))
    scans = [line for line in text.splitlines() if "FileScan" in line and "desc_no" in line and "cell0" in line]
    assert scans and all("cell0" in line.split("PartitionFilters")[1] and "leaf" in line.split("PushedFilters")[1] for line in scans)
    assert "MapInArrow walk" not in text and "MapInArrow meet" in text


def test_a_build_routes_once(stored, spark, monkeypatch):
    from cellvote.plans import index as module

    points, tree = stored
    scans = spark.sparkContext.accumulator(0)
    original = module.with_distances

    def counting(rows, *rest):
        def count(batches):
            for batch in batches:
                scans.add(batch.num_rows)
                yield batch

        return original(rows.mapInArrow(count, rows.schema), *rest)

    monkeypatch.setattr(module, "with_distances", counting)
    build_index(points, tree, new_table_path(spark, "index"))
    assert scans.value == points.count()


def test_word_count_combines_before_its_only_shuffle(spark):
    text = plan(word_count(spark.createDataFrame([("a b",)], "text STRING")))
    assert exchanges(text) == 1 and text.count("HashAggregate") == 2
