"""Searches, rounds and seeds beyond the bounds of one task, and exact search."""

import numpy as np
import pyarrow as pa
import pytest

from cellvote import Index, Limits, TreeModel, build_index, fit_tree, search
from cellvote.operators import seeds
from cellvote.operators.assign import assign_cells
from cellvote.plans.exact import exact_candidates, visits
from cellvote.plans.index import append_postings, import_index
from cellvote.plans.search import nearest_candidates
from cellvote.settings import drop_table, new_table_path
from cellvote.sources import text
from tests.conftest import clustered

DEEP = [Limits(broadcast_bytes=0, pass_bytes=1), Limits(broadcast_bytes=0, pass_bytes=30), Limits(broadcast_bytes=40, pass_bytes=1)]


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def as_queries(points):
    return points.selectExpr("cast(conv(image_id, 16, 10) AS bigint) AS query_id", "desc_no", "v")


@pytest.fixture(scope="module")
def stored(spark):
    data = [(f"{i:016x}", d, bytearray(v)) for i, d, v in clustered(300, 4, seed=8)]
    path = new_table_path(spark, "large-points")
    spark.createDataFrame(data, "image_id STRING, desc_no BIGINT, v BINARY").write.parquet(path)
    points = spark.read.parquet(path)
    tree = fit_tree(points, k=3, depth=3, iterations=1)
    return points, tree, build_index(points, tree, new_table_path(spark, "large-index"))


@pytest.mark.parametrize("limits", DEEP)
def test_trees_in_passes_equal_resident_ones(spark, stored, limits):
    points, tree, _ = stored
    deep = fit_tree(points, k=3, depth=3, iterations=1, limits=limits)
    assert deep.levels[-1].array is None
    assert rows(deep.centers(spark)) == rows(tree.centers(spark))
    for n_probe in (1, 2, 5):
        want = rows(assign_cells(points, tree.levels, n_probe=n_probe))
        assert rows(assign_cells(points, deep.levels, n_probe=n_probe, limits=limits)) == want
    assert assign_cells(points.limit(0), deep.levels, limits=limits).collect() == []


def plain_exact(queries, points, limit):
    """query_id, desc_no, dist, image_id, n by comparing all with all."""
    out = {}
    stored = [(p.image_id, np.frombuffer(p.v, np.uint8).astype(int)) for p in points]
    found = {}
    for q in queries:
        v = np.frombuffer(q.v, np.uint8).astype(int)
        found.setdefault((q.query_id, q.desc_no), []).extend((int(np.abs(v - w).sum()), image) for image, w in stored)
    for key, near in found.items():
        dists = sorted(d for d, _ in near)
        cut = dists[min(max(limit, 0), len(dists) - 1)]
        for dist, image in near:
            if dist <= cut:
                out[(*key, dist, image)] = out.get((*key, dist, image), 0) + 1
    return sorted(((*key, n) for key, n in out.items()), key=repr)


@pytest.mark.parametrize("limits", [Limits(), Limits(broadcast_bytes=0), Limits(broadcast_bytes=40)])
@pytest.mark.parametrize("vote_limit", [0, 3, 5000])
def test_exact_search_compares_with_all(spark, stored, limits, vote_limit):
    points, tree, index = stored
    queries = as_queries(points.where("desc_no < 2"))
    some = queries.limit(30).unionByName(queries.limit(2))  # rows that are equal too
    path = new_table_path(spark, "exact-queries")
    some.write.parquet(path)
    some = spark.read.parquet(path)
    index = Index(spark, index.path, TreeModel.load(spark, f"{index.path}/tree", limits))
    found = exact_candidates(some, index, vote_limit=vote_limit, limits=limits)
    assert rows(found) == plain_exact(some.collect(), points.collect(), vote_limit)
    if limits == Limits() and vote_limit < 100:
        assert visits(some, index, vote_limit=vote_limit).count() < some.count() * tree.n_leaves
        assert rows(found) == rows(nearest_candidates(some, index, vote_limit=vote_limit, n_probe=tree.n_leaves))


def test_exact_search_sees_appended_batches_and_far_queries(spark, stored):
    points, tree, _ = stored
    index = build_index(points.limit(40), tree, new_table_path(spark, "grown"))
    append_postings(points.exceptAll(points.limit(40)), tree, index.path, batch=1)
    far = spark.createDataFrame([(1, 0, bytearray([255, 0, 255, 0])), (2, 0, bytearray([0, 0, 0, 0]))], "query_id BIGINT, desc_no BIGINT, v BINARY")
    held = index.postings().collect()
    assert rows(exact_candidates(far, index, vote_limit=4)) == plain_exact(far.collect(), held, 4)
    assert search(far.limit(0), index, exact=True).collect() == []


def test_equal_vectors_stream_through_blocks(spark):
    """One leaf, all vectors alike: every candidate is inside the cut."""
    data = [(f"{i // 4:016x}", i % 4, bytearray([7, 7])) for i in range(400)] + [("f" * 16, 0, bytearray([9, 0]))]
    points = spark.createDataFrame(data, "image_id STRING, desc_no BIGINT, v BINARY").cache()
    tree = fit_tree(points, k=2, depth=1, iterations=1)
    index = build_index(points, tree, new_table_path(spark, "alike"))
    queries = as_queries(points.where("image_id < '0000000000000010'"))
    limits = Limits(broadcast_bytes=0, block_rows=50)
    want = rows(search(queries, index, top=200, vote_limit=3))
    assert rows(search(queries, index, top=200, vote_limit=3, limits=limits)) == want and len(want) == 16 * 100
    assert {r[3] for r in want} == {4}


def test_trees_and_indexes_come_from_text(spark, stored, tmp_path):
    points, tree, index = stored
    paths = [str(tmp_path / f"level{level.number}") for level in tree.levels]
    for level, path in zip(tree.levels, paths):
        text.write_centers(level.frame(spark), path)
    text.write_index(index.numbered(), str(tmp_path / "index"))
    for limits in (Limits(), Limits(broadcast_bytes=0)):
        read = TreeModel.from_text(spark, paths, k=3, limits=limits)
        assert rows(read.centers(spark)) == rows(tree.centers(spark))
        copy = import_index(text.read_index(spark, str(tmp_path / "index")), read, new_table_path(spark, "copy"), limits=limits)
        assert rows(copy.cell_sizes()) == rows(index.cell_sizes())
        queries = as_queries(points)
        assert rows(search(queries, copy)) == rows(search(queries, index))
        assert rows(search(queries, copy, exact=True)) == rows(search(queries, index, exact=True))
    with pytest.raises(ValueError, match="expected"):
        TreeModel.from_text(spark, [paths[1]], k=3)
    with pytest.raises(ValueError, match="no center files"):
        TreeModel.from_text(spark, [], k=3)
    strange = text.read_index(spark, str(tmp_path / "index")).selectExpr("cell + 27 AS cell", "ord", "image_id", "v")
    with pytest.raises(Exception, match="no leaf"):
        import_index(strange, tree, new_table_path(spark, "strange"))


def batch_of(parents, images, vectors):
    columns = [pa.array(images), pa.array(range(len(images)), pa.int64()), pa.array(vectors, pa.binary()), pa.array(parents, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["image_id", "desc_no", "v", "parent"])


def test_seeds_keep_the_parents_met_only():
    """Ten million parents, of which a task meets a few hundred."""
    found = seeds._Survivors(2, 1, held_bytes=0)
    rng = np.random.default_rng(0)
    met = rng.choice(10_000_000, 300, replace=False)
    handed = []
    for start in range(0, 40_000, 4_000):
        parents = rng.choice(met, 4_000)
        images = [f"{start + i:08d}" for i in range(4_000)]
        found.add(batch_of(parents, images, [bytes([v]) for v in rng.integers(0, 50, 4_000)]))
        handed += found.overflow()
    handed += found.flush()
    assert len(found.full) <= 300
    assert sum(batch.num_rows for batch in handed) < 2_000


def test_seeds_handed_on_early_are_the_same(spark, stored, monkeypatch):
    points, tree, _ = stored
    want = rows(seeds.find_seeds(points, tree.levels[:2], 3, 4))
    monkeypatch.setattr(seeds, "BUFFER_ROWS", 4)
    monkeypatch.setattr(seeds, "HELD_BYTES", 0)
    found = seeds._Survivors(3, 4, 0)
    kept = []
    for batch in assign_cells(points, tree.levels[:2], column="parent").orderBy("desc_no").toArrow().to_batches(max_chunksize=7):
        found.add(batch.select(["image_id", "desc_no", "v", "parent"]))
        kept += found.overflow()
    kept += found.flush()
    local = spark.createDataFrame(pa.Table.from_batches(kept), seeds.SURVIVOR_SCHEMA)
    first = {}
    for r in sorted(local.collect(), key=lambda r: (r.parent, r.image_id, r.desc_no, r.v)):
        vectors = first.setdefault(r.parent, [])
        if r.v not in vectors and len(vectors) < 3:
            vectors.append(r.v)
    assert [v for p in sorted(first) for v in first[p]] == [r[-1] for r in sorted(want, key=lambda r: r[1])]


def test_only_own_tables_are_deleted(spark, tmp_path):
    with pytest.raises(ValueError):
        drop_table(spark, str(tmp_path))
