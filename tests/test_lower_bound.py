"""Lower bounds of L1 distances, the candidates of one task, and work dealt out by comparisons."""

import numpy as np
import pyarrow as pa
import pytest

from cellvote.operators import kernels
from cellvote.operators.candidates import Nearest
from cellvote.plans import search as plan
from cellvote.plans.index import build_index
from cellvote.plans.search import dealt_postings, nearest_candidates
from cellvote.plans.tree import fit_tree
from cellvote.settings import Limits
from tests.conftest import clustered


def plain(a, b):
    return np.abs(a[:, None].astype(int) - b[None].astype(int)).sum(2)


@pytest.mark.parametrize("dim", [1, 64, 300])
def test_bound_is_never_above_the_distance(dim):
    rng = np.random.default_rng(dim)
    x = np.concatenate([rng.integers(0, 256, (60, dim)), rng.integers(120, 140, (60, dim)), np.zeros((2, dim)), np.full((2, dim), 255)])
    x = x.astype(np.uint8)
    for sample in (x, x[:1], x[:0]):
        lower = kernels.LowerBound(sample)
        assert (lower.left(x) @ lower.right(x).T <= plain(x, x) + lower.slack(dim)).all()
    i, j = np.divmod(np.arange(len(x) ** 2), len(x))
    assert (kernels.l1_pairs(x, i, x, j) == plain(x, x).ravel()).all()
    assert (kernels.l1_matrix(x[:5], x) == plain(x[:5], x)).all()


@pytest.mark.parametrize("limit", [0, 5, 90])
def test_a_task_keeps_all_inside_the_cut_and_drops_most(limit):
    rng = np.random.default_rng(limit)
    queries, x = (rng.integers(90, 160, (n, 32)).astype(np.uint8) for n in (300, 6000))
    x[100:200], x[5000] = x[0], queries[0]
    images = pa.array([f"{i % 3000:016x}" for i in range(len(x))])
    keys = [pa.array(np.arange(len(queries))), pa.array(np.zeros(len(queries), np.int64))]
    nearest = Nearest(keys, queries, limit, np.full(len(queries), np.iinfo(np.int32).max, np.int32))
    batches = [b for at in range(0, 6000, 2500) for b in nearest.meet(np.arange(300), x[at : at + 2500], images[at : at + 2500])]
    batches += nearest.rest()
    found = {}
    for row in pa.Table.from_batches(batches).to_pylist():
        key = row["query_id"], row["dist"], row["image_id"]
        found[key] = found.get(key, 0) + row["n"]
    dist = plain(queries, x)
    cut = np.sort(dist, axis=1)[:, limit]
    expected = {}
    for q, p in zip(*np.nonzero(dist <= cut[:, None])):
        key = int(q), int(dist[q, p]), images[int(p)].as_py()
        expected[key] = expected.get(key, 0) + 1
    assert found == expected


@pytest.fixture(scope="module")
def filed(spark, tmp_path_factory):
    rows = [(f"{image:016x}", desc, bytearray(v)) for image, desc, v in clustered(600, 8, 4)]
    points = spark.createDataFrame(rows, "image_id STRING, desc_no BIGINT, v BINARY").cache()
    tree = fit_tree(points, k=3, depth=2, iterations=2)
    return points, build_index(points, tree, str(tmp_path_factory.mktemp("index") / "i"))


def test_every_task_has_its_share_of_the_comparisons(filed, monkeypatch):
    """Before, a scan's tasks had as many postings each, or all in one, however many queries came to them."""
    points, index = filed
    for name, value in (("DEALT_VISITS", 1), ("LEAST_PAIRS", 1), ("BOUNDED_PAIRS", 10_000)):
        monkeypatch.setattr(plan, name, value)
    leaves = np.repeat(np.arange(9, dtype=np.int32), 600)
    dealt = dealt_postings(index.postings(), index, leaves, True)
    sizes = dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 36 and sum(sizes) == 600
    assert max(sizes) * 600 < 3 * 10_000
    columns = ["leaf", "image_id", "v"]
    assert sorted(dealt.select(columns).collect()) == sorted(index.postings().select(columns).collect())


@pytest.mark.parametrize("limits", [Limits(), Limits(broadcast_bytes=0, block_rows=50)])
def test_dealt_and_blocked_searches_of_all_leaves_are_exact(filed, monkeypatch, limits):
    points, index = filed
    for name, value in (("DEALT_VISITS", 1), ("LEAST_PAIRS", 1), ("BOUNDED_PAIRS", 10_000), ("TASK_PAIRS", 10_000)):
        monkeypatch.setattr(plan, name, value)
    queries = points.selectExpr("conv(image_id, 16, 10) % 40 AS query_id", "desc_no", "v")
    queries = queries.unionByName(queries.limit(7))  # equal rows
    got = nearest_candidates(queries, index, vote_limit=4, n_probe=9, limits=limits)
    asked, stored = queries.collect(), points.collect()
    dist = plain(*(np.array([list(r.v) for r in rows]) for rows in (asked, stored)))
    pairs = {}
    for q, row in zip(asked, dist):
        pairs.setdefault((q.query_id, q.desc_no), []).extend((int(d), p.image_id) for d, p in zip(row, stored))
    expected = {}
    for (query, desc), found in pairs.items():
        cut = sorted(d for d, _ in found)[4]
        for d, image in found:
            if d <= cut:
                expected[query, desc, d, image] = expected.get((query, desc, d, image), 0) + 1
    assert {tuple(r)[:4]: r.n for r in got.select("query_id", "desc_no", "dist", "image_id", "n").collect()} == expected
