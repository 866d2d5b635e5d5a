import numpy as np
import pytest
from pyspark.sql import functions as F

from cellvote import Limits, TreeModel, fit_tree
from cellvote.operators import assign
from cellvote.operators.assign import assign_cells
from cellvote.operators.levels import Level
from cellvote.operators.rounds import run_round
from cellvote.operators.seeds import find_seeds
from cellvote.settings import new_table_path
from tests import model
from tests.conftest import clustered

JOINED = Limits(broadcast_bytes=0)


def as_lists(spark, tree):
    rows = tree.centers(spark).orderBy("level", "center_id").collect()
    out = [[] for _ in range(tree.depth)]
    for row in rows:
        assert row.center_id == len(out[row.level]) and row.parent_id == row.center_id // tree.k
        out[row.level].append(list(row.center))
    return out


def level(number, k, rows):
    array = np.array(rows, np.uint8)
    return Level(number, k, array.shape[1], array, np.zeros(len(array), np.int64))


@pytest.mark.parametrize("limits", [Limits(), JOINED], ids=["broadcast", "joined"])
def test_fit_equals_the_plain_model(spark, make_points, limits):
    rows = clustered(90, 4, seed=3)
    tree = fit_tree(make_points(rows), k=3, depth=2, iterations=2, limits=limits)
    assert as_lists(spark, tree) == model.fit(rows, 3, 2, 2)
    stats = {r.level: r for r in tree.stats(spark).collect()}
    assert [(stats[n].centers, stats[n].points) for n in (0, 1)] == [(3, 90), (9, 90)]


def test_fit_does_not_depend_on_partitioning(spark, make_points):
    rows = clustered(80, 4, seed=4)
    one = fit_tree(make_points(rows, 1), k=2, depth=2, iterations=1)
    many = fit_tree(make_points(rows[::-1], 7), k=2, depth=2, iterations=1)
    assert as_lists(spark, one) == as_lists(spark, many)
    assert one.shifts == many.shifts


def test_means_are_truncated(make_points):
    points = make_points([(0, 0, [1, 2]), (1, 0, [2, 3]), (2, 0, [200, 200])])
    new = run_round(points, [level(0, 2, [[1, 2], [200, 200]])])
    assert new.array.tolist() == [[1, 2], [200, 200]] and new.counts.tolist() == [2, 1]


def test_empty_cluster_is_kept_or_an_error(make_points):
    points = make_points([(0, 0, [1, 2]), (1, 0, [1, 2])])
    old = level(0, 2, [[1, 2], [200, 200]])
    new = run_round(points, [old])
    assert new.array.tolist() == [[1, 2], [200, 200]] and new.counts.tolist() == [2, 0]
    with pytest.raises(ValueError, match="got no points"):
        run_round(points, [old], empty="error")


def test_seeds_use_the_whole_vector(make_points):
    points = make_points([(0, 0, [1, 1]), (0, 1, [1, 1]), (1, 0, [2, 1]), (2, 0, [9, 9])])
    found = find_seeds(points, [], 2, 2).orderBy("center_id").collect()
    assert [(r.center_id, list(r.center)) for r in found] == [(0, [1, 1]), (1, [2, 1])]


def test_tree_ends_above_a_level_without_enough_distinct_vectors(make_points):
    rows = [(0, 0, [1, 1]), (0, 1, [2, 2]), (1, 0, [200, 200]), (1, 1, [200, 200])]
    tree = fit_tree(make_points(rows), k=2, depth=3, iterations=2, seeds=None)
    assert tree.depth == 1 and tree.n_leaves == 2


def test_bad_input_is_an_error(make_points):
    with pytest.raises(ValueError, match="no points"):
        fit_tree(make_points([(0, 0, [1])]).where("false"), k=2, depth=1, iterations=1)
    with pytest.raises(ValueError, match="distinct vectors"):
        fit_tree(make_points([(0, 0, [1]), (1, 0, [1])]), k=2, depth=1, iterations=1)
    with pytest.raises(ValueError):
        fit_tree(make_points([(0, 0, [1])]), k=1, depth=1, iterations=1)
    mixed = make_points([(0, 0, [1, 2]), (1, 0, [1, 2, 3]), (2, 0, [1, 2])], 1).orderBy("image_id")
    with pytest.raises(Exception, match="exactly 2"):
        fit_tree(mixed, k=2, depth=1, iterations=1)


def test_given_seeds_and_center_count(spark, make_points):
    points = make_points(clustered(30, 2, seed=5))
    given = level(0, 2, [[0, 0], [255, 255]]).frame(spark)
    tree = fit_tree(points, k=2, depth=1, iterations=0, seeds=given)
    assert as_lists(spark, tree) == [[[0, 0], [255, 255]]]
    with pytest.raises(ValueError, match="expected 2"):
        fit_tree(points, k=2, depth=1, iterations=0, seeds=given.where("center_id = 0"))


@pytest.mark.parametrize("limits", [Limits(), JOINED], ids=["broadcast", "joined"])
def test_save_and_load(spark, make_points, limits):
    tree = fit_tree(make_points(clustered(60, 3, seed=6)), k=2, depth=2, iterations=1, limits=limits)
    path = new_table_path(spark, "tree-test")
    tree.save(spark, path)
    again = TreeModel.load(spark, path, limits)
    assert as_lists(spark, again) == as_lists(spark, tree)
    assert (again.k, again.dim, again.depth, again.iterations) == (2, 3, 2, 1)
    spark.read.parquet(f"{path}/centers").where("center_id > 0").write.parquet(f"{path}-cut/centers")
    spark.read.parquet(f"{path}/meta").write.parquet(f"{path}-cut/meta")
    with pytest.raises(Exception, match="expected 2"):
        TreeModel.load(spark, f"{path}-cut", limits)


def test_fit_continues_from_snapshots(spark, make_points, monkeypatch):
    points = make_points(clustered(60, 3, seed=7))
    folder = new_table_path(spark, "snapshots")
    fit_tree(points, k=2, depth=1, iterations=2, snapshots=folder)
    whole = fit_tree(points, k=2, depth=2, iterations=2)
    calls = []
    monkeypatch.setattr("cellvote.plans.tree.run_round", lambda *a, **kw: calls.append(1) or run_round(*a, **kw))
    resumed = fit_tree(points, k=2, depth=2, iterations=2, snapshots=folder)
    assert as_lists(spark, resumed) == as_lists(spark, whole)
    assert len(calls) == 2  # level 0 came from the snapshots


def test_snapshots_belong_to_one_fit(spark, make_points):
    points, other = (make_points(clustered(40, 3, seed=s)) for s in (7, 8))
    folder = new_table_path(spark, "snapshots")
    fit_tree(points, k=2, depth=1, iterations=2, snapshots=folder)
    fit_tree(points.repartition(5), k=2, depth=1, iterations=2, snapshots=folder)
    for rows, k, iterations in ((other, 2, 2), (points, 3, 2), (points, 2, 3)):
        with pytest.raises(ValueError, match="another fit"):
            fit_tree(rows, k=k, depth=1, iterations=iterations, snapshots=folder)


def test_early_stop_when_centers_rest(spark, make_points):
    points = make_points([(0, 0, [1, 1]), (1, 0, [9, 9])])
    tree = fit_tree(points, k=2, depth=1, iterations=9, tol=0)
    assert tree.shifts == [(0, 1, 0)]


@pytest.mark.parametrize("n_probe", [1, 2, 4])
def test_joined_descent_equals_the_broadcast_one(spark, make_points, n_probe, monkeypatch):
    monkeypatch.setattr(assign, "BEAM_CELLS", 48)  # several steps per batch
    points = make_points(clustered(70, 4, seed=8))
    tree = fit_tree(points, k=2, depth=3, iterations=1)
    frames = [
        assign_cells(points, tree.levels, n_probe=n_probe, limits=limits)
        for limits in (Limits(), JOINED, Limits(broadcast_bytes=2 * 4 + 4 * 4))  # the last: two levels of three
    ]
    rows = [sorted((r.image_id, r.desc_no, r.cell) for r in f.collect()) for f in frames]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 70 * n_probe
    with pytest.raises(ValueError, match="n_probe"):
        assign_cells(points, tree.levels, n_probe=0)


def test_points_with_equal_keys_keep_their_cells_in_both_forms(spark, make_points):
    rows = [(i // 4, 0, v) for i, _, v in clustered(24, 3, seed=5)]
    points = make_points([*rows, rows[0], rows[0]])
    tree = fit_tree(points, k=2, depth=3, iterations=1)
    found = [
        sorted((r.image_id, bytes(r.v), r.cell) for r in assign_cells(points, tree.levels, n_probe=2, limits=x).collect())
        for x in (Limits(), JOINED)
    ]
    assert found[0] == found[1] and len(found[0]) == 26 * 2


def test_every_point_is_in_its_nearest_cell(make_points):
    rows = clustered(60, 3, seed=9)
    points = make_points(rows)
    tree = fit_tree(points, k=3, depth=2, iterations=1)
    levels = [lv.array.astype(int).tolist() for lv in tree.levels]
    expected = {(f"{i:016x}", d): model.descend(v, levels, 3) for i, d, v in rows}
    for number in (0, 1):
        cells = assign_cells(points, tree.levels[: number + 1])
        got = {(r.image_id, r.desc_no): r.cell for r in cells.collect()}
        assert got == {key: leaf // 3 ** (1 - number) for key, leaf in expected.items()}
    assert cells.where(F.col("cell").isNull()).count() == 0
