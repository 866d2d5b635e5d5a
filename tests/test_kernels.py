import numpy as np
import pyarrow as pa
import pytest

from cellvote.operators import kernels
from tests import model


def matrix(rows, dim, seed, high=256):
    return np.random.default_rng(seed).integers(0, high, (rows, dim), dtype=np.uint8)


def test_bytes_matrix_round_trip_and_slices():
    x = matrix(50, 7, 1)
    column = kernels.matrix_column(x)
    assert (kernels.bytes_matrix(column, 7) == x).all()
    assert (kernels.bytes_matrix(column.slice(10, 5), 7) == x[10:15]).all()
    assert kernels.bytes_matrix(column.slice(0, 0), 7).shape == (0, 7)


def test_bytes_matrix_rejects_nulls_and_other_lengths():
    with pytest.raises(ValueError, match="null"):
        kernels.bytes_matrix(pa.array([b"ab", None]), 2)
    with pytest.raises(ValueError, match="exactly 2"):
        kernels.bytes_matrix(pa.array([b"ab", b"abc", b"a"]), 2)


@pytest.mark.parametrize("na, nb", [(3, 3000), (3000, 3), (1, 1)])
def test_l1_matrix(na, nb):
    a, b = matrix(na, 9, 2), matrix(nb, 9, 3)
    expected = np.abs(a[:, None].astype(int) - b[None].astype(int)).sum(2)
    assert (kernels.l1_matrix(a, b) == expected).all()


def test_ties_go_to_the_lowest_id():
    centers = np.array([[4, 5], [6, 5]], np.uint8)
    assert kernels.descend(np.array([[5, 5]], np.uint8), [centers], 2).tolist() == [0]


def test_only_children_of_the_parent_count():
    centers = np.array([[5, 5], [9, 9], [0, 0], [6, 6]], np.uint8)
    cell = kernels.nearest_child(np.array([[5, 5]], np.uint8), np.array([1]), centers, 2)
    assert cell.tolist() == [3]


def test_descend_equals_plain_loop_over_many_chunks():
    k, x = 3, matrix(2500, 5, 4, high=12)
    levels = [matrix(k, 5, 5, high=12), matrix(k * k, 5, 6, high=12)]
    expected = [model.descend(v, [c.astype(int).tolist() for c in levels], k) for v in x.astype(int).tolist()]
    assert kernels.descend(x, levels, k).tolist() == expected


def test_beam_of_one_is_the_greedy_descent_and_of_all_is_everything():
    k, x = 3, matrix(40, 5, 7, high=12)
    levels = [matrix(k, 5, 8, high=12), matrix(k * k, 5, 9, high=12)]
    rows, cells = kernels.descend_beam(x, levels, k, 1)
    assert rows.tolist() == list(range(40)) and cells.tolist() == kernels.descend(x, levels, k).tolist()
    rows, cells = kernels.descend_beam(x, levels, k, 9)
    assert sorted(zip(rows.tolist(), cells.tolist())) == [(r, c) for r in range(40) for c in range(9)]


def test_cell_sums():
    x, cell = matrix(3000, 4, 10), np.random.default_rng(11).integers(0, 5, 3000).astype(np.int32)
    ids, counts, sums = kernels.cell_sums(cell, x)
    assert ids.tolist() == sorted(set(cell.tolist())) and counts.sum() == 3000
    for c, s in zip(ids, sums):
        assert (s == x[cell == c].astype(int).sum(0)).all()


def test_sums_survive_packing_in_every_width():
    counts = np.array([1, 257, 258, 16_843_009, 16_843_010, 1 << 40])
    sums = np.stack([counts * 255, counts * 0, counts * 7], axis=1)
    rows, columns = zip(*kernels.pack_sums(counts, sums))
    assert [r.tolist() for r in rows] == [[0, 1], [2, 3], [4, 5]]
    mixed = pa.concat_arrays(columns[::-1])
    assert (kernels.unpack_sums(mixed, 3) == sums[[4, 5, 2, 3, 0, 1]]).all()


def test_first_distinct():
    parent = np.array([0, 0, 0, 1, 1, 1], np.int32)
    x = np.array([[1, 1], [1, 1], [2, 1], [1, 1], [3, 3], [4, 4]], np.uint8)
    assert kernels.first_distinct(parent, x, 2).tolist() == [0, 2, 3, 4]


def test_kth_smallest():
    dist = np.array([[3, 1, 2], [5, 5, 0]])
    assert kernels.kth_smallest(dist, 0).tolist() == [1, 0]
    assert kernels.kth_smallest(dist, 2).tolist() == [3, 5]
    assert (kernels.kth_smallest(dist, 3) == np.iinfo(np.int32).max).all()
