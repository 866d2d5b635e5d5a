"""numpy helpers that run inside tasks on one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1024  # rows per step, so that the working set stays in cache
BLOCK = 2048  # the same for a step that holds a value per dimension and row
DIRECTIONS = 5  # numbers that stand for a byte in a lower bound


def bytes_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """BINARY column -> uint8 matrix (rows, dim), checked for nulls and length."""
    if len(column) == 0:
        return np.empty((0, dim), np.uint8)
    if column.null_count:
        raise ValueError("null descriptor vector")
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1]
    if (np.diff(ends) != dim).any():
        raise ValueError(f"descriptor vector without exactly {dim} dimensions")
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(len(column), dim)


def matrix_column(matrix: np.ndarray) -> pa.Array:
    """uint8 matrix -> BINARY column."""
    rows, dim = matrix.shape
    ends = np.arange(rows + 1, dtype=np.int32) * np.int32(dim)
    data = np.ascontiguousarray(matrix)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _l1(x: np.ndarray, ref: np.ndarray, work: np.ndarray) -> np.ndarray:
    """Row-wise L1 of int16 x against uint8 ref (one row or as many as x)."""
    np.subtract(x, ref, out=work)
    np.abs(work, out=work)
    return work.sum(axis=1, dtype=np.int32)


def l1_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """int32 distances (len(a), len(b)) of two uint8 matrices.

    |x - y| is 2 max(x, y) - x - y, so only the larger values are summed, for many rows of b at once.
    """
    if len(b) < len(a):
        return l1_matrix(b, a).T
    kind = np.uint16 if a.shape[1] <= 257 else np.uint32  # holds 255 per dimension
    query = a.astype(kind)[:, :, None]
    larger = np.empty((len(a), len(b)), kind)
    for start in range(0, len(b), BLOCK):
        x = np.ascontiguousarray(b[start : start + BLOCK].T).astype(kind)
        work = np.empty_like(x)
        for i in range(len(a)):
            np.maximum(x, query[i], out=work)
            np.add.reduce(work, axis=0, out=larger[i, start : start + BLOCK])
    out = larger.astype(np.int32)
    out *= 2
    out -= a.sum(axis=1, dtype=np.int32)[:, None]
    out -= b.sum(axis=1, dtype=np.int32)
    return out


def l1_pairs(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """int32 distances of the rows i of a to the rows j of b, two uint8 matrices."""
    # whole numbers below 2**24 add up exactly in float32
    ones = np.ones(a.shape[1], np.float32 if a.shape[1] <= 1 << 16 else np.float64)
    out = np.empty(len(i), np.int32)
    for start in range(0, len(i), CHUNK):
        part = slice(start, start + CHUNK)
        x, y = np.take(a, i[part], axis=0), np.take(b, j[part], axis=0)
        gap = np.maximum(x, y)
        np.subtract(gap, np.minimum(x, y, out=x), out=gap)
        out[part] = gap.astype(ones.dtype) @ ones
    return out


class LowerBound:
    """Lower bounds of L1 distances that are one matrix product.

    A byte x is the vector of the 255 answers to x > t.  Of two bytes these vectors
    are |x - y| apart when squared, and any orthogonal projection brings them nearer.
    Kept are the few directions in which the bytes of `sample` vary most, for
    every dimension, so the squared distance of what is left never exceeds the L1 distance.
    """

    def __init__(self, sample: np.ndarray):
        share = np.bincount(sample.ravel(), minlength=256) / max(sample.size, 1)
        steps = (np.arange(256)[:, None] > np.arange(255)).astype(np.float64)
        steps -= share @ steps
        _, axes = np.linalg.eigh((steps * share[:, None]).T @ steps)
        self.table = (steps @ axes[:, ::-1][:, :DIRECTIONS]).astype(np.float32)

    def left(self, x: np.ndarray) -> np.ndarray:
        """x for the left side of the product, with its squared length and a one."""
        y, square = self._mapped(x)
        return np.column_stack([y, square, np.ones_like(square)])

    def right(self, x: np.ndarray) -> np.ndarray:
        y, square = self._mapped(x)
        return np.column_stack([-2 * y, np.ones_like(square), square])

    def _mapped(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = self.table[x].reshape(len(x), -1)
        return y, np.einsum("ij,ij->i", y, y)

    def slack(self, dim: int) -> float:
        """More than rounding can add to a bound."""
        terms = dim * DIRECTIONS + 8
        return terms * float(np.finfo(np.float32).eps) * 4 * dim * float((self.table.astype(np.float64) ** 2).sum(1).max())


def l1_rows(x: np.ndarray, centers: np.ndarray, number: np.ndarray) -> np.ndarray:
    """int32 distance of each row to the center with its number."""
    out = np.empty(len(x), np.int32)
    for start in range(0, len(x), CHUNK):
        rows = slice(start, start + CHUNK)
        block = x[rows].astype(np.int16)
        out[rows] = _l1(block, centers[number[rows]], np.empty_like(block))
    return out


def nearest_child(x: np.ndarray, parent: np.ndarray, centers: np.ndarray, k: int) -> np.ndarray:
    """Nearest of the k children of each row's parent; the lowest id wins ties."""
    cell = np.empty(len(x), np.int32)
    top_level = len(centers) == k
    for start in range(0, len(x), CHUNK):
        rows = slice(start, start + CHUNK)
        block = x[rows].astype(np.int16)
        work = np.empty_like(block)
        first = parent[rows].astype(np.int64) * k
        dist = np.empty((k, len(block)), np.int32)
        for j in range(k):
            dist[j] = _l1(block, centers[j] if top_level else centers[first + j], work)
        cell[rows] = first + dist.argmin(axis=0)
    return cell


def descend(x: np.ndarray, levels: list[np.ndarray], k: int, start: np.ndarray | None = None) -> np.ndarray:
    """Cell reached by stepping to the nearest child on every level."""
    cell = np.zeros(len(x), np.int32) if start is None else start
    for centers in levels:
        cell = nearest_child(x, cell, centers, k)
    return cell


def nearest_children(
    x: np.ndarray, parent: np.ndarray, centers: np.ndarray, k: int, n: int
) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of the n nearest children of each row's parent, nearest first, the lowest id on ties."""
    dist = np.empty((len(x), k), np.int32)
    first = parent.astype(np.int64) * k
    for start in range(0, len(x), CHUNK):
        rows = slice(start, start + CHUNK)
        block = x[rows].astype(np.int16)
        work = np.empty_like(block)
        for j in range(k):
            dist[rows, j] = _l1(block, centers[first[rows] + j], work)
    order = np.argsort(dist, axis=1, kind="stable")[:, :n]
    return first[:, None] + order, np.take_along_axis(dist, order, axis=1)


def descend_beam(x: np.ndarray, levels: list[np.ndarray], k: int, n_probe: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) pairs when the n_probe nearest cells are kept on every level."""
    rows = np.arange(len(x))
    cells = np.zeros(len(x), np.int64)
    for centers in levels:
        width = len(cells) // max(len(x), 1)
        children = (cells[:, None] * k + np.arange(k)).ravel()
        owner = np.repeat(rows, k)
        dist = np.empty(len(children), np.int64)
        for at in range(0, len(children), CHUNK):
            part = slice(at, at + CHUNK)
            block = x[owner[part]].astype(np.int16)
            dist[part] = _l1(block, centers[children[part]], np.empty_like(block))
        # every row has width*k children, so the order is a plain 2-d sort
        keep = min(n_probe, width * k)
        order = np.lexsort((children, dist, owner)).reshape(len(x), width * k)[:, :keep].ravel()
        rows, cells = owner[order], children[order]
    return rows, cells.astype(np.int32)


def cell_sums(cell: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct cells with their row counts and per-dimension sums."""
    if len(cell) == 0:
        return np.empty(0, np.int32), np.empty(0, np.int64), np.empty((0, x.shape[1]), np.int64)
    order = np.argsort(cell, kind="stable")
    ids, starts, counts = np.unique(cell[order], return_index=True, return_counts=True)
    sums = np.add.reduceat(x[order], starts, axis=0, dtype=np.int64)
    return ids, counts, sums


# Number types for a sum of n bytes, with the largest n whose sum always fits.
SUM_TYPES = (("<u2", 257), ("<u4", 16_843_009), ("<i8", np.iinfo(np.int64).max // 255))


def pack_sums(counts: np.ndarray, sums: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Row numbers and BINARY sums, each row in the smallest type its count allows."""
    smallest = 0
    for name, largest in SUM_TYPES:
        rows = np.flatnonzero((counts > smallest) & (counts <= largest))
        smallest = largest
        if len(rows):
            packed = np.ascontiguousarray(sums[rows].astype(name))
            yield rows, matrix_column(packed.view(np.uint8).reshape(len(rows), -1))


def unpack_sums(column: pa.Array, dim: int) -> np.ndarray:
    """Inverse of pack_sums: int64 matrix in the order of the column."""
    length = pc.binary_length(column).to_numpy()
    sums = np.empty((len(length), dim), np.int64)
    for name, _ in SUM_TYPES:
        width = dim * np.dtype(name).itemsize
        rows = np.flatnonzero(length == width)
        if len(rows):
            sums[rows] = bytes_matrix(column.take(pa.array(rows)), width).view(name)
    return sums


def first_distinct(parent: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the first k distinct vectors per parent.

    Rows must already be ordered by parent and then by priority.
    """
    dim = x.shape[1]
    tagged = np.empty((len(x), dim + 4), np.uint8)
    tagged[:, :4] = parent.astype(">i4").view(np.uint8).reshape(-1, 4)
    tagged[:, 4:] = x
    _, first = np.unique(tagged.view(f"V{dim + 4}").ravel(), return_index=True)
    first.sort()
    owner = parent[first]
    position = np.arange(len(first)) - np.searchsorted(owner, owner, side="left")
    return first[position < k]


def kth_smallest(dist: np.ndarray, limit: int) -> np.ndarray:
    """Per row the (limit+1)-th smallest value; the maximum int if there are fewer."""
    if dist.shape[1] <= limit:
        return np.full(len(dist), np.iinfo(np.int32).max, np.int32)
    return np.partition(dist, limit, axis=1)[:, limit]
