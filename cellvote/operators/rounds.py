"""One k-means round: assign, sum per cell, truncating integer mean."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellvote.functions.vectors import l1_distance, unpack_bytes
from cellvote.operators.assign import resident_levels, ship
from cellvote.operators.kernels import bytes_matrix, cell_sums, descend, matrix_column, nearest_child, pack_sums, unpack_sums
from cellvote.operators.levels import Level, center_rows
from cellvote.operators.passes import Clustered
from cellvote.settings import DEFAULT_LIMITS, Limits, ensure_checkpoint_dir

SUMS_SCHEMA = "cell INT, n BIGINT, s BINARY"  # s: one number per dimension, see pack_sums
HELD_BYTES = 64 << 20  # running sums a task may hold before it adds them up or emits them


class _RunningSums:
    """Sums per cell over the batches of one task."""

    def __init__(self, dim: int):
        self.dim = dim
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    @property
    def full(self) -> bool:
        return self.held * self.dim * 8 > HELD_BYTES

    def add(self, ids: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        if len(ids):
            self.parts.append((ids, counts, sums))
            self.held += len(ids)
            if self.full:
                self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, counts, sums = (np.concatenate(part) for part in zip(*self.parts))
        order = np.argsort(ids, kind="stable")
        cells, starts = np.unique(ids[order], return_index=True)
        merged = cells, np.add.reduceat(counts[order], starts), np.add.reduceat(sums[order], starts, axis=0)
        self.parts, self.held = [merged], len(cells)
        return merged

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        ids, counts, sums = self.merge()
        for rows, packed in pack_sums(counts, sums):
            columns = [pa.array(ids[rows], pa.int32()), pa.array(counts[rows], pa.int64()), packed]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "n", "s"])
        self.parts, self.held = [], 0


def partial_sums(
    points: DataFrame, levels: list[Level], *, limits: Limits = DEFAULT_LIMITS, clustered: Clustered | None = None
) -> DataFrame:
    """SUMS_SCHEMA rows, at most a few per cell and task.

    Assignment and summing are one pass over the Arrow batches while the
    centers fit the broadcast bound.  Beyond it they run over `clustered`, the
    points stored for all rounds of this level, which is made here without one.
    """
    dim, k = levels[-1].dim, levels[-1].k
    if len(resident_levels(levels, limits)) == len(levels):
        shipped = ship(levels, points.sparkSession)

        def walk_and_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            running = _RunningSums(dim)
            centers = [level.value for level in shipped]
            for batch in batches:
                x = bytes_matrix(batch["v"], dim)
                running.add(*cell_sums(descend(x, centers, k), x))
                if running.full:  # too many cells to hold; the merge adds them up again
                    yield from running.flush()
            yield from running.flush()

        return points.select("v").mapInArrow(walk_and_sum, SUMS_SCHEMA)

    clustered = clustered or Clustered.of(points, levels, limits)

    def step_and_sum(batches, children: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
        running = _RunningSums(dim)
        for batch in batches:
            x = bytes_matrix(batch["v"], dim)
            cells = nearest_child(x, batch["cell"].to_numpy() - first, children, k)
            running.add(*cell_sums(cells + np.int32(first * k), x))
            if running.full:
                yield from running.flush()
        yield from running.flush()

    return clustered.walk(levels[-1], step_and_sum, SUMS_SCHEMA)


def mean_centers(sums: DataFrame, dim: int) -> DataFrame:
    """SUMS_SCHEMA -> center_id, n, center (sums divided with truncation).

    Each task adds up the partial rows of its own cells as they stream in; it
    holds one row per cell.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running = _RunningSums(dim)
        for batch in batches:
            running.add(batch["cell"].to_numpy(), batch["n"].to_numpy(), unpack_sums(batch["s"], dim))
        if running.parts:
            ids, counts, sums = running.merge()
            centers = matrix_column((sums // counts[:, None]).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(counts), centers], names=["center_id", "n", "center"]
            )

    return sums.repartition("cell").mapInArrow(add_up, "center_id INT, n BIGINT, center BINARY")


def run_round(
    points: DataFrame,
    levels: list[Level],
    *,
    empty: str = "keep",
    limits: Limits = DEFAULT_LIMITS,
    clustered: Clustered | None = None,
) -> Level:
    """New centers of the last level.  A cell without points keeps its center with n = 0."""
    old = levels[-1]
    means = mean_centers(partial_sums(points, levels, limits=limits, clustered=clustered), old.dim)
    if old.array is not None:
        arrow = means.toArrow().combine_chunks()
        if empty == "error" and arrow.num_rows < old.size:
            raise ValueError(f"level {old.number}: {old.size - arrow.num_rows} centers got no points")
        centers, counts = old.array.copy(), np.zeros(old.size, np.int64)
        if arrow.num_rows:
            ids = arrow["center_id"].to_numpy()
            centers[ids] = bytes_matrix(arrow["center"].combine_chunks(), old.dim)
            counts[ids] = arrow["n"].to_numpy()
        return Level(old.number, old.k, old.dim, centers, counts)

    kept = old.table.select("center_id", F.col("center").alias("_old"))
    merged = kept.join(means, "center_id", "left").select(
        "center_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("center", "_old").alias("center")
    )
    ensure_checkpoint_dir(points.sparkSession)
    table = center_rows(merged, old.number, old.k).checkpoint()
    if empty == "error" and table.where("n = 0").limit(1).count():
        raise ValueError(f"level {old.number}: some centers got no points")
    return Level(old.number, old.k, old.dim, table=table)


def center_shift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Total L1 movement of the centers of one level between two rounds."""
    before = old.select("level", "center_id", F.col("center").alias("_old"))
    moved = new.join(before, ["level", "center_id"])
    gap = l1_distance(unpack_bytes(F.col("_old")), unpack_bytes(F.col("center")))
    return moved.groupBy("level").agg(F.sum(gap).alias("shift"))
