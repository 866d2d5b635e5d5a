"""Seeds of a level: the first k distinct vectors of every parent cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellvote.operators.assign import append_column, assign_cells, resident_levels, ship
from cellvote.operators.kernels import bytes_matrix, descend, first_distinct
from cellvote.operators.levels import Level, center_rows
from cellvote.settings import DEFAULT_LIMITS, Limits

BUFFER_ROWS = 8_192
HELD_BYTES = 128 << 20  # vectors and ids that a task may hold
SURVIVOR_SCHEMA = "image_id STRING, desc_no BIGINT, v BINARY, parent INT"


class _Survivors:
    """The first k distinct vectors per parent among the rows of one task.

    Memory follows the parents that the task has met, not all there are: those
    with k vectors are kept in order of their ids, with the image id after which
    a row comes too late.  Beyond `held_bytes` the vectors held are handed on; what
    is known of the full parents stays, up to as many of them again.
    """

    def __init__(self, k: int, dim: int, held_bytes: int = HELD_BYTES):
        self.k, self.dim, self.held_rows = k, dim, max(held_bytes // (dim + 64), BUFFER_ROWS)
        self.held: pa.Table | None = None
        self.full = np.empty(0, np.int32)  # sorted parents with k vectors
        self.last = pa.array([], pa.string())  # image id of the k-th vector of each
        self.waiting: list[pa.RecordBatch] = []
        self.rows = 0

    def add(self, batch: pa.RecordBatch) -> None:
        if len(self.full):
            parent = batch["parent"].to_numpy()
            at = np.minimum(np.searchsorted(self.full, parent), len(self.full) - 1)
            late = pc.greater(batch["image_id"], self.last.take(pa.array(at)))
            batch = batch.filter(pc.invert(pc.and_(late, pa.array(self.full[at] == parent))))
        if batch.num_rows:
            self.waiting.append(batch)
            self.rows += batch.num_rows
        if self.rows >= max(BUFFER_ROWS, self.held.num_rows if self.held else 0):
            self.reduce()

    def reduce(self) -> None:
        if not self.waiting:
            return
        table = pa.Table.from_batches(self.waiting)
        if self.held is not None:
            table = pa.concat_tables([self.held, table])
        table = table.sort_by([(c, "ascending") for c in ("parent", "image_id", "desc_no", "v")])
        x = bytes_matrix(table["v"].combine_chunks(), self.dim)
        parent = table["parent"].to_numpy()
        kept = first_distinct(parent, x, self.k)
        self.held = table.take(pa.array(kept))
        self.waiting, self.rows = [], 0

        owner, first, count = np.unique(parent[kept], return_index=True, return_counts=True)
        complete = count == self.k
        images = self.held["image_id"].combine_chunks().take(pa.array(first[complete] + self.k - 1))
        known = ~np.isin(self.full, owner[complete])  # of parents handed on before
        if len(self.full) > self.held_rows:
            known[:] = False
        ids = np.concatenate([self.full[known], owner[complete]])
        order = np.argsort(ids, kind="stable")
        self.full = ids[order]
        self.last = pa.concat_arrays([self.last.filter(pa.array(known)), images]).take(pa.array(order))

    def overflow(self) -> Iterator[pa.RecordBatch]:
        """What is held, if it is too much to hold on to."""
        if self.held is not None and self.held.num_rows > self.held_rows:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        self.reduce()
        if self.held is not None:
            yield from self.held.to_batches()
        self.held = None


def find_seeds(points: DataFrame, levels: list[Level], k: int, dim: int, *, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Centers frame of the next level; fewer than k per parent if vectors run out.

    Order is (image_id, desc_no, v).  Each task first reduces its own rows to the
    first k distinct vectors per parent.  A vector among the global first k is
    also among the first k of the task that holds its first occurrence, so
    nothing is lost and only the survivors are shuffled.
    """
    rows = points.select("image_id", "desc_no", "v")
    resident = len(resident_levels(levels, limits)) == len(levels)
    shipped = ship(levels, points.sparkSession) if resident else []
    if not resident:
        rows = assign_cells(rows, levels, column="parent", limits=limits)

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Survivors(k, dim)
        centers = [level.value for level in shipped]
        for batch in batches:
            if resident:
                cells = descend(bytes_matrix(batch["v"], dim), centers, k)
                batch = append_column(batch, "parent", cells)
            found.add(batch)
            yield from found.overflow()
        yield from found.flush()

    local = rows.mapInArrow(survivors, SURVIVOR_SCHEMA)
    distinct = local.groupBy("parent", "v").agg(F.min(F.struct("image_id", "desc_no")).alias("_first"))
    order = Window.partitionBy("parent").orderBy("_first", "v")
    ranked = distinct.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    seeds = ranked.select(
        (F.col("parent") * k + F.col("_rank") - 1).alias("center_id"), F.lit(0).alias("n"), F.col("v").alias("center")
    )
    return center_rows(seeds, len(levels), k)
