"""Filing points under tree cells: nearest center, nearest child, descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellvote.operators.kernels import bytes_matrix, descend, descend_beam, nearest_child, nearest_children
from cellvote.operators.levels import Level
from cellvote.settings import DEFAULT_LIMITS, Limits

BEAM_CELLS = 262_144  # children compared at a time when several cells are kept per point


def resident_levels(levels: list[Level], limits: Limits) -> list[Level]:
    """The top level and those below it that together stay within the broadcast bound."""
    total, kept = 0, []
    for level in levels:
        total += level.size * level.dim
        if level.array is None or (level.number > 0 and total > limits.broadcast_bytes):
            break
        kept.append(level)
    return kept


def ship(levels: list[Level], spark: SparkSession) -> list[Broadcast]:
    return [level.shipped(spark.sparkContext) for level in levels]


def with_field(schema: T.StructType, name: str) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, T.IntegerType(), False)])


def append_column(batch: pa.RecordBatch, name: str, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*batch.schema.names, name])


def assign_cells(
    points: DataFrame,
    levels: list[Level],
    *,
    n_probe: int = 1,
    keys: tuple[str, ...] = ("image_id", "desc_no"),
    column: str = "cell",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """points + the cell each one reaches on the last of `levels`.

    The levels within the broadcast bound are walked in one map-only pass over
    Arrow batches; each deeper one is a table of points clustered by parent cell,
    walked in passes of neighbouring parents (see passes.py).  With n_probe > 1
    the n nearest cells are kept on every level and a point gives n rows; rows
    that are equal in `keys`, or in everything, are points of their own.
    """
    if n_probe < 1:
        raise ValueError("n_probe must be at least 1")
    if not levels:
        return points.withColumn(column, F.lit(0))
    resident = resident_levels(levels, limits)
    deeper = levels[len(resident) :]
    if n_probe > 1 and deeper:
        # deeper levels find a point's rows again by its keys, so points with equal keys are numbered
        keys = (*keys, "v")
        alike = Window.partitionBy(*keys).orderBy(*keys)
        points, keys = points.withColumn("_copy", F.row_number().over(alike)), (*keys, "_copy")
    frame = _assign_resident(points, resident, n_probe, column)
    for level in deeper:
        frame = _assign_in_passes(frame, level, n_probe, keys, column, limits)
    return frame.drop("_copy")


def _assign_in_passes(
    frame: DataFrame, level: Level, n_probe: int, keys: tuple[str, ...], column: str, limits: Limits
) -> DataFrame:
    """One level down, as a stored table: no join, and no center goes to a task that needs it not."""
    from cellvote.operators.passes import Clustered

    k, dim, keep = level.k, level.dim, min(n_probe, level.k)
    rest = [c for c in frame.columns if c != column]
    schema = with_field(frame.select(*rest).schema, column)
    if n_probe > 1:
        schema = with_field(schema, "_dist")

    def step(batches: Iterator[pa.RecordBatch], children: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch[column].to_numpy() - first
            out = batch.select(rest)
            if n_probe == 1:
                cells = nearest_child(bytes_matrix(batch["v"], dim), own, children, k)
                yield append_column(out, column, cells + np.int32(first * k))
                continue
            for start in range(0, batch.num_rows, max(BEAM_CELLS // k, 1)):
                rows = slice(start, start + max(BEAM_CELLS // k, 1))
                x = bytes_matrix(batch["v"], dim)[rows]
                cells, dist = nearest_children(x, own[rows], children, k, keep)
                part = out.slice(start, len(x)).take(pa.array(np.repeat(np.arange(len(x)), keep)))
                part = append_column(part, column, (cells + first * k).astype(np.int32).ravel())
                yield append_column(part, "_dist", dist.ravel())

    clustered = Clustered.of_cells(frame, level, column, limits)
    walked = clustered.walk(level, step, schema)
    clustered.drop()
    if n_probe == 1:
        return walked
    best = Window.partitionBy(*keys).orderBy("_dist", column)
    return walked.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= n_probe).select(*rest, column)


def _assign_resident(points: DataFrame, levels: list[Level], n_probe: int, column: str) -> DataFrame:
    k, dim = levels[0].k, levels[0].dim
    shipped = ship(levels, points.sparkSession)
    step = max(BEAM_CELLS // (n_probe * k), 1)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = [level.value for level in shipped]
        for batch in batches:
            if n_probe == 1:
                yield append_column(batch, column, descend(bytes_matrix(batch["v"], dim), centers, k))
                continue
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                rows, cells = descend_beam(bytes_matrix(part["v"], dim), centers, k, n_probe)
                yield append_column(part.take(pa.array(rows)), column, cells)

    return points.mapInArrow(walk, with_field(points.schema, column))


def cells_of_level(spark: SparkSession, levels: list[Level]) -> DataFrame:
    """All centers of the given levels in one frame."""
    frames = [level.frame(spark) for level in levels]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
