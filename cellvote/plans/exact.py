"""Exact nearest candidates: leaves that cannot hold one are left out by the triangle inequality.

A greedy search first gives each query descriptor a distance that its cut cannot
exceed.  A posting p of a cell with center c is at least |q - c| - |p - c| away, so
the cell can hold a candidate only if |q - c| minus the cell's radius, which is
stored with the index, is within that distance.  The tree is walked down with
this test on every level, and the leaves left are searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellvote.operators.assign import resident_levels, ship
from cellvote.operators.candidates import CUT, join_broadcast, shipment
from cellvote.operators.kernels import bytes_matrix, l1_rows
from cellvote.operators.votes import cut_candidates
from cellvote.plans.index import Index
from cellvote.plans.search import ROW_OVERHEAD, bounded, candidates_of, dealt_postings
from cellvote.settings import DEFAULT_LIMITS, Limits, new_table_path

NO_POSTING = -(1 << 30)  # radius of a cell without postings: nothing is near it
PAIRS = 1 << 18  # (query, cell) pairs compared at a time
VISIT_BYTES = 16


def visits(queries: DataFrame, index: Index, *, vote_limit: int = 10, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """query_id, desc_no, v, bound, row, leaf: the leaves each query descriptor has to search, as a stored table.

    row: a number of the query row, as rows may be equal.
    bound: a distance that the cut does not exceed, null if there are too few
        candidates to know one.
    Levels beyond the broadcast bound are not tested: all leaves below the cells
    left on the last resident level are searched.
    """
    spark, tree = index.spark, index.tree
    bounded_rows = bounded(queries, index, vote_limit, limits)

    levels = resident_levels(tree.levels, limits)
    k, dim = tree.k, tree.dim
    below = k ** (tree.depth - len(levels))
    radii = []
    stored = index.radii().where(F.col("level") < len(levels)).toArrow()  # no more rows than resident centers
    for level in levels:
        mine = stored.filter(pa.compute.equal(stored["level"], level.number))
        radius = np.full(level.size, NO_POSTING, np.int64)
        radius[mine["cell"].to_numpy()] = mine["radius"].to_numpy()
        radii.append(radius)
    centers = ship(levels, spark)
    radius = spark.sparkContext.broadcast(radii)
    schema = T.StructType([*bounded_rows.schema.fields, T.StructField("leaf", T.IntegerType(), False)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(PAIRS // centers[0].value.shape[0], 1)
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                x = bytes_matrix(part["v"], dim)
                bound = part["bound"].fill_null(CUT // 4).to_numpy().astype(np.int64)
                row, cell = np.arange(len(x)), np.zeros(len(x), np.int64)
                for level, radius_ in zip(centers, radius.value):
                    row, cell = near_children(x, bound, row, cell, level.value, radius_, k)
                leaf = (cell[:, None] * below + np.arange(below)).ravel().astype(np.int32)
                taken = part.take(pa.array(np.repeat(row, below)))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaf)], names=[*part.schema.names, "leaf"])

    path = new_table_path(spark, "visits")
    bounded_rows.mapInArrow(walk, schema).write.parquet(path)
    radius.destroy()
    return spark.read.schema(schema).parquet(path)


def near_children(x, bound, row, cell, centers, radius, k) -> tuple[np.ndarray, np.ndarray]:
    """The (row, child) pairs below (row, cell) whose child may hold a vector within the row's bound."""
    rows, cells = [], []
    step = max(PAIRS // k, 1)
    for start in range(0, len(row), step):
        own = np.repeat(row[start : start + step], k)
        child = (cell[start : start + step, None] * k + np.arange(k)).ravel()
        dist = np.empty(len(own), np.int64)
        for at in range(0, len(own), 1 << 14):
            part = slice(at, at + (1 << 14))
            dist[part] = l1_rows(x[own[part]], centers, child[part])
        keep = dist - radius[child] <= bound[own]
        rows.append(own[keep])
        cells.append(child[keep])
    return (np.concatenate(rows), np.concatenate(cells)) if rows else (row[:0], cell[:0])


def exact_candidates(
    queries: DataFrame,
    index: Index,
    *,
    vote_limit: int = 10,
    limits: Limits = DEFAULT_LIMITS,
    broadcasts: list[Broadcast] | None = None,
) -> DataFrame:
    """query_id, desc_no, dist, image_id, n: the candidates inside the vote cut among all postings.

    Every query descriptor is shipped once with the list of its leaves, while the
    lists, which are counted, fit the broadcast bound.
    """
    spark, tree = index.spark, index.tree
    found = visits(queries, index, vote_limit=vote_limit, limits=limits)
    asked = queries.count()
    size = asked * (tree.dim + ROW_OVERHEAD) + found.count() * VISIT_BYTES
    if size > limits.broadcast_bytes:
        return candidates_of(found, index, False, vote_limit, limits)
    unique = found.drop("leaf").dropDuplicates(["row"]).toArrow().sort_by("row").combine_chunks()
    pairs = found.select("row", "leaf").toArrow()
    rows = np.searchsorted(unique["row"].to_numpy(), pairs["row"].to_numpy())
    bounds = unique["bound"].combine_chunks().fill_null(int(CUT)).to_numpy().astype(np.int32)
    asking = unique.drop(["bound", "row"])
    shipped = spark.sparkContext.broadcast(shipment(asking, rows, pairs["leaf"].to_numpy(), bounds))
    if broadcasts is not None:
        broadcasts.append(shipped)
    leaves = np.unique(pairs["leaf"].to_numpy()).tolist()
    candidates = join_broadcast(
        shipped,
        dealt_postings(index.postings(leaves), index, pairs["leaf"].to_numpy(), True),
        vote_limit=vote_limit,
        dim=tree.dim,
        query_type=queries.schema["query_id"].dataType,
    )
    return cut_candidates(candidates, vote_limit, small_queries=True)
