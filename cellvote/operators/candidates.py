"""Candidate join: query descriptors against the postings of their leaves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellvote.operators.kernels import LowerBound, bytes_matrix, kth_smallest, l1_matrix, l1_pairs
from cellvote.settings import DEFAULT_LIMITS, Limits

QUERY_BLOCK = 256  # query descriptors per distance matrix
POSTING_BLOCK = 2048  # postings per distance matrix
FEW = 32  # descriptors of one side that are compared without a lower bound
HELD = 1 << 22  # candidates that a task keeps
ADDED = 1 << 20  # candidates added to these at a time
PASSED_ON = 1 << 16  # candidates in one Arrow batch
TASK_PAIRS = 1 << 30  # comparisons of one task where they can be dealt out
BOUNDED_PAIRS = 1 << 28  # the same where bounds are known, so that a task with few postings passes on no more
LEAST_PAIRS = 1 << 24  # comparisons that are worth a task
CUT = np.iinfo(np.int32).max


def candidate_schema(query_id: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", query_id, False),
            T.StructField("desc_no", T.LongType(), False),
            T.StructField("dist", T.IntegerType(), False),
            T.StructField("image_id", T.StringType(), False),
            T.StructField("n", T.LongType(), False),
        ]
    )


def group_starts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(len(ordered) > 0, ordered[1:] != ordered[:-1])[: len(ordered)])


class Nearest:
    """Candidates that one task has met, without those that its other ones put beyond the vote cut.

    The (limit+1)-th smallest distance among any candidates of a query descriptor
    is an upper bound of the final one.  `bounds` carries it per query row: what is
    above it is dropped when met, and what was met before whenever the number kept
    has doubled.  Equally near ones all stay; beyond HELD they are passed on at once.
    Almost all pairs are ruled out by a lower bound of their distance (see
    LowerBound); the distances of the others are exact.
    """

    def __init__(self, keys: list[pa.Array], vectors: np.ndarray, limit: int, bounds: np.ndarray):
        self.keys, self.vectors, self.limit, self.bounds = keys, vectors, limit, bounds
        self.lower = LowerBound(vectors[:: max(len(vectors) // 4096, 1)])
        self.slack = self.lower.slack(vectors.shape[1])
        self.q, self.dist, self.images = [], [], []
        self.size, self.least = 0, 1 << 12

    def meet(self, rows: np.ndarray, x: np.ndarray, images: pa.Array) -> Iterator[pa.RecordBatch]:
        """The query rows, each one once, against all of x, the vectors of `images`."""
        for start in range(0, len(x), POSTING_BLOCK):
            stored = x[start : start + POSTING_BLOCK]
            right = self.lower.right(stored).T if min(len(stored), len(rows)) > FEW else None
            found, waiting = [], 0
            for at in range(0, len(rows), QUERY_BLOCK):
                found.append(self._block(rows[at : at + QUERY_BLOCK], stored, right))
                waiting += len(found[-1][0])
                if waiting < ADDED and at + QUERY_BLOCK < len(rows):
                    continue
                q, p, dist = (np.concatenate(parts) for parts in zip(*found))
                found, waiting = [], 0
                self.q.append(q)
                self.dist.append(dist)
                self.images.append(images.take(pa.array(p + start)))
                self.size += len(q)
                if self.size > 2 * self.least:
                    self._cut()
                    if self.size > HELD:
                        yield from self.rest()
                    self.least = max(self.size, 1 << 12)

    def _block(self, rows: np.ndarray, x: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, ...]:
        queries, own = self.vectors[rows], self.bounds[rows]
        if right is not None and own.max() < CUT:
            hit = self.lower.left(queries) @ right <= (own + self.slack).astype(np.float32)[:, None]
            if np.count_nonzero(hit) * 8 <= hit.size:
                q, p = np.divmod(np.flatnonzero(hit), len(x))
                dist = l1_pairs(queries, q, x, p)
                near = dist <= own[q]
                return rows[q[near]], p[near], dist[near]
        dist = l1_matrix(queries, x)
        own = np.minimum(own, kth_smallest(dist, self.limit))
        self.bounds[rows] = own
        q, p = np.divmod(np.flatnonzero(dist <= own[:, None]), len(x))
        return rows[q], p, dist[q, p]

    def _cut(self) -> None:
        q, dist = np.concatenate(self.q), np.concatenate(self.dist)
        order = np.lexsort((dist, q))
        q, dist = q[order], dist[order]
        first = group_starts(q)
        enough = first[np.diff(np.append(first, len(q))) > self.limit]
        self.bounds[q[enough]] = np.minimum(self.bounds[q[enough]], dist[enough + self.limit])
        near = dist <= self.bounds[q]
        images = pa.concat_arrays(self.images).take(pa.array(order[near]))
        self.q, self.dist, self.images, self.size = [q[near]], [dist[near]], [images], int(near.sum())

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What is kept now, and nothing is kept any more."""
        if self.size:
            self._cut()
            (q,), (dist,), (images,) = self.q, self.dist, self.images
            for start in range(0, len(q), PASSED_ON):
                part = slice(start, start + PASSED_ON)
                rows = np.arange(start, start + len(q[part]))
                yield _candidate_batch(self.keys, q[part], dist[part], images, rows)
        self.q, self.dist, self.images, self.size = [], [], [], 0


def shipment(queries: pa.Table, rows: np.ndarray, leaves: np.ndarray, bounds: np.ndarray | None = None) -> tuple:
    """What join_broadcast ships: each query descriptor once, and the (row, leaf) visits in leaf order."""
    order = np.argsort(leaves, kind="stable")
    return queries.combine_chunks(), rows[order], leaves[order], bounds


def join_broadcast(
    shipped: Broadcast, postings: DataFrame, *, vote_limit: int, dim: int, query_type: T.DataType
) -> DataFrame:
    """Candidates when all query descriptors fit the broadcast bound.

    Map-only over the postings, as a large leaf is already split over files.
    shipped: a `shipment`; its bounds, if any, are distances that the cut of each
        descriptor is known not to exceed.
    """
    schema = candidate_schema(query_type)
    limit = max(vote_limit, 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, asking, leaf_of, known = shipped.value
        vectors = bytes_matrix(table["v"].combine_chunks(), dim)
        first = group_starts(leaf_of)
        where = dict(zip(leaf_of[first].tolist(), np.split(asking, first[1:])))
        bounds = np.full(len(vectors), CUT, np.int32) if known is None else known.copy()
        nearest = Nearest(query_keys(table), vectors, limit, bounds)
        for batch in batches:
            x = bytes_matrix(batch["v"], dim)
            leaf = batch["leaf"].to_numpy()
            order = np.argsort(leaf, kind="stable")
            present, at = np.unique(leaf[order], return_index=True)
            for cell, start, end in zip(present.tolist(), at, [*at[1:], len(order)]):
                mine = where.get(cell)
                if mine is not None:
                    rows = order[start:end]
                    yield from nearest.meet(mine, x[rows], batch["image_id"].take(pa.array(rows)))
        yield from nearest.rest()

    return postings.select("leaf", "image_id", "v").mapInArrow(scan, schema)


def query_keys(queries: pa.Table) -> list[pa.Array]:
    return [queries[name].combine_chunks() for name in ("query_id", "desc_no")]


def _candidate_batch(
    keys: list[pa.Array], q: np.ndarray, dist: np.ndarray, images: pa.Array, p: np.ndarray
) -> pa.RecordBatch:
    """Rows of candidate_schema; equal ones are one row with their number, as an image may be there many times."""
    number = images.dictionary_encode()
    codes = number.indices.to_numpy()[p].astype(np.int64)
    order = np.lexsort((codes, dist, q))
    q, dist, codes, p = q[order], dist[order], codes[order], p[order]
    first = np.ones(len(q), bool)
    first[1:] = (q[1:] != q[:-1]) | (dist[1:] != dist[:-1]) | (codes[1:] != codes[:-1])
    at = np.flatnonzero(first)
    picked = [key.take(pa.array(q[at])) for key in keys]
    counts = np.diff(np.append(at, len(q)))
    return pa.RecordBatch.from_arrays(
        [*picked, pa.array(dist[at], pa.int32()), images.take(pa.array(p[at])), pa.array(counts, pa.int64())],
        names=["query_id", "desc_no", "dist", "image_id", "n"],
    )


def join_blocks(
    routed: DataFrame,
    postings: DataFrame,
    leaf_sizes: DataFrame,
    *,
    n_leaves: int,
    vote_limit: int,
    dim: int,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Candidates for query batches beyond the broadcast bound.

    Both sides of a leaf are cut into blocks of about limits.block_rows by a
    hash, and every query block meets every posting block of its leaf: both are
    sorted together, the queries of a block first, and a task holds those while
    the postings stream by.  Memory is bounded however large the leaf is, and
    however many candidates are equally near.
    routed: may have a column `bound`, a distance that the cut of the descriptor is
        known not to exceed, or null.
    leaf_sizes: leaf, n of the postings.
    """
    limit = max(vote_limit, 0)
    schema = candidate_schema(routed.schema["query_id"].dataType)

    def blocks(n):
        return F.ceil(n / limits.block_rows).cast("int")

    sizes = (
        routed.groupBy("leaf")
        .agg(F.count("*").alias("_nq"))
        .join(leaf_sizes, "leaf")
        .select(
            "leaf",
            blocks(F.col("_nq")).alias("_qb"),
            blocks(F.col("n")).alias("_pb"),
            (F.col("_nq").cast("double") * F.col("n")).alias("_pairs"),
        )
    )
    # The work fixes the number of partitions: adaptive execution would merge blocks of few bytes that take long.
    work = sizes.agg(F.sum(F.col("_qb").cast("bigint") * F.col("_pb")).alias("n"), F.sum("_pairs").alias("pairs")).head()
    usual = int(routed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(usual, min(2 * (work.n or 0), int((work.pairs or 0) // LEAST_PAIRS)))
    sizes = sizes.drop("_pairs")
    if n_leaves * 64 <= limits.broadcast_bytes:
        sizes = F.broadcast(sizes)

    def pick(n, *key):
        return F.pmod(F.xxhash64(*key), F.col(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    known = F.coalesce(F.col("bound"), F.lit(int(CUT))).cast("int") if "bound" in routed.columns else F.lit(int(CUT))
    left = routed.join(sizes, "leaf").select(
        "leaf", pick("_qb", "query_id", "desc_no").alias("qb"), every("_pb").alias("pb"), "query_id", "desc_no", "v", known.alias("bound")
    )
    right = postings.join(sizes, "leaf").select(
        "leaf", pick("_pb", "image_id", "desc_no").alias("pb"), every("_qb").alias("qb"), "image_id", "v"
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, held = None, [], None
        for batch in batches:
            keys = np.stack([batch[name].to_numpy() for name in ("leaf", "qb", "pb")], axis=1)
            ends = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *ends], [*ends, len(keys)]):
                if (now := tuple(keys[start])) != block:
                    if held is not None:
                        yield from held.rest()
                    block, waiting, held = now, [], None
                part = batch.slice(start, end - start)
                asked = int(np.searchsorted(part["side"].to_numpy(), 1))
                if asked:
                    waiting.append(part.slice(0, asked))
                if asked == part.num_rows or not waiting:
                    continue
                if held is None:  # all queries of the block are here once its postings come
                    table = pa.Table.from_batches(waiting)
                    vectors = bytes_matrix(table["v"].combine_chunks(), dim)
                    held = Nearest(query_keys(table), vectors, limit, table["bound"].to_numpy().copy())
                stored = part.slice(asked)
                yield from held.meet(np.arange(len(held.vectors)), bytes_matrix(stored["v"], dim), stored["image_id"])
        if held is not None:
            yield from held.rest()

    keys = ("leaf", "qb", "pb")
    left = left.withColumns({"image_id": F.lit(None).cast("string"), "side": F.lit(0)})
    right = right.withColumns(
        {
            "query_id": F.lit(None).cast(routed.schema["query_id"].dataType),
            "desc_no": F.lit(None).cast("bigint"),
            "bound": F.lit(int(CUT)),
            "side": F.lit(1),
        }
    )
    both = left.unionByName(right).repartition(parts, *keys).sortWithinPartitions(*keys, "side")
    return both.mapInArrow(meet, schema)
