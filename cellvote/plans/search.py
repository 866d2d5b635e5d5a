"""Answering a batch of query images against the index."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellvote.functions.vectors import ancestor
from cellvote.operators.assign import assign_cells
from cellvote.operators.candidates import (
    BOUNDED_PAIRS,
    CUT,
    LEAST_PAIRS,
    TASK_PAIRS,
    join_blocks,
    join_broadcast,
    shipment,
)
from cellvote.operators.votes import count_votes, cut_candidates, top_images, votes_of
from cellvote.plans.index import Index
from cellvote.settings import DEFAULT_LIMITS, Limits, new_table_path

QUERY_KEYS = ("query_id", "desc_no")
ROW_OVERHEAD = 96  # bytes per query descriptor next to its vector
LEAF_BYTES = 64  # of one leaf in a list on the driver
DEALT_VISITS = 2000  # query descriptors per posting that are worth moving it for


def route(queries: DataFrame, index: Index, *, n_probe: int = 1, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """query_id, desc_no, v, leaf: the leaf (or n_probe leaves) of every query descriptor."""
    rows = queries.select("query_id", F.col("desc_no").cast("bigint").alias("desc_no"), "v")
    return assign_cells(rows, index.tree.levels, n_probe=n_probe, keys=QUERY_KEYS, column="leaf", limits=limits)


def leaves_hit(routed: DataFrame, index: Index) -> DataFrame:
    """Postings per leaf that some query descriptor was routed to."""
    hit = routed.select("leaf").distinct()
    return index.cell_sizes().withColumnRenamed("cell", "leaf").join(hit, "leaf", "left_semi")


def small_batch(queries: DataFrame, index: Index, n_probe: int = 1, limits: Limits = DEFAULT_LIMITS) -> bool:
    """Whether the routed query descriptors, which are counted, fit the broadcast bound."""
    return queries.count() * n_probe <= limits.broadcast_bytes // (index.tree.dim + ROW_OVERHEAD)


def nearest_candidates(
    queries: DataFrame,
    index: Index,
    *,
    vote_limit: int = 10,
    n_probe: int = 1,
    limits: Limits = DEFAULT_LIMITS,
    broadcasts: list[Broadcast] | None = None,
) -> DataFrame:
    """query_id, desc_no, dist, image_id, n: the candidates inside the vote cut.

    The number of query descriptors is measured first.  Within the broadcast
    bound the routed descriptors go to every task of a pruned postings scan;
    beyond it they are written once, and the leaves found in that table prune
    the scan of the postings that are shuffled against them in blocks.
    broadcasts: a list that receives what was broadcast for this batch, for a
        long-running caller to destroy once the result is written.
    """
    small = small_batch(queries, index, n_probe, limits)
    return _nearest(queries, index, small, vote_limit, n_probe, limits, broadcasts)


def _nearest(
    queries: DataFrame,
    index: Index,
    small: bool,
    vote_limit: int = 10,
    n_probe: int = 1,
    limits: Limits = DEFAULT_LIMITS,
    broadcasts: list[Broadcast] | None = None,
) -> DataFrame:
    if n_probe >= index.tree.n_leaves > 1:
        # every leaf is searched, so the greedy one's cut is an upper bound
        rows = bounded(queries, index, vote_limit, limits)
        routed = assign_cells(rows, index.tree.levels, n_probe=n_probe, keys=QUERY_KEYS, column="leaf", limits=limits)
    else:
        routed = route(queries, index, n_probe=n_probe, limits=limits)
    return candidates_of(routed, index, small, vote_limit, limits, broadcasts)


def bounded(queries: DataFrame, index: Index, vote_limit: int, limits: Limits) -> DataFrame:
    """query_id, desc_no, v, bound, row: with the distance that a greedy search shows the cut of all leaves not to exceed.

    bound: null if there are too few candidates to know one.
    row: a number of the query row, as rows may be equal.
    """
    rows = queries.select("query_id", F.col("desc_no").cast("bigint").alias("desc_no"), "v")
    found = nearest_candidates(rows, index, vote_limit=vote_limit, limits=limits)
    enough = F.when(F.sum("n") > max(vote_limit, 0), F.max("dist"))
    bounds = found.groupBy(*QUERY_KEYS).agg(enough.alias("bound"))
    return rows.join(bounds, list(QUERY_KEYS), "left").select(
        *QUERY_KEYS, "v", "bound", F.monotonically_increasing_id().alias("row")
    )


def candidates_of(
    routed: DataFrame,
    index: Index,
    small: bool,
    vote_limit: int,
    limits: Limits = DEFAULT_LIMITS,
    broadcasts: list[Broadcast] | None = None,
) -> DataFrame:
    """nearest_candidates of routed descriptors (query_id, desc_no, v, leaf), each of which may have several leaves.

    routed: may have the columns bound and row of `bounded` as well.
    """
    spark, tree = index.spark, index.tree
    if small:
        local = routed.toArrow()
        leaves = local["leaf"].unique().to_pylist()
        asking, rows, bounds = local.select([*QUERY_KEYS, "v"]), np.arange(local.num_rows), None
        if "row" in local.column_names:
            _, first, rows = np.unique(local["row"].to_numpy(), return_index=True, return_inverse=True)
            asking = asking.take(pa.array(first))
            bounds = local["bound"].take(pa.array(first)).fill_null(int(CUT)).to_numpy().astype(np.int32)
        shipped = spark.sparkContext.broadcast(shipment(asking, rows, local["leaf"].to_numpy(), bounds))
        if broadcasts is not None:
            broadcasts.append(shipped)
        candidates = join_broadcast(
            shipped,
            dealt_postings(index.postings(leaves), index, local["leaf"].to_numpy(), bounds is not None),
            vote_limit=vote_limit,
            dim=tree.dim,
            query_type=routed.schema["query_id"].dataType,
        )
    else:
        path = new_table_path(spark, "routed")
        routed.write.parquet(path)
        routed = spark.read.schema(routed.schema).parquet(path)
        candidates = join_blocks(
            routed,
            postings_of_routed(routed, index, limits),
            index.cell_sizes().withColumnRenamed("cell", "leaf"),
            n_leaves=tree.n_leaves,
            vote_limit=vote_limit,
            dim=tree.dim,
            limits=limits,
        )
    return cut_candidates(candidates, vote_limit, small_queries=small)


def dealt_postings(postings: DataFrame, index: Index, leaves: np.ndarray, known: bool) -> DataFrame:
    """The postings of join_broadcast, dealt out by comparisons where these outweigh the moving.

    A scan's tasks have about equally many postings however many query descriptors
    visit them, so the longest would grow with the product of both.  Comparisons
    are numbered leaf by leaf, and a posting goes to the task that its own lie in.
    leaves: the leaf of each visit.
    known: whether the join has bounds to begin with.
    """
    if len(leaves) < DEALT_VISITS:
        return postings
    spark = index.spark
    leaf, visits = np.unique(leaves, return_counts=True)
    asked = spark.createDataFrame(pa.table({"leaf": pa.array(leaf, pa.int32()), "asked": pa.array(visits, pa.int64())}))
    # listed after the postings, so that a batch that came in between is counted at worst
    stored = index.cell_sizes().withColumnRenamed("cell", "leaf")
    sizes = stored.join(F.broadcast(asked), "leaf").select("leaf", "n", "asked").toArrow()
    n = sizes["n"].to_numpy()
    pairs = n.astype(np.float64) * sizes["asked"].to_numpy()
    total = pairs.sum()
    if total < max(DEALT_VISITS * n.sum(), LEAST_PAIRS):
        return postings
    most = BOUNDED_PAIRS if known else TASK_PAIRS
    tasks = max(ceil(total / most), min(spark.sparkContext.defaultParallelism, ceil(total / LEAST_PAIRS)))
    share = total / tasks
    places = pa.table({"leaf": sizes["leaf"], "_start": (np.cumsum(pairs) - pairs) / share, "_width": pairs / share})
    even = F.pmod(F.xxhash64("batch", "row"), F.lit(1 << 30)) / (1 << 30)
    task = F.least(F.floor(F.col("_start") + even * F.col("_width")), F.lit(tasks - 1))
    placed = postings.join(F.broadcast(spark.createDataFrame(places)), "leaf", "left")
    placed = placed.select("leaf", "image_id", "v", task.cast("int").alias("_task"))
    return placed.repartitionById(tasks, "_task").sortWithinPartitions("leaf")


def postings_of_routed(routed: DataFrame, index: Index, limits: Limits) -> DataFrame:
    """The postings a large batch can need: a scan pruned by the leaves in the stored `routed`.

    The leaves go into the filter one by one while they are few, else as the
    stretch of leaves asked for in each top cell, of which there are k.  The join
    that follows drops what the ranges let through.
    """
    hit = routed.groupBy("leaf").agg(F.count("*").alias("n"))
    if index.tree.n_leaves * LEAF_BYTES <= limits.broadcast_bytes:
        return index.postings([row.leaf for row in hit.select("leaf").collect()])
    top = ancestor(F.col("leaf"), index.tree.k, index.tree.depth - 1)
    spans = hit.groupBy(top.alias("cell0")).agg(F.min("leaf").alias("first"), F.max("leaf").alias("last"))
    return index.postings_between([(row["first"], row["last"]) for row in spans.collect()])


def search_votes(queries: DataFrame, index: Index, **options) -> DataFrame:
    """query_id, desc_no, image_id: the images each query descriptor votes for.

    options: those of nearest_candidates.
    """
    return votes_of(nearest_candidates(queries, index, **options))


def search(
    queries: DataFrame,
    index: Index,
    *,
    top: int = 10,
    min_votes: int = 2,
    n_probe: int = 1,
    exact: bool = False,
    limits: Limits = DEFAULT_LIMITS,
    **options,
) -> DataFrame:
    """query_id, rank, image_id, votes for every query image of the batch.

    queries: query_id, desc_no, v.
    top, min_votes: length of the answer and votes an image needs to be in it.
    options: those of nearest_candidates, namely
        vote_limit: candidates per descriptor after which no further distance votes;
        n_probe: leaves searched per descriptor, 1 is the plain greedy descent.
    exact: candidates are those of a search through all leaves; n_probe is not used then.
    """
    if exact:
        from cellvote.plans.exact import exact_candidates

        return top_images(count_votes(votes_of(exact_candidates(queries, index, limits=limits, **options))), top, min_votes)
    small = small_batch(queries, index, n_probe, limits)
    nearest = _nearest(queries, index, small, n_probe=n_probe, limits=limits, **options)
    return top_images(count_votes(votes_of(nearest), small_queries=small), top, min_votes)
