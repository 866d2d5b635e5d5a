"""Vote cut with ties, votes per image, ranked answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellvote.functions.text import format_answer, parse_answer


def cut_candidates(candidates: DataFrame, vote_limit: int, *, small_queries: bool) -> DataFrame:
    """Nearest candidates per query descriptor: query_id, desc_no, dist, image_id, n.

    Whole groups of equal distance are taken until more than vote_limit
    candidates are in; every copy of an image counts.  That is: a distance is
    kept while at most max(vote_limit, 0) candidates are strictly nearer.

    candidates: rows with the number n of equal ones (one each without such a
    column), in any number of parts.
    They are exchanged once, by query descriptor and image, so a descriptor with
    very many equally distant candidates is spread.  Of each part only the counts
    of its nearest distances travel on to find the cut.
    small_queries: the number of query descriptors is known to fit a broadcast.
    """
    limit = max(vote_limit, 0)
    keys = ["query_id", "desc_no"]
    if "n" not in candidates.columns:
        candidates = candidates.withColumn("n", F.lit(1).cast("bigint"))
    dealt = candidates.repartition(*keys, "image_id")
    counted = dealt.groupBy(*keys, "dist", "image_id").agg(F.sum("n").alias("n"))
    near = counted.select(*keys, "dist", "n")
    near = near.mapInArrow(lambda batches: nearest_counts(batches, limit), near.schema).repartition(*keys)
    nearer = Window.partitionBy(*keys).orderBy("dist").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        near.groupBy(*keys, "dist")
        .agg(F.sum("n").alias("n"))
        .withColumn("_nearer", F.coalesce(F.sum("n").over(nearer), F.lit(0)))
        .where(F.col("_nearer") <= limit)
        .groupBy(*keys)
        .agg(F.max("dist").alias("_cut"))
    )
    if small_queries:
        cut = F.broadcast(cut)
    # The filter on n is always true; it keeps the count in this branch too, so
    # that both branches share one exchange and the postings are read once.
    kept = counted.where(F.col("n") > 0).join(cut, keys)
    return kept.where(F.col("dist") <= F.col("_cut")).drop("_cut")


def nearest_counts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Candidates per (query_id, desc_no, dist), without distances that have more than limit nearer ones in the batch."""
    keys = ["query_id", "desc_no", "dist"]
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch]).group_by(keys).aggregate([("n", "sum")]).combine_chunks()
        table = table.rename_columns([*keys, "n"]).sort_by([(key, "ascending") for key in keys])
        query, desc = (table[key].combine_chunks() for key in keys[:2])
        rows = table.num_rows
        first = np.ones(rows, bool)
        other = pc.or_(pc.not_equal(query[1:], query[:-1]), pc.not_equal(desc[1:], desc[:-1]))
        first[1:] = other.to_numpy(zero_copy_only=False)
        n = table["n"].to_numpy()
        before = np.cumsum(n) - n
        start = np.flatnonzero(first)
        nearer = before - np.repeat(before[start], np.diff(np.append(start, rows)))
        yield from table.filter(pa.array(nearer <= limit)).combine_chunks().to_batches()


def votes_of(nearest: DataFrame) -> DataFrame:
    """Distinct (query_id, desc_no, image_id)."""
    return nearest.select("query_id", "desc_no", "image_id").distinct()


def count_votes(votes: DataFrame, *, small_queries: bool = False) -> DataFrame:
    """query_id, image_id, votes.

    small_queries: as in cut_candidates.  The votes are then dealt by query alone,
    which also serves the ranking of its images.
    """
    if small_queries:
        votes = votes.repartition("query_id")
    return votes.groupBy("query_id", "image_id").agg(F.count("*").alias("votes"))


def top_images(counts: DataFrame, top: int = 10, min_votes: int = 2) -> DataFrame:
    """query_id, rank, image_id, votes: most votes first, then the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("votes"), "image_id")
    return (
        counts.where(F.col("votes") >= min_votes)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("query_id", "rank", "image_id", "votes")
    )


def answers(ranked: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """One 'id:votes id:votes' string per query.

    queries: the batch that was asked; each of its query_ids gets a row then, with
        an empty string if no image was found.
    """
    found = ranked.groupBy("query_id").agg(
        format_answer(F.col("rank"), F.col("image_id"), F.col("votes")).alias("answer")
    )
    if queries is None:
        return found
    asked = queries.select("query_id").distinct().join(found, "query_id", "left")
    return asked.select("query_id", F.coalesce("answer", F.lit("")).alias("answer"))


def parsed_answers(answered: DataFrame) -> DataFrame:
    """Inverse of answers."""
    return answered.select("query_id", F.posexplode(parse_answer(F.col("answer"))).alias("_pos", "_hit")).select(
        "query_id", (F.col("_pos") + 1).alias("rank"), "_hit.image_id", "_hit.votes"
    )
