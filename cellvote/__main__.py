"""Command line: python -m cellvote {fit,search,watch,ingest,compact,images,words} ...  (or spark-submit this file)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from cellvote import Index, build_index, fit_tree, search
from cellvote.operators.ingest import split_names
from cellvote.operators.votes import answers
from cellvote.operators.words import word_count
from cellvote.settings import new_table_path
from cellvote.sources.descriptors import DEFAULT_DIM, scan_descriptors
from cellvote.sources.images import list_images
from cellvote.sources.text import read_centers, read_queries, write_counts
from cellvote.streaming.jobs import point_stream, stream_ingest, stream_search, text_query_stream


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cellvote", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)

    fit = jobs.add_parser("fit", help="fit the tree and build the index")
    fit.add_argument("points", help="Parquet points, or descriptor files with --dim")
    fit.add_argument("index", help="folder of the new index")
    fit.add_argument("--dim", type=int, help=f"read binary descriptor files of this dimension (usually {DEFAULT_DIM})")
    fit.add_argument("--k", type=int, default=10)
    fit.add_argument("--depth", type=int, default=3)
    fit.add_argument("--iterations", type=int, default=6)
    fit.add_argument("--centers", help="text file with the centers of the top level to start from")
    fit.add_argument("--snapshots", help="folder to keep every round's centers in, and to continue from")

    def add_search(name: str, text: str) -> argparse.ArgumentParser:
        job = jobs.add_parser(name, help=text)
        job.add_argument("queries", help="folder of query text files, one image per file")
        job.add_argument("index")
        job.add_argument("answers", help="Parquet folder for the ranked images")
        job.add_argument("--vote-limit", type=int, default=10)
        job.add_argument("--top", type=int, default=10)
        job.add_argument("--n-probe", type=int, default=1)
        return job

    add_search("search", "answer the query files in a folder")
    watch = add_search("watch", "answer query files as they arrive, until stopped")
    watch.add_argument("checkpoint", help="folder that remembers which files were answered")
    watch.add_argument("--replies", help="folder for one row per query, with an empty answer where nothing was found")
    watch.add_argument("--once", action="store_true", help="stop after the files that are there")

    ingest_job = jobs.add_parser("ingest", help="file points as they arrive, until stopped")
    ingest_job.add_argument("points", help="folder of Parquet points")
    ingest_job.add_argument("index")
    ingest_job.add_argument("checkpoint", help="folder that remembers which files were filed")
    ingest_job.add_argument("--once", action="store_true", help="stop after the files that are there")

    compact = jobs.add_parser("compact", help="merge the index's batches into one")
    compact.add_argument("index")
    compact.add_argument("--vacuum", action="store_true", help="delete replaced files; no older search may still run")

    listing = jobs.add_parser("images", help="list the image files to load and those with names that are no ids")
    listing.add_argument("images")
    listing.add_argument("listed", help="Parquet folder for image_id and name of the valid files")
    listing.add_argument("--marker", help="first file name to take, to resume a listing")

    words = jobs.add_parser("words", help="count words in text files")
    words.add_argument("lines")
    words.add_argument("counts")
    return top


def stored_points(spark: SparkSession, path: str, dim: int | None) -> DataFrame:
    """Points as a Parquet table, since fitting reads them many times."""
    if dim is None:
        return spark.read.parquet(path)
    copy = new_table_path(spark, "points")
    scan_descriptors(spark, path, dim).write.parquet(copy)
    return spark.read.parquet(copy)


def trigger_of(args: argparse.Namespace) -> dict:
    return {"availableNow": True} if args.once else {"processingTime": "1 second"}


def run(spark: SparkSession, argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.job == "fit":
        points = stored_points(spark, args.points, args.dim)
        seeds = read_centers(spark, args.centers, 0, args.k) if args.centers else None
        tree = fit_tree(
            points,
            k=args.k,
            depth=args.depth,
            iterations=args.iterations,
            seeds=seeds,
            snapshots=args.snapshots,
        )
        build_index(points, tree, args.index)
        tree.stats(spark).orderBy("level").show()
    elif args.job == "ingest":
        arriving = point_stream(spark, args.points)
        stream_ingest(arriving, Index.open(spark, args.index), args.checkpoint, trigger=trigger_of(args)).awaitTermination()
    elif args.job == "compact":
        index = Index.open(spark, args.index)
        index.compact()
        if args.vacuum:
            index.vacuum()
    elif args.job == "images":
        valid, rejected = split_names(list_images(spark, args.images, marker=args.marker))
        valid.write.mode("overwrite").parquet(args.listed)
        print(f"{spark.read.parquet(args.listed).count()} listed, {rejected.count()} rejected")
    elif args.job == "words":
        counts = word_count(spark.read.text(args.lines), "value")
        write_counts(counts, args.counts)
    else:
        index = Index.open(spark, args.index)
        limits = {"vote_limit": args.vote_limit, "top": args.top, "n_probe": args.n_probe}
        if args.job == "search":
            asked = read_queries(spark, args.queries)
            search(asked, index, **limits).write.mode("overwrite").parquet(args.answers)
            answers(spark.read.parquet(args.answers), asked).orderBy("query_id").show(20, truncate=False)
        else:
            stream = text_query_stream(spark, args.queries)
            started = stream_search(
                stream, index, args.answers, args.checkpoint, trigger=trigger_of(args), replies_path=args.replies, **limits
            )
            started.awaitTermination()


if __name__ == "__main__":
    run(SparkSession.builder.appName("cellvote").getOrCreate())
