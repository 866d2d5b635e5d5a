"""Continuous query answering and continuous ingest on file streams."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cellvote.operators.votes import answers
from cellvote.plans.index import Index, append_postings
from cellvote.plans.search import search
from cellvote.settings import DEFAULT_LIMITS, Limits
from cellvote.sources.text import id_of_file, query_lines

QUERY_SCHEMA = "query_id BIGINT, desc_no BIGINT, v BINARY"
POINTS_SCHEMA = "image_id STRING, desc_no BIGINT, v BINARY"
NUMBER_SCHEMA = "number BIGINT"
BATCH_BITS = 30  # of a batch number inside its stream


def stream_number(spark: SparkSession, checkpoint: str, taken: Callable[[int], bool]) -> int:
    """A positive 32-bit number of the stream, drawn once and kept inside its checkpoint folder.

    It goes where the checkpoint goes, however its path is written.  A stream
    started without its checkpoint draws a new one that is not `taken`, so it
    never overwrites what another stream, or its own lost state, has written.
    """
    path = f"{checkpoint.rstrip('/')}/stream_number"
    try:
        known = spark.read.schema(NUMBER_SCHEMA).parquet(path).head()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    if known is not None:
        return known.number
    number = secrets.randbelow(1 << 32) + 1
    while taken(number):
        number = secrets.randbelow(1 << 32) + 1
    spark.createDataFrame([(number,)], NUMBER_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
    return number


def has_folder(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def query_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Query descriptors from Parquet files; all rows of an image lie in one file."""
    reader = spark.readStream.schema(QUERY_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def text_query_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Query descriptors from text files, one image per file.

    Named by the folder query_id=... the file is in, as write_queries lays them
    out, else by the file.  path may be the folder above those folders.
    """
    reader = spark.readStream.schema("value STRING").option("maxFilesPerTrigger", files_per_batch)
    return query_lines(reader.option("recursiveFileLookup", True).text(path), id_of_file())


def point_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New points from Parquet files."""
    reader = spark.readStream.schema(POINTS_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_search(
    queries: DataFrame,
    index: Index,
    answers_path: str,
    checkpoint: str,
    *,
    trigger: dict | None = None,
    vote_limit: int = 10,
    top: int = 10,
    n_probe: int = 1,
    replies_path: str | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> StreamingQuery:
    """Answer every arriving query image; one job answers a whole micro-batch.

    replies_path: a second target for one row per query image, query_id and answer
        (see `answers`), with an empty answer where no image was found.

    Answers go to answers_path/stream=S/batch_id=N, where S belongs to the
    checkpoint, so several streams can share a target.  A batch that is run again
    after a failure overwrites its own folder, so no answer is doubled.
    """
    spark = queries.sparkSession
    number = stream_number(spark, checkpoint, lambda n: has_folder(spark, f"{answers_path}/stream={n}"))
    target = f"{answers_path}/stream={number}"

    def answer(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # counted, routed and searched
        used: list[Broadcast] = []
        try:
            found = search(
                batch, index, vote_limit=vote_limit, top=top, n_probe=n_probe, limits=limits, broadcasts=used
            )
            written = f"{target}/batch_id={batch_id}"
            found.write.mode("overwrite").parquet(written)
            if replies_path is not None:
                ranked = spark.read.schema(found.schema).parquet(written)
                replies = answers(ranked, batch)
                replies.write.mode("overwrite").parquet(f"{replies_path}/stream={number}/batch_id={batch_id}")
        finally:
            batch.unpersist()
            for table in used:
                table.destroy()

    return (
        queries.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_ingest(
    points: DataFrame,
    index: Index,
    checkpoint: str,
    *,
    trigger: dict | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> StreamingQuery:
    """File every arriving point under its leaf of the fixed tree.

    Batch N of the stream is a batch of the index whose number also holds one that
    belongs to the checkpoint: it replaces itself when run twice, and no other
    stream's (0 is the first build).
    """
    spark = points.sparkSession
    number = stream_number(spark, checkpoint, lambda n: index.known(n << BATCH_BITS, (n + 1) << BATCH_BITS))
    first = (number << BATCH_BITS) + 1

    def file(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # counted, sampled for the ranges and written
        try:
            append_postings(batch, index.tree, index.path, batch=first + batch_id, limits=limits)
        finally:
            batch.unpersist()

    return (
        points.writeStream.foreachBatch(file)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
