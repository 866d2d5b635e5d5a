"""Small helpers the operators share: reading, intermediate tables, measured broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellvote.settings import new_table_path

# ASCII white space, as the word patterns of the contracts have it (space and \x09-\x0D).
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Most that is ever broadcast.  Every table is measured first; beyond it the same join is shuffled.
BROADCAST_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back: cuts lineage, and is computed once."""
    path = new_table_path(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes the tables that `stored` wrote for the frames, once everything made from them is stored itself."""
    for frame in frames:
        spark = frame.sparkSession
        own = new_table_path(spark, "").rpartition("/")[0]
        for path in {file.rpartition("/")[0] for file in frame.inputFiles()}:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            if own.rpartition(":")[2] in path:  # nothing but this application's tables
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def text_digest(text: Column) -> Column:
    """128 bits that name a text; a null one is the empty text."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def small(frame: DataFrame, row_bytes: int) -> DataFrame:
    """The frame with a broadcast hint if its counted rows prove it small, as it is otherwise.

    Pass a stored frame: it is counted here and read again by the join.
    """
    return F.broadcast(frame) if frame.count() * row_bytes <= BROADCAST_BYTES else frame


def chunks(batch: pa.RecordBatch, text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about `limit` bytes of text each, a longer row alone."""
    sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(size)
    if len(sizes) > begin:
        yield batch.slice(begin)


def over_chunks(text: str, work: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """`work` on bounded slices, in the form mapInArrow takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                yield work(part)

    return run
