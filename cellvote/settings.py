"""Size limits and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Limits:
    """Bounds that decide between a broadcast and a shuffled plan.

    broadcast_bytes: largest table that may be sent whole to every executor or
        held on the driver.  Every such table is measured first; beyond the
        bound the join-based plan runs instead.
    block_rows: rows per side of one block in the shuffled candidate join.
    rows_per_file: postings per index file.
    top_level_bytes: largest top level, whose k centers (of dim + 64 bytes) the
        driver and every task hold; a larger k is an error.
    pass_bytes: centers that one pass over a level beyond the broadcast bound sends
        to its tasks.
    """

    broadcast_bytes: int = 256 << 20
    top_level_bytes: int = 256 << 20
    pass_bytes: int = 128 << 20
    block_rows: int = 65_536
    rows_per_file: int = 8_000_000


DEFAULT_LIMITS = Limits()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    A folder of our own is made only in local mode with nothing configured.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    path = context.getCheckpointDir()
    if path is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="cellvote-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table of this application; nothing else is ever deleted."""
    if f"/cellvote/{spark.sparkContext.applicationId}/" not in path:
        raise ValueError(f"{path} is no intermediate table")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def new_table_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/cellvote/{app}/{name}-{uuid.uuid4().hex}"
