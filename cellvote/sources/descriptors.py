"""Fixed-length binary descriptor files: 8 id bytes, then one byte per dimension.

Reading goes through Spark's own fixed-length record reader, so every path that
Spark can open will do, and no row passes a Python worker.  Writing is the Spark
data source `descriptor_files`, whose tasks get Arrow batches.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from cellvote.functions.vectors import image_hex
from cellvote.operators.kernels import bytes_matrix

# Fixed values of the file format.
ID_BYTES = 8
DEFAULT_DIM = 128

SPLIT_BYTES = 128 << 20  # of one input partition
ROW_BITS = 33  # monotonically_increasing_id keeps the partition above this many row bits
SCHEMA = "image_id STRING, desc_no BIGINT, v BINARY"
MODES = ("error", "append", "overwrite")


def scan_descriptors(spark: SparkSession, path: str, dim: int = DEFAULT_DIM, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """image_id, desc_no, v; desc_no is the record's position in its file.

    Files in subfolders are read as well; names that start with `_` or `.` are not.  Large files are split at record
    boundaries.  A file that is not a whole number of records is an error.
    """
    length = ID_BYTES + dim
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    broken = listed.where(F.col("length") % length != 0).head()
    if broken is not None:
        raise ValueError(f"{broken.path}: {broken.length} bytes is not a multiple of {length}")
    hadoop = spark._jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())
    hadoop.set("mapreduce.input.fileinputformat.input.dir.recursive", "true")
    hadoop.set("mapreduce.input.fileinputformat.split.maxsize", str(split_bytes))
    records = spark._jsc.sc().binaryRecords(path, length, hadoop)
    encoder = spark._jvm.org.apache.spark.sql.Encoders.BINARY()
    rows = DataFrame(spark._jsparkSession.createDataset(records, encoder).toDF(), spark)
    # A partition is one split of one file, which starts at a record.
    before = F.call_function("div", F.input_file_block_start(), F.lit(length))
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return rows.select(
        image_hex(F.substring("value", 1, ID_BYTES)).alias("image_id"),
        (before + within).alias("desc_no"),
        F.substring("value", ID_BYTES + 1, dim).alias("v"),
    )


def write_descriptors(points: DataFrame, path: str, dim: int = DEFAULT_DIM, mode: str = "error") -> None:
    """Export points as descriptor files, one per partition.

    mode: "error" refuses a folder with files in it, "append" adds to them, "overwrite" takes them away once the new
        ones are in place, so a failed export keeps the old records.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    points.sparkSession.dataSource.register(DescriptorFiles)
    rows = points.select("image_id", F.lit(0).cast("bigint").alias("desc_no"), "v")
    target = qualified(path, default_store(points.sparkSession))
    if mode == "error" and record_files(target):
        raise ValueError(f"{path} holds files; append to them or overwrite them")
    save = "overwrite" if mode == "overwrite" else "append"
    rows.write.format("descriptor_files").mode(save).option("dim", str(dim)).save(target)


def qualified(path: str, default_fs: str | None) -> str:
    """The path with a scheme: its own, or that of the session's default file system.

    s3a and s3n are the store that the file system library calls s3.
    """
    scheme = path.split(":", 1)[0] if ":" in path.split("/", 1)[0] else ""
    if not scheme:
        if not default_fs or default_fs.startswith("file:"):
            return path
        return qualified(default_fs.rstrip("/") + "/" + path.lstrip("/"), None)
    if scheme in ("s3a", "s3n"):
        return "s3" + path[len(scheme) :]
    if scheme not in ("file", "hdfs", "viewfs", "s3", "gs", "gcs", "abfs", "abfss"):
        raise ValueError(f"executors cannot open {scheme} paths: {path}")
    return path


def default_store(spark: SparkSession) -> str | None:
    return spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def record_files(path: str) -> list[str]:
    """The files that a scan of path reads."""
    store, root = open_store(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    files = [file.path for file in found if file.type == fs.FileType.File]
    below = len(root.rstrip("/"))
    return [file for file in files if not any(part.startswith(("_", ".")) for part in file[below:].split("/"))]


class DescriptorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "descriptor_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _DescriptorWriter(self.options["path"], int(self.options["dim"]), overwrite)


@dataclass
class _Written(WriterCommitMessage):
    staged: str | None


class _DescriptorWriter(DataSourceArrowWriter):
    """Tasks write below _temporary; the commit moves finished files into place.

    So a task that ran twice, or a lost one, leaves no records behind.
    """

    def __init__(self, path: str, dim: int, overwrite: bool = False):
        self.path, self.dim, self.overwrite = path, dim, overwrite
        self.staging = posixpath.join(path, "_temporary", uuid.uuid4().hex)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        store, folder = open_store(self.staging)
        store.create_dir(folder, recursive=True)
        target = posixpath.join(folder, f"part-{uuid.uuid4().hex}.bin")
        rows = 0
        with store.open_output_stream(target) as out:
            for batch in batches:
                out.write(encode_records(batch["image_id"], batch["v"], self.dim))
                rows += batch.num_rows
        return _Written(target if rows else None)

    def commit(self, messages: list[_Written | None]) -> None:
        store, folder = open_store(self.path)
        earlier = record_files(self.path) if self.overwrite else []
        for message in messages:
            if message is not None and message.staged:
                store.move(message.staged, posixpath.join(folder, posixpath.basename(message.staged)))
        for file in earlier:
            store.delete_file(file)
        self._drop_staging()

    def abort(self, messages: list[_Written | None]) -> None:
        self._drop_staging()

    def _drop_staging(self) -> None:
        store, folder = open_store(self.staging)
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)
        parent = posixpath.dirname(folder)
        others = store.get_file_info(fs.FileSelector(parent, allow_not_found=True))
        if not others and store.get_file_info(parent).type != fs.FileType.NotFound:
            store.delete_dir(parent)


def encode_records(image_id: pa.Array, v: pa.Array, dim: int) -> bytes:
    """Rows as fixed-length records, the id little-endian."""
    x = bytes_matrix(v, dim)
    records = np.empty((len(x), ID_BYTES + dim), np.uint8)
    digits = "".join(image_id.to_pylist())
    if len(digits) != 16 * len(x):
        raise ValueError("image ids must have 16 hex digits")
    records[:, :ID_BYTES] = np.frombuffer(bytes.fromhex(digits), np.uint8).reshape(-1, ID_BYTES)[:, ::-1]
    records[:, ID_BYTES:] = x
    return records.tobytes()
