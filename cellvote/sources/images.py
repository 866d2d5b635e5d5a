"""Listing image files, with resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellvote.operators.ingest import resume_from


def list_images(spark: SparkSession, path: str, marker: str | None = None) -> DataFrame:
    """path, name, length of every file; from `marker` on (inclusive) if given.

    File contents are not read: only the listed columns reach the scan.
    """
    files = spark.read.format("binaryFile").load(path)
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    return resume_from(named, marker)
