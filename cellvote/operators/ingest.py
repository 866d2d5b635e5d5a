"""From extractor output to points and query descriptors, with totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellvote.functions.vectors import image_id_parse, pack_bytes, truncate_values


def points_from_arrays(
    frame: DataFrame, image_id: Column, desc_no: Column, values: Column
) -> DataFrame:
    """image_id, desc_no, v from one integer array (0..255) per row."""
    return frame.select(
        image_id.cast("string").alias("image_id"), desc_no.cast("bigint").alias("desc_no"), pack_bytes(values).alias("v")
    )


def explode_descriptors(images: DataFrame, key: str, matrix: str) -> DataFrame:
    """One row per image with a matrix of float descriptors -> key, desc_no, v."""
    rows = images.select(key, F.posexplode(matrix).alias("desc_no", "_values"))
    return rows.select(
        key, F.col("desc_no").cast("bigint").alias("desc_no"), pack_bytes(truncate_values(F.col("_values"))).alias("v")
    )


def split_names(files: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Files with a valid image_id, and the rejected rest."""
    parsed = files.withColumn("image_id", image_id_parse(F.col(name)))
    return parsed.where(F.col("image_id").isNotNull()), parsed.where(F.col("image_id").isNull()).drop("image_id")


def ingest_stats(points: DataFrame) -> DataFrame:
    """image_id, descriptors: how many descriptors each image gave."""
    return points.groupBy("image_id").agg(F.count("*").alias("descriptors"))


def ingest_totals(points: DataFrame) -> DataFrame:
    """One row: images, descriptors."""
    return ingest_stats(points).agg(
        F.count("*").alias("images"), F.coalesce(F.sum("descriptors"), F.lit(0)).alias("descriptors")
    )


def merged_ids(files: DataFrame, name: str = "name") -> DataFrame:
    """Image ids that more than one file name maps to."""
    valid, _ = split_names(files, name)
    names = valid.select("image_id", name).distinct()
    return names.groupBy("image_id").agg(F.count("*").alias("names")).where(F.col("names") > 1)


def resume_from(files: DataFrame, marker: str | None, name: str = "name") -> DataFrame:
    """Files from the marker on, the marker included; all of them without one."""
    return files if marker is None else files.where(F.col(name) >= marker)


def not_loaded(files: DataFrame, points: DataFrame, name: str = "name") -> DataFrame:
    """Valid files whose image has no descriptor in `points` yet."""
    valid, _ = split_names(files, name)
    return valid.join(points.select("image_id").distinct(), "image_id", "left_anti")
