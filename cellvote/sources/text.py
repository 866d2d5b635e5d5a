"""Whitespace-separated text forms of centers, index, queries and word counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellvote.functions.vectors import vector_from_text, vector_text
from cellvote.operators.levels import center_rows


def _tail(line: Column, fields: int) -> Column:
    """The line without its first `fields` whitespace-separated fields."""
    return F.regexp_replace(line, rf"^\s*(\S+\s+){{{fields}}}", "")


def _field(line: Column, number: int) -> Column:
    return F.split(F.trim(line), r"\s+", number + 2)[number]


def write_centers(centers: DataFrame, path: str) -> None:
    """Lines 'id<TAB>count<TAB>v0 v1 ...' of one level, in id order."""
    line = F.concat_ws("\t", F.col("center_id").cast("string"), F.col("n").cast("string"), vector_text(F.col("center")))
    centers.orderBy("center_id").select(line.alias("value")).write.mode("overwrite").text(path)


def read_centers(spark: SparkSession, path: str, level: int, k: int) -> DataFrame:
    """Centers frame from text lines; the id column is the center's number."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(
        _field(F.col("value"), 0).cast("int").alias("center_id"),
        _field(F.col("value"), 1).cast("bigint").alias("n"),
        vector_from_text(_tail(F.col("value"), 2)).alias("center"),
    )
    return center_rows(rows, level, k)


def write_index(numbered: DataFrame, path: str) -> None:
    """Lines 'cell<TAB>ordinal id  v0 v1 ...', cells contiguous and in order.

    numbered: cell, ord, image_id, v.
    """
    head = F.concat(F.col("cell").cast("string"), F.lit("\t"), F.col("ord").cast("string"), F.lit(" "), F.col("image_id"))
    line = F.concat(head, F.lit("  "), vector_text(F.col("v")))
    numbered.orderBy("cell", "ord").select(line.alias("value")).write.mode("overwrite").text(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """cell, ord, image_id, v."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(
        _field(F.col("value"), 0).cast("int").alias("cell"),
        _field(F.col("value"), 1).cast("bigint").alias("ord"),
        _field(F.col("value"), 2).alias("image_id"),
        vector_from_text(_tail(F.col("value"), 3)).alias("v"),
    )


def write_queries(queries: DataFrame, path: str) -> None:
    """Lines 'desc_no<TAB>0<TAB>v0 v1 ... ', one folder and one file per query image."""
    line = F.concat(F.col("desc_no").cast("string"), F.lit("\t0\t"), vector_text(F.col("v")), F.lit(" "))
    rows = queries.select("query_id", line.alias("value")).repartition("query_id")
    rows.write.mode("overwrite").partitionBy("query_id").text(path)


def id_of_file() -> Column:
    """The folder value query_id=... of the file a line is from, else the file name."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/query_id=([^/]*)/[^/]*$", 1)
    return F.when(folder != "", F.url_decode(folder)).otherwise(F.col("_metadata.file_name"))


def query_lines(lines: DataFrame, query_id: Column) -> DataFrame:
    """query_id, desc_no, v from lines of query files (batch or stream)."""
    return lines.where(F.trim("value") != "").select(
        query_id.alias("query_id"),
        _field(F.col("value"), 0).cast("bigint").alias("desc_no"),
        vector_from_text(_tail(F.col("value"), 2)).alias("v"),
    )


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Query files: query_id is the folder value query_id=... if there is one, else the file name."""
    lines = spark.read.text(path)
    return query_lines(lines, F.col("query_id" if "query_id" in lines.columns else "_metadata.file_name"))


def write_counts(counts: DataFrame, path: str) -> None:
    """Lines 'key<TAB>count' of a two-column frame (cell sizes, word counts)."""
    key, count = counts.columns
    line = F.concat_ws("\t", F.col(key).cast("string"), F.col(count).cast("string"))
    counts.select(line.alias("value")).write.mode("overwrite").text(path)
