"""The clustered posting index: build, append, open, prune, export order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellvote.functions.vectors import ancestor
from cellvote.operators.assign import assign_cells, resident_levels, ship
from cellvote.operators.kernels import bytes_matrix, l1_rows
from cellvote.plans.tree import TreeModel
from cellvote.settings import DEFAULT_LIMITS, Limits, drop_table, new_table_path

POSTINGS_SCHEMA = (
    "leaf INT, row BIGINT, image_id STRING, desc_no BIGINT, v BINARY, batch BIGINT, cell0 INT"
)
RUNS_SCHEMA = "leaf INT, part BIGINT, first_row BIGINT, n BIGINT, batch BIGINT"
RADII_SCHEMA = "level INT, cell INT, radius INT, batch BIGINT"
MERGES_SCHEMA = "first BIGINT, last BIGINT, batch BIGINT"
ROW_BITS = 33  # monotonically_increasing_id keeps the partition above this many row bits
RUN_BYTES = 128  # of one row of the runs table in a broadcast
MAX_RANGES = 64  # leaf ranges pushed to the Parquet scan
MAX_LISTED = 10_000  # leaves listed one by one in a filter


@dataclass
class Index:
    """Postings on storage plus the tree that files them.

    postings/batch=B/cell0=C: sorted by leaf inside each file, so a scan for a
        few leaves skips directories by cell0 and row groups by leaf.
    runs/batch=B: one row per stretch of a leaf inside one file.
    radii/batch=B: for each cell the distance of its farthest posting.
    merges/batch=B: one generation: the ranges of batches that the merged batch B, a
        negative number, and those before it stand for.
    tree: the fitted centers.

    A batch counts once its runs are there, a merged one once its generation is;
    batches in a generation's ranges do not count any more.  So every listing
    sees a posting once, whatever is being written meanwhile.
    """

    spark: SparkSession
    path: str
    tree: TreeModel

    @classmethod
    def open(cls, spark: SparkSession, path: str, limits: Limits = DEFAULT_LIMITS) -> "Index":
        return cls(spark, path, TreeModel.load(spark, f"{path}/tree", limits))

    def postings(self, leaves: list[int] | None = None) -> DataFrame:
        """Postings, read only where `leaves` can be when given."""
        if leaves is None:
            return self._committed()
        ordered = sorted(set(leaves))
        frame = self.postings_between(list(zip(ordered, ordered)))
        # A longer list would bloat the plan; the join drops the rows between the ranges then.
        return frame.where(F.col("leaf").isin(leaves)) if len(leaves) <= MAX_LISTED else frame

    def postings_between(self, ranges: list[tuple[int, int]]) -> DataFrame:
        """Postings in ranges of leaves (first, last) that do not overlap, or at least all of those."""
        below = self.tree.k ** (self.tree.depth - 1)
        cells = sorted({cell for first, last in ranges for cell in range(first // below, last // below + 1)})
        return self._committed().where(F.col("cell0").isin(cells) & within_ranges(F.col("leaf"), ranges))

    def _committed(self) -> DataFrame:
        # Listed anew each time, so that appended batches are seen.
        frame = self.spark.read.schema(POSTINGS_SCHEMA).parquet(f"{self.path}/postings")
        return frame.where(within_exactly(F.col("batch"), stretches(self.batches())))

    def _generations(self) -> list:
        return read_merges(self.spark, self.path)

    def batches(self) -> list[int]:
        """Numbers of the batches that count now."""
        merges = self._generations()  # before the runs: a merge that ends in between is not seen at all
        written = [row.batch for row in self._all_runs().select("batch").distinct().collect()]
        merged = {row.batch for row in merges}
        gone = [(row.first, row.last) for row in merges]
        return sorted(
            n for n in written if (n >= 0 or n in merged) and not any(first <= n <= last for first, last in gone)
        )

    def _all_runs(self) -> DataFrame:
        return self.spark.read.schema(RUNS_SCHEMA).parquet(f"{self.path}/runs")

    def runs(self) -> DataFrame:
        return self._all_runs().where(within_exactly(F.col("batch"), stretches(self.batches())))

    def known(self, first: int, last: int) -> bool:
        """Whether a batch with a number in first..last was ever written, replaced ones included."""
        if any(row.first <= last and first <= row.last for row in self._generations()):
            return True
        return not self._all_runs().where(F.col("batch").between(first, last)).isEmpty()

    def compact(self, *, limits: Limits = DEFAULT_LIMITS) -> int | None:
        """Merges all batches that count now into one, while searches and ingest go on; its number.

        Nothing is routed again.  The merged batch takes effect with its generation,
        which is one small file; a compaction that dies before has no effect, and the
        next one takes its place.  Batches that arrive meanwhile stay as they are, and
        a replaced one that its stream writes again stays replaced.  Only one
        compaction may run at a time.  The old files stay, for searches that read
        them, until `vacuum`.
        """
        merges, old = self._generations(), self.batches()
        if len(old) < 2:
            return None
        number = min([0, *(row.batch for row in merges)]) - 1
        rows = self.spark.read.schema(POSTINGS_SCHEMA).parquet(f"{self.path}/postings")
        rows = rows.where(within_exactly(F.col("batch"), stretches(old))).select("image_id", "desc_no", "v", "leaf")
        write_postings(rows, self.tree, self.path, batch=number, limits=limits)
        # Complete, so that earlier generations need not be kept.
        replaced = joined([*stretches(old), *((row.first, row.last) for row in merges)])
        generation = self.spark.createDataFrame(replaced, "first BIGINT, last BIGINT").coalesce(1)
        generation.write.mode("overwrite").parquet(f"{self.path}/merges/batch={number}")
        return number

    def vacuum(self) -> list[int]:
        """Deletes the files of replaced batches; their numbers.

        To be called when no search that began before the last compaction still runs.
        """
        gone = [(row.first, row.last) for row in self._generations()]
        written = [row.batch for row in self._all_runs().select("batch").distinct().collect()]
        dropped = sorted(n for n in written if any(first <= n <= last for first, last in gone))
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for number in dropped:
            # the runs first: without them a batch does not count
            for part in ("runs", "radii", "postings"):
                folder = hadoop.Path(f"{self.path}/{part}/batch={number}")
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return dropped

    def radii(self) -> DataFrame:
        """level, cell, radius: the largest distance of a posting to the center of each cell above it."""
        rows = self.spark.read.schema(RADII_SCHEMA).parquet(f"{self.path}/radii")
        return rows.groupBy("level", "cell").agg(F.max("radius").alias("radius"))

    def cell_sizes(self, level: int | None = None) -> DataFrame:
        """Filed descriptors per cell of one level (leaves by default), without reading postings."""
        up = 0 if level is None else self.tree.depth - 1 - level
        cell = ancestor(F.col("leaf"), self.tree.k, up)
        return self.runs().groupBy(cell.alias("cell")).agg(F.sum("n").alias("n"))

    def numbered(self) -> DataFrame:
        """Postings with `ord`, the 1-based position inside the leaf.

        Rows of a leaf are numbered through the small runs table: the position
        inside the run plus the rows of the runs before it.  No window runs
        over the postings, so a leaf with most of the rows is no bottleneck.
        """
        earlier = (
            Window.partitionBy("leaf").orderBy("batch", "part").rowsBetween(Window.unboundedPreceding, -1)
        )
        starts = self.runs().select(
            "batch", "leaf", "part", "first_row", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before")
        )
        if self.runs().count() * RUN_BYTES <= self.tree.limits.broadcast_bytes:
            starts = F.broadcast(starts)
        rows = self.postings().withColumn("part", F.shiftright("row", ROW_BITS))
        return rows.join(starts, ["batch", "leaf", "part"]).select(
            F.col("leaf").alias("cell"),
            (F.col("_before") + F.col("row") - F.col("first_row") + 1).alias("ord"),
            "image_id",
            "desc_no",
            "v",
        )


def leaf_ranges(leaf: Column, leaves: list[int], most: int = MAX_RANGES) -> Column:
    """OR of at most `most` ranges covering `leaves`."""
    ordered = sorted(set(leaves))
    return within_ranges(leaf, list(zip(ordered, ordered)), most)


def within_ranges(leaf: Column, ranges: list[tuple[int, int]], most: int = MAX_RANGES) -> Column:
    """OR of at most `most` ranges that cover the given ones, for row-group statistics.

    Long IN lists reach Parquet only as one minimum and maximum; splitting them
    at their widest gaps keeps the skipping precise.
    """
    ordered = sorted(ranges)
    if not ordered:
        return F.lit(False)
    gap = [ordered[i][0] - ordered[i - 1][1] for i in range(1, len(ordered))]
    widest = sorted(range(1, len(ordered)), key=lambda i: gap[i - 1], reverse=True)
    cuts = sorted(i for i in widest[: most - 1] if gap[i - 1] > 1)
    condition = None
    for start, end in zip([0, *cuts], [*cuts, len(ordered)]):
        one = leaf.between(ordered[start][0], ordered[end - 1][1])
        condition = one if condition is None else condition | one
    return condition


def stretches(numbers: list[int]) -> list[tuple[int, int]]:
    """Sorted numbers as ranges of consecutive ones; a stream's batches are one, however many."""
    return joined([(n, n) for n in numbers])


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same numbers in as few ranges as there can be."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return out


def within_exactly(number: Column, ranges: list[tuple[int, int]]) -> Column:
    """Single numbers as one list and longer ranges as bounds."""
    single = [first for first, last in ranges if first == last]
    condition = number.isin(single) if single else F.lit(False)
    for first, last in ranges:
        if first < last:
            condition = condition | number.between(first, last)
    return condition


def read_merges(spark: SparkSession, path: str) -> list:
    """first, last, batch of all generations below path."""
    try:
        return spark.read.schema(MERGES_SCHEMA).parquet(f"{path}/merges").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def has_batches(spark: SparkSession, path: str) -> bool:
    """Whether a batch has been committed below path."""
    try:
        return not spark.read.schema(RUNS_SCHEMA).parquet(f"{path}/runs").isEmpty()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def build_index(
    points: DataFrame, tree: TreeModel, path: str, *, limits: Limits = DEFAULT_LIMITS
) -> Index:
    """File every point under its leaf and write the clustered index.

    The folder must not hold an index: its other batches were filed by another
    tree, or are what is read here.  Small batches are merged by `Index.compact`.
    """
    spark = points.sparkSession
    if has_batches(spark, path):
        raise ValueError(f"{path} holds an index; build into another folder")
    tree.save(spark, f"{path}/tree")
    append_postings(points, tree, path, batch=0, limits=limits)
    return Index(spark, path, tree)


def import_index(
    rows: DataFrame, tree: TreeModel, path: str, *, limits: Limits = DEFAULT_LIMITS
) -> Index:
    """An index from postings that name their leaf, without routing them again.

    rows: cell (the leaf), image_id, v, and ord or desc_no, which is kept as desc_no;
        what `read_index` gives.  A cell that the tree does not have is an error.
    """
    spark = rows.sparkSession
    if has_batches(spark, path):
        raise ValueError(f"{path} holds an index; build into another folder")
    tree.save(spark, f"{path}/tree")
    number = "desc_no" if "desc_no" in rows.columns else "ord"
    known = F.col("cell").between(0, tree.n_leaves - 1)
    leaf = F.when(known, F.col("cell")).otherwise(F.raise_error(F.lit("a posting names a cell that is no leaf")))
    filed = rows.select("image_id", F.col(number).cast("bigint").alias("desc_no"), "v", leaf.cast("int").alias("leaf"))
    write_postings(filed, tree, path, batch=0, limits=limits)
    return Index(spark, path, tree)


def append_postings(
    points: DataFrame, tree: TreeModel, path: str, *, batch: int, limits: Limits = DEFAULT_LIMITS
) -> None:
    """Route points and write them as one batch of postings; writing the same batch again replaces it."""
    filed = assign_cells(points.select("image_id", "desc_no", "v"), tree.levels, column="leaf", limits=limits)
    write_postings(filed, tree, path, batch=batch, limits=limits)


def write_postings(filed: DataFrame, tree: TreeModel, path: str, *, batch: int, limits: Limits = DEFAULT_LIMITS) -> None:
    """Write image_id, desc_no, v, leaf as one batch.

    The routed rows are written once as they come, so that no later step routes
    again.  The split points of the files are sampled from four narrow columns of
    that table, and the distances behind the radii are in it as well.
    Range partitioning on (leaf, image, descriptor) also splits a leaf that holds
    a large share of the rows over many files.
    """
    spark = filed.sparkSession
    named = F.coalesce("image_id", F.raise_error(F.lit("null image id"))).alias("image_id")
    # A hash stands in for v, as the keys of the range sample go to the driver.
    rows = filed.select("leaf", named, "desc_no", "v", F.xxhash64("v").alias("tie"))
    routed = new_table_path(spark, "filed")
    measured = with_distances(rows, tree, limits)
    measured.write.parquet(routed)
    stored = spark.read.schema(measured.schema).parquet(routed)

    count = stored.count()
    least = min(spark.sparkContext.defaultParallelism, ceil(count / 20_000))
    files = max(ceil(count / limits.rows_per_file), least, 1)
    order = ["cell0", "leaf", "image_id", "desc_no", "tie"]
    ordered = (
        stored.drop("dists")
        .withColumn("cell0", ancestor(F.col("leaf"), tree.k, tree.depth - 1))
        .repartitionByRange(files, *order)
        .sortWithinPartitions(*order, "v")
        .select("leaf", F.monotonically_increasing_id().alias("row"), "image_id", "desc_no", "v", "cell0")
    )
    target = f"{path}/postings/batch={batch}"
    ordered.write.mode("overwrite").partitionBy("cell0").parquet(target)
    farthest = stored.select("leaf", F.posexplode("dists").alias("level", "dist"))
    widths = F.array(*(F.lit(tree.k ** (tree.depth - 1 - level)) for level in range(tree.depth)))
    cell = F.call_function("div", F.col("leaf"), F.get(widths, F.col("level"))).cast("int")
    radii = farthest.groupBy("level", cell.alias("cell")).agg(F.max("dist").alias("radius"))
    radii.write.mode("overwrite").parquet(f"{path}/radii/batch={batch}")
    written = spark.read.schema("leaf INT, row BIGINT").parquet(target) if count else ordered
    runs = written.groupBy("leaf", F.shiftright("row", ROW_BITS).alias("part")).agg(
        F.min("row").alias("first_row"), F.count("*").alias("n")
    )
    runs.write.mode("overwrite").parquet(f"{path}/runs/batch={batch}")
    drop_table(spark, routed)


def with_distances(rows: DataFrame, tree: TreeModel, limits: Limits) -> DataFrame:
    """rows + dists: L1 distance to the center of each cell above the row, on the levels within the broadcast bound."""
    levels = resident_levels(tree.levels, limits)
    shipped = ship(levels, rows.sparkSession)
    k, dim, depth = tree.k, tree.dim, tree.depth

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, leaf = bytes_matrix(batch["v"], dim), batch["leaf"].to_numpy()
            dists = [l1_rows(x, level.value, leaf // k ** (depth - 1 - i)) for i, level in enumerate(shipped)]
            flat = pa.array(np.stack(dists, axis=1).ravel(), pa.int32())
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(len(dists)))
            column = pa.ListArray.from_arrays(ends, flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "dists"])

    schema = T.StructType([*rows.schema.fields, T.StructField("dists", T.ArrayType(T.IntegerType(), False))])
    return rows.mapInArrow(measure, schema)
