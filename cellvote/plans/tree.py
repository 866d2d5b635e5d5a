"""Fitting, saving and loading the hierarchical k-means tree."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellvote.operators.assign import cells_of_level
from cellvote.operators.levels import CENTERS_SCHEMA, Level, center_rows, check_count
from cellvote.operators.passes import Clustered, needs_passes
from cellvote.operators.rounds import center_shift, run_round
from cellvote.operators.seeds import find_seeds
from cellvote.settings import DEFAULT_LIMITS, Limits, ensure_checkpoint_dir, new_table_path
from cellvote.sources.text import read_centers

META_SCHEMA = "k INT, dim INT, depth INT, iterations INT"
IDENTITY_SCHEMA = "fit STRING, points STRING, seeds STRING"


@dataclass
class TreeModel:
    """A fitted tree: `depth` levels, level l with k**(l+1) centers."""

    k: int
    dim: int
    iterations: int
    levels: list[Level]
    limits: Limits = DEFAULT_LIMITS
    shifts: list[tuple[int, int, int]] = field(default_factory=list)  # (level, iteration, total L1 movement)

    @property
    def depth(self) -> int:
        return len(self.levels)

    @property
    def n_leaves(self) -> int:
        return self.k**self.depth

    def centers(self, spark: SparkSession) -> DataFrame:
        return cells_of_level(spark, self.levels)

    def stats(self, spark: SparkSession) -> DataFrame:
        """Centers and filed points per level."""
        return self.centers(spark).groupBy("level").agg(
            F.count("*").alias("centers"), F.sum("n").alias("points"), F.count_if(F.col("n") == 0).alias("empty")
        )

    def save(self, spark: SparkSession, path: str) -> None:
        meta = spark.createDataFrame([(self.k, self.dim, self.depth, self.iterations)], META_SCHEMA)
        centers = self.centers(spark)
        ordered = centers.repartitionByRange("level", "center_id").sortWithinPartitions("level", "center_id")
        ordered.write.mode("overwrite").partitionBy(
            "level"
        ).parquet(f"{path}/centers")
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def from_text(
        cls, spark: SparkSession, paths: list[str], *, k: int, iterations: int = 0, limits: Limits = DEFAULT_LIMITS
    ) -> "TreeModel":
        """The tree whose levels' centers stand in text files, the top level first.

        Every level must be whole: ids 0 .. k**(level+1) - 1, vectors of one length.
        Levels beyond the broadcast bound are written as a table once and stay one.
        """
        frames = [read_centers(spark, path, number, k) for number, path in enumerate(paths)]
        if not frames:
            raise ValueError("no center files")
        first = frames[0].select(F.length("center").alias("dim")).head()
        if first is None:
            raise ValueError(f"no centers in {paths[0]}")
        levels = []
        for number, rows in enumerate(frames):
            if not Level(number, k, first.dim).on_driver(limits):
                path = new_table_path(spark, f"centers-{number}")
                rows.repartitionByRange("center_id").sortWithinPartitions("center_id").write.parquet(path)
                rows = spark.read.schema(CENTERS_SCHEMA).parquet(path)
            levels.append(read_level(rows, number, k, first.dim, limits))
        return cls(k, first.dim, iterations, levels, limits)

    @classmethod
    def load(cls, spark: SparkSession, path: str, limits: Limits = DEFAULT_LIMITS) -> "TreeModel":
        meta = spark.read.schema(META_SCHEMA).parquet(f"{path}/meta").head()
        centers = spark.read.schema(CENTERS_SCHEMA).parquet(f"{path}/centers")
        levels = [
            read_level(centers.where(F.col("level") == number), number, meta.k, meta.dim, limits)
            for number in range(meta.depth)
        ]
        return cls(meta.k, meta.dim, meta.iterations, levels, limits)


def read_level(rows: DataFrame, number: int, k: int, dim: int, limits: Limits) -> Level:
    """Level from stored centers, on the driver if its size allows."""
    level = Level(number, k, dim)
    if level.on_driver(limits):
        return Level.collected(number, k, dim, rows)
    check_count(rows.count(), number, k)
    return replace(level, table=center_rows(rows, number, k))


def point_dim(points: DataFrame) -> int:
    first = points.select(F.length("v").alias("dim")).head()
    if first is None:
        raise ValueError("cannot fit a tree on no points")
    if not first.dim:
        raise ValueError("null or empty descriptor vector")
    return first.dim


def fit_tree(
    points: DataFrame,
    *,
    k: int,
    depth: int,
    iterations: int,
    seeds: DataFrame | None = None,
    empty: str = "keep",
    tol: int | None = None,
    snapshots: str | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> TreeModel:
    """Fit the tree level by level, with a fixed number of rounds per level.

    points: image_id, desc_no, v.  Read once per round, so pass a stored table
        rather than a long plan.
    seeds: centers of level 0 to start from (center_id, center); by default the
        first k distinct vectors.
    empty: "keep" leaves a center without points in place, "error" raises.
    tol: stop a level early once its centers move by no more than this in total.
    snapshots: folder for the centers of every round; a later call with the
        same folder continues after the last complete round.  The folder belongs
        to one fit: other points, seeds, k, rounds or stop rule are an error.
    A level is built only if every parent has k distinct vectors; otherwise the
    tree ends above it.
    """
    if k < 2 or depth < 1 or iterations < 0 or empty not in ("keep", "error"):
        raise ValueError("need k >= 2, depth >= 1, iterations >= 0 and empty in ('keep', 'error')")
    if k**depth > np.iinfo(np.int32).max:
        raise ValueError("k**depth must fit 31 bits")
    spark = points.sparkSession
    dim = point_dim(points)
    tree = TreeModel(k, dim, iterations, [], limits)
    if snapshots:
        _claim(snapshots, points, seeds, f"k={k} dim={dim} iterations={iterations} empty={empty} tol={tol}")
    for number in range(depth):
        clustered = None
        start, level, shift = _last_snapshot(spark, snapshots, number, k, dim, iterations, limits)
        if level is None:
            level = _seed_level(points, tree, seeds if number == 0 else None)
            if level is None:
                break
        for iteration in range(start + 1, iterations + 1):
            if tol is not None and shift is not None and shift <= tol:
                break
            levels = [*tree.levels, level]
            if clustered is None and needs_passes(levels, limits):
                clustered = Clustered.of(points, levels, limits)
            new = run_round(points, levels, empty=empty, limits=limits, clustered=clustered)
            shift = _shift(spark, level, new)
            tree.shifts.append((number, iteration, shift))
            level.release()  # made here, and nothing lazy is left that reads it
            level = new
            if snapshots:
                _write_snapshot(spark, snapshots, level, iteration, shift)
        tree.levels.append(level)
        if clustered is not None:
            clustered.drop()
    return tree


def fit_kmeans(points: DataFrame, *, k: int, iterations: int, **options) -> DataFrame:
    """Flat k-means: the centers frame of a tree of one level."""
    return fit_tree(points, k=k, depth=1, iterations=iterations, **options).centers(points.sparkSession)


def _seed_level(points: DataFrame, tree: TreeModel, given: DataFrame | None) -> Level | None:
    """Starting centers of the next level, or None if it cannot be built."""
    number, k, dim = tree.depth, tree.k, tree.dim
    level = Level(number, k, dim)
    if given is not None:
        rows = center_rows(given.select("center_id", F.lit(0).alias("n"), "center"), number, k)
    else:
        rows = find_seeds(points, tree.levels, k, dim, limits=tree.limits)
    spark = points.sparkSession
    if level.on_driver(tree.limits):
        rows = spark.createDataFrame(rows.toArrow(), CENTERS_SCHEMA)
    else:
        ensure_checkpoint_dir(spark)
        rows = rows.checkpoint()
    found = rows.count()
    if found < level.size and given is None:
        if number == 0:
            raise ValueError(f"only {found} distinct vectors for k = {k}")
        return None
    return read_level(rows, number, k, dim, tree.limits)


def _shift(spark: SparkSession, old: Level, new: Level) -> int:
    if new.array is not None:
        return int(np.abs(old.array.astype(np.int64) - new.array).sum())
    return center_shift(old.frame(spark), new.frame(spark)).head().shift


def _fingerprint(rows: DataFrame, *columns: str) -> str:
    """Number of rows and a sum of their hashes: the same for the same rows in any order."""
    hashed = F.xxhash64(*columns).cast("decimal(20,0)")
    found = rows.agg(F.count("*").alias("n"), F.sum(hashed).alias("total")).head()
    return f"{found.n}:{found.total or 0}"


def _claim(folder: str, points: DataFrame, seeds: DataFrame | None, fit: str) -> None:
    """Write into the snapshot folder which fit it belongs to, or check that it is this one."""
    spark = points.sparkSession
    of_points = _fingerprint(points, "image_id", "desc_no", "v")
    of_seeds = "first distinct" if seeds is None else _fingerprint(seeds, "center_id", "center")
    mine = (fit, of_points, of_seeds)
    path = f"{folder}/identity"
    try:
        known = spark.read.schema(IDENTITY_SCHEMA).parquet(path).head()
    except AnalysisException:
        known = None
    if known is None:
        spark.createDataFrame([mine], IDENTITY_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
    elif tuple(known) != mine:
        raise ValueError(f"{folder} has the snapshots of another fit: {tuple(known)}, not {mine}")


def _snapshot(folder: str, number: int, iteration: int) -> str:
    return f"{folder}/level={number}/iteration={iteration}"


def _write_snapshot(spark: SparkSession, folder: str, level: Level, iteration: int, shift: int) -> None:
    rows = level.frame(spark)
    if level.table is None:
        rows = rows.coalesce(1)
    rows.withColumn("shift", F.lit(shift)).write.mode("overwrite").parquet(_snapshot(folder, level.number, iteration))


def _last_snapshot(
    spark: SparkSession, folder: str | None, number: int, k: int, dim: int, iterations: int, limits: Limits
) -> tuple[int, Level | None, int | None]:
    """Iteration, level and shift of the last complete round on file."""
    schema = f"{CENTERS_SCHEMA}, shift BIGINT"
    for iteration in range(iterations if folder else 0, 0, -1):
        try:
            rows = spark.read.schema(schema).parquet(_snapshot(folder, number, iteration))
            return iteration, read_level(rows, number, k, dim, limits), rows.head().shift
        except (AnalysisException, ValueError):
            continue  # absent, or cut off half-way
    return 0, None, None
