"""Levels with more centers than a task may hold, walked in passes of neighbouring parents.

Points are written once per level, dealt into passes by their cell on the level
above: a pass has so many parents that their children stay within
`Limits.pass_bytes`.  Walking the level reads each pass's folder alone, in a
map-only job that has just those children as a broadcast, and frees it.  No point
is shuffled in a round or a step of the descent, none carries centers along, and
neither the driver nor a task ever holds more than one pass of centers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellvote.operators.assign import assign_cells, resident_levels
from cellvote.operators.levels import Level, children_of
from cellvote.settings import Limits, drop_table, new_table_path

# step(batches, children of the pass's parents, number of its first parent) -> batches
Step = Callable[[Iterator[pa.RecordBatch], np.ndarray, int], Iterator[pa.RecordBatch]]


def needs_passes(levels: list[Level], limits: Limits) -> bool:
    return len(resident_levels(levels, limits)) < len(levels)


def parents_per_pass(level: Level, limits: Limits) -> int:
    return max(limits.pass_bytes // (level.k * level.dim), 1)


@dataclass
class Clustered:
    """Rows with their cell on the level above, stored under _pass=P."""

    spark: SparkSession
    path: str
    schema: T.StructType
    parents: int  # of each pass

    @classmethod
    def of(cls, points: DataFrame, levels: list[Level], limits: Limits) -> "Clustered":
        """The vectors of the points for rounds of the last level, with their cell above as `cell`."""
        above = assign_cells(points.select("v"), levels[:-1], limits=limits)
        return cls.of_cells(above, levels[-1], "cell", limits)

    @classmethod
    def of_cells(cls, rows: DataFrame, level: Level, column: str, limits: Limits) -> "Clustered":
        """rows: a column v, and the cell on the level above in `column`."""
        spark, parents = rows.sparkSession, parents_per_pass(level, limits)
        passes = ceil(level.size / level.k / parents)
        path = new_table_path(spark, f"clustered-{level.number}")
        # a pass with a large share of the points is dealt over several files
        spread = max(ceil(2 * spark.sparkContext.defaultParallelism / passes), 1)
        dealt = rows.withColumns(
            {
                "_pass": F.call_function("div", F.col(column), F.lit(parents)).cast("int"),
                "_file": F.monotonically_increasing_id() % spread,
            }
        )
        dealt.repartition("_pass", "_file").drop("_file").write.partitionBy("_pass").parquet(path)
        return cls(spark, path, rows.schema, parents)

    def walk(self, level: Level, step: Step, schema: T.StructType | str) -> DataFrame:
        """The step's rows over all passes, as a stored table."""
        out = new_table_path(self.spark, f"walked-{level.number}")
        stored = T.StructType([*self.schema.fields, T.StructField("_pass", T.IntegerType())])
        rows = self.spark.read.schema(stored).parquet(self.path)
        numbers = [row._pass for row in rows.select("_pass").distinct().orderBy("_pass").collect()]
        fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        if not numbers:
            return self.spark.createDataFrame([], fields)
        for number in numbers:
            first = number * self.parents
            last = min(first + self.parents, level.size // level.k)
            shipped = self.spark.sparkContext.broadcast(children_of(level, first, last))

            def run(batches, shipped=shipped, first=first):
                return step(batches, shipped.value, first)

            mine = rows.where(F.col("_pass") == number).drop("_pass")
            mine.mapInArrow(run, schema).write.parquet(f"{out}/_in={number}")
            shipped.destroy()
        read = T.StructType([*fields.fields, T.StructField("_in", T.IntegerType())])
        return self.spark.read.schema(read).parquet(out).select(*fields.names)

    def drop(self) -> None:
        drop_table(self.spark, self.path)
