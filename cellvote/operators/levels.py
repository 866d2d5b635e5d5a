"""One level of a fitted tree, on the driver while small, else as a table."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellvote.functions.vectors import ancestor
from cellvote.operators.kernels import bytes_matrix, matrix_column
from cellvote.settings import Limits

CENTERS_SCHEMA = "level INT, center_id INT, parent_id INT, n BIGINT, center BINARY"


@dataclass
class Level:
    """The k**(number+1) centers of one level.

    `array`/`counts` are set when the level is small enough for the driver;
    otherwise only `table` (CENTERS_SCHEMA) is.
    """

    number: int
    k: int
    dim: int
    array: np.ndarray | None = None
    counts: np.ndarray | None = None
    table: DataFrame | None = field(default=None, repr=False)
    _shipped: Broadcast | None = field(default=None, repr=False)

    @property
    def size(self) -> int:
        return self.k ** (self.number + 1)

    @property
    def driver_bytes(self) -> int:
        """Bytes one round of this level brings to the driver (center, id, count, overhead)."""
        return self.size * (self.dim + 64)

    def frame(self, spark: SparkSession) -> DataFrame:
        if self.table is not None:
            return self.table
        ids = np.arange(self.size, dtype=np.int32)
        arrow = pa.table(
            {
                "level": np.full(self.size, self.number, np.int32),
                "center_id": ids,
                "parent_id": (ids // self.k).astype(np.int32),
                "n": self.counts.astype(np.int64),
                "center": matrix_column(self.array),
            }
        )
        return spark.createDataFrame(arrow, CENTERS_SCHEMA)

    def shipped(self, context: SparkContext) -> Broadcast:
        """The array as a broadcast, sent once for as long as the level is in use."""
        if self._shipped is None or self._shipped._sc is not context:
            self._shipped = context.broadcast(self.array)
        return self._shipped

    def release(self) -> None:
        """Free the broadcast of a level that is not needed on the executors any more."""
        if self._shipped is not None:
            self._shipped.destroy()
            self._shipped = None

    def on_driver(self, limits: Limits) -> bool:
        """Whether the level is kept as an array.  Level 0 is: it has only k rows."""
        if self.number == 0:
            if self.driver_bytes > limits.top_level_bytes:
                raise ValueError(f"k = {self.k} is too large: the top level must stay below Limits.top_level_bytes")
            return True
        return self.driver_bytes <= limits.broadcast_bytes

    @classmethod
    def collected(cls, number: int, k: int, dim: int, rows: DataFrame) -> "Level":
        """Level from a checked-size frame with center_id, n, center."""
        arrow = rows.select("center_id", "n", "center").toArrow().sort_by("center_id").combine_chunks()
        check_count(arrow.num_rows, number, k)
        ids = arrow["center_id"].to_numpy()
        if (ids != np.arange(len(ids))).any():
            raise ValueError(f"level {number}: center ids are not 0..{len(ids) - 1}")
        center = arrow["center"].combine_chunks()
        return cls(number, k, dim, bytes_matrix(center, dim).copy(), arrow["n"].to_numpy().copy())


def children_of(level: Level, first: int, last: int) -> np.ndarray:
    """The centers below the parents first..last-1, from the array or by a scan of their range of the table."""
    low, high = first * level.k, last * level.k
    if level.array is not None:
        return level.array[low:high]
    rows = level.table.where((F.col("center_id") >= low) & (F.col("center_id") < high)).select("center_id", "center")
    arrow = rows.toArrow().sort_by("center_id").combine_chunks()
    if arrow.num_rows != high - low:
        raise ValueError(f"level {level.number} has {arrow.num_rows} centers in {low}..{high - 1}")
    return bytes_matrix(arrow["center"].combine_chunks(), level.dim).copy()


def check_count(found: int, number: int, k: int) -> None:
    expected = k ** (number + 1)
    if found != expected:
        raise ValueError(f"level {number} has {found} centers, expected {expected}")


def center_rows(cell_rows: DataFrame, number: int, k: int) -> DataFrame:
    """Frame with center_id, n, center -> CENTERS_SCHEMA."""
    return cell_rows.select(
        F.lit(number).alias("level"),
        F.col("center_id").cast("int").alias("center_id"),
        ancestor(F.col("center_id"), k).alias("parent_id"),
        F.col("n").cast("bigint").alias("n"),
        "center",
    )
