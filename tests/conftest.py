import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from checks.compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield spark


@pytest.fixture
def make_points(spark):
    """Points frame from (image, desc_no, values) rows; images are small numbers."""

    def build(rows, partitions=3):
        data = [(f"{image:016x}", desc, bytearray(values)) for image, desc, values in rows]
        frame = spark.createDataFrame(data, "image_id STRING, desc_no BIGINT, v BINARY")
        return frame.repartition(partitions).cache()

    return build


def clustered(rows: int, dim: int, seed: int, per_image: int = 5, spread: int = 6):
    """Seeded rows around a few centers, with copies of whole vectors among them."""
    rng = np.random.default_rng(seed)
    middle = rng.integers(20, 230, (9, dim))
    x = np.clip(middle[rng.integers(0, 9, rows)] + rng.integers(-spread, spread + 1, (rows, dim)), 0, 255)
    x[rows // 2 : rows // 2 + rows // 4] = x[0]
    return [(i // per_image, i % per_image, x[i].tolist()) for i in range(rows)]
