"""Similar-image search over local descriptors, as Spark jobs.

Points are rows ``(image_id STRING, desc_no BIGINT, v BINARY)`` with one
unsigned byte per dimension.  A hierarchical k-means tree under L1 distance is
fitted over them, every point is filed under a leaf in a clustered Parquet
index, and query images are answered by routing, ranking and voting.
"""

import sys

from pyspark import cloudpickle

# The task-side helpers travel with the plans, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from cellvote.plans.index import Index, build_index  # noqa: E402
from cellvote.plans.search import route, search, search_votes  # noqa: E402
from cellvote.plans.tree import TreeModel, fit_kmeans, fit_tree  # noqa: E402
from cellvote.settings import Limits  # noqa: E402

__all__ = [
    "Index",
    "Limits",
    "TreeModel",
    "build_index",
    "fit_kmeans",
    "fit_tree",
    "route",
    "search",
    "search_votes",
]
