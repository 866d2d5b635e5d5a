import tempfile

from cellvote import Index
from cellvote.__main__ import run
from cellvote.sources.descriptors import write_descriptors
from cellvote.sources.text import write_centers, write_queries
from cellvote.plans.tree import fit_kmeans
from tests.conftest import clustered


def test_fit_search_watch_and_words(spark, make_points):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    rows = clustered(60, 8, seed=41)
    points = make_points(rows)
    write_descriptors(points, f"{folder}/bin", 8)
    write_centers(fit_kmeans(points, k=2, iterations=0), f"{folder}/centers")
    run(
        spark,
        [
            "fit", f"{folder}/bin", f"{folder}/index", "--dim", "8", "--k", "2", "--depth", "2", "--iterations", "1",
            "--centers", f"{folder}/centers", "--snapshots", f"{folder}/rounds",
        ],
    )
    assert Index.open(spark, f"{folder}/index").postings().count() == 60

    one = points.where("image_id = '0000000000000003'").selectExpr("3 AS query_id", "desc_no", "v").coalesce(1)
    write_queries(one, f"{folder}/queries")
    where = [f"{folder}/queries/query_id=3", f"{folder}/index"]
    run(spark, ["search", *where, f"{folder}/answers", "--vote-limit", "3"])
    run(spark, ["watch", *where, f"{folder}/streamed", f"{folder}/state", "--vote-limit", "3", "--once"])
    batch, streamed = (
        sorted((r["rank"], r.image_id, r.votes) for r in spark.read.parquet(f"{folder}/{name}").collect())
        for name in ("answers", "streamed")
    )
    assert batch == streamed and "0000000000000003" in {image for _, image, _ in batch}

    with open(f"{folder}/lines.txt", "w") as out:
        out.write("a b\na\n")
    run(spark, ["words", f"{folder}/lines.txt", f"{folder}/counts"])
    assert sorted(r.value for r in spark.read.text(f"{folder}/counts").collect()) == ["a\t2", "b\t1"]
