
from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from cellvote import Index, TreeModel, build_index, fit_tree, route, search, search_votes  # noqa: E402
from cellvote.functions import vectors as vec  # noqa: E402
from cellvote.operators import ingest, votes  # noqa: E402
from cellvote.operators.assign import assign_cells  # noqa: E402
from cellvote.operators.levels import Level  # noqa: E402
from cellvote.operators.rounds import center_shift, run_round  # noqa: E402
from cellvote.operators.seeds import find_seeds  # noqa: E402
from cellvote.operators.words import word_count  # noqa: E402
from cellvote.plans.exact import exact_candidates, visits  # noqa: E402
from cellvote.plans.index import import_index  # noqa: E402
from cellvote.plans.search import leaves_hit, nearest_candidates  # noqa: E402
from cellvote.settings import Limits, new_table_path  # noqa: E402
from cellvote.sources import descriptors as records  # noqa: E402
from cellvote.sources import text as texts  # noqa: E402
from cellvote.streaming import jobs  # noqa: E402
from checks import oracle  # noqa: E402
from checks.oracle import BEAM, DEPTH, K, MANY_VOTES, ROUNDS, TOP, VOTE_LIMIT  # noqa: E402

try:  # the operators for training text are an optional part
    import corpus_pipeline
    from cellvote.llm import queries as text_queries
except ModuleNotFoundError as error:
    if error.name not in ("corpus_pipeline", "cellvote.llm", "public_tokenizers"):
        raise
    corpus_pipeline = text_queries = None


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def points_of(embeddings: DataFrame) -> DataFrame:
    """embeddings as descriptors: ten per image."""
    image = F.call_function("div", F.col("vec_id"), F.lit(10))
    return ingest.points_from_arrays(
        embeddings,
        F.lower(F.lpad(F.hex(image), 16, "0")),
        F.col("vec_id") % 10,
        vec.quantize_unit(F.col("embedding")),
    )


@dataclass
class Fixture:
    """Points, tree and index of one data folder, each made once per session."""

    spark: SparkSession
    sf: str

    @cached_property
    def points(self) -> DataFrame:
        path = new_table_path(self.spark, "points")
        points_of(read(self.spark, self.sf, "embeddings")).write.parquet(path)
        return self.spark.read.parquet(path)

    @property
    def queries(self) -> DataFrame:
        """Every image as a query."""
        number = F.conv("image_id", 16, 10).cast("bigint")
        return self.points.select(number.alias("query_id"), "desc_no", "v")

    @cached_property
    def tree(self) -> TreeModel:
        return fit_tree(self.points, k=K, depth=DEPTH, iterations=ROUNDS)

    @cached_property
    def index(self) -> Index:
        return build_index(self.points, self.tree, new_table_path(self.spark, "index"))

    @cached_property
    def deep(self) -> TreeModel:
        """The same tree fitted beyond the broadcast bound, a level in passes of two parents."""
        limits = Limits(broadcast_bytes=0, pass_bytes=2 * K * self.tree.dim)
        return fit_tree(self.points, k=K, depth=DEPTH, iterations=ROUNDS, limits=limits)

    def rounds(self, number: int) -> list[Level]:
        """Seeds of a level and its centers after each round."""
        above = self.tree.levels[:number]
        seeds = find_seeds(self.points, above, K, self.tree.dim)
        levels = [Level.collected(number, K, self.tree.dim, seeds)]
        for _ in range(ROUNDS):
            levels.append(run_round(self.points, [*above, levels[-1]]))
        return levels


_fixtures: dict[tuple[str, str], Fixture] = {}


def fixture(spark: SparkSession, sf: str) -> Fixture:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fixtures:
        _fixtures[key] = Fixture(spark, sf)
    return _fixtures[key]


def center_text(frame: DataFrame) -> DataFrame:
    return frame.select("level", "center_id", "parent_id", "n", vec.vector_text(F.col("center")).alias("center"))


# --- scalar functions -------------------------------------------------------


def quantize(spark, sf):
    return points_of(read(spark, sf, "embeddings")).select("image_id", "desc_no", vec.vector_text(F.col("v")).alias("v"))


def truncate_floats(spark, sf):
    """Float components cut to whole numbers, towards zero."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * 1000)
    cut = F.transform(vec.truncate_values(scaled), lambda x: x.cast("string"))
    return read(spark, sf, "embeddings").select("vec_id", F.array_join(cut, " ").alias("v"))


def explode_descriptors(spark, sf):
    """Images with a matrix of float descriptors each, as one row per descriptor."""
    image = F.call_function("div", F.col("vec_id"), F.lit(10)).alias("image")
    floats = F.transform("embedding", lambda x: (x.cast("double") + 1) * 127.5).alias("values")
    rows = read(spark, sf, "embeddings").select(image, "vec_id", floats)
    images = rows.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("vec_id", "values"))).alias("rows"))
    images = images.select("image", F.col("rows.values").alias("matrix"))
    return ingest.explode_descriptors(images, "image", "matrix").select("image", "desc_no", vec.vector_text(F.col("v")).alias("v"))


def image_hex(spark, sf):
    hexed = F.substring(F.md5(F.col("vec_id").cast("string").cast("binary")), 1, 16)
    stored = read(spark, sf, "embeddings").select("vec_id", vec.image_bytes(hexed).alias("stored"))
    return stored.select(
        "vec_id", F.lower(F.hex("stored")).alias("stored_hex"), vec.image_hex(F.col("stored")).alias("image_id")
    )


def file_names(spark, sf):
    """Names as an image folder might hold: hex ones and others."""
    pages = read(spark, sf, "pages")
    hexed = F.concat(F.substring(F.md5(F.col("url").cast("binary")), 1, 20), F.lit(".jpg"))
    return pages.select(F.explode(F.array(hexed, F.col("url"))).alias("name"))


def image_id_parse(spark, sf):
    return file_names(spark, sf).select("name", vec.image_id_parse(F.col("name")).alias("image_id"))


def rejected_names(spark, sf):
    parsed = vec.image_id_parse(F.col("name"))
    return file_names(spark, sf).agg(F.count_if(parsed.isNull()).alias("rejected"), F.count(parsed).alias("valid"))


def thumb_dims(spark, sf):
    parts = read(spark, sf, "part")
    dims = vec.thumb_dims(F.col("p_size") * 30, F.floor("p_retailprice"))
    return parts.select("p_partkey", dims.alias("d")).select("p_partkey", "d.h", "d.w")


def l1_distance(spark, sf):
    rows = read(spark, sf, "embeddings").select("vec_id", vec.quantize_unit(F.col("embedding")).alias("v"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return rows.join(after, "vec_id").select("vec_id", vec.l1_distance(F.col("v"), F.col("w")).alias("dist"))


# --- tree -------------------------------------------------------------------


def seeds(number):
    def run(spark, sf):
        fx = fixture(spark, sf)
        found = find_seeds(fx.points, fx.tree.levels[:number], K, fx.tree.dim)
        return center_text(found).select("center_id", "center")

    return run


def assign(number):
    def run(spark, sf):
        fx = fixture(spark, sf)
        return assign_cells(fx.points, fx.tree.levels[: number + 1]).select("image_id", "desc_no", "cell")

    return run


def kmeans(number):
    def run(spark, sf):
        return center_text(fixture(spark, sf).rounds(number)[-1].frame(spark))

    return run


def kmeans_l1_shuffled(spark, sf):
    """Rounds of a level whose centers no task holds whole."""
    return center_text(fixture(spark, sf).deep.levels[1].frame(spark))


def seeds_l2_shuffled(spark, sf):
    """Seeds below a level whose centers no task holds whole."""
    fx = fixture(spark, sf)
    found = find_seeds(fx.points, fx.deep.levels, K, fx.deep.dim, limits=fx.deep.limits)
    return center_text(found).select("center_id", "center")


def tree_from_text(spark, sf):
    """The fitted tree written as text files and read back as a tree."""
    return center_text(text_tree(spark, sf).centers(spark))


def text_tree(spark, sf):
    fx, paths = fixture(spark, sf), []
    for level in fx.tree.levels:
        paths.append(new_table_path(spark, f"tree-text-{level.number}"))
        texts.write_centers(level.frame(spark), paths[-1])
    return TreeModel.from_text(spark, paths, k=K)


def tree_centers(spark, sf):
    return center_text(fixture(spark, sf).tree.centers(spark))


def tree_stats(spark, sf):
    return fixture(spark, sf).tree.stats(spark)


def center_shifts(spark, sf):
    moves = []
    for number in range(DEPTH):
        levels = fixture(spark, sf).rounds(number)
        for iteration, (old, new) in enumerate(zip(levels, levels[1:]), 1):
            shift = center_shift(old.frame(spark), new.frame(spark))
            moves.append(shift.select("level", F.lit(iteration).alias("iteration"), "shift"))
    out = moves[0]
    for frame in moves[1:]:
        out = out.unionByName(frame)
    return out


# --- index ------------------------------------------------------------------


def index_build(spark, sf):
    rows = fixture(spark, sf).index.numbered()
    return rows.select("cell", "ord", "image_id", "desc_no", vec.vector_text(F.col("v")).alias("v"))


def cell_sizes(spark, sf):
    index = fixture(spark, sf).index
    per_level = [index.cell_sizes(number).select(F.lit(number).alias("level"), "cell", "n") for number in range(DEPTH)]
    return per_level[0].unionByName(per_level[1])


def index_partition_sizes(spark, sf):
    stored = fixture(spark, sf).index.postings().groupBy("cell0", "leaf").agg(F.count("*").alias("n"))
    return stored.groupBy("cell0").agg(F.sum("n").alias("n"), F.count("*").alias("leaves"))


def leaf_prune(spark, sf):
    """Leaves that the descriptors with an id divisible by 100 are routed to."""
    fx = fixture(spark, sf)
    asked = fx.queries.where((F.col("query_id") * 10 + F.col("desc_no")) % 100 == 0)
    return leaves_hit(route(asked, fx.index), fx.index).select("leaf", "n")


# --- search -----------------------------------------------------------------


def routed(n_probe):
    def run(spark, sf):
        fx = fixture(spark, sf)
        return route(fx.queries, fx.index, n_probe=n_probe).select("query_id", "desc_no", "leaf")

    return run


def nearest(n_probe):
    def run(spark, sf):
        fx = fixture(spark, sf)
        return nearest_candidates(fx.queries, fx.index, vote_limit=VOTE_LIMIT, n_probe=n_probe)

    return run


def route_beam_shuffled(spark, sf):
    fx = fixture(spark, sf)
    index = Index(spark, fx.index.path, fx.deep)
    return route(fx.queries, index, n_probe=BEAM, limits=fx.deep.limits).select("query_id", "desc_no", "leaf")


def vote_rows(spark, sf):
    fx = fixture(spark, sf)
    return search_votes(fx.queries, fx.index, vote_limit=VOTE_LIMIT)


def vote_count(spark, sf):
    return votes.count_votes(vote_rows(spark, sf))


def search_topk(spark, sf, n_probe=1):
    fx = fixture(spark, sf)
    return search(fx.queries, fx.index, vote_limit=VOTE_LIMIT, top=TOP, n_probe=n_probe)


def search_beam(spark, sf):
    return search_topk(spark, sf, n_probe=BEAM)


def answer_string(spark, sf):
    return votes.answers(search_topk(spark, sf))


def answer_all(spark, sf):
    """Every query gets an answer, though with so many votes asked for many have no image."""
    fx = fixture(spark, sf)
    return votes.answers(search(fx.queries, fx.index, vote_limit=VOTE_LIMIT, top=TOP, min_votes=MANY_VOTES), fx.queries)


def search_topk_shuffled(spark, sf):
    """The search beyond every broadcast bound."""
    fx = fixture(spark, sf)
    return search(fx.queries, fx.index, vote_limit=VOTE_LIMIT, top=TOP, limits=Limits(broadcast_bytes=0))


def knn_exact(spark, sf):
    """Nearest candidates among all postings, by leaves that the triangle inequality leaves."""
    fx = fixture(spark, sf)
    return exact_candidates(fx.queries, fx.index, vote_limit=VOTE_LIMIT)


def exact_visits(spark, sf):
    """Leaves that the exact search visits for each query descriptor."""
    fx = fixture(spark, sf)
    found = visits(fx.queries, fx.index, vote_limit=VOTE_LIMIT)
    return found.groupBy("query_id", "desc_no").agg(F.count("*").alias("leaves"))


def search_exact(spark, sf):
    fx = fixture(spark, sf)
    return search(fx.queries, fx.index, vote_limit=VOTE_LIMIT, top=TOP, exact=True)


def answer_parse(spark, sf):
    return votes.parsed_answers(answer_string(spark, sf))


def recall_at_n(spark, sf, n_probe=1):
    """Votes found with n_probe leaves among those found when every leaf is probed."""
    keys = ["query_id", "desc_no", "image_id"]
    exact = votes.votes_of(nearest(K**DEPTH)(spark, sf))
    found = votes.votes_of(nearest(n_probe)(spark, sf)).withColumn("hit", F.lit(1))
    joined = exact.join(found, keys, "left")
    return joined.groupBy("query_id").agg(F.count("*").alias("exact"), F.count("hit").alias("found"))


# --- text, ingest, files ----------------------------------------------------


def count_words(spark, sf):
    return word_count(read(spark, sf, "documents"))


def ingest_stats(spark, sf):
    return ingest.ingest_stats(fixture(spark, sf).points)


def ingest_totals(spark, sf):
    return ingest.ingest_totals(fixture(spark, sf).points)


def merged_ids(spark, sf):
    name = F.concat(F.md5(F.col("p_type").cast("binary")), F.col("p_brand"))
    return ingest.merged_ids(read(spark, sf, "part").select(name.alias("name")))


def ingest_resume(spark, sf):
    files = file_names(spark, sf)
    marker = files.where(F.col("name").startswith("8")).agg(F.min("name").alias("name")).head().name
    return ingest.resume_from(files, marker)


def ingest_not_loaded(spark, sf):
    files = fixture(spark, sf).points.select(F.concat("image_id", F.lit(".jpg")).alias("name")).distinct()
    loaded = points_of(read(spark, sf, "embeddings").where(F.col("label") == 0))
    return ingest.not_loaded(files, loaded).select("image_id", "name")


def centers_text_roundtrip(spark, sf):
    out = None
    for level in fixture(spark, sf).tree.levels:
        path = new_table_path(spark, f"centers-text-{level.number}")
        texts.write_centers(level.frame(spark), path)
        back = center_text(texts.read_centers(spark, path, level.number, K))
        out = back if out is None else out.unionByName(back)
    return out


def index_text_roundtrip(spark, sf):
    path = new_table_path(spark, "index-text")
    texts.write_index(fixture(spark, sf).index.numbered(), path)
    return texts.read_index(spark, path).select("cell", "ord", "image_id", vec.vector_text(F.col("v")).alias("v"))


def search_from_text_index(spark, sf):
    """Tree and postings read from text files, and searched without routing the postings again."""
    path = new_table_path(spark, "index-text")
    texts.write_index(fixture(spark, sf).index.numbered(), path)
    tree = text_tree(spark, sf)
    index = import_index(texts.read_index(spark, path), tree, new_table_path(spark, "imported"))
    return search(fixture(spark, sf).queries, index, vote_limit=VOTE_LIMIT, top=TOP)


def query_text_roundtrip(spark, sf):
    path = new_table_path(spark, "queries-text")
    texts.write_queries(fixture(spark, sf).queries, path)
    back = texts.read_queries(spark, path)
    return back.select(F.col("query_id").cast("bigint").alias("query_id"), "desc_no", vec.vector_text(F.col("v")).alias("v"))


def descriptor_scan(spark, sf):
    fx = fixture(spark, sf)
    path = new_table_path(spark, "descriptors")
    records.write_descriptors(fx.points, path, fx.tree.dim)
    back = records.scan_descriptors(spark, path, fx.tree.dim)
    return back.select("image_id", vec.vector_text(F.col("v")).alias("v"))


# --- streams ----------------------------------------------------------------


def stream_search(spark, sf):
    """All images as arriving query files, answered in micro-batches."""
    fx = fixture(spark, sf)
    source, answered, checkpoint = (new_table_path(spark, f"stream-{part}") for part in ("in", "out", "state"))
    # hash partitioning keeps an image in one file
    fx.queries.repartition(4, "query_id").write.parquet(source)
    jobs.stream_search(
        jobs.query_stream(spark, source, files_per_batch=2),
        fx.index,
        answered,
        checkpoint,
        vote_limit=VOTE_LIMIT,
        top=TOP,
    ).awaitTermination()
    return spark.read.parquet(answered).select("query_id", "rank", "image_id", "votes")


def stream_ingest(spark, sf):
    """Half the points built in one go, and the others streamed in from two sources."""
    fx = fixture(spark, sf)
    index = build_index(fx.points.where(F.col("desc_no") < 5), fx.tree, new_table_path(spark, "ingest-index"))
    for late in (F.col("desc_no").between(5, 7), F.col("desc_no") > 7):
        source, checkpoint = (new_table_path(spark, f"ingest-{part}") for part in ("in", "state"))
        fx.points.where(late).repartition(2).write.parquet(source)
        jobs.stream_ingest(jobs.point_stream(spark, source, files_per_batch=1), index, checkpoint).awaitTermination()
    return index.postings().select("leaf", "image_id", "desc_no")


# --- contract ---------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the ten best images for every image of the sf0.001 tables."""
    return search_topk(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    if text_queries is None:
        return own_queries()
    return own_queries() | text_queries.queries() | {"pipeline": corpus_pipeline.run}


def own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "quantize": quantize,
        "truncate_floats": truncate_floats,
        "explode_descriptors": explode_descriptors,
        "image_hex": image_hex,
        "image_id_parse": image_id_parse,
        "rejected_names": rejected_names,
        "thumb_dims": thumb_dims,
        "l1_distance": l1_distance,
        "seeds_l0": seeds(0),
        "seeds_l1": seeds(1),
        "seeds_l2_shuffled": seeds_l2_shuffled,
        "assign_l0": assign(0),
        "assign_l1": assign(1),
        "kmeans_l0": kmeans(0),
        "kmeans_l1": kmeans(1),
        "kmeans_l1_shuffled": kmeans_l1_shuffled,
        "tree_centers": tree_centers,
        "tree_from_text": tree_from_text,
        "tree_stats": tree_stats,
        "center_shift": center_shifts,
        "index_build": index_build,
        "cell_sizes": cell_sizes,
        "index_partition_sizes": index_partition_sizes,
        "leaf_prune": leaf_prune,
        "route": routed(1),
        "route_beam": routed(BEAM),
        "route_beam_shuffled": route_beam_shuffled,
        "search_candidates": nearest(1),
        "search_votes": vote_rows,
        "vote_count": vote_count,
        "search_topk": search_topk,
        "search_beam": search_beam,
        "answer_string": answer_string,
        "answer_all": answer_all,
        "search_topk_shuffled": search_topk_shuffled,
        "answer_parse": answer_parse,
        "knn_exact": knn_exact,
        "exact_visits": exact_visits,
        "search_exact": search_exact,
        "recall_at_n": recall_at_n,
        "word_count": count_words,
        "ingest_stats": ingest_stats,
        "ingest_totals": ingest_totals,
        "merged_ids": merged_ids,
        "ingest_resume": ingest_resume,
        "ingest_not_loaded": ingest_not_loaded,
        "centers_text_roundtrip": centers_text_roundtrip,
        "index_text_roundtrip": index_text_roundtrip,
        "search_from_text_index": search_from_text_index,
        "query_text_roundtrip": query_text_roundtrip,
        "descriptor_scan": descriptor_scan,
        "stream_search": stream_search,
        "stream_ingest": stream_ingest,
    }


def oracle_sql() -> dict[str, str]:
    if text_queries is None:
        return oracle.statements()
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return oracle.statements() | text_queries.oracle_sql() | pipeline
