"""DuckDB statements with the expected result of every registered query.

The whole fit is unrolled into materialized CTEs from (k, depth, rounds), so the
statements follow the definition of each step and share nothing with the Spark
code.  Names: seed_L, center_L_R, cell_L (final assignment to level L).
"""

from __future__ import annotations

K, DEPTH, ROUNDS, VOTE_LIMIT, TOP, BEAM, MANY_VOTES = 4, 2, 2, 5, 10, 2, 3

POINTS = """
pts AS MATERIALIZED (
  SELECT vec_id AS id, printf('%016x', vec_id // 10) AS image_id, vec_id % 10 AS desc_no,
         vec_id // 10 AS query_id,
         list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS INTEGER)) AS v
  FROM embeddings)"""


def l1(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2]))) AS BIGINT)"


def text(v: str) -> str:
    return f"array_to_string({v}, ' ')"


def assign(name: str, points: str, centers: str) -> str:
    """points(id, parent, v) to the nearest child of parent; lowest id on ties."""
    return f"""
{name} AS MATERIALIZED (
  SELECT p.id, any_value(p.v) AS v, arg_min(c.c, {l1('p.v', 'c.v')} * 1000000 + c.c) AS parent
  FROM {points} p JOIN {centers} c ON c.c // {K} = p.parent GROUP BY p.id)"""


def means(name: str, assigned: str, old: str) -> str:
    return f"""
{name} AS MATERIALIZED (
  WITH flat AS (SELECT parent AS c, generate_subscripts(v, 1) AS j, unnest(v) AS x FROM {assigned}),
       dims AS (SELECT c, j, CAST(sum(x) // count(*) AS INTEGER) AS m, count(*) AS n FROM flat GROUP BY c, j),
       full_rows AS (SELECT c, list(m ORDER BY j) AS v, any_value(n) AS n FROM dims GROUP BY c)
  SELECT o.c, coalesce(f.v, o.v) AS v, coalesce(f.n, 0) AS n FROM {old} o LEFT JOIN full_rows f USING (c))"""


def fit(depth: int = DEPTH) -> list[str]:
    parts = [POINTS, "cell_m1 AS (SELECT id, 0 AS parent, v FROM pts)"]
    before = "cell_m1"
    for level in range(depth):
        parts.append(f"""
seed_{level} AS MATERIALIZED (
  SELECT parent * {K} + rn - 1 AS c, v, 0 AS n FROM (
    SELECT parent, v, row_number() OVER (PARTITION BY parent ORDER BY min(id)) AS rn
    FROM {before} GROUP BY parent, v) WHERE rn <= {K})""")
        old = f"seed_{level}"
        for r in range(1, ROUNDS + 1):
            parts.append(assign(f"assign_{level}_{r}", before, old))
            new = f"center_{level}_{r}"
            parts.append(means(new, f"assign_{level}_{r}", old))
            old = new
        parts.append(assign(f"cell_{level}", before, old))
        before = f"cell_{level}"
    return parts


LEAF = f"cell_{DEPTH - 1}"
FINAL = [f"center_{level}_{ROUNDS}" for level in range(DEPTH)]

POSTINGS = f"""
postings AS MATERIALIZED (
  SELECT l.parent AS leaf, p.image_id, p.desc_no, p.query_id, p.id, p.v FROM {LEAF} l JOIN pts p USING (id))"""

def beam(width: int) -> list[str]:
    """frontier_L: the `width` nearest cells per point on every level."""
    parts, before = [], "(SELECT id, v, 0 AS c FROM pts)"
    for level, centers in enumerate(FINAL):
        parts.append(f"""
frontier_{level} AS MATERIALIZED (
  SELECT id, v, c FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, c) AS rn FROM (
      SELECT f.id, f.v, n.c, {l1('f.v', 'n.v')} AS d FROM {before} f JOIN {centers} n ON n.c // {K} = f.c))
  WHERE rn <= {width})""")
        before = f"frontier_{level}"
    return parts


def candidates(name: str, routed: str, limit: int = VOTE_LIMIT) -> str:
    """routed(query_id, desc_no, v, leaf) against postings, cut with ties."""
    return f"""
{name} AS MATERIALIZED (
  SELECT query_id, desc_no, dist, image_id, count(*) AS n FROM (
    SELECT *, rank() OVER (PARTITION BY query_id, desc_no ORDER BY dist) AS rk FROM (
      SELECT q.query_id, q.desc_no, CAST({l1('q.v', 'p.v')} AS INTEGER) AS dist, p.image_id
      FROM {routed} q JOIN postings p USING (leaf)))
  WHERE rk <= greatest({limit}, 0) + 1 GROUP BY ALL)"""


ROUTED = "(SELECT query_id, desc_no, v, leaf FROM postings)"
EVERY_LEAF = f"(SELECT p.query_id, p.desc_no, p.v, g.leaf FROM pts p, (SELECT unnest(range({K**DEPTH})) AS leaf) g)"
VOTES = "votes AS MATERIALIZED (SELECT DISTINCT query_id, desc_no, image_id FROM near)"
COUNTS = "counts AS MATERIALIZED (SELECT query_id, image_id, count(*) AS votes FROM votes GROUP BY ALL)"
RANKED = f"""
ranked AS MATERIALIZED (
  SELECT query_id, CAST(rn AS INTEGER) AS rank, image_id, votes FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, image_id) AS rn
    FROM counts WHERE votes > 1) WHERE rn <= {TOP})"""


def statement(parts: list[str], select: str) -> str:
    return f"WITH {', '.join(parts)} {select}"


def centers_select(names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {level} AS level, CAST(c AS INTEGER) AS center_id, CAST(c // {K} AS INTEGER) AS parent_id,"
        f" CAST(n AS BIGINT) AS n, {text('v')} AS center FROM {name}"
        for level, name in names
    )


def statements() -> dict[str, str]:
    tree = fit()
    filed = [*tree, POSTINGS]
    near = [*filed, candidates("near", ROUTED)]
    ranked = [*near, VOTES, COUNTS, RANKED]
    all_levels = list(enumerate(FINAL))
    topk = statement(ranked, "SELECT query_id, rank, image_id, votes FROM ranked")
    point_rows = f"SELECT image_id, desc_no, {text('v')} AS v FROM pts"
    index_rows = (
        "SELECT CAST(leaf AS INTEGER) AS cell, row_number() OVER (PARTITION BY leaf ORDER BY image_id, desc_no) AS ord,"
        f" image_id, {text('v')} AS v FROM postings"
    )
    files = """
files AS (
  SELECT substr(md5(url), 1, 20) || '.jpg' AS name FROM pages
  UNION ALL SELECT url AS name FROM pages),
named AS (
  SELECT name, CASE WHEN regexp_matches(lower(substr(name, 1, 16)), '^[0-9a-f]{16}$')
                    THEN lower(substr(name, 1, 16)) END AS image_id FROM files)"""
    sql = {
        "quantize": statement([POINTS], point_rows),
        "image_hex": """
            WITH ids AS (SELECT vec_id, substr(md5(CAST(vec_id AS VARCHAR)), 1, 16) AS h FROM embeddings)
            SELECT vec_id, substr(h,15,2) || substr(h,13,2) || substr(h,11,2) || substr(h,9,2)
                || substr(h,7,2) || substr(h,5,2) || substr(h,3,2) || substr(h,1,2) AS stored_hex, h AS image_id FROM ids""",
        "image_id_parse": statement([files], "SELECT name, image_id FROM named"),
        "rejected_names": statement(
            [files], "SELECT count(*) FILTER (image_id IS NULL) AS rejected, count(image_id) AS valid FROM named"
        ),
        "thumb_dims": """
            SELECT p_partkey, CAST(CASE WHEN h > w THEN 75 ELSE ceil(h / w * 75) END AS INTEGER) AS h,
                   CAST(CASE WHEN h > w THEN ceil(w / h * 75) ELSE 75 END AS INTEGER) AS w
            FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) * 30 AS h, floor(p_retailprice) AS w FROM part)""",
        "l1_distance": statement(
            [POINTS],
            f"SELECT a.id AS vec_id, {l1('a.v', 'b.v')} AS dist FROM pts a JOIN pts b ON b.id = a.id + 1",
        ),
        "seeds_l0": statement(tree, f"SELECT CAST(c AS INTEGER) AS center_id, {text('v')} AS center FROM seed_0"),
        "seeds_l1": statement(tree, f"SELECT CAST(c AS INTEGER) AS center_id, {text('v')} AS center FROM seed_1"),
        "assign_l0": statement(
            tree, "SELECT image_id, desc_no, CAST(parent AS INTEGER) AS cell FROM cell_0 JOIN pts USING (id)"
        ),
        "assign_l1": statement(
            tree, "SELECT image_id, desc_no, CAST(parent AS INTEGER) AS cell FROM cell_1 JOIN pts USING (id)"
        ),
        "kmeans_l0": statement(tree, centers_select([(0, FINAL[0])])),
        "kmeans_l1": statement(tree, centers_select([(1, FINAL[1])])),
        "tree_centers": statement(tree, centers_select(all_levels)),
        "tree_stats": statement(
            tree,
            "SELECT level, count(*) AS centers, CAST(sum(n) AS BIGINT) AS points, count(*) FILTER (n = 0) AS empty"
            f" FROM ({centers_select(all_levels)}) GROUP BY level",
        ),
        "center_shift": statement(
            tree,
            " UNION ALL ".join(
                f"SELECT {level} AS level, {r} AS iteration, CAST(sum({l1('a.v', 'b.v')}) AS BIGINT) AS shift"
                f" FROM {'seed_%d' % level if r == 1 else 'center_%d_%d' % (level, r - 1)} a"
                f" JOIN center_{level}_{r} b USING (c)"
                for level in range(DEPTH)
                for r in range(1, ROUNDS + 1)
            ),
        ),
        "index_build": statement(filed, index_rows.replace("image_id, array", "image_id, desc_no, array")),
        "cell_sizes": statement(
            filed,
            f"SELECT 0 AS level, CAST(leaf // {K} AS INTEGER) AS cell, count(*) AS n FROM postings GROUP BY ALL"
            " UNION ALL SELECT 1 AS level, CAST(leaf AS INTEGER) AS cell, count(*) AS n FROM postings GROUP BY ALL",
        ),
        "index_partition_sizes": statement(
            filed,
            f"SELECT CAST(leaf // {K} AS INTEGER) AS cell0, count(*) AS n, count(DISTINCT leaf) AS leaves"
            " FROM postings GROUP BY ALL",
        ),
        "leaf_prune": statement(
            filed,
            "SELECT CAST(leaf AS INTEGER) AS leaf, count(*) AS n FROM postings"
            " WHERE leaf IN (SELECT leaf FROM postings WHERE (query_id * 10 + desc_no) % 100 = 0) GROUP BY ALL",
        ),
        "route": statement(filed, "SELECT query_id, desc_no, CAST(leaf AS INTEGER) AS leaf FROM postings"),
        "seeds_l2_shuffled": statement(
            tree,
            f"SELECT CAST(parent * {K} + rn - 1 AS INTEGER) AS center_id, {text('v')} AS center FROM ("
            "SELECT parent, v, row_number() OVER (PARTITION BY parent ORDER BY min(id)) AS rn"
            f" FROM cell_1 GROUP BY parent, v) WHERE rn <= {K}",
        ),
        "truncate_floats": """
            SELECT vec_id, array_to_string(list_transform(embedding,
                   lambda x: CAST(trunc(CAST(x AS DOUBLE) * 1000) AS INTEGER)), ' ') AS v FROM embeddings""",
        "explode_descriptors": statement([POINTS], f"SELECT query_id AS image, desc_no, {text('v')} AS v FROM pts"),
        "route_beam": statement(
            [*tree, *beam(BEAM)],
            f"SELECT query_id, desc_no, CAST(c AS INTEGER) AS leaf FROM frontier_{DEPTH - 1} JOIN pts USING (id)",
        ),
        "search_candidates": statement(near, "SELECT * FROM near"),
        "search_votes": statement([*near, VOTES], "SELECT * FROM votes"),
        "vote_count": statement([*near, VOTES, COUNTS], "SELECT * FROM counts"),
        "search_topk": topk,
        "search_beam": statement(
            [
                *filed,
                *beam(BEAM),
                f"routed AS (SELECT query_id, desc_no, p.v, c AS leaf FROM frontier_{DEPTH - 1} JOIN pts p USING (id))",
                candidates("near", "routed"),
                VOTES,
                COUNTS,
                RANKED,
            ],
            "SELECT query_id, rank, image_id, votes FROM ranked",
        ),
        "answer_string": statement(
            ranked,
            "SELECT query_id, string_agg(image_id || ':' || votes, ' ' ORDER BY rank) AS answer FROM ranked GROUP BY query_id",
        ),
        "answer_all": statement(
            [
                *near,
                VOTES,
                COUNTS,
                RANKED.replace("votes > 1", f"votes >= {MANY_VOTES}"),
            ],
            "SELECT q.query_id, coalesce(string_agg(image_id || ':' || votes, ' ' ORDER BY rank), '') AS answer"
            " FROM (SELECT DISTINCT query_id FROM pts) q LEFT JOIN ranked r ON r.query_id = q.query_id GROUP BY q.query_id",
        ),
        "search_topk_shuffled": topk,
        "answer_parse": topk,
        "knn_exact": statement(
            [*filed, candidates("near", EVERY_LEAF)], "SELECT query_id, desc_no, dist, image_id, n FROM near"
        ),
        "search_exact": statement(
            [*filed, candidates("near", EVERY_LEAF), VOTES, COUNTS, RANKED],
            "SELECT query_id, rank, image_id, votes FROM ranked",
        ),
        "exact_visits": statement(
            [
                *near,
                "bounds AS (SELECT query_id, desc_no, CASE WHEN sum(n) > greatest("
                f"{VOTE_LIMIT}, 0) THEN max(dist) END AS bound FROM near GROUP BY ALL)",
                *(
                    f"radius_{level} AS MATERIALIZED (SELECT c.c, any_value(c.v) AS v, max({l1('p.v', 'c.v')}) AS r"
                    f" FROM postings p JOIN {FINAL[level]} c ON c.c = p.leaf // {K ** (DEPTH - 1 - level)} GROUP BY c.c)"
                    for level in range(DEPTH)
                ),
                f"""visits AS (
                  SELECT q.id, l1.c FROM pts q JOIN bounds b USING (query_id, desc_no) JOIN radius_1 l1 ON true
                  JOIN radius_0 l0 ON l0.c = l1.c // {K}
                  WHERE b.bound IS NULL OR ({l1('q.v', 'l0.v')} - l0.r <= b.bound AND {l1('q.v', 'l1.v')} - l1.r <= b.bound))""",
            ],
            "SELECT query_id, desc_no, count(*) AS leaves FROM visits JOIN pts USING (id) GROUP BY query_id, desc_no",
        ),
        "recall_at_n": statement(
            [
                *near,
                VOTES,
                candidates("best", EVERY_LEAF),
                "exact AS (SELECT DISTINCT query_id, desc_no, image_id FROM best)",
            ],
            "SELECT e.query_id, count(*) AS exact, count(v.image_id) AS found FROM exact e"
            " LEFT JOIN votes v ON v.query_id = e.query_id AND v.desc_no = e.desc_no AND v.image_id = e.image_id"
            " GROUP BY e.query_id",
        ),
        "word_count": r"""
            SELECT word, count(*) AS count FROM (
              SELECT unnest(regexp_split_to_array(text, '[ \t\n\f\r]+')) AS word FROM documents)
            WHERE word <> '' GROUP BY word""",
        "ingest_stats": statement(
            [POINTS], "SELECT image_id, count(*) AS descriptors FROM pts GROUP BY image_id"
        ),
        "ingest_totals": statement(
            [POINTS], "SELECT count(DISTINCT image_id) AS images, count(*) AS descriptors FROM pts"
        ),
        "merged_ids": """
            WITH files AS (SELECT DISTINCT lower(substr(md5(p_type), 1, 16)) AS image_id, md5(p_type) || p_brand AS name FROM part)
            SELECT image_id, count(*) AS names FROM files GROUP BY image_id HAVING count(*) > 1""",
        "ingest_resume": statement(
            [files], "SELECT name FROM named WHERE name >= (SELECT min(name) FROM named WHERE name LIKE '8%')"
        ),
        "ingest_not_loaded": statement(
            [POINTS],
            """SELECT DISTINCT image_id, image_id || '.jpg' AS name FROM pts WHERE image_id NOT IN
               (SELECT printf('%016x', vec_id // 10) FROM embeddings WHERE label = 0)""",
        ),
        "centers_text_roundtrip": statement(tree, centers_select(all_levels)),
        "index_text_roundtrip": statement(filed, index_rows),
        "query_text_roundtrip": statement([POINTS], f"SELECT query_id, desc_no, {text('v')} AS v FROM pts"),
        "descriptor_scan": statement([POINTS], f"SELECT image_id, {text('v')} AS v FROM pts"),
        "stream_search": topk,
        "stream_ingest": statement(
            filed, "SELECT CAST(leaf AS INTEGER) AS leaf, image_id, desc_no FROM postings"
        ),
    }
    same = {
        "kmeans_l1_shuffled": "kmeans_l1",
        "route_beam_shuffled": "route_beam",
        "tree_from_text": "tree_centers",
        "search_from_text_index": "search_topk",
    }
    return sql | {key: sql[other] for key, other in same.items()}
