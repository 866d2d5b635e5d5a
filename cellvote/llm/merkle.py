"""Merkle manifest of a table of documents, with leaves placed by bitmap ranks.

Every row is a leaf, the digest of its fields.  The leaves of a language stand in
the order of doc_id under a subroot, and the subroots in the order of the
languages under the root.  No leaf is sorted to find its place:

* Ids of a language make a bitmap, kept as its non-zero words of 64 bits, merged
  from all tasks by a bitwise OR, with the number of rows of each word.
* A directory sums those numbers: words within runs of 4096, runs within runs of
  4096, until one run is left.  No window has more than 4096 rows.
* A leaf's place is a rank query: the directory's sum before its word, and the
  bits of the word below its own.

Places name slots: a task that has the 1024 leaves of a slot array lays each in
its slot and hashes ten levels.  Tops of arrays are the next array's leaves, so
the table shrinks 1024 times a round.  On the way down each array gets its own
siblings above it, and hands every leaf its proof.

Defined results: null ids come first, in the order of their digests, as do equal
ids; those few are placed by a second bitmap over digests.  Rows equal in every
field are one leaf with a count up to the end, where each gets its slot.  A null
language is the first one.  One row alone is its subroot, and one subroot the
root, with the digest of nothing as proof.  An empty table gives an empty
result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellvote.llm.common import small, stored

RUN_BITS = 12  # siblings of one directory window
SLOT_BITS = 10  # leaves of one slot array, and levels hashed at once
ROW_BITS = 33  # monotonically_increasing_id keeps the partition above this many row bits
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TAMPER_EVERY = 7
ARRAY_SCHEMA = (
    "tree STRING, slot_array BIGINT, total BIGINT, top BINARY, "
    "digests ARRAY<BINARY>, doc_ids ARRAY<BIGINT>, tampered ARRAY<BINARY>"
)
PATH_SCHEMA = "tree STRING, pos BIGINT, subroot STRING, path STRING"
RESULT_SCHEMA = (
    "doc_id BIGINT, leaf STRING, subroot STRING, root STRING, "
    "proof_sha256 STRING, folded_root STRING, verified BOOLEAN"
)


# --- leaves -----------------------------------------------------------------


def field(value: Column) -> Column:
    """A value with its length before it, so that no two rows of fields read alike."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def leaves_of(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf, tampered, n: one row per distinct leaf, n the rows that have it.

    tampered: the leaf with n_chars one higher, on the rows that the digest of the
        id picks; null on others.
    """
    columns = [F.col(name) for name in FIELDS]
    more = [F.col("n_chars").cast("decimal(20,0)") + 1 if name == "n_chars" else F.col(name) for name in FIELDS]
    picked = F.crc32(F.col("doc_id").cast("string")) % TAMPER_EVERY == 0
    rows = docs.select(
        # no language sorts before every language
        F.coalesce(F.concat(F.lit("l"), F.col("lang").cast("string")), F.lit("-")).alias("tree"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        digest(*columns).alias("leaf"),
        F.when(picked, digest(*more)).alias("tampered"),
    )
    return rows.groupBy("tree", "doc_id", "leaf").agg(F.first("tampered").alias("tampered"), F.count("*").alias("n"))


# --- bitmaps and ranks ------------------------------------------------------


def shifted(value: Column, by: int) -> Column:
    return F.shiftright(value, by)


def bit_of(number: Column) -> Column:
    """1 << (number mod 64)."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), number.bitwiseAND(F.lit(63)).cast("int"))


def bitmap_words(rows: DataFrame, group: list[str], number: str) -> DataFrame:
    """group, word, bits, n, more, shared: the bitmap of the numbers of each group, in words of 64 bits.

    rows: group, number, n.  n counts the rows of a word; more lists the numbers
    with more than one, shared has a bit for each that several rows of `rows` have.
    """
    single = rows.groupBy(*group, number).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    bit = F.col(number).bitwiseAND(F.lit(63)).cast("int")
    repeated = F.when(F.col("n") > 1, F.struct(bit.alias("bit"), (F.col("n") - 1).alias("extra")))
    return single.groupBy(*group, shifted(F.col(number), 6).alias("word")).agg(
        F.bit_or(bit_of(F.col(number))).alias("bits"),
        F.sum("n").alias("n"),
        F.collect_list(repeated).alias("more"),
        F.bit_or(F.when(F.col("kinds") > 1, bit_of(F.col(number))).otherwise(F.lit(0).cast("bigint"))).alias("shared"),
    )


def directory(words: DataFrame, group: list[str]) -> DataFrame:
    """words + before: the rows in the words of the group before each."""
    span = words.agg(F.min("word").alias("low"), F.max("word").alias("high")).head()
    if span.low is None:
        return words.withColumn("before", F.lit(0).cast("bigint"))
    return _sums_before(words, group, "word", span.low, span.high)


def _sums_before(rows: DataFrame, group: list[str], key: str, low: int, high: int) -> DataFrame:
    earlier = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    if high - low < 1 << RUN_BITS:
        return rows.withColumn("before", F.coalesce(F.sum("n").over(earlier.partitionBy(*group)), F.lit(0)))
    run = f"{key}_run"
    rows = rows.withColumn(run, shifted(F.col(key), RUN_BITS))
    runs = rows.groupBy(*group, run).agg(F.sum("n").alias("n"))
    above = _sums_before(runs, group, run, low >> RUN_BITS, high >> RUN_BITS)
    inside = F.coalesce(F.sum("n").over(earlier.partitionBy(*group, run)), F.lit(0))
    joined = rows.withColumn("_inside", inside).join(
        above.select(*group, run, F.col("before").alias("_above")), [*group, run]
    )
    return joined.withColumn("before", F.col("_inside") + F.col("_above")).drop("_inside", "_above", run)


def rank(number: Column) -> Column:
    """Rows before those of `number`, given the columns of its word: a popcount of the bits below."""
    bit = number.bitwiseAND(F.lit(63)).cast("int")
    below = F.shiftleft(F.call_function("shiftleft", F.col("bits"), F.lit(63) - bit), 1)
    repeats = F.filter("more", lambda x: x["bit"] < bit)
    extra = F.aggregate(repeats, F.lit(0).cast("bigint"), lambda total, x: total + x["extra"])
    return F.col("before") + F.bit_count(below).cast("bigint") + extra


def ranked(rows: DataFrame, group: list[str], number: str, name: str) -> DataFrame:
    """rows + place, shared: rank of the number within its group, and whether other rows have the same one."""
    words = stored(bitmap_words(rows.select(*group, number, "n"), group, number), name)
    listed = stored(directory(words, group).drop("n"), f"{name}-directory")
    joined = rows.withColumn("word", shifted(F.col(number), 6)).join(small(listed, 96), [*group, "word"])
    shared = F.col("shared").bitwiseAND(bit_of(F.col(number))) != 0
    return joined.withColumn("place", rank(F.col(number))).select(*rows.columns, "place", shared.alias("shared"))


def places(leaves: DataFrame, trees: DataFrame) -> DataFrame:
    """tree, total, pos, leaf, doc_id, tampered: one row per document.

    trees: tree, total, nulls.
    """
    known = ranked(leaves.where("doc_id IS NOT NULL"), ["tree"], "doc_id", "merkle-ids")
    lost = leaves.where("doc_id IS NULL")
    found = known.unionByName(lost.select("*", F.lit(0).cast("bigint").alias("place"), F.lit(True).alias("shared")))
    found = stored(found, "merkle-places")
    tied = found.where("shared")
    if not tied.isEmpty():
        # the id of a null is any number: its own group has no other
        keyed = tied.select(
            "tree",
            F.col("doc_id").isNull().alias("lost"),
            F.coalesce("doc_id", F.lit(0)).alias("id"),
            "leaf",
            "n",
            F.conv(F.substring(F.hex("leaf"), 1, 15), 16, 10).cast("bigint").alias("prefix"),
        )
        group = ["tree", "lost", "id"]
        within = ranked(keyed, group, "prefix", "merkle-ties")
        # digests that agree in 60 bits
        same = Window.partitionBy(*group, "prefix").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
        within = within.select(
            *group, "leaf", (F.col("place") + F.coalesce(F.sum("n").over(same), F.lit(0))).alias("_after")
        )
        keys = F.col("doc_id").isNull().alias("lost"), F.coalesce("doc_id", F.lit(0)).alias("id")
        moved = tied.select("*", *keys).join(within, [*group, "leaf"])
        moved = moved.withColumn("place", F.col("place") + F.col("_after")).select(*found.columns)
        found = found.where(~F.col("shared")).unionByName(moved)
    first = F.col("place") + F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("nulls"))
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))
    located = found.join(small(trees, 64), "tree").select(
        "tree", "total", "doc_id", "leaf", "tampered", first.alias("first"), copies.alias("copy")
    )
    return located.select("tree", "total", (F.col("first") + F.col("copy")).alias("pos"), "leaf", "doc_id", "tampered")


# --- slot arrays ------------------------------------------------------------


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def hashed_levels(nodes: list[str], total: int) -> list[list[str]]:
    """The levels over one slot array of a level of `total` nodes, its own first, its top last."""
    steps = min(SLOT_BITS, (total - 1).bit_length())
    levels = [nodes]
    for _ in range(steps):
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def slot_arrays(nodes: DataFrame) -> DataFrame:
    """ARRAY_SCHEMA of tree, total, pos, leaf, doc_id, tampered: leaves in their slots, and the top over them."""

    def lay(table: pa.Table) -> pa.Table:
        total, pos = table["total"][0].as_py(), table["pos"].to_pylist()
        number = pos[0] >> SLOT_BITS
        slots = {name: [None] * len(pos) for name in ("leaf", "doc_id", "tampered")}
        for name, array in slots.items():
            for at, value in zip(pos, table[name].to_pylist()):
                array[at - (number << SLOT_BITS)] = value
        top = hashed_levels([leaf.hex() for leaf in slots["leaf"]], total)[-1][0]
        return pa.table(
            {
                "tree": pa.array([table["tree"][0].as_py()], pa.string()),
                "slot_array": pa.array([number], pa.int64()),
                "total": pa.array([total], pa.int64()),
                "top": pa.array([bytes.fromhex(top)], pa.binary()),
                "digests": pa.array([slots["leaf"]], pa.list_(pa.binary())),
                "doc_ids": pa.array([slots["doc_id"]], pa.list_(pa.int64())),
                "tampered": pa.array([slots["tampered"]], pa.list_(pa.binary())),
            }
        )

    keyed = nodes.withColumn("slot_array", shifted(F.col("pos"), SLOT_BITS))
    return keyed.groupBy("tree", "slot_array").applyInArrow(lay, ARRAY_SCHEMA)


def build(nodes: DataFrame, largest: int, name: str) -> list[DataFrame]:
    """Stored slot arrays of every round, up to one array per tree.  largest: leaves of the largest tree."""
    rounds = [stored(slot_arrays(nodes), f"{name}-0")]
    while largest > 1 << SLOT_BITS:
        largest = (largest + (1 << SLOT_BITS) - 1) >> SLOT_BITS
        tops = rounds[-1].where(F.col("total") > 1 << SLOT_BITS).select(
            "tree",
            shifted(F.col("total") + ((1 << SLOT_BITS) - 1), SLOT_BITS).alias("total"),
            F.col("slot_array").alias("pos"),
            F.col("top").alias("leaf"),
            F.lit(None).cast("bigint").alias("doc_id"),
            F.lit(None).cast("binary").alias("tampered"),
        )
        rounds.append(stored(slot_arrays(tops), f"{name}-{len(rounds)}"))
    return rounds


def tops(rounds: list[DataFrame]) -> DataFrame:
    """tree, top of every tree."""
    out = None
    for arrays in rounds:
        done = arrays.where(F.col("total") <= 1 << SLOT_BITS).select("tree", F.lower(F.hex("top")).alias("top"))
        out = done if out is None else out.unionByName(done)
    return out


# --- proofs -----------------------------------------------------------------


def siblings(levels: list[list[str]], at: int) -> list[str]:
    """Steps from slot `at` up to the top: the other node with L or R for its side, or - where there is none."""
    steps = []
    for level in levels[:-1]:
        other = at ^ 1
        steps.append(("L" if at & 1 else "R") + level[other] if other < len(level) else "-")
        at >>= 1
    return steps


def folded(node: str, steps: list[str]) -> str:
    for step in steps:
        side, other = step[0], step[1:]
        node = sha(other + node if side == "L" else node + other)
    return node


def steps_of(path: str) -> list[str]:
    return path.split(" ") if path else []


def with_paths(arrays: DataFrame, above: DataFrame) -> DataFrame:
    """Slot arrays with the subroot and the path from their own top.

    above: tree, pos, subroot, path, pos being the number of the array.
    """
    named = above.withColumnRenamed("pos", "slot_array")
    return arrays.join(named, ["tree", "slot_array"])


def node_paths(arrays: DataFrame) -> DataFrame:
    """PATH_SCHEMA of every node of the arrays."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            levels = hashed_levels([d.hex() for d in row["digests"]], row["total"])
            path = steps_of(row["path"])
            first = row["slot_array"] << SLOT_BITS
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["tree"]] * len(levels[0]), pa.string()),
                    pa.array(range(first, first + len(levels[0])), pa.int64()),
                    pa.array([row["subroot"]] * len(levels[0]), pa.string()),
                    pa.array([" ".join(siblings(levels, at) + path) for at in range(len(levels[0]))], pa.string()),
                ],
                ["tree", "pos", "subroot", "path"],
            )

    return arrays.mapInArrow(work, PATH_SCHEMA)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, as an array row is large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def descend(rounds: list[DataFrame], crowns: DataFrame) -> DataFrame:
    """The arrays of the lowest round with their paths.

    crowns: tree, subroot, path, from a tree's top on.
    """
    own = crowns.select("tree", F.lit(0).cast("bigint").alias("pos"), "subroot", "path")
    above = None
    for arrays in rounds[::-1]:
        done = with_paths(arrays.where(F.col("total") <= 1 << SLOT_BITS), own)
        if above is not None:
            done = done.unionByName(with_paths(arrays.where(F.col("total") > 1 << SLOT_BITS), above))
        if arrays is rounds[0]:
            return done
        above = stored(node_paths(done), "merkle-paths")


def proofs(arrays: DataFrame, root: str) -> DataFrame:
    """RESULT_SCHEMA: every leaf folded up along its own siblings."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            levels = hashed_levels([d.hex() for d in row["digests"]], row["total"])
            path = steps_of(row["path"])
            proof, fold = [], []
            for at, changed in enumerate(row["tampered"]):
                steps = siblings(levels, at) + path
                proof.append(sha("".join(step[1:] for step in steps)))
                fold.append(folded(changed.hex() if changed is not None else levels[0][at], steps))
            n = len(proof)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(levels[0], pa.string()),
                    pa.array([row["subroot"]] * n, pa.string()),
                    pa.array([root] * n, pa.string()),
                    pa.array(proof, pa.string()),
                    pa.array(fold, pa.string()),
                    pa.array([f == root for f in fold], pa.bool_()),
                ],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    return arrays.mapInArrow(work, RESULT_SCHEMA)


def in_order(trees: DataFrame) -> DataFrame:
    """trees + pos, their place by name: counted by range, so that no task sees all names."""
    at = F.monotonically_increasing_id().alias("at")
    placed = stored(trees.repartitionByRange("tree").sortWithinPartitions("tree").select("*", at), "merkle-trees")
    part = shifted(F.col("at"), ROW_BITS).alias("part")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part).agg(F.min("at").alias("least"), F.count("*").alias("rows"))
    starts = starts.select("part", "least", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    joined = placed.select("*", part).join(starts, "part")
    return joined.select(*trees.columns, (F.col("before") + F.col("at") - F.col("least")).alias("pos"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    spark = docs.sparkSession
    leaves = stored(leaves_of(docs), "merkle-leaves")
    lost = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    trees = stored(leaves.groupBy("tree").agg(F.sum("n").alias("total"), lost.alias("nulls")), "merkle-sizes")
    size = trees.agg(F.max("total").alias("largest"), F.count("*").alias("trees")).head()
    if not size.trees:
        return spark.createDataFrame([], RESULT_SCHEMA)
    rounds = build(places(leaves, trees), size.largest, "merkle-arrays")
    subroots = stored(in_order(trees.select("tree")).join(tops(rounds), "tree"), "merkle-subroots")
    nodes = subroots.select(
        F.lit("").alias("tree"),
        F.lit(size.trees).cast("bigint").alias("total"),
        "pos",
        F.unhex("top").alias("leaf"),
        F.lit(None).cast("bigint").alias("doc_id"),
        F.lit(None).cast("binary").alias("tampered"),
    )
    upper = build(nodes, size.trees, "merkle-upper")
    root = tops(upper).head().top
    crown = spark.createDataFrame([("", root, "")], "tree STRING, subroot STRING, path STRING")
    above = node_paths(descend(upper, crown)).select("pos", "path")
    crowns = subroots.join(above, "pos").select("tree", F.col("top").alias("subroot"), "path")
    return proofs(descend(rounds, stored(crowns, "merkle-crowns")), root)


ORACLE_SQL = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, lang,
         CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
         || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
         || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
         CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS chars,
         CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) END AS more,
         CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(CAST(doc_id AS VARCHAR))),
           lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1)))),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
             lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS crc
  FROM documents),
hashed AS (
  SELECT doc_id, lang, sha256(head || chars || tail) AS leaf,
         CASE WHEN crc % 7 = 0 THEN sha256(head || more || tail) END AS tampered FROM rows),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n FROM hashed),
nodes AS (
  SELECT lang, 0 AS lvl, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes
  WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
subroots AS MATERIALIZED (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS lvl, pos, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM upper
  WHERE n > 1 GROUP BY lvl, pos // 2, n),
steps AS (
  SELECT l.lang, l.pos, o.lvl AS k, (l.pos >> o.lvl) & 1 AS odd, s.h AS other
  FROM leaves l JOIN nodes o ON o.lang IS NOT DISTINCT FROM l.lang AND o.pos = l.pos >> o.lvl AND o.n > 1
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.lvl = o.lvl AND s.pos = xor(o.pos, 1)
  UNION ALL
  SELECT l.lang, l.pos, 1000 + o.lvl, (r.pos >> o.lvl) & 1, s.h
  FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang
  JOIN upper o ON o.pos = r.pos >> o.lvl AND o.n > 1
  LEFT JOIN upper s ON s.lvl = o.lvl AND s.pos = xor(o.pos, 1)),
paths AS (
  SELECT lang, pos, string_agg(other, '' ORDER BY k) AS proof,
         list(CASE WHEN other IS NULL THEN '-' WHEN odd = 1 THEN 'L' || other ELSE 'R' || other END ORDER BY k) AS path
  FROM steps GROUP BY lang, pos),
folds AS (
  SELECT l.*, sha256(coalesce(p.proof, '')) AS proof_sha256,
         list_reduce(list_prepend(coalesce(l.tampered, l.leaf), coalesce(p.path, CAST([] AS VARCHAR[]))), lambda d, e:
           sha256(CASE left(e, 1) WHEN 'L' THEN substr(e, 2) || d WHEN 'R' THEN d || substr(e, 2) ELSE d END)) AS folded_root
  FROM leaves l LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos)
SELECT f.doc_id, f.leaf, r.h AS subroot, t.h AS root, f.proof_sha256, f.folded_root, f.folded_root = t.h AS verified
FROM folds f JOIN subroots r ON r.lang IS NOT DISTINCT FROM f.lang JOIN upper t ON t.n = 1
"""
