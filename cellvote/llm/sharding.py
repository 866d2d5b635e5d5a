"""Sharding by sampled splitters, in DataFrame functions only.

Rows are ordered by (digest of the text, doc_id), so copies of a text stand side
by side.  A sample drawn in proportion to size gives quantile boundaries that cut
this order into many ranges; a range that turns out overfull is sampled again and
subdivided, so a text that fills a third of the table is cut as well, between its
doc_ids.  Ranges are then counted exactly, and since one small row per range says
what comes before it, a window inside each range gives every row its exact place
in the whole order, in rows and in bytes.

Law `bytes`: with P the bytes of all rows before a row, of size s, and T those of
all rows, its shard is floor((P + s/2) * shards / T).  Shards are thus equal to
within the size of one row, whatever the sample was: the sample decides the
ranges the work is split into, not the result.

Defined results: a null text has size 1 and stands for the empty one; rows that
are equal in doc_id and text get different slots, in no defined order among them;
null doc_ids come first among equal texts; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellvote.llm.common import stored

SHARDS = 16
# Rows of one range, about; the ranges are the tasks of the window.
ROWS_PER_RANGE = 500_000
LEAST_RANGES = 64
# Sampled keys per splitter.
OVERSAMPLING = 32
KEY = ["digest", "doc_id", "salt"]

# The rows of `assign` as DuckDB has them; it has no crc32, which is taken byte by byte with the usual table.
ORACLE_SQL = """
WITH RECURSIVE bits(n, v, round) AS (
  SELECT n, n, 0 FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, round + 1 FROM bits WHERE round < 8),
coding AS (SELECT list(v ORDER BY n) AS codes FROM bits WHERE round = 8),
texts AS (
  SELECT doc_id, md5(coalesce(text, '')) AS digest, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
         hex(encode(coalesce(text, ''))) AS h
  FROM documents),
summed AS (
  SELECT doc_id, digest, size, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, b: xor(c >> 8, codes[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM texts, coding),
placed AS (
  SELECT *, row_number() OVER o AS place, sum(size) OVER o - size AS before, sum(size) OVER () AS total
  FROM summed WINDOW o AS (ORDER BY digest, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
dealt AS (SELECT *, (2 * before + size) * 16 // (2 * total) AS shard FROM placed)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt
"""


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, size, text_crc32 and the key of every row, without the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("digest"),
        F.monotonically_increasing_id().alias("salt"),
    )


def _key() -> Column:
    return F.struct(*(F.col(c) for c in KEY))


def _draw(rows: DataFrame, rate: Column) -> DataFrame:
    """Rows drawn with the given probability, by a hash of their key: a retried task draws the same."""
    unit = F.pmod(F.xxhash64(*(F.col(c) for c in KEY), F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
    return rows.where(unit < rate)


def _quantiles(sample: DataFrame, every: Column) -> list:
    """Each `every`-th key of each range's sample.  The sample's size is bound by its rate."""
    order = Window.partitionBy("range").orderBy(*KEY)
    return (
        sample.withColumn("rank", F.row_number().over(order))
        .where(F.pmod(F.col("rank"), every) == 0)
        .select(*KEY)
        .collect()
    )


def _splitters(rows: list) -> DataFrame | None:
    return sorted({tuple(r) for r in rows}, key=lambda k: (k[0], k[1] is not None, k[1] or 0, k[2]))


def range_of(splitters: list[tuple], key_type: str) -> Column:
    """Number of splitters that are not above the key, found by halving."""
    if not splitters:
        return F.lit(0)
    table = F.from_json(F.lit(_as_json(splitters)), f"array<{key_type}>")
    step, steps = 1, []
    while step <= len(splitters):
        steps.insert(0, step)
        step *= 2
    return F.aggregate(
        F.array(*(F.lit(s) for s in steps)),
        F.lit(0),
        lambda at, s: F.when(
            (at + s <= len(splitters)) & (F.get(table, at + s - 1) <= _key()), at + s
        ).otherwise(at),
    )


def _as_json(splitters: list[tuple]) -> str:
    import json

    return json.dumps([dict(zip(KEY, s)) for s in splitters])


def ranges(rows: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """rows with a column `range`, and one row per range with its rows and bytes (`n`, `bytes`).

    A row weighs its size plus the mean size, so ranges are bound in bytes and in rows.
    """
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).head()
    mean = total["bytes"] / max(1, total["n"])
    weight = F.col("size") + F.lit(mean)
    kind = rows.select(_key().alias("k")).schema["k"].dataType.simpleString()
    per_range = max(1.0, 2.0 * total["bytes"] / count)
    drawn = _draw(rows, weight * F.lit(OVERSAMPLING / per_range)).withColumn("range", F.lit(0))
    found = _quantiles(drawn, F.lit(OVERSAMPLING))
    for _ in range(4):
        splitters = _splitters(found)
        placed = rows.withColumn("range", range_of(splitters, kind))
        sums = placed.groupBy("range").agg(
            F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum(weight).alias("weight")
        )
        sums = stored(sums, "ranges")
        over = sums.where((F.col("weight") > 2.5 * per_range) & (F.col("n") > 1)).select("range", "weight")
        if over.isEmpty():
            break
        inside = placed.join(F.broadcast(over), "range")
        drawn = _draw(inside, weight * F.lit(4 * OVERSAMPLING / per_range))
        more = _quantiles(drawn, F.lit(OVERSAMPLING))
        if not {tuple(r) for r in more} - set(splitters):
            break
        found = found + more
    return placed, sums


def assign(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    rows = stored(keyed(docs, id_col, text_col), "shard-keys")
    count = max(LEAST_RANGES, -(-rows.count() // rows_per_range))
    placed, sums = ranges(rows, count)
    # one row per range: what the ranges before it hold
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(
        "range",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_n"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base_bytes"),
    )
    total = sums.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).head()["b"]
    inside = Window.partitionBy("range").orderBy(F.col("digest"), F.col("doc_id").asc_nulls_first(), F.col("salt"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the join comes first: its side has a row per range, and the window needs its rows by range anyway
    joined = placed.join(F.broadcast(base), "range")
    at = joined.select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("base_n") + F.row_number().over(inside) - 1).alias("at"),
        (F.col("base_bytes") + F.sum("size").over(upto) - F.col("size")).alias("before"),
    )
    shard = F.call_function("div", (F.col("before") * 2 + F.col("size")) * shards, F.lit(2 * max(1, total)))
    at = stored(at.withColumn("shard", shard.cast("int")), "shard-places")
    first = at.groupBy("shard").agg(F.min("at").alias("first"))
    return at.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("at") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files_per_shard: int = 8, text_col: str = "text") -> None:
    """Writes every row of docs once below path in folders shard=N, each by several tasks.

    Rows are told apart by a number stored with them, so ids may be null or repeated;
    of equal texts the rows stand in the order of that number.  A column `shard` of
    docs is written as `shard_in`.
    """
    rows = docs.withColumnRenamed("shard", "shard_in") if "shard" in docs.columns else docs
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "numbered-rows")
    places = assign(rows, shards, "__row", text_col)
    places = places.select(F.col("doc_id").alias("__row"), "shard", F.col("slot").alias("__slot"))
    joined = rows.join(places, "__row").drop("__row")
    spread = F.pmod(F.col("__slot"), F.lit(files_per_shard))
    dealt = joined.repartition(shards * files_per_shard, "shard", spread).drop("__slot")
    dealt.write.partitionBy("shard").parquet(path)
