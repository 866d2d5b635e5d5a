"""Benchmark decontamination with a broadcast hash table of test windows, in DataFrame functions only.

Benchmark items are cut into windows of 10 words, a shorter item into one.  The
distinct windows, their hash as key, are the build side of a hash join; every
window of a training text is hashed inside its row and probes it.  A hit is
verified word by word before it counts.  Only verified hits, and one row that
stands for each document, are grouped; they carry positions, not text.

The windows are counted before they are broadcast.  A benchmark beyond the bound
takes part in the same join shuffled; the results are the same.

Words: A-Z lower-cased, runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`.

Defined results: null texts have no words; items without words, and null items,
have no windows; rows with equal or null doc_id are told apart and each gets its
row; an item whose id is null marks words but is not listed; an empty table on
either side gives no hits.  Other columns stay out of the way under a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellvote.llm.common import BROADCAST_BYTES, lower_ascii, stored

WINDOW = 10
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# The rows of `contamination` as DuckDB has them.
ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
starts AS (
  SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS words FROM starts),
places AS (
  SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM wanted) WHERE len(w) >= n),
hits AS (
  SELECT k, i, n, item
  FROM (SELECT k, i, n, array_to_string(w[i : i + n - 1], ' ') AS words FROM places) JOIN wanted USING (n, words)),
marked AS (
  SELECT k, count(DISTINCT place) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT k, i, n FROM hits))
  GROUP BY k),
listed AS (
  SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT k, item FROM hits WHERE item IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN marked USING (k) LEFT JOIN listed USING (k)
"""


def words_of(text: Column) -> Column:
    """ARRAY<STRING> of the lower-cased words."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NO_WORD), lambda w: w != "")


def _hash(words: Column, start: Column, length: int) -> Column:
    return F.xxhash64(*(F.get(words, start + k) for k in range(length)))


def _windows(words: Column, length: int) -> Column:
    """ARRAY<STRUCT<at, len, h>> of all windows of the length."""
    starts = F.sequence(F.lit(0), F.size(words) - length)
    structs = F.transform(
        starts,
        lambda i: F.struct(i.alias("at"), F.lit(length).alias("len"), _hash(words, i, length).alias("h")),
    )
    return F.when(F.size(words) >= length, structs)


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """h, words, items: the distinct windows, with the ids (as strings) of the items they are in."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w"))
    items = items.where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    items = items.select("item", "w", length.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("i"))
    windows = items.select("item", F.slice("w", F.col("i"), F.col("n")).alias("words"))
    keyed = windows.groupBy("words").agg(F.collect_set("item").alias("items"))
    at = F.lit(0)
    chosen = F.lit(None).cast("bigint")
    for k in range(n, 0, -1):
        chosen = F.when(F.size("words") == k, _hash(F.col("words"), at, k)).otherwise(chosen)
    return keyed.select(chosen.alias("h"), "words", "items")


def hits(docs: DataFrame, windows: DataFrame, lengths: list[int], text: bool = False) -> DataFrame:
    """One row per row of docs: key, n_words, found ARRAY<STRUCT<at, len, items>>, and `doc` (its columns).

    doc has the text only if it is asked for: without, no text is shuffled.
    """
    rows = docs.withColumn("doc", F.struct(*(F.col(c) for c in docs.columns if text or c != "text")))
    rows = rows.select(
        F.monotonically_increasing_id().alias("key"), "doc", words_of(F.col("text")).alias("w")
    )  # key and windows come out of one pass, so the key need not be the same in another
    mark = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("len"), F.lit(None).cast("bigint").alias("h")))
    parts = [F.coalesce(_windows(F.col("w"), n), F.array().cast("array<struct<at:int,len:int,h:bigint>>")) for n in lengths]
    rows = rows.select("key", "doc", "w", F.concat(mark, *parts).alias("all"))
    each = rows.select("key", "doc", "w", F.explode("all").alias("x"))
    each = each.select("key", "doc", "w", F.col("x.at").alias("at"), F.col("x.len").alias("len"), F.col("x.h").alias("h"))
    found = each.join(windows, "h", "left")
    same = F.slice("w", F.col("at") + 1, F.greatest("len", F.lit(1))) == F.col("words")
    found = found.where((F.col("at") < 0) | same)
    whole = F.col("at") < 0
    found = found.select(
        "key",
        F.when(whole, F.col("doc")).alias("doc"),
        F.when(whole, F.size("w").cast("bigint")).alias("n_words"),
        F.when(~whole, F.struct("at", "len", "items")).alias("hit"),
    )
    return found.groupBy("key").agg(
        F.max("n_words").alias("n_words"),
        F.first("doc", ignorenulls=True).alias("doc"),
        F.collect_set("hit").alias("found"),
    )


def covered(found: Column) -> Column:
    """Number of words under some window of `found`."""
    ends = F.sort_array(F.transform(found, lambda x: F.struct(x["at"].alias("a"), (x["at"] + x["len"]).alias("e"))))
    total = F.aggregate(
        ends,
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda s, x: F.struct(
            F.greatest(s["upto"], x["e"]).alias("upto"),
            (s["n"] + F.greatest(x["e"] - F.greatest(s["upto"], x["a"]), F.lit(0))).alias("n"),
        ),
    )
    return total["n"].cast("bigint")


def windows_of(benchmark: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text"):
    """The windows, hinted for broadcast if their measured size allows, and their lengths (n at most)."""
    windows = stored(benchmark_windows(benchmark, n, id_col, text_col), "test-windows")
    size = F.sum(F.length(F.array_join("words", " ")) * 2 + F.size("words") * 16 + F.size("items") * 32 + 64)
    measured = windows.groupBy(F.size("words").alias("n")).agg(size.alias("bytes")).collect()
    if sum(row["bytes"] for row in measured) <= BROADCAST_BYTES:
        windows = F.broadcast(windows)
    return windows, sorted(row["n"] for row in measured)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    windows, lengths = windows_of(benchmark, n)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = hits(rows, windows, lengths)
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda x: x["items"]))))
    counted = found.select(
        F.col("doc.doc_id").alias("doc_id"), "n_words", covered(F.col("found")).alias("n_hit"), items.alias("items")
    )
    return counted.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The rows of docs (with a column `text`) that no test window occurs in, with their columns."""
    windows, lengths = windows_of(benchmark, n)
    clean = hits(docs, windows, lengths, text=True).where(F.size("found") == 0)
    return clean.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """All rows of docs, the words under test windows cut out of `text` with the gaps between them."""
    windows, lengths = windows_of(benchmark, n)
    found = hits(docs, windows, lengths, text=True)
    text = F.col("doc.text")
    pattern = NO_WORD.replace("\\x3A-\\x60", "\\x3A-\\x40\\x5B-\\x60")
    gaps, words = F.split(text, pattern.replace("[", "[^", 1)), F.split(text, pattern)
    words = F.filter(words, lambda w: w != "")
    found = found.select(
        "doc", "found", gaps.alias("gaps"), words.alias("words"),
        F.flatten(F.transform("found", lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1))).alias("cut"),
    )
    # gap i stands before word i; a cut word takes the gap after it along
    kept = F.transform(
        "words",
        lambda w, i: F.when(F.array_contains("cut", i), F.lit("")).otherwise(
            F.concat(w, F.coalesce(F.get("gaps", i + 1), F.lit("")))
        ),
    )
    cut = F.concat(F.coalesce(F.get("gaps", F.lit(0)), F.lit("")), F.array_join(kept, ""))
    new = F.when(F.size("found") > 0, cut).otherwise(text)
    return found.select(*(new.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))
