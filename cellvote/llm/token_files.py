"""Token-id files in Simple-8b word-aligned coding.

A coded text is a run of 64-bit words.  The top four bits of a word select how
many ids it holds and of how many bits (60 bits in all); small ids share a word
with many others.  Selector 0 is the escape: two such words in a row carry the
low and the high half of one value of up to 64 bits.  Ids are coded in blocks of
1,024 that begin at a word of their own; the offsets of the blocks are stored
with the words, so any block decodes alone and all blocks decode at once in
numpy: words of equal selector are unpacked together and put to the places that
the running sum of their counts gives.

A file is a Parquet file with one row per document in ascending order of
doc_id: `doc_id, part, start_in_part, n_tokens, offsets BINARY, words BINARY`.
Files are written by a range partitioning on doc_id, so file order is id order;
`start`, the number of ids before a document, is the number in the parts before
(one row per part) plus the number in the part before it.

Defined results: a null or empty text has only the end id; rows with a null
doc_id come first; rows with equal doc_id follow each other in the order of a
digest of their text, and an id that fills many rows still lies in few parts, as
that digest is part of the range key; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellvote.llm.common import chunks
from cellvote.llm.pretokens import encode_texts, library_codec, texts_of

BLOCK = 1024
# Ids per word and bits per id, by selector; 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([32, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_ORDER = range(1, 15)  # most ids first

FILE_SCHEMA = "doc_id BIGINT, part INT, start_in_part BIGINT, n_tokens BIGINT, offsets BINARY, words BINARY"


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, 1 at least."""
    if len(values) and values.max() >= 1 << 52:
        high = np.frexp((values >> np.uint64(32)).astype(np.float64))[1] + 32
        low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
        return np.where(values >> np.uint64(32) > 0, high, np.maximum(low, 1)).astype(np.int8)
    return np.maximum(np.frexp(values.astype(np.float64))[1], 1).astype(np.int8)


def encode_blocks(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks values[bounds[i]:bounds[i+1]], and the number of words of each.

    At every place the selector with most ids that fit is found at once; the
    chains of places that are used are followed in all blocks together.
    """
    n, values = len(values), values.astype(np.uint64)
    blocks = len(bounds) - 1
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(blocks, np.int64)
    need = bit_lengths(values)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    # a place that has room for a selector's ids has it for fewer ids of more bits
    fitting = np.zeros(n, np.int8)
    # the most bits that a place and those after it need, one place more at a time
    most, following = need.copy(), np.append(need, np.zeros(60, np.int8))
    # fewer ids than the word has room for may end a block
    room = np.minimum(ends - np.arange(n), 127).astype(np.int8)
    taken = 1
    for selector in reversed(_ORDER):
        for at in range(taken, int(COUNTS[selector])):
            np.maximum(most, following[at : at + n] * (room > at).view(np.int8), out=most)
        taken = int(COUNTS[selector])
        fits = most <= BITS[selector].astype(np.int8)
        if not fits.any():
            break
        fitting += fits.view(np.int8)
    choice = np.append(0, np.arange(14, 0, -1))[fitting]
    step = COUNTS[choice]
    used, live = [], np.flatnonzero(np.diff(bounds) > 0)
    at, stop = bounds[:-1][live], bounds[1:][live]
    while len(at):
        used.append(at)
        at = at + step[at]
        go = at < stop
        at, stop = at[go], stop[go]
    marked = np.zeros(n, bool)
    marked[np.concatenate(used)] = True
    used = np.flatnonzero(marked)
    owners = np.searchsorted(bounds[1:], used, side="right")
    picked = choice[used]
    width = np.where(picked == 0, 2, 1)
    slot = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    # the words' ids follow each other as the values do
    held = np.minimum(ends[used] - used, step[used])
    start = np.cumsum(held) - held
    body = values[used[0] : used[-1] + held[-1]]
    shift = (np.arange(len(body)) - np.repeat(start, held)) * np.repeat(BITS[picked], held)
    words[slot] = np.bitwise_or.reduceat(body << shift.astype(np.uint64), start) | picked.astype(np.uint64) << np.uint64(60)
    escaped = picked == 0
    words[slot[escaped]] = values[used[escaped]] & np.uint64(0xFFFFFFFF)
    words[slot[escaped] + 1] = values[used[escaped]] >> np.uint64(32)
    return words, np.bincount(owners, weights=width, minlength=blocks).astype(np.int64)


def decode_blocks(words: np.ndarray, word_bounds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ids of all blocks; block i has words[word_bounds[i]:word_bounds[i+1]] and sizes[i] ids."""
    if len(words) == 0:
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[selector]
    escaped = np.flatnonzero(selector == 0)
    count[escaped[1::2]] = 0
    # a block's last word may have room left: its count is what the block still lacks
    before = np.concatenate([[0], np.cumsum(count)])
    filled = word_bounds[1:] > word_bounds[:-1]
    last = word_bounds[1:][filled] - 1
    surplus = (before[word_bounds[1:]] - before[word_bounds[:-1]])[filled] - sizes[filled]
    count[last] -= surplus
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    low = escaped[0::2]
    out[start[low]] = words[low] | (words[escaped[1::2]] << np.uint64(32))
    for s in np.unique(selector[selector > 0]).tolist():
        chosen = np.flatnonzero(selector == s)
        bits = int(BITS[s])
        mask = np.uint64((1 << bits) - 1)
        for k in range(int(COUNTS[s])):
            some = chosen[count[chosen] > k]
            out[start[some] + k] = (words[some] >> np.uint64(k * bits)) & mask
    return out


def encode_rows(ids: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Coded words and block offsets of each row; row i has sizes[i] of the ids."""
    ends = np.cumsum(sizes)
    per_row = -(-sizes // BLOCK)
    rows = np.repeat(np.arange(len(sizes)), per_row)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    begins = (ends - sizes)[rows] + nth * BLOCK
    bounds = np.append(begins, ends[-1] if len(ends) else 0)
    words, lengths = encode_blocks(ids, bounds)
    at = np.concatenate([[0], np.cumsum(lengths)])
    block = np.concatenate([[0], np.cumsum(per_row)])
    coded, offsets = [], []
    for i in range(len(sizes)):
        low, high = block[i], block[i + 1]
        coded.append(words[at[low] : at[high]].astype("<u8").tobytes())
        offsets.append((at[low:high] - at[low]).astype("<u4").tobytes())
    return coded, offsets


def decode_rows(coded: list[bytes], offsets: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """All ids of all rows, one row after the other."""
    words = np.frombuffer(b"".join(coded), "<u8")
    base = np.cumsum([0, *(len(c) // 8 for c in coded)])
    starts = [np.frombuffer(o, "<u4").astype(np.int64) + b for o, b in zip(offsets, base)]
    bounds = np.append(np.concatenate(starts) if starts else np.empty(0, np.int64), base[-1]).astype(np.int64)
    per_row = np.array([len(s) for s in starts], np.int64)
    lengths = np.full(int(per_row.sum()), BLOCK, np.int64)
    lengths[np.cumsum(per_row)[per_row > 0] - 1] = (sizes - (per_row - 1) * BLOCK)[per_row > 0]
    return decode_blocks(words, bounds, lengths)


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    path: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    parts: int | None = None,
) -> None:
    """Encodes every text, appends end_id, and writes the files below path."""
    if library_codec(tokenizer_path) is None:
        raise ValueError("token files are written for byte-level tokenizers")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    # the number of parts is fixed here, so that it is not changed by adaptive execution
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys, "text")
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, before = library_codec(tokenizer_path), 0
        for batch in batches:
            for part in chunks(batch, "text", 2 << 20):
                ids, counts = encode_texts(codec, texts_of(part.column("text")))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                counts = counts + 1
                words, offsets = encode_rows(ids, counts)
                starts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("part"), pa.array(starts, pa.int64()),
                        pa.array(counts, pa.int64()), pa.array(offsets, pa.binary()), pa.array(words, pa.binary()),
                    ],
                    ["doc_id", "part", "start_in_part", "n_tokens", "offsets", "words"],
                )

    ordered.mapInArrow(run, FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, offsets, words of every document in the files.

    The parts' totals are one row per part; they are summed up in one small window.
    """
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    joined = rows.join(F.broadcast(base), "part")
    return joined.select(
        "doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "offsets", "words"
    )


def decoded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the rows of a batch, and the number of ids of each."""
    sizes = batch.column("n_tokens").to_numpy(zero_copy_only=False)
    ids = decode_rows(batch.column("words").to_pylist(), batch.column("offsets").to_pylist(), sizes)
    return ids, sizes


def token_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, ids ARRAY<BIGINT> of read_token_files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "words"):
                ids, sizes = decoded(part)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids.astype(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("start"), lists], ["doc_id", "start", "ids"]
                )

    return files.mapInArrow(run, "doc_id BIGINT, start BIGINT, ids ARRAY<BIGINT>")


def checksums(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of read_token_files, from the decoded ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "words"):
                ids, sizes = decoded(part)
                raw = ids.astype("<u4").tobytes()
                ends = 4 * np.cumsum(sizes)
                sums = [zlib.crc32(raw[e - 4 * n : e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("start"), part.column("n_tokens"),
                        pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.mapInArrow(run, "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT")
