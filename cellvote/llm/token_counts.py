"""Token counts through a digest cache.

The digest of a text's normalised content and the digest of the tokenizer file
name a count for good.  Texts are reduced to one row per content digest, those
whose count the cache has are taken out by a join, only the distinct misses are
encoded, and their counts are appended to the cache.  Every row then gets its
count from the cache by a join on the digest, which moves no text.

Normalised content is the text with null as the empty one.  Nothing that can
change a count may be folded here.  The join that looks up the counts is a plain
equi-join: a digest that very many rows share is split by adaptive execution,
or not moved at all while the distinct counts are small enough to broadcast.

Defined results: a null or empty text has no bytes and no tokens; repeated rows
get their rows, with equal counts; an empty table gives an empty result; an
empty cache folder, or none, is an empty cache.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellvote.llm.common import over_chunks, small
from cellvote.llm.pretokens import encode_texts, library_codec, texts_of

CACHE_SCHEMA = "tokenizer STRING, digest STRING, n_bytes BIGINT, n_tokens BIGINT"
MAX_TOKENS = 1024


def file_digest(path: str) -> str:
    """Digest of the tokenizer's file: another version is another name."""
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


@cache
def counter(path: str):
    """texts -> number of tokens of each, with the library that the file belongs to."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: np.array([len(ids) for ids in model.encode(texts, num_threads=1)], np.int64)
    codec = library_codec(path)
    if codec is not None:
        return lambda texts: encode_texts(codec, texts)[1]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: np.array([len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts], np.int64)


def content_digest(text):
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer, one row per digest even if two jobs have stored the same."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    return rows.where(F.col("tokenizer") == tokenizer).select("digest", "n_bytes", "n_tokens")


def count_misses(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """digest, n_bytes, n_tokens of (digest, text)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column("text"))
        sizes = pa.compute.binary_length(batch.column("text")).cast("int64")
        counts = pa.array(counter(tokenizer_path)(texts), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("digest"), sizes, counts], ["digest", "n_bytes", "n_tokens"])

    return texts.mapInArrow(over_chunks("text", work), "digest STRING, n_bytes BIGINT, n_tokens BIGINT")


def fill_cache(docs: DataFrame, tokenizer_path: str, cache_path: str, text_col: str = "text") -> None:
    """Appends the counts of all texts that the cache does not have."""
    spark, version = docs.sparkSession, file_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    distinct = docs.select(content_digest(text).alias("digest"), text.alias("text")).dropDuplicates(["digest"])
    known = read_cache(spark, cache_path, version).select("digest")
    misses = distinct.join(known, "digest", "left_anti")
    counted = count_misses(misses, tokenizer_path).select(F.lit(version).alias("tokenizer"), "*")
    counted.write.mode("append").parquet(cache_path)


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    max_tokens: int = MAX_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; fills the cache on the way.

    docs is scanned twice, so pass a stored table.
    """
    fill_cache(docs, tokenizer_path, cache_path, text_col)
    stored = read_cache(docs.sparkSession, cache_path, file_digest(tokenizer_path)).dropDuplicates(["digest"])
    keys = docs.select(F.col(id_col).alias("doc_id"), content_digest(F.col(text_col)).alias("digest"))
    counted = keys.join(small(stored, 80), "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))
