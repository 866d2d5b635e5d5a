"""A corpus pipeline: five stages over documents, each handing a table of documents to the next."""

from __future__ import annotations

from cellvote.llm import bpe, decontamination, minhash, quality_rules, suffix_dedup
from cellvote.llm.common import read, stored
from cellvote.llm.queries import byte_bpe


def quality(spark, docs, sf_dir):
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark, docs, sf_dir):
    """The first document of every group of near-duplicates."""
    return minhash.keep_one(docs)


def repeated_passages(spark, docs, sf_dir):
    """Documents without the passages that stand in an earlier one; n_chars follows."""
    return suffix_dedup.remove_repeats(docs)


def benchmark_free(spark, docs, sf_dir):
    """Documents in which no window of a benchmark item occurs."""
    return decontamination.remove_documents(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark, docs, sf_dir):
    """Every document's ids, as their number and digest, with the digest of what they decode to."""
    return bpe.round_trip(docs, byte_bpe())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_free", benchmark_free),
    ("encoded", encoded),
]

# The last stage has no SQL form; tests hold the whole against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; what each returns is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
