"""Word count over text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellvote.functions.text import tokens


def word_count(lines: DataFrame, text: str = "text") -> DataFrame:
    """word, count.  Counted per task before the shuffle, so common words stay cheap."""
    words = lines.select(F.explode(tokens(F.col(text))).alias("word"))
    return words.where(F.col("word") != "").groupBy("word").agg(F.count("*").alias("count"))
