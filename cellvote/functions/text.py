"""Column expressions for word lists and answer strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the token separators (space, tab, LF, FF, CR).
SEPARATORS = "[ \\t\\n\\f\\r]+"


def tokens(text: Column) -> Column:
    """ARRAY<STRING> of the tokens; the first and last may be empty."""
    return F.split(text, SEPARATORS)


def format_answer(rank: Column, image_id: Column, votes: Column) -> Column:
    """Aggregate: ranked images of one query -> 'id:votes id:votes'."""
    ranked = F.array_sort(F.collect_list(F.struct(rank.alias("r"), image_id.alias("i"), votes.alias("n"))))
    return F.array_join(F.transform(ranked, lambda x: F.concat(x["i"], F.lit(":"), x["n"].cast("string"))), " ")


def parse_answer(answer: Column) -> Column:
    """'id:votes id:votes' -> ARRAY<STRUCT<image_id, votes>>."""
    parts = F.filter(F.split(answer, " "), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.struct(
            F.split_part(x, F.lit(":"), F.lit(1)).alias("image_id"),
            F.split_part(x, F.lit(":"), F.lit(2)).cast("bigint").alias("votes"),
        ),
    )
