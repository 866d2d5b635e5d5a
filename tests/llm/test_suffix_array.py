"""The suffix array of op7 on texts where very much repeats, in blocks and groups of every size."""

import random

import pytest

from cellvote.llm import suffix_dedup
from cellvote.settings import new_table_path
from tests.llm import brute


def made(seed, alphabet):
    """Texts pieced together from shared runs of words, some of them periodic; few words, so that beginnings repeat."""
    draw = random.Random(seed)
    runs = [[f"w{draw.randrange(alphabet)}" for _ in range(draw.randint(20, 90))] for _ in range(6)]
    runs += [["a", "b"] * 45, ["a"] * 70]
    out = []
    for i in range(60):
        words = [w for _ in range(draw.randint(1, 4)) for w in draw.choice(runs)[draw.randrange(15) :]]
        if words and draw.random() < 0.5:
            words[draw.randrange(len(words))] = f"x{i}"  # breaks a run: the match ends there
        out.append((i, " ".join(words)))
    return [*out, (100, out[3][1]), (101, None), (102, "")]


@pytest.mark.parametrize("group_rows, block_rows", [(50_000, 20_000), (50_000, 3), (12, 20), (0, 20)])
def test_repeats_equal_brute_force(spark, monkeypatch, group_rows, block_rows):
    monkeypatch.setattr(suffix_dedup, "BLOCK_ROWS", block_rows)
    rows = made(3, 5) + [(200 + d, t) for d, t in made(4, 400)]
    path = new_table_path(spark, "made")
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3).write.parquet(path)
    found = {}
    for row in suffix_dedup.span_rows(suffix_dedup.passages(spark.read.parquet(path), group_rows=group_rows)).collect():
        places, later = found.setdefault(row.doc_id, (set(), []))
        places.update(range(row.begin, row.end))
        later.append(row.n_later)
    expected = brute.repeats(rows)
    assert {d: (x, sum(n)) for d, (x, n) in found.items()} == {d: (x, len(n)) for d, (x, n) in expected.items()}
