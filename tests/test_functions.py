import pytest
from pyspark.sql import functions as F

from cellvote.functions import text, vectors
from cellvote.operators.words import word_count


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("out")).head().out


def test_all_bytes_survive_packing(spark):
    every = spark.range(1).select(F.sequence(F.lit(0), F.lit(255)).alias("a")).select("a", vectors.pack_bytes(F.col("a")).alias("b"))
    row = every.select("b", vectors.unpack_bytes(F.col("b")).alias("u"), vectors.vector_text(F.col("b")).alias("t")).head()
    assert bytes(row.b) == bytes(range(256))
    assert row.u == list(range(256))
    assert row.t == " ".join(map(str, range(256)))


@pytest.mark.parametrize("bad", [[1, 256], [-1, 3], [1, None]])
def test_values_outside_a_byte_are_errors(spark, bad):
    frame = spark.createDataFrame([(bad,)], "a ARRAY<INT>")
    with pytest.raises(Exception, match="outside 0..255"):
        frame.select(vectors.pack_bytes(F.col("a"))).collect()


@pytest.mark.parametrize(
    "raw, shown",
    [("efcdab8967452301", "0123456789abcdef"), ("ff" * 8, "ff" * 8), ("00" * 7 + "80", "80" + "00" * 7)],
)
def test_image_id_bytes_are_little_endian(spark, raw, shown):
    frame = spark.createDataFrame([(bytearray.fromhex(raw), shown)], "raw BINARY, id STRING")
    row = frame.select(vectors.image_hex(F.col("raw")).alias("id"), vectors.image_bytes(F.col("id")).alias("raw")).head()
    assert row.id == shown and bytes(row.raw).hex() == raw


@pytest.mark.parametrize(
    "name, image_id",
    [
        ("0123456789abcdef.jpg", "0123456789abcdef"),
        ("0123456789ABCDEF0123.png", "0123456789abcdef"),
        ("short.jpg", None),
        ("0123456789abcdeg.jpg", None),
        ("", None),
    ],
)
def test_image_id_from_file_name(spark, name, image_id):
    assert one(spark, vectors.image_id_parse(F.col("name")), name=name) == image_id


@pytest.mark.parametrize("size, expected", [((150, 100), (75, 50)), ((100, 150), (50, 75)), ((100, 100), (75, 75)), ((3, 1000), (1, 75))])
def test_thumb_dims(spark, size, expected):
    out = one(spark, vectors.thumb_dims(F.col("h"), F.col("w")), h=size[0], w=size[1])
    assert (out.h, out.w) == expected


def test_l1_distance_does_not_wrap(spark):
    frame = spark.createDataFrame([([255, 0], [0, 255])], "a ARRAY<INT>, b ARRAY<INT>")
    assert frame.select(vectors.l1_distance(F.col("a"), F.col("b")).alias("d")).head().d == 510


def test_truncation_and_ancestors(spark):
    frame = spark.createDataFrame([([1.9, 254.99], 13)], "a ARRAY<FLOAT>, c INT")
    row = frame.select(
        vectors.truncate_values(F.col("a")).alias("a"),
        vectors.ancestor(F.col("c"), 3).alias("up1"),
        vectors.ancestor(F.col("c"), 3, 2).alias("up2"),
        vectors.ancestor(F.col("c"), 3, 0).alias("up0"),
    ).head()
    assert (row.a, row.up1, row.up2, row.up0) == ([1, 254], 4, 1, 13)


def test_vector_text_accepts_floats_and_spaces(spark):
    packed = one(spark, vectors.vector_from_text(F.col("t")), t="  1 2.0\t255 ")
    assert bytes(packed) == bytes([1, 2, 255])


def test_word_count(spark):
    lines = spark.createDataFrame([("  a\tb\fc a\n",), ("",), ("\r\n",)], "text STRING")
    assert {r.word: r["count"] for r in word_count(lines).collect()} == {"a": 2, "b": 1, "c": 1}


def test_answer_is_parsed_back(spark):
    ranked = spark.createDataFrame([(2, "b", 3), (1, "a", 5), (10, "c", 2)], "r INT, i STRING, n BIGINT")
    answer = ranked.agg(text.format_answer(F.col("r"), F.col("i"), F.col("n")).alias("s"))
    assert answer.head().s == "a:5 b:3 c:2"
    parsed = answer.select(text.parse_answer(F.col("s")).alias("p")).head().p
    assert [(p.image_id, p.votes) for p in parsed] == [("a", 5), ("b", 3), ("c", 2)]
