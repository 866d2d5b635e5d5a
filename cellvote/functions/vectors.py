"""Column expressions over descriptor vectors, image ids and tree cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LATIN1 = "ISO-8859-1"  # maps code points 0..255 one to one onto bytes


def _byte_value(x: Column) -> Column:
    """x as a code point, or an error: a wrong value must not be filed silently."""
    message = F.concat(F.lit("descriptor value outside 0..255: "), F.coalesce(x.cast("string"), F.lit("null")))
    return F.when(x.between(0, 255), F.chr(x)).otherwise(F.raise_error(message))


def pack_bytes(values: Column) -> Column:
    """ARRAY<INT> with values 0..255 -> BINARY, one byte per dimension."""
    return F.encode(F.array_join(F.transform(values, _byte_value), ""), LATIN1)


def unpack_bytes(v: Column) -> Column:
    """BINARY -> ARRAY<INT>, every byte read as unsigned."""
    return F.transform(F.split(F.decode(v, LATIN1), ""), F.ascii)


def vector_text(v: Column) -> Column:
    """BINARY vector as space-joined decimal numbers."""
    return F.array_join(F.transform(unpack_bytes(v), lambda x: x.cast("string")), " ")


def vector_from_text(text: Column) -> Column:
    """Whitespace-separated decimal numbers -> BINARY vector."""
    parts = F.split(F.trim(text), r"\s+")
    # A client may print whole floats ("12.0"); the fraction is cut off.
    return pack_bytes(F.transform(parts, lambda x: x.cast("double").cast("int")))


def truncate_values(values: Column) -> Column:
    """Float descriptor -> ARRAY<INT> by truncation."""
    return F.transform(values, lambda x: x.cast("int"))


def quantize_unit(values: Column) -> Column:
    """Components in [-1, 1] -> ARRAY<INT> in 0..255."""
    return F.transform(values, lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))


def l1_distance(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two integer arrays."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, x: s + x)


def _reverse_8(raw: Column) -> Column:
    return F.concat(*[F.substring(raw, i, 1) for i in range(8, 0, -1)])


def image_hex(raw: Column) -> Column:
    """8 little-endian id bytes -> 16 lowercase hex digits, top byte first."""
    return F.lower(F.hex(_reverse_8(raw)))


def image_bytes(image_id: Column) -> Column:
    """Inverse of image_hex."""
    return _reverse_8(F.unhex(image_id))


def image_id_parse(name: Column) -> Column:
    """Image id from the first 16 characters of a file name; null if not hex."""
    head = F.lower(F.substring(name, 1, 16))
    return F.when(head.rlike("^[0-9a-f]{16}$"), head)


def thumb_dims(height: Column, width: Column, side: int = 75) -> Column:
    """STRUCT<h, w> scaled so that the longer side is `side`."""
    h, w = height.cast("double"), width.cast("double")
    tall = h > w
    return F.struct(
        F.when(tall, F.lit(side)).otherwise(F.ceil(h / w * side)).cast("int").alias("h"),
        F.when(tall, F.ceil(w / h * side)).otherwise(F.lit(side)).cast("int").alias("w"),
    )


def ancestor(cell: Column, k: int, up: int = 1) -> Column:
    """The cell `up` levels above: children of p are p*k .. p*k+k-1."""
    return F.call_function("div", cell, F.lit(k**up)).cast("int")
