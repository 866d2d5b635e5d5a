"""Near-duplicates by HyperMinHash with banding and exact verification.

A document is the set of its distinct 5-word shingles, as 64-bit hashes.

* Sketch.  The top bits of a shingle's hash name one of 512 buckets.  A bucket
  keeps its least hash as a 16-bit register: the number of leading zeros (6 bits)
  and the 10 bits that follow the first one.  An empty bucket of a band borrows
  from the first full one in an order of its own, so that small sets fill all bands, and
  no band with a single shingle's registers only.
* Classes.  Documents of equal sets (a 128-bit digest) are one class with one
  representative; copies are never compared.
* Bands.  The first registers form 42 bands of 6.  Two sets of similarity 0.85 agree in
  a band with probability 0.38, and miss all bands with 2 in a thousand million; at
  0.8 it is 0.26, and 3 in a million.
* Candidates.  Inside a bucket of a band not all pairs are made.  In each round a
  bucket names a few of its classes as centres (one, then up to 64, 4096 and so on,
  by partial aggregation), which are compared with the others of the bucket
  that are not yet in the same component, in blocks of rows and centres.  A class that has been a centre is done in that bucket, and a
  bucket whose classes are all in one component is done.  So what is left out is
  implied by links already found; the rounds end when no bucket is open.
* Estimate.  A pair's equal registers give an estimate of its similarity,
  corrected for the share that agrees by chance; pairs more than six standard
  errors below the threshold are not verified.  Borrowed registers do not count, and
  the error is that of a sample without replacement, so it vanishes for small sets.
* Verification.  The full shingle sets of the remaining pairs are intersected and
  100 * both >= percent * either is decided in integers.
* Components.  Links are contracted by rounds of label minima with pointer jumps
  in tables; nothing of it is collected on the driver.

Defined results: null texts, and texts without words, have no shingles, are linked
with nothing and are their own component; with fewer than five words the whole
sequence is the one shingle; rows of equal doc_id get rows with the same
component; a null doc_id never names a component; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellvote.llm.common import chunks, discard, small, stored, text_digest
from cellvote.llm.words import gram_hashes, mix, word_hashes

SHINGLE = 5
PERCENT = 85  # of op10's contract
STAGE_PERCENT = 80  # where no contract names another
BUCKET_BITS, MANTISSA_BITS = 9, 10
BUCKETS = 1 << BUCKET_BITS
BAND_ROWS = 6
BANDS = 42  # over the first registers
BANDED = BANDS * BAND_ROWS
# Centres of a bucket in a round, as a multiple of those of the round before.
MORE_CENTRES = 64
# Rows of a bucket that are compared together, and centres they are compared with.
BLOCK = 64
# A pair is verified unless its estimate is this many standard errors below the threshold.
ERRORS = 6.0
# Chance that the registers of two unrelated, full buckets agree: about the sum over zeros of 4^-(z+1) * 2^-10.
COLLISION = 2.0**-MANTISSA_BITS / 3


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased."""
    words = word_hashes(text.lower())
    if len(words) == 0:
        return words
    return np.unique(gram_hashes(words, min(SHINGLE, len(words))))


def registers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """uint16 registers of a non-empty set of hashes, and which of them are not borrowed."""
    hashed = mix(values)
    bucket = (hashed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    rest = hashed << np.uint64(BUCKET_BITS)
    least = np.full(BUCKETS, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(least, bucket, rest)
    full = np.zeros(BUCKETS, bool)
    full[bucket] = True
    # leading zeros by halving
    zeros, x = np.zeros(BUCKETS, np.int64), least.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = x < (np.uint64(1) << np.uint64(64 - step))
        zeros[low] += step
        x[low] <<= np.uint64(step)
    mantissa = (x << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)
    register = (np.minimum(zeros, 63) << MANTISSA_BITS) | mantissa.astype(np.int64)
    # an empty bucket of a band takes the register of the first full one in its own order of the buckets
    source = np.arange(BUCKETS)
    empty = np.flatnonzero(~full[:BANDED])
    for width in (16, BUCKETS):  # few need more than the start of the order
        order = lending_order()[empty, :width]
        found = full[order]
        at = found.argmax(axis=1)
        lent = found[np.arange(len(empty)), at]
        source[empty[lent]] = order[lent, at[lent]]
        empty = empty[~lent]
    return register[source].astype(np.uint16), full


@cache
def lending_order() -> np.ndarray:
    """For every bucket all buckets in an order of its own, by hash."""
    return np.argsort(mix(np.arange(BUCKETS * BUCKETS, dtype=np.uint64)).reshape(BUCKETS, BUCKETS), axis=1)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_cols: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text_key, n_shingles, digest, registers, full (both null for an empty set) of every row.

    key_cols: BIGINT columns of docs that are passed on as they are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [F.col(id_col).cast("bigint").alias("doc_id"), text_digest(text).alias("text_key"), *key_cols]
    rows = docs.select(*own, text.alias("text"))
    names = ["doc_id", "text_key", *key_cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in chunks(batch, "text"):
                sizes, digests, sketches, masks = [], [], [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    found = shingle_set(text)
                    sizes.append(len(found))
                    if len(found):
                        values, full = registers(found)
                        digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                        sketches.append(values.astype("<u2").tobytes())
                        masks.append(np.packbits(full).tobytes())
                    else:
                        digests.append(None)
                        sketches.append(None)
                        masks.append(None)
                columns = [pa.array(sizes, pa.int64())] + [pa.array(x, pa.binary()) for x in (digests, sketches, masks)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), *columns],
                    [*names, "n_shingles", "digest", "registers", "full"],
                )

    keys = ", ".join(f"{c} {'BINARY' if c == 'text_key' else 'BIGINT'}" for c in names)
    return rows.mapInArrow(run, f"{keys}, n_shingles BIGINT, digest BINARY, registers BINARY, full BINARY")


def bands(classes: DataFrame) -> DataFrame:
    """band_key, band, node: a row per class and band; band_key is a hash of the band's number and registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column("registers").to_pylist()), "<u2").reshape(-1, BUCKETS)
            values = values[:, :BANDED].reshape(len(values), BANDS, BAND_ROWS).astype(np.uint64)
            keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(values), 1))
            for k in range(BAND_ROWS):
                keys = mix(keys * np.uint64(0x10001) + values[:, :, k])
            nodes = batch.column("node").take(pa.array(np.repeat(np.arange(len(values)), BANDS)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64), pa.int64()), pa.array(np.tile(np.arange(BANDS), len(values)), pa.int32()), nodes],
                ["band_key", "band", "node"],
            )

    return classes.select("node", "registers").mapInArrow(run, "band_key BIGINT, band INT, node BIGINT")


def blocks(rows: DataFrame, sketches: DataFrame, by: list[str], name: str) -> DataFrame:
    """`by` and a list `name` of the rows (node, comp) there, with their sketches; at most about BLOCK each."""
    told = F.struct("node", "comp", "n_shingles", "registers", "full")
    # by the block as well: the join may leave the rows where their bucket is
    spread = rows.join(sketches, "node").repartition("band_key", by[-1])
    return spread.groupBy(*by).agg(F.collect_list(told).alias(name))


def likely(state: DataFrame, centre: DataFrame, sketches: DataFrame, percent: int, once: bool) -> DataFrame:
    """a, b: pairs of a bucket's rows with one of its centres that their sketches do not rule out.

    state: band_key, band, node, comp; centre: band_key, part, node, comp.  Both go in
    blocks: a row of the join is a block of rows beside a block of centres, and the
    kernel emits only what may be similar.  once: a pair is looked at in the first band
    it agrees in, and in no other.
    """
    many = state.groupBy("band_key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    many = small(stored(many, "bucket-sizes"), 24)
    placed = state.join(many, "band_key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = blocks(placed, sketches, ["band_key", "band", "block"], "rows")
    part = F.floor(F.col("part") / BLOCK).alias("part")
    centres = blocks(centre.select("band_key", part, "node", "comp"), sketches, ["band_key", "part"], "centres")
    # a bucket's blocks of rows are dealt out, each with a copy of its centres
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")
    centres = centres.join(many, "band_key").select("band_key", "centres", copies)

    def columns(lists: pa.ListArray) -> tuple[np.ndarray, ...]:
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        node, comp, n, registers, full = lists.flatten().flatten()
        registers = np.frombuffer(b"".join(registers.to_pylist()), "<u2").reshape(-1, BUCKETS)
        full = np.unpackbits(np.frombuffer(b"".join(full.to_pylist()), np.uint8)).reshape(-1, BUCKETS).astype(bool)
        return ends, node.to_numpy(), comp.to_numpy(), n.to_numpy(), registers, full

    def near(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, band: int) -> np.ndarray:
        equal = x[4][i] == y[4][j]
        either = np.maximum((x[5][i] | y[5][j]).sum(axis=1), 1)
        agree = (equal & x[5][i] & y[5][j]).sum(axis=1)
        threshold = percent / 100
        estimate = (agree / either - COLLISION) / (1 - COLLISION)
        # the full buckets hold a sample of the union, drawn without putting back; so many are in the union at the threshold
        union = np.maximum((x[3][i] + y[3][j]) / (1 + threshold), 2)
        left = np.clip((union - either) / (union - 1), 0, 1)
        error = np.sqrt(threshold * (1 - threshold) / either * left)
        keep = estimate >= threshold - ERRORS * error - 1 / either
        if once:
            agreed = equal[:, :BANDED].reshape(-1, BANDS, BAND_ROWS).all(axis=2)
            keep &= agreed.argmax(axis=1) == band
        return keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, y = columns(batch.column("centres")), columns(batch.column("rows"))
            for row, band in enumerate(batch.column("band").to_pylist()):
                at, to = slice(*x[0][row : row + 2]), slice(*y[0][row : row + 2])
                n, m = x[3][at][:, None], y[3][to]
                # sets whose sizes alone rule it out are left
                open_pairs = (x[2][at][:, None] != y[2][to]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                i, j = np.nonzero(open_pairs)
                i, j = i + at.start, j + to.start
                found = [near(x, y, i[k : k + 4096], j[k : k + 4096], band) for k in range(0, len(i), 4096)]
                if found:
                    keep = np.concatenate(found)
                    a, b = x[1][i[keep]], y[1][j[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    joined = rows.join(centres, ["band_key", "block"]).select("band", "rows", "centres")
    return joined.mapInArrow(run, "a BIGINT, b BIGINT").distinct()


def shingle_sets(texts: DataFrame) -> DataFrame:
    """node, shingles (sorted uint64 as bytes) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = [shingle_set(t).tobytes() for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return texts.mapInArrow(run, "node BIGINT, shingles BINARY")


def verified(pairs: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs (with both shingle sets, sa and sb) that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(
                pa.array(keep, pa.bool_())
            )

    return pairs.mapInArrow(run, "a BIGINT, b BIGINT")


def components(links: DataFrame) -> DataFrame:
    """node, comp: for every node of links (a, b) the least node of its component, as a stored table.

    Every node takes the least label around until nothing changes; each round also
    lets a label follow the label of its label, so paths halve.
    """
    edges = stored(links.union(links.select("b", "a")).distinct(), "component-edges")
    least = edges.groupBy("a").agg(F.min("b").alias("b"))
    labels = stored(least.select(F.col("a").alias("node"), F.least("a", "b").alias("comp")), "labels")
    while True:
        known = small(labels, 24)
        near = edges.join(known, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "comp", F.lit(None).alias("old"))
        best = near.union(labels.select("node", "comp", F.col("comp").alias("old")))
        best = best.groupBy("node").agg(F.min("comp").alias("comp"), F.min("old").alias("old"))
        # one jump: the label's own label
        up = known.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        jumped = best.join(up, "comp", "left").select("node", F.least("comp", "above").alias("comp"), "old")
        last, labels = labels, stored(jumped, "labels")
        discard(last)
        if labels.where("comp <> old").isEmpty():
            discard(edges)
            return labels.select("node", "comp")


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """labels (node, comp; other nodes are alone) after joining the components that links (a, b) connect."""
    if labels is None:
        return None if links.isEmpty() else components(links)
    known = small(labels, 24)
    between = with_label(with_label(links, known, "a"), known, "b").where("a <> b")
    between = stored(between.distinct(), "component-links")
    if between.isEmpty():
        return labels
    found = components(between)
    above = small(found, 24).withColumnRenamed("comp", "above").withColumnRenamed("node", "comp")
    old = labels.join(above, "comp", "left").select("node", F.coalesce("above", "comp").alias("comp"))
    alone = found.join(known.select("node"), "node", "left_anti").select("node", "comp")
    whole = stored(old.union(alone), "labels")
    discard(between, found)
    return whole


def with_label(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """rows with the node in `column` replaced by its component."""
    named = labels.select(F.col("node").alias(column), F.col("comp").alias("__comp"))
    joined = rows.join(named, column, "left").withColumn(column, F.coalesce("__comp", column))
    return joined.select(*rows.columns)


def with_both(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b) with the columns of both nodes, as ca and cb for a column c given as its first letter."""
    for side in "ab":
        named = [F.col(c).alias(c[0] + side) for c in columns]
        pairs = pairs.join(table.select(F.col("node").alias(side), *named), side)
    return pairs


def class_links(sketches: DataFrame, sets: DataFrame, buckets: DataFrame, percent: int) -> DataFrame | None:
    """node, comp: components of the nodes in buckets (band_key, band, node, centre); nodes without a row are alone.

    sketches: node, n_shingles, registers, full; sets: node, shingles, of the same nodes.
    centre: the least node of the bucket.  Every bucket has several nodes.
    """
    sketches = small(sketches, 2 * BUCKETS + BUCKETS // 8 + 32)
    labels, centres, last = None, 1, buckets
    state = buckets.select("band_key", "band", "node", F.col("node").alias("comp"))
    centre = buckets.where("node = centre").select("band_key", F.lit(0).alias("part"), "node", F.col("node").alias("comp"))
    while True:
        near = stored(likely(state, centre, sketches, percent, once=centres > 1), "likely")
        links = stored(verified(with_both(small(near, 16), sets, ["shingles"]), percent), "links")
        before, labels = labels, merged(labels, links)
        discard(near, links, *([before] if before is not None and before is not labels else []))

        done = centre.select("band_key", "node")
        state = state.join(done, ["band_key", "node"], "left_anti").select("band_key", "band", "node", F.col("node").alias("comp"))
        if labels is not None:
            state = with_label(state, small(labels, 24), "comp")
        ends = state.groupBy("band_key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        state = stored(state.join(ends.where("lo < hi").select("band_key"), "band_key"), "open-buckets")
        discard(last)
        last = state
        if state.isEmpty():
            return labels
        centres *= MORE_CENTRES
        part = F.pmod(F.xxhash64("node", F.lit(centres)), F.lit(centres))
        centre = state.groupBy("band_key", part.alias("part")).agg(F.min(F.struct("node", "comp")).alias("c"))
        centre = stored(centre.select("band_key", "part", "c.node", "c.comp"), "centres")


def class_firsts(rows: DataFrame, docs: DataFrame, first: Column, text_col: str, percent: int) -> DataFrame:
    """digest, first: for every class the least `first` among the rows of its component, as a stored table.

    rows: the stored `sketch` of docs; first: of its columns.  docs is scanned once.
    """
    classes = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min(first).alias("least"),
        F.min("text_key").alias("text_key"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("registers").alias("registers"),
        F.first("full").alias("full"),
    )
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    every = stored(bands(classes), "bands")
    several = every.groupBy("band_key").agg(F.min("node").alias("centre"), F.max("node").alias("last"))
    several = several.where("centre < last").select("band_key", "centre")
    buckets = stored(every.join(several, "band_key"), "buckets")
    discard(every)
    live = buckets.select("node").distinct()
    live = stored(classes.join(live, "node").select("node", "text_key", "n_shingles", "registers", "full"), "live-classes")
    texts = docs.select(text_digest(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    chosen = texts.join(small(live.select("node", "text_key"), 48), "text_key").dropDuplicates(["node"])
    sets = stored(shingle_sets(chosen.select("node", "text")), "shingle-sets")
    labels = class_links(live.drop("text_key"), sets, buckets, percent)
    discard(sets, live)
    named = classes.select("digest", "node", "least").withColumn("comp", F.col("node"))
    if labels is not None:
        named = with_label(named, small(labels, 24), "comp")
    firsts = named.groupBy("comp").agg(F.min("least").alias("first"))
    return stored(named.join(firsts, "comp").select("digest", "first"), "class-components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.  docs is scanned twice: pass a stored table."""
    rows = stored(sketch(docs, id_col, text_col), "sketches")
    named = class_firsts(rows, docs, F.col("doc_id"), text_col, percent).withColumnRenamed("first", "component_id")
    joined = rows.select("doc_id", "n_shingles", "digest").join(small(named, 64), "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = STAGE_PERCENT) -> DataFrame:
    """One row of docs for every component, with its columns: the first by id (null last), text hash and row.

    Rows are told apart by a key that is stored with them, so rows of one id are
    judged by their own texts, of rows with equal id and text one stays, and a row
    without an id goes where its component has another.  Rows without a word all stay.
    """
    keyed = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "keyed-rows")
    rows = stored(sketch(keyed, id_col, text_col, ("__row",)), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "__row")
    firsts = class_firsts(rows, keyed, order, text_col, percent).select("digest", F.col("first.__row").alias("first_row"))
    joined = rows.select("__row", "digest").join(small(firsts, 64), "digest")
    gone = stored(joined.where(F.col("__row") != F.col("first_row")).select("__row"), "gone")
    return keyed.join(small(gone, 16), "__row", "left_anti").drop("__row")
