"""Repeated passages by a sparse suffix array over words.

A suffix is kept only where a minimiser stands: the word k-gram of least hash
among w neighbouring ones, so that content alone, not position, selects it.  With
k + w - 1 = 50 every run of 50 words holds a minimiser, and two equal runs hold
the same one at the same place; so every repeated passage of 50 words or more
shows up as two kept suffixes that begin alike.

1. The kept suffixes (about one word in twenty) are put in order of their first k
   words, by a hash of these, and compared to their neighbours.  One whose
   neighbours both begin otherwise is in no repeated passage.
2. The others are brought together by that beginning, each with as many words to the
   left and right as a passage around its minimiser can have, and sorted word by
   word.  Comparing each to its neighbour gives the number of words they share (the
   LCP array); so all suffixes that share their first r words stand in one run of
   it.  The words before them, read leftwards, are sorted and compared the same way.
   A match is extended by l words to the left and r to the right, l + r = 50,
   where two suffixes are in one run of both arrays: that window is a repeat, and
   the first of those with it, by (doc_id, text, position), is the one to keep.
3. Windows are merged into spans of words per document.

Copies of a whole text are put together before step 2 and get their spans at the
end, so they do not take part in it.  A beginning that very many suffixes share
(`GROUP_ROWS`, counted) is no group for one task: its windows of 50 words are dealt
out one by one, by their hash.  A key that very many rows share even so is found
on a sample; such rows are repeats by that alone, stay where they are, and only
their minimum is looked for, by partial aggregation.  Every row takes part.

Words are runs of characters other than ASCII white space, compared by 64-bit
hashes of each; a window is a false repeat only if unlike words at every unlike place
have equal hashes.  Windows dealt out by their hash are told apart by 64 bits.

Defined results: null texts and texts under 50 words have no passages; of the
copies of a text the one with the least doc_id comes first (null last), and rows
that are equal in text and doc_id cannot be told apart, so each of them counts as
first; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellvote.llm.common import chunks, small, stored, text_digest
from cellvote.llm.words import gram_hashes, word_hashes, word_spans

LENGTH = 50  # words of a passage
GRAM = 12  # words that kept suffixes are sorted by
# A key with more than this share of the rows is hot; there are at most 1 / share of them.
HOT_SHARE = 1 / 500
# Nor may a task be dealt many more rows of one key than this, however small their share.
KEY_ROWS = 2_000_000
SAMPLE_ROWS = 200_000
# Suffixes with one beginning that are sorted in one task, at most; each has up to 700 bytes of words.
GROUP_ROWS = 50_000
# Suffixes that are sorted at a time, or one group.
BLOCK_ROWS = 20_000
LEFT = LENGTH - GRAM  # words before a minimiser that a passage can have


def all_minimisers(grams: np.ndarray, w: int) -> np.ndarray:
    """For every window of w hashes the position of the least, the leftmost of equals; in blocks."""
    step, out = 1 << 18, [np.empty(0, np.int64)]
    for j in range(0, len(grams) - w + 1, step):
        views = np.lib.stride_tricks.sliding_window_view(grams[j : j + step + w - 1], w)
        out.append(views.argmin(axis=1) + np.arange(j, j + len(views)))
    return np.concatenate(out)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def suffixes(docs: DataFrame) -> DataFrame:
    """gram, text_key, at: the kept suffixes of (text_key, text)."""
    w = LENGTH - GRAM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                grams, places, rows = [], [], []
                for i, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                    hashes = gram_hashes(word_hashes(text), GRAM)
                    at = np.unique(all_minimisers(hashes, w))
                    grams.append(hashes[at])
                    places.append(at)
                    rows.append(np.full(len(at), i))
                if rows:
                    keys = part.column("text_key").take(pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays(
                        [_signed(np.concatenate(grams)), keys, pa.array(np.concatenate(places), pa.int32())],
                        ["gram", "text_key", "at"],
                    )

    return docs.mapInArrow(run, "gram BIGINT, text_key BINARY, at INT")


CONTEXT = "key BIGINT, doc_id BIGINT, text_key BINARY, at INT, low INT, high INT, words BINARY, copies BIGINT, n_words INT"


def contexts(texts: DataFrame) -> DataFrame:
    """The kept suffixes of each text with the words around them; CONTEXT.

    key: the hash of the beginning; at: its word; low, high: how many words a passage
        with this minimiser can have before it; words: the hashes of those from
        at - high up to at - low + LENGTH.
    For a suffix in `many` there is a row per window instead: key is the hash of the
    window, at its first word, words null.  A row with at = -1 stands for each text
    and has its copies and its number of words.
    """
    w = LENGTH - GRAM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 2 << 20):
                yield of_part(part)

    def of_part(part: pa.RecordBatch) -> pa.RecordBatch:
        keys, rows, places, low, high, around, many_keys, many_rows, many_places, sizes = ([] for _ in range(10))
        texts = part.column("text").cast(pa.binary()).to_pylist()
        for i, (text, kept, many) in enumerate(zip(texts, part.column("kept"), part.column("many"))):
            words = word_hashes(text)
            sizes.append(len(words))
            hashes = gram_hashes(words, GRAM)
            least = all_minimisers(hashes, w)  # never falls from one window to the next
            at = np.sort(np.asarray(kept.values, np.int64))
            first = np.searchsorted(least, at, "left")
            last = np.searchsorted(least, at, "right") - 1
            keys.append(hashes[at])
            rows.append(np.full(len(at), i))
            places.append(at)
            low.append(at - last)
            high.append(at - first)
            around += [words[a : b + LENGTH] for a, b in zip(first, last)]
            if len(many.values):
                at = np.flatnonzero(np.isin(least, np.asarray(many.values, np.int64)))
                many_keys.append(gram_hashes(words, LENGTH)[at])
                many_rows.append(np.full(len(at), i))
                many_places.append(at)
        n, suffixes_, windows_ = part.num_rows, sum(map(len, keys)), sum(map(len, many_keys))
        row = pa.array(np.concatenate([*rows, *many_rows, np.arange(n)]).astype(np.int64))
        ends = np.cumsum([0, *(8 * len(x) for x in around)]).astype(np.int32)
        held = np.concatenate([*around, np.empty(0, np.uint64)])
        data = [None, pa.py_buffer(ends), pa.py_buffer(held)]
        numbers = [pa.array(np.concatenate([*x, np.empty(0)]).astype(np.int32)) for x in (low, high)]
        none, alone = windows_ + n, suffixes_ + windows_
        return pa.RecordBatch.from_arrays(
            [
                _signed(np.concatenate([*keys, *many_keys, np.zeros(n, np.uint64)])),
                part.column("doc_id").take(row),
                part.column("text_key").take(row),
                pa.array(np.concatenate([*places, *many_places, np.full(n, -1)]).astype(np.int32)),
                *(pa.concat_arrays([x, pa.nulls(none, pa.int32())]) for x in numbers),
                pa.concat_arrays([pa.Array.from_buffers(pa.binary(), suffixes_, data), pa.nulls(none, pa.binary())]),
                pa.concat_arrays([pa.nulls(alone, pa.int64()), part.column("copies")]),
                pa.concat_arrays([pa.nulls(alone, pa.int32()), pa.array(sizes, pa.int32())]),
            ],
            ["key", "doc_id", "text_key", "at", "low", "high", "words", "copies", "n_words"],
        )

    return texts.mapInArrow(run, CONTEXT)


def in_runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by the columns, and how many columns each shares with the one before it in that order."""
    order = np.lexsort(columns[::-1])
    shared = np.zeros(len(order), np.int64)
    alike = np.ones(max(0, len(order) - 1), bool)
    for column in columns:
        placed = column[order]
        alike &= placed[1:] == placed[:-1]
        if not alike.any():
            break
        shared[1:] += alike
    return order, shared


def runs_sharing(order: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """For each row the number of its run of rows that share `least` columns or more."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < least)
    return out


def repeated_around(batch: pa.RecordBatch) -> pa.RecordBatch:
    """text_key, at, first: the windows of suffixes that another suffix of the batch has too.

    batch: rows of `contexts` that name a suffix; those with one key are all in it.
    """
    key = batch.column("key").to_numpy()
    at, low, high = (batch.column(c).to_numpy().astype(np.int64) for c in ("at", "low", "high"))
    held = batch.column("words")
    ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1] // 8
    words = np.frombuffer(held.buffers()[2], np.uint64, ends[-1])
    middle = ends[:-1] + high  # of the minimiser's own word

    def beside(step: int, there: np.ndarray) -> np.ndarray:
        return np.where(there, words[np.where(there, middle + step, 0)], 0)

    # a row that has no word at a place has 0 there; it is not asked about runs that long
    right = in_runs([key, *(beside(j, j < LENGTH - low) for j in range(LENGTH))])
    left = in_runs([key, *(beside(-j, j <= high) for j in range(1, LEFT + 1))])
    names = np.array(batch.column("text_key").to_pylist(), "S16")
    by_rank = np.lexsort((at, names, batch.column("doc_id").to_numpy()))
    rows, places, firsts = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
    for before in range(LEFT + 1):
        asked = by_rank[((low <= before) & (before <= high))[by_rank]]
        if len(asked) < 2:
            continue
        run = runs_sharing(*left, 1 + before) * (len(key) + 1) + runs_sharing(*right, 1 + LENGTH - before)
        asked = asked[np.argsort(run[asked], kind="stable")]
        like_before = np.append(False, run[asked][1:] == run[asked][:-1])
        found = like_before | np.append(like_before[1:], False)
        rows.append(asked[found])
        places.append(at[asked[found]] - before)
        firsts.append(~like_before[found])
    taken = pa.array(np.concatenate(rows))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("text_key").take(taken),
            pa.array(np.concatenate(places), pa.int32()),
            pa.array(np.concatenate(firsts)),
        ],
        ["text_key", "at", "first"],
    )


def suffix_array(rows: DataFrame) -> DataFrame:
    """text_key, at, first: the repeated windows around the suffixes of `contexts`, which share keys in groups of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            waiting.append(batch)
            n += batch.num_rows
            if n < BLOCK_ROWS:
                continue
            block = whole(waiting)
            key = block.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last group may go on
            if cut:
                yield repeated_around(block.slice(0, cut))
            waiting, n = [block.slice(cut)], len(key) - cut
        if n:
            yield repeated_around(whole(waiting))

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    dealt = rows.select("key", "doc_id", "text_key", "at", "low", "high", "words").repartition("key")
    return dealt.sortWithinPartitions("key").mapInArrow(run, "text_key BINARY, at INT, first BOOLEAN")


def repeated(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows whose key another row has too, with `first`: it is the least by `order` of those with its key.
    Without an order `first` means nothing.

    Sorts by key and compares neighbours.  rows must be a stored table.
    """
    total = rows.count()
    rate = min(1.0, max(SAMPLE_ROWS / max(1, total), 40 / KEY_ROWS))
    counted = rows.select(key).sample(rate, seed=11).groupBy(key).count()
    # twice the bound, and four sampled rows: surely more than one row
    bound = max(4, rate * min(2 * HOT_SHARE * total, KEY_ROWS))
    hot = [r[key] for r in counted.where(F.col("count") > bound).collect()]
    names = rows.columns
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", first BOOLEAN"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row seen, with whether it equals the one before
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held[0], batch]).combine_chunks().to_batches()[0]
            values = batch.column(names.index(key)).to_numpy(zero_copy_only=False)
            like_before = np.zeros(len(values), bool)
            like_before[1:] = values[1:] == values[:-1]
            if held is not None and len(values):
                like_before[0] = held[1]
            if len(values) == 0:
                continue
            like_after = np.append(like_before[1:], False)
            done = slice(0, len(values) - 1)
            yield marked(batch.slice(0, len(values) - 1), like_before[done], like_after[done])
            held = (batch.slice(len(values) - 1), bool(like_before[-1]))
        if held is not None:
            yield marked(held[0], np.array([held[1]]), np.array([False]))

    def marked(batch: pa.RecordBatch, before: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(~before)], [*names, "first"])
        return out.filter(pa.array(before | after))

    spread = rows.where(~F.col(key).isin(hot)) if hot else rows
    found = spread.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
    if hot:
        many = rows.where(F.col(key).isin(hot))
        if not order:
            return found.unionByName(many.withColumn("first", F.lit(False)))
        # one row per hot key, of which there is a bounded number
        named = F.concat_ws("|", *(F.hex(c) for c in (key, *order)))
        least = many.groupBy(key).agg(F.min(F.struct(*order)).alias("least")).select(key, "least.*")
        firsts = [row[0] for row in least.select(named).collect()]
        found = found.unionByName(many.withColumn("first", named.isin(firsts)))
    return found


def _spans(rows: DataFrame) -> DataFrame:
    """text_key, spans, later: merged in numpy, as a document may have very many windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            columns = []
            for name in ("places", "later_places"):
                columns.append(pa.array([union(np.sort(np.asarray(x.values))) for x in batch.column(name)], kind))
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), *columns], ["text_key", "spans", "later"])

    kind = "ARRAY<STRUCT<begin: INT, end: INT>>"
    return rows.mapInArrow(run, f"text_key BINARY, spans {kind}, later {kind}")


def union(places: np.ndarray) -> list[dict]:
    if len(places) == 0:
        return []
    cut = np.flatnonzero(places[1:] > places[:-1] + LENGTH) + 1
    begins, ends = places[np.append(0, cut)], places[np.append(cut - 1, len(places) - 1)] + LENGTH
    return [{"begin": int(b), "end": int(e)} for b, e in zip(begins, ends)]


def _key(text_col: str) -> Column:
    return text_digest(F.col(text_col))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), _key(text_col).alias("text_key"), text)


def text_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS
) -> DataFrame:
    """One row per distinct text that repeats something, or has copies: a stored table.

    text_key; first_id: the least doc_id that has the text; copies; n_words;
    spans: its repeated passages; later: the parts of them that stand somewhere before.
    docs is scanned twice, so pass a stored table.
    """
    rows = _keyed(docs, id_col, text_col)
    kept = stored(suffixes(rows.select("text_key", "text")), "suffixes")
    # copies of a text share their places, which are named once
    alike = stored(repeated(kept, "gram", []).select("gram", "text_key", "at").distinct(), "alike-suffixes")
    large = alike.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > group_rows)
    large = stored(large, "large-groups")
    alike = alike.join(small(large, 16), "gram", "left")
    by_text = alike.groupBy("text_key").agg(
        F.collect_set(F.when(F.col("n").isNull(), F.col("at"))).alias("kept"),
        F.collect_set(F.when(F.col("n").isNotNull(), F.col("at"))).alias("many"),
    )
    texts = rows.groupBy("text_key").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("text").alias("text")
    )
    near = texts.join(by_text, "text_key")
    found = stored(contexts(near.select("doc_id", "text_key", "text", "copies", "kept", "many")), "contexts")
    info = found.where(F.col("at") < 0).select("text_key", F.col("doc_id").alias("first_id"), "copies", "n_words")
    # a null doc_id sorts after the others
    ranked = found.where(F.col("at") >= 0).withColumn("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    places = suffix_array(ranked.where(F.col("words").isNotNull()))
    if not large.isEmpty():
        dealt = ranked.where(F.col("words").isNull()).select("key", "doc_id", "text_key", "at")
        dealt = repeated(dealt, "key", ["doc_id", "text_key", "at"])
        places = places.unionByName(dealt.select("text_key", "at", "first"))
    places = places.groupBy("text_key").agg(
        F.collect_list("at").alias("places"), F.collect_list(F.when(~F.col("first"), F.col("at"))).alias("later_places")
    )
    joined = info.join(_spans(places), "text_key", "left")
    return stored(joined.where(F.col("spans").isNotNull() | (F.col("copies") > 1)), "text-spans")


def passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS
) -> DataFrame:
    """One row per document with repeated passages: doc_id, text_key, n_words, spans, later.

    spans are all its passages of LENGTH words or more that stand elsewhere as
    well; later are the parts of them that stand somewhere before, which a
    deduplication takes out.  A text with copies is one passage from end to end,
    later in every document but the first.
    """
    found = text_spans(docs, id_col, text_col, group_rows)
    keys = _keyed(docs, id_col, text_col).select("doc_id", "text_key")
    joined = keys.join(small(found, 400), "text_key")
    whole = F.array(F.struct(F.lit(0).alias("begin"), F.col("n_words").alias("end")))
    first = (F.col("copies") == 1) | F.col("doc_id").eqNullSafe(F.col("first_id"))
    none = F.array().cast("array<struct<begin:int,end:int>>")
    return joined.select(
        "doc_id",
        "text_key",
        "n_words",
        F.when(F.col("copies") > 1, whole).otherwise(F.col("spans")).alias("spans"),
        F.when(first, F.coalesce("later", none)).otherwise(whole).alias("later"),
    )


def span_rows(found: DataFrame) -> DataFrame:
    """doc_id, begin, end, n_words, n_later: one row per repeated passage of `passages`."""
    each = found.select("doc_id", "later", F.explode("spans").alias("s"))
    overlap = F.aggregate(
        "later",
        F.lit(0),
        lambda total, x: total
        + F.greatest(F.least(x["end"], F.col("s.end")) - F.greatest(x["begin"], F.col("s.begin")), F.lit(0)),
    )
    return each.select(
        "doc_id",
        F.col("s.begin").cast("bigint").alias("begin"),
        F.col("s.end").cast("bigint").alias("end"),
        (F.col("s.end") - F.col("s.begin")).cast("bigint").alias("n_words"),
        overlap.cast("bigint").alias("n_later"),
    )


def without(text: bytes, later: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans, each span cut from its first word to its last."""
    begin, end = word_spans(text)
    parts, at = [], 0
    for low, high in later:
        parts.append(text[at : begin[low]])
        at = int(end[min(high, len(end)) - 1])
    return b"".join([*parts, text[at:]])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """docs with every passage but its first occurrence cut out of the text; rows left without a word go.

    Rows that have nothing to cut are passed on as they are.
    """
    found = passages(docs, id_col, text_col).where(F.size("later") > 0)
    cuts = stored(found.select("doc_id", "text_key", "later").distinct(), "cuts")
    row = F.struct(*(F.col(c) for c in docs.columns))
    rows = docs.select(row.alias("row"), F.col(id_col).cast("bigint").alias("id"), _key(text_col).alias("key"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))
    joined = rows.join(small(cuts, 200), same, "left").select("row", "later")
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    whole = joined.where(F.col("later").isNull()).select("row.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            left = [
                without(t, [(s["begin"], s["end"]) for s in later])
                for t, later in zip(texts, batch.column("later").to_pylist())
            ]
            kept = pa.array([bool(t.split()) for t in left])
            out = pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(left, pa.binary()).cast(pa.string())], ["row", "new"]
            )
            yield out.filter(kept)

    touched = joined.where(F.col("later").isNotNull())
    fields = [c for c in docs.columns if c != text_col]
    touched = touched.select(F.struct(*(F.col("row").getField(c).alias(c) for c in fields)).alias("row"), text.alias("text"), "later")
    kind = touched.schema["row"].dataType.simpleString()
    cut = touched.mapInArrow(run, f"row {kind}, new STRING")

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("new").alias(c)
        if c == n_chars_col:
            return F.length("new").cast(docs.schema[c].dataType).alias(c)
        return F.col("row").getField(c).alias(c)

    return whole.unionByName(cut.select(*(column(c) for c in docs.columns)))
