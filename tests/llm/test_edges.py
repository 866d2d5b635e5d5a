"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cellvote.llm import (
    bpe,
    decontamination,
    html_text,
    minhash,
    pretokens,
    quality_rules,
    sharding,
    suffix_dedup,
    token_counts,
    token_files,
    url_filter,
)
from cellvote.llm.labelled_pages import labelled_pages
from cellvote.settings import new_table_path
from tests.llm import brute

PATH = public_tokenizers.path("byte_bpe_50k.json")
PASSAGE = " ".join(f"w{i}" for i in range(60))
LONG = " ".join(f"word{i % 9973} and" for i in range(120_000))
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (None, "three four"), (5, PASSAGE),
    (6, "before it " + PASSAGE + " and after"), (7, "Before IT " + PASSAGE + " and after"), (8, LONG), (9, LONG + " end"),
    (10, "it's <|endoftext|> here\u00a0\u00e9\u4e2d  "), (11, "a a a a a a a a a a a a a a a a a a a a"), (None, None),
]
CLASHES = ["key", "doc", "w", "text_key", "node", "digest", "range", "salt", "row", "n_words", "size", "h", "at", "hit"]


@pytest.fixture(scope="module")
def docs(spark):
    path = new_table_path(spark, "edge-docs")
    frame = spark.createDataFrame(ROWS, "doc_id BIGINT, text STRING")
    frame = frame.select("*", *(F.lit(1).alias(c) for c in CLASHES), F.length("text").alias("n_chars"))
    frame.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs, spark):
    path = new_table_path(spark, "edge-none")
    docs.limit(0).write.parquet(path)
    return spark.read.schema(docs.schema).parquet(path)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def same(frame, expected):
    assert rows(frame) == sorted(expected, key=repr)


def encoded(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_token_counts(spark, docs, empty):
    cache = new_table_path(spark, "edge-cache")
    expected = [(d, len((t or "").encode()), len(encoded(t)), len(encoded(t)) > 1024) for d, t in ROWS]
    same(token_counts.token_counts(docs, PATH, cache), expected)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in ROWS})
    same(token_counts.token_counts(docs, PATH, cache), expected)
    assert spark.read.parquet(cache).count() == stored.count()
    assert rows(token_counts.token_counts(empty, PATH, cache)) == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_are_counted_whole(spark, name):
    frame = spark.createDataFrame([(1, "Some words, 12 of them"), (2, None)], "doc_id BIGINT, text STRING")
    got = rows(token_counts.token_counts(frame, public_tokenizers.path(name), new_table_path(spark, "cache")))
    assert got[0][2] > 4 and got[1][2] == 0


def test_pretokens_equal_the_library():
    letters, draw = " \n\t'sdmtlrvea1\u00b2\u00bd!?\u00e9\u65e5 \u1c89<|\u00a0\u0301", random.Random(1)
    texts = ["", "x<|endoftext|> y<|endoftext|>"]
    texts += ["".join(draw.choice(letters) for _ in range(draw.randint(1, 50))) for _ in range(3000)]
    expected = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    ids, counts = pretokens.encode_texts(pretokens.library_codec(PATH), texts)
    assert counts.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


def test_decontamination(spark, docs, empty):
    items = [(1, " ".join(f"W{i}" for i in range(3, 20))), (2, "Three, four"), (None, "one two"), (3, None), (4, "."), (3, "w1 w2")]
    items = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    plain = [tuple(r) for r in items.collect()]
    same(decontamination.contamination(docs, items), brute.decontamination(ROWS, plain))
    same(decontamination.contamination(docs, items.limit(0)), brute.decontamination(ROWS, []))
    assert rows(decontamination.contamination(empty, items)) == []
    kept = decontamination.remove_documents(docs, items)
    assert kept.columns == docs.columns
    dirty = [r for r in brute.decontamination(ROWS, plain) if r[-1]]
    assert kept.count() == len(ROWS) - len(dirty)
    cut = decontamination.remove_spans(docs.where("doc_id in (4, 6)"), items).select("doc_id", "text")
    texts = [r.text for r in cut.collect() if r.doc_id == 6]
    assert "w2 " not in texts[0] and texts[0].startswith("before it w0 ") and texts[0].endswith("and after")


def test_token_files(spark, docs, empty):
    path, none = new_table_path(spark, "edge-ids"), new_table_path(spark, "edge-no-ids")
    token_files.write_token_files(docs, PATH, path)
    files = token_files.read_token_files(spark, path)
    got = sorted(token_files.token_ids(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in ROWS), key=lambda d: (d is not None, d or 0))
    assert sorted(map(tuple, ((r.doc_id or 0, *r.ids) for r in got))) == sorted((d or 0, *encoded(t), 2) for d, t in ROWS)
    assert [r.start for r in got] == np.cumsum([0, *(len(r.ids) for r in got)])[:-1].tolist()
    token_files.write_token_files(empty, PATH, none)
    assert rows(token_files.checksums(token_files.read_token_files(spark, none))) == []


def test_simple_8b_round_trip():
    draw = np.random.default_rng(0)
    for _ in range(100):
        sizes = draw.integers(0, 3000, draw.integers(0, 6))
        wide = draw.integers(0, 2**63, sizes.sum(), dtype=np.uint64) * np.uint64(2)
        values = wide >> draw.integers(0, 64, sizes.sum()).astype(np.uint64)
        words, offsets = token_files.encode_rows(values, sizes)
        assert np.array_equal(token_files.decode_rows(words, offsets, sizes), values)


def test_html_text(spark):
    model = html_text.train(labelled_pages())
    right = total = 0
    labelled = labelled_pages()
    for i, page in enumerate(labelled):  # each page by a model that has not seen it, nor its twin of shorter texts
        half = len(labelled) // 2
        held = html_text.train([p for j, p in enumerate(labelled) if j % half != i % half])
        tree = html_text.parse(page)
        for p, text, label in zip(held.marginals(tree), tree.text, tree.label):
            right += text is not None and (p > 0.5) == bool(label)
            total += text is not None
    assert right > 0.8 * total, (right, total)
    pages = [
        (1, None, None), (2, "u", ""), (2, "u", "<p"), (3, "u", "<article><p>a &amp; b\n c<p>d < e</article>"),
        (4, "u", "<article><!-- x <p>no</p>"), (5, "u", "<nav>" + "<b>" * 3000 + "x</nav><article><p>" + "y " * 50_000),
    ]
    frame = spark.createDataFrame(pages, "page_id BIGINT, url STRING, html STRING")
    got = {(r.page_id, r.text) for r in html_text.extract(frame).collect()}
    assert got == {(1, ""), (2, ""), (3, "a & b c\n\nd < e"), (4, ""), (5, " ".join(["y"] * 50_000))}
    assert rows(html_text.extract(frame.limit(0))) == []


def test_quality_rules(docs, empty):
    got = rows(quality_rules.judge(docs))
    assert [r[:7] for r in got] == sorted(((d, *brute.base_counts(t)) for d, t in ROWS), key=repr)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [5, 6, 7]
    assert rows(quality_rules.judge(empty)) == [] and rows(quality_rules.keep_good(empty)) == []


def test_quality_rules_see_words_repeated_in_place(spark):
    draw = random.Random(4)
    words = ["".join(draw.choices("aehinorst", k=6)) for _ in range(60)]
    junk = " ".join(w for w in words for _ in range(draw.randint(2, 5)))
    had = " ".join([*words[:30], "had had that that", *words[30:]])
    rows_in = [(1, junk), (2, had), (3, " ".join(words))]
    frame = spark.createDataFrame(rows_in, "doc_id BIGINT, text STRING")
    assert [(r[0], *r[6:]) for r in rows(quality_rules.judge(frame))] == [(1, False, False), (2, False, True), (3, False, True)]
    assert sorted(r.doc_id for r in quality_rules.keep_good(frame).collect()) == [2, 3]


def test_quality_rules_keep_text_in_scripts_without_spaces(spark):
    draw, scripts = random.Random(6), {1: (0x4E00, 0x9FA5), 2: (0x3041, 0x3096), 3: (0x0E01, 0x0E2E), 4: (0x20000, 0x2A6D0)}
    rows_in = []
    for doc, (low, high) in scripts.items():
        lines = ["".join(chr(draw.randint(low, high)) for _ in range(40)) for _ in range(12)]
        lines[3] += " 50% & 60% & 70%!"
        rows_in.append((doc, "\n".join([*lines, "https://example.org/" + "a" * 40])))
    rows_in.append((5, "\n".join("".join(draw.choices("abcdefgh", k=60)) for _ in range(12)) + "\u4e2d\u6587"))
    frame = spark.createDataFrame(rows_in, "doc_id BIGINT, text STRING")
    assert [(r[0], *r[6:]) for r in rows(quality_rules.judge(frame))] == [(d, False, d < 5) for d in range(1, 6)]
    assert sorted(r.doc_id for r in quality_rules.keep_good(frame).collect()) == [1, 2, 3, 4]


def test_sharding(docs, empty):
    got = sharding.assign(docs, rows_per_range=1).collect()
    assert sorted(r.size for r in got) == sorted(len((t or "").encode()) + 1 for _, t in ROWS)
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert rows(sharding.assign(empty)) == []


def test_sharding_cuts_a_text_with_most_rows(spark):
    frame = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same").otherwise(F.md5(F.col("id").cast("string").cast("binary"))).alias("text"))
    docs = [tuple(r) for r in frame.collect()]
    got = sharding.assign(frame, rows_per_range=50).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == brute.shards(docs)


def test_url_filter(spark):
    model = url_filter.train(url_filter.labelled(spark))
    urls = [None, "", "no scheme/de/", "http://EXAMPLE.com/de/x?y", "http://a.example.net/en/", "x://net", "http://org/fr/", "http://poker-casino.test/win", "://"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id BIGINT, url STRING").withColumn("host", F.lit(1))
    got = {r.page_id: r for r in url_filter.judge(frame, model).collect()}
    for i, url in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule) == brute.rule(url)[:3]
    assert [got[i].verdict for i in (0, 1, 2, 3, 4, 6, 7)] == ["allow", "allow", "allow", "block", "allow", "allow", "block"]
    assert rows(url_filter.judge(frame.limit(0), model)) == []


def test_url_model_on_held_out_urls(spark):
    table = url_filter.labelled(spark).withColumn("part", F.pmod(F.xxhash64("url"), F.lit(4)))
    model = url_filter.train(table.where("part > 0"))
    held = table.where("part = 0")
    pages = held.select(F.monotonically_increasing_id().alias("page_id"), "url", "label")
    got = url_filter.judge(pages, model, rules=[]).join(pages, "page_id")
    right = got.where((F.col("verdict") == "block") == (F.col("label") == 1)).count()
    assert right > 0.75 * held.count()


def test_bpe(docs, empty):
    ids = bpe.encode(docs, PATH)
    assert sorted(((r.doc_id or 0, *r.ids) for r in ids.collect())) == sorted((d or 0, *encoded(t)) for d, t in ROWS)
    back = bpe.decode(ids, PATH)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((d or 0, t or "") for d, t in ROWS)
    assert rows(bpe.round_trip(empty, PATH)) == []


def test_minhash(docs, empty):
    got = minhash.near_duplicates(docs)
    ids = {d: t for d, t in ROWS if d is not None}
    expected = {r[0]: r[1:] for r in brute.near_duplicates(sorted(ids.items()))}
    for row in got.collect():
        if row.doc_id is not None:
            assert tuple(row)[1:] == expected[row.doc_id]
        else:
            assert row.component_id is None and not row.kept
    assert got.count() == len(ROWS)
    assert rows(minhash.near_duplicates(empty)) == []
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in brute.near_duplicates(sorted(ids.items()), 80) if r[3]} | {None}


def test_keep_one_judges_rows_not_ids(spark):
    base, other, third = (" ".join(f"{c}{i}" for i in range(100)) for c in "bxy")
    alone = " ".join(f"a{i}" for i in range(40))
    rows_in = [
        (3, base), (5, alone), (5, base + " tail"),  # one id, two texts
        (7, other), (7, other), (8, other.upper()), (None, other),  # a row loaded twice, copies of it
        (None, third), (None, third + " tail"), (None, third),  # no row with an id
        (9, None), (9, None), (None, ""),  # no words
    ]
    path = new_table_path(spark, "rows-not-ids")
    spark.createDataFrame(rows_in, "doc_id BIGINT, text STRING").repartition(3).write.parquet(path)
    got = [(d, t) for d, t in rows(minhash.keep_one(spark.read.parquet(path))) if (d, t) not in [(9, None), (None, "")]]
    assert len(got) == 4 and {(3, base), (5, alone), (7, other)} <= set(got)
    assert [t in (third, third + " tail") for d, t in got if d is None] == [True]
    assert minhash.keep_one(spark.read.parquet(path)).count() == 4 + 3


def test_keep_one_counts_of_edge_rows(docs):
    groups = [r for r in brute.near_duplicates(sorted({d: t for d, t in ROWS if d is not None}.items()), 80) if r[3]]
    # (None, "three four") and (None, None) are near nothing; (4, "one two") stands twice and stays once
    assert minhash.keep_one(docs).count() == len(groups) + 2


def test_minhash_finds_chains_and_large_groups(spark):
    draw, base = random.Random(3), [f"x{i}" for i in range(120)]
    rows_in = []
    for i in range(300):
        words = base[:]
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(120)] = f"y{draw.randrange(10**6)}"
        rows_in.append((i, " ".join(words)))
    chain = [f"c{i}" for i in range(200)]
    rows_in += [(1000 + i, " ".join(chain[2 * i : 2 * i + 100])) for i in range(40)]
    path = new_table_path(spark, "chains")
    spark.createDataFrame(rows_in, "doc_id BIGINT, text STRING").repartition(4).write.parquet(path)
    same(minhash.near_duplicates(spark.read.parquet(path)), brute.near_duplicates(rows_in))


def test_suffix_dedup(docs, empty, spark):
    found = {}
    for doc, begin, end, _, _ in rows(suffix_dedup.span_rows(suffix_dedup.passages(docs))):
        found.setdefault(doc, set()).update(range(begin, end))
    assert found == {d: x[0] for d, x in brute.repeats(ROWS).items()}
    assert rows(suffix_dedup.passages(empty)) == []
    left = suffix_dedup.remove_repeats(docs)
    assert left.columns == docs.columns
    texts = {r.doc_id: r.text for r in left.collect() if r.doc_id}
    assert texts[5] == PASSAGE and texts[6] == "before it  and after" and texts[1] is None
    assert texts[9].endswith("end") and len(texts[9]) < 200
    assert rows(suffix_dedup.remove_repeats(empty)) == []


def test_suffix_dedup_with_a_passage_in_most_rows(spark):
    draw = random.Random(5)
    rows_in = []
    for i in range(400):
        own = [f"u{draw.randrange(10**7)}" for _ in range(draw.randint(5, 120))]
        cut = draw.randrange(len(own))
        rows_in.append((i, " ".join(own if i % 4 == 0 else [*own[:cut], PASSAGE, *own[cut:]])))
    path = new_table_path(spark, "passages")
    spark.createDataFrame(rows_in, "doc_id BIGINT, text STRING").repartition(4).write.parquet(path)
    found = {}
    for doc, begin, end, _, later in rows(suffix_dedup.span_rows(suffix_dedup.passages(spark.read.parquet(path)))):
        places, n = found.setdefault(doc, (set(), []))
        places.update(range(begin, end))
        n.append(later)
    expected = brute.repeats(rows_in)
    assert {d: (x, sum(n)) for d, (x, n) in found.items()} == {d: (x, len(y)) for d, (x, y) in expected.items()}


def test_stages_take_edge_rows(docs, spark):
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "/root/testdata/sf0.001").count()
