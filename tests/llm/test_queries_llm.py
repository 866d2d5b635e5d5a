"""Registered queries over a whole small folder, held against plain versions."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from cellvote.llm import queries
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def table(name, *columns):
    return [tuple(r[c] for c in columns) for r in pq.read_table(f"{SF}/{name}.parquet").to_pylist()]


@pytest.fixture(scope="module")
def docs():
    return table("documents", "doc_id", "text")


@pytest.fixture(scope="module")
def ids(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d: tokenizer.encode(t or "", add_special_tokens=False).ids for d, t in docs}


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_all_are_registered():
    names = contract.queries()
    for n in range(1, 11):
        assert any(k.startswith(f"op{n}_") for k in names)
    assert "pipeline" in names


def test_token_counts(spark, docs, ids):
    expected = sorted((d, len((t or "").encode()), len(ids[d]), len(ids[d]) > 1024) for d, t in docs)
    assert rows(queries.op1_token_counts(spark, SF)) == expected


def test_decontamination(spark, docs):
    expected = sorted(brute.decontamination(docs, table("benchmark", "item_id", "text")))
    assert rows(queries.op2_decontamination(spark, SF)) == expected
    assert any(r[-1] for r in expected)


def test_token_files(spark, docs, ids):
    start, expected = 0, []
    for d, _ in sorted(docs):
        raw = np.array([*ids[d], 2], "<u4").tobytes()
        expected.append((d, start, len(ids[d]) + 1, zlib.crc32(raw)))
        start += len(ids[d]) + 1
    assert rows(queries.op3_token_files(spark, SF)) == expected


def test_html_text(spark):
    expected = sorted((p, u, brute.article(h)) for p, u, h in table("pages", "page_id", "url", "html"))
    got = rows(queries.op4_html_text(spark, SF))
    assert [r[:3] for r in got] == expected
    assert all(r[3] == len(r[2]) for r in got)


def test_quality_rules(spark, docs):
    got = rows(queries.op5_quality_rules(spark, SF))
    assert [r[:7] for r in got] == sorted((d, *brute.base_counts(t)) for d, t in docs)
    assert not any(r[6] and r[7] for r in got)
    kept = {r[0]: r[7] for r in got}
    base = {r[0]: r[6] for r in got}
    good = [d for d, quality, _ in table("labels", "doc_id", "quality", "toxic") if quality == 1 and not base[d]]
    bad = [d for d, quality, _ in table("labels", "doc_id", "quality", "toxic") if quality == 0]
    assert all(kept[d] for d in good)
    assert sum(not kept[d] for d in bad) > 0.9 * len(bad)


def test_sharding(spark, docs):
    got = rows(queries.op6_sharding(spark, SF))
    assert sorted((r[0], r[1], r[2], r[4], r[5]) for r in got) == brute.shards(docs)
    assert {(r[3], r[6]) for r in got} == {("bytes", None)}


def test_suffix_dedup(spark, docs):
    got = {}
    for doc, begin, end, n, later in rows(queries.op7_suffix_dedup(spark, SF)):
        assert end - begin == n
        places, total = got.setdefault(doc, (set(), []))
        places.update(range(begin, end))
        total.append(later)
    expected = brute.repeats(docs)
    assert {d: x for d, (x, _) in got.items()} == {d: x for d, (x, _) in expected.items()}
    assert {d: sum(n) for d, (_, n) in got.items()} == {d: len(n) for d, (_, n) in expected.items()}


def test_url_filter(spark):
    urls = dict(table("pages", "page_id", "url"))
    spam = ("ads-track", "casino-win", "spam-farm", "adult-x", "cheap-pills", "free-bets")
    for page, host, path, rule, verdict in rows(queries.op8_url_filter(spark, SF)):
        expected = brute.rule(urls[page])
        assert (host, path, rule) == expected[:3]
        assert verdict == (expected[3] or ("block" if any(s in host for s in spam) else "allow"))


def test_bpe(spark, docs, ids):
    def digest(raw):
        return hashlib.sha256(raw).hexdigest()

    expected = [(d, len(ids[d]), digest(np.array(ids[d], "<u4").tobytes()), digest((t or "").encode())) for d, t in docs]
    assert rows(queries.op9_bpe(spark, SF)) == sorted(expected)


def test_minhash(spark, docs):
    assert rows(queries.op10_minhash(spark, SF)) == brute.near_duplicates(docs)


def test_pipeline_stages(spark, docs):
    """Each stage against a plain version on its own input."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.stored(stage(spark, frame, SF), f"test-{name}")
        seen.append(frame)
    texts = [dict((r.doc_id, r.text) for r in f.collect()) for f in seen[:4]]
    assert all(f.columns == ["doc_id", "text", "lang", "source", "n_chars"] for f in seen[:4])
    groups = brute.near_duplicates(sorted(texts[0].items()), 80)
    assert set(texts[1]) == {r[0] for r in groups if r[3]}
    later = {d: x[1] for d, x in brute.repeats(sorted(texts[1].items())).items()}
    left = {}
    for d, t in texts[1].items():
        words = [w for i, w in enumerate(brute.WORDS.findall(t)) if i not in later.get(d, ())]
        if words or d not in later:
            left[d] = words if d in later else t
    assert {d: brute.WORDS.findall(t) if d in later else t for d, t in texts[2].items()} == left
    dirty = {r[0] for r in brute.decontamination(texts[2].items(), table("benchmark", "item_id", "text")) if r[-1]}
    assert texts[3] == {d: t for d, t in texts[2].items() if d not in dirty}
    assert {r.doc_id: r.decoded_sha256 for r in seen[4].collect()} == {
        d: hashlib.sha256(t.encode()).hexdigest() for d, t in texts[3].items()
    }
