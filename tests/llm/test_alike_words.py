"""Unequal words whose power sums mod 2^64 are equal whatever the base."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cellvote.llm import bpe, html_text, minhash, pretokens, suffix_dedup, token_counts, token_files, words
from cellvote.settings import new_table_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
MORSE = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
ONE, OTHER = MORSE[:1024], MORSE[1024:]
DOCS = [(1, ONE), (2, OTHER), (3, f"{ONE} {OTHER} {ONE}"), (4, f"{OTHER} {ONE} {OTHER}")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id BIGINT, text STRING").coalesce(1)


@pytest.fixture(scope="module")
def ids():
    tokenizer = Tokenizer.from_file(PATH)
    return {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in DOCS}


def test_the_words_are_the_case_looked_for():
    points = np.frombuffer((ONE + OTHER).encode(), np.uint8)
    begin, end = np.array([0, 1024]), np.array([1024, 2048])
    assert ONE != OTHER and len(set(words.span_hashes(points, begin, end).tolist())) == 1
    assert len(set(words.strong_hashes(points, begin, end).tolist())) == 2


def test_short_words_are_told_apart():
    raw = [bytes([i]) for i in range(33, 256)] + [bytes([i, j]) for i in range(33, 256) for j in range(33, 256)]
    assert len(np.unique(words.word_hashes(b" ".join(raw)))) == len(raw)


def test_documents_of_one_letter_words(spark):
    texts = ["a b c d e f g h i j", "k l m n o p q r s t", "a a a a a a a", "1 2 3", "4 5 6"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").coalesce(1)
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame).collect())
    assert found == [(0, 6, 0), (1, 6, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4)]


def test_spans_are_told_apart_by_content():
    points = np.frombuffer((ONE + OTHER + ONE).encode("utf-32-le"), "<u4")
    begin = np.array([0, 1024, 2048])
    first, where = pretokens.distinct_spans(points, begin, begin + 1024)
    assert first.tolist() == [0, 1] and where.tolist() == [0, 1, 0]


def test_ids(spark, docs, ids):
    counted = token_counts.token_counts(docs, PATH, new_table_path(spark, "cache")).collect()
    assert {r.doc_id: r.n_tokens for r in counted} == {d: len(i) for d, i in ids.items()}
    assert {r.doc_id: r.ids for r in bpe.encode(docs, PATH).collect()} == ids
    path = new_table_path(spark, "files")
    token_files.write_token_files(docs, PATH, path, 2)
    found = token_files.checksums(token_files.read_token_files(spark, path)).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {d: len(i) + 1 for d, i in ids.items()}
    for r in bpe.round_trip(docs, PATH).collect():
        raw = np.array(ids[r.doc_id], "<u4").tobytes()
        assert r.ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(dict(DOCS)[r.doc_id].encode()).hexdigest()


def test_unlike_documents_are_not_linked(docs):
    assert all(r.kept and r.component_id == r.doc_id for r in minhash.near_duplicates(docs).collect())


def test_unlike_passages_are_not_repeats(spark):
    rows = [(1, " ".join([ONE] * 60)), (2, " ".join([OTHER] * 60))]
    frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").coalesce(1)
    found = suffix_dedup.passages(frame).collect()
    assert all(s.end - s.begin <= 60 for r in found for s in r.spans)
    assert not any(r.doc_id == 2 and r.later and r.later[0].begin == 0 for r in found)


def test_labels_of_foreign_pages_are_not_read(spark):
    html = "<table><tr><td data-label='Price'>9</td><td data-label=''>x</td></tr></table><article><p>" + "Some words here. " * 30
    pages = spark.createDataFrame([(1, "http://a/", html)], "page_id BIGINT, url STRING, html STRING")
    assert "Some words" in html_text.extract(pages).head().text


def test_words_encoded_in_a_row_have_the_ids_of_each_alone(monkeypatch):
    """Distinct words went to the library one by one before, a call's overhead for each."""
    from tokenizers import Tokenizer

    from cellvote.llm import pretokens

    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyzABCßéжλ漢字가́ªⅧ٣")
    words = [" " + "".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(700)]
    pieces = list(dict.fromkeys([*words, " ", "  ", "\n", " 12", " ...", "'s", "x", " <", " ", "  ", " Ġa"]))
    plain = Tokenizer.from_file(PATH)
    expected = [np.array(plain.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in pieces]
    assert pretokens.library_codec(PATH).encode_new(pieces) == expected


def test_selectors_are_those_that_a_full_scan_of_each_finds():
    from cellvote.llm import token_files as files

    rng = np.random.default_rng(6)
    values = rng.integers(0, 1 << rng.integers(1, 17, 5000), dtype=np.uint64)
    values[1000:1400], values[2000:2500] = 1, 0
    values[[7, 4999]] = 1 << 62
    bounds = np.array([0, 0, 1, 1024, 2048, 2048, 3000, 5000])
    words, lengths = files.encode_blocks(values, bounds)
    picked = []
    for start, end in zip(bounds, bounds[1:]):
        at = start
        while at < end:
            fitting = [s for s in range(1, 15) if all(int(v) >> int(files.BITS[s]) == 0 for v in values[at : min(at + files.COUNTS[s], end)])]
            picked += [fitting[0]] if fitting else [0, 0]
            at += int(files.COUNTS[fitting[0]]) if fitting else 1
    escaped = [s == 0 for s in picked]
    assert [int(w >> np.uint64(60)) for w, e in zip(words, escaped) if not e] == [s for s in picked if s]
    assert len(words) == len(picked)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    assert (files.decode_blocks(words, ends, np.diff(bounds)) == values).all()


def fresh_codec(monkeypatch, held):
    """A codec of its own that keeps few pre-tokens, and the list of all that it encodes."""
    for name in ("KEPT", "HELD"):
        monkeypatch.setattr(pretokens, name, held, raising=False)
    codec, encoded = pretokens.library_codec.__wrapped__(PATH), []
    encode_new = codec.encode_new
    codec.encode_new = lambda pieces: encoded.extend(pieces) or encode_new(pieces)
    return codec, encoded


def test_words_of_many_chunks_outlive_a_full_table(monkeypatch):
    """The table was emptied when it was full, so frequent words were encoded over and over."""
    codec, encoded = fresh_codec(monkeypatch, 200)
    common = " ".join(f"c{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(60))
    plain = Tokenizer.from_file(PATH)
    for chunk in range(40):
        rare = " ".join(f"r{chr(97 + chunk % 26)}{chr(97 + chunk // 26)}{chr(97 + i)}" for i in range(26))
        text = f" {common} {rare}"
        ids, counts = codec.encode([text])
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]
        assert len(codec.uses) <= 200 + 86
    assert sum(piece.startswith(" c") for piece in encoded) == 60
    assert sum(piece.startswith(" r") for piece in encoded) == 40 * 26


@pytest.mark.parametrize("held", [1, 40, 100_000])
def test_words_of_earlier_chunks_are_compared(monkeypatch, held):
    """Pre-tokens of one hash in different chunks, and a table that is full time and again."""
    codec, _ = fresh_codec(monkeypatch, held)
    plain, rng = Tokenizer.from_file(PATH), np.random.default_rng(9)
    chunks = [[ONE], [OTHER], [ONE, OTHER], [f" {OTHER} {ONE}", ""], [OTHER], [ONE], [], [""], ["<|endoftext|>"]]
    letters = list("abé漢\U0001f600 '1\n")
    chunks += [["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(5)] for _ in range(60)]
    for texts in chunks:
        expected = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
        ids, counts = codec.encode(texts)
        assert counts.tolist() == [len(e) for e in expected]
        assert ids.tolist() == [i for e in expected for i in e]


def test_characters_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(pretokens, "HELD_CHARS", 5000, raising=False)
    codec, encoded = fresh_codec(monkeypatch, 1000)
    for _ in range(3):
        for letter in "abcdefgh":
            codec.encode([letter * 1000])
            assert codec.chars.end <= 6000
    assert set(encoded) == {letter * 1000 for letter in "abcdefgh"}
