"""Language identification, conversation repair and the Merkle manifest against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellvote.llm import conversations as conv
from cellvote.llm import language_id, merkle, queries
from checks.compare import database, differences

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("key", queries.oracle_sql())
def test_query_equals_its_sql(spark, key):
    assert differences(spark, database(SF), SF, queries.queries()[key], queries.oracle_sql()[key]) == ""


# --- language identification ------------------------------------------------


def test_language_id_on_held_out_rows(spark):
    found = {r.doc_id: r for r in queries.op11_language_id(spark, SF).collect()}
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()
    assert len(found) == len(docs)
    held_out = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    assert {d["doc_id"] for d in held_out} == {i for i, r in found.items() if r.held_out}
    right = [found[d["doc_id"]].lang_pred == d["lang"] for d in held_out]
    assert np.mean(right) > 0.98
    assert all(0 <= r.score <= 1 for r in found.values())


def plain_grams(text):
    words = [w for w in re.split(r"[\W\d_]+", (text or "").lower()) if w]
    whole = f" {' '.join(words)} " if words else ""
    return {whole[i : i + n] for n in (1, 2, 3) for i in range(len(whole) - n + 1)} - {" "}


@given(st.lists(st.text("abcé ñ1._", min_size=1, max_size=30).filter(lambda t: plain_grams(t)), min_size=2, max_size=6))
@settings(max_examples=40, deadline=None)
def test_kernel_values(texts):
    sets = [language_id.grams(t) for t in texts]
    plain = [plain_grams(t) for t in texts]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    kernel = language_id.Kernel.of(sets)
    expected = [[len(a & b) / (len(a) * len(b)) ** 0.5 for b in plain] for a in plain]
    assert np.allclose(kernel.values(sets), expected, atol=1e-5)
    # features of all landmarks give the kernel matrix back
    x = kernel.mapped(sets)
    assert np.allclose(x @ x.T, expected, atol=1e-2)


def test_grams_of_long_texts_are_those_of_their_blocks(monkeypatch):
    text = " ".join(random.Random(1).choices(["eins", "zwei", "dreißig", "x" * 70, "½", "Ⅷa", "7"], k=400))
    whole = set(language_id.grams(text).tolist())
    monkeypatch.setattr(language_id, "BLOCK", 200)
    assert set(language_id.grams(text).tolist()) == whole
    assert len(language_id.grams("½ Ⅷ 12 _ .")) == 0


def test_language_id_edges(spark):
    rows = [(i, f"the cat and the dog {i}", "en") for i in range(40)] + [(i, f"der hund und die katze {i}", "de") for i in range(40, 80)]
    rows += [(80, None, "en"), (81, "", None), (82, "12 .", "de"), (None, "the cat", "en"), (None, None, None), (83, "中文", "en")]
    rows += [(84, "the dog and " * 9000, None), (5, "the cat and the dog 5", "en")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING").selectExpr("*", "1 AS score", "2 AS rank", "3 AS part")
    found = language_id.identify(docs).collect()
    assert len(found) == len(rows)
    by_id = defaultdict(list)
    for r in found:
        by_id[r.doc_id].append(r)
    assert [by_id[i][0].lang_pred for i in (0, 45, 84)] == ["en", "de", "en"] and len(by_id[5]) == 2
    for i in (80, 81, 82):
        assert (by_id[i][0].lang_pred, by_id[i][0].score) == ("und", 0.0)
    assert sorted(r.lang_pred for r in by_id[None]) == ["en", "und"] and not any(r.held_out for r in by_id[None])
    assert by_id[83][0].lang_pred in ("en", "de")
    nothing = language_id.identify(docs.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).collect() == []


# --- conversation repair ----------------------------------------------------


def plain_repair(rows):
    """All edit sequences, the cheapest and first one: (cost, audit, turns).  rows: (role, text, fault)."""
    best = None
    grammar = re.compile(r"(s?(ua)+)?")

    def go(i, cost, audit, turns, put_in):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and grammar.fullmatch("".join(r[:1] for r, _ in turns)):
            best = min(best or (cost, audit, turns), (cost, audit, turns), key=lambda b: b[:2])
        if put_in < 2:
            for role in ("user", "assistant"):
                go(i, cost + 2, audit + "I", turns + [(role, "")], put_in + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 3, audit + "D", turns, 0)
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                go(i + 1, cost + cut, audit + "K", turns + [(role, text)], 0)
                for other in ("user", "assistant"):
                    go(i + 1, cost + 2 + cut, audit + "R", turns + [(other, text)], 0)

    go(0, 0, "", [], 0)
    return best


ROLES = st.sampled_from(["system", "user", "assistant", "tool", "u2", "", " "])
FAULTS = st.sampled_from([None, None, "blank", "duplicate", "truncated"])


@given(st.lists(st.tuples(ROLES, st.sampled_from(["x.", "y"]), FAULTS), max_size=5))
@settings(max_examples=150, deadline=None)
def test_repair_is_the_cheapest_and_first(rows):
    state = conv._Conversation(7)
    for turn, row in enumerate(rows):
        state.add(turn, *row)
    got = state.result()
    cost, audit, turns = plain_repair(rows)
    assert (got["cost"], got["audit"]) == (cost, audit)
    joined = "\n".join(f"{r}:{t}" for r, t in turns)
    assert got["repaired_sha256"] == hashlib.sha256(joined.encode()).hexdigest()


def suffix_repair(codes):
    """Cost and audit by one table over all rows."""
    ends = [conv.CLOSING[s] for s in range(4)]
    for code in codes[::-1].tolist():
        ends = [min((c + ends[to][0], letters + ends[to][1]) for c, letters, to in conv.STEPS[code][s]) for s in range(4)]
    return ends[0]


def test_long_conversations_split_at_many_crossings():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 256, 1000):
        codes = rng.choice(sorted(conv.STEPS), n).astype(np.uint8)
        cost, letters = conv.repair(codes)
        assert (cost, "".join(letters)) == suffix_repair(codes)
        assert len(letters) == n + 1


def plain_conversations(rows):
    """rows: (conv_id, turn, role, text) -> rows of op12 by conv_id."""
    out, by = {}, defaultdict(list)
    for conv_id, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        place = ":".join(" " if v is None else str(v) for v in (conv_id, turn))
        kind = zlib.crc32(place.encode()) % 20
        by[conv_id]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv_id] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv_id, turns in by.items():
        key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
        turns.sort(key=key)
        seen, faulty, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in turns:
            core = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((role, text))
            faulty.append((role, text, fault))
            if fault:
                counts[fault] += 1
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, repaired = plain_repair(faulty)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv_id] = (gaps, *counts.values(), illegal, cost, audit, digest)
    return out


def test_conversation_edges(spark):
    rng = random.Random(5)
    rows = [(None, None, None, None), (None, 3, "user", "a."), (-1, None, "user", "x"), (-1, None, "user", "x"), (-1, 2, "", ".")]
    for conv_id in range(150):
        for turn in range(rng.randrange(1, 5)):
            text = rng.choice([None, "", " \n", "Yes.", "no", "Why? \t", "long " * 3000 + "!", "zwei\x0b"])
            rows.append((conv_id, turn * rng.choice([1, 1, 3]), rng.choice(["user", "assistant", "system", None, "tool"]), text))
    # every row of this one is dropped
    alone = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((alone, 0, "user", "gone."))
    frame = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    frame = frame.selectExpr("*", "1 AS kind", "2 AS fault", "3 AS text_key", "'x' AS audit").repartition(5)
    result = conv.repair_conversations(conv.damage(frame))
    assert result.columns[0] == "conv_id"
    got = {r[0]: tuple(r)[1:] for r in result.collect()}
    assert got == plain_conversations(rows)
    assert got[alone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conv.repair_conversations(conv.damage(frame.limit(0))).collect() == []


def test_texts_of_a_conversation_leave_memory(spark, monkeypatch):
    monkeypatch.setattr(conv, "HELD", 100)
    state = conv._Conversation(1)
    turns = [("user" if i % 2 == 0 else "assistant", f"text {i} é.") for i in range(500)]
    for i, (role, text) in enumerate(turns):
        state.add(i, role, text, None)
    assert state.held.file._rolled
    joined = "\n".join(f"{r}:{t}" for r, t in turns)
    assert state.result()["repaired_sha256"] == hashlib.sha256(joined.encode()).hexdigest()


# --- Merkle manifest --------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def reduced(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> rows of op13."""

    def leaf(*values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = defaultdict(list)
    for row in rows:
        d, source, lang, n, text = row
        changed = d is not None and zlib.crc32(str(d).encode()) % 7 == 0
        groups[lang].append((d is not None, d or 0, leaf(*row), leaf(d, source, lang, n + 1 if n is not None else None, text) if changed else None))
    trees = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    levels = {}
    for lang in trees:
        groups[lang].sort(key=lambda r: r[:3])
        levels[lang] = reduced([r[2] for r in groups[lang]])
    upper = reduced([levels[lang][-1][0] for lang in trees])
    root, out = upper[-1][0], []
    for number, lang in enumerate(trees):
        for at, (known, d, own, changed) in enumerate(groups[lang]):
            node, others = changed or own, []
            for place, tower in ((at, levels[lang]), (number, upper)):
                for level in tower[:-1]:
                    pair = level[place & ~1 : (place & ~1) + 2]
                    if len(pair) == 2:
                        others.append(pair[1 - (place & 1)])
                        pair[place & 1] = node
                        node = sha("".join(pair))
                    else:
                        node = sha(node)
                    place >>= 1
            out.append((d if known else None, own, levels[lang][-1][0], root, sha("".join(others)), node, node == root))
    return out


FIELDS = "doc_id BIGINT, source STRING, lang STRING, n_chars BIGINT, text STRING"


@pytest.mark.parametrize("slot_bits, run_bits", [(10, 12), (2, 20)])
def test_manifest_edges(spark, monkeypatch, slot_bits, run_bits):
    monkeypatch.setattr(merkle, "SLOT_BITS", slot_bits)
    monkeypatch.setattr(merkle, "RUN_BITS", run_bits)
    rng = random.Random(7)
    rows = [(rng.choice([i, -i, i * 10**12, i % 5]), rng.choice(["a", None]), rng.choice(["en", "de", "é", None, "~"]), rng.choice([None, i]), f"t{i}") for i in range(120)]
    rows += [(None, None, "en", None, None), (None, "x", "en", 1, ""), (None, "x", "en", 1, ""), (3, "s", "one", 9, "alone")]
    rows += [(2**63 - 1, "s", "en", 2**63 - 1, "end"), (-(2**63), "s", "en", 0, "begin")] + [(64, "s", "en", 2, "copies")] * 9
    docs = spark.createDataFrame(rows, FIELDS).selectExpr("*", "1 AS tree", "2 AS leaf", "3 AS pos", "4 AS n", "5 AS word").repartition(4)
    got = sorted(map(tuple, merkle.manifest(docs).collect()), key=repr)
    assert got == sorted(plain_manifest(rows), key=repr)
    one = docs.where("text = 'alone'")
    assert [tuple(r) for r in merkle.manifest(one).collect()] == plain_manifest([rows[123]])
    assert merkle.manifest(docs.limit(0)).collect() == []


def test_manifest_of_whole_arrays(spark):
    """Several arrays of 1024 leaves, the last one not full."""
    rows = [(i * 3, "s", "en" if i % 50 else None, i, f"text {i}") for i in range(5000)]
    got = sorted(map(tuple, merkle.manifest(spark.createDataFrame(rows, FIELDS)).collect()))
    assert got == sorted(plain_manifest(rows))
