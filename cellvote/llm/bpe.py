"""Byte-level BPE through an index of pair occurrences.

The distinct pre-tokens of a slab (a bounded piece of a partition) are laid out
as one linked row of symbols.  An index maps every pair that has a merge rank to
all its places.  Ranks are taken in ascending order from a heap of the active
ones; each merges all its places at once, and the pairs that appear beside the
new symbols are put into the index.  A merge makes a symbol that no lower rank
mentions, so one ascending pass is the whole encoding.  Places of a pair of two
equal symbols may overlap; they are taken from left to right.

Only the vocabulary and merge list of a tokenizers file are used; the library
itself only says which class a code point has that Python's tables do not know.

Defined results: a null or empty text has no ids and decodes to the empty text;
rows are encoded one by one, so repeated rows get equal results; very long texts
are encoded in pieces cut where the pattern always cuts.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellvote.llm.common import chunks
from cellvote.llm.pretokens import KEPT, expand, joined, long_text, split, texts_of

# Characters of text that are indexed together, at most about this many.
SLAB = 24 << 20
LONG = 1 << 20


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merges:
    """Vocabulary and merge ranks of one file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added, pre = spec.get("added_tokens") or [], spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or len(added) > 1:
            raise ValueError(f"{path}: not a plain byte-level BPE")
        self.pre_tokenizer = Tokenizer.from_file(path).pre_tokenizer
        self.special, self.special_id = (added[0]["content"], added[0]["id"]) if added else (None, 0)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)])
        self.size = max([*vocab.values(), self.special_id]) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs])
        self.right = np.array([vocab[b] for _, b in pairs])
        self.made = np.array([vocab[a + b] for a, b in pairs])
        keys = self.left * self.size + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        bytes_of = {c: b for b, c in letters.items()}
        raw = [b""] * self.size
        for token, i in vocab.items():
            raw[i] = bytes(bytes_of[c] for c in token)
        if self.special is not None:
            raw[self.special_id] = self.special.encode()
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_sizes = np.array([len(r) for r in raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 without one.  A symbol below 0 is a gap between pre-tokens."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(known, self.order[at], -1)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all ids, as uint8."""
        return expand(self.raw, self.raw_starts[ids], self.raw_sizes[ids])


@cache
def merges(path: str) -> Merges:
    return Merges(path)


def encode_pieces(table: Merges, pieces: list[str]) -> list[bytes]:
    """Ids (little-endian uint32) of each pre-token, all encoded together."""
    if not pieces:
        return []
    raw = [p.encode() for p in pieces]
    sizes = np.array([len(r) for r in raw], np.int64)
    # a gap before each piece and after the last
    symbols = np.full(int(sizes.sum()) + len(raw) + 1, -1, np.int64)
    begins = np.cumsum(sizes + 1) - sizes
    inside = np.ones(len(symbols), bool)
    inside[begins - 1] = False
    inside[-1] = False
    symbols[inside] = table.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
    after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
    fresh = np.zeros(len(symbols), bool)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(places: np.ndarray) -> None:
        rank = table.ranks(symbols[places], symbols[after[places]])
        have = rank >= 0
        rank, places = rank[have], places[have]
        if len(rank) == 0:
            return
        order = np.argsort(rank, kind="stable")
        rank, places = rank[order], places[order]
        edges = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        bounds = [0, *edges.tolist(), len(rank)]
        for low, high in zip(bounds, bounds[1:]):
            r = int(rank[low])
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(places[low:high])

    add(np.arange(len(symbols) - 1))
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        a, b = table.left[rank], table.right[rank]
        at = at[symbols[at] == a]
        at = at[symbols[after[at]] == b]
        if a == b and len(at) > 1:
            at = np.sort(at)
            chosen, taken = [], -1
            for place, follower in zip(at.tolist(), after[at].tolist()):
                if place != taken:
                    chosen.append(place)
                    taken = follower
            at = np.array(chosen)
        if len(at) == 0:
            continue
        gone = after[at]
        follow = after[gone]
        symbols[at] = table.made[rank]
        symbols[gone] = -2
        after[at] = follow
        before[follow] = at
        fresh[at] = True
        left = before[at]
        left = left[~fresh[left]]
        fresh[at] = False
        add(np.concatenate([left, at]))
    kept = symbols >= 0
    piece = np.repeat(np.arange(len(raw)), sizes + 1)
    counts = np.bincount(piece[kept[1:]], minlength=len(raw))
    flat = symbols[kept].astype("<u4").tobytes()
    ends = 4 * np.cumsum(counts)
    return [flat[e - 4 * n : e] for e, n in zip(ends.tolist(), counts.tolist())]


class Encoder:
    """Encodes slabs of texts; keeps the ids of pre-tokens it has met, up to a bound."""

    def __init__(self, table: Merges):
        self.table = table
        self.reset()

    def reset(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids: list[bytes] = [np.array([self.table.special_id], "<u4").tobytes()]
        self.pending: list[str] = []

    def note(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Entry of every pre-token of the texts and its text; new pre-tokens wait to be encoded."""
        found = split(texts, self.table.special, self.table.pre_tokenizer)
        numbers = []
        get, new = self.number.get, len(self.ids) + len(self.pending)
        for piece in found.pieces:
            number = get(piece)
            if number is None:
                number = self.number[piece] = new
                new += 1
                self.pending.append(piece.decode("utf-32-le"))
            numbers.append(number)
        entries = np.array([*numbers, 0], np.int32)[found.entries]
        return entries, found.text_of.astype(np.int32)

    def settle(self) -> None:
        """Encodes what waits."""
        self.ids += encode_pieces(self.table, self.pending)
        self.pending = []

    def trim(self) -> None:
        if len(self.ids) > KEPT:
            self.reset()


@cache
def encoder(path: str) -> Encoder:
    return Encoder(merges(path))


def slabs(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[list[pa.RecordBatch]]:
    held, total = [], 0
    for batch in batches:
        for part in chunks(batch, text):
            held.append(part)
            total += part.column(text).nbytes
            if total >= SLAB:
                yield held
                held, total = [], 0
    if held:
        yield held


def encoded(batches: Iterator[pa.RecordBatch], path: str, text: str = "text"):
    """(batch, ids of all its rows, number of ids of each row) for bounded slices of the batches."""
    coder = encoder(path)
    for slab in slabs(batches, text):
        noted = []
        for part in slab:
            texts = texts_of(part.column(text))
            pieces, owner = [], []
            for i, t in enumerate(texts):
                cut = [t] if len(t) <= LONG else long_text(t, LONG)
                pieces += cut
                owner += [i] * len(cut)
            owner = np.array(owner)
            if len(pieces) == len(texts):
                entries, text_of = coder.note(pieces)
                noted.append((part, [(entries, text_of)]))
            else:
                one = [coder.note([p]) for p in pieces]
                noted.append((part, [(e, np.full(len(e), o, np.int32)) for (e, _), o in zip(one, owner)]))
        coder.settle()
        ids = coder.ids
        for part, groups in noted:
            entries = np.concatenate([e for e, _ in groups]) if len(groups) > 1 else groups[0][0]
            text_of = np.concatenate([t for _, t in groups]) if len(groups) > 1 else groups[0][1]
            used, local = np.unique(entries, return_inverse=True)
            flat, counts = joined([ids[u] for u in used.tolist()], local, text_of, part.num_rows)
            yield part, flat, counts
        coder.trim()


def selected(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids ARRAY<INT> of every row."""

    def run(batches):
        for part, ids, counts in encoded(batches, tokenizer_path):
            bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            lists = pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    rows = selected(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids ARRAY<INT>")


def decode(encoded_docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text of (doc_id, ids); bytes that are no UTF-8 become U+FFFD, null ids no text."""

    def run(batches):
        table = merges(tokenizer_path)
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                values = ids.values
                raw = table.decode(np.asarray(values)) if values is not None else np.empty(0, np.uint8)
                texts.append(raw.tobytes().decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded_docs.schema["doc_id"].dataType.simpleString()
    return encoded_docs.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text STRING")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded again."""

    def run(batches):
        table = merges(tokenizer_path)
        for part, ids, counts in encoded(batches, tokenizer_path):
            raw, text = ids.astype("<u4").tobytes(), table.decode(ids).tobytes()
            ends = np.cumsum(counts)
            chars = np.concatenate([[0], np.cumsum(table.raw_sizes[ids])])
            low, high = chars[ends - counts].tolist(), chars[ends].tolist()
            id_sums, text_sums = [], []
            for e, n, a, b in zip(ends.tolist(), counts.tolist(), low, high):
                id_sums.append(hashlib.sha256(raw[4 * (e - n) : 4 * e]).hexdigest())
                decoded = text[a:b].decode(errors="replace").encode()
                text_sums.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_sums), pa.array(text_sums)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = selected(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING")
