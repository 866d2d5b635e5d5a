"""Pre-tokens of a byte-level BPE in numpy, and a codec that encodes only distinct ones.

The byte-level pre-tokenizer cuts a text by the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

and BPE never merges across the cuts, so a text's ids are those of its
pre-tokens in order.  Prose repeats its words, so each task encodes only the
pre-tokens it has not met: characters and ids of the others are kept in arrays of
bounded size, found by hash and compared character by character; when they are
full, those that only one chunk held are forgotten.  Equal pre-tokens of a chunk
are found by hash and compared character by character; if a hash ever joins two,
the chunk is sorted out by the pre-tokens themselves.  The special string of the
vocabulary, which the library looks for before anything else, is a pre-token of
its own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

from cellvote.llm.words import span_hashes

LETTER, NUMBER, OTHER, SPACE, BREAK, UNKNOWN = range(6)
# Values above every code point: end of a text, and the special string inside one.
END, SPECIAL = 0x110000, 0x110001
# The white space of the pattern.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Pre-tokens that op9's encoder keeps between chunks of a task.
KEPT = 400_000
# Pre-tokens and characters of them that a codec keeps; beyond it three quarters stay at most.
HELD, HELD_CHARS = 1_000_000, 16_000_000
# How the vocabulary writes a blank, and the words given to the library in one text.
BLANK, WORDS = "\u0120", 64
# Spans compared at a time.
SPANS = 1 << 13


@cache
def class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.full(0x110002, OTHER, np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        table[c] = UNKNOWN if category == "Cn" else kinds.get(category[0], OTHER)
    table[WHITE] = SPACE
    table[[END, SPECIAL]] = BREAK
    return table


def classes(points: np.ndarray, pre_tokenizer) -> np.ndarray:
    """Class of every code point.

    What Python's Unicode tables do not know yet is put to the tokenizer itself:
    a letter joins the letter before it, a number the digit before it.
    """
    table = class_table()
    kinds = table[points]
    if (kinds == UNKNOWN).any():
        for c in np.unique(points[kinds == UNKNOWN]).tolist():
            joins = [len(pre_tokenizer.pre_tokenize_str(head + chr(c))) == 1 for head in "a1"]
            table[c] = LETTER if joins[0] else NUMBER if joins[1] else OTHER
        kinds = table[points]
    return kinds


def code_points(texts: list[str], special: str | None) -> np.ndarray:
    """All texts as code points, each followed by END, special strings as SPECIAL."""
    end, mark = (np.array([v], "<u4").tobytes() for v in (END, SPECIAL))
    parts = []
    for text in texts:
        if special and special in text:
            parts.append(mark.join(piece.encode("utf-32-le") for piece in text.split(special)))
        else:
            parts.append(text.encode("utf-32-le"))
        parts.append(end)
    return np.frombuffer(b"".join(parts), "<u4")


def cuts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Positions where a pre-token or a BREAK value begins."""
    n = len(points)
    if n == 0:
        return np.empty(0, np.int64)
    run = np.empty(n, bool)
    run[0] = True
    run[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == BREAK)
    begin = run.copy()
    # white space before a word: its last character stands alone or, a blank, joins the word
    words = np.flatnonzero(run & (kinds <= OTHER))
    words = words[words > 0]
    after = words[kinds[words - 1] == SPACE]
    begin[after - 1] = True
    begin[after[points[after - 1] == 0x20]] = False
    # contractions: a lone apostrophe that does not follow a blank, and one or two letters
    lone = np.flatnonzero(begin & (points == 0x27) & (kinds == OTHER))
    lone = lone[lone + 1 < n]
    lone = lone[kinds[lone + 1] == LETTER]
    if len(lone):
        first = points[lone + 1]
        second = np.where(lone + 2 < n, points[np.minimum(lone + 2, n - 1)], END)
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = np.zeros(len(lone), bool)
        for pair in ("re", "ve", "ll"):
            two |= (first == ord(pair[0])) & (second == ord(pair[1]))
        taken = np.where(one, 2, np.where(two, 3, 0))
        short = lone[taken > 0]
        begin[short + 1] = False
        after = short + taken[taken > 0]
        begin[after[after < n]] = True
    return np.flatnonzero(begin)


@dataclass
class Split:
    """Pre-tokens of some texts: the distinct ones, and which of them stands where.

    points: the texts' code points; begin, end, hashes: of each distinct pre-token.
    entries: for each pre-token of all texts in order its number among the
        distinct ones; one number more stands for the special string.
    text_of: the number of the text it is in.
    """

    points: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    entries: np.ndarray
    text_of: np.ndarray

    @property
    def pieces(self) -> list[bytes]:
        """Each distinct pre-token as little-endian code points."""
        raw = self.points.tobytes()
        return [raw[a:b] for a, b in zip((4 * self.begin).tolist(), (4 * self.end).tolist())]


def split(texts: list[str], special: str | None, pre_tokenizer) -> Split:
    points = code_points(texts, special)
    begin = cuts(points, classes(points, pre_tokenizer))
    end = np.append(begin[1:], len(points))
    value = points[begin]
    text_of = np.cumsum(value == END) - (value == END)
    spans = np.flatnonzero(value < END)
    entries = np.full(len(begin), -1, np.int64)
    begin, end = begin[spans], end[spans]
    hashes = _spans(points, begin, end)
    first, entries[spans] = distinct_spans(points, begin, end, hashes)
    entries[value == SPECIAL] = len(first)
    keep = entries >= 0
    return Split(points, begin[first], end[first], hashes[first], entries[keep], text_of[keep])


class Grown:
    """Parts of many lengths one after the other, in an array with room for more."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.buffer, self.sizes, self.starts, self.end = flat, sizes, np.cumsum(sizes) - sizes, len(flat)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        end = self.end + len(flat)
        if end > len(self.buffer):
            room = end - self.end + min(end, HELD_CHARS)
            self.buffer = np.concatenate([self.buffer[: self.end], np.empty(room, flat.dtype)])
        self.buffer[self.end : end] = flat
        self.starts = np.concatenate([self.starts, self.end + np.cumsum(sizes) - sizes])
        self.sizes, self.end = np.concatenate([self.sizes, sizes]), end

    def take(self, numbers: np.ndarray) -> np.ndarray:
        return expand(self.buffer, self.starts[numbers], self.sizes[numbers])


class Codec:
    """Encodes batches of texts; `encode_new` is given distinct pre-tokens and returns their ids."""

    def __init__(self, pre_tokenizer, special: str | None, special_id: int, encode_new: Callable):
        self.pre_tokenizer, self.special, self.special_id, self.encode_new = (
            pre_tokenizer, special, special_id, encode_new,
        )
        # Pre-tokens met, by number: characters, ids, chunks that held them, the last such chunk.
        # Number 0 is the special string.
        self.chars = Grown(np.empty(0, "<u4"), np.zeros(1, np.int64))
        self.ids = Grown(np.array([special_id], "<u4"), np.ones(1, np.int64))
        self.uses, self.last, self.chunk = np.zeros(1, np.int32), np.zeros(1, np.int32), 0
        # their hashes in ascending order, and the number that each stands for
        self.hashes, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int64)

    def find(self, found: Split) -> np.ndarray:
        """Number of each distinct pre-token, -1 for one not met before."""
        numbers = np.full(len(found.hashes), -1, np.int64)
        if len(self.hashes) == 0:
            return numbers
        order = np.argsort(found.hashes)
        at = np.minimum(np.searchsorted(self.hashes, found.hashes[order]), len(self.hashes) - 1)
        numbers[order] = np.where(self.hashes[at] == found.hashes[order], self.numbers[at], -1)
        same = np.flatnonzero(numbers >= 0)
        lengths = found.end[same] - found.begin[same]
        alike = self.chars.sizes[numbers[same]] == lengths
        numbers[same[~alike]] = -1
        same, lengths = same[alike], lengths[alike]
        if len(same):
            differ = expand(found.points, found.begin[same], lengths) != self.chars.take(numbers[same])
            numbers[same[np.logical_or.reduceat(differ, np.cumsum(lengths) - lengths)]] = -1
        return numbers

    def numbers_of(self, found: Split) -> np.ndarray:
        """Number of each distinct pre-token; those not met before are encoded."""
        numbers = self.find(found)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            lengths = found.end[new] - found.begin[new]
            chars = expand(found.points, found.begin[new], lengths)
            text, ends = chars.tobytes().decode("utf-32-le"), np.cumsum(lengths).tolist()
            ids = self.encode_new([text[a:b] for a, b in zip([0, *ends], ends)])
            numbers[new] = np.arange(len(self.uses), len(self.uses) + len(new))
            self.chars.add(chars, lengths)
            self.ids.add(np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
            self.uses, self.last = (np.append(a, np.zeros(len(new), np.int32)) for a in (self.uses, self.last))
            # of two with one hash the first is found, the other one encoded each time
            new = new[np.argsort(found.hashes[new], kind="stable")]
            at = np.searchsorted(self.hashes, found.hashes[new], side="right")
            self.hashes = np.insert(self.hashes, at, found.hashes[new])
            self.numbers = np.insert(self.numbers, at, numbers[new])
        self.chunk += 1
        self.uses[numbers] += 1
        self.last[numbers] = self.chunk
        return numbers

    def trim(self) -> None:
        """Forgets what only one chunk held, and of the rest what was met longest ago."""
        if len(self.uses) <= HELD and self.chars.end <= HELD_CHARS:
            return
        keep = np.flatnonzero(self.uses > 1)
        keep = keep[np.argsort(-self.last[keep], kind="stable")[: 3 * HELD // 4]]
        keep = np.union1d(keep[np.cumsum(self.chars.sizes[keep]) <= 3 * HELD_CHARS // 4], [0])
        number = np.full(len(self.uses), -1)
        number[keep] = np.arange(len(keep))
        self.chars = Grown(self.chars.take(keep), self.chars.sizes[keep])
        self.ids = Grown(self.ids.take(keep), self.ids.sizes[keep])
        self.uses, self.last = self.uses[keep], self.last[keep]
        kept = number[self.numbers] >= 0
        self.hashes, self.numbers = self.hashes[kept], number[self.numbers[kept]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in order (uint32), and the number of ids of each text."""
        found = split(texts, self.special, self.pre_tokenizer)
        # one entry more: the special string
        numbers = np.append(self.numbers_of(found), 0)
        flat, sizes = self.ids.take(numbers), self.ids.sizes[numbers]
        self.trim()
        return laid_out(flat, sizes, found.entries, found.text_of, len(texts))


def distinct_spans(
    points: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The first span of each content, and for every span the number of its content."""
    hashes, where = _factorize(_spans(points, begin, end) if hashes is None else hashes)
    first = np.empty(len(hashes), np.int64)
    first[where[::-1]] = np.arange(len(begin))[::-1]
    if equal_spans(points, begin, end, begin[first][where], end[first][where]):
        return first, where
    raw, numbers, firsts = points.tobytes(), {}, []
    for i, (a, b) in enumerate(zip((4 * begin).tolist(), (4 * end).tolist())):
        number = numbers.setdefault(raw[a:b], len(firsts))
        if number == len(firsts):
            firsts.append(i)
        where[i] = number
    return np.array(firsts, np.int64), where


def equal_spans(points: np.ndarray, begin: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> bool:
    """Whether every span has the characters of its other one."""
    sizes = end - begin
    if (sizes != other_end - other).any():
        return False
    open_ = np.flatnonzero(begin != other)
    begin, other, sizes = begin[open_], other[open_], sizes[open_]
    # few spans at a time, whose places stay in the processor's cache
    for at in range(0, len(begin), SPANS):
        size = sizes[at : at + SPANS]
        first, ends = begin[at : at + SPANS], np.cumsum(size)
        place = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
        if (points[place] != points[place + np.repeat(other[at : at + SPANS] - first, size)]).any():
            return False
    return True


def joined(ids: list[bytes], entries: np.ndarray, text_of: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pre-tokens in order and their number by text, from the ids of each entry."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    return laid_out(np.frombuffer(b"".join(ids), "<u4"), sizes, entries, text_of, n_texts)


def laid_out(
    flat: np.ndarray, sizes: np.ndarray, entries: np.ndarray, text_of: np.ndarray, n_texts: int
) -> tuple[np.ndarray, np.ndarray]:
    """As joined, from the ids of all entries one after the other and their number."""
    starts, each = np.cumsum(sizes) - sizes, sizes[entries]
    counts = np.bincount(text_of, weights=each, minlength=n_texts).astype(np.int64)
    return expand(flat, starts[entries], each), counts


def _spans(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans, in blocks that stay in the processor's cache."""
    block, out, i = 1 << 16, np.empty(len(begin), np.uint64), 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + block, side="right")))
        low = int(begin[i])
        out[i:j] = span_hashes(points[low : int(end[j - 1])], begin[i:j] - low, end[i:j] - low)
        i = j
    return out


def _factorize(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    import pandas as pd

    codes, distinct = pd.factorize(hashes)
    return distinct, codes


def expand(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + sizes[i]] for every i, one after the other."""
    total = int(sizes.sum())
    if total == 0:
        return np.empty(0, flat.dtype)
    ends = np.cumsum(sizes)
    index = np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
    return flat[index]


def texts_of(column: pa.Array) -> list[str]:
    """The texts of a column, a null as the empty one."""
    return [text if text is not None else "" for text in column.to_pylist()]


def long_text(text: str, limit: int = 1 << 20) -> list[str]:
    """A text in pieces that begin with a blank after a character other than white space.

    The pattern always cuts there, so the pieces are encoded as the whole is.
    """
    pieces, begin = [], 0
    while len(text) - begin > limit:
        cut = text.find(" ", begin + limit)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        pieces.append(text[begin:cut])
        begin = cut
    pieces.append(text[begin:])
    return pieces


def encode_texts(codec: Codec, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """codec.encode with long texts in pieces: memory is bound by a piece, not by a text."""
    if all(len(text) <= 1 << 20 for text in texts):
        return codec.encode(texts)
    ids, counts = [], []
    for text in texts:
        parts = [codec.encode([piece])[0] for piece in long_text(text)]
        ids += parts
        counts.append(sum(map(len, parts)))
    return np.concatenate(ids), np.array(counts, np.int64)


@cache
def library_codec(path: str) -> Codec | None:
    """A codec whose new pre-tokens the tokenizers library encodes.

    None if the file's pre-tokenizer is not the byte-level one with the pattern
    above, or its text is changed first: such texts have to go to the library whole.
    """
    import json
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    added, pre = spec.get("added_tokens") or [], spec.get("pre_tokenizer") or {}
    plain = not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added)
    if (
        pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
        or spec.get("normalizer") or len(added) > 1 or not plain or spec["model"].get("dropout")
    ):
        return None
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    vocabulary = tokenizer.get_vocab()
    heads = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    heads[[i for token, i in vocabulary.items() if token.startswith(BLANK)]] = True

    def encode_each(pieces: list[str]) -> list[bytes]:
        encoded = tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def encode_new(pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens; words go to the library many at a time.

        A blank always begins a pre-token of the letters after it, so words in a row
        are cut as each alone, and each one's ids begin where a token has a blank.
        """
        words = [i for i, piece in enumerate(pieces) if piece[0] == " " and piece[1:].isalpha()]
        rows = [words[at : at + WORDS] for at in range(0, len(words), WORDS)]
        texts = ["".join([pieces[i] for i in row]) for row in rows]
        found: list[bytes | None] = [None] * len(pieces)
        for row, e in zip(rows, tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = [*(4 * np.flatnonzero(heads[ids])).tolist(), 4 * len(ids)]
            if len(ends) == len(row) + 1 and ends[0] == 0:
                raw = ids.tobytes()
                for i, start, end in zip(row, ends, ends[1:]):
                    found[i] = raw[start:end]
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(rest, encode_each([pieces[i] for i in rest])):
            found[i] = ids
        return found

    special = added[0] if added else {"content": None, "id": 0}
    return Codec(tokenizer.pre_tokenizer, special["content"], special["id"], encode_new)
