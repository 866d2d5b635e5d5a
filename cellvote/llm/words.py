"""Words and word n-grams of a text as 64-bit hashes, in numpy.

A word is a run of bytes other than ASCII white space.  A word's hash is made of
two polynomials over its bytes, one mod 2^64 and one mod a prime, put through a
finaliser: the first alone gives equal sums to some regular words whatever its
base.  An n-gram's hash combines those of its words.
"""

from __future__ import annotations

import numpy as np

# Multipliers of the hashes (odd, arbitrary).
BASE = 0x9E3779B97F4A7C15
GRAM = np.uint64(0xD6E8FEB86659FD93)
PRIME, PRIME_BASE = (1 << 31) - 1, 1_220_703_125
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLOCK = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_prime_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the result depends on every bit given."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        have = tuple(
            np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]).cumprod(dtype=np.uint64)
            for b in (BASE, inverse)
        )
        _powers[0] = have
    return have[0][:n], have[1][:n]


def _reduced(x: np.ndarray) -> np.ndarray:
    """x mod PRIME, a Mersenne prime, for x below 2^62; PRIME itself may stand for 0."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    return (x & np.uint64(PRIME)) + (x >> np.uint64(31))


def _prime_table(base: int, n: int) -> np.ndarray:
    """base^i mod PRIME for i < n, by doubling."""
    have = _prime_powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        step = np.uint64(pow(base, len(have), PRIME))
        have = np.concatenate([have, (have * step) % np.uint64(PRIME)])
    _prime_powers[base] = have
    return have[:n]


def span_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each span values[begin:end]; equal spans have equal hashes wherever they stand.

    A power sum mod 2^64: quick, but some unequal spans of a regular build share it.
    """
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def strong_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """As span_hashes, with a second sum mod a prime."""
    n = len(values) + 1
    up, down = _prime_table(PRIME_BASE, n), _prime_table(pow(PRIME_BASE, -1, PRIME), n)
    sums = np.zeros(n, np.uint64)
    np.cumsum(_reduced((values.astype(np.uint64) + np.uint64(1)) * up[:-1]), out=sums[1:])
    own = (_reduced(sums[end] - sums[begin]) * down[begin]) % np.uint64(PRIME)
    # not a plain XOR of the two, which are alike for a single value
    return mix(span_hashes(values, begin, end) * GRAM + mix(own + np.uint64(1)))


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end byte of each word."""
    edge = np.flatnonzero(np.diff(_SPACE[np.frombuffer(raw, np.uint8)], prepend=True, append=True))
    return edge[0::2], edge[1::2]


def word_hashes(raw: bytes) -> np.ndarray:
    """uint64 hash of every word, in order.  Works in blocks, cut at white space where there is any."""
    if len(raw) <= _BLOCK:
        begin, end = word_spans(raw)
        return strong_hashes(np.frombuffer(raw, np.uint8), begin, end)
    begin, end = word_spans(raw)
    data, out, i = np.frombuffer(raw, np.uint8), np.empty(len(begin), np.uint64), 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + _BLOCK, side="right")))
        low = int(begin[i])
        out[i:j] = strong_hashes(data[low : int(end[j - 1])], begin[i:j] - low, end[i:j] - low)
        i = j
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words; empty if there are fewer."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out *= GRAM
        out += words[j : j + count]
    return mix(out)
