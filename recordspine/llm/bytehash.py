"""Numpy hashing of whole texts as bytes: words, word shingles and all fixed-length windows, many texts at a time.

Windows: a polynomial over a random byte table, modulo 2**64: with prefix sums any window's hash is two look-ups and one
product. Words: a multilinear hash, random table entry of the byte times a random number of its place in the word; a
polynomial modulo 2**64 gives long words of the Thue-Morse kind equal hashes whatever the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20240131)
BYTE_TABLE = _RNG.integers(0, 2**64, 256, dtype=U)
BYTE_TABLE_2 = _RNG.integers(0, 2**64, 256, dtype=U)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
SHINGLE_MULTIPLIERS = _RNG.integers(0, 2**63, 64, dtype=U) * U(2) + U(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i in 0..n."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        for k, x in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(n + 1, U(x))
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (in place)."""
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def prefix_sums(data: np.ndarray, table: np.ndarray = BYTE_TABLE) -> np.ndarray:
    up, _ = powers(len(data))
    out = np.empty(len(data) + 1, dtype=U)
    out[0] = 0
    np.cumsum(table[data] * up[: len(data)], out=out[1:])
    return out


def chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about limit bytes together; a longer text stands alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


WORD_TABLES = _RNG.integers(0, 2**64, (2, 256), dtype=U)
WORD_SALTS = _RNG.integers(0, 2**64, 2, dtype=U)


def place_numbers(n: int, seed: int) -> np.ndarray:
    """A random number for each of the first n places of a word."""
    return mix(mix(np.arange(n, dtype=U) + U(seed << 40)) + WORD_SALTS[seed])


_FIRST_PLACES = [place_numbers(4096, seed) for seed in (0, 1)]


def word_hashes(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, in order, and each text's first word's index (with the end)."""
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    gap = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    if not len(starts):
        return np.empty(0, dtype=U), np.zeros(len(offsets), dtype=np.int64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    letters = joined[~gap]
    letters = letters + ((letters >= 65) & (letters <= 90)).astype(np.uint8) * np.uint8(32)
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    terms = WORD_TABLES[seed][letters] * (_FIRST_PLACES[seed] if sizes.max() <= 4096 else place_numbers(int(sizes.max()), seed))[place]
    return mix(np.add.reduceat(terms, first) + sizes.astype(U)), np.searchsorted(starts, offsets)


def shingle_sets(texts: list[bytes], k: int, seed: int = 0) -> Iterator[np.ndarray]:
    """Each text's sorted distinct k-word shingles; with 1 to k-1 words the whole sequence as one; without words none.
    Seeds 0 and 1 give independent hashes of the words."""
    for lo, hi in chunks(texts):
        words, first = word_hashes(texts[lo:hi], seed)
        n = len(words)
        if n >= k:
            flat = words[: n - k + 1] * SHINGLE_MULTIPLIERS[0]
            for j in range(1, k):
                flat += words[j : n - k + 1 + j] * SHINGLE_MULTIPLIERS[j]
            flat = mix(flat)
        for i in range(hi - lo):
            s, e = first[i], first[i + 1]
            if e - s >= k:
                own = np.sort(flat[s : e - k + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif e > s:
                whole = np.full(1, U(e - s))
                for j in range(e - s):
                    whole += words[s + j : s + j + 1] * SHINGLE_MULTIPLIERS[j + 32]
                yield mix(whole)
            else:
                yield np.empty(0, dtype=U)
