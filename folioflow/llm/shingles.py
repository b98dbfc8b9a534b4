"""Word shingles of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
U = np.uint64
# Odd multipliers that spread bits; BASE_INVERSE * BASE is 1 modulo 2**64.
SPREAD_A, SPREAD_B, SPREAD_C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0xD6E8FEB86659FD93)
BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * SPREAD_A
    x = (x ^ (x >> U(29))) * SPREAD_B
    return x ^ (x >> U(32))


#: A random-looking number for each byte value.
OF_BYTE = mix(np.arange(1, 257, dtype=U) * SPREAD_C)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of BASE and of its inverse."""
    while len(_powers["up"]) < n:
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            have = _powers[name]
            _powers[name] = np.concatenate([have, have * U(pow(base, len(have), 1 << 64))])
    return _powers["up"], _powers["down"]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One hash for each word, from sums of a polynomial over all of them."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    up, down = powers_to(len(data) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(OF_BYTE[data] * up[: len(data)], dtype=U)])
    ends = np.cumsum(sizes)
    return mix((sums[ends] - sums[ends - sizes]) * down[ends - sizes] + sizes.astype(U))


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``words`` words, and the number of the text of each.

    Words are runs of other bytes than ASCII white space. A text of fewer words has one shingle of all of them,
    one without words none.
    """
    cut = [t.split() for t in texts]
    n = np.array([len(c) for c in cut], np.int64)
    flat = [w for c in cut for w in c]
    if not flat:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = word_hashes(flat)
    begin = np.cumsum(n) - n
    full = np.maximum(n - words + 1, 0)
    doc = np.repeat(np.arange(len(n)), full)
    start = np.repeat(begin - np.cumsum(full) + full, full) + np.arange(full.sum())
    key = mix(h[start])
    for i in range(1, words):
        key = mix(key * SPREAD_C + h[start + i])
    short = np.flatnonzero((n > 0) & (n < words))
    if not len(short):
        return key, doc
    own = []
    for i in short.tolist():
        x = np.zeros(1, U)
        for w in h[begin[i] : begin[i] + n[i]]:
            x = mix(x * SPREAD_C + w)
        own.append(x)
    return np.concatenate([key, *own]), np.concatenate([doc, short])


def strides(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of items of about ``most`` in sum; a larger item is a run of its own."""
    a, held = 0, 0
    for i, size in enumerate(sizes):
        if i > a and held + size > most:
            yield a, i
            a, held = i, 0
        held += size
    if len(sizes) > a:
        yield a, len(sizes)
