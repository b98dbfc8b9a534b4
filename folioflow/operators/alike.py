"""How much of two texts matches in order, as difflib's ``SequenceMatcher`` without junk counts it, for many pairs at once.

The longest common stretch is taken first (of equal ones that which begins first in the first text, then in the second), then the
same left and right of it. Here the stretches of two characters and more of a group of pairs are found in one join of their
bigrams, and each step of all pairs is one pass over the stretches left; where none is left, single characters match in order.
"""

from __future__ import annotations

import difflib

import numpy as np

#: Characters of a group of pairs, and most meeting bigrams of one; a pair with more is left to difflib, whose memory is linear.
CHARS, MEETINGS = 100_000, 1 << 20
PLACE = 21  # bits of a place in a text, and of a code point
MASK = (1 << PLACE) - 1


def ratios(pairs: list[tuple[str, str]], chars: int = CHARS, meetings: int = MEETINGS) -> list[float]:
    """For each pair 2 * matching characters / all characters; 1 for equal texts, 0 where one of two is empty."""
    out = [1.0 if a == b else 0.0 for a, b in pairs]
    group, held = [], 0
    for n, (a, b) in enumerate(pairs):
        if a == b or not a or not b:
            continue
        if group and held + len(a) + len(b) > chars:
            _matched(group, pairs, out, meetings)
            group, held = [], 0
        group.append(n)
        held += len(a) + len(b)
    _matched(group, pairs, out, meetings)
    return out


def _bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each text begins, places of all bigrams, (text, bigram) as one number) of texts one behind another."""
    sizes = np.array([len(t) for t in texts])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.flatnonzero(owner[:-1] == owner[1:])
    return begins, at, owner[at] << 2 * PLACE | codes[at] << PLACE | codes[at + 1]


def _matched(group: list[int], pairs: list[tuple[str, str]], out: list[float], meetings: int) -> None:
    """Set the ratios of a group's pairs."""
    if not group:
        return
    firsts, seconds = [pairs[n][0] for n in group], [pairs[n][1] for n in group]
    one = len(group) == 1
    if one and max(len(firsts[0]), len(seconds[0])) > MASK:
        out[group[0]] = difflib.SequenceMatcher(None, firsts[0], seconds[0], autojunk=False).ratio()
        return
    a_begin, a_at, a_key = _bigrams(firsts)
    b_begin, b_at, b_key = _bigrams(seconds)
    order = np.argsort(b_key, kind="stable")
    b_at, b_key = b_at[order], b_key[order]
    low = np.searchsorted(b_key, a_key, "left")
    count = np.searchsorted(b_key, a_key, "right") - low
    total = int(count.sum())
    if total > meetings:
        if one:
            out[group[0]] = difflib.SequenceMatcher(None, firsts[0], seconds[0], autojunk=False).ratio()
        else:
            _matched(group[: len(group) // 2], pairs, out, meetings)
            _matched(group[len(group) // 2 :], pairs, out, meetings)
        return
    i, j, length = _stretches(a_at, b_at, low, count, int(a_begin[-1]) + 2, int(b_begin[-1]))
    found = _split(i, j, length, a_begin, b_begin, "".join(firsts), "".join(seconds))
    for n, a, b, m in zip(group, firsts, seconds, found.tolist(), strict=True):
        out[n] = 2.0 * m / (len(a) + len(b))


def _stretches(a_at: np.ndarray, b_at: np.ndarray, low: np.ndarray, count: np.ndarray, width: int, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, length) of the stretches that can't be made longer, from the bigrams that meet: those next to each other on a diagonal."""
    i = np.repeat(a_at, count)
    j = b_at[np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
    key = np.sort((i - j + shift) * width + i)
    opens = np.flatnonzero(np.diff(key, prepend=-2) != 1)
    length = np.diff(opens, append=len(key)) + 1
    diagonal, i = np.divmod(key[opens], width)
    return i, i - diagonal + shift, length


def _split(i: np.ndarray, j: np.ndarray, length: np.ndarray, a_begin: np.ndarray, b_begin: np.ndarray, a: str, b: str) -> np.ndarray:
    """Matching characters of each pair. A stretch is never longer than the one taken, so it goes on at one side of it at most."""
    pair = np.arange(len(a_begin) - 1)
    a_low, a_high, b_low, b_high = a_begin[:-1], a_begin[1:], b_begin[:-1], b_begin[1:]
    a_zero, b_zero = a_low, b_low
    own = np.searchsorted(a_begin, i, "right") - 1
    matched = np.zeros(len(pair), np.int64)
    while len(pair):
        cut = np.maximum(np.maximum(a_low[own] - i, b_low[own] - j), 0)
        i, j = i + cut, j + cut
        length = np.minimum(np.minimum(length - cut, a_high[own] - i), b_high[own] - j)
        keep = length > 1
        i, j, length, own = i[keep], j[keep], length[keep], own[keep]
        best = np.zeros(len(pair), np.int64)
        first = MASK - (i - a_zero[pair[own]])
        np.maximum.at(best, own, length << PLACE | first)
        top = np.flatnonzero(length << PLACE | first == best[own])  # of the longest those that begin first in a
        second = np.zeros(len(pair), np.int64)
        np.maximum.at(second, own[top], MASK - (j[top] - b_zero[pair[own[top]]]))
        some = best > 0
        for p, al, ah, bl, bh in zip(*(x[~some].tolist() for x in (pair, a_low, a_high, b_low, b_high)), strict=True):
            matched[p] += _in_order(a[al:ah], b, bl, bh)
        k = best >> PLACE
        at_a, at_b = MASK - (best & MASK) + a_zero[pair], MASK - second + b_zero[pair]
        np.add.at(matched, pair, k)
        left = some & (a_low < at_a) & (b_low < at_b)
        right = some & (at_a + k < a_high) & (at_b + k < b_high)
        n = int(left.sum())
        to_left, to_right = np.cumsum(left) - 1, np.cumsum(right) - 1 + n
        goes_left = left[own] & (i < at_a[own]) & (j < at_b[own])
        goes_right = right[own] & (i + length > (at_a + k)[own]) & (j + length > (at_b + k)[own])
        stays = goes_left | goes_right
        own = np.where(goes_left, to_left[own], to_right[own])[stays]
        i, j, length = i[stays], j[stays], length[stays]
        a_low, a_high = np.concatenate([a_low[left], (at_a + k)[right]]), np.concatenate([at_a[left], a_high[right]])
        b_low, b_high = np.concatenate([b_low[left], (at_b + k)[right]]), np.concatenate([at_b[left], b_high[right]])
        pair = np.concatenate([pair[left], pair[right]])
    return matched


def _in_order(a: str, b: str, low: int, high: int) -> int:
    """Characters of ``a`` that match in ``b`` one behind another, where no two neighbours match together."""
    n = 0
    for c in a:
        at = b.find(c, low, high)
        if at >= 0:
            n += 1
            low = at + 1
            if low == high:
                break
    return n
