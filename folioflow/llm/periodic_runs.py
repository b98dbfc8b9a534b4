"""Periodic runs of words: maximal repetitions by a suffix tree and its smaller halves.

In the suffix tree of a text, a branching tandem repeat at word i with period q is a node of depth q that has the suffixes i
and i + q below different children. One of the two is not below the node's largest child, so a walk over the leaves of all
children but the largest finds every one; a leaf is in at most log2(n) such smaller halves. A run's last square is branching:
rotated to the left as far as the words agree, it gives the run, and repeats that give one run are merged under the smallest period.

The tree is the intervals of a suffix array with common prefixes, built for a batch of texts at once in numpy: prefixes are
doubled, and suffixes that are told apart drop out. The ranks of each doubling stay, since equal ranks say in one look-up that
2^k words agree; they give the common prefixes and rotate by 2^k words at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE_CLASS, let, text_of
from .shingles import strides

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Words of texts that are indexed at once; a longer text is a batch of its own.
BATCH_WORDS = 1 << 18


def _ranks(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sa, levels) of the suffixes of all texts: their order, and for each k ranks that are equal where 2^k words are.

    ``ids`` are numbers of (text, word), -1 at a text's end. Ranks are places in the order; a suffix that no other one of its
    text shares the first word with is not in ``sa`` and ranks below 0. A suffix of just 2^k words meets its text's end there.
    """
    n = len(ids)
    at = np.flatnonzero(ids >= 0)
    at = at[np.argsort(ids[at], kind="stable")]
    key = ids[at]
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    alone = new & np.append(new[1:], True)
    at, new = at[~alone], new[~alone]
    rank = np.full(n, -1, np.int64)
    rank[ids >= 0] = -2 - np.flatnonzero(ids >= 0)  # a number of their own
    first = np.flatnonzero(new)
    rank[at] = np.repeat(first, np.diff(np.append(first, len(at))))
    sa, levels, open_, width = at, [rank], np.arange(len(at)), 1
    while len(open_):
        here = sa[open_]
        major, minor = rank[here], rank[here + width]
        order = np.lexsort((minor, major))
        here, major, minor = here[order], major[order], minor[order]
        sa[open_] = here
        new = np.ones(len(here), bool)
        new[1:] = (major[1:] != major[:-1]) | (minor[1:] != minor[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(here)))
        rank = rank.copy()
        rank[here] = np.repeat(open_[first], size)
        width *= 2
        open_ = open_[np.repeat(size > 1, size)]
        if len(open_):
            levels.append(rank)
    return sa, levels


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes a and b have in common from their start."""
    got = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a + got] == levels[k][b + got]
        got += same.astype(np.int64) << k
    return got


def _smaller_before(x: np.ndarray, strict: bool) -> np.ndarray:
    """For each place the nearest one before it with a smaller value (or an equal one, unless ``strict``), else -1.

    What lies between a place and its guess is never smaller, so a guess's own guess can take its place: ways double.
    """
    best = np.arange(-1, len(x) - 1)
    live = np.arange(len(x))
    while len(live):
        guess = best[live]
        past = guess >= 0
        live, guess = live[past], guess[past]
        go = x[guess] >= x[live] if strict else x[guess] > x[live]
        live, guess = live[go], guess[go]
        best[live] = best[guess]
    return best


def _tandem_repeats(sa: np.ndarray, levels: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all branching tandem repeats."""
    m = len(sa)
    lcp = np.zeros(m + 1, np.int64)  # lcp[j]: of the suffixes j - 1 and j in order; 0 at both ends
    if m > 1:
        lcp[1:m] = _common(levels, sa[:-1], sa[1:])
    low = _smaller_before(lcp, strict=True)
    high = m - _smaller_before(lcp[::-1], strict=True)[::-1]  # the nearest smaller one behind, or m + 1
    # A node is the interval [low, high) around the places of its depth; the first of them is its number.
    equal = _smaller_before(lcp, strict=False)
    name = np.arange(m + 1)
    chained = (equal >= 0) & (lcp[equal] == lcp)
    name[chained] = equal[chained]
    while True:
        further = name[name]
        if np.array_equal(further, name):
            break
        name = further
    size = np.where(lcp > 0, high - np.maximum(low, 0), 0)
    inner = np.flatnonzero((lcp > 0) & (name == np.arange(m + 1)))

    def parent(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return name[np.where(lcp[left] >= lcp[right], left, right)]

    # Children: inner nodes, then leaves; those of the root (depth 0) have no tandem repeat above them.
    kids = np.concatenate([inner, m + 1 + np.arange(m)])
    up = np.concatenate([parent(np.maximum(low[inner], 0), np.minimum(high[inner], m)), parent(np.arange(m), np.arange(1, m + 1))])
    weight = np.concatenate([size[inner], np.ones(m, np.int64)])
    order = np.lexsort((weight, up))
    heaviest = np.ones(len(kids), bool)
    heaviest[:-1] = up[order][1:] != up[order][:-1]
    # For each node the nearest one above it that is entered from a smaller half; 0 stands for the root.
    above = np.zeros(2 * m + 1, np.int64)
    heavy = np.zeros(2 * m + 1, bool)
    above[kids], heavy[kids[order]] = up, heaviest
    above[lcp[np.minimum(above, m)] == 0] = 0
    heavy[above == 0] = False
    light = above.copy()
    while True:
        climbing = np.flatnonzero(heavy)
        if not len(climbing):
            break
        mid = light[climbing]
        light[climbing], heavy[climbing] = light[mid], heavy[mid]
    place = np.full(n, -1, np.int64)
    place[sa] = np.arange(m)
    starts, periods = [], []
    leaf, node = np.arange(m), light[m + 1 + np.arange(m)]
    while True:
        on = node > 0
        leaf, node = leaf[on], node[on]
        if not len(leaf):
            break
        i, q = sa[leaf], lcp[node]
        for start, other in ((i, i + q), (i - q, i - q)):
            inside = (other >= 0) & (other < n)
            at = place[np.where(inside, other, 0)]
            inside &= (at >= np.maximum(low[node], 0)) & (at < high[node])
            s, p = start[inside], q[inside]
            split = _next_differs(levels[0], s, p)
            starts.append(s[split])
            periods.append(p[split])
        node = light[node]
    return (np.concatenate(starts), np.concatenate(periods)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _next_differs(words: np.ndarray, s: np.ndarray, p: np.ndarray) -> np.ndarray:
    return words[s + p] != words[s + 2 * p]


def find_runs(ids: np.ndarray, begin: np.ndarray, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (start, length, period) by start, then period, of all runs, smallest periods, in places of ``ids``.

    ``ids`` are numbers of (text, word), -1 at each text's end; ``begin`` gives for each place where its text starts.
    """
    sa, levels = _ranks(ids)
    start, period = _tandem_repeats(sa, levels, len(ids))
    stop = start + 2 * period
    # Rotate to the left, by the largest steps first: what agrees is shorter than twice the largest step.
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        back = start - step
        can = np.flatnonzero(back >= begin[start])
        same = levels[k][back[can]] == levels[k][back[can] + period[can]]
        start[can[same]] = back[can[same]]
    long = stop - start >= np.maximum(least, exponent * period)
    found = np.unique(np.stack([start[long], stop[long], period[long]], 1), axis=0)  # sorted by start, end, period
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[first]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return np.stack([found[:, 0], found[:, 1] - found[:, 0], found[:, 2]], 1)


def _batch(texts: list[list[bytes]], least: int, exponent: int) -> tuple[list[list[tuple[int, int, int]]], list[np.ndarray | None]]:
    """Runs of each text, and which of its words stay where it has runs."""
    sizes = np.array([len(w) for w in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    number = pa.array([w for words in texts for w in words], pa.binary()).dictionary_encode()
    text = np.repeat(np.arange(len(texts)), sizes)
    words = np.asarray(number.indices, np.int64) if len(text) else np.zeros(0, np.int64)
    ids = np.full(len(words) + len(texts), -1, np.int64)
    inner = np.ones(len(ids), bool)
    inner[ends] = False
    ids[inner] = text * max(1, len(number.dictionary)) + words
    found = find_runs(ids, np.repeat(begins, sizes + 1), least, exponent)
    owner = np.searchsorted(ends, found[:, 0])
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for d, (s, length, q) in zip(owner.tolist(), found.tolist(), strict=True):
        runs[d].append((s - int(begins[d]), length, q))
    kept: list[np.ndarray | None] = []
    for d, own in enumerate(runs):
        if not own:
            kept.append(None)
            continue
        depth = np.zeros(int(sizes[d]) + 1, np.int64)
        for s, length, q in own:
            depth[s + q] += 1
            depth[s + length] -= 1
        kept.append(np.cumsum(depth[:-1]) == 0)
    return runs, kept


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find(batches: Iterator[pa.RecordBatch], batch_words: int, least: int, exponent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.cast(batch.column("__text"), pa.binary())
        for a, b in strides(pc.binary_length(texts).to_numpy().tolist(), 6 * batch_words):
            words = [t.split() for t in texts.slice(a, b - a).to_pylist()]
            runs, kept = _batch(words, least, exponent)
            joined = [b" ".join(w if k is None else [w[i] for i in np.flatnonzero(k).tolist()]) for w, k in zip(words, kept, strict=True)]
            flat = [r for own in runs for r in own]
            offsets = np.cumsum([0, *map(len, runs)])
            columns = [pa.array(x, pa.int64()) for x in (zip(*flat, strict=True) if flat else ([], [], []))]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(RUN)))
            digests = pa.array([hashlib.sha256(j).hexdigest() for j in joined])
            arrays = [batch.column("__id").slice(a, b - a), pa.array([len(w) for w in words], pa.int64()), lists]
            arrays += [pa.array([None if k is None else j.decode() for k, j in zip(kept, joined, strict=True)], pa.string()), digests]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_words", "runs", "collapsed", "collapsed_sha256"])


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST_LENGTH,
    exponent: int = LEAST_EXPONENT,
    batch_words: int = BATCH_WORDS,
) -> DataFrame:
    """(id_col, n_words, runs, collapsed, collapsed_sha256), one row for each input row, without a shuffle.

    Words are separated by ASCII white space and numbered from 0. ``runs`` are (start, length, period), by start and then
    period, of all maximal stretches with that smallest period and a length of at least ``least`` and ``exponent`` periods.
    ``collapsed`` is the text with each word left out that any run holds after its first period, joined by single blanks; it
    is null where there is no run (all words stay), and ``collapsed_sha256`` is its digest, or that of all words. A null text
    counts as empty; rows of one id are rows of their own; other columns are not carried. A task holds a batch of texts of about
    ``batch_words`` words or one longer text, with some 100 bytes a word and 8 more for each doubling of the longest repeat.
    """
    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string, collapsed_sha256 string"
    found = rows.mapInArrow(lambda batches: _find(batches, batch_words, least, exponent), schema)
    return found.withColumnRenamed("id", id_col)


def planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a tenth of the texts, chosen by the CRC of their ids, made periodic from some word on.

    With h the CRC and g = floor(h / 10), where 10 divides h and the text has n > 0 words, its words from a = g % n on repeat
    the first 1 + floor((n - a) / (3 + g % 8)) of them, joined by single blanks. Other texts, and rows with a null id, stay.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text_of(text_col), f"{WHITE_CLASS}+"), lambda w: w != "")

    def again(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, place(i))), " ")).otherwise("")

    return docs.withColumn(text_col, F.when(h % 10 == 0, let(words, again)).otherwise(text_of(text_col)))
