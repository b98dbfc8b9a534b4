"""Byte-level BPE encoding and decoding in numpy matrices.

Texts are cut into pieces by the tokenizer's pattern; each piece is encoded by itself. Pieces not seen yet are
sorted into buckets by length and padded into matrices of token ids, one row a piece. In each round every row
merges its leftmost pair of lowest rank (pairs are found in a hash table kept in numpy arrays), rows close the
gap, and rows without a pair leave the matrix. The result is what the rank file's own library returns.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Pieces of more bytes merge along a heap of pairs instead: a matrix row would need as many rounds as bytes.
LONGEST_ROW = 256
#: Bytes of pieces and ids that a worker remembers in each of two tables, and characters it cuts into pieces at a time.
REMEMBERED, STRIDE = 4 << 20, 1 << 20
#: Fixed value: the pattern under which a piece never goes on from another character into a space, and takes one
#: space before it along. Words between single spaces are then cut by themselves, and remembered whole.
CUT_AT_SPACES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",)
NONE = np.int32(2**31 - 1)


class Memory(dict):
    """Ids by piece, emptied before it holds more than about ``most`` bytes of pieces and ids."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held = most, 0

    def missing(self, wanted: set[str]) -> list[str]:
        """The pieces not known; all of them where the memory is full, which empties it."""
        if self.held > self.most:
            self.clear()
            self.held = 0
        return [p for p in wanted if p not in self]

    def learn(self, pieces: list[str], ids: list[bytes | None]) -> None:
        self.update(zip(pieces, ids, strict=True))
        self.held += sum(map(len, pieces)) + sum(len(x) for x in ids if x)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Tokenizer:
    """A rank file and a pattern, with what this process has encoded already."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.seen, self.words = Memory(REMEMBERED), Memory(REMEMBERED)
        self.by_word = pattern in CUT_AT_SPACES
        self._hash_pairs()

    def _hash_pairs(self) -> None:
        """Open-addressing table: each pair of tokens whose bytes join to a token, and that token's rank."""
        ranks = self.ranks
        pairs = {
            ranks[t[:i]] << 32 | ranks[t[i:]]: r
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        }
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        self.bits = int(len(keys) * 4 - 1).bit_length()
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        at = self._slot(keys)
        while len(keys):
            first = np.unique(at, return_index=True)[1]
            first = first[self.keys[at[first]] == -1]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair joins to; NONE without one, or where an id is -1."""
        out = np.full(left.shape, NONE, np.int32)
        where = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left.ravel()[where].astype(np.int64) << 32 | right.ravel()[where]
        at = self._slot(keys)
        while len(where):
            found = self.keys[at]
            hit = found == keys
            out.ravel()[where[hit]] = self.values[at[hit]]
            on = ~hit & (found != -1)
            where, keys, at = where[on], keys[on], (at[on] + 1) & (len(self.keys) - 1)
        return out

    def _merge_rows(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces of similar length."""
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        inside = np.arange(width) < lengths[:, None]
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[inside] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(len(pieces)), [b""] * len(pieces)
        while len(rows):
            at = ranks.argmin(axis=1)  # the leftmost of lowest rank
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                full = ids[done]
                packed, ends = full[full >= 0].astype("<u4").tobytes(), np.cumsum((full >= 0).sum(axis=1)) * 4
                for row, a, b in zip(rows[done].tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out[row] = packed[a:b]
                rows, ids, ranks, at, best = rows[~done], ids[~done], ranks[~done], at[~done], best[~done]
                if not len(rows):
                    break
            k = np.arange(len(rows))
            ids[k, at] = best
            source = np.arange(ids.shape[1] - 1)
            source = source + (source > at[:, None])
            ids = np.take_along_axis(ids, source, axis=1)
            if ids.shape[1] < 2:
                ranks = np.full((len(rows), 1), NONE, np.int32)
                continue
            ranks = np.take_along_axis(ranks, source[:, : ids.shape[1] - 1], axis=1)
            right = at < ids.shape[1] - 1
            ranks[k[right], at[right]] = self.pair_ranks(ids[k[right], at[right]], ids[k[right], at[right] + 1])
            left = at > 0
            ranks[k[left], at[left] - 1] = self.pair_ranks(ids[k[left], at[left] - 1], ids[k[left], at[left]])
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, along a heap of (rank, place)."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        parts = [self.tokens[i] for i in ids]
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.ranks.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (rank, i, len(parts[i]), len(parts[j])))

        for i in range(n):
            push(i)
        alive = [True] * n
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or len(parts[i]) != a or len(parts[j]) != b:
                continue
            parts[i] += parts[j]
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x, on in zip(ids, alive, strict=True) if on], np.int32)

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces not seen so far."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "replace")
            if (rank := self.ranks.get(raw)) is not None:
                self.seen.learn([piece], [rank.to_bytes(4, "little")])
            elif len(raw) > LONGEST_ROW:
                self.seen.learn([piece], [self._merge_long(raw).astype("<u4").tobytes()])
            else:
                buckets.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for rows in buckets.values():
            for start in range(0, len(rows), 8192):
                part = rows[start : start + 8192]
                self.seen.learn([p for p, _ in part], self._merge_rows([raw for _, raw in part]))

    def _encode_pieces(self, texts: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(text) for text in texts]
        self._learn(self.seen.missing(set(chain.from_iterable(cut))))
        return [b"".join(map(self.seen.__getitem__, pieces)) for pieces in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return self._encode_pieces(texts)
        first, rest = zip(*(text.partition(" ")[::2] for text in texts), strict=True)
        cut = [x.split(" ") if " " in text else [] for x, text in zip(rest, texts, strict=True)]
        new = self.words.missing(set(chain.from_iterable(cut)))
        inner = [w for w in new if w and not w[0].isspace() and not w[-1].isspace()]
        self.words.learn(new, [None] * len(new))  # None: what stands here is cut together with its neighbours
        self.words.learn(inner, self._encode_pieces([" " + w for w in inner]))
        out: list[bytes | None] = []
        for lead, parts in zip(first, cut, strict=True):
            try:
                out.append(None if parts and lead[-1:].isspace() else b"".join(map(self.words.__getitem__, parts)))
            except TypeError:
                out.append(None)
        odd = [i for i, x in enumerate(out) if x is None]
        whole = dict(zip(odd, self._encode_pieces([texts[i] for i in odd]), strict=True))
        leads = self._encode_pieces(list(first))
        return [whole[i] if x is None else leads[i] + x for i, x in enumerate(out)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def strides(texts: list[str], chars: int = STRIDE) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > chars:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """(id, n_tokens, ids): the ids of each whole text, packed as little-endian unsigned 32-bit integers.

    With ``decoded`` a column of that name has the bytes that the packed ids stand for, decoded in the same pass. One row
    per input row, repeated rows and null ids included; a null text counts as empty and has no ids, an empty table gives
    an empty result. No shuffle; a task holds one Arrow batch and the pieces of about a million characters, and remembers
    a bounded number of bytes. Other columns are not carried, whatever their names. ``path`` and ``pattern`` are opened
    and compiled on the workers.
    """
    source = docs.select(F.col(id_col), text_of(text_col).alias("__text"))
    kind = source.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "ids", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            at = 0
            for texts in strides(batch.column(1).to_pylist()):
                ids = own.encode(texts)
                columns = [batch.column(0).slice(at, len(ids)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(ids)

    ddl = f"`{id_col}` {kind}, n_tokens long, ids binary" + ", decoded binary" * decoded
    return source.mapInArrow(run, ddl)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids, decoded): the bytes that the packed ids stand for; null ids decode to nothing."""
    source = encoded.select(id_col, "n_tokens", F.coalesce("ids", F.lit(b"")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            raw = pa.array([own.decode(x) for x in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, raw], [*batch.schema.names, "decoded"])

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded binary")
