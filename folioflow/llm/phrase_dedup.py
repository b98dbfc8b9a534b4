"""Removal of byte strings that occur in an earlier document, by prefix-free parsing.

A rolling hash over 16 bytes sets triggers: of the hashes inside a string of 50 bytes, the smallest is that
string's trigger, so equal strings have equal triggers wherever they stand. Neighbouring strings with one
trigger form a phrase, which reaches 49 bytes into its successors in the parse; the suffixes of a phrase then
order the corpus to a depth of 50 bytes without looking at the parse again, so the parse's own suffix array is not needed.
The dictionary holds each distinct phrase whose trigger occurs in two documents, with the first document that has it. Strings
are equal only if their triggers stand at one place in them, so the suffixes that begin with a trigger are sorted, and so is, backwards, what stands
before it: a run of neighbours in both orders gives the first document of a string, and no string is sorted by itself.

On Spark, documents are dealt into batches by a hash of their id. Each distinct trigger of a batch is a row, and Spark
counts the batches of a trigger. Where all have the same one phrase, as inside a copied passage, its first document is known
at once. Else each distinct phrase of a shared trigger is a row of its trigger's bucket, whose sorted suffixes answer with
one mask a phrase. A trigger or phrase that very many documents hold is thus one row for each
batch, never one for each document, and rows grow in proportion to the bytes. A trigger may stand in very many different phrases, as
at the edges of a passage that a large part of the documents quote; such a trigger's strings go to buckets of their own
hash, one by one, and Spark's windows, which spill, find the first document of each. A task's Python holds at most ``HOT``
phrases of one trigger, each once for a batch that has it, and passes the strings on batch by batch, however many batches of text have them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

LENGTH, TRIGGER = 50, 16
#: Where the words begin that cover a string.
WORDS = (*range(0, LENGTH - 8, 8), LENGTH - 8)
#: Phrases of a trigger, counted in each batch, above which its strings are dealt one by one: what a bucket has to hold of one trigger at most.
HOT = 20_000
#: Bytes of text in a batch, and positions or phrases that are hashed at a time: as many as a core's cache holds.
BATCH_BYTES, STRETCH = 8 << 20, 1 << 15
#: Bits that number the positions of a stretch and of the strings that begin in it.
PLACE = 16
U = np.uint64
# Odd multipliers that spread bits.
SPREAD_A, SPREAD_B, SPREAD_C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    y = x >> U(32)
    y ^= x
    y *= SPREAD_A
    z = y >> U(29)
    y ^= z
    y *= SPREAD_B
    y ^= np.right_shift(y, U(32), out=z)
    return y


def _words(data: np.ndarray, order: str = "<") -> np.ndarray:
    """At each position, the eight bytes from there on as one integer: a view."""
    return np.ndarray(max(len(data) - 7, 0), f"{order}u8", np.ascontiguousarray(data), strides=(1,))


def _keys(data: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """64-bit hashes of phrases: of the first and the last string, which cover the phrase, and the number of strings."""
    words, out = _words(data), np.empty(len(first), U)
    for at in range(0, len(first), STRETCH):
        f, n = first[at : at + STRETCH], count[at : at + STRETCH]
        key = _mix(n.astype(U))
        for start in (f, f + n - 1):
            for offset in WORDS:
                key *= SPREAD_C
                key += words[start + offset]
                key = _mix(key)
        out[at : at + STRETCH] = key
    return out


def _strings(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each string of some phrases: the phrase's place among them, the string's offset in it, its start."""
    phrase = np.repeat(np.arange(len(first)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return phrase, offset, first[phrase] + offset


@dataclass
class Parse:
    """A batch's bytes and its phrases: first string, number of strings, trigger hash, trigger's place in the phrase, document number."""

    data: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    count: np.ndarray
    trigger: np.ndarray
    lead: np.ndarray
    doc: np.ndarray


def parse(texts: list[bytes], use: list[bool]) -> Parse:
    """Phrases of the texts marked for use; a text of under 50 bytes has none."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    none = np.zeros(len(data), bool)  # where no string starts
    for end, text, on in zip(ends.tolist(), texts, use, strict=True):
        none[max(end - len(text), end - LENGTH + 1) if on else end - len(text) : end] = True
    window, starts, stops, hashes, places = LENGTH - TRIGGER + 1, [], [], [], []
    number = np.arange(STRETCH + window, dtype=np.uint32)
    for at in range(0, len(data) - LENGTH + 1, STRETCH):
        n = min(STRETCH, len(data) - LENGTH + 1 - at)
        w = _words(data[at : at + n + LENGTH - 1]).copy()
        h = w[: n + window - 1] * SPREAD_C
        for offset in (*range(8, TRIGGER - 8, 8), TRIGGER - 8):
            h ^= h >> U(32)
            h *= SPREAD_A
            h += w[offset : offset + n + window - 1] * SPREAD_B
        h ^= h >> U(29)
        h *= SPREAD_C  # the upper bits are the ones that are used
        low = (h >> U(32 + PLACE)).astype(np.uint32)
        low <<= PLACE
        low |= number[: len(h)]  # the leftmost of equal ones
        reach = 1
        while reach < window:
            step = min(reach, window - reach)
            low = np.minimum(low[:-step], low[step:])
            reach += step
        off = none[at : at + n]
        new = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (off[1:] != off[:-1])]))
        end = np.append(new[1:], n)
        real = ~off[new]
        new = new[real]
        place = (low[new] & ((1 << PLACE) - 1)).astype(np.int64)
        starts.append(new + at)
        stops.append(end[real] + at)
        hashes.append(h[place])
        places.append(place - new)
    first, stop, lead = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, stops, places))
    trigger = np.concatenate(hashes) if hashes else np.zeros(0, U)
    return Parse(data, ends, first, stop - first, trigger, lead, np.searchsorted(ends, first, "right"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the way."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        z = pa.array([pack.compress(t) for t in batch.column(2).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), z], ["b", "id", "z"])


def _batch(table: pa.Table, bits: int) -> tuple[list, list[bytes], np.ndarray, Parse]:
    """Ids, texts, ids as integers and phrases of a batch's documents, in order of id and text; triggers cut to ``bits``."""
    unpack = zstandard.ZstdDecompressor()
    rows = sorted(
        zip(table.column("id").to_pylist(), map(unpack.decompress, table.column("z").to_pylist()), strict=True),
        key=lambda r: (r[0] is None, r[0] or 0, r[1]),
    )
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]
    p = parse(texts, [i is not None for i in ids])
    p.trigger >>= U(64 - bits)
    return ids, texts, np.array([i or 0 for i in ids], np.int64), p


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys are neighbours, and where each distinct one begins in it."""
    order = np.argsort(key)
    key = key[order]
    return order, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])


def _firsts(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct key, in order: the key, its least document, and a place that has the key."""
    order, at = _groups(key)
    one = order[at]
    return key[one], np.minimum.reduceat(doc[order], at) if len(at) else doc, one


def _least(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each entry, the least document of all that have its key."""
    order, at = _groups(key)
    least = np.empty_like(doc)
    if len(at):
        least[order] = np.repeat(np.minimum.reduceat(doc[order], at), np.diff(np.append(at, len(key))))
    return least


def _met(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in x of entries that are known, and where they stand among the known ones, which are sorted.

    Most others are told by their last 20 bits, without a search.
    """
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    some, last = np.zeros(1 << 20, bool), U((1 << 20) - 1)
    some[known & last] = True
    here = np.flatnonzero(some[x & last])
    at = np.minimum(np.searchsorted(known, x[here]), len(known) - 1)
    found = known[at] == x[here]
    return here[found], at[found]


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def _slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes [start, start + size) of each entry, as an array of binaries."""
    places = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data[places])])


TRIGGERS = pa.schema(
    [("b", pa.int32()), ("h", pa.int64()), ("one", pa.int64()), ("doc", pa.int64()), ("n", pa.int32()), ("several", pa.bool_())]
)
PHRASES = pa.schema(
    [("b", pa.int32()), ("k", pa.int32()), ("key", pa.int64()), ("doc", pa.int64()), ("n", pa.int32()), ("lead", pa.int32()), ("hot", pa.int64()), ("raw", pa.binary()), ("string", pa.binary())]
)
MASKS = pa.schema([("b", pa.int32()), ("key", pa.int64()), ("mask", pa.int64()), ("hot", pa.int64()), ("raw", pa.binary())])
#: Bits of the trigger in a row beyond those that number the corpus's bytes, and of a phrase's hash.
SPARE, ONE = 7, 48


def send_triggers(table: pa.Table, bits: int) -> pa.Table:
    """A batch's distinct triggers (b, h): how many phrases they have in it (n), their first document, whether another has them too.

    ``one`` is a hash of the trigger's phrase, -1 if the batch has several phrases of it.
    """
    _, _, number, p = _batch(table, bits)
    if not len(p.first):
        return TRIGGERS.empty_table()
    key, doc = _keys(p.data, p.first, p.count) >> U(64 - ONE) << U(64 - ONE), number[p.doc]  # zeros beside h's own pack well
    order, at = _groups(p.trigger)
    key, doc = key[order].view(np.int64), doc[order]
    one, least = np.minimum.reduceat(key, at), np.minimum.reduceat(doc, at)
    size, most = np.diff(np.append(at, len(key))), np.maximum.reduceat(key, at)
    n = np.ones(len(at), np.int64)
    several = np.repeat((size > 1) & (one < most), size)  # the others have one phrase
    if several.any():
        home, key = np.repeat(np.arange(len(at)), size)[several], key[several]
        inner = np.lexsort((key, home))
        fresh = np.concatenate([[True], key[inner][1:] != key[inner][:-1]]) | np.concatenate([[True], home[inner][1:] != home[inner][:-1]])
        n = np.maximum(n, np.bincount(home[inner][fresh], minlength=len(at)))
    columns = [
        np.full(len(at), table.column("b")[0].as_py(), np.int32),
        p.trigger[order[at]].view(np.int64),
        np.where(one == most, one, -1),
        least,
        n.astype(np.int32),
        np.maximum.reduceat(doc, at) > least,
    ]
    return pa.table([pa.array(c) for c in columns], schema=TRIGGERS)


#: What is known of a shared trigger: it has several phrases, or very many of them, or one phrase with an earlier document.
SEVERAL, VERY_MANY, EARLIER = 0, 1, 2


def shared_triggers(triggers: DataFrame) -> DataFrame:
    """(b, h, kind) of the triggers that two documents of the corpus have, for the batches that need to know.

    A trigger has one row of numbers a batch, which the window spills where very many batches have it.
    """
    w = Window.partitionBy("h")
    counted = triggers.select(
        "b", "h", "one", "doc",
        F.count(F.lit(1)).over(w).alias("batches"), F.max("several").over(w).alias("several"), F.sum("n").over(w).alias("n"),
        F.min("one").over(w).alias("least"), F.max("one").over(w).alias("most"), F.min("doc").over(w).alias("first"),
    ).where("batches > 1 or several")
    same = (F.col("least") == F.col("most")) & (F.col("least") != -1)
    kind = (
        F.when(same & (F.col("doc") > F.col("first")), EARLIER)
        .when(same, None)  # its first document is here, and the batch itself sees the others
        .when(F.col("n") > HOT, VERY_MANY)
        .otherwise(SEVERAL)
    )
    return counted.select("b", "h", kind.alias("kind")).where("kind is not null")


def send_phrases(table: pa.Table, shared: pa.Table, buckets: int, bits: int) -> pa.Table:
    """A batch's distinct phrases with one of these triggers, each with its first document in the batch.

    Of a hot trigger each distinct string is sent by itself, in ``string``, to the bucket of its own hash. The
    batch's triggers with an earlier document pass through as one row without a key.
    """
    if not len(table) or not len(shared):
        return PHRASES.empty_table()
    _, _, number, p = _batch(table, bits)
    h, kind = _numbers(shared.column("h")).view(U), _numbers(shared.column("kind"))
    here, _ = _met(p.trigger, np.sort(h[kind == SEVERAL]))
    key, doc, one = _firsts(_keys(p.data, p.first[here], p.count[here]), number[p.doc[here]])
    one = here[one]
    first, count, lead, home, trigger = p.first[one], p.count[one], p.lead[one], p.trigger[one], np.full(len(one), -1)
    if (kind == VERY_MANY).any():
        here, _ = _met(p.trigger, np.sort(h[kind == VERY_MANY]))
        phrase, offset, start = _strings(p.first[here], p.count[here])
        single = np.ones(len(start), np.int64)
        own, least, one = _firsts(_keys(p.data, start, single), number[p.doc[here[phrase]]])
        key, doc, first, count = (np.concatenate(x) for x in ((key, own), (doc, least), (first, start[one]), (count, single[one])))
        lead = np.concatenate([lead, (p.lead[here[phrase]] - offset)[one]])
        home, trigger = np.concatenate([home, own]), np.concatenate([trigger, p.trigger[here[phrase[one]]].view(np.int64)])
    b, known = table.column("b")[0].as_py(), h[kind == EARLIER]
    sent = [
        np.full(len(key), b, np.int32),
        (_mix(home) % U(buckets)).astype(np.int32),
        key.view(np.int64),
        doc,
        count.astype(np.int32),
        lead.astype(np.int32),
        trigger,
    ]
    raw, alone = _slices(p.data, first, count + LENGTH - 1), pa.array(trigger >= 0)
    none = pa.nulls(len(raw), pa.binary())
    phrases = pa.table([*map(pa.array, sent), pc.if_else(alone, none, raw), pc.if_else(alone, raw, none)], schema=PHRASES)
    passed = {"b": [b], "k": [b % buckets], "raw": [_packed_list(known)]} if len(known) else {}
    return pa.concat_tables([phrases, pa.table({f.name: pa.array(passed.get(f.name, [None] * len(passed.get("b", []))), f.type) for f in PHRASES})])


def _packed_list(numbers: np.ndarray) -> bytes:
    """A set of numbers as compressed differences."""
    return zstandard.ZstdCompressor(level=3).compress(np.diff(np.unique(numbers), prepend=U(0)).tobytes())


def _unpacked_lists(column: pa.ChunkedArray) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    return np.concatenate([np.zeros(0, U), *(np.cumsum(np.frombuffer(unpack.decompress(x), U), dtype=U) for x in column.to_pylist())])


def answer_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch's phrases, masks of the strings that occur in a document before the phrase's own.

    Strings of hot triggers come with their first document and are answered as they pass, always, since their batch compares
    its own documents' strings as well. Rows without a key come back as they are.
    """
    held = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        phrase = pc.is_valid(table.column("raw"))
        held.append(table.filter(pc.and_(phrase, pc.is_valid(table.column("key")))))
        rest = table.filter(pc.or_(pc.invert(phrase), pc.is_null(table.column("key"))))
        later = pc.cast(pc.greater(rest.column("doc"), rest.column("first")), pa.int64())
        yield from rest.append_column("mask", later).select(MASKS.names).cast(MASKS).to_batches()
    if held:
        yield from _masks(pa.concat_tables(held)).to_batches()


def _agree(words: list[np.ndarray]) -> np.ndarray:
    """How many leading bytes each entry of a sorted list shares with the one before it; the first none."""
    shared, equal = np.zeros(len(words[0]), np.int64), np.ones(len(words[0]), bool)
    equal[:1] = False
    for k, w in enumerate(words):
        differ = w[equal] ^ np.roll(w, 1)[equal]
        shared[equal] = 8 * k + sum((differ < U(1) << U(8 * x)).astype(np.int64) for x in range(8))
        equal[equal] = differ == 0
    return shared


def _masks(table: pa.Table) -> pa.Table:
    """Masks of a bucket's phrases, by its dictionary's suffixes.

    Equal strings have their trigger at one place, so the suffixes that begin with a trigger are sorted, and what stands
    before the triggers is sorted backwards. Strings that begin r bytes before their triggers are equal where neighbours
    in both orders agree, in one in 50 - r bytes, in the other in r.
    """
    if not len(table):
        return MASKS.empty_table()
    key, doc, count, lead = (_numbers(table.column(c)) for c in ("key", "doc", "n", "lead"))
    key, count, lead = key.view(U), count.astype(np.int64), lead.astype(np.int64)
    margin = 8 * len(WORDS)  # before the first phrase and after the last one, as words may reach there
    raw = np.frombuffer(b"".join([bytes(margin), *table.column("raw").to_pylist(), bytes(margin)]), np.uint8)
    place = margin + np.cumsum(count + LENGTH - 1) - count - LENGTH + 1
    uniq, least, one = _firsts(key, doc)
    forward, backward = _words(raw, ">"), _words(raw)

    def sorted_words(words: np.ndarray, starts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        columns = [words[x].astype(U) for x in starts]
        order = np.lexsort(columns[::-1])
        return order, _agree([c[order] for c in columns])

    trigger = place[one] + lead[one]
    suffixes, after = sorted_words(forward, [trigger + o for o in range(0, margin, 8)])
    # from here on phrases stand in the order of their suffixes
    n, most, own, trigger = count[one][suffixes], lead[one][suffixes], least[suffixes], trigger[suffixes]
    prefixes, before = sorted_words(backward, [trigger - 8 - o for o in range(0, LENGTH - TRIGGER + 1, 8)])
    most_after = np.maximum(after, np.append(after[1:], 0))
    most_before = np.empty_like(before)
    most_before[prefixes] = np.maximum(before, np.append(before[1:], 0))
    low, high = np.maximum(most - n + 1, LENGTH - most_after), np.minimum(most, most_before)
    found = np.zeros(len(n), U)
    behind = np.empty(len(n), np.int64)
    for r in range(LENGTH - TRIGGER + 1):
        here = np.flatnonzero((low <= r) & (r <= high))
        if not len(here):
            continue
        behind[prefixes] = np.cumsum(before < r)
        same = np.cumsum(after < LENGTH - r)[here] << 32 | behind[here]
        earlier = own[here] > _least(same, own[here])
        found[here] |= earlier.astype(U) << (most[here] - r).astype(U)
    mask = np.empty(len(n), U)
    mask[suffixes] = found
    at = np.searchsorted(uniq, key)
    full = (U(1) << count.astype(U)) - U(1)
    masks = np.where(doc > least[at], full, mask[at])
    on = pa.array(np.flatnonzero(masks > 0))
    columns = [table.column("b").take(on), table.column("key").take(on), pa.array(masks.view(np.int64)).take(on), table.column("hot").take(on)]
    return pa.table([*columns, pa.nulls(len(on), pa.binary())], schema=MASKS)


SPANS = "array<struct<start:int,stop:int>>"
SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])


def _looked_up(key: np.ndarray, known: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The bits of each key among sorted known ones, 0 for others."""
    here, at = _met(key, known)
    found = np.zeros(len(key), U)
    found[here] = bits[at]
    return found


def cut_batch(table: pa.Table, masks: pa.Table, id_type: pa.DataType, bits: int) -> pa.Table:
    """Each document of a batch with its removed spans and the bytes that stay.

    ``masks`` has (key, mask, hot) of phrases, and lists of triggers whose phrases go as a whole, without a key.
    """
    ids, texts, number, p = _batch(table, bits)
    key = _keys(p.data, p.first, p.count)
    whole = masks.column("key").is_null().combine_chunks()
    earlier, masks = _unpacked_lists(masks.column("raw").filter(whole)), masks.filter(pc.invert(whole))
    sent, bits_of, hot = (_numbers(masks.column(c)) for c in ("key", "mask", "hot"))
    order = np.lexsort((sent.view(U), hot >= 0))
    sent, bits_of, hot = sent[order].view(U), bits_of[order].view(U), hot[order]
    cold = len(hot) - np.count_nonzero(hot >= 0)
    mask = _looked_up(key, sent[:cold], bits_of[:cold])
    full = (U(1) << p.count.astype(U)) - U(1)
    every, _ = _met(p.trigger, np.sort(earlier))
    mask[every] = full[every]
    if cold < len(hot):  # strings of hot triggers have masks of their own
        here, _ = _met(p.trigger, np.unique(hot[cold:].view(U)))
        phrase, offset, start = _strings(p.first[here], p.count[here])
        own = _keys(p.data, start, np.ones(len(start), np.int64))
        doc = number[p.doc[here[phrase]]]
        gone = (_looked_up(own, sent[cold:], bits_of[cold:]) > 0) | (doc > _least(own, doc))
        np.bitwise_or.at(mask, here[phrase], gone.astype(U) << offset.astype(U))
    later = number[p.doc] > _least(key, number[p.doc])
    mask[later] = full[later]
    on, whole = np.flatnonzero((mask > 0) & (mask < full)), np.flatnonzero(mask == full)
    # each string is in one phrase, so starts are distinct, and a later one's end is later
    first = [p.first[whole], *(p.first[on[(mask[on] >> U(o)) & U(1) > 0]] + o for o in range(LENGTH - TRIGGER + 1))]
    stop = [p.first[whole] + p.count[whole] + LENGTH - 1, *(x + LENGTH for x in first[1:])]
    starts, stops = np.concatenate(first), np.concatenate(stop)
    order = np.argsort(starts)
    starts, stops = starts[order], stops[order]
    owner = np.searchsorted(p.ends, starts, "right")
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (starts[1:] > stops[:-1]) | (owner[1:] != owner[:-1])  # a span ends with its document
    at = np.flatnonzero(fresh)
    starts, stops, owner = starts[at], stops[np.append(at[1:], len(stops))[: len(at)] - 1], owner[at]
    sizes = np.array([len(t) for t in texts], np.int64)
    base = (p.ends - sizes)[owner]
    starts, stops = starts - base, stops - base
    spans = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (starts, stops)], fields=list(SPAN))
    bounds = np.searchsorted(owner, np.arange(len(ids) + 1))
    kept = list(texts)
    for i in np.unique(owner).tolist():
        a, b = starts[bounds[i] : bounds[i + 1]].tolist(), stops[bounds[i] : bounds[i + 1]].tolist()
        kept[i] = b"".join(texts[i][x:y] for x, y in zip([0, *b], [*a, len(texts[i])], strict=True))
    return pa.table(
        {
            "id": pa.array(ids, id_type),
            "n_bytes": pa.array(sizes),
            "removed": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spans),
            "kept": pa.array(kept, pa.binary()),
        }
    )


def phrase_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """(id, n_bytes, removed, kept): each document without the bytes under a 50-byte string of an earlier document.

    One row per input row. A null text counts as empty. Rows that share an id are one document's and remove
    nothing from each other; a row with a null id neither removes nor loses bytes. Matches never cross documents,
    and strings are judged on the input. An empty table gives an empty result. ``removed`` has maximal spans in
    bytes of the UTF-8 text, ``kept`` the other bytes. Ids are integers. Other columns are not carried.

    The texts are shuffled once, into batches of about ``batch_bytes``; a batch's bytes, a few times over, are what
    a task holds. Within a batch or bucket, phrases are told apart by 64-bit hashes of the whole phrase, those of one trigger in
    different batches by 48 bits of them; strings of different phrases are compared byte by byte.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_of(text_col))), F.lit(0))).first()[0]
    batches = max(1, -(-size // batch_bytes))
    kind = docs.schema[id_col].dataType.simpleString()
    raw = docs.select(
        F.pmod(F.xxhash64(id_col), F.lit(batches)).cast("int").alias("b"),
        F.col(id_col).alias("id"),
        F.encode(text_of(text_col), "utf-8").alias("raw"),
    )
    dealt = raw.mapInArrow(_packed, f"b int, id {kind}, z binary")
    bits = min(64, size.bit_length() + SPARE)
    triggers = dealt.groupBy("b").applyInArrow(
        lambda t: send_triggers(t, bits), "b int, h long, one long, doc long, n int, several boolean"
    )
    phrases = dealt.groupBy("b").cogroup(shared_triggers(triggers).groupBy("b")).applyInArrow(
        lambda t, s: send_phrases(t, s, batches, bits), "b int, k int, key long, doc long, n int, lead int, hot long, raw binary, string binary"
    )
    # in the partitions that the groups need anyway; a bucket's phrases have no string and pass the window as one key
    first = F.min(F.when(F.col("string").isNotNull(), F.col("doc"))).over(Window.partitionBy("k", "string"))
    masks = phrases.repartition("k").withColumn("first", first).groupBy("k").applyInArrow(answer_phrases, "b int, key long, mask long, hot long, raw binary")
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.int64())
    cut_docs = dealt.groupBy("b").cogroup(masks.groupBy("b")).applyInArrow(
        lambda t, m: cut_batch(t, m, id_type, bits), f"id {kind}, n_bytes long, removed {SPANS}, kept binary"
    )
    return cut_docs.withColumnRenamed("id", id_col)
