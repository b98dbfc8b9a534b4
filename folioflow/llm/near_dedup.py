"""Near-duplicate classes by ProbMinHash sketches of word shingles, banding and verification.

Each distinct shingle of a text is a Poisson process whose rate is the shingle's weight. Its
arrivals visit the registers in an order of its own, each register once, and a register keeps the shingle
that arrives first. Shingles stop once their next arrival is later than every register's. Two texts agree in a
register with their probability Jaccard similarity, so equal bands of six registers make them candidates.
A text has two sketches: one with weights of 1, for which that similarity is the Jaccard similarity of the sets of
shingles, and, where it repeats shingles, one with weights of 1 + log2 of the counts; equal bands of either make candidates.
Candidates are verified on their whole texts by the same two measures, computed exactly: either must reach 0.8.

Texts of equal words are one node from the start. A bucket never emits its pairs: first each text is held against
one hub at a time, the text of a bucket that meets most others, and verified links make components. Only buckets with
several components are then left. These are compared whole, in blocks of bounded size, by counting shared
shingles; a block gives one link for each two components that it connects. The largest component of a bucket is not
compared with itself, so its texts go to one block for each block of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_CLASS, cut, text_of
from .shingles import SPREAD_B, U, mix, shingles, strides

REGISTERS, ROWS, BANDS = 256, 6, 42
LEAST = 0.8
#: Pairs whose sketches agree in less of their registers, by either measure, are not verified; 0.8 lies over nine deviations above.
LEAST_ESTIMATE = 0.55
HUB_ROUNDS = 2
#: Rows of links or of bucket members for each task of the steps over them.
ROWS_A_TASK = 20_000
#: Texts of one bucket that are compared at a time.
BLOCK = 768
STRIDE = 2 << 20


def _counted(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hash, text number, count."""
    key, doc = shingles(texts, words)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])[: len(key)])
    return key[new], doc[new], np.diff(new, append=len(key))


def sketch(key: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Matrix of one row a document: the shingle that came first in each register. ``registers`` is a power of two."""
    soonest = np.full(docs * registers, np.inf)
    winner = np.zeros(docs * registers, U)
    latest = np.full(docs, np.inf)
    start, stride = mix(key ^ SPREAD_B), mix(key + SPREAD_B) | U(1)  # an odd stride visits every register once
    time, live = np.zeros(len(key)), np.arange(len(key))
    for i in range(registers):
        own = key[live]
        step = U((i + 1) * int(SPREAD_B) & (1 << 64) - 1)
        draw = ((mix(own + step) >> U(11)).astype(float) + 1) * 2.0**-53
        time[live] -= np.log(draw) * (registers / (registers - i)) / weight[live]
        live = live[time[live] < latest[doc[live]]]
        if not len(live):
            break
        slot = doc[live] * registers + ((start[live] + stride[live] * U(i)) & U(registers - 1)).astype(np.int64)
        np.minimum.at(soonest, slot, time[live])
        won = soonest[slot] == time[live]
        winner[slot[won]] = key[live[won]]
        latest = soonest.reshape(docs, registers).max(axis=1)
        live = live[time[live] < latest[doc[live]]]
    return winner.reshape(docs, registers)


def bands(winners: np.ndarray, rows: int = ROWS, n: int = BANDS) -> np.ndarray:
    """One hash for each band of each sketch, the band's number included."""
    parts = winners[:, : rows * n].reshape(len(winners), n, rows)
    key = np.broadcast_to(mix(np.arange(1, n + 1, dtype=U)), parts.shape[:2])
    for i in range(rows):
        key = mix(key * SPREAD_B + parts[:, :, i])
    return key


def weights(count: np.ndarray) -> np.ndarray:
    """A shingle's weight by its count in the text."""
    return 1 + np.log2(count)


def probability_jaccard(ka: np.ndarray, wa: np.ndarray, kb: np.ndarray, wb: np.ndarray) -> float:
    """Sum over shared keys of 1 / sum over all keys of max(a_j / a_i, b_j / b_i); ``ka`` and ``kb`` are sorted and distinct.

    For key i the maximum is a_j / a_i where a_j / b_j is at least a_i / b_i, and b_j / b_i elsewhere, so keys in order
    of that quotient need two running sums.
    """
    key, place = np.unique(np.concatenate([ka, kb]), return_inverse=True)
    a, b = np.zeros(len(key)), np.zeros(len(key))
    a[place[: len(ka)]], b[place[len(ka) :]] = wa, wb
    with np.errstate(divide="ignore"):
        order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    above, below = np.cumsum(a[::-1])[::-1], np.cumsum(b) - b
    both = (a > 0) & (b > 0)
    a, b, above, below = a[both], b[both], above[both], below[both]
    return float((1 / (above / a + below / b)).sum())


def _sketches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in strides(pc.binary_length(batch.column(1)).to_pylist(), STRIDE):
            texts = batch.column(1)[a:b].to_pylist()
            key, doc, count = _counted(texts, words)
            w = sketch(key, doc, np.ones(len(key)), b - a)
            band, small = list(bands(w).view("<i8")), [x.tobytes() for x in (w & U(255)).astype(np.uint8)]
            # without repeated shingles the weighted sketch is the same; elsewhere its bands and registers come behind the others
            repeats = np.unique(doc[count > 1])
            own = np.isin(doc, repeats)
            weighted = sketch(key[own], np.searchsorted(repeats, doc[own]), weights(count[own]), len(repeats))
            low = (weighted & U(255)).astype(np.uint8)
            for n, (i, more) in enumerate(zip(repeats.tolist(), bands(weighted).view("<i8"), strict=True)):
                band[i] = np.concatenate([band[i], more[more != band[i]]])
                small[i] += low[n].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[a:b], batch.column(2)[a:b], pa.array(band, pa.list_(pa.int64())), pa.array(small, pa.binary())],
                ["id", "same", "bands", "sketch"],
            )


def _words_digest(text_col: str) -> Column:
    """Digest of a text's words and their order; null without words."""
    text = F.array_join(F.filter(F.split(text_of(text_col), WHITE_CLASS + "+"), lambda w: w != ""), " ")
    return F.md5(F.nullif(text, F.lit("")))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the way."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        z = pa.array([pack.compress(t) for t in batch.column(1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), z], ["id", "z"])


def _agree(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Shares of equal registers of pairs of sketches."""
    same = np.frombuffer(b"".join(x), np.uint8) == np.frombuffer(b"".join(y), np.uint8)
    return same.reshape(-1, REGISTERS).mean(axis=1)


def _verified(batches: Iterator[pa.RecordBatch], words: int, least: float) -> Iterator[pa.RecordBatch]:
    """The pairs of (a, b, za, zb, sa, sb), ids, texts and sketches, that are similar enough by either measure."""
    unpack, names = zstandard.ZstdDecompressor(), ["a", "b"]
    for batch in batches:
        sa, sb = (batch.column(k).to_pylist() for k in (4, 5))
        own, weighted = ([[x[at] for x in s] for s in (sa, sb)] for at in (slice(REGISTERS), slice(-REGISTERS, None)))
        likely = np.maximum(_agree(*own), _agree(*weighted)) >= LEAST_ESTIMATE
        batch = batch.filter(pa.array(likely))
        za, zb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = np.zeros(len(za), bool)
        for i, j in strides([len(x) + len(y) for x, y in zip(za, zb, strict=True)], STRIDE // 4):
            key, doc, count = _counted([unpack.decompress(z) for pair in zip(za[i:j], zb[i:j], strict=True) for z in pair], words)
            order = np.lexsort((key, doc // 2))
            k, pair = key[order], (doc // 2)[order]
            both = np.bincount(pair[1:][(k[1:] == k[:-1]) & (pair[1:] == pair[:-1])], minlength=j - i)
            near = both >= least * (np.bincount(pair, minlength=j - i) - both)
            begin, w = np.searchsorted(doc, np.arange(2 * (j - i) + 1)), weights(count)
            for n in np.flatnonzero(~near & (np.bincount(pair, count[order] > 1, minlength=j - i) > 0)).tolist():
                x, y = slice(begin[2 * n], begin[2 * n + 1]), slice(begin[2 * n + 1], begin[2 * n + 2])
                near[n] = probability_jaccard(key[x], w[x], key[y], w[y]) >= least
            keep[i:j] = near
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], names)


def _block_links(table: pa.Table, words: int, least: float) -> pa.Table:
    """One link (a, b) for each two components that similar enough texts of a block connect.

    Rows are (id, label, side, z): texts of one side are compared with each other, else those of the two sides.
    """
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("id", "label", "side", "z")), strict=True), key=lambda r: r[:3])
    unpack = zstandard.ZstdDecompressor()
    key, doc, count = _counted([unpack.decompress(r[3]) for r in rows], words)
    size = np.bincount(doc, minlength=len(rows))
    place, at = np.searchsorted(doc, np.arange(len(rows) + 1)), key
    order = np.argsort(key, kind="stable")
    key, owner = key[order], doc[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    end = np.append(begin[1:], len(key))
    both = np.zeros((len(rows), len(rows)), np.int32)
    for a, b in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True):
        own = owner[a:b]
        both[own[:, None], own] += 1
    _, label = np.unique([r[1] for r in rows], return_inverse=True)
    side = np.array([r[2] for r in rows])
    other = (label[:, None] != label) & ((side[:, None] != side) | (side.min() == side.max()))
    near = other & (both >= least * (size[:, None] + size - both))
    # the second measure, for texts that repeat shingles; it is at most the sum of the lesser shares of the weights
    w = weights(count)
    share = w / np.bincount(doc, w, minlength=len(rows))[doc]
    held = share[order]
    for i in np.unique(doc[count > 1]).tolist():
        mine = slice(place[i], place[i + 1])
        runs = np.searchsorted(key[begin], at[mine])
        n = (end - begin)[runs]
        spots = np.repeat(begin[runs] - np.cumsum(n) + n, n) + np.arange(n.sum())
        most = np.bincount(owner[spots], np.minimum(held[spots], np.repeat(share[mine], n)), minlength=len(rows))
        for j in np.flatnonzero(other[i] & ~near[i] & (most >= least - 1e-9)).tolist():
            yours = slice(place[j], place[j + 1])
            near[i, j] = near[j, i] = probability_jaccard(at[mine], w[mine], at[yours], w[yours]) >= least
    x, y = np.nonzero(near & (label[:, None] > label))
    _, one = np.unique(np.stack([label[x], label[y]]), axis=1, return_index=True)
    kind = table.schema.field("id").type
    return pa.table({"a": pa.array([rows[i][0] for i in x[one]], kind), "b": pa.array([rows[i][0] for i in y[one]], kind)})


def components(links: DataFrame) -> DataFrame:
    """(id, label): for each id in the links (a, b), the least id of its component.

    Labels spread along links and then jump to their own label, until none changes. Each round is checkpointed.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    parts = both.count() // ROWS_A_TASK + 1  # links are few beside documents, and each round has several shuffles
    both = both.coalesce(parts)
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")).coalesce(parts))
    while True:
        met = both.join(labels, F.col("b") == F.col("id")).select("a", "label").coalesce(parts)
        near = met.groupBy("a").agg(F.min("label").alias("m"))
        spread = labels.join(near, F.col("id") == F.col("a")).select(
            "id", F.col("label").alias("was"), F.least("label", "m").alias("label")
        )
        jump = labels.select(F.col("id").alias("at"), F.col("label").alias("to"))
        jumped = spread.coalesce(parts).join(jump, F.col("label") == F.col("at"))
        new = cut(jumped.select("id", "was", F.least("label", "to").alias("label")).coalesce(parts))
        labels = new.select("id", "label")
        if new.where("label < was").isEmpty():
            return labels


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """Bucket members with their component, their own id where no link has them."""
    return (
        members.join(components(links), "id", "left")
        .withColumn("label", F.coalesce("label", "id"))
    )


def _classed(docs: DataFrame, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    """(id, same, class_id) of each row: its id, its words' digest, the least id of its class."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.encode(text_of(text_col), "utf-8").alias("raw"))
    digested = source.withColumn("same", _words_digest("raw"))
    sketched = cut(
        digested.mapInArrow(lambda b: _sketches(b, words), f"id {kind}, same string, bands array<long>, sketch binary")
    )
    first = sketched.where("same is not null and id is not null").groupBy("same").agg(F.min("id").alias("node"))
    nodes = sketched.join(first, "same").where("id = node").select("id", "same", "bands", "sketch")
    every = nodes.select("id", F.explode("bands").alias("band")).distinct()
    full = every.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = every.join(full, "band")
    met = shared.groupBy("id").agg(F.sum("n").alias("met"))
    members = cut(shared.select("band", "id").join(met, "id"))
    parts = members.count() // ROWS_A_TASK + 1
    members = members.coalesce(parts)
    wanted = members.select("id").distinct()
    texts = source.mapInArrow(_packed, f"id {kind}, z binary").join(wanted, "id").distinct()
    held = cut(texts.join(nodes.select("id", "sketch"), "id"))

    def verify(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links."""
        side = lambda x: held.select(F.col("id").alias(x), F.col("z").alias(f"z{x}"), F.col("sketch").alias(f"s{x}"))
        met = pairs.join(side("a"), "a").join(side("b"), "b")
        return met.select("a", "b", "za", "zb", "sa", "sb").mapInArrow(
            lambda b: _verified(b, words, least), f"a {kind}, b {kind}"
        )

    tried = links = None
    for _ in range(HUB_ROUNDS):
        placed = members.withColumn("label", F.col("id")) if links is None else _labelled(members, links)
        hubs = (
            placed.groupBy("band")
            .agg(F.max(F.struct("met", "id", "label")).alias("hub"), F.min("label").alias("x"), F.max("label").alias("y"))
            .where("x < y")
        )
        pairs = (
            placed.join(hubs, "band")
            .where("label <> hub.label")
            .groupBy(F.col("id").alias("a"), F.col("hub.id").alias("b"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        best = pairs.groupBy("a").agg(F.min_by("b", F.struct((-F.col("n")).alias("n"), "b")).alias("b"))
        best = cut(best.coalesce(parts))
        found = verify(best).coalesce(parts)
        tried = best if tried is None else tried.union(best)
        links = cut(found if links is None else links.union(found))
    placed = cut(_labelled(members, links).coalesce(parts))
    sizes = placed.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = F.max(F.struct("n", "label"))["label"].alias("most")
    mixed = sizes.groupBy("band").agg(largest, F.sum("n").alias("all"), F.max("n").alias("n"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    open_ = placed.join(mixed, "band").join(held.select("id", "z"), "id")
    # blocks of the largest component come first, and only blocks of the others meet all blocks
    main, rest = F.ceil(F.col("n") / BLOCK), F.ceil((F.col("all") - F.col("n")) / BLOCK)
    within, h = F.col("label") == F.col("most"), F.xxhash64("id")
    own = F.when(within, F.pmod(h, main)).otherwise(main + F.pmod(h, rest))
    other = F.explode(F.sequence(F.when(within, main).otherwise(F.lit(0).cast("long")), main + rest - 1))
    found = (
        open_.select("band", "id", "label", "z", own.alias("side"), other.alias("other"))
        .select("band", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "id", "label", "side", "z")
        .groupBy("band", "x", "y")
    )
    links = cut(links.union(found.applyInArrow(lambda t: _block_links(t, words, least), f"a {kind}, b {kind}")))
    label = components(links)
    own = sketched.select("id", "same").join(first, "same", "left")
    return own.join(label.withColumnRenamed("id", "node"), "node", "left").select(
        "id", "same", F.when(F.col("id").isNotNull(), F.coalesce("label", "node", "id")).alias("class_id")
    )


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = LEAST
) -> DataFrame:
    """(id, class_id, n_class): one row per input row; the class is named by the least id in it.

    Classes are the connected components of texts of equal words and of texts with a similarity of ``least`` or more: the
    Jaccard similarity of their sets of shingles, or the probability Jaccard similarity of their shingles with weights of
    1 + log2 of the counts, whichever is greater. Ids are of any type that has an order. A null text counts as empty; texts without a word, and rows with a null id, are
    in no class with others: their class id is their own id, ``n_class`` 1. A text of fewer words than a shingle
    is one shingle. Rows that share an id but not their words are separate members of their
    classes, though one node in the search for links. An empty table gives an empty result. Other columns are not carried.

    A pair of similarity 0.8 shares no band of that measure's sketch with a probability of 3e-6, however each text repeats
    its shingles. Sketches are checkpointed; texts pass one shuffle, compressed, and only those with a candidate go further.
    """
    classed = _classed(docs, id_col, text_col, words, least)
    sizes = classed.where("class_id is not null").groupBy("class_id").agg(F.count(F.lit(1)).alias("n_class"))
    return classed.join(sizes, "class_id", "left").select(
        F.col("id").alias(id_col), "class_id", F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = LEAST) -> DataFrame:
    """The input's rows and columns less those whose id is not the least of their class: one document of each stays.

    Rows that share this id and the class all stay. Rows with a null id and texts without words stay. Only ids and
    digests of the rows that go are joined to the texts; other cases are as in ``near_classes``.
    """
    classed = _classed(docs, id_col, text_col, words, least)
    gone = classed.where("id > class_id").select(F.col("id").alias("__id"), F.col("same").alias("__same")).distinct()
    row = (F.col(id_col) == F.col("__id")) & (_words_digest(text_col) == F.col("__same"))
    return docs.join(gone, row, "left_anti")
