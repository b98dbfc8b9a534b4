"""Document quality by a linear-chain conditional random field over lines.

Each line of a text is good or bad. A line's features are counts of its characters and words, whether the text has had it
before, and the same of its two neighbours; a weight for each pair of labels links a line to the next. Trained on documents
whose label all their lines take, the field gives by its forward and backward messages the probability that a line is good,
given all lines of its text; a document's quality is the mean of its lines' probabilities, weighted by their lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .shingles import OF_BYTE, U, mix, powers_to, strides

# Kinds of bytes.
UPPER, LOWER, HIGH, TAIL, DIGIT, BLANK, STOP, CALL, SIGN = range(9)
KIND = np.full(256, SIGN, np.uint8)
for kind, values in (
    (UPPER, range(65, 91)), (LOWER, range(97, 123)), (HIGH, range(192, 256)), (TAIL, range(128, 192)), (DIGIT, range(48, 58)),
    (BLANK, b" \t\n\x0b\f\r"), (STOP, b".,;:'\"-()"), (CALL, b"!?"),
):
    KIND[list(values)] = kind
#: Features of a line itself; neighbours' and the two of the text's edges follow them.
OWN = ("words", "no words", "capitals", "digits", "stops", "calls", "signs", "signed words", "lone signs", "word length", "same as before", "repeated", "seen line")
N_FEATURES = 1 + 3 * len(OWN) + 2
BATCH_BYTES = 4 << 20
#: Bounds of the training sample: documents, chains of neighbouring lines, lines of a chain.
SAMPLE, CHAINS, CHAIN = 4_000, 8_000, 64
GOOD = 0.7


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, text) of all lines of all texts; an empty text is one empty line. Lengths are in bytes."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = KIND[data]
    ends = np.flatnonzero(data == 10)
    begins = np.append(0, ends[:-1] + 1)
    n = len(ends)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begins, side="right")
    line = np.repeat(np.arange(n), ends - begins + 1)
    count = np.bincount(line * 16 + kind, minlength=16 * n).reshape(n, 16)
    # Words, and polynomial hashes of them and of lines.
    inside = kind != BLANK
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers_to(len(data) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(OF_BYTE[data] * up[: len(data)], dtype=U)])
    hashed = lambda a, b: mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U))
    word, owner = hashed(start, stop), line[start]
    per_line = lambda mask: np.bincount(owner[mask], minlength=n)
    words = np.bincount(owner, minlength=n)
    last = kind[stop - 1]
    odd = (last == SIGN) | (last == CALL)
    bare = (kind[start] >= STOP) & (stop - start == 1)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((word, owner))
    copied = np.zeros(len(word), bool)
    copied[1:] = (word[order][1:] == word[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    whole = hashed(begins, ends)
    order_l = np.lexsort((np.arange(n), whole, text))
    seen = np.zeros(n, bool)
    seen[order_l[1:]] = (whole[order_l][1:] == whole[order_l][:-1]) & (text[order_l][1:] == text[order_l][:-1]) & (words[order_l][1:] > 0)

    letters = count[:, UPPER] + count[:, LOWER] + count[:, HIGH]
    marks = np.maximum(1, letters + count[:, [DIGIT, STOP, CALL, SIGN]].sum(1))
    some = np.maximum(1, words)
    own = [
        np.minimum(1, np.log1p(words) / 8), words == 0, count[:, UPPER] / np.maximum(1, letters), count[:, DIGIT] / marks, count[:, STOP] / marks, count[:, CALL] / marks,
        count[:, SIGN] / marks, per_line(odd) / some, per_line(bare) / some, np.minimum(1, (letters / some) / 12), per_line(again) / some,
        np.bincount(owner[order][copied], minlength=n) / some, seen,
    ]
    own = np.stack(own, 1).astype(np.float64)
    own[:, 2:] = np.sqrt(own[:, 2:])  # small shares tell more than large ones
    features = np.zeros((n, N_FEATURES))
    k = len(OWN)
    features[:, 0] = 1
    features[:, 1 : 1 + k] = own
    follows = text[1:] == text[:-1]
    features[1:, 1 + k : 1 + 2 * k] = own[:-1] * follows[:, None]
    features[:-1, 1 + 2 * k : 1 + 3 * k] = own[1:] * follows[:, None]
    features[:, -2] = np.append(1, ~follows)
    features[:, -1] = np.append(~follows, 1)
    return features, ends - begins, text


def _pass_on(x, w: np.ndarray):
    """Log odds of good that a line with log odds ``x`` sends to the next one, by the four weights (bb, bg, gb, gg)."""
    return np.logaddexp(x + w[3], w[1]) - np.logaddexp(x + w[2], w[0])


def fit(features: np.ndarray, begin: np.ndarray, size: np.ndarray, good: np.ndarray, penalty: float = 1e-5, steps: int = 300) -> np.ndarray:
    """Weights of the features, then those of pairs of labels, that make the chains' labels most likely, with an L2 penalty.

    A chain is the rows from ``begin`` on, ``size`` of them, all labelled ``good`` or not. The likelihood is concave; Adam climbs it.
    """
    order = np.argsort(-size, kind="stable")
    begin, size, good = begin[order], size[order], good[order].astype(np.float64)
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size.max()) + 1)]  # chains of more than t lines
    weights, first, second = np.zeros(features.shape[1] + 4), 0.0, 0.0
    n = int(size.sum())
    for step in range(1, steps + 1):
        w, pair = weights[:-4], weights[-4:]
        u = features @ w
        into, onto = np.zeros(len(u)), np.zeros(len(u))  # messages from the line before and from the one behind
        for t in range(1, len(live) - 1):
            at = begin[: live[t]] + t
            into[at] = _pass_on(into[at - 1] + u[at - 1], pair)
        for t in range(len(live) - 2, 0, -1):
            at = begin[: live[t]] + t
            onto[at - 1] = _pass_on(onto[at] + u[at], pair[[0, 2, 1, 3]])
        p = 1 / (1 + np.exp(-np.clip(into + u + onto, -500, 500)))
        slope = np.zeros(len(weights))
        for t in range(0, len(live) - 1):
            at = begin[: live[t]] + t
            slope[:-4] += (good[: live[t]] - p[at]) @ features[at]
            if t:
                a, b = into[at - 1] + u[at - 1], u[at] + onto[at]
                joint = np.stack([np.zeros(len(a)) + pair[0], b + pair[1], a + pair[2], a + b + pair[3]])
                joint = np.exp(joint - joint.max(0))
                slope[-4:] -= (joint / joint.sum(0)).sum(1)
                slope[-4] += len(at) - good[: live[t]].sum()
                slope[-1] += good[: live[t]].sum()
        slope = slope / n - penalty * weights
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights = weights + 0.3 / (1 + step / 100) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return weights


def marginals(u: list[float], pair: tuple[float, float, float, float]) -> list[float]:
    """The probability of good for each line of one text, from the lines' own log odds; one pass each way."""
    bb, bg, gb, gg = pair
    exp, log = math.exp, math.log
    clip = lambda x: max(-500.0, min(500.0, x))

    def send(x: float, down: float, up: float) -> float:
        e = exp(clip(x))
        return log((e * exp(gg) + exp(up)) / (e * exp(down) + exp(bb)))

    into, x = [0.0], 0.0
    for v in u[:-1]:
        x = send(x + v, gb, bg)
        into.append(x)
    out, x = [0.0] * len(u), 0.0
    for t in range(len(u) - 1, -1, -1):
        out[t] = 1 / (1 + exp(-clip(into[t] + u[t] + x)))
        x = send(x + u[t], bg, gb)
    return out


def _score(batches: Iterator[pa.RecordBatch], weights: np.ndarray, good: float) -> Iterator[pa.RecordBatch]:
    pair = tuple(weights[-4:].tolist())
    for batch in batches:
        texts = pc.cast(batch.column("__text"), pa.binary())
        for a, b in strides(pc.binary_length(texts).to_numpy().tolist(), BATCH_BYTES):
            features, length, text = line_features(texts.slice(a, b - a).to_pylist())
            u = (features @ weights[:-4]).tolist()
            cuts = np.searchsorted(text, np.arange(b - a + 1)).tolist()
            p = np.array([x for s, e in zip(cuts, cuts[1:], strict=False) for x in marginals(u[s:e], pair)])
            weight = np.where(np.bincount(text, length)[text] > 0, length, 1).astype(np.float64)
            score = np.clip(np.bincount(text, weight * p) / np.bincount(text, weight), 0, 1)
            bad = np.bincount(text, p < 0.5).astype(np.int64)
            arrays = [batch.column("__id").slice(a, b - a), pa.array(np.diff(cuts), pa.int64()), pa.array(bad), pa.array(score), pa.array((score >= good).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_lines", "n_bad_lines", "score", "predicted"])


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's lines in chains of ``CHAIN`` at most: their features, and a hash to choose chains by."""
    for batch in batches:
        for text, good in zip(batch.column("__text").to_pylist(), batch.column("good").to_pylist(), strict=True):
            features, _, _ = line_features([text.encode()])
            rows = [features[i : i + CHAIN].ravel().tolist() for i in range(0, len(features), CHAIN)]
            yield pa.RecordBatch.from_arrays([pa.array([good] * len(rows), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["good", "features"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, chains: int = CHAINS) -> np.ndarray:
    """Weights fitted to at most ``sample`` labelled documents, chosen by a hash of their ids, and ``chains`` chains of their lines.

    ``labels`` has the id and ``quality`` (1 good, 0 bad); rows with a null in either don't count, and of contradicting
    ones the lower does. Without any label all weights are 0, so each score is one half. The sample, and so what is
    broadcast and what the driver fits, is bounded by the two parameters and ``CHAIN`` lines a chain.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col("quality").cast("int").alias("good")).where("__id IS NOT NULL AND good IS NOT NULL")
    chosen = known.groupBy("__id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    found = texts.join(F.broadcast(chosen), "__id").select("__text", "good").mapInArrow(_chains, "good int, features array<double>")
    rows = found.orderBy(F.xxhash64("features"), "good").limit(chains).collect()
    if not rows:
        return np.zeros(N_FEATURES + 4)
    each = [np.asarray(r.features).reshape(-1, N_FEATURES) for r in rows]
    size = np.array([len(x) for x in each])
    return fit(np.concatenate(each), np.cumsum(size) - size, size, np.array([r.good for r in rows]))


def score_documents(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", good: float = GOOD) -> DataFrame:
    """(id_col, n_lines, n_bad_lines, score, predicted), one row for each input row, without a shuffle.

    ``score`` is the mean probability of good of the text's lines, weighted by their bytes; ``predicted`` is 1 from ``good`` on.
    A null text counts as empty, which is one empty line of weight 1. Every line of every text counts; rows of one id are
    rows of their own; other columns are neither used nor carried. A task holds a batch of texts of 4 MiB, or one longer
    text, with some 60 bytes a byte of it.
    """
    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    schema = f"id {kind}, n_lines long, n_bad_lines long, score double, predicted int"
    return rows.mapInArrow(lambda batches: _score(batches, weights, good), schema).withColumnRenamed("id", id_col)
