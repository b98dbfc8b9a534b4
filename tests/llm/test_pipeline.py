"""Each stage of the pipeline, and the whole, against brute force on a table with nulls, empty texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
import test_text_operators as brute
import tiktoken

from folioflow.llm import byte_bpe

COLUMNS = list(corpus_pipeline.COLUMNS)
OWN = tiktoken.Encoding(
    "own", pat_str=corpus_pipeline.PATTERN, mergeable_ranks=byte_bpe.read_ranks(corpus_pipeline.RANKS), special_tokens={}
)


def quality(rows):
    failed, hosts = [], defaultdict(lambda: [0, 0])
    for r in rows:
        n, *_, repeated = brute.base_counts(r[1])
        failed.append(n < 20 or 100 * repeated > 30 * n)
        hosts[r[3]][0] += 1
        hosts[r[3]][1] += failed[-1]
    total = sum(n for n, _ in hosts.values())
    m = sum(k for _, k in hosts.values()) / max(total, 1)
    v = max(0, sum(k * k / n for n, k in hosts.values()) / max(total, 1) - m * m - m * (1 - m) * len(hosts) / max(total, 1))
    strength = min(1000, max(1, m * (1 - m) / max(v, 1e-9) - 1))
    return [r for r, bad in zip(rows, failed, strict=True) if not bad and (hosts[r[3]][1] + strength * m) / (hosts[r[3]][0] + strength) <= 0.6]


def lines(rows):
    return [(r[0], t, r[2], r[3], len(t)) for r, (_, _, _, t) in zip(rows, brute.line_deduped(rows), strict=True)]


def near(rows):
    first = defaultdict(list)
    for i, c, _ in brute.near_classes(rows):
        first[i].append(c)
    return [r for r in rows if r[0] is None or r[0] in first[r[0]]]


def slots(rows):
    """The slot of each block (source, number), slot by slot."""
    own, others = corpus_pipeline.PARTS, sorted({r[3] for r in rows} - corpus_pipeline.PARTS.keys(), key=lambda s: hashlib.md5(b"" if s is None else b"=" + s.encode()).hexdigest())
    entries = {**{s: n for s, n in own.items() if any(r[3] == s for r in rows)}, **({"": corpus_pipeline.OTHER_PARTS} if others else {})}
    total, done, out = sum(entries.values()), dict.fromkeys(entries, 0), {}
    for t in range(len(rows) * total if rows else 0):
        due, _, s = min((-(-(done[s] + 1) * total // n), s == "", s) for s, n in entries.items() if done[s] * total // n <= t)
        out[(s, done[s]) if s else (others[done[s] % len(others)], done[s] // len(others))] = t
        done[s] += 1
    return out


def mixed(rows):
    every, place = defaultdict(list), slots(rows)
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        every[r[3]].append(r)
    return [(place[s, n // 16], r[0]) for s, own in every.items() for n, r in enumerate(own)]


def tokens(rows):
    out = []
    for r in rows:
        text = r[1] or ""
        ids = OWN.encode_ordinary(text)
        out.append((r[0], len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256(text.encode()).hexdigest()))
    return out


EXPECTED = [quality, lines, near, None, tokens]


def rows_of(df):
    return [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect()]


@pytest.fixture(scope="module")
def rows():
    return brute.made_rows()


def test_stages_on_all_rows(spark, rows):
    docs = spark.createDataFrame(rows, brute.DDL).repartition(3)
    for (name, stage), expected in zip(corpus_pipeline.STAGES, EXPECTED, strict=True):
        found = stage(spark, docs, "")
        if name == "byte-level BPE":
            brute.same(rows_of(found), tokens(rows))
            continue
        assert found.columns == COLUMNS, name
        own = rows_of(found)
        brute.same(own, expected([r[:5] for r in rows]) if expected else [r[:5] for r in rows])
        assert stage(spark, docs.limit(0), "").count() == 0, name


def test_mix_in_order(spark, rows):
    found = rows_of(corpus_pipeline.mix(spark, spark.createDataFrame(rows, brute.DDL).repartition(3), ""))
    order = [i for _, i in sorted(mixed(rows), key=lambda x: (x[0], x[1] is not None, x[1] or 0))]
    assert [r[0] for r in found] == order


def test_whole(spark, rows, tmp_path):
    spark.createDataFrame(rows, brute.DDL).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [r[:5] for r in rows]
    for stage in (quality, lines, near):
        kept = stage(kept)
    brute.same(rows_of(corpus_pipeline.run(spark, str(tmp_path))), tokens(kept))
    assert 40 < len(kept) < len(rows)
