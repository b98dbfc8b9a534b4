"""Operators on documents against brute force, on small tables with nulls, empty texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

from folioflow.llm import byte_bpe, license_scan, line_dedup, mixing, mpeg_audio, near_dedup, phrase_dedup, quality_rules, queries
from folioflow.llm import token_counts
from folioflow.llm.common import shared_folder

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, lang string, source string, n_chars long, gone string"


def made_rows():
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdeé"), rng.integers(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    rows = [(i, "\n".join(text(30) for _ in range(4)), "en", f"s{i % 3}") for i in range(40)]
    base = rows[0][1]
    near = base.split(" ")
    near[17] = "changed"
    passage = text(25)
    rows += [(100 + i, base, "en", "s0") for i in range(5)]
    rows += [(110, " ".join(near), "en", "s1"), (111, text(20) + " " + passage + " " + text(9), "en", None), (112, passage + "\n" + text(30), "de", "s2")]
    rows += [(120, None, "en", "s0"), (121, "", None, "s1"), (122, " \n\t ", "en", "s1"), (123, "ein paar worte", "de", "s2"), (123, "ein paar worte", "de", "s2")]
    rows += [(None, base, "en", "s0"), (124, "ab " * 400, "en", "s1"), (125, "x" * 5000, "en", "s1"), (126, "\n".join(["gleiche zeile hier"] * 9), "en", "s2")]
    rows += [(127, text(6000), "en", "s2"), (128, "# * $ % & | < > " + text(20) + "😀", "en", "s2"), (-5, passage, "en", "s0"), (129, "it's 1234 I'll  go\r\n\n ..", "en", "s0")]
    return [(*r, len(r[1]) if r[1] is not None else None, "clash") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return made_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(3)


def same(got, expected):
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_phrase_dedup(docs, rows, monkeypatch):
    first: dict[bytes, int] = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49 if i is not None else 0):
            first[b[s : s + 50]] = min(i, first.get(b[s : s + 50], i))
    expected = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49 if i is not None else 0):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        expected.append((i, len(b), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    for size, hot in ((phrase_dedup.BATCH_BYTES, phrase_dedup.HOT), (20_000, phrase_dedup.HOT), (20_000, 2)):
        monkeypatch.setattr(phrase_dedup, "HOT", hot)  # with 2, most shared triggers are hot
        found = phrase_dedup.phrase_dedup(docs, batch_bytes=size).collect()
        same([(r.doc_id, r.n_bytes, [tuple(s) for s in r.removed], bytes(r.kept)) for r in found], expected)
    assert phrase_dedup.phrase_dedup(docs.limit(0)).count() == 0


def test_phrase_dedup_sorts_a_bucket_by_phrase():
    """Masks of a bucket are those of brute force, for less than it takes to sort the bucket's strings one by one."""
    rng = np.random.default_rng(3)
    texts = [rng.choice(np.frombuffer(b"ab cd", np.uint8), 1200).tobytes() for _ in range(400)]
    for i in range(100, 400):  # passages of earlier documents, next to other bytes each time
        a, n = int(rng.integers(0, 600)), int(rng.integers(20, 300))
        texts[i] = texts[i][:a] + texts[int(rng.integers(0, 100))][a : a + n] + texts[i][a + n :]
    texts[399], bits = texts[7], 40
    sent = []
    for b in range(2):
        ids = list(range(b, len(texts), 2))
        packed = [zstandard.compress(texts[i]) for i in ids]
        batch = pa.table({"b": pa.array([b] * len(ids), pa.int32()), "id": ids, "z": pa.array(packed, pa.binary())})
        triggers = phrase_dedup.send_triggers(batch, bits)
        shared = pa.table({"h": triggers["h"], "kind": pa.array([phrase_dedup.SEVERAL] * len(triggers), pa.int32())})
        sent.append(phrase_dedup.send_phrases(batch, shared, 1, bits))
    bucket = pa.concat_tables(sent)
    first: dict[bytes, int] = {}
    held = bucket.select(["b", "key", "doc", "n", "raw"]).to_pylist()
    for r in held:
        for o in range(r["n"]):
            string = r["raw"][o : o + 50]
            first[string] = min(r["doc"], first.get(string, r["doc"]))
    expected = {(r["b"], r["key"]): sum((first[r["raw"][o : o + 50]] < r["doc"]) << o for o in range(r["n"])) for r in held}
    assert len({m for m in expected.values() if m}) > 100
    spent = []
    for _ in range(3):
        began = time.thread_time()
        masks = phrase_dedup._masks(bucket)
        spent.append(time.thread_time() - began)
    got = {(r["b"], r["key"]): r["mask"] for r in masks.to_pylist()}
    assert got == {k: m for k, m in expected.items() if m}
    strings = np.frombuffer(b"".join(r["raw"][o : o + 50] + bytes(6) for r in held for o in range(r["n"])), ">u8").reshape(-1, 7)
    columns = strings.astype(np.uint64).T[::-1].copy()
    began = time.thread_time()
    np.lexsort(columns)
    assert min(spent) < time.thread_time() - began


def test_phrase_dedup_counts_phrases_of_a_trigger():
    """What a bucket holds of a trigger are its phrases, however often a batch has each."""
    rng = np.random.default_rng(5)
    passage, *others = (rng.choice(np.frombuffer(b"ab cd", np.uint8), 90).tobytes() for _ in range(61))
    texts = [passage] * 30 + [x + passage for x in others[:30]] + others
    batch = pa.table({"b": pa.array([0] * len(texts), pa.int32()), "id": list(range(len(texts))), "z": [zstandard.compress(t) for t in texts]})
    p = phrase_dedup.parse(texts, [True] * len(texts))
    phrases = defaultdict(Counter)
    for first, n, trigger in zip(p.first.tolist(), p.count.tolist(), p.trigger.tolist(), strict=True):
        phrases[trigger >> 24][p.data[first : first + n + 49].tobytes()] += 1
    triggers = phrase_dedup.send_triggers(batch, 40).to_pylist()
    assert {r["h"]: r["n"] for r in triggers} == {h: len(x) for h, x in phrases.items()}
    assert max(max(x.values()) for x in phrases.values()) >= 60 and max(map(len, phrases.values())) > 10


def shingle_counts(text):
    w = WORDS.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def probability_jaccard(x, y):
    a, b = ({k: 1 + math.log2(n) for k, n in c.items()} for c in (x, y))
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a | b) for d in a.keys() & b.keys())


def similar(x, y):
    if not x or not y or not x.keys() & y.keys():
        return False
    if len(x.keys() & y.keys()) >= 0.8 * len(x.keys() | y.keys()):
        return True
    return max([*x.values(), *y.values()]) > 1 and probability_jaccard(x, y) >= 0.8


def near_classes(rows):
    sets = [(i, shingle_counts(t)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and similar(x, y):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(sets)):
        groups[find(k)].append(k)
    return [(sets[k][0], min(sets[m][0] for m in g) if sets[k][0] is not None else None, len(g)) for g in groups.values() for k in g]


def test_near_classes(docs, rows, monkeypatch):
    expected = near_classes(rows)
    same([tuple(r) for r in near_dedup.near_classes(docs).collect()], expected)
    kept = near_dedup.keep_first(docs).collect()
    same([r.doc_id for r in kept], [i for i, c, _ in expected if i == c])
    assert kept[0].gone == "clash"
    assert near_dedup.near_classes(docs.limit(0)).count() == 0
    # buckets left to the comparison in blocks alone
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "HUB_ROUNDS", 1)
    same([tuple(r) for r in near_dedup.near_classes(docs).collect()], expected)


def test_near_classes_of_string_ids(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [("b", " ".join(words)), ("a", " ".join([*words, "more"])), ("c", "other words here " * 9), ("10", " ".join(words)), ("9", None)]
    found = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    same([tuple(r) for r in found], near_classes(rows))


def unequal_rows():
    """Pairs near by their sets alone, by their weighted shingles alone, and by neither."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 7))
    rows = []
    for i in range(6):
        words = [word() for _ in range(200)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + words[20:60] * 1000))]
    for i in range(6, 12):
        same_, own, more = ([word() for _ in range(n)] for n in (60, 20, 20))
        rows += [(2 * i, " ".join(same_ * 500 + own)), (2 * i + 1, " ".join(same_ * 500 + more))]
    for i in range(12, 15):
        same_, own, more = ([word() for _ in range(n)] for n in (60, 20, 20))
        rows += [(2 * i, " ".join(same_ * 2 + own)), (2 * i + 1, " ".join(same_ * 2 + more))]
    return rows


def test_near_classes_of_unequal_repetition(spark, monkeypatch):
    rows = unequal_rows()
    expected = near_classes(rows)
    assert [n for *_, n in sorted(expected)] == [2] * 24 + [1] * 6
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same([tuple(r) for r in near_dedup.near_classes(docs).collect()], expected)
    monkeypatch.setattr(near_dedup, "HUB_ROUNDS", 1)
    same([tuple(r) for r in near_dedup.near_classes(docs).collect()], expected)


def test_block_links():
    texts = [t.encode() for _, t in unequal_rows()]
    pack = zstandard.ZstdCompressor().compress
    n = len(texts)
    found = near_dedup._block_links(pa.table({"id": range(n), "label": range(n), "side": [0] * n, "z": [pack(t) for t in texts]}), 5, 0.8)
    counts = [shingle_counts(t.decode()) for t in texts]
    assert {frozenset(p) for p in zip(*found.to_pydict().values())} == {frozenset((i, j)) for i in range(n) for j in range(i) if similar(counts[i], counts[j])}


def test_sketches_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    key = rng.integers(1, 2**63, 600).astype(np.uint64)
    both = np.concatenate([key[:400], key[100:]])
    doc = np.repeat([0, 1], [400, 500])
    weight = np.concatenate([np.full(400, 1.0), np.full(500, 1.0)])
    w = near_dedup.sketch(both, doc, weight, 2, 4096)
    assert abs((w[0] == w[1]).mean() - 300 / 600) < 0.04
    x = {int(k): 1.0 + (n % 3) for n, k in enumerate(key[:400])}
    y = {int(k): 1.0 + (n % 2) for n, k in enumerate(key[100:])}
    exact = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x | y) for d in x.keys() & y.keys())
    w = near_dedup.sketch(both, doc, np.array([*x.values(), *y.values()]), 2, 4096)
    assert abs((w[0] == w[1]).mean() - exact) < 0.04


def line_deduped(rows):
    """(id, lines, removed lines, text) of each row."""
    by_id = defaultdict(list)
    for i, t, *_ in rows:
        by_id[i].append(t or "")
    lines = {i: [(p, s) for p, s in enumerate(ts[0].split("\n")) if WORDS.search(s)] for i, ts in by_id.items() if i is not None}
    seen, gone = set(), defaultdict(set)
    for i in sorted(lines):
        for k in range(len(lines[i]) - 2):
            window = tuple(s for _, s in lines[i][k : k + 3])
            if window in seen:
                gone[i] |= {p for p, _ in lines[i][k : k + 3]}
            seen.add(window)
    out = []
    for i, t, *_ in rows:
        every = (t or "").split("\n")
        out.append((i, len([s for s in every if WORDS.search(s)]), len(gone[i]) if i is not None else 0, "\n".join(s for p, s in enumerate(every) if i is None or p not in gone[i])))
    return out


def test_line_dedup(docs, rows):
    found = line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_removed_lines", "text").collect()
    same([tuple(r) for r in found], line_deduped(rows))
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def base_counts(t):
    w = WORDS.findall(t or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = {x for x in windows if windows.count(x) > 1} if len(windows) < 2000 else set()
    covered = {p for i, x in enumerate(windows) if x in twice for p in range(i, i + 8)}
    lines = [s for s in (t or "").split("\n") if WORDS.search(s)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, rows):
    found = quality_rules.quality(docs).collect()
    same(
        [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found],
        [(r[0], *(c := base_counts(r[1])), c[0] < 20 or 100 * c[4] > 30 * c[0]) for r in rows],
    )
    kept = quality_rules.keep_good(docs).collect()
    same([r.doc_id for r in kept], [r.doc_id for r in found if r.kept])
    assert quality_rules.quality(docs.limit(0)).count() == 0 == quality_rules.keep_good(docs.limit(0)).count()


def test_hosts(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good if i % 10 else "kurz", "fine") for i in range(100)] + [(200 + i, "kurz" if i % 10 else good, "bad") for i in range(100)]
    rows += [(300 + i, good, f"h{i}") for i in range(30)] + [(400, "kurz", "new"), (401, good, None)]
    kept = {r.doc_id for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("kept").collect()}
    assert kept == {r[0] for r in rows if r[1] == good and r[2] != "bad"}


def test_byte_bpe(docs, rows):
    own = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=byte_bpe.read_ranks(queries.RANKS), special_tokens={})
    found = byte_bpe.encode(docs, queries.RANKS, queries.PATTERN, decoded=True).collect()
    encoded = byte_bpe.encode(docs, queries.RANKS, queries.PATTERN)
    same([tuple(r) for r in byte_bpe.decode(encoded, queries.RANKS, queries.PATTERN).collect()], [tuple(r) for r in found])
    expected = []
    for i, t, *_ in rows:
        ids = own.encode_ordinary(t or "")
        expected.append((i, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()))
    same([(r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in found], expected)


def test_token_counts(spark, docs, rows):
    folder = shared_folder(spark, "tokens")
    written = token_counts.write_flat(docs, folder, queries.RANKS, queries.PATTERN, queries.END_OF_DOCUMENT)
    own = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=byte_bpe.read_ranks(queries.RANKS), special_tokens={})
    for block in (token_counts.BLOCK_TOKENS, 7):
        counted = token_counts.count_tokens(spark, folder, queries.END_OF_DOCUMENT, block_tokens=block)
        found = counted.join(written, ["file", "doc"], "full").collect()
        assert all(r.closed for r in found)
        same([(r.doc_id, r.n_tokens) for r in found], [(r[0], len(own.encode_ordinary(r[1] or ""))) for r in rows])


def test_flat_files_that_end_open(spark, tmp_path):
    np.array([1, 2, 9, 9, 3, 4, 5], "<u2").tofile(tmp_path / "a.bin")
    np.array([9], "<u2").tofile(tmp_path / "b.bin")
    (tmp_path / "c.bin").write_bytes(b"")
    for block in (1, 2, 3, 100):
        found = token_counts.count_tokens(spark, f"file://{tmp_path}", 9, block_tokens=block).collect()
        same([tuple(r) for r in found], [("a.bin", 0, 0, 2, True), ("a.bin", 1, 3, 0, True), ("a.bin", 2, 4, 3, False), ("b.bin", 0, 0, 0, True)])


def test_mixing(spark):
    weights = {"a": 5, "b": 3, None: 2}
    spread = lambda n: (n * 0x9E3779B97F4A7C15 + 11) % 2**64 - 2**63  # ids as hashes give them
    names = ["a"] * 2600 + ["b"] * 1500 + [None] * 1000 + ["c"] * 200 + ["d"] * 150 + ["e"] * 140
    rows = [(spread(n), s) for n, s in enumerate(names)] + [(None, "c"), (3, "c"), (3, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, source string").withColumn("slot", F.lit("clash"))
    for large, full in ((mixing.LARGE, mixing.FULL), (500, mixing.FULL), (500, 1)):
        found = mixing.mix_sources(docs, weights, block=4, large=large, full=full).collect()
        same([(r.doc_id, r.source) for r in found], rows)
        slot_of = {(r.source, r.block): r.slot for r in found}
        assert len(set(slot_of.values())) == len(slot_of) and all(r.release <= r.slot < r.deadline for r in found)
        ends = [max(v for (x, _), v in slot_of.items() if x == s) for s in "abcde"]
        for s, share in {"a": 5 / 11, "b": 3 / 11, None: 2 / 11, "c": 1 / 33, "d": 1 / 33, "e": 1 / 33}.items():
            slots = sorted(v for (x, _), v in slot_of.items() if x == s)
            assert all(abs(sum(v < t for v in slots) - t * share) < 1 for t in range(min(ends)))
            order = [r for r in sorted((r for r in found if r.source == s), key=lambda r: (r.block, r.doc_id is not None, r.doc_id or 0))]
            assert [-(2**64) if r.doc_id is None else r.doc_id for r in order] == sorted(-(2**64) if r.doc_id is None else r.doc_id for r in order)
    assert mixing.mix_sources(docs.limit(0), weights).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"a": 0})


def test_mixing_of_equal_and_missing_ids(spark):
    ids = [None] * 900 + [7] * 1200 + list(range(700)) + [5] * 3
    docs = spark.createDataFrame([(i, "a", str(n)) for n, i in enumerate(ids)], "doc_id long, source string, text string")
    whole, dealt = (
        sorted((r.slot, r.block, r.text) for r in mixing.mix_sources(docs, {"a": 2}, block=4, large=large, full=2).collect())
        for large in (mixing.LARGE, 100)
    )
    assert dealt == whole and len(dealt) == len(ids)
    order = [-1 if ids[int(t)] is None else ids[int(t)] for _, _, t in sorted(dealt, key=lambda r: (r[1], ids[int(r[2])] or -1))]
    assert order == sorted(order)


def test_mixing_ranges_split_equal_and_missing_ids(spark):
    bounds = [10 if i < 6 else 10 * i for i in range(15)]  # the id 10 is six of sixteen bounds
    rows = [(v, h) for v in (None, 3, 10, 65, 1000) for h in range(-(2**63), 2**63, 2**57 - 1)]
    made = spark.createDataFrame(rows, "v long, h long").withColumn("bounds", F.array(*map(F.lit, bounds)))
    found = made.withColumn("range", mixing._range(F.col("bounds"), F.col("v"), F.col("h"), 16)).collect()
    ordered = sorted(found, key=lambda r: (r.v is not None, r.v or 0, r.h))
    places = [tuple(r.range) for r in ordered]
    assert places == sorted(places)
    n = {v: len({tuple(r.range) for r in found if r.v == v}) for v in (None, 3, 10, 65, 1000)}
    assert n[None] > 100 and n[10] > 100 and n[3] == n[65] == n[1000] == 1


def test_mixing_of_very_many_sources(spark, monkeypatch):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("host"), F.col("id") % 25_000).alias("source"))
    for most in (mixing.BROADCAST, 0):
        monkeypatch.setattr(mixing, "BROADCAST", most)
        found = mixing.mix_sources(docs, {"host7": 3}, 2, block=1).agg(F.count("slot"), F.count_distinct("slot"), F.count_distinct("source")).first()
        assert tuple(found) == (60_000, 60_000, 25_000)


def test_license_scan(spark):
    rng = np.random.default_rng(3)
    plain = lambda: " ".join("".join(rng.choice(list("aeiounrst"), rng.integers(2, 9))) for _ in range(40))
    licences = {1: "This software is released under the MIT License.", 2: "Licensed under the Apache License, Version 2.0 (the \"License\")", 3: "This work is licensed under the GNU General Public License, version 3."}
    rows = [(i, plain() + "\n" + plain()) for i in range(10, 200)] + [(i, plain() + "\n" + x) for i, x in licences.items()] + [(4, None), (5, ""), (6, "The licence plate of the car was dirty"), (None, licences[1]), (1, licences[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = license_scan.license_scan(docs).collect()
    assert len(found) == len(rows)
    families = {(r.doc_id, tuple(r.families)) for r in found if r.families}
    assert families == {(1, ("mit",)), (2, ("apache",)), (3, ("gpl",)), (None, ("mit",))}
    assert {r.doc_id: r.n_paragraphs for r in found if r.doc_id in (4, 5, 6)} == {4: 0, 5: 0, 6: 1}
    assert license_scan.license_scan(docs.limit(0)).count() == 0


# wordings and licences that neither the templates nor the names in training have
HELD_OUT = {
    "apache": ["We publish all of this under Apache License 2.0", "Code in this folder is Apache-2.0 licensed; the Apache License applies.", "Portions Copyright 2019, available under the Apache License, Version 2.0"],
    "bsd": ["The library comes with a BSD 3-Clause License", "Covered by the terms of the BSD License found in the root folder"],
    "cc-by": ["Text and pictures: Creative Commons Attribution 4.0 International (CC BY 4.0)"],
    "cc-by-nc": ["Pictures: Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Articles are shared under the Creative Commons Attribution-ShareAlike 4.0 License"],
    "gpl": ["You can use it under GNU General Public License version 3 or later", "The kernel module is under the GNU General Public License v2"],
    "lgpl": ["Linking is allowed by the GNU Lesser General Public License, version 2.1"],
    "mit": ["distributed under terms of the MIT licence, see COPYING", "Everything here has the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"],
    "mpl": ["Source files carry the Mozilla Public License, v. 2.0"],
    "public-domain": ["The author waives all rights, CC0 1.0 Universal applies"],
}
FOREIGN = [
    "Sleepycat License", "Licensed under the Academic Free License version 3.0", "Common Public Attribution License Version 1.0", "Open Software License v. 3.0",
    "This file is covered by the Eclipse Public License v 2.0", "IBM Public License Version 1.0", "The licence plate of the car was dirty", "He lost his driving licence in the city",
    "A public hearing about the version of the law", "GNU Affero General Public License version 3", "Server Side Public License, version 1",
]


def test_licences_in_held_out_wordings(spark):
    rng = np.random.default_rng(4)
    plain = lambda: " ".join("".join(rng.choice(list("aeiounrst"), rng.integers(2, 9))) for _ in range(40))
    truth = [(f, t) for f, ts in HELD_OUT.items() for t in ts] + [("", t) for t in FOREIGN]
    rows = [(i, f"{plain()}\n\n{t}\n\n{plain()}", f) for i, (_, t) in enumerate(truth) for f in ["clash"]] + [(1000 + i, plain(), "x") for i in range(150)] + [(2000, "mit " * 200_000, "x")]
    found = {r.doc_id: r.families for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string, families string")).collect()}
    hit = sum(f in found[i] for i, (f, _) in enumerate(truth) if f)
    wrong = [(truth[i] if i < 1000 else i, x) for i, fs in found.items() for x in fs if i >= len(truth) or truth[i][0] != x]
    print(f"recall {hit / sum(bool(f) for f, _ in truth):.2f}, precision {hit / (hit + len(wrong)):.2f}, wrong {wrong}", [(t, found[i]) for i, (f, t) in enumerate(truth) if f and f not in found[i]])
    assert hit >= 0.8 * sum(bool(f) for f, _ in truth) and hit >= 0.9 * (hit + len(wrong))


# Sentences in the corpus's languages, mostly in other wordings than the module's; some of its names and phrases are in them.
IN_FOUR_LANGUAGES = {
    "apache": ["Der Quelltext steht unter der Apache-Lizenz, Version 2.0.", "Sous licence Apache 2.0", "Este código usa la licencia Apache 2.0", "Apache-2.0 applies to all of these files"],
    "bsd": ["Veröffentlicht unter einer BSD-Lizenz", "Ce module est distribué sous la licence BSD", "BSD-3-Clause, see the file COPYRIGHT"],
    "cc-by": ["Alle Texte: CC BY 4.0", "Contenido bajo CC BY 4.0"],
    "cc-by-nc": ["Les images sont sous CC BY-NC 4.0", "Fotos: CC BY-NC 3.0"],
    "cc-by-sa": ["Der Artikel steht unter CC BY-SA 4.0", "Texte disponible sous licence CC BY-SA"],
    "gpl": ["You can copy this under GPLv3 or later.", "Dieses Programm ist freie Software unter der GPLv2", "Logiciel libre, licence GNU GPL version 3", "Software libre bajo GPL-3.0-or-later"],
    "lgpl": ["Die Bibliothek steht unter der LGPL, Version 2.1", "Bibliothèque sous LGPLv3"],
    "mit": ["This file is part of Foo, licensed MIT.", "Lizenziert unter der MIT-Lizenz.", "Publié sous licence MIT", "Con licencia MIT", "Our code is MIT licensed"],
    "mpl": ["Unter der MPL 2.0 lizenziert", "Código bajo la Mozilla Public License 2.0", "MPL-2.0 for everything in src"],
    "public-domain": ["Creative Commons Zero v1.0", "Gemeinfrei unter CC0", "Dedicated to the public domain (CC0-1.0)"],
}
NO_LICENCE = [
    "Er fährt mit Lizenz und ohne Führerschein", "Verkauf nur mit Lizenz der Stadt", "Boost-Lizenz", "AGPLv3 or later", "Licencia de conducir para todos", "La licence de pêche coûte peu",
    "mit der Zeit kommt der Rat", "Lizenz zum Töten", "Sous licence EUPL", "the apache helicopter flew over the city", "a licence to sell beer", "GFDL 1.3", "WTFPL",
    "She studied at MIT and later worked under a general", "a clause of the law that the public may read",
]


def test_licences_in_four_languages(spark):
    rng = np.random.default_rng(5)
    plain = lambda: " ".join("".join(rng.choice(list("aeiounrst"), rng.integers(2, 9))) for _ in range(40))
    german = lambda: " ".join(rng.choice(["mit", "der", "die", "und", "unter", "ein", "heit", "lich"], 30))
    truth = [(f, t) for f, ts in IN_FOUR_LANGUAGES.items() for t in ts] + [("", t) for t in NO_LICENCE]
    rows = [(i, f"{plain()}\n\n{t}\n\n{german()}") for i, (_, t) in enumerate(truth)] + [(1000 + i, f"{plain()}\n{german()}") for i in range(150)]
    found = {r.doc_id: r.families for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = {f: sum(f in found[i] for i, (g, _) in enumerate(truth) if g == f) / len(ts) for f, ts in IN_FOUR_LANGUAGES.items()}
    wrong = [(truth[i] if i < 1000 else i, x) for i, fs in found.items() for x in fs if i >= len(truth) or truth[i][0] != x]
    print(recall, wrong, [(t, found[i]) for i, (f, t) in enumerate(truth) if f and f not in found[i]])
    assert sum(recall[f] * len(ts) for f, ts in IN_FOUR_LANGUAGES.items()) >= 0.9 * sum(map(len, IN_FOUR_LANGUAGES.values()))
    assert not wrong


def test_media_columns(spark, docs, rows):
    media = mpeg_audio.carry_bytes(docs)
    found = mpeg_audio.scan_media(media.select(F.struct("doc_id", "n_bytes").alias("k"), "media"), id_col="k").select("k.*", "payload", "media", "n_frames", "crc_bad", "resync_bytes").collect()
    expected = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        expected.append((i, len(raw), raw + bytes(-len(raw) % 64 if raw else 64), 0, 0))
    same([(r.doc_id, r.n_bytes, bytes(r.payload), r.crc_bad, r.resync_bytes) for r in found], expected)
    stream = bytes(next(r for r in found if r.doc_id == 127).media)
    whole = mpeg_audio.scan(stream)
    broken = mpeg_audio.scan(b"junk" + stream[:2000] + b"\xff\xfbxx" + stream[2000:])
    assert broken["resync_bytes"] > 0 and len(broken["offsets"]) >= len(whole["offsets"]) - 3
    for junk in (b"", b"\xff" * 500, b"ID3", b"TAG" + bytes(125), hashlib.sha512(b"x").digest() * 9):
        assert mpeg_audio.scan(junk)["n_samples"] >= 0


def walked(data, at, end):
    """(offset, samples, checksum holds) of each frame of a Layer I, II or III stream, read bit by bit from the standard's fields."""
    bits = lambda a, n: int("".join(f"{b:08b}" for b in data[a // 8 : (a + n + 7) // 8 + 1])[a % 8 : a % 8 + n] or "0", 2)
    out = []
    while at < end:
        p = at * 8
        assert bits(p, 11) == 2047
        version, layer, unprotected = bits(p + 11, 2), 4 - bits(p + 13, 2), bits(p + 15, 1)
        kbits = mpeg_audio.KBITS[1 if version == 3 else 2, layer][bits(p + 16, 4) - 1]
        hz = mpeg_audio.RATES[version][bits(p + 20, 2)]
        pad, mode, extension = bits(p + 22, 1), bits(p + 24, 2), bits(p + 26, 2)
        samples = {1: 384, 2: 1152, 3: 1152 if version == 3 else 576}[layer]
        size = (12000 * kbits // hz + pad) * 4 if layer == 1 else samples * 125 * kbits // hz + pad
        good = None
        if not unprotected:
            channels, bound = 1 if mode == 3 else 2, 4 * (extension + 1) if mode == 1 else 32
            q = p + 48
            if layer == 1:
                covered = 4 * sum(channels if band < bound else 1 for band in range(32))
            elif layer == 3:
                covered = 8 * {(3, 3): 17, (3, 0): 32, (2, 3): 9, (2, 0): 17}[version, 3 if mode == 3 else 0]
            else:  # the frames made here are of 44.1 kHz with 96 kbit/s and more a channel
                covered, chosen = 0, 0
                for band in range(30):
                    n = 4 if band < 11 else 3 if band < 23 else 2
                    for _ in range(channels if band < bound else 1):
                        chosen += (bits(q + covered, n) > 0) * (1 if band < bound else channels)
                        covered += n
                covered += 2 * chosen
            crc = 0xFFFF
            for i in [*range(p + 16, p + 32), *range(q, q + covered)]:
                crc = (crc << 1 & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ bits(i, 1) else 0)
            good = crc == bits(p + 32, 16)
        out.append((at, samples, good))
        at += size
    return out


def made_frame(rng, layer, version=3, kbits=9, mode=0, extension=0, protected=True, pad=0):
    word = 0x7FF << 21 | version << 19 | (4 - layer) << 17 | (not protected) << 16 | kbits << 12 | pad << 9 | mode << 6 | extension << 4
    head = word.to_bytes(4, "big")
    size, h = mpeg_audio.header(head)[0], mpeg_audio.header(head)
    body = bytearray(rng.integers(0, 256, size - 4).astype(np.uint8).tobytes().replace(b"\xff", b"\x7f"))
    if protected and layer == 2:
        body[:2] = mpeg_audio._crc16_bits(mpeg_audio._layer2_bits(head + bytes(body), h)).to_bytes(2, "big")
    elif protected:
        channels, bound = 1 if mode == 3 else 2, 4 * (extension + 1) if mode == 1 else 32
        span = mpeg_audio.SIDE[h[3], mode == 3] if layer == 3 else sum(channels if b < bound else 1 for b in range(32)) // 2
        body[:2] = mpeg_audio.crc16(head[2:] + bytes(body[2 : 2 + span])).to_bytes(2, "big")
    return head + bytes(body)


def test_streams_of_all_layers_by_a_walker():
    rng = np.random.default_rng(9)
    for layer, modes in ((1, (0, 1, 3)), (2, (0, 1, 3)), (3, (0, 3))):
        for mode in modes:
            frames = [made_frame(rng, layer, kbits=12, mode=mode, extension=i % 4, pad=i % 2) for i in range(9)]
            frames[4] = frames[4][:4] + bytes([frames[4][4] ^ 1]) + frames[4][5:]
            tag = b"TAG" + b"Title".ljust(30, b"\0") + bytes(95)
            lead = b"ID3\x03\0\0\0\0\0\x11TIT2\0\0\0\x07\0\0\0Piece\0"
            data = lead + b"".join(frames) + tag
            expected = walked(data, len(lead), len(data) - 128)
            found = mpeg_audio.scan(data)
            assert [x[0] for x in expected] == found["offsets"] and sum(x[1] for x in expected) == found["n_samples"]
            assert (found["crc_good"], found["crc_bad"]) == (8, 1) == (sum(x[2] for x in expected), sum(not x[2] for x in expected))
            assert found["tags"] == {"TIT2": "Piece", "title": "Title"} and found["resync_bytes"] == 0
            damaged = data[: expected[2][0]] + b"\0" * 33 + data[expected[2][0] :]
            again = mpeg_audio.scan(damaged)
            assert again["resync_bytes"] == 33 and len(again["offsets"]) == 9


def test_vbri_table():
    rng = np.random.default_rng(10)
    first = bytearray(made_frame(rng, 3, mode=3, protected=False))
    first[36:62] = b"VBRI" + bytes(6) + (1000).to_bytes(4, "big") + (7).to_bytes(4, "big") + bytes([0, 3, 0, 2, 0, 2, 0, 1])
    first[62:68] = bytes([0, 10, 0, 20, 0, 30])
    found = mpeg_audio.scan(bytes(first) + made_frame(rng, 3, mode=3, protected=False) * 3)
    assert found["vbr"] == {"kind": "VBRI", "frames": 7, "bytes": 1000, "toc": [20, 40, 60]} and len(found["offsets"]) == 3


def test_payload_tags_of_all_kinds():
    stream = mpeg_audio.carry(b"abc")
    own = mpeg_audio.PAYLOAD_TAG.encode()
    for value in ("²²", "-1", "", "9" * 40, "x"):
        text = b"\3" + own + b"\0" + value.encode()
        tag = b"ID3\x04\0\0\0\0" + bytes([(len(text) + 10) >> 7, (len(text) + 10) & 127]) + b"TXXX\0\0\0" + bytes([len(text), 0, 0]) + text
        at = stream.index(b"\xff\xfa")
        assert mpeg_audio.scan(tag + stream[at:])["payload"].startswith(b"abc")


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert mpeg_audio.scan_media(mpeg_audio.carry_bytes(none)).count() == 0
    assert byte_bpe.encode(none, queries.RANKS, queries.PATTERN, decoded=True).count() == 0
    folder = shared_folder(spark, "tokens")
    assert token_counts.write_flat(none, folder, queries.RANKS, queries.PATTERN, queries.END_OF_DOCUMENT).count() == 0
    assert token_counts.count_tokens(spark, folder, queries.END_OF_DOCUMENT).count() == 0
    with pytest.raises(ValueError):
        token_counts.write_flat(none, folder, queries.RANKS, queries.PATTERN, 70_000)
