"""Operators around models, with functions of known results."""

from __future__ import annotations

import pytest

from folioflow.operators import models


def test_embed(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id long, text string")
    found = {r.id: list(r.vector) for r in models.embed(rows, "text", lambda texts: [[float(len(t)), 1.0] for t in texts], 2).collect()}
    assert found == {1: [2.0, 1.0], 2: [0.0, 1.0], 3: [0.0, 1.0]}
    with pytest.raises(Exception, match="one vector of 3 numbers"):
        models.embed(rows, "text", lambda texts: [[1.0, 1.0] for _ in texts], 3).collect()


def test_judge(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "b"), (3, None)], "rank int, text string")
    by_rank = lambda judge: {r.rank: r.judged for r in models.judge(rows, "a b", "text", judge).collect()}
    assert by_rank(models.shared_words) == {1: 1.0, 2: 0.5, 3: 0.0}
    assert by_rank(None) == {1: -1.0, 2: -2.0, 3: -3.0}
    assert by_rank(lambda q, t: [float("nan")] * len(t)) == {1: -1.0, 2: -2.0, 3: -3.0}
    assert by_rank(lambda q, t: [float("nan") if not x else 7.0 for x in t]) == {1: 7.0, 2: 7.0, 3: 0.0}


def test_corrections_with_topics(spark):
    import json

    text = "Das ist ein ganzer Absatz, der etwas sagt.\n\nUnd das ist noch einer, der mehr sagt."
    good = {"text": text.replace("ganzer", "guter"), "topics": [{"title": "B", "start": 60, "end": 61}, {"title": "A", "start": 5, "end": 7}, {"start": 3}]}
    given = {
        "json": json.dumps(good), "plain": text, "empty": "", "short": "Nur das.", "other": json.dumps({"text": text[::-1], "topics": "none"}), "null": None, "broken": '{"text": "x',
    }
    rows = spark.createDataFrame([(k, f"{text}" if k != "null" else None, 50.0, 150.0) for k in given], "k string, text string, start double, end double")
    answers = list(given.values())  # seven rows are one batch
    found = {r.k: r for r in models.correct(rows.coalesce(1), lambda texts: answers).collect()}
    assert found["json"].corrected == good["text"] and not found["json"].discarded
    assert [(t.title, t.start, t.end) for t in found["json"].topics] == [("A", 50, 60), ("B", 60, 150)]
    assert [p.text for p in found["json"].paragraphs] == good["text"].split("\n\n") and found["json"].paragraphs[1].end == 150
    assert found["plain"].corrected == text and found["plain"].topics == []
    assert {k: found[k].reason for k in ("empty", "short", "other", "broken")} == {"empty": "empty", "short": "length", "other": "similarity", "broken": "length"}
    assert found["short"].similarity is None and all(found[k].corrected == text for k in ("empty", "short", "other"))


def test_similarity_of_many_pairs_is_that_of_difflib():
    """Batches of pairs, groups that are halved and pairs left to difflib give the ratios of difflib, and in less of a second."""
    import random
    import time
    from difflib import SequenceMatcher

    from folioflow.operators.alike import ratios

    rng, pairs = random.Random(7), [("", ""), ("", "a"), ("a", ""), ("ab", "ab"), ("a" * 300, "a" * 299), ("😀é😀é", "é😀é")]
    for alphabet in ("ab", "abcä😀", "abcdefghijklmnopqrstuvwxyz") * 200:
        a, b = ("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(2))
        pairs += [(a, b), (a, a[::-1]), (a, a[7:] + a[:5])]
    exact = [1.0 if a == b else SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs]
    assert ratios(pairs) == ratios(pairs, 500, 300) == ratios(pairs, 5000, 40) == exact
    long = ["".join(rng.choice("enisratdhulcgmobwfkzpvjyxq"[: rng.randrange(8, 27)]) for _ in range(400)) for _ in range(300)]
    start = time.perf_counter()
    assert len(ratios([(x, x[::-1]) for x in long])) == 300
    mine, start = time.perf_counter() - start, time.perf_counter()
    for x in long[:60]:
        SequenceMatcher(None, x, x[::-1], autojunk=False).ratio()
    assert mine / 300 < (time.perf_counter() - start) / 60 / 2


def test_a_model_gets_a_bounded_number_of_bytes_at_a_time(spark):
    def most(texts: list[str]) -> list[list[float]]:
        return [[float(sum(map(len, texts)))]] * len(texts)

    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('ab', 1000) AS t")
    sums = models.embed(rows, "t", most, 1).selectExpr("max(vector[0])", "count(vector)").first()
    assert sums[0] <= 1 << 20 and sums[1] == 3000
