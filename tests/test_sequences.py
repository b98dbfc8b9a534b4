"""Sequences at sizes and shapes that the tables don't have: numbers of hot works, long blocks, odd sentences, white space."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as t
from folioflow.operators import intervals, splitter
from folioflow.operators import sequences as q
from folioflow.plans import catalog

SF = "/root/testdata/sf0.001"


def test_numbers_of_works(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 > 0, F.col("id").cast("string")).alias("work_id"), ((F.col("id") * 7919) % 20_011).alias("x"))
    found = q.numbered(rows, "work_id", "x").collect()
    works: dict = {}
    for r in found:
        works.setdefault(r.work_id, []).append((r.x, r.ordinal))
    assert len(found) == 20_000 and len(works["hot"]) == 18_000 and len(works[None]) == 1000
    assert all([n for _, n in sorted(w)] == list(range(1, len(w) + 1)) for w in works.values())
    assert q.numbered(rows.limit(0), "work_id", "x").count() == 0


@pytest.mark.parametrize("name", ["str_heads", "search_context", "seq_split"])
def test_no_window_carries_texts(spark, name):
    """Texts are joined to numbers; no window and no sort for one has them."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("\n"):
        assert not ("Window" in line and re.search(r"\btext#", line))


def test_long_works(spark):
    """A row of 100,000 lines shared out, and a work of as many lines held against its blocks."""
    lines = ["x" * (i % 7) for i in range(100_000)]
    row = spark.createDataFrame([(lines,)], "l array<string>").select(q.share_out(F.col("l"), F.lit(0.0), F.lit(300_000.0)).alias("p"))
    found = row.selectExpr("p[0]", "p[50000]", "p[99999]").first()
    total = sum(map(len, lines))
    assert found[0].start == 0 and found[2].end == 300_000
    assert found[1].start == pytest.approx(300_000 * sum(map(len, lines[:50_000])) / total)

    each = spark.range(100_000).select(F.lit(1).alias("work_id"), F.floor(F.col("id") / 4).alias("block"), F.col("id").cast("double").alias("start"), (F.col("id") + 1.0).alias("end"), F.col("id").cast("string").alias("text"))
    met = intervals.compare_blocks(each, each.select("work_id", "start", "end", "text"))
    assert met.count() == 25_000
    assert met.where("block = 777").first().raw == " ".join(str(i) for i in range(3108, 3112))


def sentence_by_sentence(text):
    """The rule said plainly: pieces between possible ends, glued where the end is none."""
    text = re.sub(f"[{splitter.WHITE}]+", " ", text).strip(" ")
    pieces = re.sub(splitter.SENTENCE_END, "\\1\0", text).split("\0")
    out, done = [], ""
    for i, p in enumerate(pieces):
        done += p
        tail = ((pieces[i - 1][-60:] + " " if i else "") + p[-60:])[-60:]
        one = re.search(rf"([^ ]+?)\.[.!?…]*[{splitter.CLOSERS}]*$", tail)
        two = re.search(rf"([^ ]+ [^ ]+?)\.[.!?…]*[{splitter.CLOSERS}]*$", tail)
        known = [m[1].lower() + "." in splitter.ABBREVIATIONS for m in (one, two) if m]
        if i < len(pieces) - 1 and (any(known) or one and re.fullmatch(r"[^\W\d_]|[0-9]{1,2}", one[1])):
            done += " "
        else:
            out.append(done)
            done = ""
    return [s for s in out if s]


def test_sentences_of_made_texts():
    rng = random.Random(8)
    parts = ["z. B.", "Dr.", "A.", "3.", "123.", "usw.", "Wort", "wort", "Ende.", "Was?", "Ja!", "„So“.", "n. Chr.", "…", "...", "(x).", "»Gut.«", ".", "u.", "a.", "Die", "12.", "\u00a0", "\n", "é.", "z.B."]
    for _ in range(3000):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert splitter.sentences(text) == sentence_by_sentence(text), text


def test_white_space(spark):
    rng = random.Random(9)
    parts = ["a", "b", " ", "  ", "\t", "\n", "\n\n", "\r\n", "\u00a0", "\u2003", "\x0b", "\u3000", "\x1c", "x y"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["", " ", "\n"]
    white = f"[{t.WHITE}]"
    strip = lambda s: re.sub(rf"\A{white}+|{white}+\Z", "", s)
    smooth = lambda s: strip(re.sub(r"\n{3,}", "\n\n", "\n".join(strip(re.sub(r"[ \t]+", " ", x)) for x in s.replace("\r\n", "\n").split("\n"))))
    found = spark.createDataFrame([(s,) for s in rows], "s string").select("s", t.strip(F.col("s")).alias("a"), t.collapse(F.col("s")).alias("b"), t.smooth_space(F.col("s")).alias("c")).collect()
    for r in found:
        assert (r.a, r.b, r.c) == (strip(r.s), re.sub(f"{white}+", " ", strip(r.s)), smooth(r.s)), repr(r.s)


def test_foreign_scripts_and_marks(spark):
    rows = {"„Тест“ — a  b": '"" - a b', "Привет мир x": " x", "naïve ― Ω…": "naïve ― Ω...", "漢字と kana": " kana", "𠀀x": "x", "a  b": "a  b", "\u00a0«q»": ' "q"'}
    found = spark.createDataFrame([(s,) for s in rows], "s string").select("s", t.clean(F.col("s")).alias("c")).collect()
    assert {r.s: r.c for r in found} == rows


def test_markdown_marks(spark):
    rows = {
        "![](a.png) [](b) [l](c)": " [](b) l", "**a *b* c** __d__ _e_": "a b c d e", "snake_case_name 2*3*4": "snake_case_name 2*3*4", "`x *y* z`": "x y z",
        "> q\n>r\n1) one\n + two": "q\nr\n- one\n- two", "| a | b |\n|---|:--:|\n| c | d |": "  a   b  \n\n  c   d  ", "---": "", "a -- b": "a -- b", "no marks": "no marks",
    }
    found = spark.createDataFrame([(s,) for s in rows], "s string").select("s", t.plain_markdown(F.col("s")).alias("p")).collect()
    assert {r.s: r.p for r in found} == rows


def test_batches_are_objects_a_few_megabytes_at_a_time(spark):
    """Slices of a batch are bounded by bytes, whatever its rows; folds over many and null rows give the same as row by row."""
    import pyarrow as pa

    from folioflow.operators.folds import fold, lists, pieces, running_ends

    texts = [["x" * n, None] if n % 5 else None for n in range(600)] + [["y" * 50_000]]
    batch = pa.array(texts)
    found = list(pieces(batch, 10_000))
    assert [row for p in found for row in lists(p)] == texts
    assert all(p.nbytes <= 10_000 or len(p) == 1 for p in found) and len(found) > 15
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "IF(id % 7 = 0, NULL, array_repeat(id, 60)) AS s")
    ends = {r[0]: r[1] for r in rows.select("id", fold(running_ends(1), "array<long>", F.col("s"))).collect()}
    assert ends == {i: None if i % 7 == 0 else [i * (k + 1) + k for k in range(60)] for i in range(3000)}
