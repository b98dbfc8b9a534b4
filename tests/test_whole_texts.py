"""Queries over documents see every document and the whole of its text."""

from __future__ import annotations

import hashlib

import pytest

from folioflow.plans import catalog
from folioflow.plans.sequence_queries import sections

TEXTS = {i: "\n".join(f"Line {n} of document {i} says {n * i} and a few words." for n in range(40)) for i in (5, 300)} | {301: ""}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, t, "en", "src0", len(t)) for i, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_guard_of_every_block(spark, folder):
    found = catalog.QUERIES["mod_guard"](spark, folder).collect()
    blocks = {i: sorted(r.block for r in found if r.doc_id == i) for i in TEXTS}
    assert blocks[301] == [0]
    for i in (5, 300):
        assert blocks[i] == list(range(len(blocks[i]))) and len(blocks[i]) * 401 >= len(TEXTS[i])


def test_guard_of_whole_texts(spark, folder):
    found = {r.doc_id: r.text for r in catalog.QUERIES["str_guard"](spark, folder).collect()}
    assert found[5] == hashlib.md5(TEXTS[5].encode()).hexdigest()


def test_sections_hold_whole_texts(spark, folder):
    found = {r.doc_id: "\n".join(x.title + x.text if n % 3 < 2 else x.text for n, x in enumerate(r.s)) for r in sections(spark, folder).collect()}
    expected = {i: "\n".join(x if n % 3 < 2 else x[12:] for n, x in enumerate(t.split("\n"))) for i, t in TEXTS.items()}
    assert found == expected
