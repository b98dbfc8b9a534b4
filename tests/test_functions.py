"""Cases with known results for functions and folds that SQL checks only in part."""

from __future__ import annotations

import time

import difflib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as t
from folioflow.functions import values as v
from folioflow.operators import listing, merge, models
from folioflow.operators import sequences as q
from folioflow.sources import documents as d
from folioflow.sources import files, package
from folioflow.streaming import streams

SEGMENTS = "start double, end double, text string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def segments(spark, rows):
    return spark.createDataFrame([(rows,)], f"s array<struct<start:double,end:double,text:string>>")


def test_text_rules(spark):
    assert one(spark, t.straighten(F.lit("„Ja“ – nein… ‚x’"))) == "\"Ja\" - nein... 'x'"
    assert one(spark, t.only_latin(F.lit("weil er 认为 in Ωß"))) == "weil er in Ωß"
    assert one(spark, t.only_latin(F.lit("a  b"))) == "a  b"
    assert one(spark, t.plain_markdown(F.lit("![a](b) [c](d) `e` **f** *g*\n> h\n* i | j"))) == "a c e f g\nh\n- i   j"
    assert one(spark, t.model_family(F.lit("text-embedding-bge-m3-q8_0"))) == "bge-m3"
    assert one(spark, t.time_mark(F.lit(3661.5))) == "1:01:02"
    assert one(spark, t.link_citations(F.lit("see [12] and [3](x)"))) == "see [12](#hit-12) and [3](x)"


@pytest.mark.parametrize(
    ("answer", "reason"),
    [("", "empty"), ("Gerne!", "empty"), ("Hier ist der Text.", "remark"), ("kurz", "length"), ("Ein ganz anderer Inhalt steht", "similarity"), ("Das ist der rohe Satz hier!", "")],
)
def test_guard(spark, answer, reason):
    raw = "das ist der rohe satz hier"
    cleaned = one(spark, t.clean_answer(F.lit(answer)))
    if reason == "remark":
        cleaned = answer
    alike = difflib.SequenceMatcher(None, raw.replace(" ", ""), "".join(c for c in cleaned.lower() if c.isalnum()), autojunk=False).ratio()
    got = one(spark, t.guard(F.lit(raw), F.lit(cleaned), F.lit(alike)))
    assert (got.reason, got.discarded, got.text) == (reason, reason != "", cleaned if not reason else raw)


def test_similarity(spark):
    rows = spark.createDataFrame([("Ab c", "abd"), ("", ""), ("x", "")], "a string, b string")
    found = [r.s for r in rows.select(models.similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert found == [pytest.approx(2 / 3), 1.0, 0.0]


def test_segments(spark):
    rows = segments(spark, [(0.0, 3.0, "A"), (3.0, 6.5, "B"), (7.0, 9.0, "C"), (9.0, 25.0, "D"), (25.0, 26.0, "E")])
    blocks = rows.select(q.merge_segments(F.col("s")).alias("b")).first().b
    assert [(b.start, b.end, b.text) for b in blocks] == [(0.0, 6.5, "A B"), (7.0, 25.0, "C D"), (25.0, 26.0, "E")]
    said = ["Hallo.", "Hallo.", "", "ja ja ja ja ja ja ja ja", "Untertitel von Sender", "Hallo.", "Weiter geht es."]
    kept = segments(spark, [(0.0, 1.0, x) for x in said]).select(q.drop_made_up(F.col("s")).alias("k")).first().k
    assert [k.text for k in kept] == ["Hallo.", "Weiter geht es."]
    assert one(spark, q.pack(F.array(*map(F.lit, (3, 2, 4, 1, 10, 1))), 7, glue=1)) == [0, 0, 1, 1, 2, 3]


def test_sentences(spark):
    text = 'Am 3. Mai kam Dr. A. Müller z. B. nach Ulm. "Gut!" Er blieb bis 1999. 20 Jahre n. Chr. Geburt? Ja… Ende'
    expected = ["Am 3. Mai kam Dr. A. Müller z. B. nach Ulm.", '"Gut!"', "Er blieb bis 1999.", "20 Jahre n. Chr. Geburt?", "Ja…", "Ende"]
    assert one(spark, q.sentences(F.lit(text))) == expected
    assert one(spark, q.sentences(F.lit("  "))) == []
    assert one(spark, q.break_at_blanks(F.lit("aa bb cccccc d"), 5)) == ["aa bb", "cccccc", "d"]


def plain_chunks(parts, target, overlap):
    """The rules of chunking, one step at a time."""
    join = lambda xs: "".join(("" if i == 0 else " " if xs[i - 1][1] == x[1] else "\n\n") + x[0] for i, x in enumerate(xs))
    out, carry, i = [], [], 0
    while i < len(parts):
        new = [parts[i]]
        while i + len(new) < len(parts) and len(join(carry + new + [parts[i + len(new)]])) <= target:
            new.append(parts[i + len(new)])
        i += len(new)
        tail = []
        for x in reversed(new[1:]):
            if len(join([x, *tail])) > overlap:
                break
            tail = [x, *tail]
        tail = tail if overlap else []
        out.append((join(carry + new), len(join(carry)), len(join(tail))))
        carry = tail
    return [(a, b, c if k < len(out) - 1 else 0) for k, (a, b, c) in enumerate(out)]


@pytest.mark.parametrize(("target", "overlap"), [(30, 0), (30, 12), (25, 40), (1, 5), (1000, 100)])
def test_chunks(spark, target, overlap):
    texts = ["Eins zwei drei.", "Vier.", "Fünf sechs sieben acht neun zehn.", "Elf.", "Zwölf.", "Dreizehn vierzehn."]
    parts = [(x, n // 2, float(n // 2), float(n // 2 + 1)) for n, x in enumerate(texts)]
    rows = spark.createDataFrame([(1, parts), (2, [])], "id int, s array<struct<text:string,paragraph:int,start:double,end:double>>")
    found = {r.id: r.chunks for r in q.chunks(rows, "s", target, overlap).collect()}
    assert [(c.text, c.overlap_before, c.overlap_after) for c in found[1]] == plain_chunks(parts, target, overlap)
    assert [c.ordinal for c in found[1]] == list(range(1, len(found[1]) + 1)) and found[2] == []


def test_sections(spark):
    long = "Ein Satz. " * 5
    rows = [(1, "Titel", ""), (2, "Unter", "kurz"), (1, "Teil", ""), (2, "Tief", long), (1, "", "x"), (1, "Ende", long)]
    frame = spark.createDataFrame([(rows,)], "s array<struct<level:int,title:string,text:string>>")
    kept = frame.select(q.clean_sections(F.col("s")).alias("k")).first().k
    assert [k.title for k in kept] == ["Teil", "Tief", "Ende"]


def test_selection_rule(spark):
    def inside(duration, least=300, most=0, kind="video", loaded=True, only=True):
        kinds = F.array(F.lit("video"), F.lit("live"))
        return one(spark, listing.in_scope(F.lit(duration).cast("int"), F.lit(kind), F.lit(loaded), F.lit(least), F.lit(most), kinds, F.lit(only)))

    assert [inside(300), inside(301), inside(None), inside(3600, most=3600), inside(3601, most=3600)] == [False, True, False, True, False]
    assert [inside(100, least=0), inside(900, kind="short"), inside(900, loaded=False), inside(900, loaded=False, only=False)] == [True, False, False, True]


def test_stages(spark):
    cases = [
        (None, 0, 0, 0, 0, "discovered"), (None, 1, 0, 0, 0, "transcribed"), (None, 0, 1, 0, 0, "corrected"), (None, 0, 1, 2, 1, "chunked"),
        (None, 0, 1, 2, 2, "embedded"), ("embedded", 0, 0, 0, 0, "embedded"), ("embedded", 0, 1, 0, 0, "embedded"),
        ("embedded", 0, 1, 3, 1, "chunked"), ("audio", 0, 1, 0, 0, "corrected"), ("audio", 0, 0, 2, 2, "embedded"),
    ]
    rows = spark.createDataFrame(cases, "x string, t int, c int, h int, e int, expected string")
    got = rows.select("expected", merge.stage_after_import(*map(F.col, "xtche")).alias("s")).collect()
    assert [r.s for r in got] == [r.expected for r in got]


def test_json(spark):
    a = F.lit('{"hits": [{"text": "a", "url": "u1"}, {"text": "b"}], "answer": {"core": "x"}}')
    paths = {"hits[].text": ["a", "b"], "hits[].url": ["u1"], "answer.core": ["x"], "hits[1].text": ["b"], "hits[-1].text": ["b"], "none.too": []}
    assert {p: one(spark, v.json_values(a, p)) for p in paths} == paths
    assert one(spark, v.ratings(F.lit('{"bewertungen": [{"nr": 1, "wert": "7,5"}, {"nr": 2, "wert": 99}]}'), F.lit(3))) == [7.5, 10.0, 0.0]
    assert one(spark, v.ratings(F.lit("no idea"), F.lit(2))) is None
    for header, expected in (("bytes=0-4", (0, 4, "partial")), ("bytes=5-", (5, 9, "partial")), ("bytes=-3", (7, 9, "partial")), ("bytes=20-", (0, 9, "unsatisfiable")), ("x", (0, 9, "whole"))):
        assert tuple(one(spark, v.byte_range(F.lit(header), F.lit(10)))) == expected


def epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="OEBPS/b.opf"/></rootfiles></container>')
        z.writestr(
            "OEBPS/b.opf",
            '<package xmlns="p" xmlns:dc="d"><metadata><dc:title>Buch</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator></metadata><manifest>'
            '<item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="a" href="text/k1.xhtml" media-type="application/xhtml+xml"/>'
            '<item id="b" href="text/k2.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>',
        )
        z.writestr("OEBPS/nav.xhtml", '<html><nav><ol><li><a href="text/k1.xhtml">Erstes Kapitel</a></li><li><a href="text/k2.xhtml#u0">Zweites</a></li></ol></nav></html>')
        z.writestr("OEBPS/text/k1.xhtml", "<html><head><title>no</title></head><body><p>" + "Ein Satz ohne Titel. " * 3 + "</p><script>bad()</script></body></html>")
        z.writestr("OEBPS/text/k2.xhtml", "<html><body><h1 id='u0'>Zweites Kapitel</h1><p>" + "Text. " * 9 + "</p><h2>Unterpunkt</h2><p>" + "Mehr. " * 9 + "</p></body></html>")
    return out.getvalue()


def test_epub(spark):
    rows = spark.createDataFrame([("a.epub", bytearray(epub())), ("bad", bytearray(b"x")), ("null", None)], "path string, content binary")
    found = {r.path: r for r in d.read_epub(rows).collect()}
    book = found["a.epub"]
    assert [(s.title, s.level) for s in book.sections] == [("Erstes Kapitel", 1), ("Zweites Kapitel", 1), ("Unterpunkt", 2)]
    assert book.title == "Buch" and book.meta["creator"] == "A, B" and "bad" not in book.sections[0].text
    assert found["bad"].error and found["null"].error and found["bad"].sections == []


def test_markdown_and_text(spark):
    source = "---\nTitel: Mein Text\ndate: 2024-03-01\n---\n# Einleitung\n**Fett** und [Link](http://x) mit genug Text.\n\n## Details\n- eins ist eine lange Zeile\n\n```\ncode = 1\n```\n"
    rows = spark.createDataFrame([(source,), ("",), (None,)], "text string")
    got = d.read_markdown(rows).collect()
    assert [(s.level, s.title) for s in got[0].sections] == [(1, "Einleitung"), (2, "Details")] and got[0].title == "Mein Text"
    assert got[0].sections[0].text == "Fett und Link mit genug Text." and "code = 1" in got[0].sections[1].text
    assert got[1].sections == []
    text = d.read_text(spark.createDataFrame([("Erste Zeile\n\nZweiter  Absatz\n \nDritter Absatz",)], "text string")).first()
    assert text.title == "Erste Zeile" and text.sections[0].text == "Erste Zeile\n\nZweiter Absatz\n\nDritter Absatz"


def test_markdown_outline(spark):
    long = "some words that are enough"
    source = f"```\ncode {long}\n# no heading\n```\n\n#### Deep ####\ntext {long}\nmore\n~~~\nkept\n\n~~~\nend\n## Two\n\n{long} a\n\n{long} b\n# One\n{long}"
    rows = spark.createDataFrame([(source,), (f"```\nlost {long}\n```\n# H\n{long}",)], "text string")
    a, b = (r.sections for r in d.read_markdown(rows).collect())
    assert [(s.level, s.title, s.text) for s in a] == [
        (1, f"text {long}", f"code {long} # no heading\n\nDeep\n\ntext {long} more kept  end"),
        (2, "Two", f"{long} a\n\n{long} b"), (1, "One", long),
    ]
    assert [(s.level, s.title, s.text) for s in b] == [(1, "H", long)]


def test_blocks_and_places(spark):
    blocks = [("lead text of the page", 0, ""), ("Head", 2, ""), ("one paragraph of it", 0, ""), ("another one", 0, ""), ("Last", 1, "")]
    rows = spark.createDataFrame([(1, blocks), (2, [])], f"id long, blocks {d.BLOCK_DDL}").select("id", d.sections_of_blocks(F.col("blocks"), F.lit("")).alias("sections"))
    found = {r.id: [tuple(s) for s in r.sections] for r in rows.collect()}
    assert found == {1: [(1, "lead text of the page", "lead text of the page"), (2, "Head", "one paragraph of it\n\nanother one"), (1, "Last", "")], 2: []}
    placed = d.placed_sections(rows, "id").orderBy("ordinal").collect()
    assert [(r.ordinal, r.title, r.position_from) for r in placed] == [(1, "lead text of the page", 0), (2, "Head", 23), (3, "Last", 57)]


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    for name in ("Vortrag_ueber_Zeit.mp4", "sub/B_Folge.m4a", "note.txt", ".hidden/x.mp4"):
        (tmp_path / name).write_bytes(b"123")
    found = files.scan(spark, str(tmp_path)).orderBy(F.lower("rel")).collect()
    assert [r.rel for r in found] == ["sub/B_Folge.m4a", "Vortrag_ueber_Zeit.mp4"]
    media = files.scan(spark, str(tmp_path))
    cards = spark.createDataFrame([("Vortrag_ueber_Zeit.info.json", '{"title": "Zeit", "upload_date": "20240102", "duration": "900", "tags": ["zeit", " "], "url": "u"}'), ("sub/B_Folge.json", "{broken")], "rel string, json string")
    rows = {r.rel: r for r in files.videos(files.with_sidecars(media, cards)).collect()}
    a, b = rows["Vortrag_ueber_Zeit.mp4"], rows["sub/B_Folge.m4a"]
    assert (a.title, a.published.year, a.duration_s, a.tags, a.url) == ("Zeit", 2024, 900, ["zeit"], "u")
    assert (b.title, b.duration_s, b.tags) == ("B Folge", None, [])
    assert {r.area: r.n for r in files.sizes(media, ["sub"]).collect()} == {"sub": 1, "other": 1}


def test_package(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    package.write_package({"rows": rows}, str(tmp_path / "p"), 4)
    assert package.manifest(spark, str(tmp_path / "p")).first().tables[0].rows == 2
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "rows").mkdir()
    (tmp_path / "q" / "rows" / "x.json").write_text('{"id": 1, "more": 2}\n{"id": "no"}\n')
    loose = package.read_table(spark, str(tmp_path / "q"), "rows", rows.schema, strict=False).cache()
    assert loose.where("_corrupt_record is not null").count() == 1


def test_throttle(spark, tmp_path):
    rows = [(1, i, p) for i, p in enumerate([0.0, 0.001, 0.02, 0.021, 0.022, 0.5])] + [(2, 0, 0.1), (2, 5, 0.1)]
    frame = spark.createDataFrame(rows, "job_id long, s int, progress double").withColumn("ts", F.timestamp_seconds("s"))
    frame.select("job_id", "ts", "progress").write.parquet(str(tmp_path / "in"))
    stream = streams.events(spark, str(tmp_path / "in"), "*.parquet", "job_id long, ts timestamp, progress double")
    got = streams.drain(streams.throttled(stream, 0.01, 3.0)).collect()
    assert sorted((r.job_id, r.progress) for r in got) == [(1, 0.0), (1, 0.02), (1, 0.5), (2, 0.1), (2, 0.1)]


def test_stuck_stream(spark, tmp_path):
    for n, rows in enumerate([[(1, 1000), (2, 1000)], [(2, 1100)], [(3, 1900)], [(3, 3000)]]):
        frame = spark.createDataFrame(rows, "job_id long, s int").select("job_id", F.timestamp_seconds("s").alias("ts"))
        frame.coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema("job_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = streams.drain(streams.stuck_stream(stream, 300)).collect()
    assert {1, 2} <= {r.job_id for r in got} <= {1, 2, 3}


def test_sections_are_dropped_in_rounds(spark):
    import random

    def rounds(parts):
        while True:
            rest = [p for i, p in enumerate(parts) if len(p[2]) >= 20 or p[1] and i + 1 < len(parts) and parts[i + 1][0] > p[0]]
            if len(rest) == len(parts):
                return rest
            parts = rest

    random.seed(3)
    cases = [[(1, "A", ""), (1, "", ""), (2, "C", "x" * 40)], [], [(1, "A", ""), (2, "B", "")]]
    cases += [[(random.randint(1, 4), random.choice(["", "T"]), random.choice(["", "x" * 30, ""])) for _ in range(random.randint(1, 12))] for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(cases)), "n int, s array<struct<level:int,title:string,text:string>>")
    found = {r.n: [tuple(x) for x in r.k] for r in rows.select("n", q.clean_sections(F.col("s")).alias("k")).collect()}
    assert all(found[n] == rounds(c) for n, c in enumerate(cases))


def test_words_of_merged_segments(spark):
    rows = [(0.0, 3.0, "A", [("A", 0.0, 1.0)]), (3.0, 6.5, "B", [("B", 3.0, 4.0)]), (7.0, 9.0, "C", []), (9.0, 25.0, "D", []), (25.0, 26.0, "E", [])]
    frame = spark.createDataFrame([(rows,)], "s array<struct<start:double,end:double,text:string,words:array<struct<word:string,start:double,end:double>>>>")
    found = frame.select(q.merge_segments(F.col("s"), words=True).alias("b")).first().b
    assert [(x.text, x.start, x.end) for x in found] == [("A B", 0.0, 6.5), ("C D", 7.0, 25.0), ("E", 25.0, 26.0)]
    assert [w.word for w in found[0].words] == ["A", "B"]


def test_very_long_texts_in_linear_time(spark):
    text = "Ein Satz mit z. B. drei Punkten geht hier weiter. " * 100_000 + "wort " * 1_000_000
    frame = spark.createDataFrame([(1, [(text, 0.0, 1.0)])], "id int, p array<struct<text:string,start:double,end:double>>")
    began = time.time()
    found = q.chunks(frame.select("id", q.sentences_of(F.col("p"), 3000).alias("s")), "s").select(F.explode("chunks").alias("c")).select("c.*").collect()
    assert time.time() - began < 120 and sum(r.chars - r.overlap_before for r in found) >= len(text.strip()) - len(found)
