"""Listings, archives, handovers and downloads at their edges: services that lie, archives in a wrong order, lost tasks."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import random
import tarfile
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from folioflow.sources import archive, files, handover, paged, ranges


def put_pages(folder, pages, total):
    for n, ids in enumerate(pages, 1):
        (folder / f"{n}.json").write_text(json.dumps({"videos": [{"id": i, "title": f"T{i}"} for i in ids], "total": total}))
    return f"file://{folder}/{{page}}.json"


@pytest.mark.parametrize("ahead", [1, 2, 100])
def test_drain_by_distinct_ids(spark, tmp_path, ahead):
    """Repeats, an entry without an id, and pages beyond the total, which don't count."""
    url = put_pages(tmp_path, [["a", "b"], ["b", "c", None], ["d", "c"], ["e"], ["never"]], 5)
    rows, pages = paged.drain(spark, url, "id", size=2, ahead=ahead)
    assert {(r.id, r.page, r.position) for r in rows.collect()} == {("a", 1, 0), ("b", 1, 1), ("c", 2, 1), ("d", 3, 0), ("e", 4, 0)}
    assert pages == [(1, 2, 2), (2, 3, 1), (3, 2, 1), (4, 1, 1)]


def test_drain_ends_at_an_empty_page(spark, tmp_path):
    rows, pages = paged.drain(spark, put_pages(tmp_path, [["a"], ["b"], [], ["c"]], 99), "id", size=1)
    assert sorted(r.id for r in rows.collect()) == ["a", "b"] and len(pages) == 2
    none, no_pages = paged.drain(spark, f"file://{tmp_path}/none-{{page}}", "id")
    assert none.count() == 0 and no_pages == []


def test_drain_stops_a_service_that_repeats_itself(spark, tmp_path):
    url = put_pages(tmp_path, [["a", "b"], ["c"], ["b", "a"], ["d"]], 4)
    with pytest.raises(paged.PagedError, match="page 3 brings nothing new"):
        paged.drain(spark, url, "id", size=1)
    with pytest.raises(paged.PagedError, match="from 1"):
        paged.read_pages(spark, url, 0, 1)


def test_pages_over_http(spark):
    """A service that caps pages at three entries and answers its last page for all later ones."""
    asked = []

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            page = int(self.path.split("page=")[1].split("&")[0])
            asked.append(self.path)
            ids = range(3 * min(page, 4) - 3, min(3 * min(page, 4), 10))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"videos": [{"id": f"v{i}"} for i in ids] + ["no object"], "total": 10}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/videos?page={{page}}&per_page={{size}}"
    rows, pages = paged.drain(spark, url, "id", size=50)
    server.shutdown()
    assert rows.count() == 10 and [p for p, *_ in pages] == [1, 2, 3, 4] and "per_page=50" in asked[0]


def test_broken_pages(spark, tmp_path):
    (tmp_path / "1.json").write_text("no json")
    (tmp_path / "2.json").write_text('{"videos": 7}')
    for n, what in ((1, "not JSON"), (2, "no list")):
        with pytest.raises(Exception, match=what):
            paged.read_pages(spark, f"file://{tmp_path}/{{page}}.json", n, n).collect()
    rows = spark.createDataFrame([(i,) for i in range(7)], "n int")
    assert [r.n for r in paged.page_of(rows, [F.desc("n")], 2, 3).collect()] == [3, 2, 1]


def put_tar(path, members, packed=False):
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w") as tar:
        folder = tarfile.TarInfo("a folder")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
        for name, content in members:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    path.write_bytes(gzip.compress(data.getvalue()) if packed else data.getvalue())
    return f"file://{path}"


def test_lines_of_member_ranges(spark, tmp_path):
    """Whatever the ranges are, each line comes once, also long, empty and unended ones."""
    rng = random.Random(1)
    members = [
        ("a.jsonl", b"\n".join(b"x" * rng.choice([0, 1, 7, 300]) + str(i).encode() for i in range(60))),
        ("b" * 150 + ".jsonl", "zeile ü\n\n\nende\n".encode()), ("empty.jsonl", b""), ("c.txt", b"other\n"), ("one.jsonl", b"\n"),
    ]
    expected = []
    for n, (name, content) in enumerate(members):
        at = 0
        for line in content.splitlines(keepends=True) if name.endswith(".jsonl") else ():
            expected.append((name, n, at, line.rstrip(b"\n").decode()))
            at += len(line)
    plain, packed = put_tar(tmp_path / "p.tar", members), put_tar(tmp_path / "p.tar.gz", members, packed=True)
    for path, width in ((plain, 1), (plain, 10), (plain, 97), (plain, 1 << 20), (packed, 10)):
        found = [(r.member, r.number, r.at, r.line) for r in archive.lines(spark, [path], width=width).collect()]
        assert sorted(found) == sorted(expected)
    for path in (plain, packed):
        assert [(r.number, r.member, r.bytes) for r in archive.members(spark, [path]).orderBy("number").collect()] == [(i, n, len(c)) for i, (n, c) in enumerate(members)]


def test_order_of_packages(spark, tmp_path):
    parents = {"chunks": "works", "vectors": "chunks"}
    good = ["manifest.json", "works.jsonl", "chunks/1.jsonl", "chunks/2.jsonl", "vectors.jsonl"]
    cases = {
        "good": (good, []), "late": ([*good[1:], good[0]], ["manifest.json is not the first member"]),
        "child": (["manifest.json", "chunks/1.jsonl", "works.jsonl"], ["chunks stands before works"]),
        "between": (["manifest.json", "works/1.jsonl", "chunks.jsonl", "works/2.jsonl"], ["chunks stands before works"]),
        "orphan": (["manifest.json", "works.jsonl", "vectors.jsonl"], ["vectors has no chunks"]),
        "twice": ([*good, good[1]], ["a member comes twice", "chunks stands before works"]),
    }
    paths = {put_tar(tmp_path / f"{k}.tar", [(n, b"{}\n") for n in names]): errors for k, (names, errors) in cases.items()}
    found = archive.order_errors(archive.members(spark, list(paths)), parents).collect()
    assert sorted((r.archive, r.error) for r in found) == sorted((p, e) for p, errors in paths.items() for e in errors)


def test_handover_and_lost_tasks(spark, tmp_path):
    folder = f"file://{tmp_path}/h"
    rows = spark.createDataFrame([(i, f"t{i}", i % 3 > 0) for i in range(500)], "id int, text string, current boolean").repartition(7)
    empty = spark.createDataFrame([], "id int")
    tables = [handover.Table("works", rows, ["id"], "current"), handover.Table("none", empty, ["id"]), handover.Table("all", rows.withColumn("n", F.lit(None).cast("int")), [F.desc("id")])]
    manifest = handover.write_handover(tables, folder, 8, part_bytes=4000)
    (tmp_path / "h/works/000000-of-a-lost-task.jsonl").write_text('{"id":-1}\n')  # in no list, so in no part
    assert manifest["rows"] == {"works": 333, "none": 0, "all": 500} and manifest["files"]["none"] == []
    parts = [f"{folder}/{p['name']}" for p in manifest["parts"]]
    lines = archive.lines(spark, parts).withColumn("table", archive.table_of(F.col("member"))).collect()
    assert sorted(json.loads(r.line)["id"] for r in lines if r.table == "works") == [i for i in range(500) if i % 3 > 0]
    whole = sorted((r for r in lines if r.table == "all"), key=lambda r: (r.archive, r.number, r.at))
    assert [json.loads(r.line) for r in whole] == [{"id": i, "text": f"t{i}", "current": i % 3 > 0, "n": None} for i in range(499, -1, -1)]
    first = archive.members(spark, parts[:1]).orderBy("number").first()
    assert first.member == "manifest.json" and len(parts) == 2
    sums = (tmp_path / "h/SHA256SUMS").read_text().split("\n")[:-1]
    assert sums == [f"{hashlib.sha256((tmp_path / 'h' / p['name']).read_bytes()).hexdigest()}  {p['name']}" for p in manifest["parts"]]
    assert all(sum(f["bytes"] for f in part) <= 4000 or len(part) == 1 for part in handover.pack([f for t in tables for f in manifest["files"][t.name]], 4000))

    stored = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.substring_index("path", "/h/", -1).alias("path"), "content")
    listed = handover.read_manifest(spark, folder)
    assert files.verified(stored, listed).where("error is not null").count() == 0
    broken = stored.withColumn("content", F.when(F.col("path") == "part-00001.tar", F.lit(b"x")).otherwise(F.col("content")))
    assert [r.error for r in files.verified(broken, listed).where("error is not null").collect()] == ["size"]


def test_a_failed_write_leaves_no_list(spark, tmp_path):
    rows = spark.range(100).withColumn("x", F.expr("assert_true(id <> 77)"))
    with pytest.raises(Exception, match="assert_true|is not true"):
        handover.write_lines(handover.Table("t", rows, ["id"]), f"file://{tmp_path}/h")
    assert not (tmp_path / "h/t.files.json").exists()


def test_ranges_against_brute_force(spark):
    rng = random.Random(4)
    size = {f"f{i}": rng.randint(0, 40) for i in range(30)}
    content = {p: bytes(rng.randrange(256) for _ in range(n)) for p, n in size.items()}
    got = [(p, str(k), s, e) for p, n in size.items() for k in range(rng.randint(0, 6)) for s in [rng.randint(0, n)] for e in [min(n, s + rng.randint(0, 12))]]
    got += [(p, f"{k}again", s, e) for p, k, s, e in got[::7]]
    rows = spark.createDataFrame([(p, k, s, e, content[p][s:e]) for p, k, s, e in got], "path string, id string, start long, end long, content binary")
    files_ = spark.createDataFrame(list(size.items()), "path string, bytes long")

    def stretches(p, wanted):
        here = {i for q, _, s, e in got if q == p for i in range(s, e)}
        runs, i = [], 0
        while i < size[p]:
            j = i
            while j < size[p] and (j in here) == (i in here):
                j += 1
            if (i in here) == wanted:
                runs.append((i, j))
            i = j
        return runs

    found = sorted((r.path, r.start, r.end) for r in ranges.joined(rows).collect())
    assert found == sorted((p, *r) for p in size for r in stretches(p, True))
    asked = sorted((r.path, r.start, r.end) for r in ranges.missing(rows, files_, 5).collect())
    assert asked == sorted((p, a, min(b, a + 5)) for p in size for s, b in stretches(p, False) for a in range(s, b, 5))
    rest = spark.createDataFrame([(p, f"m{a}", a, b, content[p][a:b]) for p, a, b in asked], rows.schema)
    whole = {r.path: bytes(r.content) for r in ranges.assembled(ranges.pieces(rows.unionByName(rest))).collect()}
    assert whole == {p: c for p, c in content.items() if c}


def test_model_files(spark):
    rows = [
        ("m/models--a--b/refs/main", 1), ("m/models--a--b/snapshots/r1/x.bin", 5), ("m/models--a--b/snapshots/r2/sub/y.bin", 9), ("m/models--a--b/blobs/z", 1),
        ("models--c/snapshots/old/x", 2), ("models--c/snapshots/new/x", 3), ("models--c/.locks/l", 3), ("other/CACHEDIR.TAG", 1), ("other/w.gguf", 1),
    ]
    found = files.model_files(spark.createDataFrame(rows, "rel string, modified int"), spark.createDataFrame([("m/models--a--b", "r1\n"), ("models--x", "r")], "folder string, revision string"))
    assert {r.rel for r in found.collect()} == {"m/models--a--b/refs/main", "m/models--a--b/snapshots/r1/x.bin", "models--c/snapshots/new/x", "other/w.gguf"}


def test_damaged_books(spark):
    """Whatever is wrong with a file, it has an error and no section, and the others are read."""
    from folioflow.plans.service_queries import book
    from folioflow.sources.documents import read_epub

    good = book(1, "en", "s", [["A line of the first chapter."], ["A line of the second one."], ["And one of the third one."]])
    flipped = bytearray(good)
    flipped[good.index(b"META-INF") + 40] ^= 0xFF
    encrypted = bytearray(good)
    for at in (i for i in range(len(good)) if good[i : i + 4] in (b"PK\3\4", b"PK\1\2")):
        encrypted[at + (6 if good[at + 2] == 3 else 8)] |= 1
    rows = [("good", good), ("flipped", bytes(flipped)), ("encrypted", bytes(encrypted)), ("cut", good[:-30]), ("text", b"no zip"), ("none", None)]
    found = {r.path: r for r in read_epub(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert found["good"].error is None and [(s.level, s.title) for s in found["good"].sections] == [(1, "Chapter 1"), (1, "Chapter 2"), (2, "Chapter 3")]
    assert all(found[k].error and not found[k].sections for k, _ in rows[1:])


def test_artwork(spark):
    media = spark.createDataFrame([("a/x.mp4", 100.0), ("a/y.1.mp4", 900.0), ("z.mp4", None), ("a/.q.mp4", 5.0)], "rel string, duration_s double")
    pictures = spark.createDataFrame([("a/x.webp",), ("a/x.jpeg",), ("a/y.1.gif",), ("b/z.jpg",), ("a/x.JPG",)], "rel string")
    found = {r.rel: (r.artwork, r.frame_s) for r in files.with_artwork(media, pictures).collect()}
    assert found == {"a/x.mp4": ("a/x.jpeg", None), "a/y.1.mp4": (None, 30.0), "z.mp4": (None, 0.0), "a/.q.mp4": (None, 0.5)}


def test_handovers_newest_first(spark, tmp_path):
    for name, text in {"a": '{"format": "folioflow-library", "version": 1, "created": "2024-01-02T00:00:00Z", "parts": [{"name": "p"}]}', "b": "broken {", "c": '{"format": "folioflow-library", "created": "2024-03-01T00:00:00Z"}', "d": "[]"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(text)
    (tmp_path / "e").mkdir()
    assert [(r.path.split("/")[-2], r.n_parts) for r in handover.handovers(spark, f"file://{tmp_path}").collect()] == [("c", 0), ("a", 1)]


def test_tools_and_sound(spark):
    from folioflow.operators import listing, merge

    tools = "array<struct<name:string,title:string,active:boolean>>"
    servers = [("s1", "Haus Ä", True, 1, [("Suche", "", None), ("", "x", True), (None, "x", True), ("aus", "x", False), ("an", "An!", True)]), ("s2", "B", False, 0, [("q", "", True)]), ("s3", "C", True, 2, None)]
    found = listing.usable_tools(spark.createDataFrame(servers, f"server_id string, title string, active boolean, created int, discovered {tools}")).orderBy("place").collect()
    assert [(r.tool_id, r.name, r.title) for r in found] == [("s1:Suche", "haus_ae_suche", "Haus Ä: Suche"), ("s1:an", "haus_ae_an", "Haus Ä: An!")]
    audio = spark.createDataFrame([(1, "mp3", "stream"), (2, "mp3", "file")], "work_id int, format string, way string")
    made = spark.createDataFrame([(2, "opus", None), (3, None, "source")], "work_id int, format string, way string")
    assert sorted(map(tuple, merge.acquired(audio, made, ["format"]).collect())) == [(1, "mp3", "stream"), (2, "opus", "file"), (3, None, "source")]
    with pytest.raises(Exception, match="unknown way x"):
        merge.acquired(audio, made.withColumn("way", F.lit("x")), ["format"]).collect()


def test_many_small_pages_and_ranges_are_few_tasks(spark, tmp_path):
    url = put_pages(tmp_path, [[f"e{n}"] for n in range(700)], 700)
    assert paged.read_pages(spark, url, 1, 700).rdd.getNumPartitions() <= paged.TASKS
    assert [r.page for r in paged.read_pages(spark, url, 1, 700).select("page").collect()] == list(range(1, 701))
    rows, pages = paged.drain(spark, url, "id", size=50)
    assert rows.count() == len(pages) == 700
    table = spark.range(3000).selectExpr("id", "repeat('z', 40) AS text")
    parts = [f"file://{tmp_path}/h/{p['name']}" for p in handover.write_handover([handover.Table("all", table, ["id"])], f"file://{tmp_path}/h", 3)["parts"]]
    lines = archive.lines(spark, parts, width=100)
    assert lines.rdd.getNumPartitions() <= 2 * archive.TASKS and lines.select("line").distinct().count() == 3000
