"""Document readers: Markdown and plain text by folds in the row, XHTML and EPUB by the standard library inside tasks.

All give sections (level, title, text) in reading order; ``placed_sections`` numbers them and adds their places.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, join_paragraphs, let, plain_markdown, strip
from ..functions.values import lenient_time
from ..operators import folds
from ..operators.sequences import clean_sections, settled

SECTIONS = "array<struct<level:int,title:string,text:string>>"
TITLE_LENGTH, HEADING_LENGTH = 80, 200
# Kinds of files by their ending; elements of XHTML that end a block, are headings, or are never read.
KINDS = {"epub": "epub", "md": "markdown", "markdown": "markdown", "txt": "text", "text": "text"}
BLOCK_TAGS = frozenset(
    "p div li blockquote pre section article aside header footer figure figcaption td th tr dd dt br hr ul ol table".split()
)
HEADINGS = {"h1": 1, "h2": 2, "h3": 3}
UNREAD = frozenset("script style head title svg math nav".split())


def kind_of(name: Column) -> Column:
    """SRC18: the reader for a file name; an error for an unknown ending."""
    ending = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    known = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), ending)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("no reader for "), name)).cast("string"))


def title_of(text: Column, default: str) -> Column:
    """The first line that is not empty, 80 characters of it."""
    first = F.get(F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != ""), F.lit(0))
    return F.coalesce(F.rtrim(F.substring(first, 1, TITLE_LENGTH)), F.lit(default))


def front_matter(text: Column) -> Column:
    """SRC16: the map of a Markdown file's head, keys in lower case; empty without one."""
    head = F.regexp_extract(text, r"\A---\r?\n([\s\S]*?)\r?\n---(?:\r?\n|\z)", 1)
    pairs = F.filter(F.split(head, r"\r?\n"), lambda x: F.instr(x, ":") > 1)
    entry = lambda x: F.struct(
        F.lower(strip(F.substring_index(x, ":", 1))).alias("k"),
        F.regexp_replace(strip(F.regexp_replace(x, r"^[^:]*:", "")), r"^[\"']+|[\"']+$", "").alias("v"),
    )
    return F.map_from_entries(F.array_distinct(F.transform(pairs, entry)))


def read_text(docs: DataFrame, text_col: str = "text", default: str = "Text") -> DataFrame:
    """SRC17: rows with ``title`` and ``sections``, one section of the paragraphs between blank lines."""
    text = strip(F.replace(F.col(text_col), F.lit("\r\n"), F.lit("\n")))
    parts = F.transform(F.split(text, r"\n\s*\n"), collapse)
    title = title_of(text, default)
    rows = docs.withColumn("title", F.coalesce(title, F.lit(default)))
    one = F.array(F.struct(F.lit(1).alias("level"), F.col("title").alias("title"), join_paragraphs(parts).alias("text")))
    return rows.withColumn("sections", clean_sections(one.cast(SECTIONS)))


def read_markdown(docs: DataFrame, text_col: str = "text", default: str = "Document") -> DataFrame:
    """SRC16: rows with ``meta``, ``title`` and ``sections``: headings of three levels open sections, deeper ones are paragraphs.

    Fences toggle, their lines are kept as they are. Text before the first heading is under the head's title, else its first line.
    """
    whole = F.replace(F.col(text_col), F.lit("\r\n"), F.lit("\n"))
    rows = settled(docs, "meta", front_matter(whole))
    body = F.regexp_replace(whole, r"\A---\n[\s\S]*?\n---(?:\n|\z)", "")
    own_title = F.coalesce(F.element_at("meta", "titel"), F.element_at("meta", "title"))

    def marks(line: Column) -> Column:
        return F.length(F.regexp_extract(line, r"^(#{1,6})\s+\S", 1))

    def heading(line: Column) -> Column:
        return strip(plain_markdown(F.regexp_extract(line, r"^#{1,6}\s+(.*?)\s*#*\s*$", 1)))

    def kind(line: Column) -> Column:
        other = F.when(F.rlike(line, F.lit(r"(?U)\S")), folds.TEXT).otherwise(folds.BLANK)
        deep = F.when(marks(line) > 0, F.least(marks(line), F.lit(folds.DEEP))).otherwise(other)
        return F.when(line.startswith("#"), deep).when(line.startswith("```") | line.startswith("~~~"), folds.FENCE).otherwise(other)

    rows = settled(rows, "__l", F.split(body, "\n"))
    found = settled(rows, "__o", folds.fold(folds.outline, "array<struct<at:int,parts:array<array<int>>>>", F.transform("__l", kind)))

    def part(numbers: Column) -> Column:
        of = lambda i: F.when(i < 0, heading(F.get("__l", -i - 1))).otherwise(strip(F.get("__l", i)))
        return plain_markdown(F.array_join(F.transform(numbers, of), " "))

    def section(o: Column) -> Column:
        line = F.get("__l", o["at"])
        title = F.when(marks(line) > 0, heading(line)).otherwise(F.coalesce(own_title, title_of(line, default)))
        return F.struct(F.greatest(marks(line), F.lit(1)).alias("level"), title.alias("title"), join_paragraphs(F.transform(o["parts"], part)).alias("text"))

    plain = F.transform("__o", section)
    found, plain = settled(found, "__plain", plain), F.col("__plain")
    first = F.get(F.filter("__o", lambda o: marks(F.get("__l", o["at"])) == 1), F.lit(0))["at"]
    return (
        found.withColumn("sections", clean_sections(plain))
        .withColumn("title", F.coalesce(own_title, F.nullif(heading(F.get("__l", first)), F.lit("")), F.lit(default)))
        .withColumn("published", lenient_time(F.coalesce(F.element_at("meta", "datum"), F.element_at("meta", "date"))))
        .drop("__l", "__o", "__plain")
    )


class Blocks(HTMLParser):
    """Blocks of one XHTML file as (text, level, anchor); level 0 is a paragraph."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, int, str]] = []
        self.unread, self.level, self.anchor, self.parts = 0, 0, "", []

    def end(self) -> None:
        if text := " ".join("".join(self.parts).split()):
            self.found.append((text, self.level, self.anchor))
        self.level, self.anchor, self.parts = 0, "", []

    def handle_starttag(self, tag, attrs):
        self.unread += tag in UNREAD
        if self.unread:
            return
        own = dict(attrs).get("id") or ""
        if tag in HEADINGS or tag in BLOCK_TAGS:
            self.end()
            self.level = HEADINGS.get(tag, 0)
        if own and not self.anchor and not self.parts:
            self.anchor = own

    def handle_startendtag(self, tag, attrs):
        if tag not in UNREAD:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in UNREAD:
            self.unread = max(0, self.unread - 1)
        elif not self.unread and (tag in HEADINGS or tag in BLOCK_TAGS):
            self.end()

    def handle_data(self, data):
        if not self.unread:
            self.parts.append(data)


def blocks_of(source: str) -> list[tuple[str, int, str]]:
    page = Blocks()
    page.feed(source)
    page.close()
    page.end()
    return page.found


BLOCK = pa.struct([("text", pa.string()), ("level", pa.int32()), ("anchor", pa.string())])
BLOCK_DDL = "array<struct<text:string,level:int,anchor:string>>"


def xhtml_blocks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """SRC12: (id, blocks) of each page's XHTML; a null page has none."""
    source = pages.select(id_col, F.coalesce(html_col, F.lit("")).alias("__html"))
    kind = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("text", "level", "anchor"), b, strict=True)) for b in blocks_of(h)] for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(BLOCK))], [id_col, "blocks"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, blocks {BLOCK_DDL}")


def sections_of_blocks(blocks: Column, lead_title: Column, lead_level: Column | None = None) -> Column:
    """SRC15: headings open sections; text before the first is under ``lead_title``, else its own first words."""
    opening = F.filter(F.transform(blocks, lambda b, i: F.when((b["level"] > 0) | (i == 0), i)), F.isnotnull)

    def sections(at: Column) -> Column:
        def section(first: Column, n: Column) -> Column:
            inside = F.slice(blocks, first + 1, F.coalesce(F.get(at, n + 1), F.size(blocks)) - first)
            head, parts = F.get(blocks, first), F.transform(F.filter(inside, lambda b: b["level"] <= 0), lambda b: b["text"])
            lead = F.coalesce(F.nullif(lead_title, F.lit("")), F.rtrim(F.substring(head["text"], 1, TITLE_LENGTH)))
            return F.struct(
                F.when(head["level"] > 0, head["level"]).otherwise(lead_level if lead_level is not None else F.lit(1)).alias("level"),
                F.when(head["level"] > 0, F.substring(head["text"], 1, HEADING_LENGTH)).otherwise(lead).alias("title"),
                join_paragraphs(parts).alias("text"),
            )

        return F.transform(at, section)

    return let(opening, sections)


def placed_sections(docs: DataFrame, id_col: str, sections_col: str = "sections") -> DataFrame:
    """SRC19: (id, ordinal from 1, level, title, text, position_from), two characters between sections."""
    ends = folds.fold(folds.running_ends(2), "array<long>", F.transform(sections_col, lambda s: F.length(s["text"])))
    rows = settled(docs, "__p", ends).select(id_col, "__p", F.posexplode(sections_col).alias("i", "s"))
    start = (F.get("__p", F.col("i")) - F.length("s.text")).cast("int")
    return rows.select(id_col, (F.col("i") + 1).alias("ordinal"), "s.level", "s.title", "s.text", start.alias("position_from"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def epub_sections(raw: bytes) -> tuple[dict[str, str], list[dict]]:
    """SRC11, SRC13, SRC14: an EPUB's metadata and its spine's files with blocks, lead title and level from the contents."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        read = lambda name: ElementTree.fromstring(z.read(name))
        opf_path = next(e.get("full-path") for e in read("META-INF/container.xml").iter() if _local(e.tag) == "rootfile")
        opf, folder = read(opf_path), posixpath.dirname(opf_path)
        path = lambda href, base=folder: posixpath.normpath(posixpath.join(base, unquote(href.split("#")[0])))
        items = {e.get("id"): e for e in opf.iter() if _local(e.tag) == "item"}
        spine = [e.get("idref") for e in opf.iter() if _local(e.tag) == "itemref"]
        meta: dict[str, str] = {}
        for e in opf.iter():
            name = _local(e.tag)
            if name in ("title", "creator", "language", "description", "date") and (e.text or "").strip():
                meta[name] = f"{meta[name]}, {e.text.strip()}" if name == "creator" and name in meta else meta.get(name) or e.text.strip()
        contents: dict[tuple[str, str], tuple[str, int]] = {}
        for item in items.values():
            where, kind = path(item.get("href", "")), item.get("media-type", "")
            if "nav" in (item.get("properties") or "").split() or kind == "application/x-dtbncx+xml":
                if where not in z.namelist():
                    continue
                base = posixpath.dirname(where)

                def walk(e, depth, base=base):
                    for child in e:
                        deeper = depth + (_local(child.tag) in ("ol", "navpoint"))
                        href = child.get("href") if _local(child.tag) == "a" else None
                        label = " ".join("".join(child.itertext()).split()) if href else ""
                        if _local(child.tag) == "navpoint":
                            href = next((c.get("src") for c in child if _local(c.tag) == "content"), None)
                            label = next((" ".join("".join(c.itertext()).split()) for c in child if _local(c.tag) == "navlabel"), "")
                        if href and label:
                            contents.setdefault((path(href, base), href.partition("#")[2]), (label, min(max(deeper, 1), 3)))
                        walk(child, deeper)

                walk(read(where), 0)
        files = []
        for number, ref in enumerate(spine, 1):
            item = items.get(ref)
            if item is None or item.get("media-type") not in ("application/xhtml+xml", "text/html") or "nav" in (item.get("properties") or "").split():
                continue
            where = path(item.get("href", ""))
            if where not in z.namelist():
                continue
            blocks = blocks_of(z.read(where).decode("utf-8", "replace"))
            points = [v for (p, f), v in contents.items() if p == where and not f] + [v for (p, f), v in contents.items() if p == where and f]
            title, level = points[0] if points else (f"Section {number}", 1)
            blocks = [(t, contents.get((where, a), ("", n))[1] if n and a else n, a) for t, n, a in blocks]
            files.append({"title": title, "level": level, "blocks": [dict(zip(("text", "level", "anchor"), b, strict=True)) for b in blocks]})
        return meta, files


def read_epub(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """SRC11: (path, meta, title, sections, error) of EPUB files as ``binaryFile`` reads them; a broken file has an error and no section."""
    source = files.select(F.col(path_col).alias("path"), F.coalesce(F.col(content_col), F.lit(b"")).alias("content"))
    part = pa.struct([("title", pa.string()), ("level", pa.int32()), ("blocks", pa.list_(BLOCK))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            metas, parts, errors = [], [], []
            for raw in batch.column(1).to_pylist():
                try:
                    meta, found = epub_sections(raw)
                    error = None
                except Exception as e:  # noqa: BLE001  damaged streams, encrypted members and odd markup are all a broken file
                    meta, found, error = {}, [], f"{type(e).__name__}: {e}"
                metas.append(list(meta.items()))
                parts.append(found)
                errors.append(error)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(metas, pa.map_(pa.string(), pa.string())), pa.array(parts, pa.list_(part)), pa.array(errors, pa.string())],
                ["path", "meta", "files", "error"],
            )

    read = source.mapInArrow(run, f"path string, meta map<string,string>, files array<struct<title:string,level:int,blocks:{BLOCK_DDL}>>, error string")
    every = F.flatten(F.transform("files", lambda f: sections_of_blocks(f["blocks"], f["title"], f["level"])))
    read = settled(read, "__every", every)
    return read.select("path", "meta", F.element_at("meta", "title").alias("title"), clean_sections(F.col("__every")).alias("sections"), "error")


def own_text(docs: DataFrame, title_col: str, text_col: str) -> DataFrame:
    """SRC30: texts typed in as documents with a file name made from their title."""
    name = let(strip(F.regexp_replace(title_col, r"[^\p{L}\p{N}_ -]", "")), lambda n: F.when(n == "", "text").otherwise(F.substring(n, 1, 80)))
    return docs.withColumn("file_name", F.concat(name, F.lit(".md"))).where(strip(F.col(text_col)) != "")
