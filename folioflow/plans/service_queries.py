"""Listings and packages that come from outside: pages of a service, archives, handovers, resumed downloads, with their SQL."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, remove_folder, shared_folder, store_of
from ..sources import archive as a
from ..sources import handover as h
from ..sources import paged, ranges
from ..sources.documents import read_epub
from ..sources.files import endings, model_files, scan, verified, with_artwork
from ..sources.package import FORMAT
from .tables import table

#: Entries that a page has, and how many of them the page before had.
SIZE, AGAIN = 20, 3
#: Bytes of a handover's parts, and of a range of a member.
PART, RANGE = 100_000, 50_000


def serve_pages(spark: SparkSession, sf_dir: str, folder: str, broken: bool) -> None:
    """The pages table as a service's answers: overlapping pages of ``SIZE``, whatever size is asked for.

    A broken service gives its third page again as the fourth and counts itself one entry larger than it is.
    """
    rows = table(spark, sf_dir, "pages")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    step = SIZE - AGAIN
    own = F.floor(F.col("page_id") / step).cast("int") + 1
    head = (F.col("page_id") % step < AGAIN) & (own > 1)
    pages = F.when(head, F.array(own, own - 1)).otherwise(F.array(own))
    pages = F.when(own == 3, F.concat(pages, F.array(F.lit(4)))).otherwise(pages) if broken else pages
    placed = rows.select("page_id", "url", F.explode(pages).alias("page")).join(total)  # one row
    placed = placed.where((F.col("page") != 4) | (own == 3)) if broken else placed
    entry = F.struct(F.concat(F.lit("v"), "page_id").alias("id"), F.col("url").alias("title"))
    listed = placed.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("page_id", entry.alias("e")))).alias("es"), F.max("total").alias("total"))
    answer = F.to_json(F.struct(F.col("es.e").alias("videos"), (F.col("total") + F.lit(int(broken))).alias("total"), F.col("page")))
    listed.select("page", answer.alias("value")).repartition("page").write.partitionBy("page").text(folder)


def src_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC08, SRC10: all entries of a service, where they first came, beside what its pages brought; a broken one's error."""
    found = []
    for broken in (False, True):
        folder = shared_folder(spark, "service")
        serve_pages(spark, sf_dir, folder, broken)
        try:
            rows, pages = paged.drain(spark, folder + "/page={page}", "id", size=50)
            rows = rows.select(F.lit("whole").alias("service"), F.substring("id", 2, 20).cast("long").alias("page_id"), "page", F.get_json_object("entry", "$.title").alias("title"))
            found.append(rows.withColumns({"error": F.lit(None).cast("string"), "pages": F.lit(len(pages))}))
        except paged.PagedError as e:
            one = spark.range(1).select(F.lit("broken").alias("service"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("title"))
            found.append(one.withColumns({"error": F.lit(str(e)), "pages": F.lit(None).cast("int")}))
        remove_folder(spark, folder)  # the entries are in a checkpoint by now
    return found[0].unionByName(found[1])


def current_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of customers' texts, the latest of each customer the current one."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    last = orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("last"))
    return orders.join(last, "o_custkey").withColumn("current", F.col("o_orderkey") == F.col("last")).drop("last", "o_orderdate")


def snk_handover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK02, SNK07: customers and their current orders as a handover; rows and bytes by table, parts and files read back."""
    folder = shared_folder(spark, "handover")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    tables = [h.Table("customers", customers, ["c_custkey"]), h.Table("orders", current_orders(spark, sf_dir), ["o_orderkey"], "current")]
    manifest = h.write_handover(tables, folder, 64, part_bytes=PART)
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    stored = stored.select(F.substring_index("path", folder.rpartition("/")[2] + "/", -1).alias("path"), "content")
    checked = cut(verified(stored, h.read_manifest(spark, folder)))
    tabled = F.when(F.col("path").endswith(".tar"), "parts").otherwise(a.table_of(F.col("path")))
    sums = checked.groupBy(tabled.alias("name")).agg(F.sum("bytes").alias("bytes"), F.count("error").alias("n_errors"))
    line = lambda x: F.struct(F.lit(x[0]).alias("name"), F.lit(x[1]).cast("long").alias("rows"))
    counts = spark.range(1).select(F.explode(F.array(*map(line, manifest["rows"].items()))).alias("c")).select("c.*")  # two rows
    found = counts.join(sums, "name").select("name", "rows", "bytes", "n_errors")
    parts = sums.where("name = 'parts'").select("name", F.lit(None).cast("long").alias("rows"), F.lit(None).cast("long").alias("bytes"), "n_errors")
    found = cut(found.unionByName(parts))
    remove_folder(spark, folder)
    return found


def src_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC21: documents and vectors as archives, read by ranges of their members; what is wrong with one in another order."""
    folder, other = shared_folder(spark, "handover"), shared_folder(spark, "handover")
    docs = h.Table("documents", table(spark, sf_dir, "documents").select("doc_id", "text", "source"), ["doc_id"])
    vectors = h.Table("embeddings", table(spark, sf_dir, "embeddings").select("vec_id", "label"), ["vec_id"])
    parts = [f"{folder}/{p['name']}" for p in h.write_handover([docs, vectors], folder, 64, PART)["parts"]]
    swapped = [f"{other}/{p['name']}" for p in h.write_handover([vectors, docs], other, 64, 1 << 40)["parts"]]
    rows = a.lines(spark, parts, width=RANGE).withColumn("table", a.table_of(F.col("member")))
    row = F.from_json("line", "doc_id long, text string, source string, vec_id long, label long")
    key = F.when(F.col("table") == "documents", F.concat_ws("|", row["doc_id"].cast("string"), row["source"], row["text"])).otherwise(F.concat_ws("|", row["vec_id"].cast("string"), row["label"].cast("string")))
    hashed = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("decimal(30,0)")
    found = rows.groupBy("table").agg(F.count(F.lit(1)).alias("n"), F.sum(hashed).cast("string").alias("hashes"))
    errors = a.order_errors(a.members(spark, swapped), {"embeddings": "documents"})
    bad = errors.select(F.lit("swapped").alias("table"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("hashes"), "error")
    found = cut(found.withColumn("error", F.lit(None).cast("string")).unionByName(bad))
    remove_folder(spark, folder)
    remove_folder(spark, other)
    return found


def src_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC22: documents' bytes received in overlapping ranges; the requests that are left, and the files after these."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "utf-8").alias("whole"))
    files = docs.select("path", F.length("whole").cast("long").alias("bytes"), F.sha2("whole", 256).alias("sha256"))

    def cut_out(asked: DataFrame) -> DataFrame:
        """The bytes asked for, as a server of these files answers."""
        content = F.substring(F.col("whole"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
        return asked.join(docs, "path").select("path", "id", "start", "end", content.alias("content"))

    tries = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
    start = (F.col("path") * 7919 + F.col("k") * 104729) % F.col("bytes")
    first = tries.select("path", F.col("k").cast("string").alias("id"), start.alias("start"), F.least(start + 1 + (F.col("path") * 31 + F.col("k") * 977) % (F.floor(F.col("bytes") / 3) + 1), "bytes").alias("end"))
    asked = cut(ranges.missing(first, files, 1000))
    second = asked.select("path", F.concat(F.lit("m"), "start").alias("id"), "start", "end")
    whole = ranges.assembled(ranges.pieces(cut_out(first.unionByName(second))))
    checked = verified(whole, files.where("bytes > 0"))
    sums = asked.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.sum(F.col("end") - F.col("start")).alias("missing"))
    return checked.join(sums, "path", "left").select("path", "bytes", "error", F.coalesce("n", F.lit(0)).alias("n"), "first", F.coalesce("missing", F.lit(0)).alias("missing"))


def snk_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK08: parts as files of a model store: snapshots of two revisions, refs for some folders, stores and other files."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    model = F.concat(F.lit("hub/models--"), F.replace("p_brand", F.lit("#"), F.lit("--")))
    revision = F.concat(F.lit("r"), (key % 3).cast("string"))
    place = F.when(key % 7 == 0, F.concat(model, F.lit("/blobs/"))).when(key % 7 == 1, F.concat(model, F.lit("/refs/"))).when(key % 7 == 2, F.concat(F.lit("plain/"), "p_type", F.lit("/")))
    rel = F.concat(F.coalesce(place, F.concat(model, F.lit("/snapshots/"), revision, F.lit("/"))), F.lit("f"), key.cast("string"))
    files = part.select(rel.alias("rel"), key.alias("modified"))
    refs = part.where("p_brand < 'Brand#2'").select(model.alias("folder"), F.lit("r1\n").alias("revision")).distinct()
    return model_files(files, refs).select("rel")


def write_files(rows: DataFrame, folder: str) -> None:
    """Rows (rel, content) as files below a folder; each task writes its own, again the same if it is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rel, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, top = store_of(folder)  # names need not be parts of a URI
                place = f"{top}/{rel}"
                store.create_dir(place.rpartition("/")[0], recursive=True)
                with store.open_output_stream(place) as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["rel"])

    rows.select("rel", "content").mapInArrow(run, "rel string").write.format("noop").mode("overwrite").save()


def src_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC01, SRC02: parts' names by type and brand as files of several endings, some hidden; those of two endings, listed."""
    folder = shared_folder(spark, "media")
    part = table(spark, sf_dir, "part")
    names = part.groupBy("p_type", "p_brand").agg(F.sort_array(F.collect_list(F.concat_ws(":", F.col("p_partkey").cast("string"), "p_name"))).alias("n"))
    number = F.substring_index("p_brand", "#", -1).cast("int")
    ending = F.element_at(F.array(*map(F.lit, ("mp4", "M4A", "txt", "tar.mp3"))), (number % 4 + 1).cast("int"))
    hidden = F.when(number % 5 == 0, ".").otherwise("")
    rel = F.concat(F.lower("p_type"), F.lit("/"), hidden, F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lit("."), ending)
    write_files(names.select(rel.alias("rel"), F.encode(F.array_join("n", "\n"), "utf-8").alias("content")), folder)
    found = scan(spark, folder, endings(" .MP4, m4a,,mp3 "))
    listed = cut(found.select("rel", "stem", "ending", "bytes"))
    remove_folder(spark, folder)
    return listed


#: The frame of an EPUB file.
CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>'
OPF = (
    '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{title}</dc:title><dc:creator>{creator}</dc:creator>'
    '<dc:language>{language}</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>{items}</manifest><spine>{spine}</spine></package>'
)


def book(doc: int, lang: str, source: str, chapters: list[list[str]]) -> bytes:
    """An EPUB of chapters of lines: titles in the contents alone, every third chapter below the one before."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        put = lambda name, text: z.writestr(zipfile.ZipInfo(name), text)
        put("META-INF/container.xml", CONTAINER)
        n = range(1, len(chapters) + 1)
        items = "".join(f'<item id="c{i}" href="text/c%20{i}.xhtml" media-type="application/xhtml+xml"/>' for i in n)
        put("OPS/book.opf", OPF.format(title=f"Book {doc}", creator=source, language=lang, items=items, spine="".join(f'<itemref idref="c{i}"/>' for i in n)))
        entries = [f'<li><a href="text/c%20{i}.xhtml">Chapter {i}</a>' for i in n]
        nested = "".join(f"<ol>{e}</li></ol></li>" if i % 3 == 0 else e + ("" if i % 3 == 2 and i < len(chapters) else "</li>") for i, e in zip(n, entries, strict=True))
        put("OPS/nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml"><body><nav><ol>{nested}</ol></nav></body></html>')
        for i, lines in zip(n, chapters, strict=True):
            body = "".join(f"<p>{escape(x)}</p>" for x in lines)
            put(f"OPS/text/c {i}.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml"><head><style>p {{}}</style></head><body>{body}</body></html>')
    return data.getvalue()


def src_epub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC11, SRC13, SRC14: documents as EPUB files of chapters of four lines, read as sections; every seventh file is damaged."""

    def bind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, lang, source in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                lines = text.split("\n")
                raw = book(doc, lang, source, [lines[i : i + 4] for i in range(0, len(lines), 4)])
                yield pa.RecordBatch.from_arrays([pa.array([str(doc)]), pa.array([raw[: len(raw) // 2] if doc % 7 == 0 else raw], pa.binary())], ["path", "content"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    read = read_epub(docs.mapInArrow(bind, "path string, content binary"))
    shown = F.transform("sections", lambda s: F.concat_ws("/", s["level"].cast("string"), s["title"], s["text"]))
    return read.select(
        F.col("path").cast("long").alias("doc_id"), "title", F.element_at("meta", "creator").alias("creator"), F.element_at("meta", "language").alias("language"),
        F.size("sections").alias("n"), F.md5(F.array_join(shown, "|")).alias("sections"), F.col("error").isNotNull().alias("broken"),
    )


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as media files (rel, duration_s)."""
    rel = F.concat(F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), F.col("p_partkey").cast("string"), F.lit(".mp4"))
    return table(spark, sf_dir, "part").select("p_partkey", rel.alias("rel"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_size") * 9.0).alias("duration_s"))


def src_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC07: the third page of a folder's files in the order of their paths."""
    return paged.page_of(part_files(spark, sf_dir).select("rel"), [F.lower("rel"), F.col("rel")], 3, 20)


def src_artwork(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC31: parts' pictures, of some two or of another kind, or the place of a frame."""
    media = part_files(spark, sf_dir)
    base, k = F.regexp_replace("rel", r"\.mp4$", ""), F.col("p_partkey") % 5
    kinds = F.when(k == 0, F.array(F.lit(".webp"), F.lit(".jpeg"))).when(k == 1, F.array(F.lit(".gif"))).when(k == 2, F.array(F.lit(".png"))).otherwise(F.array().cast("array<string>"))
    pictures = media.select(F.explode(F.transform(kinds, lambda e: F.concat(base, e))).alias("rel"))
    return with_artwork(media, pictures).select("p_partkey", "artwork", F.round("frame_s", 3).alias("frame_s"))


def top_handovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP14: a handover for each nation, some manifests broken or of another format, newest first."""
    folder = shared_folder(spark, "handovers")
    nations = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first"))
    created = F.date_format(F.timestamp_seconds(1_700_000_000 + F.col("n") * 86_400), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    form = F.when(F.col("c_nationkey") % 6 == 5, "other").otherwise(FORMAT)
    parts = F.transform(F.sequence(F.lit(1), F.col("n") % 3 + 1), lambda i: F.struct(F.concat(F.lit("part-"), i.cast("string")).alias("name")))
    manifest = F.to_json(F.struct(form.alias("format"), F.lit(1).alias("version"), created.alias("created"), parts.alias("parts")))
    content = F.when(F.col("c_nationkey") % 4 == 3, F.substring(manifest, 1, 30)).otherwise(manifest)
    write_files(nations.select(F.concat(F.lit("h"), F.col("c_nationkey").cast("string"), F.lit("/manifest.json")).alias("rel"), F.encode(content, "utf-8").alias("content")), folder)
    found = h.handovers(spark, folder).select(F.element_at(F.split("path", "/"), -2).alias("name"), F.unix_seconds("created").alias("created"), "version", "n_parts")
    listed = cut(found)
    remove_folder(spark, folder)
    return listed


QUERIES = {f.__name__: f for f in (src_paged, snk_handover, src_archive, src_resumed, snk_models, src_scan, src_epub, src_page, src_artwork, top_handovers)}

ORACLE = {
    "src_paged": f"""
WITH p AS (SELECT page_id, url, page_id // {SIZE - AGAIN} + 1 AS own FROM pages),
f AS (SELECT page_id, url, CASE WHEN page_id % {SIZE - AGAIN} < {AGAIN} AND own > 1 THEN own - 1 ELSE own END AS page FROM p)
SELECT 'whole' AS service, page_id, page, url AS title, NULL AS error, max(page) OVER () AS pages FROM f
UNION ALL SELECT 'broken', NULL, NULL, NULL, 'page 4 brings nothing new', NULL""",
    "snk_handover": """
WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1)
SELECT 'customers' AS name, count(*) AS rows, sum(strlen('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}') + 1)::BIGINT AS bytes, 0 AS n_errors FROM customer
UNION ALL SELECT 'orders', count(*), sum(strlen('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') + 1)::BIGINT, 0 FROM o
UNION ALL SELECT 'parts', NULL, NULL, 0""",
    "src_archive": """
SELECT 'documents' AS table, count(*) AS n, sum(('0x' || substr(md5(doc_id || '|' || source || '|' || text), 1, 12))::BIGINT)::VARCHAR AS hashes, NULL AS error FROM documents
UNION ALL SELECT 'embeddings', count(*), sum(('0x' || substr(md5(vec_id || '|' || label), 1, 12))::BIGINT)::VARCHAR, NULL FROM embeddings
UNION ALL SELECT 'swapped', NULL, NULL, 'embeddings stands before documents'""",
    "src_resumed": """
WITH f AS (SELECT doc_id AS path, strlen(text) AS bytes FROM documents WHERE text <> ''),
k AS (SELECT path, bytes, (path * 7919 + k * 104729) % bytes AS a, 1 + (path * 31 + k * 977) % (bytes // 3 + 1) AS n FROM f, range(1, 6) r(k)),
r AS (SELECT path, bytes, a, least(a + n, bytes) AS b FROM k UNION ALL SELECT path, bytes, bytes, bytes FROM f),
g AS (SELECT path, a AS t, coalesce(max(b) OVER (PARTITION BY path ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM r),
m AS (SELECT path, sum((t - s + 999) // 1000)::BIGINT AS n, min(s) AS first, sum(t - s)::BIGINT AS missing FROM g WHERE t > s GROUP BY path)
SELECT f.path, f.bytes, NULL AS error, coalesce(n, 0) AS n, first, coalesce(missing, 0) AS missing FROM f LEFT JOIN m USING (path)""",
    "snk_models": """
WITH p AS (SELECT p_partkey AS k, p_brand, 'hub/models--' || replace(p_brand, '#', '--') AS m, p_type FROM part),
f AS (SELECT *, CASE k % 7 WHEN 0 THEN m || '/blobs/' WHEN 1 THEN m || '/refs/' WHEN 2 THEN 'plain/' || p_type || '/' ELSE m || '/snapshots/r' || k % 3 || '/' END || 'f' || k AS rel FROM p WHERE k % 7 > 0),
n AS (SELECT m, CASE WHEN any_value(p_brand) < 'Brand#2' THEN 'r1' ELSE 'r' || arg_max(k, k) % 3 END AS r FROM f WHERE k % 7 > 2 GROUP BY m)
SELECT rel FROM f LEFT JOIN n USING (m) WHERE k % 7 < 3 OR 'r' || k % 3 = r""",
    "src_scan": """
WITH n AS (SELECT p_type, p_brand, split_part(p_brand, '#', 2)::INT AS k, sum(length(p_partkey || ':' || p_name) + 1) - 1 AS bytes FROM part GROUP BY 1, 2)
SELECT lower(p_type) || '/' || replace(p_brand, '#', ' ') || '.' || e AS rel, replace(p_brand, '#', ' ') || CASE k % 4 WHEN 3 THEN '.tar' ELSE '' END AS stem,
  lower(split_part(e, '.', -1)) AS ending, bytes::BIGINT AS bytes
FROM (SELECT *, ['mp4', 'M4A', 'txt', 'tar.mp3'][k % 4 + 1] AS e FROM n) WHERE k % 5 > 0 AND k % 4 <> 2""",
    "src_epub": r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, trim(regexp_replace(unnest(string_split(text, chr(10))), '[\s]+', ' ', 'g'), ' ') AS t FROM documents),
c AS (SELECT doc_id, i // 4 + 1 AS c, string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (t <> '') AS body FROM l GROUP BY 1, 2),
s AS (SELECT doc_id, c, CASE WHEN c % 3 = 0 THEN 2 ELSE 1 END AS level, coalesce(body, '') AS body FROM c),
k AS (SELECT *, lead(level) OVER (PARTITION BY doc_id ORDER BY c) > level AS opens FROM s),
g AS (SELECT doc_id, count(*)::INT AS n, string_agg(level || '/Chapter ' || c || '/' || body, '|' ORDER BY c) AS s FROM k WHERE length(body) >= 20 OR coalesce(opens, false) GROUP BY 1)
SELECT d.doc_id, CASE WHEN NOT broken THEN 'Book ' || d.doc_id END AS title, CASE WHEN NOT broken THEN source END AS creator, CASE WHEN NOT broken THEN lang END AS language,
  CASE WHEN broken THEN 0 ELSE coalesce(n, 0) END AS n, md5(CASE WHEN broken THEN '' ELSE coalesce(s, '') END) AS sections, broken
FROM (SELECT *, doc_id % 7 = 0 AS broken FROM documents) d LEFT JOIN g ON g.doc_id = d.doc_id""",
    "src_page": """
SELECT lower(p_type) || '/' || replace(p_name, ' ', '_') || '.' || p_partkey || '.mp4' AS rel FROM part ORDER BY lower(rel), rel LIMIT 20 OFFSET 40""",
    "src_artwork": """
WITH m AS (SELECT p_partkey, p_partkey % 5 AS k, lower(p_type) || '/' || replace(p_name, ' ', '_') || '.' || p_partkey AS b, CASE WHEN p_partkey % 7 > 0 THEN p_size * 9.0 END AS d FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN b || '.jpeg' WHEN 2 THEN b || '.png' END AS artwork, CASE WHEN k NOT IN (0, 2) THEN round(least(30, coalesce(d, 0) / 10), 3)::DOUBLE END AS frame_s FROM m""",
    "top_handovers": """
SELECT 'h' || c_nationkey AS name, 1700000000 + count(*) * 86400 AS created, 1 AS version, (count(*) % 3 + 1)::INT AS n_parts FROM customer
WHERE c_nationkey % 6 <> 5 AND c_nationkey % 4 <> 3 GROUP BY c_nationkey""",
}
