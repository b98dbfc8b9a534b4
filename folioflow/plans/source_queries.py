"""Readers over the driver tables, with their SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import documents as d
from ..sources import files as f
from ..sources import package as p
from ..shared import cut, remove_folder, shared_folder
from .tables import table


def src_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC17, SRC19: documents as plain text, their one section placed."""
    rows = d.read_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "title", F.size("sections").alias("n"), F.md5(F.get("sections", F.lit(0))["text"]).alias("text"))


def src_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC16: documents with every fifth line as a heading and a front matter, read as Markdown."""
    lines = F.transform(F.split("text", "\n"), lambda s, i: F.when(i % 5 == 1, F.concat(F.lit("## "), s)).otherwise(F.concat(s, F.lit("\n"))))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('---\nTitle: "T"\ndate: 20240301\n---\n'), F.array_join(lines, "\n")).alias("text"))
    rows = d.read_markdown(docs)
    return rows.select("doc_id", "title", F.unix_seconds("published").alias("published"), F.size("sections").alias("n"), F.md5(F.to_json("sections")).alias("sections"))


def src_xhtml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12, SRC15: pages' blocks as sections."""
    rows = d.xhtml_blocks(table(spark, sf_dir, "pages"), "page_id", "html")
    s = d.sections_of_blocks(F.col("blocks"), F.lit(""))
    return rows.select("page_id", F.size("blocks").alias("n_blocks"), F.size(s).alias("n_sections"), F.md5(F.to_json(s)).alias("sections"))


def src_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC03, SRC04, SRC18 over made-up file names of parts."""
    ending = F.element_at(F.array(*map(F.lit, ("epub", "MD", "txt"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("__")), F.lit("_"), "p_partkey", F.lit("."), ending)
    return table(spark, sf_dir, "part").select("p_partkey", f.file_id(F.concat("p_type", F.lit("/"), name)).alias("id"), f.title_from_name(name).alias("title"), d.kind_of(name).alias("kind"))


def src_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC29: files and totals of each source."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").cast("long").alias("chars"))


def snk_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK01, SNK02, SRC20: tables written as a package and read again, counted by the manifest."""
    folder = shared_folder(spark, "package")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 8)).alias("vector"))
    p.write_package({"documents": docs, "embeddings": vectors}, folder, 64)
    counted = p.manifest(spark, folder).select(F.explode("tables").alias("t")).select("t.name", "t.rows")
    read = p.read_table(spark, folder, "documents", docs.schema)
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "source", "text")), 1, 12), 16, 10).cast("long")
    again = read.agg(F.sum(F.length("text")).cast("long").alias("chars"), F.sum(hashed.cast("decimal(30,0)")).cast("string").alias("hashes"))
    found = cut(counted.join(again))  # one row
    remove_folder(spark, folder)
    return found


QUERIES = {q.__name__: q for q in (src_text, src_markdown, src_xhtml, src_names, src_channel, snk_package)}

_WHITE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+"

_STRIP = rf"regexp_replace(regexp_replace(X, '^{_WHITE}', ''), '{_WHITE}$', '')"

ORACLE = {
    "src_text": rf"""
WITH d AS (SELECT doc_id, {_STRIP.replace("X", "replace(text, chr(13) || chr(10), chr(10))")} AS t FROM documents),
p AS (SELECT doc_id, coalesce(rtrim(substr(list_filter(list_transform(string_split(t, chr(10)), lambda l: {_STRIP.replace("X", "l")}), lambda l: l <> '')[1], 1, 80), ' '), 'Text') AS title,
  array_to_string(list_filter(list_transform(string_split_regex(t, '\n\s*\n'), lambda x: {_STRIP.replace("X", f"regexp_replace(x, '{_WHITE}', ' ', 'g')")}), lambda x: x <> ''), chr(10) || chr(10)) AS body FROM d)
SELECT doc_id, title, (length(body) >= 20)::INT AS n, CASE WHEN length(body) >= 20 THEN md5(body) END AS text FROM p""",
    "src_names": """
WITH n AS (SELECT p_partkey, p_type, replace(p_name, ' ', '__') || '_' || p_partkey AS s, ['epub', 'MD', 'txt'][p_partkey % 3 + 1] AS e FROM part)
SELECT p_partkey, 'datei-' || substr(sha1(p_type || '/' || s || '.' || e), 1, 20) AS id, regexp_replace(replace(s, '_', ' '), ' +', ' ', 'g') AS title,
  CASE e WHEN 'epub' THEN 'epub' WHEN 'MD' THEN 'markdown' ELSE 'text' END AS kind FROM n""",
    "src_channel": "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1",
    "snk_package": """
WITH s AS (SELECT sum(length(text))::BIGINT AS chars, sum(('0x' || substr(md5(doc_id || '|' || source || '|' || text), 1, 12))::BIGINT)::VARCHAR AS hashes FROM documents)
SELECT 'documents' AS name, (SELECT count(*) FROM documents) AS rows, chars, hashes FROM s
UNION ALL SELECT 'embeddings', (SELECT count(*) FROM embeddings), chars, hashes FROM s""",
}
