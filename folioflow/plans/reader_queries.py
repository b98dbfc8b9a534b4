"""Media folders, typed-in texts, listings and refreshed vectors over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import listing as o
from ..operators import merge as m
from ..sources import documents as d
from ..sources import files as f
from .tables import table


def src_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC05, SRC06, SRC09: parts as media files; of four one has two sidecars, one a broken, one a short one and one none."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    stem = F.concat(F.lit("part_"), k)
    media = part.select(F.concat(stem, F.lit(".mp4")).alias("rel"), F.concat(stem, F.lit(".mp4")).alias("name"), F.lit("2024-01-01").cast("timestamp").alias("modified"))
    full = F.to_json(F.struct(
        F.col("p_name").alias("title"), F.lit("20240102").alias("upload_date"), F.col("p_size").cast("string").alias("duration"),
        F.array(F.lit("a"), F.lit(" "), F.col("p_brand")).alias("tags"), F.col("p_brand").alias("uploader"), F.lit("u").alias("url")))
    info = part.where(k % 4 == 0).select(F.concat(stem, F.lit(".info.json")).alias("rel"), full.alias("json"))
    short = F.when(k % 4 == 1, "{broken").otherwise('{"titel": "Other"}')
    found = f.videos(f.with_sidecars(media, info.union(part.where(k % 4 < 3).select(F.concat(stem, F.lit(".json")), short))))
    return found.select("extern_id", "title", F.unix_seconds("published").alias("published"), "duration_s", F.array_join("tags", ",").alias("tags"), "channel", "url", "kind")


def src_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC27: parts as files of three folders and of none."""
    folder = F.element_at(F.array(*map(F.lit, ("audio/", "video/sub/", "cache/", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return f.sizes(table(spark, sf_dir, "part").select(F.concat(folder, "p_name").alias("rel"), F.col("p_size").cast("long").alias("bytes")), ["audio", "video"])


def src_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC22: names of parts as fetched files; of five one is missing, one of another size and one of another content."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    own = part.where(k % 5 > 0).select(k.alias("path"), F.encode("p_name", "utf-8").alias("content"))
    size = F.octet_length("p_name") + F.when(k % 5 == 1, 1).otherwise(0)
    told = part.select(k.alias("path"), size.alias("bytes"), F.sha2(F.when(k % 5 == 2, "x").otherwise(F.col("p_name")), 256).alias("sha256"))
    return f.verified(own, told).select("path", "error")


def src_own_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC30: parts as typed-in texts, every seventh without any."""
    text = F.when(F.col("p_partkey") % 7 == 0, " \n").otherwise(F.col("p_type"))
    title = F.when(F.col("p_partkey") % 5 == 0, "?!").otherwise(F.concat("p_name", F.lit(" / "), "p_brand"))
    return d.own_text(table(spark, sf_dir, "part").select("p_partkey", title.alias("title"), text.alias("text")), "title", "text").select("p_partkey", "file_name")


def flt_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT02, FLT03, FLT10, FLT17: orders by words, state and least stage; one predicate is not given."""
    stage = F.element_at(F.array([F.lit(s) for s in o.VIDEO_STAGES]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", stage.alias("stage"))
    reached = o.stage_index(F.col("stage")) >= o.stage_index(F.lit("transcribed"))
    return o.where_all(rows, o.contains(F.col("o_orderpriority"), "urg"), None, F.col("o_orderstatus").isin("O", "P"), reached).select("o_orderkey", "stage")


def flt_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT07, FLT08: a question's own limit, else its conversation's, else the default; 0 is a limit."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", o.layered(F.when(k % 3 == 0, k * 0), F.when(k % 2 == 0, k % 10), F.lit(30)).cast("long").alias("most"))


def mrg_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG07: vectors of every fourth part made anew by one family of models; the other family's stay."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"))
    old = part.select("chunk_id", F.explode(F.array(F.lit("bge-m3"), F.lit("e5"))).alias("family"), F.lit(1).alias("version"))
    new = part.where("chunk_id % 4 = 0").select("chunk_id", F.lit("bge-m3").alias("family"), F.lit(2).alias("version"))
    return m.replace_children(old, new, ["chunk_id", "family"])


QUERIES = {q.__name__: q for q in (src_videos, src_sizes, src_verified, src_own_text, flt_listing, flt_layers, mrg_refresh)}

ORACLE = {
    "src_videos": """
SELECT 'datei-' || substr(sha1('part_' || p_partkey || '.mp4'), 1, 20) AS extern_id, CASE WHEN n = 0 THEN p_name WHEN n = 2 THEN 'Other' ELSE 'part ' || p_partkey END AS title,
  CASE WHEN n = 0 THEN 1704153600 ELSE 1704067200 END AS published, CASE WHEN n = 0 THEN p_size::INT END AS duration_s, CASE WHEN n = 0 THEN 'a,' || p_brand ELSE '' END AS tags,
  CASE WHEN n = 0 THEN p_brand ELSE '' END AS channel, CASE WHEN n = 0 THEN 'u' ELSE '' END AS url, 'video' AS kind FROM (SELECT *, p_partkey % 4 AS n FROM part)""",
    "src_sizes": """
SELECT CASE p_partkey % 4 WHEN 0 THEN 'audio' WHEN 1 THEN 'video' ELSE 'other' END AS area, count(*) AS n, sum(p_size)::BIGINT AS bytes FROM part GROUP BY 1""",
    "src_verified": """
SELECT p_partkey AS path, CASE p_partkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'size' WHEN 2 THEN 'checksum' END AS error FROM part""",
    "src_own_text": r"""
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'text' ELSE substr(trim(regexp_replace(p_name || ' / ' || p_brand, '[^\p{L}\p{N}_ -]', '', 'g')), 1, 80) END || '.md' AS file_name
FROM part WHERE p_partkey % 7 > 0""",
    "flt_listing": """
SELECT o_orderkey, ['discovered', 'audio', 'transcribed', 'corrected', 'chunked', 'embedded'][o_orderkey % 6 + 1] AS stage FROM orders
WHERE o_orderpriority ILIKE '%urg%' AND o_orderstatus IN ('O', 'P') AND o_orderkey % 6 >= 2""",
    "flt_layers": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 2 = 0 THEN c_custkey % 10 ELSE 30 END::BIGINT AS most FROM customer",
    "mrg_refresh": """
SELECT p_partkey AS chunk_id, family, CASE WHEN family = 'bge-m3' AND p_partkey % 4 = 0 THEN 2 ELSE 1 END AS version FROM part, (VALUES ('bge-m3'), ('e5')) v(family)""",
}
