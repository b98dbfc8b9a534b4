"""Works from answer to chunk source over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as v
from ..operators import merge as m
from ..sources import package as p
from .tables import table


def seq_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ15: customers' urgent orders as corrections, others as transcripts; every seventh order has no paragraph, every fifth is old."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("work_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5 > 0).alias("current"), F.col("o_orderdate").alias("created"),
        F.when(F.col("o_orderkey") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderstatus", "o_orderpriority")).alias("paragraphs"),
    )
    urgent = F.col("id") % 3 == 0
    works = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("work_id"))
    found = m.source_of_chunks(works, orders.where(urgent), orders.where(~urgent))
    return found.select("work_id", "kind", "source_id", F.array_join("paragraphs", "|").alias("paragraphs"))


def snk_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK09: assistants' turns as answers, the line items of an order of that number as their hits."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    messages = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), F.md5("text").alias("text"))
    hits = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("message_id"), F.col("l_linenumber").cast("int").alias("rank"), F.col("l_partkey").cast("long").alias("chunk_id"),
        F.round(F.col("l_discount").cast("double"), 4).alias("score"),
    )
    rows = m.answers(messages, hits, 5)
    shown = F.transform("hits", lambda h: F.concat_ws(":", h["rank"], h["chunk_id"], F.format_string("%.2f", h["score"])))
    return rows.select("message_id", "text", F.array_join(shown, ",").alias("hits"), "parameters")


def src_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC26: made-up answers of a transcription service about parts, with entries that are no objects and numbers that are none."""
    part = table(spark, sf_dir, "part")
    one = F.format_string('{"start": %d, "end": "%d.5", "text": "%s", "words": [{"word": "%s", "start": 1}]}', "p_partkey", "p_partkey", "p_name", "p_brand")
    listed = F.concat(F.lit("["), one, F.lit(', 7, "x", {"start": "soon", "text": "'), "p_brand", F.lit('"}]'))
    answer = F.when(F.col("p_partkey") % 3 == 0, listed).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('{"segments": '), listed, F.lit("}"))).otherwise("no answer")
    each = part.select("p_partkey", F.posexplode(v.segments_of_json(answer)).alias("i", "s"))
    return each.select("p_partkey", "i", "s.start", "s.end", "s.text", F.array_join(F.transform("s.words", lambda w: w["word"]), ",").alias("words"))


def mrg_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG10: a manifest for each label of vectors and source of documents, held against what the reader expects."""
    vectors = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("string").alias("package")).agg(F.max(F.size("embedding")).alias("dimension"), F.count(F.lit(1)).alias("rows"))
    docs = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("package")).agg(F.max(F.length("lang") * 32).alias("dimension"), F.count(F.lit(1)).alias("rows"))
    every = vectors.unionByName(docs)
    form = F.when(F.col("rows") % 7 == 0, "other").otherwise(p.FORMAT)
    manifests = every.select("package", form.alias("format"), (F.col("rows") % 3).cast("int").alias("version"), (F.col("dimension") - F.when(F.col("rows") % 5 == 0, 1).otherwise(0)).alias("dimension"))
    return m.check_manifest(manifests, p.FORMAT, p.VERSION, 64).select("package", "format", "version", "dimension", "error")


QUERIES = {f.__name__: f for f in (seq_source, snk_answers, src_segments, mrg_manifest)}

ORACLE = {
    "seq_source": """
WITH o AS (SELECT o_custkey AS w, o_orderkey AS id, o_orderdate AS d, o_orderkey % 3 = 0 AS c, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderstatus || '|' || o_orderpriority END AS p
  FROM orders WHERE o_orderkey % 5 > 0),
l AS (SELECT w, c, arg_max(id, (d, id)) AS id, arg_max(p, (d, id)) AS p FROM o GROUP BY w, c),
b AS (SELECT c_custkey AS work_id, k.id AS kid, k.p AS kp, t.id AS tid, t.p AS tp FROM customer LEFT JOIN l k ON k.w = c_custkey AND k.c LEFT JOIN l t ON t.w = c_custkey AND NOT t.c)
SELECT work_id, CASE WHEN kp <> '' THEN 'correction' WHEN tid IS NOT NULL THEN 'transcript' END AS kind, CASE WHEN kp <> '' THEN kid ELSE tid END AS source_id,
  CASE WHEN kp <> '' THEN kp ELSE tp END AS paragraphs FROM b""",
    "snk_answers": """
WITH a AS (SELECT conv_id * 100 + turn AS message_id, md5(text) AS text FROM conversations WHERE role = 'assistant'),
h AS (SELECT l_orderkey AS message_id, string_agg(l_linenumber || ':' || l_partkey || ':' || printf('%.2f', l_discount::DOUBLE), ',' ORDER BY l_linenumber, l_partkey, l_discount) AS hits,
  string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_discount) AS ids, count(*) AS n FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1)
SELECT a.message_id, text, coalesce(hits, '') AS hits, '{"chunk_ids":[' || coalesce(ids, '') || '],"n":' || coalesce(n, 0) || '}' AS parameters FROM a LEFT JOIN h ON h.message_id = a.message_id""",
    "src_segments": """
SELECT p_partkey, 0 AS i, p_partkey::DOUBLE AS start, p_partkey + 0.5::DOUBLE AS end, p_name AS text, p_brand AS words FROM part WHERE p_partkey % 3 < 2
UNION ALL SELECT p_partkey, 1, 0, 0, p_brand, '' FROM part WHERE p_partkey % 3 < 2""",
    "mrg_manifest": """
WITH e AS (SELECT label::VARCHAR AS package, max(len(embedding)) AS d, count(*) AS n FROM embeddings GROUP BY 1 UNION ALL SELECT source, max(length(lang) * 32), count(*) FROM documents GROUP BY 1),
k AS (SELECT package, CASE WHEN n % 7 = 0 THEN 'other' ELSE 'folioflow-library' END AS format, (n % 3)::INT AS version, (d - (n % 5 = 0)::INT)::INT AS dimension FROM e)
SELECT *, CASE WHEN format = 'other' THEN 'not such a package' WHEN version > 1 THEN 'made by a newer version' WHEN dimension <> 64 THEN 'vectors of another dimension' END AS error FROM k""",
}
