"""Smaller queries of a library over the driver tables: known rows, works with open jobs, hits by kind of work, paging totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import listing as o
from ..operators import merge as m
from .listing_queries import JOBS, jobs
from .tables import table


def flt_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT12: hits by kind of work: documents have no times, other works no section; a missing topic is the section's title."""
    docs, events = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "event_type", "value")
    both = docs.select("doc_id", "lang", "source").join(events, "doc_id", "left")
    is_video = (F.col("doc_id") % 2 == 0) & F.col("event_type").isNotNull()
    topic = F.when(F.col("doc_id") % 3 == 0, F.col("event_type")).otherwise("")
    return both.select(
        "doc_id", F.when(is_video, "video").otherwise("document").alias("kind"), F.when(is_video, F.col("value")).otherwise(0.0).alias("start"),
        F.when(is_video, "").otherwise(F.col("lang")).alias("section"),
        F.when(is_video | (F.coalesce(topic, F.lit("")) != ""), F.coalesce(topic, F.lit(""))).otherwise(F.col("lang")).alias("topic"),
    )


def flt_deselected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT14: hits without those the user has taken out."""
    hits = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return hits.where(~F.col("vec_id").isin(1, 5, 8, 13)).where("label = 1")


def flt_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT16: new sources that exist already, by nation and segment."""
    existing = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("base"), F.col("c_mktsegment").alias("channel")).distinct()
    wanted = table(spark, sf_dir, "customer").where("c_custkey % 2 = 1").select("c_custkey", F.col("c_nationkey").alias("base"), F.col("c_mktsegment").alias("channel"))
    return wanted.join(existing, ["base", "channel"], "left_semi").select("c_custkey")


def jon_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON03: jobs with their work's title, those of unknown works too."""
    works = table(spark, sf_dir, "customer").where("c_custkey % 5 > 0").select(F.col("c_custkey").alias("work_id"), F.col("c_name").alias("title"))
    return jobs(spark, sf_dir).join(works, "work_id", "left").select("job_id", F.coalesce("title", F.lit("")).alias("title"))


def jon_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON04: items of the orders that are selected."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(orders, "l_orderkey")


def jon_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON07: a preview's rows and whether the library has them."""
    known = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("known", F.lit(True))
    return table(spark, sf_dir, "customer").join(known, "c_custkey", "left").select("c_custkey", F.coalesce("known", F.lit(False)).alias("known"))


def jon_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON08: current summaries of the works that the hits are from, each once."""
    hits = table(spark, sf_dir, "embeddings").where("label = 2").select(F.col("vec_id").alias("doc_id"))
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").join(hits, "doc_id", "left_semi")
    return docs.select("doc_id", t.shorten(F.col("text"), 60).alias("summary"))


def jon_open_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON13: works of either kind with an open job."""
    rows = jobs(spark, sf_dir).where(F.col("status").isin(*o.OPEN_STATES))
    video = F.when(F.col("job_id") % 2 == 0, F.col("work_id"))
    document = F.when(F.col("job_id") % 2 > 0, F.col("work_id") + 1000)
    return rows.select(F.coalesce(video, document).alias("work_id")).distinct()


def agg_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG11: a page with the total of the filtered rows, counted beside it."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    shown = o.page(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 1, 10).select("o_orderkey")
    return shown.join(F.broadcast(total))  # one row


def top_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP10: newest works first, those without a date last, then the items' own order."""
    dated = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate")).alias("published"))
    items = table(spark, sf_dir, "lineitem").join(dated, "l_orderkey", "left")
    order = [F.desc_nulls_last("published"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return items.orderBy(*order).limit(60).select("l_orderkey", "l_linenumber", "l_partkey")


def top_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP12: topics in a fixed order first, the others by name."""
    fixed = F.array(F.lit("MACHINERY"), F.lit("BUILDING"))
    place = F.nullif(F.array_position(fixed, F.col("topic")), F.lit(0))
    topics = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return topics.withColumn("place", place).orderBy(F.asc_nulls_last("place"), "topic")


def flt_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT15: suppliers as servers of tools, their customers' segments as what was discovered there."""
    made = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("segments"))
    discovered = F.transform("segments", lambda s, i: F.struct(
        F.when(i == 3, "").otherwise(F.lower(s)).alias("name"), F.when(i == 1, F.initcap(s)).alias("title"), F.when(i == 2, F.col("s_suppkey") % 2 == 0).alias("active")))
    servers = table(spark, sf_dir, "supplier").join(made, F.col("s_nationkey") == F.col("c_nationkey")).select(
        F.concat(F.lit("s"), "s_suppkey").alias("server_id"), F.col("s_name").alias("title"), (F.col("s_suppkey") % 3 > 0).alias("active"), F.col("s_suppkey").alias("created"), discovered.alias("discovered")
    )
    return o.usable_tools(servers).select("tool_id", "name", "title", "created", "place")


def flt_discarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT18: line items as compared blocks, of which some are not known to be discarded."""
    blocks = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linestatus") == "F", F.col("l_returnflag") == "R").alias("discarded"))
    return o.toggleable(blocks).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("parts"))


def mrg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC28: customers' sound, of every third made anew in a way that some of them don't say."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("work_id"), F.col("c_mktsegment").alias("format"), (F.col("c_custkey") % 50 + 0.5).alias("duration_s"))
    way = lambda n: F.element_at(F.array(*map(F.lit, m.WAYS)), (F.col("work_id") % n % 3 + 1).cast("int"))
    old = rows.where("work_id % 4 > 0").withColumn("way", way(7))
    made = rows.where("work_id % 3 = 0").withColumns({"format": F.lit("opus"), "duration_s": F.col("duration_s") * 2, "way": F.when(F.col("work_id") % 2 == 0, way(5))})
    return m.acquired(old, made, ["format", "duration_s"])


QUERIES = {
    f.__name__: f
    for f in (
    flt_tools, flt_discarded, mrg_audio,
        flt_hits, flt_deselected, flt_duplicates, jon_titles, jon_selected, jon_known, jon_summaries, jon_open_works, agg_total, top_works, top_topics,
    )
}

ORACLE = {
    "flt_tools": """
WITH n AS (SELECT c_nationkey, list_sort(list_distinct(list(c_mktsegment))) AS g FROM customer GROUP BY 1),
e AS (SELECT s_suppkey, s_name, unnest(g) AS seg, generate_subscripts(g, 1) - 1 AS i FROM supplier JOIN n ON c_nationkey = s_nationkey WHERE s_suppkey % 3 > 0)
SELECT 's' || s_suppkey || ':' || lower(seg) AS tool_id, regexp_replace(trim(regexp_replace(lower(s_name || '_' || seg), '[^a-z0-9]+', '_', 'g'), '_'), '_+', '_', 'g') AS name,
  s_name || ': ' || CASE WHEN i = 1 THEN upper(seg[1]) || lower(seg[2:]) ELSE lower(seg) END AS title, s_suppkey AS created, i::INT AS place FROM e WHERE i <> 3 AND (i <> 2 OR s_suppkey % 2 = 0)""",
    "flt_discarded": "SELECT l_orderkey, count(*) AS n, sum(l_partkey)::BIGINT AS parts FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R' GROUP BY 1",
    "mrg_audio": """
WITH c AS (SELECT c_custkey AS k, c_mktsegment AS f, c_custkey % 50 + 0.5 AS d, CASE WHEN c_custkey % 4 > 0 THEN ['stream', 'source', 'file'][c_custkey % 7 % 3 + 1] END AS w FROM customer)
SELECT k AS work_id, CASE WHEN k % 3 = 0 THEN 'opus' ELSE f END AS format, (CASE WHEN k % 3 = 0 THEN d * 2 ELSE d END)::DOUBLE AS duration_s,
  CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN ['stream', 'source', 'file'][k % 5 % 3 + 1] ELSE w END AS way FROM c WHERE k % 3 = 0 OR k % 4 > 0""",
    "flt_hits": """
WITH b AS (SELECT doc_id, lang, event_type, value, doc_id % 2 = 0 AND event_type IS NOT NULL AS v, CASE WHEN doc_id % 3 = 0 THEN coalesce(event_type, '') ELSE '' END AS t
  FROM documents LEFT JOIN events ON event_id = doc_id)
SELECT doc_id, CASE WHEN v THEN 'video' ELSE 'document' END AS kind, CASE WHEN v THEN value ELSE 0 END AS start, CASE WHEN v THEN '' ELSE lang END AS section,
  CASE WHEN v OR t <> '' THEN t ELSE lang END AS topic FROM b""",
    "flt_deselected": "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (1, 5, 8, 13) AND label = 1",
    "flt_duplicates": """SELECT c_custkey FROM customer WHERE c_custkey % 2 = 1 AND (c_nationkey, c_mktsegment) IN (SELECT (c_nationkey, c_mktsegment) FROM customer WHERE c_custkey % 2 = 0)""",
    "jon_titles": f"WITH {JOBS} SELECT job_id, coalesce(c_name, '') AS title FROM j LEFT JOIN customer ON c_custkey = work_id AND c_custkey % 5 > 0",
    "jon_selected": """SELECT l_orderkey, l_linenumber, l_partkey, o_totalprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND o_totalprice > 300000""",
    "jon_known": "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS known FROM customer",
    "jon_summaries": r"""SELECT doc_id, CASE WHEN length(c) <= 60 THEN c ELSE rtrim(substr(c, 1, 60)) || ' ...' END AS summary
FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents WHERE lang = 'en' AND doc_id IN (SELECT vec_id FROM embeddings WHERE label = 2))""",
    "jon_open_works": f"""WITH {JOBS} SELECT DISTINCT CASE WHEN job_id % 2 = 0 THEN work_id ELSE work_id + 1000 END AS work_id FROM j WHERE status IN ('running', 'waiting')""",
    "agg_total": """SELECT o_orderkey, total FROM (SELECT o_orderkey, count(*) OVER () AS total, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders
WHERE o_orderstatus = 'O') WHERE n BETWEEN 11 AND 20""",
    "top_works": """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
ORDER BY CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey LIMIT 60""",
    "top_topics": """SELECT c_mktsegment AS topic, count(*) AS n, CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 END::BIGINT AS place FROM customer GROUP BY 1""",
}
