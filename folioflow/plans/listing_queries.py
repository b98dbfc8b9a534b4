"""Listings, joins, top-k and counters over the driver tables, with their SQL.

Orders stand for videos (priority: series, status: stage), parts for chunks, events for jobs, conversations for messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import listing as o
from .tables import table

KINDS = ("click", "error", "purchase", "signup", "view", "export")
NOW = "2024-01-31 00:00:00"


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("video_id"), F.col("o_custkey").alias("work_id"), F.col("o_orderpriority").alias("series"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("published"), F.col("o_totalprice").alias("price"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs: state, progress and times follow from the event's number and value."""
    state = F.element_at(F.array(*map(F.lit, ("done", "waiting", "running", "aborted", "done"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("work_id"), F.col("event_type").alias("kind"), state.alias("status"),
        (F.col("event_id") % 3).alias("priority"), (F.col("event_id") % 100 / 100).alias("progress"), F.col("ts").alias("created"),
        (F.col("ts") + F.expr("make_dt_interval(0, 0, 0, cast(value as decimal(18, 6)))")).alias("finished"),
    )


JOBS = """j AS (SELECT event_id AS job_id, user_id AS work_id, event_type AS kind, ['done', 'waiting', 'running', 'aborted', 'done'][event_id % 5 + 1] AS status,
  event_id % 3 AS priority, event_id % 100 / 100 AS progress, ts AS created, ts + to_microseconds(round(value * 1000000)::BIGINT) AS finished FROM events)"""


def flt_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT01: text or exact id, series, state; what isn't given does not filter."""
    rows = videos(spark, sf_dir)
    found = o.where_all(rows, o.contains(F.col("series"), "r_ent") | (F.col("video_id") == 7), None, F.col("status") == "F")
    return found.select("video_id", "series", "status")


def flt_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT04: series and a period over two dates of which either may be null."""
    rows = videos(spark, sf_dir)
    other = F.when(F.col("video_id") % 4 == 0, F.add_months("published", 6).cast("timestamp"))
    own = F.when(F.col("video_id") % 3 > 0, F.col("published"))
    return rows.where((F.col("series") == "1-URGENT") & o.in_period("2000-06-01 00:00:00", own, other)).select("video_id")


def flt_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT06 and FLT07: rules of the source over those of the settings."""
    rows = table(spark, sf_dir, "part")
    least = o.layered(F.when(F.col("p_size") % 5 == 0, F.lit(0)), F.lit(10))
    most = o.layered(F.when(F.col("p_partkey") % 7 == 0, F.lit(20)), F.lit(0))
    duration = F.when(F.col("p_partkey") % 11 > 0, F.col("p_size"))
    kinds, loaded = F.array(F.lit("ECONOMY"), F.lit("SMALL")), F.col("p_retailprice") > 950
    inside = o.in_scope(duration, F.col("p_type"), loaded, least, most, kinds, F.col("p_partkey") % 2 == 0)
    return rows.select("p_partkey", inside.alias("inside"))


def flt_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT09 over made-up settings."""
    rows = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, ("int", "float", "switch", "choice"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    raw = F.element_at(F.array(F.lit("7"), F.lit("99.5"), F.lit("Yes"), F.lit("x"), F.col("p_type")), (F.col("p_partkey") % 5 + 1).cast("int"))
    s = o.setting(raw, kind, F.lit(1.0), F.lit(50.0), F.array(F.lit("SMALL"), F.lit("x")))
    return rows.select("p_partkey", s["value"].alias("value"), s["error"].alias("error"))


def flt_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT13 over parts."""
    rows = table(spark, sf_dir, "part")
    return rows.where(o.has_all_words("Ring  brand#2", F.col("p_name"), F.col("p_brand"), F.col("p_type"))).select("p_partkey", "p_name")


def flt_unembedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT11: documents without a vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(vectors, "doc_id", "left_anti")


def flt_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT02: line items as chunks of a video (order), a document (part) and a section (supplier): two listings of predicates."""
    chunks = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_linestatus").alias("topic"), F.col("l_returnflag").alias("text"), "l_extendedprice",
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey")).alias("video_id"), F.when(F.col("l_linenumber") % 2 == 1, F.col("l_partkey")).alias("document_id"),
        F.when(F.col("l_linenumber") % 4 == 1, F.col("l_suppkey")).alias("section_id"),
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), F.col("o_orderpriority").alias("series"), F.col("o_orderstatus").alias("title"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("document_id"), F.col("p_name").alias("name"))
    sections = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("section_id"), F.col("s_name").alias("section"))

    def listing(kind: str | None, series: str | None, topic: str | None, q: str | None) -> DataFrame:
        own = [F.col(f"{kind}_id").isNotNull() if kind else None, o.contains(F.col("topic"), topic) if topic else None]
        words = o.contains(F.col("text"), q) | o.contains(F.col("title"), q) | o.contains(F.col("name"), q) if q else None
        sides = [(orders, "video_id", [F.col("series") == series if series else None]), (parts, "document_id", []), (sections, "section_id", [])]
        return o.across_satellites(chunks, sides, own, [words])

    shown = ("l_orderkey", "l_linenumber", "title", "name", "section", F.round(F.col("l_extendedprice").cast("double"), 2).alias("price"))
    by_series, by_words = listing("video", "1-URGENT", None, "o"), listing(None, None, "f", "ring")
    return by_series.select(F.lit("series").alias("listing"), *shown).unionByName(by_words.select(F.lit("words").alias("listing"), *shown))


#: The stage that each kind of made-up job lifts a work from.
LIFTS = {"click": "audio", "error": "chunked", "view": "audio", "signup": "chunked"}


def flt_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT10: aborted jobs that still hold a work up, of all kinds and of one; waiting ones by kind."""
    rows = jobs(spark, sf_dir).where("job_id % 41 < 4 or status = 'aborted'")
    works = rows.select("work_id", F.when(F.col("work_id") % 3 > 0, "audio").otherwise("chunked").alias("stage")).distinct()
    found = [
        o.job_listing(rows, works, LIFTS, status, kind).select(F.lit(name).alias("listing"), "job_id", "work_id", "kind", "status")
        for name, status, kind in (("aborted", "aborted", None), ("views", "aborted", "view"), ("waiting", "waiting", "click"))
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


def jon_satellites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON01, JON05: chunks with their work, its nation and its open orders in one pass."""
    orders = table(spark, sf_dir, "orders")
    counts = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.max("o_orderdate").alias("last")
    )
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = table(spark, sf_dir, "customer").join(nations, "c_nationkey", "left").join(counts, "c_custkey", "left")
    return rows.select("c_custkey", "n_name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_open", F.lit(0)).alias("n_open"), "last")


def jon_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON02: documents with the vectors of some models."""
    vectors = table(spark, sf_dir, "embeddings").where(F.col("label").isin(1, 2, 3))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    return docs.join(vectors, "vec_id").select("vec_id", "lang", "label", F.size("embedding").alias("dimension"))


def jon_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON06: jobs whose work has no open job of few, by works at a stage."""
    rows = jobs(spark, sf_dir).where("job_id % 41 < 4 or status = 'aborted'")
    works = rows.select("work_id", F.when(F.col("work_id") % 3 > 0, "audio").otherwise("chunked").alias("stage")).distinct()
    return o.blocking(rows, works, "click", "audio").select("job_id", "work_id", "finished")


BLOCKED = f"""
WITH {JOBS}, r AS (SELECT * FROM j WHERE job_id % 41 < 4 OR status = 'aborted'),
b AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY finished DESC NULLS LAST, created DESC, job_id) AS n FROM r
  WHERE kind = 'click' AND status = 'aborted' AND work_id % 3 > 0
    AND work_id NOT IN (SELECT work_id FROM r WHERE status IN ('running', 'waiting')))
SELECT job_id, work_id, finished FROM b WHERE n = 1
"""


def jon_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON09: chunks in the order of a list, unknown ids left out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return o.in_given_order(docs, [42, 7, -1, 99, 3], "doc_id").select("position", "doc_id", "lang").orderBy("position")


def jon_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON11: line items before and after each in its order, ordinals with gaps."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    return o.neighbours(rows, "part", "l_orderkey", "l_linenumber")


def jon_adopted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON12: orders matched with suppliers' rows, of which some have lost their source."""
    found = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("source_id"), (F.col("c_custkey") % 90).alias("extern_id")).distinct()
    existing = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 90).alias("extern_id"),
        F.when(F.col("s_suppkey") % 2 > 0, F.col("s_nationkey")).alias("source_id"),
    )
    return o.adopted(found, existing)


def top_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP04: the third page by price, equal prices newest first."""
    rows = videos(spark, sf_dir)
    return o.page(rows, [F.desc_nulls_last("price"), F.desc("published"), F.asc("video_id")], 2, 25).select("video_id", "price")


def top_stage_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP04: sorted by the stage's place in the pipeline, not by its name."""
    stages = ("O", "P", "F")
    rows = videos(spark, sf_dir).withColumn("stage", o.stage_index(F.col("status"), stages))
    return o.page(rows, [F.asc_nulls_last("stage"), F.desc("published"), F.asc("video_id")], 0, 40).select("video_id", "stage")


def top_open_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP05: each work's open job, running before waiting, then the oldest."""
    rows = jobs(spark, sf_dir).where(F.col("status").isin(*o.OPEN_STATES))
    return o.first_per(rows, ["work_id"], [F.asc("status"), F.asc("created"), F.asc("job_id")]).select("work_id", "job_id", "status")


def top_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP06: each customer's newest order."""
    rows = videos(spark, sf_dir)
    return o.first_per(rows, ["work_id"], [F.desc("published"), F.desc("video_id")]).select("work_id", "video_id", "published")


def top_next_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP07: the scheduler's next jobs of a kind."""
    works = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("work_id"), (F.col("c_custkey") % 4).alias("work_priority"),
        F.col("c_mktsegment").alias("series"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal")).alias("published"),
    )
    rows = jobs(spark, sf_dir).where("status <> 'running' or job_id % 97 = 2")
    return o.next_jobs(rows, works, "view", 12, "MACHINERY").select("job_id", "work_id", "priority")


def top_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP08: the last four messages of a conversation in their order, system ones left out."""
    rows = table(spark, sf_dir, "conversations").where("conv_id = 3 and role <> 'system' and text <> ''")
    return rows.orderBy(F.desc("turn")).limit(4).orderBy("turn").select("turn", "role")


def top_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP09 and TOP11: a page of the newest events."""
    return o.page(table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], 1, 50).select("event_id", "event_type")


def top_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP13 and AGG10: conversations with their counts, longest first."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last"))
    return o.page(rows, [F.desc("last"), F.asc("conv_id")], 0, 20)


def agg_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG01: counts, open ones, earliest and latest of each series."""
    return videos(spark, sf_dir).groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("status") == "O", 1).otherwise(0)).alias("n_open"),
        F.min("published").alias("first"), F.max("published").alias("last"),
    )


def agg_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG02-AGG08: jobs by kind over a fixed dimension, trailing window, mean duration, remaining time."""
    rows = jobs(spark, sf_dir)
    recent = (F.col("status") == "done") & (F.col("finished") >= F.lit(NOW).cast("timestamp") - F.expr("interval 36 hours"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    seconds = (micros("finished") - micros("created")) / 1e6
    n = lambda s: F.count_if(F.col("status") == s)
    counted = o.counted(
        rows, o.literal(rows, "kind", KINDS), ["kind"],
        n("waiting").alias("waiting"), n("running").alias("running"), n("aborted").alias("aborted"), F.count_if(recent).alias("recent"),
        F.coalesce(F.sum(F.when(F.col("status") == "running", 1 - F.col("progress"))), F.lit(0.0)).alias("rest"),
    )
    means = rows.where("status = 'done'").groupBy("kind").agg(F.avg(seconds).alias("mean_s"))
    left = o.remaining(F.col("mean_s"), F.col("waiting"), F.col("rest"), F.lit(3))
    return counted.join(means, "kind", "left").select(
        "kind", "position", "waiting", "running", "aborted", "recent", F.round("rest", 6).alias("rest"), F.round("mean_s", 6).alias("mean_s"),
        F.round(left, 4).alias("left_s"),
    )


def agg_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG08: a histogram over a fixed dimension with a stage that has no rows."""
    rows = videos(spark, sf_dir).withColumnRenamed("status", "stage")
    return o.counted(rows, o.literal(rows, "stage", ("P", "O", "F", "X")), ["stage"], F.count(F.lit(1)).alias("n"))


def agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12: sources of non-empty texts."""
    return table(spark, sf_dir, "documents").where("source <> '' and text <> ''").select("source").distinct()


def agg_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG09, AGG14: the parts of each order as a sorted list, and their number."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("l_partkey")).cast("array<string>"), ",").alias("parts")
    )


def agg_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13, AGG17, AGG18: mean, discarded, characters and whole mean size by source."""
    size = F.length("text")
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.round(F.avg(size), 6).alias("mean"), F.count_if(size < 200).alias("small"), F.sum(size).cast("long").alias("chars"),
        F.floor(F.sum(size) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("mean_size"),
    )


def agg_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG16: how often a needle occurs, by language."""
    found = o.occurrences(F.col("text"), "The")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(found).alias("n"), F.count_if(found > 0).alias("texts"))


def agg_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG19: total and selected per source, sources without documents kept."""
    labels = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(1))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count("good").alias("selected"))


QUERIES = {
    f.__name__: f
    for f in (
    flt_chunks, flt_jobs,
        flt_videos, flt_period, flt_scope, flt_settings, flt_words, flt_unembedded, jon_satellites, jon_family, jon_blocking, jon_given,
        jon_neighbours, jon_adopted, top_page, top_stage_page, top_open_job, top_latest, top_next_jobs, top_messages, top_log,
        top_conversations, agg_series, agg_overview, agg_stages, agg_distinct, agg_models, agg_similarity, agg_occurrences, agg_sources,
    )
}

ORACLE = {
    "flt_chunks": """
WITH c AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey END AS v, CASE WHEN l_linenumber % 2 = 1 THEN l_partkey END AS d, CASE WHEN l_linenumber % 4 = 1 THEN l_suppkey END AS s FROM lineitem),
j AS (SELECT c.*, o_orderpriority, o_orderstatus AS title, p_name AS name, s_name AS section FROM c LEFT JOIN orders ON o_orderkey = v LEFT JOIN part ON p_partkey = d LEFT JOIN supplier ON s_suppkey = s)
SELECT 'series' AS listing, l_orderkey, l_linenumber, title, name, section, round(l_extendedprice::DOUBLE, 2) AS price FROM j
WHERE v IS NOT NULL AND o_orderpriority = '1-URGENT' AND (l_returnflag ILIKE '%o%' OR title ILIKE '%o%' OR name ILIKE '%o%')
UNION ALL SELECT 'words', l_orderkey, l_linenumber, title, name, section, round(l_extendedprice::DOUBLE, 2) FROM j
WHERE l_linestatus ILIKE '%f%' AND (l_returnflag ILIKE '%ring%' OR title ILIKE '%ring%' OR name ILIKE '%ring%')""",
    "flt_jobs": f"""
WITH {JOBS}, r AS (SELECT * FROM j WHERE job_id % 41 < 4 OR status = 'aborted'),
h AS (SELECT * FROM r WHERE status = 'aborted' AND work_id NOT IN (SELECT work_id FROM r WHERE status IN ('running', 'waiting'))
  AND CASE WHEN work_id % 3 > 0 THEN kind IN ('click', 'view') ELSE kind IN ('error', 'signup') END),
a AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY finished DESC NULLS LAST, created DESC, job_id) AS n FROM h),
b AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY finished DESC NULLS LAST, created DESC, job_id) AS n FROM h WHERE kind = 'view')
SELECT 'aborted' AS listing, job_id, work_id, kind, status FROM a WHERE n = 1
UNION ALL SELECT 'views', job_id, work_id, kind, status FROM b WHERE n = 1
UNION ALL SELECT 'waiting', job_id, work_id, kind, status FROM r WHERE status = 'waiting' AND kind = 'click'""",
    "flt_videos": """SELECT o_orderkey AS video_id, o_orderpriority AS series, o_orderstatus AS status FROM orders
WHERE (o_orderpriority ILIKE '%r_ent%' OR o_orderkey = 7) AND o_orderstatus = 'F'""",
    "flt_period": """SELECT o_orderkey AS video_id FROM orders WHERE o_orderpriority = '1-URGENT'
AND (o_orderkey % 3 > 0 AND o_orderdate >= '2000-06-01' OR o_orderkey % 4 = 0 AND o_orderdate + INTERVAL 6 MONTH >= '2000-06-01')""",
    "flt_scope": """SELECT p_partkey, coalesce(d > least AND (most = 0 OR d <= most) AND p_type IN ('ECONOMY', 'SMALL')
  AND (p_partkey % 2 <> 0 OR p_retailprice > 950), false) AS inside
FROM (SELECT *, CASE WHEN p_partkey % 11 > 0 THEN p_size END AS d, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 10 END AS least,
  CASE WHEN p_partkey % 7 = 0 THEN 20 ELSE 0 END AS most FROM part)""",
    "flt_settings": """
WITH s AS (SELECT p_partkey, ['int', 'float', 'switch', 'choice'][p_partkey % 4 + 1] AS kind, ['7', '99.5', 'Yes', 'x', p_type][p_partkey % 5 + 1] AS raw FROM part),
n AS (SELECT *, TRY_CAST(raw AS DOUBLE) AS n FROM s),
e AS (SELECT *, CASE WHEN kind = 'int' AND NOT coalesce(n = floor(n), false) THEN 'not a whole number' WHEN kind = 'float' AND n IS NULL THEN 'not a number'
  WHEN kind IN ('int', 'float') AND n < 1 THEN 'too small' WHEN kind IN ('int', 'float') AND n > 50 THEN 'too large'
  WHEN kind = 'switch' AND lower(raw) NOT IN ('true', 'false', 'on', 'off', 'yes', 'no', '1', '0') THEN 'not a switch word'
  WHEN kind = 'choice' AND raw NOT IN ('SMALL', 'x') THEN 'not a choice' END AS error FROM n)
SELECT p_partkey, error, CASE WHEN error IS NOT NULL THEN NULL WHEN kind = 'int' THEN n::BIGINT::VARCHAR WHEN kind = 'float' THEN n::VARCHAR
  WHEN kind = 'switch' THEN (lower(raw) IN ('true', 'on', 'yes', '1'))::VARCHAR ELSE raw END AS value FROM e""",
    "flt_words": """SELECT p_partkey, p_name FROM part
WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring') AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#2')""",
    "flt_unembedded": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "jon_satellites": """SELECT c_custkey, n_name, coalesce(n, 0) AS n, coalesce(n_open, 0) AS n_open, last FROM customer
LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_open, max(o_orderdate) AS last
  FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
    "jon_family": """SELECT vec_id, lang, label, len(embedding)::INT AS dimension FROM documents JOIN embeddings ON vec_id = doc_id WHERE label IN (1, 2, 3)""",
    "jon_blocking": BLOCKED,
    "jon_given": """SELECT p - 1 AS position, doc_id, lang FROM (SELECT unnest([42, 7, -1, 99, 3]) AS i, unnest([1, 2, 3, 4, 5]) AS p) JOIN documents ON doc_id = i""",
    "jon_neighbours": """
WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part FROM lineitem GROUP BY ALL)
SELECT l.*, a.part AS previous, b.part AS next FROM l LEFT JOIN l a ON a.l_orderkey = l.l_orderkey AND a.l_linenumber = l.l_linenumber - 1
LEFT JOIN l b ON b.l_orderkey = l.l_orderkey AND b.l_linenumber = l.l_linenumber + 1""",
    "jon_adopted": """
WITH f AS (SELECT DISTINCT c_nationkey AS source_id, c_custkey % 90 AS extern_id FROM customer),
e AS (SELECT s_suppkey AS id, s_suppkey % 90 AS x, CASE WHEN s_suppkey % 2 > 0 THEN s_nationkey END AS s FROM supplier)
SELECT source_id, extern_id, id FROM (
  SELECT source_id, extern_id, id, row_number() OVER (PARTITION BY source_id, extern_id ORDER BY s NULLS LAST, id) AS n
  FROM f LEFT JOIN e ON x = extern_id AND (s IS NULL OR s = source_id)) WHERE n = 1""",
    "top_page": "SELECT o_orderkey AS video_id, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50",
    "top_stage_page": """SELECT o_orderkey AS video_id, (list_position(['O', 'P', 'F'], o_orderstatus) - 1)::BIGINT AS stage FROM orders
ORDER BY stage NULLS LAST, o_orderdate DESC, o_orderkey LIMIT 40""",
    "top_open_job": f"""WITH {JOBS} SELECT work_id, job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY status, created, job_id) AS n
FROM j WHERE status IN ('running', 'waiting')) WHERE n = 1""",
    "top_latest": """SELECT work_id, video_id, published FROM (SELECT o_custkey AS work_id, o_orderkey AS video_id, o_orderdate AS published,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""",
    "top_next_jobs": f"""
WITH {JOBS}, r AS (SELECT * FROM j WHERE status <> 'running' OR job_id % 97 = 2),
w AS (SELECT c_custkey AS work_id, c_custkey % 4 AS wp, c_mktsegment AS series, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS published FROM customer),
q AS (SELECT r.*, row_number() OVER (ORDER BY priority DESC, wp DESC NULLS LAST, coalesce(series = 'MACHINERY', false) DESC, published DESC NULLS LAST, created, job_id) AS rank
  FROM r LEFT JOIN w USING (work_id) WHERE kind = 'view' AND status = 'waiting'),
s AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY rank) AS n FROM q WHERE rank <= 48)
SELECT job_id, work_id, priority FROM s WHERE n = 1 AND work_id NOT IN (SELECT work_id FROM r WHERE status = 'running') ORDER BY rank LIMIT 12""",
    "top_messages": """SELECT turn, role FROM (SELECT turn, role FROM conversations WHERE conv_id = 3 AND role <> 'system' AND text <> '' ORDER BY turn DESC LIMIT 4)""",
    "top_log": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50",
    "top_conversations": "SELECT conv_id, count(*) AS n, max(turn) AS last FROM conversations GROUP BY 1 ORDER BY last DESC, conv_id LIMIT 20",
    "agg_series": """SELECT o_orderpriority AS series, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_open, min(o_orderdate) AS first, max(o_orderdate) AS last
FROM orders GROUP BY 1""",
    "agg_overview": f"""
WITH {JOBS}, d AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'export']) AS kind, unnest([0, 1, 2, 3, 4, 5]) AS position),
c AS (SELECT kind, count(*) FILTER (status = 'waiting') AS waiting, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'aborted') AS aborted,
  count(*) FILTER (status = 'done' AND finished >= TIMESTAMP '{NOW}' - INTERVAL 36 HOUR) AS recent, coalesce(sum(1 - progress) FILTER (status = 'running'), 0) AS rest,
  avg(epoch_us(finished) - epoch_us(created)) FILTER (status = 'done') / 1e6 AS mean_s FROM j GROUP BY 1),
f AS (SELECT d.kind, position, coalesce(waiting, 0) AS waiting, coalesce(running, 0) AS running, coalesce(aborted, 0) AS aborted, coalesce(recent, 0) AS recent,
  coalesce(rest, 0) AS rest, mean_s FROM d LEFT JOIN c USING (kind))
SELECT kind, position, waiting, running, aborted, recent, round(rest, 6) AS rest, round(mean_s, 6) AS mean_s,
  round(CASE WHEN waiting + rest > 0 THEN mean_s * (waiting + rest) / 3 END, 4) AS left_s FROM f""",
    "agg_stages": """SELECT stage, position, coalesce(n, 0) AS n FROM (SELECT unnest(['P', 'O', 'F', 'X']) AS stage, unnest([0, 1, 2, 3]) AS position)
LEFT JOIN (SELECT o_orderstatus AS stage, count(*) AS n FROM orders GROUP BY 1) USING (stage)""",
    "agg_distinct": "SELECT DISTINCT source FROM documents WHERE source <> '' AND text <> ''",
    "agg_models": "SELECT l_orderkey, count(*) AS n, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS parts FROM lineitem GROUP BY 1",
    "agg_similarity": """SELECT source, round(avg(length(text)), 6) AS mean, count(*) FILTER (length(text) < 200) AS small, sum(length(text))::BIGINT AS chars,
sum(length(text))::BIGINT // count(*) AS mean_size FROM documents GROUP BY 1""",
    "agg_occurrences": """SELECT lang, sum(n)::BIGINT AS n, count(*) FILTER (n > 0) AS texts FROM (
SELECT lang, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS n FROM documents) GROUP BY 1""",
    "agg_sources": """SELECT source, count(*) AS total, count(l.doc_id) AS selected FROM documents d
LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = d.doc_id GROUP BY 1""",
}
