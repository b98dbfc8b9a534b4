"""Merges over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import merge as m
from ..shared import cut
from .listing_queries import JOBS, jobs
from .tables import table


def mrg_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG01, MRG02, AGG15: parts merged with changed ones, names pinned for every fourth."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_size").alias("duration"), F.split("p_brand", "#").alias("tags"))
    old = rows.where("p_partkey % 5 <> 0").withColumn("pinned", F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("title"))).otherwise(F.array().cast("array<string>")))
    new = rows.where("p_partkey % 7 <> 0").select(
        "p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("title")).otherwise(F.col("title")).alias("title"), "duration",
        F.when(F.col("p_partkey") % 3 > 0, F.col("tags")).otherwise(F.array().cast("array<string>")).alias("tags"),
    )
    merged = m.upsert(old, new, ["p_partkey"], ["title", "duration", "tags"], lists=("tags",))
    chosen = m.select_by_rule(F.col("p_partkey") % 2 == 1, F.col("p_partkey") % 10 == 1, F.col("duration") > 25)
    return merged.select("p_partkey", "title", "duration", F.array_join("tags", "#").alias("tags"), "action", chosen.alias("selected"))


def selectable(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as works of which some are selected, some by hand, and every third one's job."""
    key = F.col("o_orderkey")
    stage = F.element_at(F.array(*map(F.lit, ("discovered", "audio", "corrected", "embedded"))), (key % 4 + 1).cast("int"))
    works = table(spark, sf_dir, "orders").select(key.alias("work_id"), (key % 2 == 0).alias("selected"), (key % 10 == 1).alias("manual"), stage.alias("stage"), F.col("o_totalprice").alias("price"))
    status = F.element_at(F.array(*map(F.lit, ("waiting", "running", "done"))), (key % 5 % 3 + 1).cast("int"))
    made = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(key.alias("work_id"), m.next_job(stage).alias("kind"), status.alias("status"), F.lit(None).cast("string").alias("error"))
    return works, made.where("kind is not null")


def shown(rows: DataFrame, jobs_after: DataFrame, counters: dict[str, int]) -> DataFrame:
    """Works that were looked at, their jobs and the counters as rows (part, id, a, b)."""
    works = rows.where("action <> 'kept' and action <> 'manual'").select(F.lit("work").alias("part"), F.col("work_id").cast("string").alias("id"), F.col("action").alias("a"), F.concat_ws("/", F.col("selected").cast("string"), F.col("manual").cast("string")).alias("b"))
    made = jobs_after.select(F.lit("job"), F.col("work_id").cast("string"), F.concat_ws("/", "kind", "status"), F.coalesce("error", F.lit("")))
    one = F.map_from_arrays(F.array(*map(F.lit, counters)), F.array(*[F.lit(v).cast("string") for v in counters.values()]))
    counts = rows.sparkSession.range(1).select(F.explode(one).alias("id", "a")).select(F.lit("counter"), "id", "a", F.lit(""))
    return works.union(made).union(counts)


def mrg_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG03: a rule on prices over all works that nobody has decided by hand, with its jobs and counters."""
    works, old = selectable(spark, sf_dir)
    seen, made = Observation("rule"), Observation("jobs")
    rows = cut(m.apply_rule(works, F.col("price") > 150_000, seen))
    after = cut(m.jobs_after_selection(old, rows, True, made))
    return shown(rows, after, seen.get | made.get)


def mrg_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG04: every fifth order and some unknown ids dropped by hand, with the jobs and counters."""
    works, old = selectable(spark, sf_dir)
    asked = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.when(F.col("o_orderkey") % 35 == 0, -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey")).alias("work_id"))
    seen, made = Observation("batch"), Observation("jobs")
    rows = cut(m.select_batch(works, asked, False, seen))
    after = cut(m.jobs_after_selection(old, rows, True, made))
    return shown(rows, after, seen.get | made.get)


def mrg_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG05: the items of every tenth order replaced by one."""
    old = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    new = old.where("l_orderkey % 10 = 0").select("l_orderkey").distinct().select("l_orderkey", F.lit(-1).cast("long").alias("l_partkey"), F.lit(1).alias("l_linenumber"))
    return m.replace_children(old, new, "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("parts"))


def mrg_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG06, MRG12: orders as versions of customers' texts: new ones become current, then the dropped ones' successors."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    old = rows.where("o_orderkey % 3 > 0").withColumn("current", F.col("o_orderkey") % 2 == 0)
    flipped = m.flip_versions(old, rows.where("o_orderkey % 30 = 0"), "o_custkey")
    gone = rows.where("o_orderkey % 15 = 0 or o_orderkey % 11 = 1")
    order = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    return m.drop_versions(flipped, gone, "o_custkey", "o_orderkey", order).select("o_orderkey", "o_custkey", "current")


def mrg_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG08: orders' customers translated, dangling ones nulled; items of unknown orders dropped."""
    ids = table(spark, sf_dir, "customer").where("c_custkey % 6 > 0").select(F.col("c_custkey").alias("old_id"), (F.col("c_custkey") + 10_000).alias("new_id"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return m.remap(orders, ids, "o_custkey", soft=True).withColumn("kept", F.col("o_custkey").isNotNull())


def mrg_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG08: items whose order is not in the package."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return m.dangling(items, orders, "l_orderkey", "o_orderkey")


def mrg_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG09, MRG14-MRG16, MRG19 over parts as works with counts."""
    size, key = F.col("p_size"), F.col("p_partkey")
    existing = F.element_at(F.array(F.lit(None).cast("string"), F.lit("embedded"), F.lit("audio")), (key % 3 + 1).cast("int"))
    stage = m.stage_after_import(existing, size % 2, size % 3, size % 4, size % 5)
    return table(spark, sf_dir, "part").select(
        "p_partkey", stage.alias("stage"), m.document_stage(size % 4, size % 5).alias("document_stage"), m.next_job(stage).alias("job"),
        m.raised(stage, F.lit("corrected")).alias("raised"), m.after_failure(size % 4, F.lit(2)).alias("after"),
    )


def mrg_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG13: (work, kind) that no open job has."""
    rows = jobs(spark, sf_dir)
    return m.missing_jobs(rows.select("work_id", "kind").distinct(), rows.where("job_id % 9 = 1"))


def mrg_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG17, MRG18: nations as defaults, those with suppliers of a kind stored."""
    defaults = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    stored = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("key")).agg(F.max("s_name").alias("value"))
    return m.add_missing(defaults, stored, "key")


def mrg_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG11: vectors of works reset to corrected are gone."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("work_id"))
    return m.reset(vectors, vectors.where("work_id < 3"), "corrected", "embedded")


def mrg_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM05: states after a restart."""
    rows = jobs(spark, sf_dir).withColumn("reason", F.when(F.col("job_id") % 2 == 0, "restart"))
    return m.recover(rows).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def snk_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK03: one row of counts, one aggregate a table."""
    names = ("documents", "embeddings", "pages", "labels", "conversations")
    one = None
    for n in names:
        c = table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias(n))
        one = c if one is None else one.join(c)  # each side is one row
    return one


def snk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK04, SNK05: vectors rounded for the package, their dimension checked, the models collected."""
    v = table(spark, sf_dir, "embeddings")
    checked = F.when(F.size("embedding") != 64, F.raise_error(F.concat(F.lit("dimension of "), "vec_id")).cast("array<float>")).otherwise(F.col("embedding"))
    rounded = F.transform(checked, lambda x: F.round(x.cast("double"), 8))
    return v.select("vec_id", F.round(F.aggregate(rounded, F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size(rounded).alias("dimension"))


SELECTABLE = """w AS (SELECT o_orderkey AS work_id, o_orderkey % 2 = 0 AS selected, o_orderkey % 10 = 1 AS manual, ['discovered', 'audio', 'corrected', 'embedded'][o_orderkey % 4 + 1] AS stage, o_totalprice AS price,
  ['audio', 'transcription', 'chunking', NULL][o_orderkey % 4 + 1] AS following FROM orders),
old AS (SELECT work_id, following AS kind, ['waiting', 'running', 'done'][work_id % 5 % 3 + 1] AS status FROM w WHERE work_id % 3 = 0 AND following IS NOT NULL)"""

AFTER = """k AS (SELECT old.*, action = 'removed' AND status = 'waiting' AS stopped FROM old JOIN c USING (work_id)),
n AS (SELECT work_id, following AS kind FROM c WHERE action = 'added' AND following IS NOT NULL AND NOT EXISTS (SELECT 1 FROM old WHERE old.work_id = c.work_id AND kind = following AND status IN ('waiting', 'running')))
SELECT 'work' AS part, work_id::VARCHAR AS id, action AS a, now::VARCHAR || '/' || hand::VARCHAR AS b FROM c WHERE action NOT IN ('kept', 'manual')
UNION ALL SELECT 'job', work_id::VARCHAR, kind || '/' || CASE WHEN stopped THEN 'aborted' ELSE status END, CASE WHEN stopped THEN 'no longer selected' ELSE '' END FROM k
UNION ALL SELECT 'job', work_id::VARCHAR, kind || '/waiting', '' FROM n
UNION ALL SELECT 'counter', 'created', count(*)::VARCHAR, '' FROM n
UNION ALL SELECT 'counter', 'aborted', count(*)::VARCHAR, '' FROM k WHERE stopped"""

QUERIES = {
    f.__name__: f
    for f in (
    mrg_rule, mrg_batch,
        mrg_upsert, mrg_children, mrg_versions, mrg_import, mrg_dangling, mrg_stages, mrg_jobs, mrg_settings, mrg_reset, mrg_recover,
        snk_counters, snk_vectors,
    )
}

ORACLE = {
    "mrg_rule": f"""
WITH {SELECTABLE},
c AS (SELECT *, CASE WHEN manual THEN 'manual' WHEN selected = (price > 150000) THEN 'unchanged' WHEN price > 150000 THEN 'added' ELSE 'removed' END AS action, CASE WHEN manual THEN selected ELSE price > 150000 END AS now, manual AS hand FROM w),
{AFTER}
UNION ALL SELECT 'counter', 'checked', count(*)::VARCHAR, '' FROM c WHERE NOT manual
UNION ALL SELECT 'counter', action, count(*)::VARCHAR, '' FROM c WHERE action <> 'manual' GROUP BY action""",
    "mrg_batch": f"""
WITH {SELECTABLE}, a AS (SELECT CASE WHEN o_orderkey % 35 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS id FROM orders WHERE o_orderkey % 5 = 0),
c AS (SELECT w.*, CASE WHEN a.id IS NULL THEN 'kept' WHEN selected THEN 'removed' ELSE 'unchanged' END AS action, CASE WHEN a.id IS NULL THEN selected ELSE false END AS now, manual OR a.id IS NOT NULL AS hand
  FROM w LEFT JOIN a ON a.id = work_id),
{AFTER}
UNION ALL SELECT 'counter', 'asked', count(DISTINCT id)::VARCHAR, '' FROM a
UNION ALL SELECT 'counter', 'not_found', count(DISTINCT id)::VARCHAR, '' FROM a WHERE id < 0
UNION ALL SELECT 'counter', 'changed', count(*)::VARCHAR, '' FROM c WHERE action = 'removed'
UNION ALL SELECT 'counter', 'unchanged', count(*)::VARCHAR, '' FROM c WHERE action = 'unchanged'""",
    "mrg_upsert": """
WITH p AS (SELECT p_partkey AS k, p_name AS t, p_size AS d, string_split(p_brand, '#') AS g FROM part),
j AS (SELECT k, t, d, g, k % 5 <> 0 AS o, k % 7 <> 0 AS n, k % 4 = 0 AS pin, CASE WHEN k % 2 = 0 THEN upper(t) ELSE t END AS nt FROM p),
x AS (SELECT *, CASE WHEN o AND (NOT n OR pin) THEN t ELSE nt END AS title, CASE WHEN o OR k % 3 > 0 THEN g ELSE [] END AS tags FROM j WHERE o OR n)
SELECT k AS p_partkey, title, d AS duration, array_to_string(tags, '#') AS tags,
  CASE WHEN NOT o THEN 'new' WHEN NOT n THEN 'kept' WHEN title = t THEN 'unchanged' ELSE 'updated' END AS action,
  CASE WHEN k % 10 = 1 THEN k % 2 = 1 ELSE d > 25 END AS selected FROM x""",
    "mrg_children": """SELECT l_orderkey, CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE count(*) END AS n, CASE WHEN l_orderkey % 10 = 0 THEN -1 ELSE sum(l_partkey) END::BIGINT AS parts
FROM lineitem GROUP BY l_orderkey""",
    "mrg_versions": """
WITH n AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderkey % 30 = 0),
f AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderkey % 2 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM n) AS cur FROM orders WHERE o_orderkey % 3 > 0
  UNION ALL SELECT *, true FROM n),
g AS (SELECT *, o_orderkey % 15 = 0 OR o_orderkey % 11 = 1 AS g FROM f),
k AS (SELECT *, bool_and(g) OVER (PARTITION BY o_custkey) AS every, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM g),
l AS (SELECT * FROM k WHERE NOT g OR every AND r = 1)
SELECT o_orderkey, o_custkey, CASE WHEN bool_or(cur) OVER (PARTITION BY o_custkey) THEN cur
  ELSE row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 END AS current FROM l""",
    "mrg_import": """SELECT o_orderkey, c_custkey + 10000 AS o_custkey, c_custkey IS NOT NULL AS kept FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 6 > 0""",
    "mrg_dangling": """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""",
    "mrg_stages": """
WITH p AS (SELECT p_partkey, p_size % 2 AS t, p_size % 3 AS c, p_size % 4 AS h, p_size % 5 AS e, [NULL, 'embedded', 'audio'][p_partkey % 3 + 1] AS x FROM part),
f AS (SELECT *, CASE WHEN h > 0 AND e >= h THEN 'embedded' WHEN h > 0 THEN 'chunked' WHEN c > 0 THEN 'corrected' WHEN t > 0 THEN 'transcribed' ELSE 'discovered' END AS f FROM p),
s AS (SELECT *, CASE WHEN x IS NULL OR h > 0 THEN f WHEN x = 'embedded' THEN x WHEN f = 'discovered' THEN 'audio' ELSE f END AS stage FROM f)
SELECT p_partkey, stage, CASE WHEN h = 0 THEN 'imported' WHEN e < h THEN 'chunked' ELSE 'embedded' END AS document_stage,
  map {'discovered': 'audio', 'audio': 'transcription', 'transcribed': 'correction', 'corrected': 'chunking', 'chunked': 'embedding'}[stage] AS job,
  CASE WHEN stage IN ('discovered', 'audio', 'transcribed') THEN 'corrected' ELSE stage END AS raised, CASE WHEN h <= 2 THEN 'waiting' ELSE 'error' END AS after FROM s""",
    "mrg_jobs": f"""WITH {JOBS} SELECT DISTINCT work_id, kind FROM j WHERE (work_id, kind) NOT IN (SELECT (work_id, kind) FROM j WHERE job_id % 9 = 1 AND status IN ('running', 'waiting'))""",
    "mrg_settings": """
WITH s AS (SELECT s_nationkey AS key, max(s_name) AS value FROM supplier WHERE s_acctbal > 9000 GROUP BY 1)
SELECT * FROM s UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT key FROM s)""",
    "mrg_reset": "SELECT vec_id, label AS work_id FROM embeddings WHERE label >= 3",
    "mrg_recover": f"""WITH {JOBS} SELECT CASE WHEN status = 'running' OR status = 'aborted' AND job_id % 2 = 0 THEN 'waiting' ELSE status END AS status, count(*) AS n FROM j GROUP BY 1""",
    "snk_counters": """SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM pages) AS pages,
(SELECT count(*) FROM labels) AS labels, (SELECT count(*) FROM conversations) AS conversations""",
    "snk_vectors": """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: round(x::DOUBLE, 8))), 6) AS total, len(embedding)::INT AS dimension FROM embeddings""",
}
