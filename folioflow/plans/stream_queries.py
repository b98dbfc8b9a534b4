"""Streams over the events table, with the SQL of the same results in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import bus
from ..streaming import streams as s
from .tables import table

NOW = "2024-01-31 00:00:00"
IDLE = 12 * 3600


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return s.events(spark, sf_dir, "events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def stm_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM08: each user's latest event."""
    updates = s.drain(s.latest(stream(spark, sf_dir), ["user_id"], "ts", "event_id", "event_type"), "update")
    return s.final(updates, ["user_id"]).select("user_id", "event_id", "event_type")


def stm_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM06: events by hour and kind."""
    updates = s.drain(s.throughput(stream(spark, sf_dir), "ts", "event_type"), "update")
    return s.final(updates, ["start", "event_type"]).select(F.unix_seconds("start").alias("start"), "event_type", "n")


def stm_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM06: events in the hour up to every quarter of an hour."""
    updates = s.drain(s.throughput(stream(spark, sf_dir), "ts", "event_type", slide="15 minutes"), "update")
    return s.final(updates, ["start", "event_type"]).select(F.unix_seconds("start").alias("start"), "event_type", "n")


def stm_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM04 on a table: users without an event for four hours are in error."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("heartbeat"))
    rows = last.withColumn("status", F.when(F.col("user_id") % 4 > 0, "running").otherwise("done"))
    return s.stuck(rows, F.lit(NOW).cast("timestamp"), 4 * 3600).select("user_id", "status")


def stm_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM09: each user's values passed on at steps of 25 or after six hours."""
    rows = stream(spark, sf_dir).select(F.col("user_id").alias("job_id"), "ts", F.col("value").alias("progress"))
    return s.drain(s.throttled(rows, 25.0, 6 * 3600)).drop("batch")


def stm_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM02: the last 200 events for a new subscriber."""
    seen = s.drain(stream(spark, sf_dir).where("event_type <> 'error'").select("event_id", "ts", "event_type"))
    return seen.orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "event_type")


def stm_mailboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM01: the last 500 events of each of some subscribers, one of them to all kinds, and how many each has lost."""
    wants = F.expr("explode(array(named_struct('subscriber', 'all', 'kind', '*'), named_struct('subscriber', 'trade', 'kind', 'purchase'), named_struct('subscriber', 'trade', 'kind', 'signup'), named_struct('subscriber', 'errors', 'kind', 'error')))")
    subscribers = spark.range(1).select(wants.alias("s")).select("s.*")
    rows = stream(spark, sf_dir).select("event_id", F.unix_micros("ts").alias("us"), F.col("event_type").alias("kind"))
    last = s.final(s.drain(bus.mailboxes(rows, subscribers), "update"), ["subscriber"])
    return last.select("subscriber", "dropped", F.size("events").alias("held"), F.md5(F.array_join("events", ",")).alias("events"))


def stm_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM02: heartbeats of users every twelve hours without an event, up to the end of the stream."""
    rows = stream(spark, sf_dir).select(F.col("user_id").alias("subscriber"), "ts")
    return s.drain(bus.heartbeats(rows, IDLE)).drop("batch")


def stm_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM07: users as jobs of sixteen pools; signing up queues one, a click starts it, an error ends it."""
    kind = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "click", "started").when(F.col("event_type") == "view", "progress").when(F.col("event_type") == "error", "finished").otherwise("other")
    rows = stream(spark, sf_dir).select("event_id", "ts", (F.col("user_id") % 16).alias("pool"), F.col("user_id").alias("job_id"), kind.alias("kind"), "value")
    return s.drain(bus.pool_states(rows)).drop("batch")


QUERIES = {f.__name__: f for f in (stm_latest, stm_throughput, stm_trailing, stm_stuck, stm_throttle, stm_replay, stm_mailboxes, stm_heartbeats, stm_pools)}

ORACLE = {
    "stm_latest": """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
    "stm_throughput": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stm_trailing": """SELECT (floor(epoch(ts) / 900) * 900)::BIGINT - 900 * k AS start, event_type, count(*) AS n
FROM events, range(0, 4) r(k) GROUP BY ALL""",
    "stm_stuck": f"""SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 'done' WHEN floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(max(ts))) > 14400 THEN 'error' ELSE 'running' END AS status
FROM events GROUP BY user_id""",
    "stm_throttle": """
WITH RECURSIVE e AS (SELECT user_id AS job_id, epoch_us(ts) AS us, value AS progress, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS n FROM events),
r AS (SELECT job_id, us, progress, n, us AS since, progress AS done, true AS passed FROM e WHERE n = 1
  UNION ALL SELECT job_id, us, progress, n, CASE WHEN p THEN us ELSE since END, CASE WHEN p THEN progress ELSE done END, p
  FROM (SELECT e.*, since, done, abs(e.progress - done) >= 25 OR e.us - since >= 21600000000 AS p FROM r JOIN e ON e.job_id = r.job_id AND e.n = r.n + 1))
SELECT job_id, us, progress FROM r WHERE passed""",
    "stm_replay": "SELECT event_id, event_type FROM events WHERE event_type <> 'error' ORDER BY ts DESC, event_id DESC LIMIT 200",
    "stm_mailboxes": """
WITH w(subscriber, kind) AS (VALUES ('all', '*'), ('trade', 'purchase'), ('trade', 'signup'), ('errors', 'error')),
e AS (SELECT subscriber, event_id, ts, row_number() OVER (PARTITION BY subscriber ORDER BY ts DESC, event_id DESC) AS n FROM events JOIN w ON kind IN ('*', event_type))
SELECT subscriber, count(*) FILTER (n > 500) AS dropped, (count(*) FILTER (n <= 500))::INT AS held, md5(string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) FILTER (n <= 500)) AS events
FROM e GROUP BY 1""",
    "stm_heartbeats": f"""
WITH e AS (SELECT user_id AS subscriber, epoch_us(ts) // 1000 AS ms FROM events),
g AS (SELECT subscriber, ms, coalesce(lead(ms) OVER (PARTITION BY subscriber ORDER BY ms), (SELECT max(ms) FROM e) + 1) AS next FROM e)
SELECT subscriber, unnest(range(ms + {IDLE} * 1000, next, {IDLE} * 1000)) AS beat_ms FROM g""",
    "stm_pools": """
WITH e AS (SELECT event_id, epoch_us(ts) AS us, user_id % 16 AS pool, user_id AS job_id, value,
    CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'started' WHEN 'view' THEN 'progress' WHEN 'error' THEN 'finished' ELSE 'other' END AS kind FROM events),
s AS (SELECT *, count(*) FILTER (kind IN ('started', 'finished')) OVER (PARTITION BY job_id ORDER BY us, event_id) AS seg FROM e),
f AS (SELECT *, max(CASE WHEN kind = 'started' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, seg) AS runs,
    min(CASE WHEN kind = 'queued' THEN us END) OVER (PARTITION BY job_id, seg ORDER BY us, event_id) AS since,
    arg_max(CASE WHEN kind = 'progress' THEN value END, (us, event_id)) FILTER (kind = 'progress') OVER (PARTITION BY job_id, seg ORDER BY us, event_id) AS p FROM s),
t AS (SELECT *, CASE WHEN runs = 1 THEN 'running' WHEN since IS NOT NULL THEN 'waiting' ELSE 'unknown' END AS state FROM f),
d AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY job_id ORDER BY us, event_id), 'unknown') AS before, lead(us) OVER (PARTITION BY job_id ORDER BY us, event_id) AS until FROM t),
n AS (SELECT *, sum((state = 'waiting')::INT - (before = 'waiting')::INT) OVER w AS n_waiting, sum((state = 'running')::INT - (before = 'running')::INT) OVER w AS n_running
  FROM d WINDOW w AS (PARTITION BY pool ORDER BY us, event_id)),
q AS (SELECT a.event_id, count(*) AS position FROM n a JOIN n b ON b.pool = a.pool AND b.state = 'waiting' AND b.us <= a.us AND coalesce(b.until > a.us, true) AND (b.since, b.job_id) <= (a.since, a.job_id)
  WHERE a.state = 'waiting' GROUP BY 1)
SELECT pool, n.event_id, job_id, state, position, n_waiting::BIGINT AS n_waiting, n_running::BIGINT AS n_running, CASE WHEN state = 'running' THEN least(1, greatest(0, coalesce(p, 0) / 100)) END AS progress
FROM n LEFT JOIN q ON q.event_id = n.event_id""",
}
