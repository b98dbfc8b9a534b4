"""The bus on keyed state over several micro-batches, against plain Python; plans of listings and selections."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from folioflow.operators import listing, merge
from folioflow.streaming import bus, streams

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.fixture
def batches(spark, tmp_path):
    """Writes files that a stream reads one by one, a micro-batch each."""

    def write(parts, schema):
        for i, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{i}")
        return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))

    return write


def test_mailboxes_keep_the_latest(spark, batches):
    parts = [[(i, i * 10, "ab"[i % 2]) for i in range(k, 60, 3)] for k in range(3)]
    stream = batches(parts, "event_id long, us long, kind string")
    subscribers = spark.createDataFrame([("all", "*"), ("a", "a"), ("none", "z"), ("both", "a"), ("both", "b")], "subscriber string, kind string")
    last = streams.final(streams.drain(bus.mailboxes(stream, subscribers, most=4), "update"), ["subscriber"])
    found = {r.subscriber: (r.dropped, r.events) for r in last.collect()}
    assert found == {"all": (56, [56, 57, 58, 59]), "both": (56, [56, 57, 58, 59]), "a": (26, [52, 54, 56, 58])}


def test_heartbeats_of_silence(spark, batches):
    """Gaps inside a batch, between batches and behind the last event, as far as the watermark goes; late events take nothing back."""
    parts = [[(1, at(0)), (1, at(40)), (2, at(5))], [(1, at(71)), (2, at(100))], [(3, at(200))]]
    rows = streams.drain(bus.heartbeats(batches(parts, "subscriber long, ts timestamp"), 15)).collect()
    found = sorted((r.subscriber, r.beat_ms // 1000 - int(START.timestamp())) for r in rows)
    expected = [(1, s) for s in (15, 30, 55, 70)] + [(2, s) for s in (20, 35, 50, 65, 80, 95)]
    expected += [(1, s) for s in range(86, 201, 15)] + [(2, s) for s in range(115, 201, 15)]
    assert found == sorted(expected)


def test_pools_over_batches(spark, batches):
    schema = "event_id long, ts timestamp, pool long, job_id long, kind string, value double"
    events = [
        (1, 0, 10, "queued"), (2, 1, 11, "queued"), (3, 2, 12, "queued"), (4, 3, 10, "queued"), (5, 4, 11, "started"), (6, 5, 12, "other"),
        (7, 6, 11, "progress"), (8, 7, 10, "progress"), (9, 8, 11, "finished"), (10, 9, 11, "queued"), (11, 10, 13, "finished"), (12, 11, 10, "started"),
    ]
    parts = [[(e, at(t), 1, j, k, 250.0 if e == 7 else 30.0) for e, t, j, k in events[i : i + 4]] for i in (0, 4, 8)]
    rows = streams.drain(bus.pool_states(batches(parts, schema))).orderBy("event_id").collect()
    assert [(r.state, r.position, r.n_waiting, r.n_running, r.progress) for r in rows] == [
        ("waiting", 1, 1, 0, None), ("waiting", 2, 2, 0, None), ("waiting", 3, 3, 0, None), ("waiting", 1, 3, 0, None), ("running", None, 2, 1, 0.0),
        ("waiting", 2, 2, 1, None), ("running", None, 2, 1, 1.0), ("waiting", 1, 2, 1, None), ("unknown", None, 2, 0, None), ("waiting", 3, 3, 0, None),
        ("unknown", None, 3, 0, None), ("running", None, 2, 1, 0.0),
    ]


def test_pools_forget(spark, batches):
    schema = "event_id long, ts timestamp, pool long, job_id long, kind string, value double"
    parts = [[(1, at(0), 1, 10, "queued", 0.0)], [(2, at(100), 2, 20, "queued", 0.0)], [(3, at(101), 1, 11, "queued", 0.0)]]
    rows = streams.drain(bus.pool_states(batches(parts, schema), forget_s=50)).orderBy("event_id").collect()
    assert [(r.event_id, r.position, r.n_waiting) for r in rows] == [(1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_throttled_over_batches(spark, batches):
    import random

    rng = random.Random(3)
    events = [(k % 3, at(i * rng.choice([0.2, 1, 4])), round(rng.random(), 2)) for k in range(3) for i in range(300)]
    events.sort(key=lambda e: (e[1], e[2]))
    rows = streams.drain(streams.throttled(batches([events[:500], events[500:]], "job_id long, ts timestamp, progress double"), 0.4, 20.0)).collect()
    last, expected = {}, []
    for half in (events[:500], events[500:]):
        for job, ts, p in half:
            if job not in last or abs(p - last[job][1]) >= 0.4 or (ts - last[job][0]).total_seconds() >= 20:
                last[job] = (ts, p)
                expected.append((job, int(ts.timestamp() * 1_000_000 + 0.5), p))
    assert sorted((r.job_id, r.us, r.progress) for r in rows) == sorted(expected)


def test_predicates_go_below_their_joins(spark, tmp_path):
    for name, n in (("chunks", 3), ("videos", 2), ("documents", 2)):
        spark.range(n).select(F.col("id").alias("video_id"), F.col("id").alias("document_id"), F.lit(name).alias(name)).write.parquet(f"{tmp_path}/{name}")
    read = lambda name, *keep: spark.read.parquet(f"{tmp_path}/{name}").select(*keep, name)
    chunks, videos, documents = read("chunks", "video_id", "document_id"), read("videos", "video_id"), read("documents", "document_id")
    some = listing.across_satellites(chunks, [(videos, "video_id", [F.col("videos") == "videos"]), (documents, "document_id", [None])], [F.col("chunks") > "a"], [None])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(videos,videos)" in plan and "GreaterThan(chunks,a)" in plan and "LeftOuter" in plan and "Inner" in plan and some.count() == 2
    free = listing.across_satellites(chunks, [(videos, "video_id", [])], [], [F.col("videos").isNull()])
    assert [r.video_id for r in free.collect()] == [2]


@pytest.fixture
def fixed_partitions(spark):
    """Joins shuffle both sides to as many partitions as the session says."""
    fixed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in fixed}
    for k, v in fixed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("kind", ["long", "int", "short", "double", "string", "date"])
def test_rows_without_a_key(spark, fixed_partitions, kind):
    """They are dealt over the tasks of an outer join, and meet nothing, even where a key is the number they are dealt by."""
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")) if kind == "date" else n.cast(kind)
    chunks = spark.range(2000).select(F.col("id").alias("chunk_id"), F.when(F.col("id") < 200, day(F.col("id") % 50)).alias("video_id"), F.create_map("id", "id").alias("more"))
    keys = spark.range(50).select(day(F.col("id")).alias("video_id"))
    if kind in ("long", "int", "double", "string"):
        keys = keys.union(chunks.where("chunk_id >= 200").select(F.hash("chunk_id", "video_id").cast(kind))).distinct()
    videos = keys.select("video_id", F.concat(F.lit("v"), "video_id").alias("title"))
    found = listing.across_satellites(chunks, [(videos, "video_id", [])], [], [])
    assert set(found.columns) == {"chunk_id", "video_id", "more", "title"}
    rows = found.select("chunk_id", "video_id", "title", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.chunk_id for r in rows) == list(range(2000))
    assert all((r.title is None) == (r.chunk_id >= 200) == (r.video_id is None) for r in rows)
    assert all(r.title == f"v{r.video_id}" for r in rows if r.chunk_id < 200)
    if kind != "date":
        lacking = [r.task for r in rows if r.video_id is None]
        assert len(set(lacking)) == 8 and max(map(lacking.count, set(lacking))) < 400


def test_key_of_an_earlier_satellite(spark, fixed_partitions):
    chunks = spark.range(1000).select(F.col("id").alias("chunk_id"), F.when(F.col("id") % 4 == 0, F.col("id") % 40).alias("video_id"))
    videos = spark.range(20).select(F.col("id").alias("video_id"), F.when(F.col("id") < 8, F.col("id")).alias("work_id"))
    works = spark.range(5).select(F.col("id").alias("work_id"), F.lit("w").alias("work"))
    rows = listing.across_satellites(chunks, [(videos, "video_id", []), (works, "work_id", [])], [], [None])
    expected = {i: (v := i % 40 if i % 4 == 0 else None, w := v if v is not None and v < 8 else None, "w" if w is not None and w < 5 else None) for i in range(1000)}
    assert {r.chunk_id: (r.video_id, r.work_id, r.work) for r in rows.collect()} == expected
    held = listing.across_satellites(chunks, [(videos, "video_id", []), (works, "work_id", [F.col("work") == "w"])], [], [])
    assert sorted(r.chunk_id for r in held.collect()) == [i for i, x in expected.items() if x[2]]


def test_selection_in_one_scan(spark, tmp_path):
    works = [(1, True, False, "audio"), (2, False, False, "audio"), (3, False, True, "audio"), (4, True, False, "embedded"), (5, False, False, "embedded")]
    spark.createDataFrame(works, "work_id long, selected boolean, manual boolean, stage string").write.parquet(f"{tmp_path}/works")
    seen = Observation()
    rows = merge.apply_rule(spark.read.parquet(f"{tmp_path}/works"), F.col("work_id").isin(2, 3, 5), seen)
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert {r.work_id: (r.selected, r.action) for r in rows.collect()} == {1: (False, "removed"), 2: (True, "added"), 3: (False, "manual"), 4: (False, "removed"), 5: (True, "added")}
    assert seen.get == {"checked": 4, "added": 2, "removed": 2, "unchanged": 0}
    jobs = spark.createDataFrame([(1, "transcription", "waiting", None), (1, "audio", "done", None), (4, "audio", "running", None)], "work_id long, kind string, status string, error string")
    for automatic in (True, False):
        made = Observation()
        after = merge.jobs_after_selection(jobs, rows, automatic, made).collect()
        new = [(2, "transcription", "waiting")] if automatic else []
        assert sorted((r.work_id, r.kind, r.status) for r in after) == sorted([(1, "transcription", "aborted"), (1, "audio", "done"), (4, "audio", "running"), *new])
        assert made.get == {"created": len(new), "aborted": 1}


def test_batch_of_unknown_ids(spark):
    works = spark.createDataFrame([(1, True, False), (2, False, False), (3, True, False)], "work_id long, selected boolean, manual boolean")
    asked = spark.createDataFrame([(1,), (1,), (2,), (9,)], "work_id long")
    seen = Observation()
    found = {r.work_id: (r.selected, r.manual, r.action) for r in merge.select_batch(works, asked, True, seen).collect()}
    assert found == {1: (True, True, "unchanged"), 2: (True, True, "added"), 3: (True, False, "kept")}
    assert seen.get == {"asked": 3, "changed": 1, "unchanged": 1, "not_found": 1}


def test_a_pool_gives_its_rows_out_in_frames():
    """A batch of many events of one pool is neither rows nor a frame as a whole; its states follow each other through frames."""
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    n, jobs = 25_000, {}
    state = SimpleNamespace(iterator=lambda: iter(()), updateValue=lambda k, v: jobs.update({k: v}), removeKey=lambda k: jobs.pop(k, None))
    pool = bus.Pool(1000)
    pool.init(SimpleNamespace(getMapState=lambda *_: state, listTimers=lambda: [], registerTimer=lambda at: None))
    at = np.arange(n)[::-1]
    rows = pd.DataFrame({"us": at, "event_id": at, "job_id": at % 50, "kind": np.where(at < 50, 1, 0).astype(np.int8), "value": 0.0})
    frames = list(pool.handleInputRows((3,), iter([rows[:9000], rows[9000:]]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    assert max(map(len, frames)) <= 10_000 and sum(map(len, frames)) == n
    whole = pd.concat(frames)
    assert whole["event_id"].tolist() == list(range(n)) and (whole["position"][50:] == whole["job_id"][50:] + 1).all()
    assert len(jobs) == 50 and whole["n_waiting"].iloc[-1] == 50
