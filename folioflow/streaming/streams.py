"""Event streams: latest state per job, throughput in windows, stuck jobs, throttled progress.

A stream is read from files as they arrive and written by micro-batch; ``drain`` runs what is there and gives the
result as a table. Spark never drops events under load, it reads fewer files a batch (``maxFilesPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shared import cut, remove_folder, shared_folder

# Spark's setting of where streams keep their state, and its store on disk.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(spark: SparkSession, folder: str, glob: str, schema: Any, files_per_batch: int = 100) -> DataFrame:
    """STM01: files of a folder as a stream, oldest first, so many a batch at most."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what has arrived; its output rows with the number of the batch that wrote them as ``batch``."""
    spark = stream.sparkSession
    out, state = shared_folder(spark, "stream"), shared_folder(spark, "state")
    provider = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # the state API's lists, maps and timers need it

    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])

    def write(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number:09d}")  # again: the same

    spark.createDataFrame([], schema).write.parquet(f"{out}/start")  # so that a stream without events has a result
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    try:
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, provider) if provider else spark.conf.unset(PROVIDER)
    remove_folder(spark, state)
    rows = cut(spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out))
    remove_folder(spark, out)
    return rows


def final(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return updates.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "batch")


def latest(stream: DataFrame, keys: list[str], time_col: str, *values: str) -> DataFrame:
    """STM07, STM08: each key's latest values, ties to the greatest; updates."""
    last = F.max(F.struct(time_col, *values)).alias("last")
    return stream.groupBy(*keys).agg(last).select(*keys, "last.*")


def throughput(stream: DataFrame, time_col: str, kind_col: str, length: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """STM06: events by kind in windows of time; updates; windows older than ``late`` are closed and leave the state."""
    window = F.window(time_col, length, slide) if slide else F.window(time_col, length)
    counts = stream.withWatermark(time_col, late).groupBy(window.alias("w"), kind_col).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), kind_col, "n")


def stuck(jobs: DataFrame, now: Column, limit_s: int, status: str = "status", beat: str = "heartbeat") -> DataFrame:
    """STM04 on a table: running jobs without a sign of life for too long are in error."""
    old = F.coalesce(F.unix_seconds(now) - F.unix_seconds(beat) > limit_s, F.lit(True))
    return jobs.withColumn(status, F.when((F.col(status) == "running") & old, "error").otherwise(F.col(status)))


def stuck_stream(stream: DataFrame, limit_s: int) -> DataFrame:
    """STM04 on a stream of (job_id, ts): a row (job_id, last) once no event has come for ``limit_s`` of event time.

    The state of a job is its last sign of life, and a timer on the watermark.
    """

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "last": [pd.Timestamp(last, unit="us")]})
            return
        last = max(int(b["us"].max()) for b in batches)
        last = max(last, state.get[0]) if state.exists else last
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + limit_s * 1000, state.getCurrentWatermarkMs() + 1))

    marked = stream.withWatermark("ts", "0 seconds").withColumn("us", F.unix_micros("ts"))
    return marked.groupBy("job_id").applyInPandasWithState(
        watch, "job_id long, last timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def throttled(stream: DataFrame, step: float = 0.01, seconds: float = 1.0) -> DataFrame:
    """STM09: of (job_id, ts, progress), those with ``step`` more than the last one passed on, or so many seconds later.

    The state of a job is the last event passed on; within a batch its events are taken in order of time, of which a
    task holds two numbers an event of one job.
    """

    def pass_on(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [(b["us"].to_numpy(), b["progress"].to_numpy()) for b in batches]
        times, values = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((values, times))
        times, values = times[order], values[order]
        at, done = state.get if state.exists else (int(times[0]), None)
        keep, i = [], 0
        if done is None:
            keep, done, i = [0], float(values[0]), 1
        while i < len(times):
            # The next event passed on is the first with enough progress or late enough; look in growing strides.
            late = int(np.searchsorted(times, at + seconds * 1e6, side="left"))
            width, found = 64, None
            while found is None and i < min(late, len(times)):
                far = np.flatnonzero(np.abs(values[i : min(i + width, late)] - done) >= step)
                found = i + int(far[0]) if len(far) else None
                i, width = min(i + width, late), 2 * width
            found = max(late, i) if found is None else found
            if found >= len(times):
                break
            keep.append(found)
            at, done, i = int(times[found]), float(values[found]), found + 1
        state.update((at, done))
        yield pd.DataFrame({"job_id": np.full(len(keep), key[0]), "us": times[keep], "progress": values[keep]})

    return stream.withColumn("us", F.unix_micros("ts")).select("job_id", "us", "progress").groupBy("job_id").applyInPandasWithState(
        pass_on, "job_id long, us long, progress double", "us long, progress double", "append", GroupStateTimeout.NoTimeout
    )
