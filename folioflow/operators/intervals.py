"""Interval and as-of lookups: in the row for a work's own short lists, as joins by work for tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE_S = 0.05


def topic_at(topics: Column, t: Column) -> Column:
    """RNG01: the first topic (title, start, end) that holds ``t``, else the one begun last before, else nothing."""
    inside = F.get(F.filter(topics, lambda x: (x["start"] <= t) & (t <= x["end"])), F.lit(0))["title"]
    begun = F.transform(
        F.filter(F.transform(topics, lambda x, i: F.struct(x["start"].alias("s"), (-i).alias("i"), x["title"].alias("title"))), lambda x: x["s"] <= t),
        lambda x: x,
    )
    return F.coalesce(inside, F.array_max(begun)["title"], F.lit(""))


def as_of(rows: DataFrame, topics: DataFrame, work_col: str = "work_id", time_col: str = "t") -> DataFrame:
    """RNG01 over tables: each row with the topic of its work that has the greatest start at or before its time.

    One sort by work over both tables instead of a join of all pairs: a work's last topic is carried forward.
    """
    marked = topics.select(work_col, F.col("start").alias(time_col), F.lit(0).alias("__k"), F.struct("title", "start").alias("topic"))
    both = rows.withColumn("__k", F.lit(1)).unionByName(marked, allowMissingColumns=True)
    w = Window.partitionBy(work_col).orderBy(time_col, "__k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("topic", F.last("topic", ignorenulls=True).over(w)).where("__k = 1").drop("__k")


def in_window(segments: Column, start: Column, end: Column) -> Column:
    """RNG02: the segments (start, end, text) whose middle lies in the window, with some tolerance."""
    middle = lambda s: (s["start"] + s["end"]) / 2
    return F.filter(segments, lambda s: (middle(s) >= start - TOLERANCE_S) & (middle(s) <= end + TOLERANCE_S))


def section_at(sections: Column, middle: Column) -> Column:
    """RNG03, RNG05: the first section (id, start, end) with start <= middle < end, else the first of all."""
    found = F.filter(sections, lambda s: (s["start"] <= middle) & (middle < s["end"]))
    return F.coalesce(F.get(found, F.lit(0))["id"], F.get(sections, F.lit(0))["id"])


def compare_blocks(paragraphs: DataFrame, segments: DataFrame, work_col: str = "work_id", bucket_s: float = 60.0) -> DataFrame:
    """RNG04: each block's window, corrected text, and the raw text of the segments whose middle lies in it.

    paragraphs: (work, block, start, end, text), segments: (work, start, end, text). Blocks and segments meet in buckets
    of ``bucket_s`` seconds: a segment is in the bucket of its middle, a block in all that its window touches.
    """
    blocks = paragraphs.groupBy(work_col, "block").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), "\n\n").alias("corrected"),
    )
    bucket = lambda t: F.floor(t / bucket_s)
    low, high = F.col("start") - TOLERANCE_S, F.col("end") + TOLERANCE_S
    windows = blocks.select(work_col, "block", low.alias("__low"), high.alias("__high"), F.explode(F.sequence(bucket(low), bucket(high))).alias("__b"))
    middle = (F.col("start") + F.col("end")) / 2
    placed = segments.select(work_col, bucket(middle).alias("__b"), middle.alias("__m"), F.struct("start", F.col("text").alias("t")).alias("s"))
    met = windows.join(placed, [work_col, "__b"]).where(F.col("__m").between(F.col("__low"), F.col("__high")))
    texts = F.transform(F.sort_array(F.collect_list("s")), lambda x: x["t"])
    raw = met.groupBy(work_col, "block").agg(F.array_join(texts, " ").alias("raw"))
    return blocks.join(raw, [work_col, "block"], "left").withColumn("raw", F.coalesce("raw", F.lit("")))
