"""Downloads resumed by byte ranges: what has come, what is missing, and the file put together again.

Ranges are half-open and may overlap or repeat. Only their bounds go through the windows by file; contents are joined
to the ranges that give new bytes. A file of many ranges is one window of bounds, without the bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _before(key: str) -> tuple:
    w = Window.partitionBy(key).orderBy("start", "end", "id")
    return w, F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def joined(ranges: DataFrame, key: str = "path") -> DataFrame:
    """SRC22: (key, start, end) of the stretches that ranges (key, id, start, end) cover together; touching ones are one."""
    w, before = _before(key)
    some = ranges.select(key, "id", "start", "end").where(F.col("end") > F.col("start"))
    opened = some.withColumn("__new", (F.row_number().over(w) == 1) | (F.col("start") > before))
    numbered = opened.withColumn("__n", F.sum(F.col("__new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "__n").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__n")


def missing(ranges: DataFrame, files: DataFrame, most: int, key: str = "path") -> DataFrame:
    """SRC22: (key, start, end) of the next requests: what ranges leave of files (key, bytes), at most ``most`` bytes each.

    A file without a range is missing as a whole; an empty file never is. Bytes beyond a file's end don't count.
    """
    have = joined(ranges, key).withColumnRenamed("end", "till")
    w = Window.partitionBy(key).orderBy("start")
    ends = files.select(key, "bytes", F.col("bytes").alias("start"), F.col("bytes").alias("till"))
    known = files.select(F.col(key), F.col("bytes")).join(have, key).select(key, "bytes", "start", "till").unionByName(ends)
    gaps = known.withColumn("from", F.coalesce(F.max("till").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    gaps = gaps.select(key, "from", F.least("start", "bytes").alias("to")).where(F.col("from") < F.col("to"))
    each = gaps.select(key, "to", F.explode(F.sequence(F.col("from"), F.col("to") - 1, F.lit(most).cast("long"))).alias("start"))
    return each.select(key, "start", F.least(F.col("start") + most, F.col("to")).alias("end"))


def pieces(ranges: DataFrame, key: str = "path") -> DataFrame:
    """SRC22: (key, start, content) of the bytes that each of ranges (key, id, start, end, content) adds to those before it.

    The pieces don't overlap, and in order of ``start`` they are the file as far as it has come.
    """
    _, before = _before(key)
    cuts = ranges.select(key, "id", "start", "end").withColumn("__from", F.greatest("start", before)).where(F.col("__from") < F.col("end"))
    both = ranges.select(key, "id", "content").join(cuts, [key, "id"])
    content = F.substring(F.col("content"), (F.col("__from") - F.col("start") + 1).cast("int"), (F.col("end") - F.col("__from")).cast("int"))
    return both.select(key, F.col("__from").alias("start"), content.alias("content"))


def assembled(parts: DataFrame, key: str = "path") -> DataFrame:
    """SRC22: (key, content) of files that fit in a row, from their pieces, for ``files.verified``."""
    hexed = F.transform(F.sort_array(F.collect_list(F.struct("start", F.hex("content").alias("h")))), lambda p: p["h"])
    return parts.groupBy(key).agg(F.unhex(F.array_join(hexed, "")).alias("content"))
