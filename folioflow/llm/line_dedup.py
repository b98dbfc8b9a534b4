"""Line dedup by overlapping windows of three lines.

Lines that hold more than white space are numbered within their document; every three neighbours among them
are hashed as one window. A window that occurs more than once in the corpus stays at its first place, by
document id and then position; every line that a later occurrence covers is removed. Windows overlap, so what
they cover is merged: a passage of any length is removed line by line, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, let, text_of

WIDTH = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _said(line: Column) -> Column:
    """Whether a line holds more than white space."""
    return F.translate(line, WHITE, "") != ""


def _numbered(text: Column) -> Column:
    """Array of (p: position among all lines, s: the line) of the lines with more than white space."""
    every = F.transform(_lines(text), lambda s, i: F.struct(i.alias("p"), s.alias("s")))
    return F.filter(every, lambda x: _said(x["s"]))


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, first, lines, h): each window's place, the positions of its lines and its 128-bit hash."""

    def cut_windows(n: Column) -> Column:
        starts = F.when(F.size(n) >= width, F.sequence(F.lit(0), F.size(n) - width)).otherwise(
            F.array().cast("array<int>")
        )
        parts = lambda i, field: [F.get(n, i + k)[field] for k in range(width)]
        return F.transform(
            starts,
            lambda i: F.struct(
                F.array(*parts(i, "p")).alias("lines"),
                F.unhex(F.md5(F.concat_ws("\n", *parts(i, "s")))).alias("h"),
            ),
        )

    found = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.explode(let(_numbered(text_of(text_col)), cut_windows)).alias("w")
    )
    return found.select("doc_id", F.col("w.lines")[0].alias("first"), "w.lines", "w.h")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, gone): for each document that loses lines, the sorted positions of these lines."""
    every = windows(docs, id_col, text_col, width)
    repeated = (
        every.groupBy("h")
        .agg(F.min(F.struct("doc_id", "first")).alias("keep"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("h", "keep")
    )
    later = every.join(repeated, "h").where(F.struct("doc_id", "first") != F.col("keep"))
    return (
        later.select("doc_id", F.explode("lines").alias("p"))
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_set("p")).alias("gone"))
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The input's rows and columns with the text less its repeated lines, and ``n_lines``, ``n_removed_lines``.

    ``n_lines`` counts the lines with more than white space. A null text counts as empty and becomes empty.
    Documents of under three such lines have no window and stay as they are. Blank lines stay. Rows that share
    a document id count as one document at one place and are treated alike; a row with a null id neither
    removes nor loses lines. Input columns of the two new names are replaced. Hot windows are counted before
    the shuffle and meet one row each in the join, whose large partitions Spark splits.
    """
    gone = repeated_lines(docs, id_col, text_col, width).withColumnsRenamed({"doc_id": "__id", "gone": "__gone"})
    joined = docs.drop("n_lines", "n_removed_lines").join(gone, F.col(id_col) == F.col("__id"), "left")
    text = text_of(text_col)

    def rest(lines: Column) -> Column:
        keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
        return F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n")

    return (
        joined.withColumn("n_lines", F.size(F.filter(_lines(text), _said)).cast("long"))
        .withColumn("n_removed_lines", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
        .withColumn(text_col, F.when(F.col("__gone").isNull(), text).otherwise(let(_lines(text), rest)))
        .drop("__gone", "__id")
    )
