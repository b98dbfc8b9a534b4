"""Interchange packages: one folder of JSON lines a table, and a manifest of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT, VERSION = "folioflow-library", 1


def write_package(tables: dict[str, DataFrame], folder: str, dimension: int) -> None:
    """SNK01, SNK02, SNK07: each table as JSON lines under its name, written by all tasks, and ``manifest``, one row.

    The manifest is written last and is read first, so a package that lacks it is not whole. It counts what was written.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{folder}/{name}")
    counts = None
    for name, rows in tables.items():
        one = read_table(spark, folder, name, rows.schema).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        counts = one if counts is None else counts.union(one)
    listed = counts.agg(F.sort_array(F.collect_list(F.struct("name", "rows"))).alias("tables"))  # one entry a table
    manifest = listed.select(F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), F.lit(dimension).alias("dimension"), "tables")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def read_table(spark: SparkSession, folder: str, name: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """SRC20, SRC21: a table of a package by an explicit schema; unknown fields are ignored.

    A line that is no such row fails the read, or is kept in ``_corrupt_record`` if not ``strict``.
    """
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/{name}")
    marked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(marked).option("mode", "PERMISSIVE").json(f"{folder}/{name}")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    schema = "format string, version int, dimension int, tables array<struct<name:string,rows:bigint>>"
    return spark.read.schema(schema).json(f"{folder}/manifest")
