"""Folders that the driver and all executors share, and DataFrames kept in them."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, as a URI.

    Where it is unset, as in tests, a session on one machine gets a temporary folder of its own; on a cluster that is an
    error, since executors would write to folders that nobody else sees.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="folioflow-")
    return base if "://" in base else f"file://{os.path.abspath(base.removeprefix('file:'))}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path, as a URI, in the shared folder."""
    return f"{base_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``shared_folder`` has named, on whatever file system it is."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a checkpoint in the shared folder, so a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base_folder(df.sparkSession))
    return df.checkpoint()


def store_of(uri: str):
    """(file system, path in it) of a URI, for tasks that seek in files; schemes as Spark names them."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://|^file:/+", lambda m: "s3://" if m[0].startswith("s3") else "file:///", uri))
