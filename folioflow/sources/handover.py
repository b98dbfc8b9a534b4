"""Handovers: tables written as JSON lines by a sink that commits in two phases, packed into parts with checksums.

Each task writes one file and answers with its size, rows and digest; only the driver's commit, which sees the answers of the
tasks that count, lists the files. Files that a failed or repeated task has left are in no list. The listed files are
packed into tar archives of a bounded size by one task each, and the manifest is written last: what lacks it is no handover.
"""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..shared import store_of
from .package import FORMAT, VERSION

SINK = "json_lines_committed"
PART_BYTES, BLOCK = 1 << 30, 1 << 20
MANIFEST, SUMS = "manifest.json", "SHA256SUMS"


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    bytes: int
    rows: int
    sha256: str


class _Counted(io.RawIOBase):
    """A stream that counts and digests what goes into it."""

    def __init__(self, out) -> None:  # noqa: ANN001
        self.out, self.digest, self.size = out, hashlib.sha256(), 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:  # noqa: ANN001
        data = bytes(data)
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)
        return len(data)


class LineWriter(DataSourceWriter):
    def __init__(self, folder: str, table: str) -> None:
        self.folder, self.table = folder, table

    def write(self, rows: Iterator) -> Written:
        """One file of a task's lines, named after its partition; a task without rows writes none."""
        partition = TaskContext.get().partitionId()
        name = f"{self.table}/{partition:06d}-{uuid.uuid4().hex}.jsonl"
        store, place = store_of(f"{self.folder}/{name}")
        out, n = None, 0
        for row in rows:
            if out is None:
                store.create_dir(place.rpartition("/")[0], recursive=True)
                out = _Counted(store.open_output_stream(place))
            out.write(row[0].encode() + b"\n")
            n += 1
        if out is None:
            return Written(partition, "", 0, 0, "")
        out.out.close()
        return Written(partition, name, out.size, n, out.digest.hexdigest())

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted((m for m in messages if m and m.name), key=lambda m: m.partition)
        listed = [{"path": m.name, "rows": m.rows, "bytes": m.bytes, "sha256": m.sha256} for m in files]
        _put(f"{self.folder}/{self.table}.files.json", json.dumps(listed).encode())

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.name:
                store, place = store_of(f"{self.folder}/{m.name}")
                store.delete_file(place)


class CommittedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return SINK

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return LineWriter(self.options["folder"], self.options["table"])


def _put(uri: str, content: bytes) -> None:
    store, place = store_of(uri)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    with store.open_output_stream(place) as f:
        f.write(content)


def _get(uri: str) -> bytes:
    store, place = store_of(uri)
    with store.open_input_stream(place) as f:
        return f.read()


@dataclass
class Table:
    """A table of a handover: its rows in a fixed order, and the column that marks current versions, if it has versions."""

    name: str
    rows: DataFrame
    order: list[str | Column]
    current: str | None = None


def write_lines(t: Table, folder: str) -> list[dict]:
    """SNK01, SNK02: the table's current rows as JSON lines in its order, by all tasks; the files of the commit, in that order.

    Tasks sort ranges of the order, so files follow each other in it. The column of current versions is left out.
    """
    spark = t.rows.sparkSession
    spark.dataSource.register(CommittedLines)
    rows = t.rows.where(F.col(t.current)).drop(t.current) if t.current else t.rows
    line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    rows.orderBy(*t.order).select(line.alias("line")).write.format(SINK).mode("append").options(folder=folder, table=t.name).save()
    return json.loads(_get(f"{folder}/{t.name}.files.json"))


def pack(files: list[dict], most: int) -> list[list[dict]]:
    """SNK06 for files: parts of neighbouring files of ``most`` bytes together; a larger file is a part of its own."""
    parts: list[list[dict]] = []
    room = 0
    for f in files:
        if not parts or f["bytes"] > room:
            parts.append([])
            room = most
        parts[-1].append(f)
        room -= f["bytes"]
    return parts


def _tar(folder: str, name: str, first: bytes | None, paths: list[tuple[str, int]]) -> tuple[int, str]:
    """One part, written under another name and then moved, so a repeated task leaves a whole one; its size and digest."""
    store, place = store_of(f"{folder}/{name}")
    own = f"{place}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        out = _Counted(f)
        with tarfile.open(fileobj=out, mode="w|", format=tarfile.PAX_FORMAT, bufsize=BLOCK) as tar:
            if first is not None:
                info = tarfile.TarInfo(MANIFEST)
                info.size = len(first)
                tar.addfile(info, io.BytesIO(first))
            for path, size in paths:
                info = tarfile.TarInfo(path)
                info.size = size
                source, at = store_of(f"{folder}/{path}")
                with source.open_input_stream(at) as content:
                    tar.addfile(info, content)
    store.move(own, place)
    return out.size, out.digest.hexdigest()


def write_handover(tables: list[Table], folder: str, dimension: int, part_bytes: int = PART_BYTES) -> dict:
    """SNK02, SNK07: tables as a handover in ``folder``; its manifest.

    The parts are tar archives ``part-<n>.tar`` of the tables' files in the order given, ``part_bytes`` of files each; the
    first one begins with the package's own manifest (format, version, time, dimension, rows by table). ``manifest.json`` lists
    parts and files with sizes and digests and is written last, beside the parts' digests in ``SHA256SUMS``. A part is
    written by one task from file to file; the driver holds the lists alone, an entry for each task that wrote.
    """
    spark = tables[0].rows.sparkSession
    files = {t.name: write_lines(t, folder) for t in tables}
    counts = {name: sum(f["rows"] for f in found) for name, found in files.items()}
    package = {"format": FORMAT, "version": VERSION, "created": datetime.now(UTC).isoformat(timespec="seconds"), "dimension": dimension, "rows": counts}
    packed = pack([f for t in tables for f in files[t.name]], part_bytes) or [[]]
    rows = [
        (n, f"part-{n:05d}.tar", json.dumps(package, indent=1).encode() if n == 1 else None, [(f["path"], f["bytes"]) for f in part])
        for n, part in enumerate(packed, 1)
    ]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size, digest = _tar(folder, row["name"], row["first"], [(f["path"], f["bytes"]) for f in row["files"]])
                yield pa.RecordBatch.from_pylist([{"n": row["n"], "name": row["name"], "bytes": size, "sha256": digest}])

    jobs = spark.createDataFrame(rows, "n long, name string, first binary, files array<struct<path:string,bytes:long>>")
    parts = jobs.repartition(len(rows), "n").mapInArrow(write, "n long, name string, bytes long, sha256 string")
    listed = [r.asDict() for r in parts.orderBy("n").collect()]
    manifest = package | {"parts": listed, "files": files}
    _put(f"{folder}/{SUMS}", "".join(f"{p['sha256']}  {p['name']}\n" for p in listed).encode())
    _put(f"{folder}/{MANIFEST}", json.dumps(manifest, indent=1).encode())
    return manifest


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of all parts and files of a handover, for ``files.verified``."""
    text = spark.read.text(f"{folder}/{MANIFEST}", wholetext=True)
    one = "struct<path:string,bytes:bigint,sha256:string>"
    parts = F.from_json("value", "parts array<struct<name:string,bytes:bigint,sha256:string>>")["parts"]
    files = F.flatten(F.map_values(F.from_json("value", f"files map<string,array<{one}>>")["files"]))
    every = F.concat(F.transform(parts, lambda p: F.struct(p["name"].alias("path"), p["bytes"].alias("bytes"), p["sha256"].alias("sha256"))), files)
    return text.select(F.explode(every).alias("f")).select("f.*")


def handovers(spark: SparkSession, folder: str) -> DataFrame:
    """TOP14: (path, created, version, n_parts) of the handovers below a folder, newest first; unreadable manifests are left out.

    A manifest is readable if it is JSON of this format with a time; a folder without one is no handover.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", MANIFEST).option("recursiveFileLookup", True).load(folder)
    m = F.from_json(F.decode("content", "utf-8"), "format string, version int, created timestamp, parts array<struct<name:string>>")
    rows = found.select("path", m.alias("m")).where((F.col("m.format") == FORMAT) & F.col("m.created").isNotNull())
    return rows.select("path", "m.created", "m.version", F.coalesce(F.size("m.parts"), F.lit(0)).alias("n_parts")).orderBy(F.desc("created"), "path")
