"""Tar archives as tables: an index of members from their headers, and lines read by ranges of members.

A tar archive holds its members one after another, so a scan that reads the headers and seeks over the contents gives each
member's place; tasks then read ranges of members side by side. A compressed archive can't be entered in the middle: it
is one range, read as a stream.
"""

from __future__ import annotations

import json
import tarfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shared import store_of

LINES, MEMBERS = "tar_lines", "tar_members"
RANGE_BYTES, BLOCK = 32 << 20, 1 << 20
#: Tasks that many small ranges or archives are dealt to.
TASKS = 64


def _packed(path: str) -> bool:
    return path.endswith((".gz", ".tgz"))


def _headers(path: str) -> list[tuple[int, str, int, int]]:
    """(number, name, offset, bytes) of the regular files of an archive that is not compressed."""
    store, place = store_of(path)
    with store.open_input_file(place) as f, tarfile.open(fileobj=f, mode="r:") as tar:
        return [(i, m.name.removeprefix("./"), m.offset_data, m.size) for i, m in enumerate(x for x in tar if x.isfile())]


def _stream(path: str) -> Iterator[tuple[int, tarfile.TarInfo, object]]:
    """(number, header, content) of the regular files of a compressed archive, each once, in their order."""
    store, place = store_of(path)
    with store.open_input_stream(place, compression=None) as f, tarfile.open(fileobj=f, mode="r|gz") as tar:
        for i, m in enumerate(x for x in tar if x.isfile()):
            yield i, m, tar.extractfile(m)


@dataclass
class Archive(InputPartition):
    path: str


@dataclass
class Archives(InputPartition):
    paths: list[str]


@dataclass
class Range:
    path: str
    number: int
    name: str
    offset: int
    size: int
    begin: int
    end: int


@dataclass
class Ranges(InputPartition):
    ranges: list[Range]


def _groups(ranges: list[Range]) -> list[Ranges]:
    """Neighbouring ranges of ``RANGE_BYTES`` together, so that small ones are no tasks of their own; but ``TASKS`` tasks where there are as many."""
    share = min(RANGE_BYTES, -(-sum(r.end - r.begin for r in ranges) // TASKS))
    out, held = [], 0
    for r in ranges:
        if not out or held >= share:
            out.append(Ranges([]))
            held = 0
        out[-1].ranges.append(r)
        held += r.end - r.begin
    return out


class MemberReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        width = -(-len(self.paths) // TASKS) or 1
        return [Archives(self.paths[i : i + width]) for i in range(0, len(self.paths), width)]

    def read(self, partition: Archives) -> Iterator[tuple]:
        for path in partition.paths:
            if _packed(path):
                for i, m, _ in _stream(path):
                    yield path, i, m.name.removeprefix("./"), m.size
            else:
                for i, name, _, size in _headers(path):
                    yield path, i, name, size


class LineReader(DataSourceReader):
    def __init__(self, paths: list[str], ending: str, width: int) -> None:
        self.paths, self.ending, self.width = paths, ending, width

    def partitions(self) -> list[InputPartition]:
        plain = [p for p in self.paths if not _packed(p)]
        with ThreadPoolExecutor(16) as pool:  # headers only, as Spark lists files
            found = list(pool.map(_headers, plain))
        ranges = [
            Range(p, i, name, offset, size, a, min(size, a + self.width))
            for p, members in zip(plain, found, strict=True)
            for i, name, offset, size in members
            if name.endswith(self.ending)
            for a in range(0, size, self.width)
        ]
        return [*_groups(ranges), *(Archive(p) for p in self.paths if _packed(p))]

    def read(self, partition: Ranges | Archive) -> Iterator[tuple]:
        """Lines that begin in the ranges, whole, with the place in their member that they begin at."""
        if isinstance(partition, Archive):
            for i, m, content in _stream(partition.path):
                at = 0
                for line in content if m.name.endswith(self.ending) else ():
                    yield partition.path, m.name.removeprefix("./"), i, at, line.rstrip(b"\n").decode()
                    at += len(line)
            return
        for r in partition.ranges:
            yield from self.lines(r)

    def lines(self, p: Range) -> Iterator[tuple]:
        store, place = store_of(p.path)
        with store.open_input_file(place) as f:
            at = max(0, p.begin - 1)  # a line begins behind a line end, which may be the byte before the range
            f.seek(p.offset + at)
            held, skip = b"", p.begin > 0
            while at < p.end:
                more = f.read(min(BLOCK, p.size - at - len(held)))
                *lines, held = (held + more).split(b"\n")
                if not more and held:
                    lines, held = [*lines, held], b""
                for line in lines:
                    if not skip and at < p.end:
                        yield p.path, p.name, p.number, at, line.decode()
                    skip = False
                    at += len(line) + 1
                if not more:
                    return


class TarMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return MEMBERS

    def schema(self) -> str:
        return "archive string, number int, member string, bytes long"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return MemberReader(json.loads(self.options["archives"]))


class TarLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return LINES

    def schema(self) -> str:
        return "archive string, member string, number int, at long, line string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return LineReader(json.loads(self.options["archives"]), self.options.get("ending", ".jsonl"), int(self.options.get("width", RANGE_BYTES)))


def members(spark: SparkSession, archives: list[str]) -> DataFrame:
    """SRC21: (archive, number, member, bytes) of the files in archives, numbered in their order."""
    spark.dataSource.register(TarMembers)
    return spark.read.format(MEMBERS).option("archives", json.dumps(archives)).load()


def lines(spark: SparkSession, archives: list[str], ending: str = ".jsonl", width: int = RANGE_BYTES) -> DataFrame:
    """SRC21: (archive, member, number, at, line) of the members with this ending, each byte read by one task."""
    spark.dataSource.register(TarLines)
    return spark.read.format(LINES).options(archives=json.dumps(archives), ending=ending, width=width).load()


def table_of(member):  # noqa: ANN001, ANN201
    """The table that a member holds: ``<table>.jsonl`` or ``<table>/<anything>``."""
    return F.regexp_extract(member, r"^([^/.]+)", 1)


def order_errors(found: DataFrame, parents: dict[str, str], first: str = "manifest.json") -> DataFrame:
    """SRC21: (archive, error) of packages that can't be read in one go; ``found`` is ``members`` with a package an archive.

    ``first`` must be the first member, no member may come twice, and of ``parents`` (table: its parent's) every member of
    the parent must stand before the table's. An archive has few members, so they are looked at in its row.
    """
    m = F.sort_array(F.collect_list(F.struct("number", "member", table_of(F.col("member")).alias("t"))))
    rows = found.groupBy("archive").agg(m.alias("m"))
    numbers = lambda t: F.transform(F.filter("m", lambda x: x["t"] == t), lambda x: x["number"])
    late = [
        F.when(F.array_max(numbers(parent)) > F.array_min(numbers(child)), F.lit(f"{child} stands before {parent}"))
        .when((F.size(numbers(child)) > 0) & (F.size(numbers(parent)) == 0), F.lit(f"{child} has no {parent}"))
        for child, parent in parents.items()
    ]
    names = F.transform("m", lambda x: x["member"])
    twice = F.when(F.size(F.array_distinct(names)) < F.size(names), F.lit("a member comes twice"))
    start = F.when(~(F.get(names, F.lit(0)) == first), F.lit(f"{first} is not the first member"))
    errors = F.array_compact(F.array(start, twice, *late))
    return rows.select("archive", F.explode(errors).alias("error"))
