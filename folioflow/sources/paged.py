"""Paged listings of a service: a Python data source whose partitions are ranges of pages, and a drain that ends by distinct ids.

A page is a JSON object with its entries under one key and, under another, how many entries the service has in all. Services
cap page sizes without a word, repeat entries when new ones push old ones on, and some answer the last page again and again, so
neither page arithmetic nor an empty page tells when all has been read: the number of distinct ids does.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shared import cut, store_of

FORMAT = "paged_listing"
SCHEMA = "page int, position int, total long, entry string"
#: Most pages that one round reads; the driver gets one row a page of a round.
AHEAD = 10_000
#: Partitions that a round has at most, and how many times the pages of the round before one may read.
TASKS, GROWTH = 128, 16


class PagedError(ValueError):
    """What a service answered is no listing, or its pages lead nowhere."""


def fetch(url: str) -> bytes | None:
    """The content behind a URL: over HTTP, a file, or the files of a folder in their order; None where there is nothing."""
    if url.startswith(("http://", "https://")):
        try:
            with urllib.request.urlopen(url, timeout=60) as answer:  # noqa: S310
                return answer.read()
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            raise
    from pyarrow import fs

    store, path = store_of(url)
    found = store.get_file_info(path)
    if found.type == fs.FileType.NotFound:
        return None
    files = [path]
    if found.type == fs.FileType.Directory:
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", ".")))
    content = b""
    for file in files:
        with store.open_input_stream(file) as f:
            content += f.read()
    return content


@dataclass
class Pages(InputPartition):
    first: int
    last: int


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.items, self.total = options["url"], options.get("items", "videos"), options.get("total", "total")
        self.first, self.last, self.size = int(options.get("first", "1")), int(options.get("last", "1")), options.get("size", "50")

    def partitions(self) -> list[InputPartition]:
        width = -(-(self.last - self.first + 1) // TASKS)
        return [Pages(n, min(self.last, n + width - 1)) for n in range(self.first, self.last + 1, width)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        """The pages' entries as JSON, page by page; a page without any is one row with a null entry."""
        for n in range(partition.first, partition.last + 1):
            yield from self.page(n)

    def page(self, n: int) -> Iterator[tuple]:
        content = fetch(self.url.replace("{page}", str(n)).replace("{size}", self.size))
        try:
            page = json.loads(content) if content else {self.items: []}
        except ValueError as e:
            raise PagedError(f"page {n} is not JSON") from e
        entries = page.get(self.items) if isinstance(page, dict) else None
        if not isinstance(entries, list):
            raise PagedError(f"page {n} has no list of {self.items}")
        entries = [e for e in entries if isinstance(e, dict)]
        total = page.get(self.total)
        total = total if isinstance(total, int) else len(entries)
        if not entries:
            yield n, 0, total, None
        for i, e in enumerate(entries):
            yield n, i, total, json.dumps(e, ensure_ascii=False)


class PagedListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return PageReader(self.options)


def read_pages(spark: SparkSession, url: str, first: int, last: int, size: int = 50, items: str = "videos", total: str = "total") -> DataFrame:
    """SRC08: (page, position, total, entry) of the pages from ``first`` to ``last``, fetched by ``TASKS`` tasks at most.

    ``{page}`` and ``{size}`` in ``url`` stand for the page's number, from 1, and the size asked for.
    """
    if first < 1:
        raise PagedError("pages count from 1")
    spark.dataSource.register(PagedListing)
    return spark.read.format(FORMAT).options(url=url, first=first, last=last, size=size, items=items, total=total).load()


def drain(spark: SparkSession, url: str, id_key: str, size: int = 50, ahead: int = AHEAD, **keys: str) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """SRC10: all entries of a service, each id once where it first came, and (page, entries, new ids) of each page that counts.

    In the order of pages the listing ends at an empty page, or with the page that brings the distinct ids up to the total
    it names; a page before that with known ids alone is a ``PagedError``. Entries without an id don't count. The pages of a
    round are read at once, as many as the total still needs at the new ids that a page has brought so far, ``size`` at most (``ahead`` pages, and ``GROWTH`` times the round before, since a service may end early or repeat itself); the
    driver sees counts by page, and pages beyond the end are dropped. The rows are (id, page, position, entry), kept as a checkpoint.
    """
    seen, counted, known, total, following, width = None, [], 0, 1, 1, 1
    while True:
        brought = min(size, max(1, known // len(counted))) if counted else size
        width = min(ahead, width * GROWTH, -(-max(1, total - known) // brought)) if counted else 1
        last = following + width - 1
        rows = read_pages(spark, url, following, last, size, **keys)
        rows = cut(rows.withColumn("id", F.nullif(F.trim(F.get_json_object("entry", f"$.{id_key}")), F.lit(""))))
        first = rows.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("page", "position", "entry")).alias("f")).select("id", "f.*")
        fresh = cut(first if seen is None else first.join(seen.select("id"), "id", "left_anti"))
        new = fresh.groupBy("page").agg(F.count(F.lit(1)).alias("new"))
        pages = rows.groupBy("page").agg(F.count("entry").alias("n"), F.max("total").alias("total"))
        ended = False
        for page, n, total, more in pages.join(new, "page", "left").select("page", "n", "total", F.coalesce("new", F.lit(0))).orderBy("page").collect():  # noqa: B007
            ended = n == 0
            if ended:
                break
            if more == 0:
                raise PagedError(f"page {page} brings nothing new")
            counted.append((page, n, more))
            known += more
            ended = known >= total
            if ended:
                break
        until = counted[-1][0] if counted else 0
        kept = fresh.where(F.col("page") <= until)
        seen = kept if seen is None else seen.unionByName(kept)
        if ended:
            return seen, counted
        following = last + 1


def page_of(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """SRC07: page ``number``, from 1, of a folder's or table's rows in this order."""
    if number < 1:
        raise PagedError("pages count from 1")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)
