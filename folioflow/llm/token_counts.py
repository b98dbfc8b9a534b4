"""Token counts of the documents in flat token files that have no index.

A flat file is little-endian token ids, each document closed by an end-of-document id. Files are cut into blocks by
their length alone; tasks read their blocks and find the end ids with one vectorised comparison. A document may cross
any number of blocks: a prefix scan over the blocks' counts and last ends says, for each block, how many documents
ended before it and where the open one began.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import read_ranks, strides, tokenizer
from .common import cut, text_of

KINDS = {2: "<u2", 4: "<u4"}
BLOCK_TOKENS, FILE_BYTES = 1 << 21, 64 << 20


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI as Spark's readers name it."""
    return fs.FileSystem.from_uri(re.sub(r"^(s3)[an]://|^file:/+", lambda m: "s3://" if m[1] else "file:///", uri))


def write_flat(
    docs: DataFrame, folder: str, ranks: str, pattern: str, eod: int, width: int = 2, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode whole texts and write them to flat files in ``folder``; gives (id, file, doc), the place of each row.

    ``folder`` is one that all executors reach. Each task writes its rows, in their order, to files of about
    ``FILE_BYTES`` under names of its partition; a repeated task writes the same files again, and a file appears
    under its name only when it is whole. The result is checkpointed, so the files are written once it is returned.
    A null text counts as empty; an empty document is its end id alone. One row per input row, repeated rows and null ids
    included; an empty table writes nothing. Other columns are not carried. Ids that ``width`` bytes can't hold are an error.
    """
    if max(eod, max(read_ranks(ranks).values())) >= 1 << 8 * width:
        raise ValueError(f"ids of this tokenizer do not fit into {width} bytes")
    source = docs.select(F.col(id_col), text_of(text_col).alias("__text"))
    kind = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        own, part, number = tokenizer(ranks, pattern), TaskContext.get().partitionId(), 0
        out, size, docs_in, temporary = None, 0, 0, ""

        def name() -> str:
            return f"tokens-{part:06d}-{number:04d}.bin"

        def close() -> None:
            out.close()
            store.move(temporary, f"{base}/{name()}")

        for batch in batches:
            files, places = [], []
            for texts in strides(batch.column(1).to_pylist()):
                for ids in own.encode(texts):
                    if out is not None and size >= FILE_BYTES:
                        close()
                        out, number, size, docs_in = None, number + 1, 0, 0
                    if out is None:
                        temporary = f"{base}/.{uuid.uuid4().hex}"
                        out = store.open_output_stream(temporary)
                    raw = np.append(np.frombuffer(ids, "<u4"), np.uint32(eod)).astype(KINDS[width]).tobytes()
                    out.write(raw)
                    size += len(raw)
                    files.append(name())
                    places.append(docs_in)
                    docs_in += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(files, pa.string()), pa.array(places, pa.int64())], [id_col, "file", "doc"]
            )
        if out is not None:
            close()

    store, base = _store(folder)
    store.create_dir(base)
    return cut(source.mapInArrow(run, f"`{id_col}` {kind}, file string, doc long"))


def _scan(batches: Iterator[pa.RecordBatch], eod: int, width: int, block_tokens: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = []
        for path, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            store, place = _store(path)
            with store.open_input_file(place) as f:
                raw = f.read_at(block_tokens * width, block * block_tokens * width)
            ids = np.frombuffer(raw, KINDS[width], len(raw) // width)
            ends.append(np.flatnonzero(ids == eod) + block * block_tokens)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(ends, pa.list_(pa.int64()))],
            ["path", "block", "tokens", "ends"],
        )


def count_tokens(
    spark: SparkSession, folder: str, eod: int, width: int = 2, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """(file, doc, start, n_tokens, closed): each document's number in its file, first token and tokens before its end id.

    Tokens after a file's last end id are a document with ``closed`` false; none there, no row. Bytes short of a whole
    id at a file's end are not read. An empty file has no document. Only names and lengths of files are read to plan
    the blocks; a task holds one block of ``block_tokens`` ids. Blocks, not files, are dealt to tasks.
    """
    files = spark.read.format("binaryFile").load(folder).select(
        "path", F.floor(F.col("length") / width).alias("tokens")
    )
    last = F.floor((F.col("tokens") - 1) / block_tokens)
    blocks = files.where("tokens > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), "tokens")
    found = cut(
        blocks.repartition("path", "block").mapInArrow(
            lambda b: _scan(b, eod, width, block_tokens), "path string, block long, tokens long, ends array<long>"
        )
    )
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.select(
        "path",
        "block",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("docs_before"),
        (F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(-1)) + 1).alias("open_at"),
    )
    every = found.join(scanned, ["path", "block"])
    start = lambda i: F.when(i == 0, F.col("open_at")).otherwise(F.get("ends", i - 1) + 1)
    inner = every.select(
        "path",
        F.explode(
            F.transform(
                "ends",
                lambda e, i: F.struct(
                    (F.col("docs_before") + i).alias("doc"), start(i).alias("start"), e.alias("end"), F.lit(True).alias("closed")
                ),
            )
        ).alias("d"),
    )
    rest = every.groupBy("path").agg(
        F.sum(F.size("ends")).alias("doc"),
        F.greatest(F.coalesce(F.max(F.array_max("ends")), F.lit(-1)) + 1, F.lit(0)).alias("start"),
        F.max("tokens").alias("end"),
    )
    rest = rest.where("start < end").select(
        "path", F.struct("doc", "start", "end", F.lit(False).alias("closed")).alias("d")
    )
    name = F.element_at(F.split("path", "/"), -1)
    return inner.union(rest).select(
        name.alias("file"), "d.doc", "d.start", (F.col("d.end") - F.col("d.start")).alias("n_tokens"), "d.closed"
    )
