"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns of
``documents`` (doc_id, text, lang, source, n_chars); the last returns each document's tokens. Other columns are not
carried, whatever their names. At each stage an empty table gives an empty one, and repeated rows are rows of their own unless
the stage says otherwise; long texts are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import byte_bpe, line_dedup, mixing, near_dedup, quality_rules
from folioflow.llm.common import remove_folder, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
#: Target weights of the mix, in parts, and the parts that all other sources share.
PARTS, OTHER_PARTS = {"src0": 4, "src1": 3, "src2": 2}, 11


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; one that they reject, or whose host they reject, goes.

    A null text has no words and goes; a null source is a host of its own; a null id does not matter.
    """
    return quality_rules.keep_good(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that earlier ones have, three in a row; ``n_chars`` follows the text.

    Every document stays, also one that loses all its text. A null text becomes empty. Rows of one id are one document at one
    place; a row with a null id neither removes nor loses lines.
    """
    found = line_dedup.line_dedup(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class of near-duplicates.

    Rows of that id all stay, and so do texts without a word and rows with a null id.
    """
    return near_dedup.keep_first(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix; a null source is a source, and null ids come first in theirs."""
    return mixing.mix_sources(docs.select(*COLUMNS), PARTS, OTHER_PARTS).orderBy("slot", "doc_id").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): packed ids of each text, and the digest of what they decode to.

    A null text counts as empty and has no ids.
    """
    decoded = byte_bpe.encode(docs, RANKS, PATTERN, decoded=True)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near dedup", near_duplicates),
    ("mixing", mix),
    ("byte-level BPE", tokens),
]

#: ProbMinHash and byte-level BPE have no SQL; tests/llm/test_pipeline.py holds each stage and the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next; only the last one's files are kept."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = shared_folder(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove_folder(spark, last)
        last = path
    return docs
