"""Operators around models, which are plain functions on lists of texts: embedding, re-ranking, similarity of answers.

A function runs in Arrow batches inside tasks; its surroundings (batches, checks, fallbacks, order) are here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_answer, comparable, guard, length_deviation
from ..functions.values import salvage_json
from .alike import ratios
from .folds import pieces
from .sequences import repair_topics, share_out

Embed = Callable[[list[str]], list[list[float]]]
Judge = Callable[[list[str], list[str]], list[float]]


def embed(rows: DataFrame, text_col: str, function: Embed, dimension: int, to: str = "vector") -> DataFrame:
    """MOD01: rows with the vectors of their texts; a wrong number or dimension of vectors is an error. A null text is empty."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for piece in pieces(batch):
                found = function([t or "" for t in piece.to_pylist()])
                if len(found) != len(piece) or any(len(v) != dimension for v in found):
                    raise ValueError(f"the model does not give one vector of {dimension} numbers for each text")
                yield pa.array(found, pa.list_(pa.float32()))

    return rows.withColumn(to, vectors(F.col(text_col)))


def hashed_vectors(dimension: int) -> Embed:
    """A stand-in for a model: equal texts have equal vectors, others look random."""

    def one(text: str) -> list[float]:
        raw = hashlib.shake_128(text.encode()).digest(dimension)
        return [b / 128 - 1 for b in raw]

    return lambda texts: [one(t) for t in texts]


def judge(rows: DataFrame, question: str, text_col: str, function: Judge | None, rank_col: str = "rank") -> DataFrame:
    """MOD03, MOD04: rows with ``judged``, a second score; without a function, or where it fails, the old order counts down.

    A score that a function cannot give is NaN; if all of them are, the old order stays.
    """
    if function is None:
        return rows.withColumn("judged", -F.col(rank_col).cast("double"))

    @F.pandas_udf(T.DoubleType())
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(function([question] * len(texts), [t or "" for t in texts]), dtype=float)

    judged = rows.withColumn("judged", F.nanvl(scores(F.col(text_col)), F.lit(None).cast("double")))
    works = judged.agg(F.count("judged").alias("__n"))  # one row
    fallback = F.when(F.col("__n") == 0, -F.col(rank_col).cast("double")).otherwise(F.coalesce("judged", F.lit(0.0)))
    return judged.join(F.broadcast(works)).withColumn("judged", fallback).drop("__n")


def shared_words(questions: list[str], texts: list[str]) -> list[float]:
    """A stand-in for a re-ranker: the share of the question's words that the text has."""
    out = []
    for q, t in zip(questions, texts, strict=True):
        words = set(q.lower().split())
        out.append(len(words & set(t.lower().split())) / max(1, len(words)))
    return out


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ratios(list(zip(a.fillna(""), b.fillna(""), strict=True))), dtype=float)


def similarity(raw: Column, answer: Column) -> Column:
    """STR08: how much of two texts' letters and digits match in order, from 0 to 1.

    Equal texts are not compared; others are by the bigrams that they share, whose number grows with the square of a block's some
    thousand characters.
    """
    return _ratio(comparable(raw), comparable(answer))


Correct = Callable[[list[str]], list[str]]


def correct(blocks: DataFrame, function: Correct, least: float = 0.8, most_deviation: float = 0.35) -> DataFrame:
    """MOD05: blocks (text, start, end, ...) with a model's correction behind the guard, and its topics.

    The model answers with JSON of ``text`` and ``topics`` (title, start, end), maybe with words around it, or with plain text.
    Adds corrected, similarity, discarded, reason, paragraphs (text, start, end; the block's time shared out by characters) and topics,
    repaired so that they cover the block without a gap; a block without usable topics has none. The similarity is null where
    the lengths alone discard an answer.
    """

    @F.pandas_udf(T.StringType())
    def ask(texts: pd.Series) -> pd.Series:
        answers = function([t or "" for t in texts])
        if len(answers) != len(texts):
            raise ValueError("the model does not give one answer for each block")
        return pd.Series(answers, dtype=object)

    rows = blocks.withColumn("__a", ask(F.col("text")))
    rows = rows.withColumn("__j", salvage_json(F.coalesce("__a", F.lit(""))))
    plain = F.when(F.col("__j").isNull(), F.col("__a"))
    rows = rows.withColumn("__t", clean_answer(F.coalesce(F.get_json_object("__j", "$.text"), plain, F.lit(""))))
    long = length_deviation(F.col("text"), F.col("__t")) > most_deviation
    alike = F.when(~long, similarity(F.when(~long, F.col("text")), F.when(~long, F.col("__t"))))
    rows = rows.withColumn("__g", guard(F.col("text"), F.col("__t"), alike, least, most_deviation))
    start, end = F.col("start").cast("double"), F.col("end").cast("double")
    found = F.from_json(F.get_json_object("__j", "$.topics"), "array<struct<title:string,start:double,end:double>>")
    usable = F.filter(F.coalesce(found, F.array().cast("array<struct<title:string,start:double,end:double>>")), lambda t: t["title"].isNotNull() & t["start"].isNotNull())
    parts = F.filter(F.split(F.col("__g.text"), r"\n\s*\n"), lambda p: F.trim(p) != "")
    return rows.withColumns(
        {
            "corrected": F.col("__g.text"), "similarity": F.col("__g.similarity"), "discarded": F.col("__g.discarded"), "reason": F.col("__g.reason"),
            "paragraphs": share_out(parts, start, end), "topics": repair_topics(usable, start, end),
        }
    ).drop("__a", "__j", "__t", "__g")
