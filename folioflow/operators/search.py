"""Semantic search over stored vectors: exact cosine top-k, floor, cap per work, re-ranking.

The order of the steps carries meaning: candidates are limited first, and the floor and the cap then work on
these candidates only, so fewer hits than asked for are a legitimate answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is null or zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.nullif(norms, F.lit(0.0))


def candidates(
    vectors: DataFrame, question: list[float], hits: int = 8, factor: int = 4,
    id_col: str = "chunk_id", vector_col: str = "vector",
) -> DataFrame:
    """The ``max(1, hits * factor)`` rows nearest to the question, with ``score`` to 6 decimals.

    The question is a literal, so scoring needs no join, and each task keeps only its own best rows before the
    final merge. Rows without a score come last; ties go to the smaller id.
    """
    target = F.array(*[F.lit(float(x)) for x in question])
    scored = vectors.withColumn("score", F.round(cosine(F.col(vector_col), target), 6))
    return scored.orderBy(F.desc_nulls_last("score"), F.asc(id_col)).limit(max(1, hits * factor))


def floor(found: DataFrame, least: float) -> DataFrame:
    """Candidates of at least this similarity."""
    return found.where(F.col("score") >= F.lit(least))


def cap_per_work(found: DataFrame, most: int, work_col: str = "work_id", id_col: str = "chunk_id") -> DataFrame:
    """At most this many hits of one work, best first; 0 is no cap."""
    if most <= 0:
        return found
    order = Window.partitionBy(work_col).orderBy(F.desc_nulls_last("score"), F.asc(id_col))
    return found.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def rerank(found: DataFrame, hits: int, judged: Column | None = None, id_col: str = "chunk_id") -> DataFrame:
    """The first ``hits`` rows by a second score, equal ones in their old order; None keeps the old order."""
    old = [F.desc_nulls_last("score"), F.asc(id_col)]
    return found.orderBy(*([F.desc_nulls_last(judged)] if judged is not None else []), *old).limit(hits)


def search(
    vectors: DataFrame, question: list[float], hits: int = 8, factor: int = 4, least: float = 0.45,
    per_work: int = 3, judged: Column | None = None,
) -> DataFrame:
    """Limit, floor, cap, re-rank and cut, in this order, over (chunk_id, work_id, vector, ...)."""
    found = cap_per_work(floor(candidates(vectors, question, hits, factor), least), per_work)
    return rerank(found, hits, judged)
