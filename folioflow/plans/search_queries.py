"""Search queries over the embeddings table (chunk = vec_id, work = label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as s

LEAST = 0.05


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("work_id"), F.col("embedding").alias("vector"))


def question(spark: SparkSession, sf_dir: str) -> list[float]:
    """The question's vector: that of row 0."""
    return list(vectors(spark, sf_dir).where("chunk_id = 0").select("vector").first()[0])


def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = s.search(vectors(spark, sf_dir), question(spark, sf_dir), least=LEAST)
    return found.select(F.col("chunk_id").alias("vec_id"), F.col("work_id").alias("label"), "score")


QUERIES = {"search_ranked": search_ranked}

ORACLE = {
    "search_ranked": """
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
c AS (SELECT vec_id, label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v::DOUBLE[]), 6) AS score
      FROM embeddings e, q ORDER BY score DESC, vec_id LIMIT 32),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM c WHERE score >= 0.05)
SELECT vec_id, label, score FROM r WHERE rn <= 3 ORDER BY score DESC, vec_id LIMIT 8
"""
}
