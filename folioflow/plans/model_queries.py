"""Model-backed operators with stand-ins for models, and search with neighbours, over the driver tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import models as m
from ..operators import search as s
from ..operators import sequences as q
from .search_queries import question, vectors
from .tables import table


def mod_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD01, MOD02, MTH01: documents embedded by the stand-in, and their similarity to one question's vector."""
    rows = m.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", m.hashed_vectors(16), 16)
    target = m.hashed_vectors(16)(["what is it"])[0]
    score = s.cosine(F.col("vector"), F.array(*map(F.lit, target)))
    return rows.select("doc_id", F.round(score, 6).alias("score"))


def mod_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD03, TOP03: the documents nearest to a question, re-ranked by a stand-in judge."""
    found = s.candidates(vectors(spark, sf_dir), question(spark, sf_dir), hits=8)
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))  # 32 rows
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    judged = m.judge(ranked.join(docs, "chunk_id", "left"), "the and of", "text", m.shared_words)
    return judged.orderBy(F.desc("judged"), "rank").limit(8).select("chunk_id", F.round("judged", 6).alias("judged"), "rank")


def mod_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD05, STR08, STR12: every document's blocks of sentences and made-up corrections of them through the guard."""
    paragraph = lambda x: F.struct(x.alias("text"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"))
    each = q.sentences_of(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), paragraph), 400)
    cut = q.settled(table(spark, sf_dir, "documents").select("doc_id", "text"), "s", F.transform(each, lambda x: x["text"]))
    cut = q.settled(cut, "g", q.pack(F.transform("s", F.length), 400, glue=1))
    parts = cut.select("doc_id", F.posexplode_outer(F.arrays_zip("s", "g")).alias("i", "x"))
    docs = parts.groupBy("doc_id", F.coalesce("x.g", F.lit(0)).alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "x.s"))), lambda x: x["s"]), " ").alias("raw")
    )
    answer = F.when(F.col("doc_id") % 3 == 0, F.upper("raw")).when(F.col("doc_id") % 3 == 1, F.reverse("raw")).otherwise(F.concat(F.lit("Hier ist der Text:\n"), "raw"))
    rows = docs.withColumn("answer", t.clean_answer(answer))
    rows = rows.withColumn("alike", m.similarity(F.col("raw"), F.col("answer")))
    rows = q.settled(rows, "g", t.guard(F.col("raw"), F.col("answer"), F.col("alike")))
    return rows.select("doc_id", "block", F.round("alike", 6).alias("alike"), "g.discarded", "g.reason")


def search_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search from candidates to passages: floor, cap, neighbours, stitching; a source's documents are its chunks."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("work_id"), "text", F.lit(0).alias("overlap_before"))
    numbers = q.numbered(docs, "work_id", "chunk_id")
    hits = s.search(vectors(spark, sf_dir), question(spark, sf_dir), least=0.05).select("chunk_id", "score")
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))  # 8 rows
    placed = numbers.join(ranked, "chunk_id")
    beside = numbers.join(q.neighbour_keys(placed, 1), ["work_id", "ordinal"], "left_semi").select("chunk_id", "ordinal")
    anchors, near = docs.join(placed.select("chunk_id", "ordinal", "score", "rank"), "chunk_id"), docs.join(beside, "chunk_id")
    return q.stitch(anchors, near).select("chunk_id", "work_id", "rank", "first", "last", F.md5("text").alias("text"))


def answers(texts: list[str]) -> list[str]:
    """A stand-in for a correcting model: JSON of the text and two topics, with words around it for some texts, or no answer."""
    out = []
    for text in texts:
        topics = [{"title": "later", "start": 60.0, "end": 70.0}, {"title": "first", "start": -5.0, "end": 10.0}, {"title": " ", "start": 1.0, "end": 2.0}]
        whole = json.dumps({"text": text, "topics": topics}, ensure_ascii=False)
        out.append((whole, f"Sure:\n```json\n{whole}\n```", text[: len(text) // 2], "")[len(text) % 4])
    return out


def mod_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD05: documents' first lines as blocks of a hundred seconds, corrected, guarded and with topics."""
    line = F.regexp_replace(F.regexp_replace(F.split("text", "\n")[0], r"[^\p{L}., ]+", ""), " +", " ")
    blocks = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Zum Text "), F.trim(line)).alias("text"), F.lit(0.0).alias("start"), F.lit(100.0).alias("end"))
    found = m.correct(blocks, answers)
    shown = F.transform("topics", lambda t: F.concat_ws("/", t["title"], t["start"].cast("int").cast("string"), t["end"].cast("int").cast("string")))
    return found.select("doc_id", F.md5("corrected").alias("corrected"), "discarded", "reason", F.array_join(shown, ",").alias("topics"), F.size("paragraphs").alias("n"), F.get("paragraphs", F.lit(0))["end"].alias("end"))


QUERIES = {f.__name__: f for f in (mod_embed, mod_rerank, mod_guard, mod_correct, search_context)}

ORACLE = {
    "mod_correct": r"""
WITH b AS (SELECT doc_id, 'Zum Text ' || trim(regexp_replace(regexp_replace(string_split(text, chr(10))[1], '[^\p{L}., ]+', '', 'g'), ' +', ' ', 'g'), ' ') AS t FROM documents),
k AS (SELECT doc_id, trim(t, ' ') AS t, length(t) % 4 AS k FROM b)
SELECT doc_id, md5(t) AS corrected, k > 1 AS discarded, CASE k WHEN 2 THEN 'length' WHEN 3 THEN 'empty' ELSE '' END AS reason,
  CASE WHEN k < 2 THEN 'first/0/60,later/60/100' ELSE '' END AS topics, 1 AS n, 100.0::DOUBLE AS end FROM k""",
    "mod_rerank": """
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
c AS (SELECT vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v::DOUBLE[]), 6) AS score FROM embeddings e, q ORDER BY score DESC, vec_id LIMIT 32),
r AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM c),
j AS (SELECT vec_id, rank, len(list_intersect(['the', 'and', 'of'], list_distinct(string_split_regex(lower(coalesce(text, '')), '\\s+')))) / 3 AS judged FROM r LEFT JOIN documents ON doc_id = vec_id)
SELECT vec_id AS chunk_id, round(judged, 6) AS judged, rank FROM j ORDER BY judged DESC, rank LIMIT 8""",
    "search_context": """
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
c AS (SELECT vec_id, label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v::DOUBLE[]), 6) AS score FROM embeddings e, q ORDER BY score DESC, vec_id LIMIT 32),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM c WHERE score >= 0.05),
h AS (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM r WHERE rn <= 3 ORDER BY score DESC, vec_id LIMIT 8),
d AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS o FROM documents),
a AS (SELECT d.*, rank, score FROM d JOIN h ON vec_id = doc_id),
u AS (SELECT DISTINCT d.* FROM d JOIN a ON a.source = d.source AND d.o BETWEEN a.o - 1 AND a.o + 1),
i AS (SELECT u.*, u.o - row_number() OVER (PARTITION BY u.source ORDER BY u.o) AS island, a.rank, a.score FROM u LEFT JOIN a ON a.doc_id = u.doc_id)
SELECT arg_min(doc_id, rank) AS chunk_id, source AS work_id, min(rank) AS rank, min(o) AS first, max(o) AS last,
  md5(string_agg(trim(text, ' ' || chr(10)), ' ' ORDER BY o) FILTER (trim(text, ' ' || chr(10)) <> '')) AS text FROM i GROUP BY source, island""",
}
