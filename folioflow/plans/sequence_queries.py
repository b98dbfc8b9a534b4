"""Sequence and interval operators over the driver tables, with their SQL where it can say them.

Lines of documents stand for segments and paragraphs, their places for times, line items for chunks of an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals as r
from ..operators import sequences as q
from ..operators.folds import fold, running_ends
from .tables import table


def docs_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, ls): the lines of each document as segments (start, end, text), twelve characters a second."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.split("text", "\n").alias("l"))
    docs = q.settled(docs, "at", fold(running_ends(6), "array<long>", F.transform("l", F.length)))
    segments = F.zip_with("l", "at", lambda x, e: F.struct(((e - F.length(x)) / 12).alias("start"), ((e - F.length(x)) / 12 + F.length(x) / 12).alias("end"), x.alias("text")))
    return q.settled(docs, "ls", segments).select("doc_id", "source", "ls")


LINES = """l AS (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS t FROM documents),
s AS (SELECT *, coalesce(sum(length(t) + 6) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 12 AS a FROM l),
seg AS (SELECT *, a + length(t) / 12 AS b FROM s)"""


SECTIONS = """l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS ordinal, unnest(string_split(text, chr(10))) AS t FROM documents),
sec AS (SELECT doc_id, ordinal, (((ordinal - 1) * 5 + length(t)) % 4)::INT AS level, CASE WHEN (ordinal - 1) % 3 = 2 THEN '' ELSE substr(t, 1, 12) END AS title,
  substr(t, 13) AS text FROM l)"""


def seq_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ01, SEQ02, SEQ04: lines without made-up ones, merged to blocks, and their paragraphs."""
    kept = q.settled(docs_lines(spark, sf_dir), "kept", q.drop_made_up(F.col("ls")))
    kept, blocks = q.settled(kept, "blocks", q.merge_segments(F.col("kept"))), F.col("blocks")
    numbers = q.paragraphs_of_segments(F.transform("kept", lambda s: s["text"]), 900)
    times = F.transform(blocks, lambda b: F.concat_ws("-", F.round(b["start"] * 12).cast("long"), F.round(b["end"] * 12).cast("long")))
    return kept.select(
        "doc_id", F.size("kept").alias("n_kept"), F.size(blocks).alias("n_blocks"), F.md5(F.array_join(times, ",")).alias("times"),
        F.md5(F.array_join(F.transform(blocks, lambda b: b["text"]), "|")).alias("blocks"),
        F.array_join(numbers.cast("array<string>"), ",").alias("paragraphs"),
    )


def seq_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ03: lines in blocks of 600 characters, no line split."""
    rows = docs_lines(spark, sf_dir)
    groups = q.pack(F.transform("ls", lambda s: F.length(s["text"])), 600, glue=1)
    return rows.select("doc_id", F.array_max(groups).alias("last"), F.array_join(groups.cast("array<string>"), ",").alias("groups"))


def snk_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK06: lines of a document, as its files, dealt to parts of 4,000 bytes in order."""
    files = q.settled(table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l")), "n", F.transform("l", F.length))
    each = files.select("doc_id", F.explode(F.arrays_zip(q.pack(F.col("n"), 4000).alias("g"), F.col("n").alias("n"))).alias("x"))
    return each.groupBy("doc_id", F.col("x.g").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("x.n").cast("long").alias("bytes"))


PACK = """
r AS (SELECT k, i, 0 AS g, n AS held FROM f WHERE i = 1
  UNION ALL SELECT f.k, f.i, r.g + (r.held + f.n + {glue} > {most})::INT, CASE WHEN r.held + f.n + {glue} > {most} THEN f.n ELSE r.held + f.n + {glue} END
  FROM r JOIN f ON f.k = r.k AND f.i = r.i + 1)"""


def seq_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ05-SEQ07: sentences of all lines, long ones broken at 300 characters."""
    rows = q.settled(docs_lines(spark, sf_dir), "s", q.sentences_of(F.col("ls"), 300))
    texts = F.array_join(F.transform("s", lambda x: x["text"]), "|")
    return rows.select("doc_id", F.size("s").alias("n"), F.md5(texts).alias("sentences"))


def seq_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ08-SEQ11: overlapping chunks of about 3000 characters with their topics."""
    rows = docs_lines(spark, sf_dir).select("doc_id", q.sentences_of(F.col("ls"), 3000).alias("s"))
    found = q.chunks(rows, "s").select("doc_id", F.explode("chunks").alias("c"))
    topics = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(F.concat(F.lit("topic "), i.cast("string")).alias("title"), (i * 100.0).alias("start"), (i * 100.0 + 80).alias("end")))
    topic = r.topic_at(topics, (F.col("c.start") + F.col("c.end")) / 2)
    return found.select(
        "doc_id", "c.ordinal", "c.chars", "c.overlap_before", "c.overlap_after", F.round("c.start", 6).alias("start"),
        F.round("c.end", 6).alias("end"), F.md5("c.text").alias("text"), topic.alias("topic"),
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, s): each document's lines as its sections (ordinal, level, title, text, position_from).

    The level follows from the line's number and length, the title is its first words; every third has no title.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    docs = q.settled(docs, "at", fold(running_ends(2), "array<long>", F.transform("l", F.length)))
    numbered = F.transform(F.arrays_zip(F.col("l").alias("x"), F.col("at").alias("e")), lambda x, i: F.struct(
        (i + 1).alias("ordinal"), ((i * 5 + F.length(x["x"])) % 4).cast("int").alias("level"),
        F.when(i % 3 == 2, "").otherwise(F.substring(x["x"], 1, 12)).alias("title"), F.substring(x["x"], F.lit(13), F.length(x["x"])).alias("text"),
        (x["e"] - F.length(x["x"])).alias("position_from")))
    return q.settled(docs, "s", numbered).select("doc_id", "s")


def section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir).select("doc_id", F.explode("s").alias("s")).select("doc_id", "s.*")


def seq_document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ12-SEQ14, RNG03: chunks chapter by chapter, numbered through the document, each with its section."""
    parted = q.chapters(section_rows(spark, sf_dir))
    placed = q.settled(parted, "ps", q.placed_paragraphs(F.col("text"), F.col("title"), F.col("position_from")))
    of_chapter = placed.groupBy("doc_id", "chapter").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "ps", "position_from"))).alias("sections")
    )
    rows = of_chapter.select(
        "doc_id", "chapter",
        q.sentences_of(F.flatten(F.transform("sections", lambda s: s["ps"])), 2000).alias("s"),
        F.transform("sections", lambda s: F.struct(
            s["ordinal"].alias("id"), s["position_from"].cast("double").alias("start"),
            F.greatest(F.try_element_at(F.transform(s["ps"], lambda p: p["end"] + 2), F.lit(-1)), s["position_from"] + 1.0).alias("end"))).alias("ranges"),
    )
    found = q.chunks(rows, "s", 2000, 300).select("doc_id", "chapter", "ranges", F.explode("chunks").alias("c"))
    middle = (F.col("c.start") + F.col("c.end")) / 2
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("chapter", "c.ordinal"))
    return found.select("doc_id", number.alias("ordinal"), "chapter", r.section_at(F.col("ranges"), middle).alias("section"), "c.chars", F.md5("c.text").alias("text"))


def seq_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ12."""
    return q.chapters(section_rows(spark, sf_dir)).select("doc_id", "ordinal", "level", "chapter")


def seq_clean_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ25: sections of a document without those of under 200 characters."""
    rows = sections(spark, sf_dir)
    kept = q.settled(rows, "kept", q.clean_sections(F.col("s"), 200))
    texts = F.transform("kept", lambda x: F.concat_ws("/", x["level"].cast("string"), x["title"], x["text"]))
    return kept.select("doc_id", F.size("s").alias("n"), F.size("kept").alias("n_kept"), F.md5(F.array_join(texts, "|")).alias("kept"))


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of their source; they are numbered without their texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    numbers = q.numbered(docs, "source", "doc_id").select("doc_id", "ordinal")
    return docs.join(numbers, "doc_id").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("work_id"), "ordinal", "text", F.least(F.lit(15), F.length("text")).alias("overlap_before"),
    )


CHUNKS = """c AS (SELECT doc_id AS chunk_id, source AS work_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal, text, least(15, length(text)) AS ov FROM documents)"""


def seq_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ16-SEQ19: every seventh document an anchor, its two neighbours on each side, runs stitched to passages."""
    rows = chunk_rows(spark, sf_dir)
    anchors = rows.where("chunk_id % 7 = 0").withColumns({"rank": F.col("chunk_id"), "score": (F.col("chunk_id") * 37 % 101) / 101})
    near = rows.join(q.neighbour_keys(anchors, 2), ["work_id", "ordinal"], "left_semi")
    found = q.stitch(anchors, near)
    return found.select("chunk_id", "work_id", "rank", F.round("score", 6).alias("score"), "first", "last", F.md5("text").alias("text"))


def seq_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ20: a window of 100 seconds shared out over lines."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    each = lines.select("doc_id", F.posexplode(q.share_out(F.col("l"), F.lit(50.0), F.lit(150.0))).alias("i", "p"))
    return each.select("doc_id", "i", F.round("p.start", 6).alias("start"), F.round("p.end", 6).alias("end"))


def seq_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ21: made-up topics of an order's items, repaired."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))).alias("t")
    )
    topics = F.transform("t", lambda x: F.struct(x["l_partkey"].cast("string").alias("title"), (x["l_quantity"] * 4 - 30).alias("start")))
    each = items.select("l_orderkey", F.posexplode(q.repair_topics(topics, F.lit(0.0), F.lit(150.0))).alias("i", "p"))
    return each.select("l_orderkey", "i", "p.title", "p.start", "p.end")


def seq_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ22, SEQ23: texts cut near their middle, and joined with their successor."""
    own = chunk_rows(spark, sf_dir)
    after = own.select("work_id", (F.col("ordinal") - 1).alias("ordinal"), F.col("text").alias("following"))
    rows = own.join(after, ["work_id", "ordinal"], "left")
    s = q.split_chunk(F.col("text"), F.expr("length(text) div 2"), F.lit(0.0), F.lit(60.0))
    return rows.select(
        "chunk_id", F.md5(s["left"]).alias("left"), F.md5(s["right"]).alias("right"), F.round(s["boundary"], 6).alias("boundary"),
        F.md5(q.join_chunks(F.col("text"), F.col("following"), F.lit(15))).alias("joined"),
    )


def seq_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ24, SEQ26, SEQ27: line items renumbered, in batches of three over two instances, with unique names."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").distinct()
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    named = q.unique_names(q.renumber(rows, "l_orderkey", order).withColumn("name", F.concat(F.lit("p"), "l_partkey")), "name", ["l_orderkey", *order])
    return q.batches(named, "l_orderkey", ["ordinal"], 3, 2).select("l_orderkey", "ordinal", "batch", "instance", "unique_name")


def topics_of(ls: Column) -> Column:
    """Every third line as a topic of 20 seconds."""
    third = F.filter(ls, lambda s, i: i % 3 == 0)
    return F.transform(third, lambda s: F.struct(s["text"].alias("title"), s["start"].alias("start"), (s["start"] + 20).alias("end")))


def rng_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNG01: the topic at each 25 seconds of a document."""
    rows = docs_lines(spark, sf_dir).withColumn("t", topics_of(F.col("ls")))
    rows = rows.withColumn("second", F.explode(F.sequence(F.lit(-10), F.lit(190), F.lit(25))))
    return rows.select("doc_id", "second", F.md5(r.topic_at(F.col("t"), F.col("second").cast("double"))).alias("topic"))


def rng_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNG01 over tables: each click with its user's last purchase before it."""
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("event_id", F.col("user_id").alias("work_id"), F.col("ts").alias("t"))
    bought = events.where("event_type = 'purchase'").select(F.col("user_id").alias("work_id"), F.col("ts").alias("start"), F.col("event_id").alias("title"))
    return r.as_of(clicks, bought).select("event_id", F.col("topic.title").alias("purchase"))


def rng_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNG02: the lines in the window from 20 to 60 seconds."""
    inside = r.in_window(F.col("ls"), F.lit(20.0), F.lit(60.0))
    return docs_lines(spark, sf_dir).select("doc_id", F.size(inside).alias("n"), F.md5(F.array_join(F.transform(inside, lambda s: s["text"]), " ")).alias("text"))


def rng_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNG03, RNG05: the line at 30 seconds, the first where none is."""
    numbered = F.transform("ls", lambda s, i: F.struct(i.alias("id"), s["start"].alias("start"), s["end"].alias("end")))
    return docs_lines(spark, sf_dir).select("doc_id", r.section_at(numbered, F.lit(30.0)).alias("section"))


def rng_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNG04: blocks of four lines held against the lines in their windows."""
    each = docs_lines(spark, sf_dir).select(F.col("doc_id").alias("work_id"), F.posexplode("ls").alias("i", "s"))
    flat = each.select("work_id", F.floor(F.col("i") / 4).alias("block"), "s.start", "s.end", "s.text")
    found = r.compare_blocks(flat, flat.select("work_id", (F.col("start") + 1).alias("start"), (F.col("end") + 1).alias("end"), "text"))
    return found.select("work_id", "block", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), F.md5("corrected").alias("corrected"), F.md5("raw").alias("raw"))


QUERIES = {
    f.__name__: f
    for f in (
        seq_segments, seq_pack, snk_parts, seq_sentences, seq_chunks, seq_document_chunks, seq_chapters, seq_clean_sections, seq_stitch, seq_share,
        seq_topics, seq_split, seq_numbers, rng_topic, rng_as_of, rng_window, rng_section, rng_blocks,
    )
}

_WHITE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+"
_CLOSERS, _OPENERS = r"""["''»«“”’)\]]""", r"""["''„»«“‘(\[]"""
_KNOWN = "[" + ", ".join(f"'{a}'" for a in q.ABBREVIATIONS) + "]"
# Over par (k, i, t, a, b): the paragraphs i of work k with their start and end. The fold puts a mark behind each piece that ends a sentence.
SENTENCES = rf"""
flat AS (SELECT k, i, a, b, trim(regexp_replace(t, '{_WHITE}', ' ', 'g')) AS t FROM par),
whole AS (SELECT k, i, a, b, unnest(s) AS t, generate_subscripts(s, 1) AS j FROM (SELECT k, i, a, b, string_split(list_reduce(
  string_split(regexp_replace(t, '([.!?…]+{_CLOSERS}*) ({_OPENERS}?[A-ZÄÖÜ0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)),
  lambda done, x: done || CASE WHEN regexp_matches(right(done, 60), '(^|[\s\x01])(\p{{L}}|\d{{1,2}})\.[.!?…]*{_CLOSERS}*$')
    OR list_contains({_KNOWN}, lower(regexp_extract(right(done, 60), '([^\s\x01]+?)\.[.!?…]*{_CLOSERS}*$', 1)) || '.')
    OR list_contains({_KNOWN}, lower(regexp_extract(right(done, 60), '([^\s\x01]+ [^\s\x01]+?)\.[.!?…]*{_CLOSERS}*$', 1)) || '.')
    THEN ' ' ELSE chr(1) END || x), chr(1)) AS s FROM flat WHERE t <> '')),
cut AS (SELECT k, i, a, b, j, CASE WHEN length(t) <= MOST THEN [t] ELSE string_split(list_reduce(string_split(t, ' '),
  lambda done, w: done || CASE WHEN length(regexp_extract(done, '[^\x02]*$')) + 1 + length(w) > MOST THEN chr(2) ELSE ' ' END || w), chr(2)) END AS s FROM whole),
sent AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i, j, m) AS n FROM (SELECT k, i, a, b, j, unnest(s) AS t, generate_subscripts(s, 1) AS m FROM cut))"""
CHUNK = """
glued AS (SELECT *, CASE WHEN n = 1 THEN '' WHEN i = lag(i) OVER (PARTITION BY k ORDER BY n) THEN ' ' ELSE chr(10) || chr(10) END AS g FROM sent),
upto AS (SELECT *, sum(length(g) + length(t)) OVER (PARTITION BY k ORDER BY n)::BIGINT AS e FROM glued),
work AS (SELECT k, list(e - length(t) ORDER BY n) AS bs, list(e ORDER BY n) AS es, list(a ORDER BY n) AS froms, list(b ORDER BY n) AS tos, string_agg(g || t, '' ORDER BY n) AS t FROM upto GROUP BY k),
run AS (SELECT k, 1 AS ordinal, 1 AS first, 1 AS new, greatest(1, len(list_filter(es, lambda x: x <= TARGET))) AS last FROM work
  UNION ALL SELECT k, ordinal + 1, carried, last + 1, greatest(last + 1, len(list_filter(es, lambda x: x - bs[carried] <= TARGET)))
  FROM (SELECT run.*, bs, es, least(last + 1, greatest(new + 1, len(list_filter(bs, lambda x: x < es[last] - OVERLAP)) + 1)) AS carried FROM run JOIN work ON work.k = run.k WHERE last < len(es))),
held AS (SELECT run.k, ordinal, es[last] - bs[first] AS chars, CASE WHEN first < new THEN es[new - 1] - bs[first] ELSE 0 END AS overlap_before,
  list_min(froms[first:last]) AS start, list_max(tos[first:last]) AS end, substr(t, bs[first] + 1, es[last] - bs[first]) AS text FROM run JOIN work ON work.k = run.k)"""

STOCK = ", ".join("'" + p.replace("'", "''") + "'" for p in q.STOCK_PHRASES)

ORACLE = {
    "seq_sentences": f"""
WITH {LINES}, par AS (SELECT doc_id AS k, i, t, a, b FROM seg), {SENTENCES.replace("MOST", "300")}
SELECT d.doc_id, count(n)::INT AS n, md5(coalesce(string_agg(t, '|' ORDER BY n), '')) AS sentences FROM documents d LEFT JOIN sent ON k = d.doc_id GROUP BY d.doc_id""",
    "seq_chunks": f"""
WITH RECURSIVE {LINES}, par AS (SELECT doc_id AS k, i, t, a, b FROM seg), {SENTENCES.replace("MOST", "3000")}, {CHUNK.replace("TARGET", "3000").replace("OVERLAP", "400")}
SELECT k AS doc_id, ordinal, chars::INT AS chars, overlap_before::INT AS overlap_before, coalesce(lead(overlap_before) OVER (PARTITION BY k ORDER BY ordinal), 0)::INT AS overlap_after,
  round(start, 6) AS start, round("end", 6) AS end, md5(text) AS text, 'topic ' || least(floor((start + "end") / 200), 9)::INT AS topic FROM held""",
    "seq_document_chunks": f"""
WITH RECURSIVE {SECTIONS},
lines AS (SELECT s.*, coalesce(sum(length(t) + 2) OVER (PARTITION BY s.doc_id ORDER BY s.ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS since,
  doc_id * 1000000 + sum((level <= 1 OR ordinal = 1)::INT) OVER (PARTITION BY s.doc_id ORDER BY s.ordinal) AS k FROM (SELECT sec.*, l.t FROM sec JOIN l ON l.doc_id = sec.doc_id AND l.ordinal = sec.ordinal) s),
named AS (SELECT k, ordinal, since, regexp_replace(title, '^{_WHITE}|{_WHITE}$', '', 'g') AS title, regexp_replace(text, '^{_WHITE}|{_WHITE}$', '', 'g') AS text FROM lines),
placed AS (SELECT *, since + length(title) AS upto, since + CASE WHEN title = '' THEN 0 ELSE length(title) + 2 END AS next FROM named),
par AS (SELECT k, ordinal * 2 AS i, title AS t, since::DOUBLE AS a, upto::DOUBLE AS b FROM placed WHERE title <> ''
  UNION ALL SELECT k, ordinal * 2 + 1, text, next, next + length(text) FROM placed WHERE text <> ''),
{SENTENCES.replace("MOST", "2000")}, {CHUNK.replace("TARGET", "2000").replace("OVERLAP", "300")},
span AS (SELECT k, ordinal AS section, since, greatest(since + 1, CASE WHEN text <> '' THEN next + length(text) + 2 WHEN title <> '' THEN upto + 2 ELSE 0 END) AS upto FROM placed),
found AS (SELECT held.k, held.ordinal, chars, text, coalesce(min(section) FILTER (span.since <= (start + "end") / 2 AND (start + "end") / 2 < span.upto), min(section)) AS section
  FROM held JOIN span ON span.k = held.k GROUP BY held.k, held.ordinal, chars, text)
SELECT (k // 1000000)::BIGINT AS doc_id, row_number() OVER (PARTITION BY k // 1000000 ORDER BY k, ordinal)::INT AS ordinal, (k % 1000000)::BIGINT AS chapter, section::INT AS section,
  chars::INT AS chars, md5(text) AS text FROM found""",
    "seq_pack": f"""
WITH RECURSIVE {LINES}, f AS (SELECT doc_id AS k, i, length(t) AS n FROM seg), {PACK.format(glue=1, most=600)}
SELECT k AS doc_id, max(g) AS last, string_agg(g::VARCHAR, ',' ORDER BY i) AS groups FROM r GROUP BY k""",
    "snk_parts": f"""
WITH RECURSIVE {LINES}, f AS (SELECT doc_id AS k, i, length(t) AS n FROM seg), {PACK.format(glue=0, most=4000)}
SELECT r.k AS doc_id, g AS part, count(*) AS n, sum(n)::BIGINT AS bytes FROM r JOIN f ON f.k = r.k AND f.i = r.i GROUP BY ALL""",
    "seq_segments": f"""
WITH RECURSIVE {LINES}, x AS (SELECT doc_id, i, a, b, trim(t) AS t, list_filter(string_split_regex(trim(t), '\\s+'), lambda w: w <> '') AS ws FROM seg),
o AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM x
  WHERE t <> '' AND NOT (len(ws) > 3 AND len(list_distinct(list_transform(ws, lambda w: lower(w)))) / len(ws) < 0.3)
    AND NOT (length(t) < 50 AND len(list_filter([{STOCK}], lambda p: contains(t, p))) > 0)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM o WHERE before IS DISTINCT FROM t),
m AS (SELECT doc_id, n, 0 AS block, a AS since, b AS upto, 0 AS par, CASE WHEN p OR length(t) + 1 >= 900 THEN 0 ELSE length(t) + 1 END AS held, p OR length(t) + 1 >= 900 AS ended
  FROM (SELECT *, regexp_matches(t, '[.!?…]["''»«“”’)\\]]*$') AS p FROM k) WHERE n = 1
  UNION ALL SELECT doc_id, n, CASE WHEN closed THEN block + 1 ELSE block END, CASE WHEN closed THEN a ELSE since END, b, par + ended::INT,
    CASE WHEN p OR held + len1 >= 900 THEN 0 ELSE held + len1 END, p OR held + len1 >= 900
  FROM (SELECT m.doc_id, k.n, m.block, m.since, k.a, k.b, m.par, m.held, m.ended, length(k.t) + 1 AS len1, regexp_matches(k.t, '[.!?…]["''»«“”’)\\]]*$') AS p,
    m.upto - m.since >= 15 OR (m.upto - m.since >= 6 AND k.a - m.upto >= 0.3) AS closed FROM m JOIN k ON k.doc_id = m.doc_id AND k.n = m.n + 1)),
g AS (SELECT m.doc_id, block, string_agg(t, ' ' ORDER BY k.n) AS t, round(min(k.a) * 12)::BIGINT || '-' || round(max(k.b) * 12)::BIGINT AS times FROM m JOIN k ON k.doc_id = m.doc_id AND k.n = m.n GROUP BY ALL),
p AS (SELECT doc_id, count(*)::INT AS n_kept, string_agg(par::VARCHAR, ',' ORDER BY n) AS paragraphs FROM m GROUP BY doc_id),
b AS (SELECT doc_id, count(*)::INT AS n_blocks, md5(string_agg(t, '|' ORDER BY block)) AS blocks, md5(string_agg(times, ',' ORDER BY block)) AS times FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_kept, 0) AS n_kept, coalesce(n_blocks, 0) AS n_blocks, coalesce(times, md5('')) AS times, coalesce(blocks, md5('')) AS blocks, coalesce(paragraphs, '') AS paragraphs
FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id""",
    "seq_chapters": f"""
WITH {SECTIONS} SELECT doc_id, ordinal, level, sum((level <= 1 OR ordinal = 1)::INT) OVER (PARTITION BY doc_id ORDER BY ordinal)::BIGINT AS chapter FROM sec""",
    "seq_clean_sections": f"""
WITH RECURSIVE {SECTIONS}, c AS (SELECT * FROM sec),
w AS (SELECT doc_id, 0 AS round, ordinal, level, title <> '' AS titled, length(text) >= 200 AS long, true AS alive FROM c
  UNION ALL SELECT doc_id, round + 1, ordinal, level, titled, long, keep FROM (
    SELECT *, count_if(alive) OVER (PARTITION BY doc_id) > count_if(keep) OVER (PARTITION BY doc_id) AS changed FROM (
      SELECT *, alive AND (long OR (titled AND coalesce(lead(level) OVER (PARTITION BY doc_id, alive ORDER BY ordinal) > level, false))) AS keep FROM w))
  WHERE changed),
z AS (SELECT w.* FROM w JOIN (SELECT doc_id, max(round) AS round FROM w GROUP BY doc_id) l ON l.doc_id = w.doc_id AND l.round = w.round)
SELECT z.doc_id, count(*)::INT AS n, count_if(alive)::INT AS n_kept,
  md5(coalesce(string_agg(c.level || '/' || title || '/' || text, '|' ORDER BY c.ordinal) FILTER (alive), '')) AS kept
FROM z JOIN c ON c.doc_id = z.doc_id AND c.ordinal = z.ordinal GROUP BY z.doc_id""",
    "seq_stitch": f"""
WITH {CHUNKS}, a AS (SELECT *, (chunk_id * 37 % 101) / 101 AS score FROM c WHERE chunk_id % 7 = 0),
u AS (SELECT DISTINCT c.* FROM c JOIN a ON a.work_id = c.work_id AND c.ordinal BETWEEN a.ordinal - 2 AND a.ordinal + 2),
i AS (SELECT *, ordinal - row_number() OVER (PARTITION BY work_id ORDER BY ordinal) AS island,
  CASE WHEN chunk_id % 7 = 0 THEN (chunk_id * 37 % 101) / 101 END AS score FROM u),
p AS (SELECT *, row_number() OVER (PARTITION BY work_id, island ORDER BY ordinal) AS k, trim(CASE WHEN row_number() OVER (PARTITION BY work_id, island ORDER BY ordinal) = 1 THEN text ELSE substr(text, ov + 1) END, ' ' || chr(10)) AS t FROM i)
SELECT arg_min(chunk_id, (-score, ordinal)) FILTER (score IS NOT NULL) AS chunk_id, work_id, arg_min(chunk_id, (-score, ordinal)) FILTER (score IS NOT NULL) AS rank,
  round(max(score), 6) AS score, min(ordinal) AS first, max(ordinal) AS last, md5(coalesce(string_agg(t, ' ' ORDER BY ordinal) FILTER (t <> ''), '')) AS text
FROM p GROUP BY work_id, island""",
    "seq_share": """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS t FROM documents),
c AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS upto, greatest(sum(length(t)) OVER (PARTITION BY doc_id), 1) AS total,
  max(i) OVER (PARTITION BY doc_id) AS n FROM l)
SELECT doc_id, i - 1 AS i, round(CASE WHEN i = 1 THEN 50 ELSE 50 + 100 * ((upto - length(t)) / total) END, 6) AS start,
  round(CASE WHEN i = n THEN 150 ELSE 50 + 100 * (upto / total) END, 6) AS end FROM c""",
    "seq_topics": """
WITH o AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k,
  l_partkey::VARCHAR AS title, least(greatest(l_quantity * 4 - 30, 0), 150) AS a FROM lineitem),
s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY a, k) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM o)
SELECT l_orderkey, i - 1 AS i, title, CASE WHEN i = 1 THEN 0 ELSE a END AS start,
  CASE WHEN i = n THEN 150 ELSE greatest(a, lead(a) OVER (PARTITION BY l_orderkey ORDER BY i)) END AS end FROM s""",
    "seq_split": f"""
WITH {CHUNKS}, n AS (SELECT *, lead(text) OVER (PARTITION BY work_id ORDER BY ordinal) AS f, length(text) // 2 AS pos FROM c),
k AS (SELECT *, length(regexp_extract(substr(text, pos + 1), '^[^ \\n]*')) AS ahead FROM n),
s AS (SELECT *, CASE WHEN pos <= 0 THEN 0 ELSE least(pos + ahead, length(text)) END AS cut FROM k),
p AS (SELECT *, trim(substr(text, 1, cut), ' ' || chr(10)) AS l, trim(substr(text, cut + 1), ' ' || chr(10)) AS r FROM s)
SELECT chunk_id, CASE WHEN l <> '' AND r <> '' THEN md5(l) END AS left, CASE WHEN l <> '' AND r <> '' THEN md5(r) END AS right,
  CASE WHEN l <> '' AND r <> '' THEN round(60.0 * length(l) / greatest(length(text), 1), 6) END AS boundary,
  md5(trim(rtrim(text, ' ') || ' ' || CASE WHEN length(f) > 15 THEN ltrim(substr(f, 16), ' ') ELSE f END, ' ' || chr(10))) AS joined FROM p""",
    "seq_numbers": """
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM d)
SELECT l_orderkey, ordinal, (ordinal - 1) // 3 AS batch, (ordinal - 1) // 3 % 2 AS instance, 'p' || l_partkey || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS unique_name FROM n""",
    "rng_topic": f"""
WITH {LINES}, t AS (SELECT * FROM seg WHERE (i - 1) % 3 = 0), x AS (SELECT doc_id, unnest(range(-10, 191, 25)) AS second FROM documents),
j AS (SELECT x.doc_id, second, t.t, a, i, second <= a + 20 AS inside FROM x LEFT JOIN t ON t.doc_id = x.doc_id AND a <= second)
SELECT doc_id, second, md5(coalesce(arg_min(t, i) FILTER (inside), arg_max(t, (a, -i)), '')) AS topic FROM j GROUP BY doc_id, second""",
    "rng_as_of": """
SELECT c.event_id, p.event_id AS purchase FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON p.user_id = c.user_id AND p.ts <= c.ts""",
    "rng_window": f"""
WITH {LINES} SELECT doc_id, count(*) FILTER (m)::INT AS n, md5(coalesce(string_agg(t, ' ' ORDER BY i) FILTER (m), '')) AS text
FROM (SELECT *, (a + b) / 2 BETWEEN 19.95 AND 60.05 AS m FROM seg) GROUP BY doc_id""",
    "rng_section": f"""WITH {LINES} SELECT doc_id, coalesce(min(i) FILTER (a <= 30 AND 30 < b), 1)::INT - 1 AS section FROM seg GROUP BY doc_id""",
    "rng_blocks": f"""
WITH {LINES}, b AS (SELECT doc_id AS work_id, (i - 1) // 4 AS block, min(a) AS a, max(b) AS b, string_agg(t, chr(10) || chr(10) ORDER BY i) AS c FROM seg GROUP BY ALL)
SELECT work_id, block, round(b.a, 6) AS start, round(b.b, 6) AS end, md5(c) AS corrected, md5(coalesce(string_agg(t, ' ' ORDER BY i), '')) AS raw
FROM b LEFT JOIN seg ON seg.doc_id = work_id AND (seg.a + seg.b) / 2 + 1 BETWEEN b.a - 0.05 AND b.b + 0.05 GROUP BY ALL""",
}
