"""Queries of the string functions over whole columns of the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import sequences as q
from .tables import table


def str_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR01-04 over texts with typographic and foreign characters put in."""
    docs = table(spark, sf_dir, "documents")
    mixed = F.concat(F.lit("„"), F.replace(F.col("text"), F.lit(" a"), F.lit(" — 认为a")), F.lit("“ …  x"))
    return docs.select(
        "doc_id",
        F.md5(t.straighten(mixed)).alias("straight"),
        F.md5(t.clean(mixed)).alias("clean"),
        F.md5(t.smooth_space(F.replace(F.col("text"), F.lit("\n"), F.lit("  \n\n\n ")))).alias("smooth"),
    )


def str_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR07 and STR09."""
    docs = table(spark, sf_dir, "documents")
    half = F.expr("substr(text, 1, length(text) div 2)")
    return docs.select(
        "doc_id",
        F.md5(t.comparable(F.col("text"))).alias("comparable"),
        F.round(t.length_deviation(F.col("text"), half), 6).alias("deviation"),
    )


def str_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR05 over the lines of texts."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(t.join_paragraphs(F.split("text", "\n"))).alias("joined"))


def str_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR13, STR14 and STR24 over made-up titles of parts."""
    title = F.concat("p_name", F.lit(" | "), F.regexp_replace("p_brand", "[^A-Za-z]", ""), F.lit("#"), "p_partkey")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(title).alias("title")
    )
    s = t.series_of(F.col("title"))
    return rows.select(
        "p_partkey",
        s["series"].alias("series"),
        s["episode"].alias("episode"),
        t.episode_label(s["series"], s["episode"]).alias("label"),
        t.safe_name(F.col("title")).alias("file_name"),
    )


def str_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR15-STR17 and STR27 over durations and sizes."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") * 60).alias("s"), "user_id")
    return rows.select(
        "event_id",
        t.time_mark(F.col("s")).alias("mark"),
        t.time_mark(F.col("s"), rounded=False).alias("shown"),
        t.duration_words(F.col("s")).alias("words"),
        t.bytes_text(F.col("event_id") * 1237).alias("size"),
        t.page_url(F.lit("https://example.org/v/{id}"), F.col("user_id").cast("string"), F.floor("s")).alias("url"),
    )


def str_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR18-STR20 over documents of each source, numbered by id."""
    docs = table(spark, sf_dir, "documents")
    numbers = q.numbered(docs, "source", "doc_id", to="n").select("doc_id", "n")
    numbered = docs.join(numbers, "doc_id")
    kind = F.when(F.col("n") % 3 == 0, "document").when(F.col("n") % 3 == 1, "tool").otherwise("video")
    short = t.shorten(F.col("text"), 40)
    head = t.citation_head(
        F.col("n"), kind, F.col("source"), F.col("lang"), F.col("n") % 2, F.col("lang"), F.col("n"), F.col("n") + 3700
    )
    return numbered.select(
        "doc_id",
        short.alias("short"),
        head.alias("head"),
        F.md5(t.context_head(F.lit("Document"), F.col("source"), F.when(F.col("n") > 2, F.col("lang")).otherwise(""), short)).alias("context"),
    )


def str_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR21: citations as links, and how often each document is cited."""
    docs = table(spark, sf_dir, "documents")
    answer = F.concat(F.lit("See ["), F.col("doc_id") % 1200, F.lit("] and ["), F.col("doc_id") % 7, F.lit("]."))
    cited = F.regexp_extract_all(answer, F.lit(r"\[(\d{1,3})\]"), F.lit(1))
    return docs.select("doc_id", t.link_citations(answer).alias("linked"), F.size(cited).alias("n_cited"))


def str_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR22, STR23 and STR26 over made-up names."""
    rows = table(spark, sf_dir, "customer")
    model = F.concat(
        F.element_at(F.array(*map(F.lit, ("BAAI/", "text-embedding-", "", "org/sub/"))), (F.col("c_custkey") % 4 + 1).cast("int")),
        F.element_at(F.array(*map(F.lit, ("bge-m3", "BGE-M3-GGUF", "multilingual-e5-large", "own"))), (F.col("c_custkey") % 5 % 4 + 1).cast("int")),
        F.element_at(F.array(*map(F.lit, ("", "-q8_0", "@latest"))), (F.col("c_custkey") % 3 + 1).cast("int")),
    )
    language = F.element_at(
        F.array(*map(F.lit, ("Deutsch", " EN ", "fr-FR", "klingon", "english"))), (F.col("c_custkey") % 5 + 1).cast("int")
    )
    return rows.select(
        "c_custkey",
        t.model_family(model).alias("family"),
        t.function_name(F.concat(F.lit("Größe: "), F.col("c_mktsegment"), F.lit(" "), F.col("c_name"))).alias("function"),
        t.language_code(language).alias("code"),
    )


def str_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR25 over parts."""
    rows = table(spark, sf_dir, "part")
    names, values = ["q", "size"], [F.col("p_name"), F.col("p_size").cast("string")]
    return rows.select(
        "p_partkey",
        t.fill(F.lit("https://example.org/?q={q}&s={size}"), names, values).alias("url"),
        t.fill(F.lit('{"q": "{q}", "n": {size}}'), names, [F.concat(F.col("p_name"), F.lit('"')), values[1]], url=False).alias("json"),
    )


def str_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR28 over documents, as if they overlapped by 20 and 30 characters."""
    docs = table(spark, sf_dir, "documents")
    p = t.overlap_parts(F.col("text"), F.lit(20), F.least(F.lit(30), F.greatest(F.length("text") - 20, F.lit(0))))
    return docs.select("doc_id", p["head"].alias("head"), F.md5(p["core"]).alias("core"), p["tail"].alias("tail"))


def str_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR10-STR12 over documents and made-up answers to them; the similarity is that of lengths."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw"))
    k = F.col("doc_id") % 6
    answer = (
        F.when(k == 0, F.concat(F.lit("<think>hm</think>Hier ist der korrigierte Text:\n"), F.col("raw")))
        .when(k == 1, F.lit(""))
        .when(k == 2, F.lit("Gerne!"))
        .when(k == 3, F.concat(F.lit("```text\n"), F.col("raw"), F.lit("\n```")))
        .when(k == 4, F.expr("substr(raw, 1, length(raw) div 2)"))
        .otherwise(F.col("raw"))
    )
    cleaned = docs.select("doc_id", "raw", t.clean_answer(answer).alias("answer"))
    alike = F.least(F.length("answer"), F.length("raw")) / F.greatest(F.length("answer"), F.length("raw"), F.lit(1))
    g = t.guard(F.col("raw"), F.col("answer"), alike)
    return cleaned.select("doc_id", g["discarded"].alias("discarded"), g["reason"].alias("reason"), F.md5(g["text"]).alias("text"))


def str_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR06: lines of documents with Markdown put around them, by their numbers, and taken off again."""
    bare = F.transform(F.split("text", "\n"), lambda s: F.regexp_replace(F.translate(s, "*_`|#[]()<>+-~!", ""), "^[ 0-9.]+", "x"))

    def marked(s: Column, i: Column) -> Column:
        head, rest = F.substring_index(s, " ", 1), F.substring(s, F.instr(s, " "), F.length(s))
        around = lambda a, b: F.concat(F.lit(a), head, F.lit(b), F.when(F.instr(s, " ") > 0, rest).otherwise(""))
        kinds = (around("![", "](a.png)"), around("[", "](http://x/y_z)"), around("`", "`"), around("**", "**"), around("*", "*"), around("__", "__"), around("> ", ""), around("* ", ""), around("12. ", ""), around("**_", "_**"))
        return F.concat(F.element_at(F.array(*kinds), i % len(kinds) + 1), F.when((i % 4 == 3) & ~(i % 10).isin(6, 7), F.lit("\n|---|:--:|")).otherwise(""))

    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(bare, marked), "\n").alias("text"))
    return docs.select("doc_id", F.md5(t.plain_markdown(F.col("text"))).alias("plain"))


QUERIES = {
    f.__name__: f
    for f in (
        str_clean, str_compare, str_paragraphs, str_titles, str_marks, str_heads, str_links, str_names, str_fill, str_overlap,
        str_guard, str_markdown,
    )
}

_MARK = "CASE WHEN x >= 3600 THEN (x // 3600)::VARCHAR || ':' || lpad((x % 3600 // 60)::VARCHAR, 2, '0') ELSE (x // 60)::VARCHAR END || ':' || lpad((x % 60)::VARCHAR, 2, '0')"
_WHITE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]"
_STRIP = f"regexp_replace(regexp_replace(X, '^{_WHITE}+', ''), '{_WHITE}+$', '')"


def _mark(x: str) -> str:
    return "(" + _MARK.replace("x", f"({x})") + ")"


def _strip(x: str) -> str:
    return _STRIP.replace("X", x)



def _remark(x: str) -> str:
    """Whether a line is a remark, for a line that is no longer than a remark's text."""
    starts = ", ".join(f"'{w}'" for w in t.REMARK_STARTS)
    words = ", ".join(f"'{w}'" for w in t.REMARK_WORDS)
    z = f"lower({_strip(x)})"
    return f"""(length({z}) BETWEEN 1 AND {t.REMARK_LENGTH} AND len(list_filter([{starts}], lambda w: starts_with({z}, w))) > 0
      AND (ends_with({z}, ':') OR len(string_split_regex({z}, '{_WHITE}+')) <= 3 OR len(list_filter([{words}], lambda w: contains({z}, w))) > 0))"""


def _ahead(lines: str) -> str:
    return f"coalesce(nullif(list_position(list_transform({lines}[1:{t.REMARK_LINES}], lambda l: {_remark('l')}), false), 0) - 1, least(len({lines}), {t.REMARK_LINES}))"


ORACLE = {
    "str_markdown": r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, regexp_replace(translate(unnest(string_split(text, chr(10))), '*_`|#[]()<>+-~!', ''), '^[ 0-9.]+', 'x') AS t FROM documents)
SELECT doc_id, md5(string_agg(CASE WHEN i % 10 IN (7, 8) THEN '- ' ELSE '' END || t || CASE WHEN i % 4 = 3 AND i % 10 NOT IN (6, 7) THEN chr(10) ELSE '' END, chr(10) ORDER BY i)) AS plain FROM l GROUP BY 1""",
    "str_guard": rf"""
WITH a AS (SELECT doc_id, text AS raw, CASE doc_id % 6 WHEN 0 THEN '<think>hm</think>Hier ist der korrigierte Text:' || chr(10) || text WHEN 1 THEN '' WHEN 2 THEN 'Gerne!'
  WHEN 3 THEN '```text' || chr(10) || text || chr(10) || '```' WHEN 4 THEN substr(text, 1, length(text) // 2) ELSE text END AS x FROM documents),
b AS (SELECT doc_id, raw, {_strip(r"replace(regexp_replace(x, '(?is)<think>.*?</think>', '', 'g'), chr(13) || chr(10), chr(10))")} AS x FROM a),
c AS (SELECT doc_id, raw, {_strip(r"regexp_replace(regexp_replace(x, '\A```[a-zA-Z]*[ \t]*\n', ''), '\n```[ \t]*\z', '')")} AS x FROM b),
e AS (SELECT doc_id, raw, list_transform(string_split(x, chr(10)), lambda l: {_strip(r"regexp_replace(l, '[ \t]+', ' ', 'g')")}) AS ls FROM c),
f AS (SELECT doc_id, raw, string_split({_strip(r"regexp_replace(array_to_string(ls, chr(10)), '\n{3,}', chr(10) || chr(10), 'g')")}, chr(10)) AS ls FROM e),
g AS (SELECT doc_id, raw, ls[{_ahead("ls")} + 1:] AS ls FROM f),
h AS (SELECT doc_id, raw, list_reverse(ls) AS ls FROM g),
i AS (SELECT doc_id, raw, array_to_string(list_reverse(ls[{_ahead("ls")} + 1:]), chr(10)) AS x FROM h),
k AS (SELECT doc_id, {_strip(r"raw")} AS raw, length(raw) AS n, {_strip(r"x")} AS x FROM i),
r AS (SELECT *, CASE WHEN x = '' THEN 'empty' WHEN {_remark("string_split(x, chr(10))[1]")} THEN 'remark'
  WHEN CASE WHEN raw = '' THEN x <> '' ELSE abs(length(x) - length(raw)) / length(raw) > 0.35 END THEN 'length'
  WHEN least(length(x), n) / greatest(length(x), n, 1) < 0.8 THEN 'similarity' ELSE '' END AS reason FROM k)
SELECT doc_id, reason <> '' AS discarded, reason, md5(CASE WHEN reason = '' THEN x ELSE raw END) AS text FROM r""",
    "str_clean": rf"""
WITH m AS (SELECT doc_id, text, '„' || replace(text, ' a', ' — 认为a') || '“ … ' || chr(160) || 'x' AS m FROM documents),
s AS (SELECT doc_id, text, replace(translate(m, '—–‒‑‐“”„‟«»‹›‘’‚' || chr(160), '-----' || repeat('"', 6) || repeat(chr(39), 5) || ' '), '…', '...') AS s FROM m)
SELECT doc_id, md5(s) AS straight,
  md5(CASE WHEN regexp_matches(s, '[\x{{3000}}-\x{{9fff}}]')
      THEN regexp_replace(regexp_replace(s, '[\x{{3000}}-\x{{9fff}}]+', '', 'g'), '[ \t]{{2,}}', ' ', 'g') ELSE s END) AS clean,
  md5({_strip(r"regexp_replace(array_to_string(list_transform(string_split(replace(text, chr(10), '  ' || chr(10) || chr(10) || chr(10) || ' '), chr(10)), lambda l: " + _strip(r"regexp_replace(l, '[ \t]+', ' ', 'g')") + r"), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')".replace("{{", "{").replace("}}", "}"))}) AS smooth
FROM s
""",
    "str_compare": r"""
SELECT doc_id, md5(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')) AS comparable,
  round(CASE WHEN length(trim(text, chr(32) || chr(10))) = 0 THEN CASE WHEN length(trim(h, chr(32) || chr(10))) = 0 THEN 0.0 ELSE 1.0 END
    ELSE abs(length(trim(h, chr(32) || chr(10))) - length(trim(text, chr(32) || chr(10))))::DOUBLE / length(trim(text, chr(32) || chr(10))) END, 6) AS deviation
FROM (SELECT *, substr(text, 1, length(text) // 2) AS h FROM documents)
""",
    "str_paragraphs": f"""
SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda p: {_strip("p")}), lambda p: p <> ''), chr(10) || chr(10))) AS joined
FROM documents
""",
    "str_titles": r"""
WITH d AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name
  ELSE p_name || ' | ' || regexp_replace(p_brand, '[^A-Za-z]', '', 'g') || '#' || p_partkey END AS title FROM part),
s AS (SELECT *, regexp_extract(title, '\|\s*([A-Za-z]+)#(\d+)\s*$', 1) AS series,
  TRY_CAST(nullif(regexp_extract(title, '\|\s*([A-Za-z]+)#(\d+)\s*$', 2), '') AS INT) AS episode FROM d)
SELECT p_partkey, series, episode, CASE WHEN series <> '' AND episode IS NOT NULL THEN series || '#' || episode ELSE series END AS label,
  substr(trim(regexp_replace(title, '[^\p{L}\p{N}_ -]', '', 'g')), 1, 80) AS file_name
FROM s
""",
    "str_marks": f"""
WITH e AS (SELECT event_id, user_id, value * 60 AS s, event_id * 1237 AS b FROM events),
r AS (SELECT *, round_even(s, 0)::BIGINT AS x, floor(s)::BIGINT AS f FROM e)
SELECT event_id, {_mark("x")} AS mark, {_mark("f")} AS shown,
  CASE WHEN x < 60 THEN x || CASE WHEN x = 1 THEN ' second' ELSE ' seconds' END
       WHEN x < 3600 THEN x // 60 || CASE WHEN x // 60 = 1 THEN ' minute' ELSE ' minutes' END
       WHEN x < 86400 THEN x // 3600 || CASE WHEN x // 3600 = 1 THEN ' hour' ELSE ' hours' END
       ELSE x // 86400 || CASE WHEN x // 86400 = 1 THEN ' day' ELSE ' days' END END AS words,
  CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN replace(printf('%.1f', round_even(b / 1024, 1)), '.', ',') || ' KB'
       WHEN b < 1073741824 THEN replace(printf('%.1f', round_even(b / 1048576, 1)), '.', ',') || ' MB'
       ELSE replace(printf('%.1f', round_even(b / 1073741824, 1)), '.', ',') || ' GB' END AS size,
  'https://example.org/v/' || user_id || CASE WHEN f > 0 THEN '?t=' || f ELSE '' END AS url
FROM r
""",
    "str_heads": f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
c AS (SELECT *, {_strip(f"regexp_replace(text, '{_WHITE}+', ' ', 'g')")} AS c FROM n),
s AS (SELECT *, CASE WHEN length(c) <= 40 THEN c ELSE rtrim(substr(c, 1, 40)) || ' ...' END AS short FROM c)
SELECT doc_id, short,
  '[' || n || '] ' || CASE WHEN n % 3 = 0 THEN 'document ' || source || ' (chapter ' || lang || CASE WHEN n % 2 > 0 THEN ', page 1' ELSE '' END || ')'
    WHEN n % 3 = 1 THEN 'tool ' || lang || ' - ' || source || ' (' || lang || ')'
    ELSE source || ' (' || lang || ', ' || {_mark("n")} || '-' || {_mark("n + 3700")} || ')' END AS head,
  md5('Document: ' || source || CASE WHEN n > 2 THEN ' | Topic: ' || lang ELSE '' END || chr(10) || short) AS context
FROM s
""",
    "str_links": r"""
WITH a AS (SELECT doc_id, 'See [' || doc_id % 1200 || '] and [' || doc_id % 7 || '].' AS a FROM documents)
SELECT doc_id, regexp_replace(a, '\[(\d{1,3})\]', '[\1](#hit-\1)', 'g') AS linked, len(regexp_extract_all(a, '\[(\d{1,3})\]')) AS n_cited FROM a
""",
    "str_names": r"""
WITH m AS (SELECT c_custkey, c_mktsegment, c_name,
  lower(trim(['BAAI/', 'text-embedding-', '', 'org/sub/'][c_custkey % 4 + 1] || ['bge-m3', 'BGE-M3-GGUF', 'multilingual-e5-large', 'own'][c_custkey % 5 % 4 + 1]
    || ['', '-q8_0', '@latest'][c_custkey % 3 + 1])) AS m, lower(trim(['Deutsch', ' EN ', 'fr-FR', 'klingon', 'english'][c_custkey % 5 + 1])) AS l FROM customer),
b AS (SELECT *, regexp_replace(regexp_replace(string_split(m, '/')[-1], '^text-embedding-', ''), '(\.gguf|-gguf|-q\d.*|@.*)$', '') AS bare FROM m)
SELECT c_custkey, CASE WHEN contains(bare, 'bge-m3') THEN 'bge-m3' WHEN contains(bare, 'multilingual-e5-large') THEN 'multilingual-e5-large' ELSE bare END AS family,
  'groesse_' || regexp_replace(lower(c_mktsegment || ' ' || c_name), '[^a-z0-9]+', '_', 'g') AS function,
  CASE l WHEN 'deutsch' THEN 'de' WHEN 'english' THEN 'en' WHEN 'en' THEN 'en' WHEN 'fr-fr' THEN 'fr' END AS code
FROM b
""",
    "str_fill": """
SELECT p_partkey, 'https://example.org/?q=' || replace(p_name, ' ', '%20') || '&s=' || p_size AS url,
  '{"q": "' || p_name || '\\"", "n": ' || p_size || '}' AS json FROM part
""",
    "str_overlap": """
SELECT doc_id, substr(text, 1, 20) AS head,
  md5(CASE WHEN length(text) <= 50 THEN '' ELSE substr(text, 21, length(text) - 50) END) AS core,
  CASE WHEN length(text) <= 20 THEN '' ELSE right(text, least(30, length(text) - 20)) END AS tail FROM documents
""",
}
