"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import (
    byte_bpe,
    html_text,
    license_scan,
    line_dedup,
    line_quality,
    mixing,
    mpeg_audio,
    near_dedup,
    periodic_runs,
    phrase_dedup,
    quality_rules,
    spelling,
    token_counts,
)
from .common import remove_folder, shared_folder, table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
#: The id that ends documents in flat files of these ranks, free in them.
END_OF_DOCUMENT = 50256
#: Target weights of the mix, in parts, and the parts that all other sources share.
PARTS, OTHER_PARTS = {"src0": 4, "src1": 3, "src2": 2}, 11


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = mpeg_audio.carry_bytes(table(spark, sf_dir, "documents"))
    sizes = media.select("n_bytes", F.struct("doc_id", "n_bytes").alias("key"), "media")
    scanned = mpeg_audio.scan_media(sizes, id_col="key")
    return scanned.select(
        "key.doc_id",
        "key.n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        mpeg_audio.feature().alias("feature"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed_lines", "text")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), PARTS, OTHER_PARTS)
    return mixed.select("doc_id", "source", "block", "release", "deadline", "slot")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as flat files, found again without an index; the files' order gives back their ids."""
    folder = shared_folder(spark, "tokens")
    written = token_counts.write_flat(table(spark, sf_dir, "documents"), folder, RANKS, PATTERN, END_OF_DOCUMENT)
    counted = token_counts.count_tokens(spark, folder, END_OF_DOCUMENT)
    remove_folder(spark, folder)  # the blocks' ends are in a checkpoint by now
    return counted.join(written, ["file", "doc"], "left").select("doc_id", "n_tokens", "closed")


def op6_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_dedup.phrase_dedup(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality(table(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *counts, "base_failed", "kept")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("licences").cast("long").alias("n_licences"),
        F.size(F.filter("licences", lambda x: x["confirmed"])).cast("long").alias("n_confirmed"),
        F.array_join("families", ",").alias("families"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), RANKS, PATTERN, decoded=True)
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.planted_periods(table(spark, sf_dir, "documents")))
    # The longest run, the first of equals; runs are in the order of their starts and periods.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    rows = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), F.array_join(rows, "").alias("rows"), "collapsed_sha256")
    return found.select(
        "doc_id", "n_runs",
        (-F.col("m.s")).alias("start"), F.col("m.l").alias("length"), (-F.col("m.p")).alias("period"),
        F.floor(1000 * F.col("m.l") / -F.col("m.p")).alias("exponent_milli"),
        F.sha2("rows", 256).alias("runs_sha256"), "collapsed_sha256",
    )


def op13_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose CRC leaves 2 are held out: their labels are not learned."""
    docs = table(spark, sf_dir, "documents")
    held_out = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    weights = line_quality.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = line_quality.score_documents(docs, weights)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_text,
        op2_media_columns,
        op3_line_dedup,
        op4_mix_sources,
        op5_token_counts,
        op6_phrase_dedup,
        op7_near_dedup,
        op8_quality_rules,
        op9_license_scan,
        op10_byte_bpe,
        op11_spelling_groups,
        op12_periodic_runs,
        op13_line_quality,
        pipeline,
    )
}

ORACLE: dict[str, str] = {
    "op3_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p,
         unnest(string_split(coalesce(text, ''), chr(10))) AS s
  FROM documents),
n AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k
  FROM lines WHERE regexp_matches(s, '[^\x20\x09-\x0D]')),
w AS (
  SELECT a.doc_id, a.p AS p1, b.p AS p2, c.p AS p3, a.s || chr(10) || b.s || chr(10) || c.s AS t
  FROM n a JOIN n b ON b.doc_id = a.doc_id AND b.k = a.k + 1 JOIN n c ON c.doc_id = a.doc_id AND c.k = a.k + 2),
later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, p1) AS r FROM w) WHERE r > 1),
gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT doc_id, p1 AS p FROM later UNION ALL SELECT doc_id, p2 FROM later UNION ALL SELECT doc_id, p3 FROM later))
SELECT l.doc_id, count(*) FILTER (regexp_matches(l.s, '[^\x20\x09-\x0D]')) AS n_lines, count(g.p) AS n_removed_lines,
       coalesce(string_agg(l.s, chr(10) ORDER BY l.p) FILTER (g.p IS NULL), '') AS text
FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.p = l.p
GROUP BY l.doc_id
""",
    "op4_mix_sources": r"""
WITH RECURSIVE n AS (
  SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 16 AS block FROM documents),
s AS (
  SELECT source, CASE source WHEN 'src0' THEN 4 WHEN 'src1' THEN 3 WHEN 'src2' THEN 2 END AS own
  FROM (SELECT DISTINCT source FROM documents)),
k AS (
  SELECT *, CASE WHEN own IS NULL THEN count(*) OVER (PARTITION BY own IS NULL) ELSE 1 END AS rivals,
    CASE WHEN own IS NULL THEN row_number() OVER (PARTITION BY own IS NULL ORDER BY md5(CASE WHEN source IS NULL THEN '' ELSE '=' || source END)) - 1
      ELSE 0 END AS turn,
    CASE WHEN own IS NULL THEN 'others' ELSE source END AS entry
  FROM s),
e AS (
  SELECT entry, coalesce(any_value(own), 11) AS parts, row_number() OVER (ORDER BY any_value(own) IS NULL, entry) AS i
  FROM k GROUP BY entry),
t AS (SELECT sum(parts)::BIGINT AS total, list(parts ORDER BY i) AS parts FROM e),
plan AS (
  SELECT 0::BIGINT AS slot, list_transform(parts, lambda x: 0::BIGINT) AS done, NULL::BIGINT AS pick FROM t
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda x, i: CASE WHEN i = best THEN x + 1 ELSE x END), best
  FROM (
    SELECT p.slot, p.done, list_min(list_filter(list_transform(t.parts, lambda w, i:
        CASE WHEN p.done[i] * t.total // w <= p.slot
          THEN {'due': ((p.done[i] + 1) * t.total + w - 1) // w, 'i': i::BIGINT} END), lambda x: x IS NOT NULL)).i AS best, t.total
    FROM plan p, t)
  WHERE slot < total),
slots AS (
  SELECT pick AS i, slot - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS nth
  FROM plan WHERE pick IS NOT NULL),
m AS (
  SELECT n.doc_id, n.source, n.block, n.block * k.rivals + k.turn AS nth, e.i, e.parts
  FROM n JOIN k ON n.source IS NOT DISTINCT FROM k.source JOIN e ON e.entry = k.entry)
SELECT m.doc_id, m.source, m.block, m.nth * t.total // m.parts AS release,
  ((m.nth + 1) * t.total + m.parts - 1) // m.parts AS deadline, m.nth // m.parts * t.total + slots.slot AS slot
FROM m JOIN slots ON slots.i = m.i AND slots.nth = m.nth % m.parts, t
""",
    "op8_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS t FROM (
    SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, t) AS n FROM win) WHERE n > 1),
covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
c AS (
  SELECT d.rid, doc_id, source, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
     - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT
      AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN covered USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS k FROM f GROUP BY source),
m AS (
  SELECT sum(k) / sum(n) AS m,
    greatest(0, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) ** 2
      - sum(k) / sum(n) * (1 - sum(k) / sum(n)) * count(*) / sum(n)) AS v
  FROM h),
p AS (SELECT m, least(1000, greatest(1, m * (1 - m) / greatest(v, 1e-9) - 1)) AS strength FROM m),
r AS (SELECT source, (k + strength * m) / (n + strength) > 0.6 AS rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rejected AS kept
FROM f JOIN r ON r.source IS NOT DISTINCT FROM f.source
""",
    "op11_spelling_groups": r"""
WITH RECURSIVE crcs AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
each AS (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY ALL),
bytes AS (  -- letters from 192 on have two bytes in UTF-8
  SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda s:
    CASE WHEN ord(s) < 128 THEN [ord(s)::BIGINT] ELSE [192 + ord(s) // 64, 128 + ord(s) % 64] END)) AS b
  FROM each),
coded AS (
  SELECT run, times, doc_id IS NOT NULL AS known,
    xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS h
  FROM bytes, crcs),
v AS (
  SELECT CASE WHEN known AND h % 199 = 0
      THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word,
    sum(times)::BIGINT AS n
  FROM coded GROUP BY 1 HAVING length(word) >= 6 AND sum(times) >= 5),
less AS (  -- each word without its letter i
  SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS near FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, rest FROM less WHERE rest IN (SELECT word FROM v)
  UNION SELECT rest, word FROM less WHERE rest IN (SELECT word FROM v)),
best AS (
  SELECT p.word, count(*) AS n_near, max(v.n) AS most, arg_min(near, (-v.n, near)) AS near
  FROM pairs p JOIN v ON v.word = p.near GROUP BY p.word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * v.n THEN near END AS form, CASE WHEN most >= 5 * v.n THEN most END AS form_n
  FROM v LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root FROM f
  UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM f JOIN chain c ON c.word = f.word JOIN f AS e ON e.word = c.root AND e.form IS NULL
""",
    "op12_periodic_runs": r"""
WITH crcs AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
      lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS h
  FROM documents, crcs),
p AS (
  SELECT *, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS parts FROM d),
words AS (
  SELECT rid, i, w[CASE WHEN planted AND i >= a THEN a + (i - a) % (1 + (n - a) // parts) ELSE i END + 1] AS word, n
  FROM (SELECT *, unnest(range(n)) AS i FROM p)),
same AS (
  SELECT x.rid, x.i, y.i - x.i AS q FROM words x JOIN words y ON y.rid = x.rid AND y.word = x.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
found AS (
  SELECT rid, min(i) AS start, count(*) + q AS length, q AS period
  FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM same)
  GROUP BY rid, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT rid, start, length, min(period) AS period FROM found GROUP BY ALL),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT rid, sha256(string_agg(word, ' ' ORDER BY i)) AS digest
  FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid),
best AS (
  SELECT rid, count(*) AS n_runs, arg_min({'start': start, 'length': length, 'period': period}, (-length, start, period)) AS m,
    sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS digest
  FROM runs GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, m.start AS start, m.length AS length, m.period AS period, 1000 * m.length // m.period AS exponent_milli,
  coalesce(best.digest, sha256('')) AS runs_sha256, coalesce(kept.digest, sha256('')) AS collapsed_sha256
FROM p LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
""",
}
