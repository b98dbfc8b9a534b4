"""Date, number, array and JSON functions over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as v
from .tables import table

NOW = "2024-01-31 00:00:00"


def dat_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT01-DAT05 over events and made-up spellings of their times."""
    now = F.lit(NOW).cast("timestamp")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    k = F.col("event_id") % 4
    text = (
        F.when(k == 0, F.date_format("ts", "yyyyMMdd")).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k == 2, F.lit("soon")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00")))
    )
    finished = F.when(k > 0, F.col("ts") - F.expr("interval 10 seconds") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round("value", 2).cast("decimal(18,6)")))
    strict = v.strict_time(F.when(k == 1, "").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    return rows.select(
        "event_id", F.unix_seconds(v.lenient_time(text)).alias("lenient"), F.round(v.run_time(F.col("ts"), finished, now), 3).alias("ran"),
        v.older_than(finished, F.col("ts"), now, 12).alias("old"), v.ago(F.col("ts"), now).alias("ago"), F.unix_seconds(strict).alias("strict"),
    )


def mth_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH02-MTH05 over parts."""
    text = F.when(F.col("p_partkey") % 3 == 0, F.replace((F.col("p_size") / 4).cast("string"), F.lit("."), F.lit(","))).when(
        F.col("p_partkey") % 3 == 1, F.lit("x")
    ).otherwise(F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", v.score_of(text).alias("score"), F.round(v.share(F.col("p_size") / 40, 0.2, 0.6), 6).alias("share"),
        v.token_budget(F.length("p_name")).alias("tokens"), v.may_load(F.lit(950.0), F.col("p_retailprice") / 2, F.lit(450.0)).alias("may"),
    )


def arr_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR01, ARR02, ARR04, ARR06, ARR07 over names of parts and lines of documents."""
    rows = table(spark, sf_dir, "part")
    listed = F.concat("p_name", F.lit(" , "), F.lower("p_type"), F.lit(",, "), "p_type")
    joined = lambda a: F.array_join(a, "|")
    tagged = v.tags(F.when(F.col("p_size") % 2 == 0, F.split(listed, ",")))
    pins = v.pin(F.array(F.lit("title"), F.col("p_type")), F.split("p_name", " "), ["title", "ring", "bolt", "SMALL"])
    number = v.first_number(F.when(F.col("p_size") > 20, F.lit("no")), F.when(F.col("p_size") > 5, F.col("p_size").cast("string")))
    return rows.select(
        "p_partkey", joined(tagged).alias("tags"), joined(v.kinds(listed)).alias("kinds"), v.full_text(F.split(listed, ",")).alias("full"),
        joined(pins).alias("pins"), number.alias("number"),
    )


def arr_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR03, ARR05: items of an order as segments with two texts changed, and as paragraphs with a block replaced."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("t")
    )
    segments = F.transform("t", lambda x: F.struct(x["l_partkey"].cast("string").alias("text"), F.array(x["l_suppkey"].cast("string")).alias("words")))
    changed = v.correct_segments(segments, F.create_map(F.lit(0), F.lit("new")))
    paragraphs = F.transform("t", lambda x: F.struct(x["l_partkey"].alias("start"), (x["l_linenumber"] % 3).alias("block"), x["l_suppkey"].cast("string").alias("text")))
    new = F.array(F.struct(F.lit(7).cast("long").alias("start"), F.lit(1).alias("block"), F.lit("new").alias("text")))
    blocks = v.replace_block(paragraphs, F.lit(1), new)
    return rows.select(
        "l_orderkey", F.array_join(F.transform(changed, lambda s: F.concat_ws(":", s["text"], F.size(s["words"]).cast("string"))), "|").alias("segments"),
        F.array_join(F.transform(blocks, lambda p: F.concat_ws(":", p["start"].cast("string"), p["block"].cast("string"), p["text"])), "|").alias("blocks"),
    )


def jsn_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN01, JSN02 over made-up answers of tools about parts."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    item = lambda a, b: F.struct(a.alias("text"), b.alias("url"))
    two = F.array(item(F.col("p_name"), F.lit("u1")), item(F.col("p_brand"), F.lit("u2")))
    answer = F.to_json(F.struct(F.when(F.col("p_size") % 2 == 0, two).otherwise(F.slice(two, 1, 1)).alias("hits"), F.struct(F.col("p_size").alias("n")).alias("info")))
    texts = v.json_values(F.col("a"), "hits[].text")
    zipped = v.zip_results(texts, F.array(F.lit("all")), v.json_values(F.col("a"), "hits[].url"))
    return rows.withColumn("a", answer).select(
        "p_partkey", F.array_join(texts, "|").alias("texts"), F.array_join(v.json_values(F.col("a"), "hits[1].text"), "|").alias("second"),
        F.array_join(v.json_values(F.col("a"), "hits[-1].url"), "|").alias("last"), F.array_join(v.json_values(F.col("a"), "info.n"), "|").alias("n"),
        F.size(v.json_values(F.col("a"), "info.none.x")).alias("none"), F.array_join(F.transform(zipped, lambda z: F.concat_ws("/", z["text"], z["title"], z["url"])), "|").alias("zipped"),
    )


def jsn_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN03, JSN04: scores out of a model's answers in the shapes that occur."""
    k = F.col("p_partkey") % 5
    n = F.col("p_size").cast("string")
    answer = (
        F.when(k == 0, F.concat(F.lit('Sure: ```json\n{"bewertungen": [{"nr": 1, "wert": '), n, F.lit('}, {"nr": 3, "wert": "2,5"}]}\n```')))
        .when(k == 1, F.concat(F.lit('{"bewertungen": ['), n, F.lit(", 4]}")))
        .when(k == 2, F.concat(F.lit("1: "), n, F.lit("\n2 = 3,5")))
        .when(k == 3, F.concat(F.lit('so {"x": 1} and 2:'), n))
        .otherwise("none")
    )
    scores = v.ratings(answer, F.lit(3))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(scores.cast("array<string>"), ",").alias("scores"))


def jsn_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN05-JSN07 over parts."""
    old = F.create_map(F.lit("detail"), F.col("p_name"), F.lit("gone"), F.lit("x"))
    new = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("detail"), F.col("p_brand"))).otherwise(F.create_map(F.lit("n"), F.col("p_brand")))
    m = v.merge_metadata(old, new)
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey", m["detail"].alias("detail"), F.size(m).alias("n"),
        v.direct_argument(F.slice(words, 1, (F.col("p_size") % 2).cast("int")), F.slice(words, 1, (F.col("p_size") % 3).cast("int"))).alias("argument"),
        v.masked(F.substring("p_name", 1, 12)).alias("masked"),
    )


def src_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC23: byte ranges of documents."""
    k, a = F.col("doc_id") % 6, F.col("doc_id")
    header = (
        F.when(k == 0, F.concat(F.lit("bytes="), a, F.lit("-"), a * 2)).when(k == 1, F.concat(F.lit("bytes="), a, F.lit("-")))
        .when(k == 2, F.concat(F.lit("bytes=-"), a)).when(k == 3, F.lit("bytes=9-3")).when(k == 4, F.lit("items=1-2"))
    )
    x = v.byte_range(header, F.col("n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", x["start"].alias("start"), x["stop"].alias("stop"), x["status"].alias("status"))


def src_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC24, SRC25: made-up probes and progress lines."""
    p = F.concat(
        F.lit('{"streams": [{"codec_type": "video"}, {"codec_type": "audio", "duration": "9.5", "sample_rate": "'), F.col("p_partkey") + 8000,
        F.lit('", "channels": 2}]'), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(', "format": {"duration": "'), "p_size", F.lit('"}'))).otherwise(""), F.lit("}"),
    )
    a = v.audio_of(p)
    line = F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("out_time_us="), F.col("p_partkey") * 1000)).otherwise("progress=end")
    return table(spark, sf_dir, "part").select(
        "p_partkey", a["duration"].alias("duration"), a["rate"].alias("rate"), a["channels"].alias("channels"), v.progress_seconds(line).alias("at")
    )


QUERIES = {
    f.__name__: f
    for f in (dat_times, mth_numbers, arr_lists, arr_segments, jsn_paths, jsn_answers, jsn_merge, src_ranges, src_probe)
}

ORACLE = {
    "dat_times": f"""
WITH e AS (SELECT event_id, ts, event_id % 4 AS k, CASE WHEN event_id % 4 > 0 THEN ts - INTERVAL 10 SECOND + to_microseconds(round(round(value, 2) * 1000000)::BIGINT) END AS f,
  epoch(TIMESTAMP '{NOW}') - epoch(ts) AS s FROM events)
SELECT event_id, CASE k WHEN 0 THEN epoch(date_trunc('day', ts)) WHEN 1 THEN floor(epoch(ts)) WHEN 3 THEN floor(epoch(ts)) - 7200 END::BIGINT AS lenient,
  round(greatest(0, epoch(coalesce(f, TIMESTAMP '{NOW}')) - epoch(ts)), 3) AS ran, coalesce(f, ts) < TIMESTAMP '{NOW}' - INTERVAL 12 DAY AS old,
  CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN floor(s / 60)::BIGINT || CASE WHEN floor(s / 60) = 1 THEN ' minute ago' ELSE ' minutes ago' END
    WHEN s < 86400 THEN floor(s / 3600)::BIGINT || CASE WHEN floor(s / 3600) = 1 THEN ' hour ago' ELSE ' hours ago' END
    ELSE floor(s / 86400)::BIGINT || CASE WHEN floor(s / 86400) = 1 THEN ' day ago' ELSE ' days ago' END END AS ago,
  CASE WHEN k <> 1 THEN floor(epoch(ts))::BIGINT END AS strict FROM e""",
    "mth_numbers": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN least(p_size / 4, 10) WHEN 1 THEN 0 ELSE least(p_size, 10) END::DOUBLE AS score,
round(0.2 + 0.4 * least(p_size / 40, 1), 6) AS share, ceil(length(p_name) / 2.5)::BIGINT + 300 AS tokens, 950 - p_retailprice / 2 >= 450 AS may FROM part""",
    "arr_lists": """
WITH p AS (SELECT *, p_name || ' , ' || lower(p_type) || ',, ' || p_type AS l FROM part),
s AS (SELECT *, list_filter(list_transform(string_split(l, ','), lambda t: trim(t)), lambda t: t <> '') AS t FROM p)
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN array_to_string(t, '|') ELSE '' END AS tags,
  array_to_string(list_sort(list_distinct(list_transform(t, lambda x: lower(x)))), '|') AS kinds, array_to_string(t, ' ') AS full,
  array_to_string(list_sort(list_filter(list_distinct(list_concat(['title', p_type], string_split(p_name, ' '))), lambda x: x IN ('title', 'ring', 'bolt', 'SMALL'))), '|') AS pins,
  CASE WHEN p_size > 5 THEN p_size ELSE 0 END::DOUBLE AS number FROM s""",
    "arr_segments": """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem),
a AS (SELECT l_orderkey, string_agg(CASE WHEN i = 1 THEN 'new:0' ELSE l_partkey || ':1' END, '|' ORDER BY i) AS segments FROM k GROUP BY 1),
p AS (SELECT l_orderkey, l_partkey AS a, l_linenumber % 3 AS b, l_suppkey::VARCHAR AS t FROM lineitem WHERE l_linenumber % 3 <> 1
  UNION ALL SELECT DISTINCT l_orderkey, 7, 1, 'new' FROM lineitem)
SELECT l_orderkey, segments, string_agg(a || ':' || b || ':' || t, '|' ORDER BY a, b, t) AS blocks FROM p JOIN a USING (l_orderkey) GROUP BY ALL""",
    "jsn_paths": """SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN '|' || p_brand ELSE '' END AS texts, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS second,
CASE WHEN p_size % 2 = 0 THEN 'u2' ELSE 'u1' END AS last, p_size::VARCHAR AS n, 0 AS none,
p_name || '/all/u1' || CASE WHEN p_size % 2 = 0 THEN '|' || p_brand || '/all/u2' ELSE '' END AS zipped FROM part""",
    "jsn_answers": """
WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, printf('%.1f', least(p_size, 10)::DOUBLE) AS s FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN s || ',0.0,2.5' WHEN 1 THEN s || ',4.0,0.0' WHEN 2 THEN s || ',3.5,0.0' WHEN 3 THEN '0.0,' || s || ',0.0' END AS scores FROM p""",
    "jsn_merge": """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS detail, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS n,
CASE WHEN p_size % 2 = 1 AND p_size % 3 > 0 THEN string_split(p_name, ' ')[1] WHEN p_size % 2 = 0 AND p_size % 3 = 1 THEN string_split(p_name, ' ')[1] END AS argument,
CASE WHEN length(substr(p_name, 1, 12)) > 8 THEN '********' || right(substr(p_name, 1, 12), 4) ELSE '********' END AS masked FROM part""",
    "src_ranges": """
WITH d AS (SELECT doc_id, n_chars AS n, doc_id % 6 AS k FROM documents),
r AS (SELECT *, CASE k WHEN 0 THEN doc_id WHEN 1 THEN doc_id WHEN 2 THEN greatest(0, n - doc_id) WHEN 3 THEN 9 END AS a,
  CASE k WHEN 0 THEN least(doc_id * 2, n - 1) WHEN 3 THEN least(3, n - 1) ELSE n - 1 END AS b FROM d),
s AS (SELECT *, CASE WHEN k > 3 THEN 'whole' WHEN a >= n OR b < a OR (k = 2 AND doc_id = 0) THEN 'unsatisfiable' ELSE 'partial' END AS status FROM r)
SELECT doc_id, CASE WHEN status = 'partial' THEN a ELSE 0 END AS start, CASE WHEN status = 'partial' THEN b ELSE n - 1 END AS stop, status FROM s""",
    "src_probe": """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 9.5 END::DOUBLE AS duration, (p_partkey + 8000)::INT AS rate, 2 AS channels,
CASE WHEN p_size % 3 > 0 THEN p_partkey / 1000 END AS at FROM part""",
}
