"""Functions on dates, numbers, arrays and JSON as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip


# ---- dates
def lenient_time(x: Column) -> Column:
    """DAT01: a timestamp in UTC from ISO text or eight digits; null for anything else."""
    t = F.trim(x)
    return F.when(F.rlike(t, F.lit(r"^\d{8}$")), F.try_to_timestamp(t, F.lit("yyyyMMdd"))).otherwise(t.try_cast("timestamp"))


def run_time(started: Column, finished: Column, now: Column) -> Column:
    """DAT02: seconds a job has run, to now while it runs, never negative; null before it starts."""
    seconds = (F.unix_micros(F.coalesce(finished, now)) - F.unix_micros(started)) / 1e6
    return F.when(started.isNotNull(), F.greatest(F.lit(0.0), seconds))


def older_than(finished: Column, created: Column, now: Column, days: int) -> Column:
    """DAT03: done, or else made, more than ``days`` days ago."""
    return F.coalesce(finished, created) < now - F.make_dt_interval(F.lit(days))


def ago(then: Column, now: Column) -> Column:
    """DAT04: how long ago, in its largest unit."""
    s = F.floor((F.unix_micros(now) - F.unix_micros(then)) / 1e6)
    unit = lambda n, name: F.concat(n.cast("string"), F.when(n == 1, f" {name} ago").otherwise(f" {name}s ago"))
    return (
        F.when(s < 60, "just now")
        .when(s < 3600, unit(F.floor(s / 60), "minute"))
        .when(s < 86400, unit(F.floor(s / 3600), "hour"))
        .otherwise(unit(F.floor(s / 86400), "day"))
    )


def strict_time(x: Column) -> Column:
    """DAT05: a timestamp from ISO text; null for the empty text, an error for anything else."""
    return F.nullif(F.trim(x), F.lit("")).cast("timestamp")


# ---- numbers
def score_of(x: Column) -> Column:
    """MTH02: a score from 0 to 10 from text with a decimal point or comma; 0 for anything else."""
    number = F.replace(F.trim(x), F.lit(","), F.lit(".")).try_cast("double")
    return F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.coalesce(number, F.lit(0.0))))


def share(done: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """MTH03: a progress from 0 to 1 mapped into a part of the whole."""
    return low + (high - low) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), done))


def token_budget(chars: Column) -> Column:
    """MTH04: tokens set aside for an answer to so many characters."""
    return F.ceil(chars / 2.5) + 300


def may_load(available: Column, size: Column, reserve: Column) -> Column:
    """MTH05: whether the reserve stays free."""
    return available - size >= reserve


# ---- arrays
def tags(x: Column) -> Column:
    """ARR01: trimmed tags without empty ones; none for null."""
    return F.coalesce(F.filter(F.transform(x, strip), lambda t: t != ""), F.array().cast("array<string>"))


def kinds(x: Column) -> Column:
    """ARR02: a comma list as distinct lower-case names, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(x, ","), lambda t: F.lower(strip(t))), lambda t: t != "")))


def correct_segments(segments: Column, changes: Column) -> Column:
    """ARR03: segments (text, words) with texts replaced by index; a changed text loses its words; an unknown index is an error."""
    bad = F.exists(F.map_keys(changes), lambda i: (i < 0) | (i >= F.size(segments)))
    changed = F.transform(
        segments,
        lambda s, i: F.struct(
            F.coalesce(F.element_at(changes, i), s["text"]).alias("text"),
            F.when(F.coalesce(F.element_at(changes, i) != s["text"], F.lit(False)), F.array().cast("array<string>"))
            .otherwise(s["words"])
            .alias("words"),
        ),
    )
    return F.when(bad, F.raise_error(F.lit("no such segment")).cast("array<struct<text:string,words:array<string>>>")).otherwise(changed)


def full_text(texts: Column) -> Column:
    """ARR04: trimmed texts joined by a blank, empty ones left out."""
    return F.array_join(F.filter(F.transform(texts, strip), lambda t: t != ""), " ")


def replace_block(paragraphs: Column, block: Column, new: Column) -> Column:
    """ARR05: paragraphs (start, block, text) with one block's replaced, in order of start."""
    return F.array_sort(F.concat(F.filter(paragraphs, lambda p: p["block"] != block), new))


def pin(pinned: Column, changed: Column, allowed: list[str]) -> Column:
    """ARR06: the fields pinned before and now, of those allowed, sorted."""
    return F.array_sort(F.array_intersect(F.array_union(pinned, changed), F.array([F.lit(a) for a in allowed])))


def first_number(*values: Column) -> Column:
    """ARR07: the first value present as a number, else 0."""
    return F.coalesce(*[v.try_cast("double") for v in values], F.lit(0.0))


# ---- JSON
def json_values(x: Column, path: str) -> Column:
    """JSN01: the texts at a path such as ``a[].b`` or ``a[1].b``; missing parts give none, the empty path the document.

    Each step works on an array of variants, so one match and many are alike, and the text is parsed once.
    """
    found = F.filter(F.array(F.try_parse_json(x)), lambda v: v.isNotNull())
    items = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    for part in [p for p in path.replace("[", ".[").split(".") if p]:
        if part == "[]":
            found = F.flatten(F.transform(found, items))
        elif part.startswith("[-"):
            back = int(part[1:-1])
            found = F.transform(found, lambda v: F.try_element_at(items(v), F.lit(back)))
        else:
            at = f"$.{part}" if not part.startswith("[") else f"${part}"
            found = F.transform(found, lambda v: F.try_variant_get(v, at, "variant"))
        found = F.filter(found, lambda v: v.isNotNull() & ~F.is_variant_null(v))
    plain = lambda v: F.schema_of_variant(v) == "STRING"
    return F.transform(found, lambda v: F.when(plain(v), F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v)))


def segments_of_json(x: Column) -> Column:
    """SRC26: the segments (start, end, text, words) of a transcription service's answer, a list under ``segments`` or by itself.

    Entries that are no objects are skipped, numbers that are none are 0, missing texts empty.
    """
    whole = F.try_parse_json(x)
    listed = F.coalesce(
        F.try_variant_get(whole, "$.segments", "array<variant>"), F.try_variant_get(whole, "$", "array<variant>"), F.array().cast("array<variant>")
    )
    number = lambda v, at: F.coalesce(F.try_variant_get(v, at, "string").try_cast("double"), F.lit(0.0))
    text = lambda v, at: F.coalesce(F.try_variant_get(v, at, "string"), F.lit(""))
    word = lambda w: F.struct(text(w, "$.word").alias("word"), number(w, "$.start").alias("start"), number(w, "$.end").alias("end"))
    words = lambda v: F.coalesce(F.try_variant_get(v, "$.words", "array<variant>"), F.array().cast("array<variant>"))
    objects = F.filter(listed, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    return F.transform(
        objects,
        lambda v: F.struct(
            number(v, "$.start").alias("start"), number(v, "$.end").alias("end"), text(v, "$.text").alias("text"),
            F.transform(words(v), word).alias("words"),
        ),
    )


def zip_results(texts: Column, titles: Column, urls: Column) -> Column:
    """JSN02: texts with titles and urls: by place if there are as many, one for all if there is one, else empty."""
    beside = lambda a, i: F.when(F.size(a) == F.size(texts), F.get(a, i)).when(F.size(a) == 1, F.get(a, F.lit(0))).otherwise("")
    return F.transform(texts, lambda t, i: F.struct(t.alias("text"), beside(titles, i).alias("title"), beside(urls, i).alias("url")))


def salvage_json(x: Column) -> Column:
    """JSN03: the first JSON object in a model's answer: in a fence, the whole, or from the first to the last brace."""
    fence = F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    good = lambda t: F.when(F.try_parse_json(t).isNotNull() & F.trim(t).startswith("{"), F.trim(t))
    return F.coalesce(good(fence), good(x), good(braces))


def ratings(x: Column, n: Column) -> Column:
    """JSN04: n scores from an answer: a list of (nr, wert), a list or a map of numbers; else ``nr: score`` in the text; missing are 0.

    Null if the answer has no score at all.
    """
    pairs = F.from_json(F.get_json_object(salvage_json(x), "$.bewertungen"), "array<struct<nr:string,wert:string>>")
    listed = F.filter(pairs, lambda p: p["nr"].isNotNull())
    plain = F.from_json(F.coalesce(F.get_json_object(salvage_json(x), "$.bewertungen"), F.regexp_extract(x, r"(\[[^\[\]{}]*\])", 1)), "array<string>")
    loose = F.regexp_extract_all(x, F.lit(r"(\d+)\s*[:=]\s*(\d+(?:[.,]\d+)?)"), F.lit(1))
    scores = F.regexp_extract_all(x, F.lit(r"(\d+)\s*[:=]\s*(\d+(?:[.,]\d+)?)"), F.lit(2))
    numbers = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    of = lambda ns, vs: F.transform(numbers, lambda i: score_of(F.get(vs, F.array_position(ns, i.cast("string")).cast("int") - 1)))
    by_pairs = of(F.transform(listed, lambda p: F.trim(p["nr"])), F.transform(listed, lambda p: p["wert"]))
    by_place = F.transform(numbers, lambda i: score_of(F.get(plain, i - 1)))
    return F.when(F.size(listed) > 0, by_pairs).when(F.size(plain) > 0, by_place).when(F.size(loose) > 0, of(loose, scores))


def merge_metadata(old: Column, new: Column, survivor: str = "detail") -> Column:
    """JSN05: the new map, with the old one's ``survivor`` where the new one has none."""
    kept = F.map_filter(old, lambda k, v: (k == survivor) & ~F.map_contains_key(new, survivor))
    return F.map_concat(kept, new)


def direct_argument(required: Column, texts: Column) -> Column:
    """JSN06: the one text parameter that a question can fill: the only one required, else the only one, else null."""
    needed = F.array_intersect(texts, required)
    return F.when((F.size(required) == 1) & (F.size(needed) == 1), needed[0]).when(
        (F.size(required) == 0) & (F.size(texts) == 1), F.get(texts, F.lit(0))
    )


def masked(x: Column) -> Column:
    """JSN07: a secret with its last four characters shown, none of a short one."""
    return F.when(F.length(x) > 8, F.concat(F.lit("********"), F.right(x, F.lit(4)))).otherwise(F.when(x == "", "").otherwise("********"))


def byte_range(header: Column, total: Column) -> Column:
    """SRC23: struct(start, stop, status) of a ``bytes=a-b``, ``a-`` or ``-n`` header: partial, whole or unsatisfiable."""
    a = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 1)
    b = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 2)
    valid = F.coalesce(F.rlike(header, F.lit(r"^bytes=(\d+-\d*|-\d+)$")), F.lit(False))
    start = F.when(a == "", F.greatest(F.lit(0), total - b.try_cast("long"))).otherwise(a.try_cast("long"))
    stop = F.when((a == "") | (b == ""), total - 1).otherwise(F.least(b.try_cast("long"), total - 1))
    bad = (start >= total) | (stop < start) | ((a == "") & (b.try_cast("long") == 0))
    return let(
        F.struct(valid.alias("v"), bad.alias("bad"), start.alias("a"), stop.alias("b")),
        lambda x: F.struct(
            F.when(x["v"] & ~x["bad"], x["a"]).otherwise(F.lit(0)).alias("start"),
            F.when(x["v"] & ~x["bad"], x["b"]).otherwise(total - 1).alias("stop"),
            F.when(~x["v"], "whole").when(x["bad"], "unsatisfiable").otherwise("partial").alias("status"),
        ),
    )


def progress_seconds(line: Column) -> Column:
    """SRC25: seconds from a progress line ``out_time_us=...``."""
    return F.nullif(F.regexp_extract(line, r"^out_time_us=(\d+)\s*$", 1), F.lit("")).try_cast("long") / 1e6


def audio_of(probe: Column) -> Column:
    """SRC24: struct(duration, rate, channels) of a probe's first audio stream; the format's duration before the stream's."""
    j = F.from_json(
        probe,
        "format struct<duration:string>, streams array<struct<codec_type:string,duration:string,sample_rate:string,channels:int>>",
    )
    s = F.get(F.filter(j["streams"], lambda x: x["codec_type"] == "audio"), F.lit(0))
    return F.struct(
        F.coalesce(j["format"]["duration"].try_cast("double"), s["duration"].try_cast("double")).alias("duration"),
        s["sample_rate"].try_cast("int").alias("rate"),
        s["channels"].alias("channels"),
    )
