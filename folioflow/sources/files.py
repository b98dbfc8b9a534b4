"""Media folders: recursive scans, stable ids, titles, sidecar files, sizes by area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..functions.values import lenient_time, tags
from ..operators.listing import first_per

# Endings of media files; keys under which sidecar files have a field, first one first.
ENDINGS = ("mp4", "mkv", "webm", "mov", "m4a", "mp3", "wav", "ogg", "opus", "flac")
DATE_KEYS = ("veroeffentlicht", "published", "upload_date", "release_date", "datum")
TAG_KEYS = ("schlagworte", "tags", "categories")
URL_KEYS = ("original_url", "webpage_url", "url")
CHANNEL_KEYS = ("kanal", "channel", "uploader")
TITLE_KEYS = ("titel", "title")
DURATION_KEYS = ("dauer_s", "duration")


def endings(text: str, default: tuple[str, ...] = ENDINGS) -> tuple[str, ...]:
    """SRC02: a comma list of endings, without dots, in lower case; the default for none."""
    found = [p.strip().lower().lstrip(".") for p in text.split(",")]
    return tuple(dict.fromkeys(p for p in found if p)) or default


def scan(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ENDINGS) -> DataFrame:
    """SRC01: (rel, name, stem, ending, bytes, modified) of the files below a folder, hidden ones and hidden folders left out.

    Only the listing is read, no content. Order them by ``lower(rel)`` where order counts.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    top = folder.rstrip("/").removeprefix("file://").removeprefix("file:")
    rel = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^[a-z]+:/*" + "".join(f"\\{c}" if not c.isalnum() else c for c in top.lstrip("/")) + "/", "")
    named = files.select(rel.alias("rel"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("rel", "/"), -1)
    full = named.withColumns({"name": name, "stem": F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "ending": F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))})
    return full.where(~F.rlike("rel", F.lit(r"(^|/)\.")) & (F.col("ending").isin(*kinds) if kinds else F.lit(True)))


def file_id(rel: Column) -> Column:
    """SRC03: a stable id from the relative path."""
    return F.concat(F.lit("datei-"), F.substring(F.sha1(F.encode(rel, "utf-8")), 1, 20))


def title_from_name(name: Column) -> Column:
    """SRC04: the name without its ending, underscores as blanks."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(collapse(F.translate(stem, "_", " ")), F.lit("")), stem)


def with_sidecars(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """SRC05: media rows with ``sidecar``, the JSON beside them: ``<stem>.info.json`` before ``<stem>.json``.

    sidecars: (rel, json). A broken or missing one is an empty object.
    """
    base = F.regexp_replace("rel", r"(\.info)?\.json$", "")
    rank = F.when(F.col("rel").endswith(".info.json"), 0).otherwise(1)
    best = first_per(sidecars.withColumns({"__base": base, "__rank": rank}), ["__base"], [F.asc("__rank")]).select("__base", "json")
    own = media.withColumn("__base", F.regexp_replace("rel", r"(?<=.)\.[^./]*$", ""))
    good = F.when(F.try_parse_json("json").isNotNull() & F.trim("json").startswith("{"), F.col("json")).otherwise("{}")
    return own.join(best, "__base", "left").withColumn("sidecar", F.coalesce(good, F.lit("{}"))).drop("__base", "json")


# Endings of pictures beside media files, best first; where a frame is taken from a file without one.
PICTURES = ("jpg", "jpeg", "png", "webp")
FRAME_S, FRAME_SHARE = 30.0, 0.1


def with_artwork(media: DataFrame, pictures: DataFrame, duration_col: str = "duration_s") -> DataFrame:
    """SRC31: media rows (rel, duration) with ``artwork``, the picture of their name beside them, or else ``frame_s``.

    pictures: (rel). Endings count as they are written, and of several pictures the first kind of ``PICTURES`` does; the
    frame is at a tenth of the duration, half a minute at most, at the start where the duration is not known.
    """
    base = F.regexp_replace("rel", r"(?<=[^/])\.[^./]*$", "")
    rank = F.array_position(F.array(*map(F.lit, PICTURES)), F.regexp_extract("rel", r"\.([^./]+)$", 1))
    kinds = pictures.select(base.alias("__base"), F.col("rel").alias("artwork"), rank.alias("__rank")).where("__rank > 0")
    best = first_per(kinds, ["__base"], [F.asc("__rank")]).drop("__rank")
    found = media.withColumn("__base", base).join(best, "__base", "left").drop("__base")
    frame = F.least(F.lit(FRAME_S), F.coalesce(F.col(duration_col), F.lit(0.0)) * FRAME_SHARE)
    return found.withColumn("frame_s", F.when(F.col("artwork").isNull(), frame))


def _first(j: Column, keys: tuple[str, ...]) -> Column:
    """The first key's value that is not empty, as text."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(j, f"$.{k}")), F.lit("")) for k in keys])


def videos(media: DataFrame) -> DataFrame:
    """SRC06, SRC09: rows (extern_id, title, published, duration_s, tags, channel, url, kind) from files and their sidecars."""
    j = F.col("sidecar")
    lists = [F.from_json(F.get_json_object(j, f"$.{k}"), "array<string>") for k in TAG_KEYS]
    starts = [F.get_json_object(j, f"$.{k}").startswith("[") for k in TAG_KEYS]
    dates = [lenient_time(F.get_json_object(j, f"$.{k}")) for k in DATE_KEYS]
    return media.select(
        file_id(F.col("rel")).alias("extern_id"), "rel",
        F.coalesce(_first(j, TITLE_KEYS), title_from_name(F.col("name"))).alias("title"),
        F.coalesce(*dates, F.col("modified")).alias("published"),
        _first(j, DURATION_KEYS).try_cast("double").try_cast("int").alias("duration_s"),
        tags(F.coalesce(*[F.when(s, x) for s, x in zip(starts, lists, strict=True)])).alias("tags"),
        F.coalesce(_first(j, CHANNEL_KEYS), F.lit("")).alias("channel"), F.coalesce(_first(j, URL_KEYS), F.lit("")).alias("url"),
        F.coalesce(F.lower(_first(j, ("typ",))), F.lit("video")).alias("kind"),
    )


def sizes(files: DataFrame, areas: list[str]) -> DataFrame:
    """SRC27: files and bytes of each first-level folder listed, and of all else as ``other``."""
    first = F.when(F.contains("rel", F.lit("/")), F.substring_index("rel", "/", 1)).otherwise("")
    area = F.when(first.isin(*areas), first).otherwise("other")
    return files.groupBy(area.alias("area")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """SRC22: the manifest's (path, bytes, sha256) with ``error`` where a file (path, content) is missing or not the same."""
    own = files.select("path", F.length("content").alias("__n"), F.sha2("content", 256).alias("__s"))
    error = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") != F.col("bytes"), "size").when(F.col("__s") != F.col("sha256"), "checksum")
    return manifest.join(own, "path", "left").withColumn("error", error).drop("__n", "__s")


# Parts of paths in a model store that no receiver needs.
STORE_ONLY = ("blobs", ".locks", ".DS_Store", "CACHEDIR.TAG")


def model_files(files: DataFrame, refs: DataFrame) -> DataFrame:
    """SNK08: the files (rel, modified) of a model store that a receiver needs.

    Of a folder ``models--<owner>--<name>`` only the snapshot of the revision counts that ``refs`` (folder, revision) names for
    it, or else its latest one; stores and locks are left out everywhere, and all else is taken.
    """
    path = F.split("rel", "/")
    needed = files.where(~F.exists(path, lambda p: p.isin(*STORE_ONLY)))
    folder = F.regexp_extract("rel", r"^((?:[^/]+/)*?models--[^/]+)/", 1)
    snapshot = F.regexp_extract("rel", r"^(?:[^/]+/)*?models--[^/]+/snapshots/([^/]+)/", 1)
    placed = needed.withColumns({"__f": folder, "__s": snapshot})
    own = F.col("__s") != ""
    newest = placed.where(own).groupBy("__f").agg(F.max(F.struct("modified", "__s"))["__s"].alias("__n"))
    named = refs.select(F.col("folder").alias("__f"), F.nullif(F.trim("revision", F.lit(" \t\r\n")), F.lit("")).alias("__r"))
    current = newest.join(named, "__f", "left").select("__f", F.coalesce("__r", "__n").alias("__s"))
    return placed.where(~own).unionByName(placed.where(own).join(current, ["__f", "__s"], "left_semi")).drop("__f", "__s")
