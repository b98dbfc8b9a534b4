"""Listings: optional predicates, satellite joins, first row per key, paging, and counters over fixed dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions.text import function_name

# The stages of both kinds of work in their order, job states that are open.
VIDEO_STAGES = ("discovered", "audio", "transcribed", "corrected", "chunked", "embedded")
DOCUMENT_STAGES = ("imported", "chunked", "embedded")
OPEN_STATES = ("running", "waiting")


def contains(column: Column, words: str) -> Column:
    """Case-insensitive match of a user's text anywhere; ``%`` and ``_`` in it stay wildcards."""
    return F.ilike(column, F.lit(f"%{words}%"))


def where_all(rows: DataFrame, *predicates: Column | None) -> DataFrame:
    """FLT01-FLT03, FLT10: the rows for which all predicates hold; None is one that the user did not give."""
    given = [p for p in predicates if p is not None]
    return rows.where(reduce(lambda a, b: a & b, given)) if given else rows


def across_satellites(
    rows: DataFrame,
    satellites: list[tuple[DataFrame, str, list[Column | None]]],
    own: list[Column | None],
    any_of: list[Column | None],
) -> DataFrame:
    """FLT02: rows outer-joined to satellites (table, key, predicates), filtered on whichever side each predicate is about.

    Predicates of the rows (``own``) go below all joins. One of a satellite can hold only where it has a row, so it filters
    the satellite and makes its join an inner one. ``any_of`` are those over several sides, after the joins, where a missing
    satellite's columns are null. None is a predicate that the user did not give. A satellite has a row a key at most, and
    where the user asks about none of its columns it may be left out of the list: it neither adds nor drops rows.

    Rows without a key stay in an outer join, and Spark would send all of them to one task; see ``_outer``.
    """
    found = where_all(rows, *own)
    given = [[p for p in predicates if p is not None] for _, _, predicates in satellites]
    if not all(given):
        hashed = [F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
        found = found.withColumn("__apart", F.hash(*hashed))
    for (table, key, _), g in zip(satellites, given, strict=True):
        found = found.join(where_all(table, *g), key) if g else _outer(found, table, key)
    return where_all(found.drop("__apart"), *any_of)


def _outer(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join in which rows whose key is null are dealt by ``__apart``, a hash of the row, and meet nothing.

    Only rows that are equal in all columns stay together. Keys that are neither numbers nor texts are joined as they are.
    """
    kind = rows.select(key).schema[0].dataType
    if not isinstance(kind, (NumericType, StringType)):
        return rows.join(table, key, "left")
    apart = F.col("__apart").cast("string") if isinstance(kind, StringType) else F.col("__apart")
    meets = (F.coalesce(F.col(key), apart) == F.col("__key")) & F.col(key).isNotNull()
    return rows.join(table.withColumnRenamed(key, "__key"), meets, "left").drop("__key")


def in_period(since: str, *dates: Column) -> Column:
    """FLT04: any of the dates is at or after ``since``; nulls in all of them fail."""
    return reduce(lambda a, b: a | b, [F.coalesce(d >= F.lit(since).cast("timestamp"), F.lit(False)) for d in dates])


def in_scope(
    duration: Column, kind: Column, downloaded: Column, least: Column, most: Column, kinds: Column, only_downloaded: Column
) -> Column:
    """FLT06: longer than ``least``, not longer than ``most`` (0: no bound), of these kinds; a null duration fails."""
    fits = (duration > least) & ((most == 0) | (duration <= most)) & F.array_contains(kinds, kind)
    return F.coalesce(fits & (~only_downloaded | downloaded), F.lit(False))


def layered(*values: Column) -> Column:
    """FLT07, FLT08: the first value that is set; 0 and false are set."""
    return F.coalesce(*values)


def setting(raw: Column, kind: Column, least: Column, most: Column, choices: Column) -> Column:
    """FLT09: struct(value, error): the raw text as the setting's kind within its bounds, or what is wrong with it."""
    number = raw.try_cast("double")
    whole = (number == F.floor(number)) & number.isNotNull()
    word = F.lower(F.trim(raw))
    error = (
        F.when((kind == "int") & ~F.coalesce(whole, F.lit(False)), "not a whole number")
        .when((kind == "float") & number.isNull(), "not a number")
        .when(kind.isin("int", "float") & (number < least), "too small")
        .when(kind.isin("int", "float") & (number > most), "too large")
        .when((kind == "switch") & ~word.isin("true", "false", "on", "off", "yes", "no", "1", "0"), "not a switch word")
        .when((kind == "choice") & ~F.array_contains(choices, raw), "not a choice")
    )
    value = (
        F.when(kind == "int", number.cast("long").cast("string"))
        .when(kind == "float", number.cast("string"))
        .when(kind == "switch", word.isin("true", "on", "yes", "1").cast("string"))
        .otherwise(raw)
    )
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def has_all_words(query: str, *texts: Column) -> Column:
    """FLT13: every word of the query is in the joined texts, whatever its case."""
    whole = F.lower(F.concat_ws(" ", *texts))
    return reduce(lambda a, b: a & b, [F.contains(whole, F.lit(w)) for w in query.lower().split()], F.lit(True))


def stage_index(stage: Column, stages: tuple[str, ...] = VIDEO_STAGES) -> Column:
    """FLT17, MRG19: a stage's place in its order, from 0; null for none of them."""
    return F.nullif(F.array_position(F.array([F.lit(s) for s in stages]), stage) - 1, F.lit(-1))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """TOP04: one page of the ordered rows; only the rows up to its end are kept while sorting."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def first_per(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """TOP05, TOP06: the first ``n`` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def counted(rows: DataFrame, dimension: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """AGG06, AGG08: aggregates for every row of a fixed dimension, zeros where it has no rows."""
    found = rows.groupBy(*keys).agg(*aggregates)
    joined = dimension.join(found, keys, "left")
    return joined.fillna(0, [c for c in found.columns if c not in keys])


def literal(rows: DataFrame, name: str, values: tuple[str, ...]) -> DataFrame:
    """A fixed dimension of names in their order, as (name, position)."""
    one = rows.sparkSession.range(1).select(F.posexplode(F.array([F.lit(v) for v in values])).alias("position", name))
    return one.select(name, "position")


def remaining(mean_s: Column, waiting: Column, rest: Column, parallel: Column) -> Column:
    """AGG07: seconds until a kind's work is done; null without experience or work."""
    work = waiting + rest
    return F.when(mean_s.isNotNull() & (work > 0), mean_s * work / F.greatest(F.lit(1), parallel))


def occurrences(text: Column, needle: str) -> Column:
    """AGG16: how often the needle occurs, whatever its case, without overlaps."""
    low = F.lower(text)
    short = F.length(F.replace(low, F.lit(needle.lower()), F.lit("")))
    return ((F.length(low) - short) / len(needle)).cast("long")


def blocking(jobs: DataFrame, works: DataFrame, kind: str, stage: str) -> DataFrame:
    """JON06: the latest aborted job of a kind for each work that stands at ``stage`` and has no open job.

    jobs: (job_id, work_id, kind, status, finished, created), works: (work_id, stage).
    """
    opened = jobs.where(F.col("status").isin(*OPEN_STATES)).select("work_id")
    aborted = jobs.where((F.col("kind") == kind) & (F.col("status") == "aborted")).join(opened, "work_id", "left_anti")
    stopped = aborted.join(works.where(F.col("stage") == stage).select("work_id"), "work_id", "left_semi")
    return first_per(stopped, ["work_id"], [F.desc_nulls_last("finished"), F.desc("created"), F.asc("job_id")])


def blocking_all(jobs: DataFrame, works: DataFrame, lifts: dict[str, str], kind: str | None = None) -> DataFrame:
    """JON06 for all kinds: the latest aborted job of each work that stands at the stage this job lifts it from.

    ``lifts`` names the stage that each kind of job starts at; works with an open job of any kind are not held up.
    jobs: (job_id, work_id, kind, status, finished, created), works: (work_id, stage).
    """
    starts = F.coalesce(*[F.when(F.col("kind") == k, F.lit(s)) for k, s in lifts.items()])
    aborted = where_all(jobs, F.col("status") == "aborted", None if kind is None else F.col("kind") == kind)
    held = aborted.withColumn("stage", starts).join(works.select("work_id", "stage"), ["work_id", "stage"], "left_semi").drop("stage")
    opened = jobs.where(F.col("status").isin(*OPEN_STATES)).select("work_id")
    order = [F.desc_nulls_last("finished"), F.desc("created"), F.asc("job_id")]
    return first_per(held.join(opened, "work_id", "left_anti"), ["work_id"], order)


def job_listing(jobs: DataFrame, works: DataFrame, lifts: dict[str, str], status: str | None = None, kind: str | None = None, work: int | None = None) -> DataFrame:
    """FLT10: jobs by status, kind and work; what is None does not filter.

    Of aborted jobs only those show that still hold a work up, so that status is no predicate but a semi join; the work's
    own predicate then goes below it.
    """
    own = None if work is None else F.col("work_id") == work
    if status == "aborted":
        held = blocking_all(where_all(jobs, own), works, lifts, kind).select("job_id")
        return where_all(jobs, own).join(held, "job_id", "left_semi")
    return where_all(jobs, own, None if status is None else F.col("status") == status, None if kind is None else F.col("kind") == kind)


def next_jobs(jobs: DataFrame, works: DataFrame, kind: str, n: int, preferred: str) -> DataFrame:
    """TOP07: the next ``n`` jobs of a kind, one a work, none of works that run.

    The order: the job's priority, the work's priority, the preferred series, newest published, oldest created. As many as
    four times ``n`` jobs are looked at, so fewer than ``n`` may be found.
    """
    order = [
        F.desc("priority"), F.desc_nulls_last("work_priority"), F.desc(F.coalesce(F.col("series") == preferred, F.lit(False))),
        F.desc_nulls_last("published"), F.asc("created"), F.asc("job_id"),
    ]
    waiting = jobs.where((F.col("kind") == kind) & (F.col("status") == "waiting")).join(works, "work_id", "left")
    some = waiting.orderBy(*order).limit(4 * n)
    running = jobs.where("status = 'running'").select("work_id")
    return first_per(some, ["work_id"], order).join(running, "work_id", "left_anti").orderBy(*order).limit(n)


def in_given_order(rows: DataFrame, ids: list, id_col: str) -> DataFrame:
    """JON09: the rows of a list of ids with their position in it; ids that have no row are left out."""
    listed = rows.sparkSession.range(1).select(F.posexplode(F.array([F.lit(i) for i in ids])).alias("position", id_col))
    return rows.join(F.broadcast(listed), id_col)  # the list is the caller's own


def neighbours(rows: DataFrame, id_col: str, work_col: str, ordinal_col: str) -> DataFrame:
    """JON11: the ids before and after each row in its work, where the next ordinal has a row."""
    w = Window.partitionBy(work_col).orderBy(ordinal_col)
    at = lambda f, step: F.when(f(ordinal_col).over(w) == F.col(ordinal_col) + step, f(id_col).over(w))
    return rows.withColumns({"previous": at(F.lag, -1), "next": at(F.lead, 1)})


def adopted(found: DataFrame, existing: DataFrame) -> DataFrame:
    """JON12: each found (source_id, extern_id) with the row it belongs to: its source's, else one whose source is gone."""
    e = existing.select(F.col("id"), F.col("extern_id").alias("__x"), F.col("source_id").alias("__s"))
    match = (F.col("extern_id") == F.col("__x")) & (F.col("__s").isNull() | (F.col("__s") == F.col("source_id")))
    order = [F.asc_nulls_last("__s"), F.asc("id")]
    return first_per(found.join(e, match, "left"), ["source_id", "extern_id"], order).drop("__x", "__s")


def usable_tools(servers: DataFrame) -> DataFrame:
    """FLT15: the tools that may be called: those unlocked, with a name, of active servers, in the servers' order.

    servers: (server_id, title, active, created, discovered), where ``discovered`` lists (name, title, active); a tool that
    does not say whether it is unlocked is. Rows are (server_id, tool_id, name, title, created, place).
    """
    tools = servers.where("active").select("server_id", F.col("title").alias("__t"), "created", F.posexplode("discovered").alias("place", "e"))
    open_ = tools.where(F.coalesce("e.active", F.lit(True)) & (F.coalesce("e.name", F.lit("")) != ""))
    shown = F.coalesce(F.nullif("e.title", F.lit("")), "e.name")
    return open_.select(
        "server_id", F.concat("server_id", F.lit(":"), "e.name").alias("tool_id"), function_name(F.concat("__t", F.lit("_"), "e.name")).alias("name"),
        F.concat("__t", F.lit(": "), shown).alias("title"), "created", "place",
    )


def toggleable(blocks: DataFrame, discarded: str = "discarded") -> DataFrame:
    """FLT18: of compared blocks only those whose correction was discarded can be switched; an unknown one can't."""
    return blocks.where(F.coalesce(F.col(discarded), F.lit(False)))
