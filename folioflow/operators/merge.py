"""Merges of tables: each gives the new state of a table as a DataFrame, to be written as a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .listing import OPEN_STATES, VIDEO_STAGES, first_per, stage_index


def upsert(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], pinned_col: str = "pinned", lists: tuple[str, ...] = ()) -> DataFrame:
    """MRG01: the merged rows with ``action`` new, updated, unchanged or kept (not in ``new``).

    A field of ``new`` replaces the old one unless the row pins it; a field of ``lists`` only if it has items. ``old`` has
    keys, fields and the pinned fields' names.
    """
    o = old.select(*keys, pinned_col, *[F.col(f).alias(f"__o_{f}") for f in fields], F.lit(True).alias("__old"))
    n = new.select(*keys, *fields, F.lit(True).alias("__new"))
    both = o.join(n, keys, "full")
    is_old, is_new = F.col("__old").isNotNull(), F.col("__new").isNotNull()

    def value(f: str) -> Column:
        stays = F.array_contains(pinned_col, f) | ~is_new
        if f in lists:
            stays = stays | (F.coalesce(F.size(f), F.lit(0)) <= 0)
        return F.when(is_old & F.coalesce(stays, F.lit(False)), F.col(f"__o_{f}")).otherwise(F.col(f))

    merged = both.select(*keys, pinned_col, *[value(f).alias(f"__m_{f}") for f in fields], *[f"__o_{f}" for f in fields], is_old.alias("__was"), is_new.alias("__is"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"__m_{f}").eqNullSafe(F.col(f"__o_{f}"))
    action = F.when(~F.col("__was"), "new").when(~F.col("__is"), "kept").when(same, "unchanged").otherwise("updated")
    none = F.array().cast("array<string>")
    return merged.select(*keys, F.coalesce(pinned_col, none).alias(pinned_col), *[F.col(f"__m_{f}").alias(f) for f in fields], action.alias("action"))


def select_by_rule(selected: Column, manual: Column, rule: Column) -> Column:
    """MRG02-MRG04: the rule decides unless the user has."""
    return F.when(manual, selected).otherwise(rule)


def apply_rule(works: DataFrame, rule: Column, observed: Observation) -> DataFrame:
    """MRG03: works (work_id, selected, manual, ...) after the rule, with ``action`` manual, unchanged, added or removed.

    ``observed`` gets the counters checked, added, removed and unchanged of the same pass, once the rows have been computed.
    """
    new = select_by_rule(F.col("selected"), F.col("manual"), rule)
    action = F.when(F.col("manual"), "manual").when(F.col("selected") == new, "unchanged").when(new, "added").otherwise("removed")
    marked = works.withColumns({"action": action, "selected": new})
    counters = [F.count_if(F.col("action") == a).alias(a) for a in ("added", "removed", "unchanged")]
    return marked.observe(observed, F.count_if(~F.col("manual")).alias("checked"), *counters)


def select_batch(works: DataFrame, asked: DataFrame, selected: bool, observed: Observation) -> DataFrame:
    """MRG04: works after the user has selected or dropped those ``asked`` for (work_id), which are manual from then on.

    ``observed`` gets asked, changed, unchanged and not_found of the same pass. Ids that are asked for twice count once.
    """
    both = works.withColumn("__w", F.lit(True)).join(asked.select("work_id").distinct().withColumn("__a", F.lit(True)), "work_id", "full")
    wanted, known = F.col("__a").isNotNull(), F.col("__w").isNotNull()
    action = F.when(~wanted, "kept").when(~known, "not_found").when(F.col("selected") == selected, "unchanged").when(F.lit(selected), "added").otherwise("removed")
    counters = [F.count_if(wanted).alias("asked"), F.count_if(F.col("action").isin("added", "removed")).alias("changed")]
    counters += [F.count_if(F.col("action") == a).alias(a) for a in ("unchanged", "not_found")]
    counted = both.withColumn("action", action).observe(observed, *counters)
    taken = wanted & known
    chosen = {"selected": F.when(taken, F.lit(selected)).otherwise(F.col("selected")), "manual": F.col("manual") | taken}
    return counted.where(known).withColumns(chosen).drop("__w", "__a")


def jobs_after_selection(jobs: DataFrame, works: DataFrame, automatic: bool, observed: Observation) -> DataFrame:
    """MRG03, MRG04: jobs (work_id, kind, status, error) after works (work_id, stage, action) were added or removed.

    Waiting jobs of removed works are aborted; works added get the job that follows their stage, if jobs are made
    ``automatic``-ally and they have none open of that kind. ``observed`` gets created and aborted.
    """
    changed = works.where(F.col("action").isin("added", "removed")).select("work_id", "stage", "action")
    removed = changed.where("action = 'removed'").select("work_id", F.lit(True).alias("__r"))
    stopped = F.coalesce("__r", F.lit(False)) & (F.col("status") == "waiting")
    old = jobs.join(removed, "work_id", "left").withColumn("__s", stopped)
    after = {"status": F.when(F.col("__s"), "aborted").otherwise(F.col("status")), "error": F.when(F.col("__s"), "no longer selected").otherwise(F.col("error"))}
    old = old.withColumns(after).withColumn("__new", F.lit(False)).drop("__r")
    wanted = changed.where("action = 'added'").select("work_id", next_job(F.col("stage")).alias("kind")).where(F.col("kind").isNotNull() & F.lit(automatic))
    new = missing_jobs(wanted, jobs).withColumns({"status": F.lit("waiting"), "error": F.lit(None).cast("string"), "__s": F.lit(False), "__new": F.lit(True)})
    every = old.unionByName(new, allowMissingColumns=True)
    return every.observe(observed, F.count_if("__new").alias("created"), F.count_if("__s").alias("aborted")).drop("__s", "__new")


def replace_children(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """MRG05, MRG07: the children of every parent that ``new`` has are replaced by its rows; of vectors the parent is (chunk, family)."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def flip_versions(old: DataFrame, new: DataFrame, key: str, current: str = "current") -> DataFrame:
    """MRG06: ``new`` rows are their parents' current versions, all older ones no longer."""
    flagged = new.select(key, F.lit(True).alias("__n")).distinct()
    kept = old.join(flagged, key, "left").withColumn(current, F.col(current) & F.col("__n").isNull()).drop("__n")
    return kept.unionByName(new.withColumn(current, F.lit(True)))


def drop_versions(versions: DataFrame, gone: DataFrame, key: str, id_col: str, order: list[Column], current: str = "current") -> DataFrame:
    """MRG12: versions without those ``gone``; the newest left is current if the current one went. A parent's last version stays."""
    marked = versions.join(gone.select(id_col, F.lit(True).alias("__g")), id_col, "left")
    w = Window.partitionBy(key)
    all_gone = F.count(F.lit(1)).over(w) == F.count("__g").over(w)
    newest = F.row_number().over(w.orderBy(*order)) == 1
    kept = marked.withColumn("__last", all_gone & newest).where("__g is null or __last")
    has_current = F.max(F.col(current).cast("int")).over(w) == 1
    first = F.row_number().over(w.orderBy(*order)) == 1
    return kept.withColumn(current, F.when(has_current, F.col(current)).otherwise(first)).drop("__g", "__last")


def remap(rows: DataFrame, ids: DataFrame, column: str, soft: bool = False) -> DataFrame:
    """MRG08: a reference translated by (old_id, new_id); a dangling one becomes null if soft, else the row goes."""
    names = rows.columns
    m = ids.select(F.col("old_id").alias(column), F.col("new_id").alias("__new"))
    return rows.join(m, column, "left" if soft else "inner").withColumn(column, F.col("__new")).select(*names)


def dangling(rows: DataFrame, parents: DataFrame, column: str, parent_id: str) -> DataFrame:
    """MRG08: the rows whose reference has no parent; an import with any is refused."""
    return rows.where(F.col(column).isNotNull()).join(parents.select(F.col(parent_id).alias(column)), column, "left_anti")


def stage_after_import(existing: Column, transcripts: Column, corrections: Column, chunks: Column, embedded: Column) -> Column:
    """MRG09: a video's stage from what it has; an existing stage stands if that has brought nothing beyond it."""
    found = (
        F.when((chunks > 0) & (embedded >= chunks), "embedded").when(chunks > 0, "chunked").when(corrections > 0, "corrected")
        .when(transcripts > 0, "transcribed").otherwise("discovered")
    )
    higher = F.greatest(stage_index(found), stage_index(existing))
    by_index = F.get(F.array([F.lit(s) for s in VIDEO_STAGES]), higher.cast("int"))
    return F.when(existing.isNull() | (chunks > 0), found).otherwise(by_index)


def document_stage(chunks: Column, embedded: Column) -> Column:
    """MRG09 for documents."""
    return F.when(chunks == 0, "imported").when(embedded < chunks, "chunked").otherwise("embedded")


def check_manifest(manifest: DataFrame, form: str, version: int, dimension: int) -> DataFrame:
    """MRG10: one row with ``error``, null if the package can be read."""
    return manifest.withColumn(
        "error",
        F.when(F.col("format") != form, "not such a package").when(F.col("version") > version, "made by a newer version")
        .when(F.col("dimension") != dimension, "vectors of another dimension"),
    )


def reset(children: DataFrame, works: DataFrame, stage: str, made_at: str, work_col: str = "work_id") -> DataFrame:
    """MRG11: children without those that works reset to ``stage`` have beyond it; ``made_at`` is the stage that makes them."""
    beyond = VIDEO_STAGES.index(made_at) > VIDEO_STAGES.index(stage)
    return children.join(works.select(work_col).distinct(), work_col, "left_anti") if beyond else children


def missing_jobs(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """MRG13: the wanted (work_id, kind) that no open job has."""
    opened = jobs.where(F.col("status").isin(*OPEN_STATES)).select("work_id", "kind")
    return wanted.join(opened, ["work_id", "kind"], "left_anti")


#: The job that follows each stage.
NEXT_JOB = {"discovered": "audio", "audio": "transcription", "transcribed": "correction", "corrected": "chunking", "chunked": "embedding"}


def next_job(stage: Column) -> Column:
    """MRG14, MRG19: the kind of job that lifts a work from its stage; null at the last."""
    return F.coalesce(*[F.when(stage == s, j) for s, j in NEXT_JOB.items()], F.lit(None).cast("string"))


def raised(stage: Column, reached: Column) -> Column:
    """MRG15: a stage only rises."""
    return F.when(F.coalesce(stage_index(reached) > stage_index(stage), F.lit(False)), reached).otherwise(stage)


def after_failure(attempts: Column, retries: Column) -> Column:
    """MRG16."""
    return F.when(attempts <= retries, "waiting").otherwise("error")


def add_missing(defaults: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """MRG18: stored rows, and the defaults of keys that have none."""
    return stored.unionByName(defaults.join(stored.select(key), key, "left_anti"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """STM08 as a batch: each key's latest row."""
    return first_per(rows, keys, order)


def recover(jobs: DataFrame) -> DataFrame:
    """STM05: jobs that ran when the service stopped, or were aborted by its end, wait again."""
    lost = (F.col("status") == "running") | ((F.col("status") == "aborted") & (F.col("reason") == "restart"))
    return jobs.withColumn("status", F.when(F.coalesce(lost, F.lit(False)), "waiting").otherwise(F.col("status")))


def source_of_chunks(works: DataFrame, corrections: DataFrame, transcripts: DataFrame, work_col: str = "work_id") -> DataFrame:
    """SEQ15: what each work is cut into chunks from: (work, kind, source_id, paragraphs).

    The latest current correction (id, current, created, paragraphs) that has paragraphs, else the latest current transcript
    with its segments as paragraphs; kind and the rest are null where there is neither. Equal times go to the greater id.
    """

    def latest(rows: DataFrame, kind: str) -> DataFrame:
        last = F.max(F.struct("created", "id", "paragraphs"))
        return rows.where("current").groupBy(work_col).agg(last.alias(kind))

    both = works.select(work_col).join(latest(corrections, "correction"), work_col, "left").join(latest(transcripts, "transcript"), work_col, "left")
    corrected = F.coalesce(F.size("correction.paragraphs") > 0, F.lit(False))
    found = F.when(corrected, F.col("correction")).otherwise(F.col("transcript"))
    kind = F.when(corrected, "correction").when(F.col("transcript").isNotNull(), "transcript")
    return both.select(work_col, kind.alias("kind"), found["id"].alias("source_id"), found["paragraphs"].alias("paragraphs"))


def answers(messages: DataFrame, hits: DataFrame, limit: int = 100) -> DataFrame:
    """SNK09: answers (message_id, text, ...) with their hits (message_id, rank, chunk_id, score) nested in order, and their parameters as JSON.

    An answer shows ``limit`` hits at most, the bound of what a question asks for; one without hits has an empty list.
    """
    top = hits.where(F.col("rank") <= limit).groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("hits"))
    joined = messages.join(top, "message_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<rank:int,chunk_id:bigint,score:double>>")))
    ids = F.transform("hits", lambda h: h["chunk_id"])
    return joined.withColumn("parameters", F.to_json(F.struct(ids.alias("chunk_ids"), F.size("hits").alias("n"))))


# Ways to get at a work's sound.
WAYS = ("stream", "source", "file")


def acquired(audio: DataFrame, made: DataFrame, fields: list[str]) -> DataFrame:
    """SRC28: the rows of works' sound after some were made: replaced or added by work, fields of ``made`` first.

    Both have work_id, the fields and ``way``. A null way keeps the old row's; one that is not of ``WAYS`` is an error.
    """
    known = F.when(F.col("way").isNull() | F.col("way").isin(*WAYS), F.col("way")).otherwise(F.raise_error(F.concat(F.lit("unknown way "), "way")).cast("string"))
    new = made.select("work_id", *[F.col(f).alias(f"__n_{f}") for f in fields], known.alias("__way"), F.lit(True).alias("__new"))
    both = audio.join(new, "work_id", "full")
    is_new = F.col("__new").isNotNull()
    values = {f: F.when(is_new, F.col(f"__n_{f}")).otherwise(F.col(f)) for f in fields}
    return both.withColumns(values | {"way": F.coalesce("__way", "way")}).select("work_id", *fields, "way")
