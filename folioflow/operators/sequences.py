"""Folds over the ordered parts of one work: segments, blocks, sentences, overlapping chunks, runs of neighbours.

A work's parts are an ordered array in its row, so folds run in the row without a shuffle; only operators over
tables of chunks use windows by work. Texts are handled by Spark's functions; where a step depends on all steps before it,
the numbers alone go through one of ``folds``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, strip
from ..shared import cut
from . import folds
from .splitter import ABBREVIATIONS, CLOSERS, split_texts

# Phrases that a transcription makes up in silence.
STOCK_PHRASES = (
    "Untertitel von", "Untertitelung", "Vielen Dank fürs Zuschauen", "Vielen Dank für's Zuschauen", "Danke fürs Zuschauen",
    "Copyright", "www.", "http", "Abonniere", "♪",
)
STOCK_LENGTH, LEAST_DISTINCT = 50, 0.3


def settled(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that the optimizer does not repeat inside the expressions that use it."""
    return rows.withColumn(name, F.explode(F.array(value)))


RUNS = "array<struct<first:int,last:int>>"


def is_made_up(text: Column, previous: Column) -> Column:
    """SEQ01: empty, equal to the segment kept before, much the same few words, or a stock phrase."""
    return made_up_by_itself(text) | F.coalesce(text == previous, F.lit(False))


def made_up_by_itself(text: Column) -> Column:
    """SEQ01 without a look at other segments."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    few = (F.size(words) > 3) & (F.size(F.array_distinct(F.transform(words, F.lower))) / F.size(words) < LEAST_DISTINCT)
    stock = (F.length(text) < STOCK_LENGTH) & F.exists(F.array([F.lit(p) for p in STOCK_PHRASES]), lambda p: F.contains(text, p))
    return (text == "") | few | stock


def drop_made_up(segments: Column) -> Column:
    """SEQ01: segments (start, end, text, ...) without those made up; each is held against the last one kept.

    Of those not made up by themselves the last one kept always has the text of the one before, kept or not.
    """
    own = F.filter(F.transform(segments, lambda s: s.withField("text", strip(s["text"]))), lambda s: ~made_up_by_itself(s["text"]))
    return let(own, lambda k: F.filter(k, lambda s, i: (i == 0) | (s["text"] != F.get(k, i - 1)["text"])))


def merge_segments(segments: Column, least_s: float = 6.0, most_s: float = 15.0, pause_s: float = 0.3, words: bool = False) -> Column:
    """SEQ02: segments merged to blocks; one closes at ``most_s``, or at ``least_s`` before a pause.

    With ``words``, the segments' arrays of that name are joined too.
    """
    at = lambda name: F.transform(segments, lambda s: s[name].cast("double"))
    runs = folds.fold(folds.blocks(least_s, most_s, pause_s), RUNS, at("start"), at("end"))

    def block(r: Column) -> Column:
        inside = F.slice(segments, r["first"] + 1, r["last"] - r["first"] + 1)
        more = F.trim(F.array_join(F.transform(inside, lambda s: s["text"]), " "))
        fields = [
            F.get(segments, r["first"])["start"].alias("start"),
            F.get(segments, r["last"])["end"].alias("end"),
            F.when(r["first"] == r["last"], F.get(segments, r["first"])["text"]).otherwise(more).alias("text"),
        ]
        return F.struct(*fields, *([F.flatten(F.transform(inside, lambda s: s["words"])).alias("words")] if words else []))

    return F.transform(runs, block)


def pack(sizes: Column, most: int, glue: int = 0) -> Column:
    """SEQ03, SNK06: the group number of each size: groups in order of at most ``most`` in sum, a larger one by itself.

    ``glue`` is added for each item but a group's first.
    """
    return folds.fold(folds.group_numbers(most, glue), "array<int>", sizes)


def paragraphs_of_segments(texts: Column, most: int) -> Column:
    """SEQ04: the paragraph number of each segment; one ends with a sentence, or at ``most`` characters."""
    ends = F.transform(texts, lambda t: F.rlike(t, F.lit(rf"[.!?…][{CLOSERS}]*$")))
    return folds.fold(folds.paragraph_numbers(most), "array<int>", F.transform(texts, F.length), ends)


def sentences(text: Column) -> Column:
    """SEQ05: whole sentences of a German text; abbreviations, initials and ordinals of two digits end none."""
    return F.flatten(split_texts(F.array(text)))


def break_at_blanks(text: Column, most: int) -> Column:
    """SEQ06: parts of at most ``most`` characters, cut at blanks; a longer word stays whole."""
    if most < 1:
        raise ValueError("parts have at least one character")
    own = strip(text)
    longest = rf"(?s)[^ ].{{0,{most - 1}}}(?= |\z)|[^ ]+"  # as many words as fit, else one word
    cut = F.regexp_extract_all(F.regexp_replace(own, " +", " "), F.lit(longest), 0)
    return F.when(F.length(own) <= most, F.filter(F.array(own), lambda t: t != "")).otherwise(cut)


def sentences_of(paragraphs: Column, most: int) -> Column:
    """SEQ07: the sentences of paragraphs (text, start, end), each with its paragraph's number, start and end.

    Sentences of over ``most`` characters are broken at blanks.
    """
    split = split_texts(F.transform(paragraphs, lambda p: p["text"]), most)

    def placed(x: Column, n: Column) -> Column:
        p = x["p"]  # zipped, so that ``paragraphs`` is not computed again for each sentence
        return F.transform(x["own"], lambda t: F.struct(t.alias("text"), n.alias("paragraph"), p["start"].alias("start"), p["end"].alias("end")))

    zipped = F.arrays_zip(split.alias("own"), F.coalesce(paragraphs, F.array()).alias("p"))
    return F.flatten(F.transform(zipped, placed))


def chunks(parts: DataFrame, sentence_col: str, target: int = 3000, overlap: int = 400) -> DataFrame:
    """SEQ08-SEQ11: rows with ``chunks``, overlapping runs of whole sentences of about ``target`` characters.

    ``sentence_col`` is ``sentences_of``'s array. A chunk begins with the end of the last one: the longest run of its
    new sentences, the first of them excluded, that fits into ``overlap`` characters. It has one new sentence at least and
    closes before the one that would lift it over ``target``. Sentences of a paragraph are joined by a blank, paragraphs by a blank line.
    Each chunk is (ordinal from 1, text, start, end, chars, overlap_before, overlap_after).
    """
    if target < 1 or overlap < 0:
        raise ValueError("a chunk has at least one character, an overlap none or more")
    rows = settled(parts, "__s", F.col(sentence_col))
    kind = "array<struct<first:int,last:int,overlap_before:int,overlap_after:int,chars:int,text:string>>"
    runs = folds.fold(folds.overlapping_texts(target, overlap), kind, F.transform("__s", lambda x: x["text"]), F.transform("__s", lambda x: x["paragraph"]))
    times = settled(rows, "__t", F.transform("__s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    rows = settled(times, "__runs", runs)

    def chunk(r: Column, i: Column) -> Column:
        inside = F.slice("__t", r["first"] + 1, r["last"] - r["first"] + 1)
        return F.struct(
            (i + 1).alias("ordinal"),
            r["text"].alias("text"),
            F.array_min(F.transform(inside, lambda x: x["start"])).alias("start"),
            F.array_max(F.transform(inside, lambda x: x["end"])).alias("end"),
            r["chars"].alias("chars"),
            r["overlap_before"].alias("overlap_before"),
            r["overlap_after"].alias("overlap_after"),
        )

    return rows.withColumn("chunks", F.transform("__runs", chunk)).drop("__s", "__t", "__runs")


def placed_paragraphs(text: Column, title: Column, start: Column) -> Column:
    """SEQ13: a section's title and paragraphs (text, start, end) with character places, two between paragraphs."""
    parts = F.transform(F.filter(F.concat(F.array(title), F.split(text, "\n\n")), lambda p: strip(p) != ""), strip)
    ends = folds.fold(folds.running_ends(2), "array<long>", F.transform(parts, F.length))

    def placed(p: Column, end: Column) -> Column:
        upto = start.cast("double") + end
        return F.struct(p.alias("text"), (upto - F.length(p)).alias("start"), upto.alias("end"))

    return F.zip_with(parts, ends, placed)


def chapters(sections: DataFrame, doc_col: str = "doc_id", ordinal_col: str = "ordinal", level_col: str = "level") -> DataFrame:
    """SEQ12: each section's chapter number; a first-level section opens one, deeper ones before any are a chapter too."""
    w = Window.partitionBy(doc_col).orderBy(ordinal_col)
    opens = (F.col(level_col) <= 1) | (F.row_number().over(w) == 1)
    return sections.withColumn("__o", opens.cast("int")).withColumn("chapter", F.sum("__o").over(w)).drop("__o")


def clean_sections(sections: Column, least: int = 20) -> Column:
    """SEQ25: sections (level, title, text), a column that is settled, without short ones, but for a title that a deeper one follows.

    Short ones are dropped in rounds until a round drops none, since a title may lose what followed it.
    """
    part = lambda of: F.transform(sections, of)
    kept = folds.fold(
        folds.kept_sections, "array<boolean>", part(lambda s: s["level"]),
        part(lambda s: F.coalesce(s["title"], F.lit("")) != ""), part(lambda s: F.coalesce(F.length(s["text"]), F.lit(0)) >= least),
    )
    rest = F.filter(F.zip_with(sections, kept, lambda s, k: F.struct(s.alias("s"), k.alias("k"))), lambda x: x["k"])
    return F.transform(rest, lambda x: F.struct(x["s"]["level"].alias("level"), x["s"]["title"].alias("title"), x["s"]["text"].alias("text")))


def neighbour_keys(anchors: DataFrame, n: int, work_col: str = "work_id", ordinal_col: str = "ordinal") -> DataFrame:
    """SEQ16: the (work, ordinal) around the anchors that are none themselves."""
    o = F.col(ordinal_col)
    around = anchors.select(work_col, F.explode(F.sequence(F.greatest(o - n, F.lit(0)), o + n)).alias(ordinal_col)).distinct()
    return around.join(anchors.select(work_col, ordinal_col), [work_col, ordinal_col], "left_anti")


def stitch(anchors: DataFrame, near: DataFrame) -> DataFrame:
    """SEQ17-SEQ19: passages from anchors (with ``rank`` and ``score``) and their neighbours, in the anchors' order.

    Both have (chunk_id, work_id, ordinal, text, overlap_before). Runs without a gap are one passage, which takes the chunk and
    rank of its anchor of best score; the overlap with the chunk before is cut from each follower.
    """
    names = ["chunk_id", "work_id", "ordinal", "text", "overlap_before"]
    every = anchors.select(*names, "score", "rank").unionByName(near.select(*names), allowMissingColumns=True)
    own = Window.partitionBy("work_id", "ordinal").orderBy(F.asc_nulls_last("rank"))
    one = every.withColumn("__n", F.row_number().over(own)).where("__n = 1")
    island = F.col("ordinal") - F.row_number().over(Window.partitionBy("work_id").orderBy("ordinal"))
    runs = one.withColumn("island", island).groupBy("work_id", "island").agg(
        F.max_by(
            F.struct("chunk_id", "rank", "score"),
            F.when(F.col("rank").isNotNull(), F.struct("score", (-F.col("ordinal")).alias("o"))),
        ).alias("best"),
        F.sort_array(F.collect_list(F.struct("ordinal", "text", "overlap_before"))).alias("parts"),
    )
    texts = F.transform(
        "parts",
        lambda p, i: strip(F.when(i == 0, p["text"]).otherwise(F.substring(p["text"], F.greatest(p["overlap_before"], F.lit(0)) + 1, F.length(p["text"])))),
    )
    return runs.where("best.rank is not null").select(
        "best.chunk_id", "work_id", "best.rank", "best.score",
        F.get("parts", F.lit(0))["ordinal"].alias("first"),
        F.element_at("parts", -1)["ordinal"].alias("last"),
        F.array_join(F.filter(texts, lambda t: t != ""), " ").alias("text"),
    )


def share_out(paragraphs: Column, start: Column, end: Column) -> Column:
    """SEQ20: paragraphs with the block's window shared out by characters; the last ends with the block."""
    ends = folds.fold(folds.running_ends(0), "array<long>", F.transform(paragraphs, F.length))

    def shared(e: Column) -> Column:
        total = F.greatest(F.try_element_at(e, F.lit(-1)), F.lit(1))
        at = lambda i: start + (end - start) * (F.get(e, i) / total)
        return F.transform(
            paragraphs,
            lambda p, i: F.struct(
                p.alias("text"), F.when(i == 0, start).otherwise(at(i - 1)).alias("start"),
                F.when(i == F.size(e) - 1, end).otherwise(at(i)).alias("end"),
            ),
        )

    return let(ends, shared)


def repair_topics(topics: Column, start: Column, end: Column) -> Column:
    """SEQ21: topics (title, start, end) clamped, in order of start, each ending where the next begins, none missing at the ends."""
    clamp = lambda x, low: F.least(F.greatest(x, low), end)
    clamped = F.transform(
        F.filter(topics, lambda t: strip(t["title"]) != ""),
        lambda t, i: F.struct(clamp(t["start"], start).alias("start"), i.alias("i"), t["title"].alias("title")),
    )

    def next_to_each_other(s: Column) -> Column:
        return F.transform(
            s,
            lambda t, i: F.struct(
                t["title"].alias("title"),
                F.when(i == 0, start).otherwise(t["start"]).alias("start"),
                F.when(i == F.size(s) - 1, end).otherwise(F.greatest(t["start"], F.get(s, i + 1)["start"])).alias("end"),
            ),
        )

    return let(F.array_sort(clamped), next_to_each_other)


def split_chunk(text: Column, position: Column, start: Column, end: Column) -> Column:
    """SEQ22: struct(left, right, boundary): cut at the first white space from ``position`` on; null if a part is empty."""
    ahead = F.regexp_instr(F.substring(text, position + 1, F.length(text)), F.lit(r"(?U)\s"))
    cut = F.when((position <= 0) | (ahead == 0), F.when(position <= 0, F.lit(0)).otherwise(F.length(text))).otherwise(position + ahead - 1)
    left, right = strip(F.substring(text, F.lit(1), cut)), strip(F.substring(text, cut + 1, F.length(text)))
    boundary = start + F.greatest(end - start, F.lit(0.0)) * F.length(left) / F.greatest(F.length(text), F.lit(1))
    return F.when((left != "") & (right != ""), F.struct(left.alias("left"), right.alias("right"), boundary.alias("boundary")))


def join_chunks(text: Column, following: Column, overlap: Column) -> Column:
    """SEQ23: a chunk with its successor less the overlap, if the successor is longer than that."""
    rest = F.when((overlap > 0) & (F.length(following) > overlap), F.ltrim(F.substring(following, overlap + 1, F.length(following)))).otherwise(following)
    return strip(F.concat(F.rtrim(text), F.lit(" "), rest))


def numbered(rows: DataFrame, work_col: str, id_col: str, to: str = "ordinal") -> DataFrame:
    """(work_col, id_col, to): each id's number in its work, from 1, in the order of ids, however large a work is.

    Ids alone are dealt to ranges of (work, id) and numbered within them; the counts of a work's ranges before are added.
    Both windows are over a range's rows or over ranges, so no task sees a whole work, and texts are joined afterwards.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select(work_col, id_col).repartitionByRange(n, work_col, id_col)
    placed = cut(ranged.withColumn("__r", F.spark_partition_id()))  # ranges come from a sample, so they are settled once
    before = Window.partitionBy(work_col).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(work_col, "__r").agg(F.count(F.lit(1)).alias("__c"))
    offsets = counts.select(F.col(work_col).alias("__w"), F.col("__r").alias("__q"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    own = F.row_number().over(Window.partitionBy(work_col, "__r").orderBy(id_col))
    local = placed.withColumn("__n", own)
    joined = local.join(offsets, F.col(work_col).eqNullSafe(F.col("__w")) & (F.col("__r") == F.col("__q")))
    return joined.select(work_col, id_col, (F.col("__n") + F.col("__o")).alias(to))


def renumber(rows: DataFrame, work_col: str, order: list[str], to: str = "ordinal") -> DataFrame:
    """SEQ24: 1 to n within each work."""
    return rows.withColumn(to, F.row_number().over(Window.partitionBy(work_col).orderBy(*order)))


def batches(rows: DataFrame, key_col: str, order: list[str], size: int, instances: int) -> DataFrame:
    """SEQ26: batch number and instance of each row, batches of ``size`` in order going round the instances."""
    n = F.row_number().over(Window.partitionBy(key_col).orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(n / size)).withColumn("instance", F.pmod("batch", F.lit(instances)))


def unique_names(rows: DataFrame, name_col: str, order: list[str]) -> DataFrame:
    """SEQ27: the second and later rows of a name get ``_2``, ``_3``, ..."""
    n = F.row_number().over(Window.partitionBy(name_col).orderBy(*order))
    return rows.withColumn("unique_name", F.when(n == 1, F.col(name_col)).otherwise(F.concat(F.col(name_col), F.lit("_"), n.cast("string"))))
