"""Quality rules with verdicts on hosts (DataFrame functions only).

Document rules first: too few words, or too much of the text in word windows that repeat. Rule failures
are then summed by host, each host's failure rate is shrunk towards the corpus by an empirical beta prior,
and hosts whose shrunken rate is too high are rejected as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WHITE_CLASS, cut, let, text_of

MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED_PERCENT = 30
#: A host whose shrunken failure rate is above this is rejected.
MAX_HOST_RATE = 0.6
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """Array of the runs of other characters than ASCII white space."""
    return F.filter(F.split(text, WHITE_CLASS + "+"), lambda w: w != "")


def repeated_words(words_: Column, width: int = WINDOW) -> Column:
    """How many words lie in a window of ``width`` words that the text holds twice or more, first ones included."""

    def hashes(w: Column) -> Column:
        starts = F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    def starts_of_repeated(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def twice(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))

        return F.sort_array(F.transform(let(by_hash, twice), lambda x: x["p"]))

    def covered(h: Column) -> Column:
        return F.aggregate(
            starts_of_repeated(h),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"],
        )

    # most texts repeat nothing, and distinct hashes tell
    nothing = F.lit(0).cast("long")
    return let(
        let(words_, hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), nothing).otherwise(covered(h))
    )


def fails(n_words: Column, n_repeat_words: Column) -> Column:
    """Whether the document rules reject a text of these counts."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words)


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed), one row per input row.

    A null text counts as empty. Counts use the whole text.
    """
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    w = words(text)
    counts = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(host_col).cast("string").alias("host"),
        let(
            w,
            lambda x: F.struct(F.size(x).cast("long").alias("n_words"), repeated_words(x).alias("n_repeat_words")),
        ).alias("w"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "host", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")
    return counts.withColumn("base_failed", fails(F.col("n_words"), F.col("n_repeat_words")))


def host_verdicts(counts: DataFrame, max_rate: float = MAX_HOST_RATE, n_col: str | None = None) -> DataFrame:
    """(host, n_docs, n_failed, host_rate, host_rejected): failure rates by host, shrunk by a beta prior.

    The prior comes from all hosts by the method of moments: mean m of the hosts' rates weighted by their
    documents, variance v between hosts less what binomial noise explains, strength m(1-m)/v - 1 kept within
    1 and 1000. A host's rate is (failed + strength * m) / (documents + strength). A null host is a host of
    its own. ``n_col`` has the number of documents that a row of ``counts`` stands for. The sums take two aggregations; only rows per host reach them.
    """
    one = F.lit(1).cast("long") if n_col is None else F.col(n_col)
    hosts = counts.groupBy("host").agg(
        F.sum(one).alias("n_docs"), F.sum(F.when(F.col("base_failed"), one).otherwise(0)).alias("n_failed")
    )
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    prior = hosts.agg(
        (F.sum(f) / F.sum(n)).alias("m"),
        F.sum(f * f / n).alias("ss"),
        F.sum(n).alias("total"),
        F.count(F.lit(1)).alias("k"),
    )
    between = F.greatest(
        F.lit(0.0),
        F.col("ss") / F.col("total")
        - F.col("m") * F.col("m")
        - F.col("m") * (1 - F.col("m")) * F.col("k") / F.col("total"),
    )
    strength = F.least(
        F.lit(1000.0),
        F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.greatest(between, F.lit(1e-9)) - 1),
    )
    prior = prior.select("m", strength.alias("strength"))
    rate = (f + F.col("strength") * F.col("m")) / (n + F.col("strength"))
    return (
        hosts.join(F.broadcast(prior))  # the prior is one row
        .withColumn("host_rate", rate)
        .select("host", "n_docs", "n_failed", "host_rate", (F.col("host_rate") > max_rate).alias("host_rejected"))
    )


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_rate: float = MAX_HOST_RATE,
) -> DataFrame:
    """``rule_counts`` with ``host_rate`` and ``kept``; one row per input row, also for null ids and repeated rows.

    ``kept`` is false for a document that fails a document rule or whose host is rejected. The counts are
    computed once and kept as a checkpoint; the texts never pass a shuffle. The join with the hosts is left to
    Spark, which broadcasts the hosts only under its size threshold and splits a hot host otherwise.
    An empty table gives an empty result. Other input columns are not carried.
    """
    counts = cut(rule_counts(docs, id_col, text_col, host_col))
    hosts = host_verdicts(counts, max_rate)
    joined = counts.alias("d").join(hosts.alias("h"), F.col("d.host").eqNullSafe(F.col("h.host")), "left")
    return joined.select("d.*", "h.host_rate", (~F.col("d.base_failed") & ~F.col("h.host_rejected")).alias("kept"))


def keep_good(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_rate: float = MAX_HOST_RATE,
) -> DataFrame:
    """The input's rows and columns that ``quality`` keeps, null ids and repeated rows included.

    The document rules are applied again where the texts are read, and only rejected hosts are joined to them, so the
    texts pass no shuffle unless very many hosts are rejected. The rest is as in ``quality``.
    """
    failed = let(words(text_of(text_col)), lambda x: fails(F.size(x), repeated_words(x)))
    ruled = docs.select(F.col(host_col).cast("string").alias("host"), failed.alias("base_failed"))
    passed = cut(ruled.groupBy("host", "base_failed").agg(F.count(F.lit(1)).alias("n")))
    rejected = host_verdicts(passed, max_rate, "n").where("host_rejected").select(F.col("host").alias("__host"))
    same = F.col(host_col).cast("string").eqNullSafe(F.col("__host"))
    return docs.where(~failed).join(rejected, same, "left_anti")
