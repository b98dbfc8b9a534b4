"""Spelling variants: words that differ by one code point, grouped under their most frequent spelling.

Two words within one edit share one of their three rarest bigrams: an edit breaks at most two bigrams of either word, and
those left keep their order, so with one order of all bigrams (rarest in the vocabulary first, then by place in the word) the
first three of both words can't be disjoint. A bigram before the edit stands at the same place in both words, one behind it
at most one place on. The edit also leaves the first or the second half of the word as it is. So words meet on a rare
bigram, its place, their length and one half, and an edit distance verifies each meeting; no pair is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

# The letters, of which only the ASCII capitals have a lower case here.
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_LETTERS = r"[^a-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
#: An edit breaks two bigrams, so three hold one that is whole.
RAREST = 3


def letter_runs(text: Column) -> Column:
    """Array of the maximal runs of letters, ASCII letters in lower case."""
    return F.filter(F.split(F.translate(text, CAPITALS, SMALL), NO_LETTERS), lambda w: w != "")


def word_counts(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): how often each word of the column ``word`` occurs, of those that are long and frequent enough.

    Null words don't count. Counting starts before the shuffle, so a frequent word is one row a task.
    """
    long_enough = words.where(F.length("word") >= least_length)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _bigrams(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.struct(i.alias("p"), F.substring(word, i, F.lit(2)).alias("b")))


def rare_bigrams(words: DataFrame) -> DataFrame:
    """(word, grams): each word's three rarest bigrams as (p: place from 1, b: bigram).

    The letters are 26 and 64, so at most 8,100 counts of bigrams are broadcast, whatever the vocabulary.
    """
    each = words.select("word", F.explode(_bigrams(F.col("word"))).alias("g")).select("word", "g.p", "g.b")
    counts = each.groupBy("b").agg(F.count(F.lit(1)).alias("f"))
    ranked = each.join(F.broadcast(counts), "b").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("f", "b", "p"))).alias("g"))
    return ranked.select("word", F.transform(F.slice("g", 1, RAREST), lambda g: F.struct(g["p"].alias("p"), g["b"].alias("b"))).alias("grams"))


def _meetings(grams: Column, length: Column, places, half: int, text: Column) -> Column:
    """Array of hashed meeting points of a word: bigram, place, length of the shorter word, which half, the half's text."""
    point = lambda g, p: F.xxhash64(g["b"], p, length, F.lit(half), text)
    return F.flatten(F.transform(grams, lambda g: F.transform(places(g["p"]), lambda p: point(g, p))))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): all pairs of words exactly one inserted, deleted or replaced code point apart, in both directions.

    ``words`` has a column ``word`` of distinct words of at least ``LEAST_LENGTH`` letters of this module's alphabet (shorter
    ones have too few bigrams). The join's keys are hashes, which the edit distance makes exact; its skewed keys are split by Spark.
    """
    w, n = F.col("word"), F.length("word")
    here = lambda p: F.array(p)
    both = lambda p: F.array(p, p - 1)
    h, lh = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")  # halves of a word and of itself less a letter
    first, second = F.substring(w, F.lit(1), h), F.substring(w, h + 1, n)
    own = F.concat(_meetings(F.col("grams"), n, here, 0, first), _meetings(F.col("grams"), n, here, 1, second))
    # A word as the longer one: behind the edit its bigrams stand one place further on than in the shorter word.
    whole = lambda p: F.when(p + 1 <= lh, here(p)).otherwise(both(p))
    moved = lambda p: F.when(p >= lh + 2, here(p - 1)).otherwise(both(p))
    longer = F.concat(
        _meetings(F.col("grams"), n - 1, whole, 0, F.substring(w, F.lit(1), lh)),
        _meetings(F.col("grams"), n - 1, moved, 1, F.substring(w, lh + 2, n)),
    )
    grams = rare_bigrams(words)
    left = grams.select("word", F.explode(F.array_distinct(own)).alias("k"))
    sides = F.array(F.struct(F.lit(False).alias("longer"), own.alias("ks")), F.struct(F.lit(True).alias("longer"), longer.alias("ks")))
    right = grams.select(F.col("word").alias("near"), F.explode(sides).alias("s"))
    right = right.select("near", "s.longer", F.explode(F.array_distinct("s.ks")).alias("k"))
    close = (F.col("longer") | (F.col("word") < F.col("near"))) & (F.levenshtein("word", "near", 1) == 1)
    pairs = left.join(right, (left["k"] == right["k"]) & close).select("word", "near").distinct()
    ways = F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near")))
    return pairs.select(F.explode(ways).alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the links (word, form) from word to word end.

    A form is at least ``FACTOR`` times as frequent as its word, so links have no cycles and at most 27 follow each other
    among 64-bit counts; each round doubles the way that a link goes, until none goes on.
    """
    links = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")))
        links = moved.select("word", "root")
        if moved.where("on").isEmpty():
            return links


def group_spellings(counts: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of ``counts`` (word, n).

    The form is the near word of largest n (the first in code-point order among equals) if that n is at least ``factor``
    times the word's own, else null; the root is where forms end, the word itself where it has none. ``n_near`` counts all
    near words. An empty table gives an empty one; other columns are not carried. The vocabulary is kept as a checkpoint.
    """
    counts = cut(counts.select("word", "n"))
    known = counts.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    # Of equally frequent words the first in code-point order: min() of the negated count, then of the word.
    best = near_words(counts).join(known, "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = counts.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.less")).alias("most"), F.col("best.near").alias("near")
    )
    much = F.col("most") >= factor * F.col("n")
    formed = cut(joined.select("word", "n", "n_near", F.when(much, F.col("near")).alias("form"), F.when(much, F.col("most")).alias("form_n")))
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def planted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199) -> DataFrame:
    """(word): each letter run of each text, one letter less where ``every`` divides the CRC of ``<id>:<run>``.

    Texts are taken whole; a null text has no runs, and a row with a null id loses no letter. Repeated rows count each.
    """
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(letter_runs(text_of(text_col))).alias("run"))
    coded = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"), F.col("id").isNotNull().alias("known"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return coded.select(F.when(F.col("known") & (F.col("h") % every == 0), short).otherwise(F.col("run")).alias("word"))


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``group_spellings`` of the words of all texts, with letters lost as ``planted_words`` says."""
    return group_spellings(word_counts(planted_words(docs, id_col, text_col)))
