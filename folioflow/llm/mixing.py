"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

Each source is cut into blocks. With the target weights as whole parts of a total, block i of a source with w
of T parts is released at slot floor(i * T / w) and due before slot ceil((i + 1) * T / w). Of the released blocks, the one
with the earliest deadline gets the next slot. Parts sum to T, so the schedule repeats every T slots: it is worked
out once for T slots, and a block's slot follows from its number alone.

Sources that have no weight of their own share one entry of the schedule, whose blocks go to them in turn; that is Pfair
among equals, and there may be any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let

BLOCK = 16
#: Rows of one source above which its rows are numbered in ranges of ids. Each such source is cut into so many ranges, or
#: twice as many, and so on, until none of the largest source's ranges has more than about FULL rows.
LARGE, RANGES, FULL = 4_000, 1024, 100_000
#: Leading bits of the row's hash by which rows of one id, or of none, are ranges of their own where they would fill one.
SAME_BITS = 10
#: A table with at most so many numbers in it is broadcast; a larger one is left to Spark's joins.
BROADCAST = 1 << 18
#: Leading digits of a hash by which the sources without a weight are numbered in many tasks.
DIGITS = 3


def schedule(entries: DataFrame) -> DataFrame:
    """(entry, parts, total, slots) from (entry, parts): the slots that each entry gets of the ``total`` that repeat.

    Earliest deadline first among released blocks; equal deadlines go to the smaller entry. Entries and their parts are
    the caller's weights, whatever the data, and the one row that this builds has ``total`` numbers.
    """
    one = entries.agg(F.array_sort(F.collect_list(F.struct("entry", "parts"))).alias("every"), F.sum("parts").alias("total"))

    def pick(state: Column, t: Column) -> Column:
        def option(x: Column, i: Column) -> Column:
            done = F.get(state["done"], i)
            released = F.floor(done * F.col("total") / x["parts"])
            due = F.ceil((done + 1) * F.col("total") / x["parts"])
            return F.when(released <= t, F.struct(due.alias("due"), i.alias("i")))

        best = F.array_min(F.transform("every", option))["i"]
        return F.transform(
            F.array(best),
            lambda b: F.struct(
                F.transform(state["done"], lambda n, i: n + (i == b).cast("long")).alias("done"),
                F.concat(state["picks"], F.array(b)).alias("picks"),
            ),
        )[0]

    start = F.struct(
        F.transform("every", lambda x: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("picks")
    )
    slots = F.sequence(F.lit(0).cast("long"), F.col("total") - 1)
    picked = one.where("total > 0").select(
        "every", "total", F.aggregate(slots, start, pick, lambda s: s["picks"]).alias("picks")
    )
    each = picked.select("picks", "total", F.posexplode("every").alias("n", "source"))
    at = F.transform("picks", lambda p, t: F.when(p == F.col("n"), t))
    return each.select("source.entry", "source.parts", "total", F.filter(at, lambda t: t.isNotNull()).alias("slots"))


def _small(rows: DataFrame, numbers: int) -> DataFrame:
    """``rows`` for a join, broadcast if ``numbers``, what they hold at most, are few."""
    return F.broadcast(rows) if numbers <= BROADCAST else rows


def _below(bounds: Column, value: Column, ranges: int) -> Column:
    """How many of the ``ranges`` - 1 sorted bounds, a power of two less one, are less than the value, by bisection."""
    steps = F.array(*[F.lit(ranges >> k) for k in range(1, ranges.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) < value, at + step).otherwise(at))


def _range(bounds: Column, value: Column, row: Column, ranges: int) -> Column:
    """The range of a row, in the order of (value, row): its place among the bounds, and its place among rows of equal value.

    A value that is two bounds fills a range, so its rows are dealt by the leading bits of their hash, behind the smaller
    values of its first range; so are rows of a large source without a value. The rows of other values are one range.
    """
    part = F.shiftright(row, 64 - SAME_BITS) + F.lit(1 + (1 << SAME_BITS - 1))  # from 1, in the order of the signed hash

    def place(at: Column) -> Column:
        fills = (F.get(bounds, at) == value) & (F.get(bounds, at + 1) == value)
        return F.struct(at.alias("at"), F.when(fills, part).otherwise(0).alias("part"))

    none = F.struct(F.lit(-1).alias("at"), part.alias("part"))
    one = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("part"))
    return F.when(bounds.isNull(), one).when(value.isNull(), none).otherwise(let(_below(bounds, value, ranges), place))


def _turns(others: DataFrame) -> DataFrame:
    """(__key, turn): sources without a weight numbered from 0 in order of the hash of their key.

    Keys are counted by the first digits of the hash, so no task numbers all of them.
    """
    hashed = others.select("__key", F.md5("__key").alias("h")).withColumn("d", F.substring("h", 1, DIGITS))
    counts = hashed.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)  # 16 ** DIGITS rows at most
    starts = counts.select("d", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("d").orderBy("h", "__key")) - 1
    return hashed.withColumn("own", own).join(F.broadcast(starts), "d").select("__key", (F.col("start") + F.col("own")).alias("turn"))


def mix_sources(
    docs: DataFrame,
    parts: dict[str | None, int],
    other_parts: int = 1,
    block: int = BLOCK,
    id_col: str = "doc_id",
    source_col: str = "source",
    large: int = LARGE,
    full: int = FULL,
) -> DataFrame:
    """The input's rows and columns with ``block``, ``release``, ``deadline`` and ``slot``; their order by slot is the mix.

    ``parts`` are the target weights, whole numbers of at least 1; all sources that it doesn't list have ``other_parts``
    together, in equal shares. A block is ``block`` documents of one source in order of id, the last may have fewer. Until
    the first source ends, each source has had its weight's share of every number of slots to within less than one block;
    then its slots stay empty and the others keep their ratios. Every row stays, once. A null source is a source of its own (key
    None in ``parts``). Ids are numbers; rows with a null id come first in their source; equal ids are ordered by a hash of
    the row, equal rows anyhow. Input columns of the new names are replaced. An empty table gives an empty result.

    Documents of a source of over ``large`` rows are numbered within ranges of ids that hold about equally many, and counts of
    the ranges are summed up, so a hot source's rows go to as many tasks as it has ranges, however its ids are spread. The number
    of ranges grows with the largest source; rows without an id, and those of an id that fills a range, are dealt by their hash.
    """
    if other_parts < 1 or any(n < 1 for n in parts.values()):
        raise ValueError("weights are whole parts of at least 1")
    names = [c for c in docs.columns if c not in ("block", "release", "deadline", "slot")]
    key = F.when(F.col(source_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    keyed = docs.select(*names, key.alias("__key"))
    sources = cut(keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("n")))
    n_sources, n_large, most = sources.agg(F.count(F.lit(1)), F.count_if(F.col("n") > large), F.max("n")).first()  # three numbers
    ranges = RANGES
    while (most or 0) > ranges * full:
        ranges *= 2
    wide = keyed.join(_small(sources.where(F.col("n") > large).select("__key"), n_large), "__key")
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    bounds = wide.groupBy("__key").agg(F.percentile_approx(id_col, at, F.lit(4 * ranges)).alias("__bounds"))
    hashed = keyed.withColumn("__row", F.xxhash64(*names)).join(_small(cut(bounds), n_large * ranges), "__key", "left")
    ranged = hashed.withColumn("__range", _range(F.col("__bounds"), F.col(id_col), F.col("__row"), ranges)).drop("__bounds")
    counts = ranged.groupBy("__key", "__range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__key", "__range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))

    listed = [(F.lit("" if s is None else f"={s}"), n) for s, n in parts.items()]
    weight = F.coalesce(F.lit(None).cast("long"), *[F.when(F.col("__key") == s, F.lit(n).cast("long")) for s, n in listed])
    weighed = sources.select("__key", weight.alias("parts"))
    turns = _turns(weighed.where("parts is null"))
    rivals = weighed.agg(F.count_if(F.col("parts").isNull()).alias("__rivals"))
    own = F.struct(F.col("parts").isNull().alias("other"), F.when(F.col("parts").isNotNull(), F.col("__key")).alias("key"))
    entries = weighed.select(own.alias("entry"), F.coalesce("parts", F.lit(other_parts)).alias("parts")).distinct()
    table = schedule(entries).withColumnsRenamed({"parts": "__parts", "total": "__total", "slots": "__slots"})
    placed = (
        weighed.join(turns, "__key", "left")
        .withColumn("entry", own)
        .join(F.broadcast(table), "entry")  # an entry for each weight that the caller gives, and one
        .crossJoin(F.broadcast(rivals))  # one row
        .select("__key", F.coalesce("turn", F.lit(0)).alias("__turn"), F.when(F.col("parts").isNull(), F.col("__rivals")).otherwise(1).alias("__of"), "__parts", "__total", "__slots")
    )
    within = Window.partitionBy("__key", "__range").orderBy(id_col, "__row")
    number = F.col("__before") + F.row_number().over(within) - 1
    numbered = ranged.join(before, ["__key", "__range"]).withColumn("block", F.floor(number / block))
    numbered = numbered.join(_small(placed, n_sources * (4 + max([other_parts, *parts.values()]))), "__key")
    turn = numbered.withColumn("__nth", F.col("block") * F.col("__of") + F.col("__turn"))  # among the entry's blocks
    period = F.floor(F.col("__nth") / F.col("__parts"))
    return turn.select(
        *names,
        "block",
        F.floor(F.col("__nth") * F.col("__total") / F.col("__parts")).alias("release"),
        F.ceil((F.col("__nth") + 1) * F.col("__total") / F.col("__parts")).alias("deadline"),
        (period * F.col("__total") + F.get("__slots", (F.col("__nth") % F.col("__parts")).cast("int"))).alias("slot"),
    )
