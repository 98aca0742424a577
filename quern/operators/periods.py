"""Continuous periods and gaps per entity, from run bitmaps.

Days are the exact time unit. A period is discretised into

* *edge words*: a 64-day word that it covers in part, as a bit mask, and
* *fill words*: the words that it covers whole, kept compressed as one bit per
  word in a 64-word shard (4,096 days),

so a period of any length costs a few rows. Masks of one entity and word (or
shard) are united by ``bit_or``, which Spark aggregates on the map side: a hot
entity shuffles at most one row per word and map task. Set runs are then read
off the united masks; what is left per entity is bounded by the calendar, not
by the number of rows, and one window stitches runs across word borders and
takes the clear runs between them as gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WORD = 6  # 2**6 days a word, 2**6 words a shard


def day_bound(text: Column, last: bool) -> Column:
    """Day number (days since 1970-01-01) of a bound written YYYY, YYYY-MM or YYYY-MM-DD.

    A coarse bound means its first day, or its last day with ``last``. Anything
    else, an empty text or a day that does not exist gives null.
    """
    t = F.trim(text)
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
    month_start = F.when(t.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(t, F.lit("-01")), "yyyy-MM-dd"))
    year = F.when(t.rlike(r"^\d{4}$"), F.try_to_date(F.concat(t, F.lit("-12-31" if last else "-01-01")), "yyyy-MM-dd"))
    month = F.last_day(month_start) if last else month_start
    return F.unix_date(F.coalesce(day, month, year)).cast("bigint")


def _mask(lo: Column, hi: Column) -> Column:
    """64-bit mask with the bits ``lo``..``hi`` (0..63) set."""
    ones = F.lit(-1).cast("bigint")
    up = F.call_function("shiftleft", ones, lo.cast("int"))
    down = F.call_function("shiftrightunsigned", ones, (F.lit(63) - hi).cast("int"))
    return up.bitwiseAND(down)


def _runs(mask: Column) -> Column:
    """Array of (lo, hi) for the runs of set bits of a 64-bit mask."""
    bit = lambda i: F.call_function("shiftrightunsigned", mask, i).bitwiseAND(F.lit(1).cast("bigint")) == 1
    every = F.sequence(F.lit(0), F.lit(63))
    starts = F.filter(every, lambda i: bit(i) & ((i == 0) | ~bit(F.greatest(i - 1, F.lit(0)))))
    ends = F.filter(every, lambda i: bit(i) & ((i == 63) | ~bit(F.least(i + 1, F.lit(63)))))
    many = F.arrays_zip(starts.alias("lo"), ends.alias("hi"))
    return F.when(mask == -1, F.array(F.struct(F.lit(0).alias("lo"), F.lit(63).alias("hi")))).otherwise(
        F.transform(many, lambda p: F.struct(p["lo"].alias("lo"), p["hi"].alias("hi")))
    )


def continuous_periods(periods: DataFrame, key: str, start: str = "start_day", end: str = "end_day") -> DataFrame:
    """Periods and gaps of every ``key``: (key, kind, start_day, end_day).

    ``start`` and ``end`` are day numbers, both included. Rows with a null bound
    or a start after the end are dropped; a null key is a key like any other
    and comes out as null. Overlapping, nested, repeated and adjacent periods
    become one ``period``; the days between two periods of a key are a ``gap``.
    An empty input gives an empty result; other columns are ignored.
    """
    p = periods.select(F.col(key).alias("k"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e"))
    p = p.where(F.col("s") <= F.col("e"))
    word = lambda c: F.shiftright(c, _WORD)
    low = lambda c: c.bitwiseAND(F.lit(63).cast("bigint"))
    s, e = F.col("s"), F.col("e")
    sw, ew = word(s), word(e)
    same = sw == ew
    # words covered whole lie strictly between the edge words; the edges keep their own masks
    edges = F.array(
        F.struct(sw.alias("w"), _mask(low(s), F.when(same, low(e)).otherwise(F.lit(63))).alias("m")),
        F.when(~same, F.struct(ew.alias("w"), _mask(F.lit(0), low(e)).alias("m"))),
    )
    edge_words = (
        p.select("k", F.explode(F.filter(edges, lambda x: x.isNotNull())).alias("x"))
        .groupBy("k", F.col("x.w").alias("w"))
        .agg(F.bit_or("x.m").alias("m"))
        .select("k", F.explode(_runs(F.col("m"))).alias("r"), F.col("w"))
        .select("k", (F.shiftleft("w", _WORD) + F.col("r.lo")).alias("s"), (F.shiftleft("w", _WORD) + F.col("r.hi")).alias("e"))
    )
    first, final = sw + 1, ew - 1
    shard = F.explode(F.sequence(word(first), word(final))).alias("h")
    fills = p.where(first <= final).select("k", first.alias("a"), final.alias("b"), shard)
    fill_words = (
        fills.select(
            "k", "h",
            _mask(
                F.when(word(F.col("a")) == F.col("h"), low(F.col("a"))).otherwise(F.lit(0)),
                F.when(word(F.col("b")) == F.col("h"), low(F.col("b"))).otherwise(F.lit(63)),
            ).alias("m"),
        )
        .groupBy("k", "h").agg(F.bit_or("m").alias("m"))
        .select("k", F.explode(_runs(F.col("m"))).alias("r"), "h")
        .select(
            "k",
            F.shiftleft(F.shiftleft("h", _WORD) + F.col("r.lo"), _WORD).alias("s"),
            (F.shiftleft(F.shiftleft("h", _WORD) + F.col("r.hi") + 1, _WORD) - 1).alias("e"),
        )
    )
    runs = edge_words.unionByName(fill_words)
    order = Window.partitionBy("k").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("s") <= F.col("reach") + 1, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = (
        runs.withColumn("reach", reach).withColumn("i", island)
        .groupBy("k", "i").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    )
    before = F.lag("e").over(Window.partitionBy("k").orderBy("i"))
    out = merged.withColumn("b", before).select(
        "k",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("period").alias("kind"), F.col("s").alias("s"), F.col("e").alias("e")),
                    F.when(F.col("b").isNotNull(), F.struct(F.lit("gap").alias("kind"), (F.col("b") + 1).alias("s"), (F.col("s") - 1).alias("e"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("x"),
    )
    return out.select(F.col("k").alias(key), F.col("x.kind").alias("kind"), F.col("x.s").alias(start), F.col("x.e").alias(end))


def fact_periods(facts: DataFrame) -> DataFrame:
    """``continuous_periods`` of facts that state a year, quarter or month.

    Result: (entity_canonical, kind, start_date, end_date), dates as YYYY-MM-DD.
    Facts without both bounds, with bounds that are no dates or with the start
    after the end state no period.
    """
    wanted = facts.where(F.upper(F.trim("granularity")).isin("YEAR", "QUARTER", "MONTH"))
    days = wanted.select(
        "entity_canonical",
        day_bound(F.col("start_date"), last=False).alias("start_day"),
        day_bound(F.col("end_date"), last=True).alias("end_day"),
    )
    text = lambda c: F.date_from_unix_date(F.col(c).cast("int")).cast("string")
    return continuous_periods(days, "entity_canonical").select(
        "entity_canonical", "kind", text("start_day").alias("start_date"), text("end_day").alias("end_date")
    )
