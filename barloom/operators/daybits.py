"""Sets of days as bitmaps over a numbered calendar: a row (code, word, bits) holds 64 days of a code.

Thirty years of open days are 118 words, about 1 KB a code. Days are numbered by their place in the calendar, so a life span
is a mask, a union is `bit_or` (combined map-side), a difference is and-not, a count is `bit_count`, and neighbours in the
calendar are neighbouring bits. What a code should have and what it has meet in one aggregate by (code, word); only bits of
the difference are ever unpacked.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A calendar may have this many days.
_MOST_DAYS = 1 << 16


@dataclass(frozen=True)
class Calendar:
    """The distinct days in order, as one array that every use in a plan shares."""

    spark: SparkSession
    days: Column

    @staticmethod
    def of(opens: DataFrame, day: str) -> Calendar:
        return Calendar(opens.sparkSession, opens.agg(F.sort_array(F.collect_set(day))).scalar())

    def day(self, number: Column) -> Column:
        return F.get(self.days, number.cast("int"))

    def numbered(self, day: str) -> DataFrame:
        """(day, n), as many rows as the calendar has days."""
        return F.broadcast(self.spark.range(1).select(F.posexplode(self.days).alias("n", day)))


def before(days: Column, date: Column) -> Column:
    """How many of the sorted `days` are earlier than `date`, by bisection. `days` is a column that holds the calendar's
    array, as a subquery cannot stand inside a lambda."""
    steps = F.array(*[F.lit(_MOST_DAYS >> i) for i in range(_MOST_DAYS.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, d: F.when(F.get(days, at + d - 1) < date, at + d).otherwise(at))


def bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (number % 64).cast("int"))


def _mask(low: Column, high: Column) -> Column:
    """Bits [low, high) of a word, 0 <= low < high <= 64."""
    ones = F.lit(-1).cast("long")
    return F.call_function("shiftleft", ones, low.cast("int")).bitwiseAND(F.call_function("shiftrightunsigned", ones, (64 - high).cast("int")))


def held(keys: DataFrame, calendar: Calendar, by: str, day: str) -> DataFrame:
    """(by, word, bits) of the days that occur in `keys`, before they are combined; days outside the calendar are none."""
    n = F.col("n")
    return keys.select(by, day).join(calendar.numbered(day), day).select(by, F.floor(n / 64).cast("int").alias("word"), bit(n).alias("bits"))


def span_words(a: Column, b: Column) -> Column:
    """Structs (word, bits) of the days [a, b), a < b."""
    words = F.sequence(F.floor(a / 64).cast("int"), F.floor((b - 1) / 64).cast("int"))
    low, high = lambda w: F.greatest(a - w * 64, F.lit(0)), lambda w: F.least(b - w * 64, F.lit(64))
    return F.transform(words, lambda w: F.struct(w.alias("word"), _mask(low(w), high(w)).alias("bits")))


def spanned(spans: DataFrame, by: str) -> DataFrame:
    """(by, word, bits) of the days [a, b) of each row of `spans` (by, a, b: day numbers); an empty span has none."""
    words = F.explode(span_words(F.col("a"), F.col("b"))).alias("w")
    return spans.where("a < b").select(by, words).select(by, "w.word", "w.bits")


def combined(parts: list[DataFrame], by: str) -> DataFrame:
    """One row per (by, word): the union."""
    return reduce(DataFrame.unionByName, parts).groupBy(by, "word").agg(F.bit_or("bits").alias("bits"))


def without(due: DataFrame, seen: list[DataFrame], by: str) -> DataFrame:
    """`due` less all of `seen`, in one aggregate; rows without a bit are left out."""
    none = F.lit(0).cast("long")
    sides = [due.select(by, "word", F.col("bits").alias("_due"), none.alias("_seen"))]
    sides += [s.select(by, "word", none.alias("_due"), F.col("bits").alias("_seen")) for s in seen]
    both = reduce(DataFrame.unionByName, sides).groupBy(by, "word").agg(F.bit_or("_due").alias("_due"), F.bit_or("_seen").alias("_seen"))
    return both.select(by, "word", F.col("_due").bitwiseAND(F.bitwise_not("_seen")).alias("bits")).where("bits <> 0")


def numbers(bits: Column, word: Column) -> Column:
    """The day numbers of a word's bits, ascending."""
    at = F.sequence(F.lit(0), F.lit(63))
    there = F.filter(at, lambda i: F.call_function("shiftrightunsigned", bits, i).bitwiseAND(F.lit(1).cast("long")) == 1)
    return F.transform(there, lambda i: word * 64 + i)


def first_number(bits: Column, word: Column) -> Column:
    """The lowest bit is found in the binary text: arithmetic on a word whose only bit is its sign overflows."""
    return word * 64 + F.instr(F.reverse(F.bin(bits)), "1") - 1


def last_number(bits: Column, word: Column) -> Column:
    return word * 64 + F.length(F.bin(bits)) - 1


def unpacked(words: DataFrame, calendar: Calendar, by: str, day: str) -> DataFrame:
    """(by, day) of every bit."""
    return words.select(by, F.explode(numbers(F.col("bits"), F.col("word"))).alias("n")).select(by, calendar.day(F.col("n")).alias(day))


def spans_of(words: DataFrame, calendar: Calendar, by: str) -> DataFrame:
    """(by, first_missing, last_missing, n_missing): the range of each code's bits and their number."""
    b, w = F.col("bits"), F.col("word")
    ends = words.groupBy(by).agg(F.min(first_number(b, w)).alias("lo"), F.max(last_number(b, w)).alias("hi"), F.sum(F.bit_count(b)).alias("n_missing"))
    return ends.select(by, calendar.day(F.col("lo")).alias("first_missing"), calendar.day(F.col("hi")).alias("last_missing"), "n_missing")


def runs_of(words: DataFrame, calendar: Calendar, by: str) -> DataFrame:
    """(by, gap_start, gap_end, n_days): the stretches of neighbouring bits. A stretch begins at a bit whose lower
    neighbour is not set and ends at one whose upper neighbour is not; the i-th beginning belongs to the i-th end.

    The window and the arrays hold one code's words, which the calendar bounds."""
    order = Window.partitionBy(by).orderBy("word")
    b, w, one = F.col("bits"), F.col("word"), F.lit(1).cast("long")
    into = (F.lag("word").over(order) == w - 1) & (F.lag("bits").over(order) < 0)
    onto = (F.lead("word").over(order) == w + 1) & (F.lead("bits").over(order).bitwiseAND(one) == 1)
    carry = lambda c, bit: F.when(c, F.lit(bit)).otherwise(F.lit(0)).cast("long")
    below = F.call_function("shiftleft", b, F.lit(1)).bitwiseOR(carry(into, 1))
    above = F.call_function("shiftrightunsigned", b, F.lit(1)).bitwiseOR(carry(onto, -(1 << 63)))
    edges = words.select(by, "word", b.bitwiseAND(F.bitwise_not(below)).alias("lo"), b.bitwiseAND(F.bitwise_not(above)).alias("hi"))
    whole = edges.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("word", "lo", "hi"))).alias("e"))
    at = lambda c: F.flatten(F.transform("e", lambda x: numbers(x[c], x["word"])))
    pairs = whole.select(by, F.explode(F.arrays_zip(at("lo").alias("lo"), at("hi").alias("hi"))).alias("g")).select(by, "g.lo", "g.hi")
    return pairs.select(
        by, calendar.day(F.col("lo")).alias("gap_start"), calendar.day(F.col("hi")).alias("gap_end"), (F.col("hi") - F.col("lo") + 1).cast("long").alias("n_days")
    )


def dated(keys: DataFrame, by: str, day: str) -> DataFrame:
    """(by, word, bits) of the days that occur in `keys`, numbered from 1970-01-01 on, so that sets made at different times
    can be united without a calendar."""
    n = F.unix_date(F.to_date(day, "yyyyMMdd"))
    return combined([keys.select(by, F.floor(n / 64).cast("int").alias("word"), bit(F.pmod(n, F.lit(64))).alias("bits"))], by)


def listed(words: DataFrame, by: str) -> DataFrame:
    """(by, n_days, days): the number of days of `dated` sets, and the days as one sorted array."""
    whole = words.groupBy(by).agg(F.sum(F.bit_count("bits")).alias("n_days"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))
    days = F.flatten(F.transform("w", lambda x: numbers(x["bits"], x["word"])))
    return whole.select(by, "n_days", F.transform(days, lambda n: F.date_format(F.date_from_unix_date(n), "yyyyMMdd")).alias("days"))
