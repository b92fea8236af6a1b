"""Positions, ranks, groups and quantiles inside one date's cross-section.

A cross-section may hold any share of the rows, so nothing here sorts one date in one task when it is large:
the date is cut at sampled keys into buckets, each bucket is ordered by itself, and a bucket's start is the sum
of the buckets before it. Sample and cuts are functions of the data only, so a recomputed task sees the same.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import stage

# Up to this many rows of one group are ordered by one task.
ROWS_PER_TASK = 2_000_000
_SAMPLES_PER_CUT = 32
# Cuts of one group made at a time; where that leaves buckets too large, they are cut again.
_CUTS_AT_ONCE = 256


def join_by(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of the same name in which null meets null; the left side's columns and the right side's
    other ones."""
    ours = {c: f"_right_{i}" for i, c in enumerate(by)}
    other = right.withColumnsRenamed(ours)
    on = [F.col(c).eqNullSafe(F.col(r)) for c, r in ours.items()]
    return left.join(other, on, how).drop(*ours.values())


def _clean(c: Column) -> Column:
    """-0.0 as 0.0, so that grouping, joining and sorting agree on it."""
    return F.when(c == 0, F.abs(c)).otherwise(c)


def with_group_stats(df: DataFrame, by: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Attach per-group aggregates to every row: combined map-side, then joined back, instead of a window that
    would bring a whole group into one task."""
    stats = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])
    return join_by(df, stats, by, "left")


def prefix_sum(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    weight: Column,
    out: str,
    rows_per_task: int = ROWS_PER_TASK,
    total: str = "_total",
) -> DataFrame:
    """Sum of `weight` over the rows that come before this one in its group (exclusive, 0 for the first).

    `order` are ascending keys that together are unique in a group. Adds `out`, and the group's whole weight as
    `total`.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    biggest = sizes.agg(F.max("_n")).first()[0] or 0
    keys = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns({**dict(zip(keys, order)), "_w": weight})
    before = lambda part: Window.partitionBy(*part).orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if biggest <= rows_per_task:
        whole = F.sum("_w").over(Window.partitionBy(*by))
        return keyed.withColumns({out: F.sum("_w").over(before(by)) - F.col("_w"), total: whole}).drop(*keys, "_w")

    cut_count = F.least(F.lit(_CUTS_AT_ONCE), F.ceil(F.col("_n") / rows_per_task)).cast("int")
    rate = F.least(F.lit(1.0), cut_count * _SAMPLES_PER_CUT / F.col("_n"))
    unit = F.pmod(F.xxhash64(*by, *keys), F.lit(1 << 30)) / float(1 << 30)
    large = sizes.where(F.col("_n") > rows_per_task)
    cuts = (
        join_by(keyed.select(*by, *keys), large, by)
        .where(unit < rate)
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(F.struct(*keys))).alias("_s"))  # about _CUTS_AT_ONCE x _SAMPLES_PER_CUT
        .select(*by, F.filter("_s", lambda s, i: (i + 1) % _SAMPLES_PER_CUT == 0).alias("_cuts"))
    )
    _b, start = f"_b{len(by)}", f"_start{len(by)}"
    here = F.struct(*keys)
    bucket = F.coalesce(F.size(F.filter("_cuts", lambda c: c < here)), F.lit(0))
    bucketed = stage(join_by(keyed, cuts, by, "left").withColumn(_b, bucket).drop("_cuts"))
    # One row per (group, bucket).
    w_bucket = Window.partitionBy(*by).orderBy(_b).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_bucket = bucketed.groupBy(*by, _b).agg(F.sum("_w").alias("_bw"), F.count(F.lit(1)).alias("_bn"))
    starts = per_bucket.select(
        *by,
        _b,
        (F.sum("_bw").over(w_bucket) - F.col("_bw")).alias(start),
        F.sum("_bw").over(Window.partitionBy(*by)).alias(total),
    )
    placed = join_by(bucketed, starts, [*by, _b])
    fullest = per_bucket.agg(F.max("_bn")).first()[0] or 0
    if rows_per_task * 4 < fullest < biggest:
        inside, whole = f"_inside{len(by)}", f"_whole{len(by)}"
        inner = prefix_sum(placed.drop(*keys, "_w"), [*by, _b], order, weight, inside, rows_per_task, whole)
        return inner.withColumn(out, F.col(start) + F.col(inside)).drop(inside, whole, _b, start)
    inside = F.sum("_w").over(before([*by, _b])) - F.col("_w")
    return placed.withColumn(out, F.col(start) + inside).drop(*keys, "_w", _b, start)


def positions(df: DataFrame, by: list[str], order: list[Column], out: str = "position", **kw) -> DataFrame:
    """1-based row number in the group."""
    return _placed(df, by, order, out, "_n", **kw).drop("_n")


def _placed(df: DataFrame, by: list[str], order: list[Column], out: str, n: str, **kw) -> DataFrame:
    """Row number and size of the group."""
    p = prefix_sum(df, by, order, F.lit(1), "_before", total=n, **kw)
    return p.withColumn(out, (F.col("_before") + 1).cast("long")).drop("_before")


def average_rank(df: DataFrame, x: str, by: list[str], out: str, share: bool = False, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Ascending rank of x in its group, ties averaged, nulls left null; `share` divides by the non-null count.

    Groups that fit in a task are ranked by one window. Larger ones collapse equal values first, so that a value that
    many rows share is one row, order those, and give the ranks back by a join on the value.
    """
    return average_ranks(df, {out: F.col(x)}, by, share, rows_per_task)


def average_ranks(
    df: DataFrame, ranks: dict[str, Column], by: list[str], share: bool = False, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """`average_rank` of several expressions over the same groups, whose size is taken once."""
    biggest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    for i, (out, x) in enumerate(ranks.items()):
        df = _average_rank(df.withColumn(f"_x{i}", x), f"_x{i}", by, out, share, biggest <= rows_per_task, rows_per_task).drop(f"_x{i}")
    return df


def _average_rank(df: DataFrame, x: str, by: list[str], out: str, share: bool, small: bool, rows_per_task: int) -> DataFrame:
    if isinstance(df.schema[x].dataType, (T.DoubleType, T.FloatType)):
        df = df.withColumn(x, _clean(F.col(x)))
    if small:
        ordered = Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())
        ties = F.count(F.lit(1)).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
        rank = F.rank().over(ordered) + (ties - 1) / 2.0
        if share:
            rank = F.try_divide(rank, F.count(x).over(Window.partitionBy(*by)))
        return df.withColumn(out, F.when(F.col(x).isNotNull(), rank))

    values = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("_ties"))
    ranked = prefix_sum(values, by, [F.col(x)], F.col("_ties"), "_below", rows_per_task)
    rank = F.col("_below") + (F.col("_ties") + 1) / 2.0
    if share:
        rank = rank / F.col("_total")
    ranked = ranked.select(*by, x, rank.alias(out))
    return join_by(df, ranked, [*by, x], "left")


def quantile_groups(df: DataFrame, value: str, groups: int, by: list[str], tie: str = "ts_code", **kw) -> DataFrame:
    """Equal-size groups by descending value, 0 the highest; the first (n mod groups) groups hold one more.

    Adds group_no and weight (equal in a group). Rows without a value are left out.
    """
    if groups < 2:
        raise ValueError(f"at least two groups: {groups}")
    present = df.where(F.col(value).isNotNull())
    placed = _placed(present, by, [-F.col(value), F.col(tie)], "_pos", "_n", **kw)
    base, extra, i = F.floor(F.col("_n") / groups), F.col("_n") % groups, F.col("_pos") - 1
    in_big = i < extra * (base + 1)
    group = F.when(in_big, F.floor(i / (base + 1))).otherwise(
        extra + F.floor((i - extra * (base + 1)) / F.greatest(base, F.lit(1)))
    )
    return (
        placed.withColumn("group_no", group.cast("int"))
        .withColumn("weight", F.lit(1.0) / F.when(F.col("group_no") < extra, base + 1).otherwise(base))
        .drop("_pos", "_n")
    )


# Bins of a value range at a time, and values of one group that are put in order at the end of a selection.
_BINS = 4_096
_LEFT = 4_096


def _magnitude(x: Column) -> Column:
    """A bin that keeps the order of doubles: by sign, then by the power of two below the absolute value; the infinities
    and NaN have bins of their own."""
    power = F.floor(F.log2(F.abs(x))) + 1_100
    sized = F.when(x > 0, power).when(x < 0, -power).otherwise(0)
    return F.when(F.isnan(x), 9_999).when(x == float("inf"), 9_998).when(x == float("-inf"), -9_998).otherwise(sized).cast("int")


def _holding(bins: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """The targets with the one bin that holds their index: its bounds, its count, and the index within it. A group has
    some thousand bins at most."""
    order = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = bins.withColumn("_upto", F.sum("_c").over(order))
    met = join_by(targets, placed, by)
    before = F.col("_upto") - F.col("_c")
    return met.where((before <= F.col("_i")) & (F.col("_i") < F.col("_upto"))).withColumn("_i", F.col("_i") - before)


def selected(df: DataFrame, value: str, by: list[str], picks: dict[str, Callable[[Column], Column]], rows_per_task: int = _LEFT) -> DataFrame:
    """Per group the count of its values and, for each of `picks`, the value at an index of their ascending order: the pick
    maps the count to the index (from 0). Nulls are no values; both zeros are one, NaN is the greatest.

    No group is put in order. Values are counted by magnitude, map-side; the bin that holds an index is counted again by
    even parts of its range, and so on until it is of one value or has `rows_per_task` values at most, which are put in order. Each
    round reads the values once and tells the driver one number; a range shrinks by thousands each round, so there are few.
    """
    x = F.col("_x")
    values = df.select(*by, _clean(F.col(value).cast("double")).alias("_x")).where(x.isNotNull())
    bounds = [F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")]
    bins = stage(values.groupBy(*by, _magnitude(x).alias("_bin")).agg(*bounds))
    counts = bins.groupBy(*by).agg(F.sum("_c").alias("count"))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("_pick"), f(F.col("count")).cast("long").alias("_i")) for n, f in picks.items()]))
    targets = counts.select(*by, wanted.alias("_t")).select(*by, "_t.*")
    held = stage(_holding(bins, targets, by).drop("_bin", "_upto"))
    done = []
    one = (F.col("_lo") == F.col("_hi")) | F.col("_lo").eqNullSafe(F.col("_hi"))
    while True:
        done.append(held.where(one).select(*by, "_pick", F.col("_lo").alias("_v")))
        wide = held.where(~one)
        most = wide.agg(F.max("_c")).first()[0] or 0
        if most <= rows_per_task:
            break
        ranges = wide.select(*by, "_lo", "_hi").distinct()
        inside = join_by(values, ranges, by).where((x >= F.col("_lo")) & (x <= F.col("_hi")))
        part = F.least(F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * _BINS), F.lit(_BINS - 1)).cast("int")
        bins = inside.groupBy(*by, F.col("_lo").alias("_from"), F.col("_hi").alias("_to"), part.alias("_bin")).agg(*bounds)
        targets = wide.select(*by, F.col("_lo").alias("_from"), F.col("_hi").alias("_to"), "_pick", "_i")
        held = stage(_holding(bins, targets, [*by, "_from", "_to"]).select(*by, "_pick", "_i", "_c", "_lo", "_hi"))
    if most:
        # At most `rows_per_task` values a group and pick are put in order.
        inside = join_by(values, wide, by).where((x >= F.col("_lo")) & (x <= F.col("_hi")))
        ordered = inside.groupBy(*by, "_pick", "_i").agg(F.sort_array(F.collect_list("_x")).alias("_v"))
        done.append(ordered.select(*by, "_pick", F.get("_v", F.col("_i").cast("int")).alias("_v")))
    found = reduce(DataFrame.unionByName, done).groupBy(*by).agg(*[F.max(F.when(F.col("_pick") == n, F.col("_v"))).alias(n) for n in picks])
    return join_by(counts, found, by, "left")


def nearest_rank_quantiles(df: DataFrame, value: str, by: list[str], probs: dict[str, float], rows_per_task: int = _LEFT) -> DataFrame:
    """Per group the count and the values at index round_half_even((n - 1) * p) of the ascending order."""
    return selected(df, value, by, {n: lambda c, p=p: F.rint((c - 1) * p) for n, p in probs.items()}, rows_per_task)


def upper_median(df: DataFrame, value: str, by: list[str], rows_per_task: int = _LEFT) -> DataFrame:
    """Per group the element at index n // 2 of the ascending order."""
    return selected(df, value, by, {"median": lambda c: F.floor(c / 2)}, rows_per_task).drop("count")
