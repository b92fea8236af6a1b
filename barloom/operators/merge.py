"""Loading against a target: row differences, upserts, reconciliation. Everything returns the new state or the
difference as a DataFrame; `sources.sinks` replaces the partitions concerned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: floats this close are the same.
FLOAT_TOLERANCE = 1e-9


def canonical_json(doc: Column) -> Column:
    """A JSON document as text in which key order and spacing do not count, at any depth: the variant type keeps the keys of
    an object sorted. Numbers stay numbers (1 is not "1"), the order of arrays counts; a text that is no JSON is itself."""
    return F.coalesce(F.to_json(F.try_parse_json(doc)), doc)


def _blank_as_null(c: Column, dtype: T.DataType, as_json: bool) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    if as_json:
        return canonical_json(c)
    if isinstance(dtype, T.StringType):
        return F.when(F.trim(c) != "", c)
    return c


def same_value(a: Column, b: Column, dtype: T.DataType, as_json: bool = False) -> Column:
    """Equality of two stored values: null, NaN and '' are one, floats within the tolerance are equal."""
    x, y = _blank_as_null(a, dtype, as_json), _blank_as_null(b, dtype, as_json)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return (x.isNull() & y.isNull()) | F.coalesce(F.abs(x - y) <= FLOAT_TOLERANCE, F.lit(False))
    return x.eqNullSafe(y)


def _key(c: str, dtype: T.DataType) -> Column:
    """A key as it is matched: a null text is a blank one."""
    return F.coalesce(F.col(c), F.lit("")) if isinstance(dtype, T.StringType) else F.col(c)


def _same(c: str, dtype: T.DataType, other: str) -> Column:
    """Whether a key equals the column `other`, which is already matched as by `_key`."""
    return _key(c, dtype) == F.col(other) if isinstance(dtype, T.StringType) else F.col(c).eqNullSafe(F.col(other))


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """`left` joined with the distinct keys of `right`, semi or anti, null keys matching null keys."""
    types = {f.name: f.dataType for f in left.schema.fields}
    other = right.select(*[_key(k, types[k]).alias(f"_k_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [_same(k, types[k], f"_k_{k}") for k in keys])
    return left.join(other, same, how)


def classify(
    incoming: DataFrame,
    existing: DataFrame,
    keys: list[str],
    compare: list[str] | None = None,
    json_columns: tuple[str, ...] = (),
    in_scope: Column | None = None,
) -> DataFrame:
    """Incoming rows with diff_class: insert (new key), update (a compared column differs) or skip (equal, or out of
    the load's scope). Compares the supplied columns, or `compare`. Null keys match null keys, and blank ones."""
    columns = compare or [c for c in incoming.columns if c not in keys and c in existing.columns]
    types = {f.name: f.dataType for f in existing.schema.fields}
    old = existing.select(
        *[_key(k, types[k]).alias(f"_k_{k}") for k in keys], F.lit(True).alias("_found"), *[F.col(c).alias(f"_old_{c}") for c in columns]
    )
    same = reduce(lambda a, b: a & b, [_same(k, types[k], f"_k_{k}") for k in keys])
    checks = [same_value(F.col(f"_old_{c}"), F.col(c), types[c], c in json_columns) for c in columns]
    equal = reduce(lambda a, b: a & b, checks, F.lit(True))
    cls = F.when(F.col("_found").isNull(), F.lit("insert")).when(equal, F.lit("skip")).otherwise(F.lit("update"))
    if in_scope is not None:
        cls = F.when(F.coalesce(in_scope, F.lit(False)), cls).otherwise(F.lit("skip"))
    out = incoming.join(old, same, "left").withColumn("diff_class", cls)
    return out.select(*incoming.columns, "diff_class")


def merged(
    target: DataFrame, incoming: DataFrame, keys: list[str], update: list[str] | None = None, json_columns: tuple[str, ...] = ()
) -> DataFrame:
    """`classify` and `upsert` in one full-outer join: the target's rows after the load, with diff_class (null where no row
    came in). The incoming rows have one row a key and no null keys; a row that is skipped stays as it is stored."""
    types = {f.name: f.dataType for f in target.schema.fields}
    columns = [c for c in target.columns if c not in keys]
    changed = [c for c in (update or columns) if c in incoming.columns]
    new = incoming.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_new_{c}") for c in changed], F.lit(True).alias("_come"))
    old = target.select(*target.columns, *[_key(k, types[k]).alias(f"_o_{k}") for k in keys], F.lit(True).alias("_old"))
    both = old.join(new, reduce(lambda a, b: a & b, [F.col(f"_o_{k}") == F.col(f"_k_{k}") for k in keys]), "full")
    checks = [same_value(F.col(c), F.col(f"_new_{c}"), types[c], c in json_columns) for c in changed]
    equal, stays = reduce(lambda a, b: a & b, checks, F.lit(True)), F.col("_old").isNotNull()
    cls = F.when(~stays, F.lit("insert")).when(equal, F.lit("skip")).otherwise(F.lit("update"))
    writes = F.col("diff_class").isin("insert", "update")
    return both.withColumn("diff_class", F.when(F.col("_come"), cls)).select(
        *[F.when(stays, F.col(k)).otherwise(F.col(f"_k_{k}")).alias(k) for k in keys],
        *[(F.when(writes, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)) for c in columns],
        "diff_class",
    )


def diff_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("diff_class").agg(F.count(F.lit(1)).alias("n_rows"))


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """Target after insert-or-update on the keys: one full-outer join. Null keys match null keys, and blank ones.

    With `update`, a conflict overwrites those columns only; a new row has null in the others. Of incoming rows with one
    key the greatest counts, as one row, so a target row is never multiplied.
    """
    types = {f.name: f.dataType for f in target.schema.fields}
    columns = [c for c in target.columns if c not in keys]
    changed = [c for c in (update or columns) if c in incoming.columns]
    matched = [f"_k_{k}" for k in keys]
    new = incoming.select(*[_key(k, types[k]).alias(m) for k, m in zip(keys, matched)], F.struct(*keys, *changed).alias("_new"))
    new = new.groupBy(*matched).agg(F.max("_new").alias("_new"))
    same = reduce(lambda a, b: a & b, [_same(k, types[k], m) for k, m in zip(keys, matched)])
    old = target.select(*target.columns, F.lit(True).alias("_old"))
    come, stays = F.col("_new").isNotNull(), F.col("_old")
    return old.join(new, same, "full").select(
        *[F.when(stays, F.col(k)).otherwise(F.col(f"_new.{k}")).alias(k) for k in keys],
        *[(F.when(come, F.col(f"_new.{c}")).otherwise(F.col(c)) if c in changed else F.col(c)).alias(c) for c in columns],
    )


def insert_absent(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Target plus the incoming rows whose key it does not have."""
    return target.unionByName(incoming.join(target.select(*keys), keys, "left_anti"))


def fallback(sources: DataFrame, keys: list[str], rank: str = "source_rank") -> DataFrame:
    """Rows of the best-ranked source that has the key; the others of that key go.

    The best rank per key is an aggregate that is joined back, so a large key stays spread.
    """
    best = sources.groupBy(*keys).agg(F.min(rank).alias(rank))
    return sources.join(best, [*keys, rank], "left_semi")


def reconcile_counts(left: DataFrame, right: DataFrame, key: str, expected_skips: DataFrame | None = None) -> DataFrame:
    """Row counts per key of two stores: ok, diff, left_only or right_only; a left_only key named in
    `expected_skips` is expected_skip."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("left_n"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("right_n"))
    n, m = F.coalesce(F.col("left_n"), F.lit(0)), F.coalesce(F.col("right_n"), F.lit(0))
    both = a.join(b, key, "full").select(key, n.alias("left_n"), m.alias("right_n"))
    left_only = F.lit("left_only")
    if expected_skips is not None:
        both = both.join(expected_skips.select(key, F.lit(True).alias("_skip")), key, "left")
        left_only = F.when(F.col("_skip"), F.lit("expected_skip")).otherwise(left_only)
    status = (
        F.when(F.col("left_n") == F.col("right_n"), F.lit("ok"))
        .when(F.col("right_n") == 0, left_only)
        .when(F.col("left_n") == 0, F.lit("right_only"))
        .otherwise(F.lit("diff"))
    )
    return both.select(key, "left_n", "right_n", status.alias("status"))
