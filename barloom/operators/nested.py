"""JSON documents and shapes: overflow packing, combos, wide matrices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators import ordering
from barloom.session import stage

ITEMS = "array<struct<factor_name:string,weight:double>>"


def _present(name: str, dtype: T.DataType) -> Column:
    c = F.col(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c), c)
    elif isinstance(dtype, T.StringType):
        c = F.when(F.trim(c) != "", c)
    return c.alias(name)


def pack_overflow(df: DataFrame, model: list[str], json_column: str) -> DataFrame:
    """Columns outside the model as one JSON object; null, NaN and blank values are left out of it."""
    extra = [f for f in df.schema.fields if f.name not in model and f.name != json_column]
    doc = F.to_json(F.struct(*[_present(f.name, f.dataType) for f in extra])) if extra else F.lit("{}")
    return df.select(*[c for c in model if c in df.columns], doc.alias(json_column))


def combo_items(combos: DataFrame) -> DataFrame:
    """(combo, factor_name, weight) of every combo of at least two factors; a missing or zero weight is 1."""
    items = combos.select("combo", F.explode(F.from_json("items", ITEMS)).alias("i")).select(
        "combo",
        F.trim("i.factor_name").alias("factor_name"),
        F.when(F.coalesce(F.col("i.weight"), F.lit(0.0)) != 0, F.col("i.weight")).otherwise(F.lit(1.0)).alias("weight"),
    )
    items = items.where(F.coalesce(F.col("factor_name"), F.lit("")) != "")
    enough = items.groupBy("combo").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return items.join(enough, "combo", "left_semi")


def score_combos(long: DataFrame, combos: DataFrame) -> DataFrame:
    """Composite score and position of every code, date and combo, in long form: any number of factors and combos.

    z-scores take each factor's stats per date; the weights of the factors that a code has are normalised.
    """
    stats = {"_m": F.avg("value"), "_s": F.stddev_samp("value")}
    items = combo_items(combos)
    used = long.join(items.select("factor_name").distinct(), "factor_name", "left_semi")
    scored = ordering.with_group_stats(used, ["factor_name", "trade_date"], stats)
    std = F.col("_s")
    z = F.when(std.isNotNull() & ~F.isnan(std) & (std > 0), (F.col("value") - F.col("_m")) / std).otherwise(F.lit(0.0))
    parts = scored.select("factor_name", "trade_date", "ts_code", z.alias("z")).join(items, "factor_name")
    total = parts.groupBy("combo", "trade_date", "ts_code").agg(
        F.sum(F.col("z") * F.col("weight")).alias("_t"), F.sum("weight").alias("_w")
    )
    out = total.where(F.col("_w") > 0).select("combo", "trade_date", "ts_code", (F.col("_t") / F.col("_w")).alias("value"))
    return ordering.positions(stage(out), ["combo", "trade_date"], [-F.col("value"), F.col("ts_code")])


def matrices_to_long(matrices: dict[str, DataFrame], index: str, present: str = "close") -> DataFrame:
    """One wide matrix per field (index column, one column per code) to long rows where `present` has a value.

    The matrices are stacked and brought together by one aggregate, instead of one join per field.
    """
    stacked = [
        m.unpivot([index], [c for c in m.columns if c != index], "ts_code", "v").withColumn("field", F.lit(name))
        for name, m in matrices.items()
    ]
    long = reduce(DataFrame.unionByName, stacked).where(F.col("v").isNotNull() & ~F.isnan("v"))
    wide = long.groupBy(index, "ts_code").pivot("field", list(matrices)).agg(F.first("v"))
    return wide.where(F.col(present).isNotNull())


def summary_fields(runs: DataFrame, document: str, fields: dict[str, str]) -> DataFrame:
    """Run rows with fields taken from their JSON summary; a bad or missing document gives nulls."""
    schema = ", ".join(f"{n} {t}" for n, t in fields.items())
    parsed = runs.withColumn("_d", F.from_json(document, schema))
    return parsed.select(*[c for c in runs.columns if c != document], *[F.col(f"_d.{n}").alias(n) for n in fields])
