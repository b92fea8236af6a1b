"""Row filters and slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Longer value lists are joined instead of being written into the plan.
IN_LIST = 500


def where_in(df: DataFrame, column: str, values: list[str] | DataFrame) -> DataFrame:
    """Rows whose column is among the values (a list, or a table with that column); no values, no rows."""
    if isinstance(values, DataFrame):
        return df.join(values.select(column).distinct(), column, "left_semi")
    if not values:
        return df.where(F.lit(False))
    if len(values) <= IN_LIST:
        return df.where(F.col(column).isin(values))
    wanted = df.sparkSession.createDataFrame([(v,) for v in sorted(set(values))], f"{column} string")
    return df.join(wanted, column, "left_semi")


def where_between(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    if start:
        df = df.where(F.col(column) >= start)
    if end:
        df = df.where(F.col(column) <= end)
    return df


def table_slice(
    df: DataFrame,
    limit: int,
    order: list[str],
    start: str | None = None,
    end: str | None = None,
    codes: list[str] | None = None,
    groups: list[str] | None = None,
) -> DataFrame:
    """First `limit` rows of the filtered table in key order, each with the number of all filtered rows."""
    if limit < 1:
        raise ValueError(f"a slice has one row at least: {limit}")
    out = where_between(df, "trade_date", start, end)
    if codes is not None:
        out = where_in(out, "ts_code", codes)
    if groups is not None:
        out = where_in(out, "group_id", groups)
    total = out.agg(F.count(F.lit(1))).scalar()
    return out.orderBy(*order).limit(limit).withColumn("total_rows", total)
