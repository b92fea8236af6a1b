"""One row per key, as aggregates: duplicates collapse map-side, so a key with many copies never meets in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_pages(pages: list[DataFrame], ordinal: str = "page_no") -> DataFrame:
    """Pages or sources stacked in order, each row with the number of its page."""
    numbered = [p.withColumn(ordinal, F.lit(i)) for i, p in enumerate(pages)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def first_by(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """The first (or last) row of every key in the given order. Ties in the order must be equal rows."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    rank = order[0] if len(order) == 1 else F.struct(*order)
    return df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*")


def minute_key(period: str) -> list[str]:
    """Key of bars: intraday periods end in m, like 5m."""
    return ["ts_code", "trade_time"] if period.endswith("m") else ["ts_code", "trade_date"]


def newest_version(reports: DataFrame, by_type: bool = True, ann: str | None = None, ordinal: str = "ordinal") -> DataFrame:
    """Per code, period (and type) the row with update flag '1' before others, then the latest announcement (by
    f_ann_date where the table has one, else ann_date, unless `ann` names it), then the earliest arrival."""
    ann = ann or ("f_ann_date" if "f_ann_date" in reports.columns else "ann_date")
    keys = ["ts_code", "end_date"] + (["report_type"] if by_type else [])
    flag = (F.col("update_flag") == "1").cast("int")
    order = [F.coalesce(flag, F.lit(0)), F.coalesce(F.col(ann), F.lit("")), -F.col(ordinal)]
    return first_by(reports, keys, order, last=True)


def merge_types(picked: DataFrame) -> DataFrame:
    """Every report type under the one name that the stored tables use."""
    return picked.withColumn("report_type", F.lit("merge_now"))


def key_conflicts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that still occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
