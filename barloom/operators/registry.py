"""The registry of missing keys with their retry counts, and the report over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import board

KEY = ["ts_code", "missing_entity", "missing_date"]
# Labels of the retry buckets and of codes without a listing.
RETRY_BUCKETS = ("1 次", "2-3 次", "4-10 次", ">10 次")
STATUS_LABELS = {"L": "在市(L)", "D": "退市(D)", "P": "暂停上市(P)"}
UNLISTED = "未在 stock_list"


def record_missing(registry: DataFrame, seen: DataFrame, at: Column) -> DataFrame:
    """Registry after the keys in `seen` were missed (again): a new key starts at 1, a known one counts on."""
    hit = seen.select(*KEY).where((F.trim("ts_code") != "") & (F.trim("missing_date") != "")).distinct()
    joined = registry.join(hit.withColumn("_seen", F.lit(True)), KEY, "full")
    return joined.select(
        *KEY,
        F.when(F.col("_seen"), F.coalesce(F.col("try_count"), F.lit(0)) + 1).otherwise(F.col("try_count")).alias("try_count"),
        F.when(F.col("_seen"), at).otherwise(F.col("last_try_time")).alias("last_try_time"),
    )


def forget_resolved(registry: DataFrame, resolved: DataFrame) -> DataFrame:
    """Registry without the keys that were resolved."""
    return registry.join(resolved.select(*KEY), KEY, "left_anti")


def retry_bucket(tries: Column) -> Column:
    t = F.coalesce(tries, F.lit(0))
    return (
        F.when(t <= 1, F.lit(RETRY_BUCKETS[0]))
        .when(t <= 3, F.lit(RETRY_BUCKETS[1]))
        .when(t <= 10, F.lit(RETRY_BUCKETS[2]))
        .otherwise(F.lit(RETRY_BUCKETS[3]))
    )


def year(day: Column) -> Column:
    y = F.substring(F.coalesce(day, F.lit("")), 1, 4)
    return F.when(y == "", F.lit("未知")).otherwise(y)


def count_by(registry: DataFrame, label: Column, name: str) -> DataFrame:
    """Rows per label with their share in percent."""
    total = registry.agg(F.count(F.lit(1))).scalar()
    g = registry.groupBy(label.alias(name)).agg(F.count(F.lit(1)).alias("n_missing"))
    return g.withColumn("share_pct", F.round(F.col("n_missing") / total * 100, 2))


def by_board_and_year(registry: DataFrame, boards: list[str]) -> DataFrame:
    """Rows per year, one column per board."""
    b = registry.select(year(F.col("missing_date")).alias("year"), board(F.col("ts_code")).alias("board"))
    return b.groupBy("year").agg(*[F.count_if(F.col("board") == n).alias(n) for n in boards])


def worst_codes(registry: DataFrame, listing: DataFrame, n: int = 30) -> DataFrame:
    """The n codes with most missing keys, their largest retry count and their names."""
    per_code = registry.groupBy("ts_code").agg(
        F.count(F.lit(1)).alias("n_missing"), F.max(F.coalesce("try_count", F.lit(0))).alias("max_tries")
    )
    top = per_code.orderBy(F.desc("n_missing"), "ts_code").limit(n)
    return top.join(listing.select("ts_code", "name", "list_date", "delist_date"), "ts_code", "left")


def by_listing_status(registry: DataFrame, listing: DataFrame) -> DataFrame:
    """Missing keys and codes per listing status; counted per code before the join."""
    per_code = registry.groupBy("ts_code").agg(F.count(F.lit(1)).alias("n"))
    status = listing.select("ts_code", F.col("list_status").alias("_st"), F.lit(True).alias("_known"))
    label = F.when(F.col("_known").isNull(), F.lit(UNLISTED))
    for k, v in STATUS_LABELS.items():
        label = label.when(F.col("_st") == k, F.lit(v))
    label = label.otherwise(F.concat(F.lit("其他("), F.coalesce(F.col("_st"), F.lit("未知")), F.lit(")")))
    return (
        per_code.join(status, "ts_code", "left")
        .groupBy(label.alias("status"))
        .agg(F.sum("n").alias("n_missing"), F.count(F.lit(1)).alias("n_codes"))
    )
