"""Partitioned Parquet sinks. All of them replace whole partitions and can be run again.

Rows are rebalanced by partition value before the write: large partitions are split over tasks and small ones are
not scattered, so neither one huge file nor many small ones come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import vendor_name
from barloom.session import stage
from barloom.sources.bars import partitioned, read_or_none
from barloom.sources.contracts import FACTOR, KLINE_DAILY, SNAPSHOT, conform, to_double

# Compression and row-group size of the warehouse files.
WRITER = {"compression": "zstd", "parquet.compression.codec.zstd.level": "3", "parquet.enable.dictionary": "true"}
ROW_GROUP_BYTES = str(16 * 1024 * 1024)


def overwrite_partitions(df: DataFrame, path: str, by: list[str], sort: list[str]) -> None:
    """Replace exactly the partitions that `df` has rows in."""
    (
        df.hint("rebalance", *by)
        .sortWithinPartitions(*by, *sort)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .options(**WRITER)
        .partitionBy(*by)
        .parquet(path)
    )


def write_bars(bars: DataFrame, root: str) -> None:
    """Bars under the contract's columns, by month."""
    rows = conform(bars, KLINE_DAILY).withColumn("dt", F.substring("trade_date", 1, 6))
    overwrite_partitions(rows, f"{root.rstrip('/')}/kline_daily", ["dt"], ["trade_date", "ts_code"])


def write_factors(long: DataFrame, root: str, row_group_bytes: str = ROW_GROUP_BYTES) -> None:
    """Long factor rows (factor_name, ts_code, trade_date, value) into months that are clustered by factor; nulls are not
    stored. What is replaced are the factors of a month that `long` has rows of; the month's other factors stay.

    A month is some files in order of factor, whatever the number of factors: their row groups hold few factors each, whose
    statistics and Bloom filters let a read of one factor open only its own. Rows and kept rows are written aside first, so
    the table may be its own source.
    """
    spark, path = long.sparkSession, f"{root.rstrip('/')}/factor"
    cols = ["factor_name", *FACTOR.schema.names]
    rows = stage(long.select(*cols).where(F.col("value").isNotNull()).withColumn("dt", F.substring("trade_date", 1, 6)))
    months = [r.dt for r in rows.select("dt").distinct().collect()]
    if not months:
        return
    stored = read_or_none(spark, partitioned(FACTOR.schema, "factor_name", "dt"), path).where(F.col("dt").isin(months))
    kept = stage(stored.join(rows.select("factor_name", "dt").distinct(), ["factor_name", "dt"], "left_anti"))
    (
        rows.unionByName(kept.select(*rows.columns))
        .repartitionByRange("dt", "factor_name")
        .sortWithinPartitions("dt", "factor_name", "trade_date", "ts_code")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.bloom.filter.enabled#factor_name", "true")
        .option("parquet.bloom.filter.expected.ndv#factor_name", "1000")
        .options(**WRITER)
        .partitionBy("dt")
        .parquet(path)
    )
    spark.catalog.refreshByPath(path)


def vendor_long(wide: DataFrame) -> DataFrame:
    """A vendor's wide frame as long factor rows under the local names."""
    keys = ["ts_code", "trade_date"]
    named = to_double(wide.withColumnsRenamed({c: vendor_name(c) for c in wide.columns}), keys)
    names = [c for c in named.columns if c not in keys]
    return named.unpivot(keys, names, "factor_name", "value").where(F.col("value").isNotNull())


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    overwrite_partitions(conform(snapshots, SNAPSHOT), path, ["source_name"], ["date_key"])


def write_backtest(result, summary: DataFrame, root: str) -> None:
    """The five tables of a run and its one-row JSON summary; empty tables keep their schema."""
    for name in ("portfolio", "trades", "returns", "ic", "turnover"):
        getattr(result, name).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}")
    summary.select(F.to_json(F.struct(*summary.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{root}/report")
