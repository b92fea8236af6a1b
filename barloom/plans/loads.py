"""Loading landed tables: all dates, or all periods, in one job."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import dedup, merge, universe
from barloom.operators.nested import pack_overflow
from barloom.session import stage
from barloom.sources.contracts import Contract, conform
from barloom.sources.sinks import overwrite_partitions

BAR_KEYS = ["ts_code", "trade_date"]
# Keys of the statement tables and of the indicator table.
STATEMENT_KEYS = ["ts_code", "end_date", "f_ann_date", "report_type", "update_flag"]
INDICATOR_KEYS = ["ts_code", "end_date", "ann_date", "update_flag"]


def load_bars(landed: DataFrame, stored: DataFrame, listing: DataFrame, in_scope=None) -> DataFrame:
    """Landed bars with their diff_class: only codes listed on the day, compared with what is stored."""
    return merge.classify(universe.keep_listed(landed, listing, "trade_date"), stored, BAR_KEYS, in_scope=in_scope)


def load_satellite(landed: DataFrame, stored: DataFrame, listing: DataFrame, columns: list[str]) -> DataFrame:
    """Stored bars after an update of some columns (adjustment factor, limits) from landed rows."""
    return merge.upsert(stored, universe.keep_listed(landed, listing, "trade_date"), BAR_KEYS, columns)


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df` itself, or an error that names some of the keys that occur more than once. Hashes of the keys are counted first,
    and the keys themselves only where a hash is doubled."""
    if dedup.key_conflicts(df.select(F.xxhash64(*keys).alias("_h")), ["_h"]).isEmpty():
        return df
    doubled = dedup.key_conflicts(df, keys).limit(5).collect()
    if doubled:
        raise ValueError(f"more than one row for {keys}: " + "; ".join(str(tuple(r)[:-1]) for r in doubled))
    return df


def read_stored(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """The stored table with its month `dt`; an empty one where nothing is stored yet."""
    try:
        return spark.read.schema(f"{contract.columns}, dt string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{contract.columns}, dt string")


def load_into(path: str, incoming: DataFrame, contract: Contract, columns: list[str] | None = None, json_columns: tuple[str, ...] = ()) -> DataFrame:
    """Load rows into the month-partitioned table at `path`: normalise, refuse doubled keys, compare with what is stored,
    and write the months in which something changes, whole. Returns the number of rows by diff_class.

    With `columns`, only these are compared and overwritten, and a new row has null in the others: the load of one source
    of a table that several sources fill. `json_columns` are compared as documents.

    The key holds the day, so only stored months that rows come in for are read. One join compares and merges; what comes
    of it is written aside before the stored months are replaced, so the table may be its own source, and loading the same
    rows again changes nothing.
    """
    spark, keys = incoming.sparkSession, list(contract.key)
    month = F.substring(contract.day, 1, 6).alias("dt")
    rows = conform(incoming, contract)
    rows = require_unique(stage(rows if columns is None else rows.select(*keys, *columns)), keys)
    months = [r.dt for r in rows.select(month).distinct().collect()]
    stored = read_stored(spark, path, contract).where(F.col("dt").isin(months)).drop("dt")
    # Days differ in their first characters, codes hardly do: with the day first, sorting compares less.
    by_day = sorted(keys, key=lambda k: k != contract.day)
    after = stage(merge.merged(stored, rows, by_day, columns, json_columns).select(*stored.columns, "diff_class", month))
    touched = [r.dt for r in after.where("diff_class != 'skip'").select("dt").distinct().collect()]
    if touched:
        overwrite_partitions(after.where(F.col("dt").isin(touched)).select(*stored.columns, "dt"), path, ["dt"], keys)
        spark.catalog.refreshByPath(path)
    return merge.diff_counts(after.where("diff_class IS NOT NULL").select("diff_class"))


def newest_reports(landed: DataFrame, companies: DataFrame) -> DataFrame:
    """Listed companies' reports, one version per key; every type is stored as one, so two types of one period are an
    error, as is any other key that is left twice. A table without types is picked by period alone."""
    typed = "report_type" in landed.columns
    picked = dedup.newest_version(universe.keep_listed(landed, companies, "end_date"), by_type=typed).drop("ordinal")
    group = ["ts_code", "end_date"] + ["report_type"] * typed
    return require_unique(dedup.merge_types(picked) if typed else picked, group)


def load_reports(landed: DataFrame, stored: DataFrame, companies: DataFrame, model: list[str], json_column: str) -> DataFrame:
    """Landed reports with their diff_class: the newest version of each, other columns packed as JSON, matched by the
    table's key, all columns compared."""
    packed = pack_overflow(newest_reports(landed, companies), model, json_column)
    keys = STATEMENT_KEYS if "report_type" in packed.columns else INDICATOR_KEYS
    compare = [c for c in packed.columns if c not in keys]
    return merge.classify(packed, stored, keys, compare, json_columns=(json_column,))


def load_reports_into(path: str, landed: DataFrame, companies: DataFrame, contract: Contract, json_column: str) -> DataFrame:
    """Load landed reports into the stored table of `contract`: the newest version of each, columns that the table lacks
    packed as JSON, matched by the table's key (a null key is a blank one), whole rows compared. Returns the number of rows
    by diff_class. Reports of other versions that are stored already stay."""
    model = [f.name for f in contract.schema.fields if f.name != json_column]
    packed = pack_overflow(newest_reports(landed, companies), model, json_column)
    return load_into(path, packed, contract, json_columns=(json_column,))
