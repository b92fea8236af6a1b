"""Table contracts: key, columns and types, and the projections onto them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import text


@dataclass(frozen=True)
class Contract:
    """`columns` is a DDL list; text columns in the key default to '' when absent, everything else to null.

    `dates` are the columns that hold days: they are stored as 8 digits. `day` is the one that a row must have. `renames` are
    names that a vendor gives columns, `upper` texts that are stored in capitals, `allowed` the values that rows may have.
    """

    name: str
    key: tuple[str, ...]
    columns: str
    day: str = "trade_date"
    dates: tuple[str, ...] = ("trade_date",)
    renames: tuple[tuple[str, str], ...] = ()
    upper: tuple[str, ...] = ()
    allowed: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.columns)


# Column names of the landed tables.
KLINE_DAILY = Contract(
    "kline_daily",
    ("ts_code", "trade_date"),
    "ts_code string, trade_date string, "
    "open double, high double, low double, close double, pre_close double, change double, pct_chg double, "
    "vol double, amount double, adj_factor double, up_limit double, down_limit double",
)
FACTOR = Contract("factor", ("ts_code", "trade_date"), "ts_code string, trade_date string, value double")
BLOCK_TRADE = Contract(
    "market_block_trade",
    ("ts_code", "trade_date", "buyer", "seller"),
    "ts_code string, trade_date string, buyer string, seller string, price double, vol double, amount double",
)
REPORT_INCOME = Contract(
    "financial_report_income",
    ("ts_code", "end_date", "f_ann_date", "report_type", "update_flag"),
    "ts_code string, ann_date string, f_ann_date string, end_date string, report_type string, update_flag string, "
    "total_revenue double, income_table string",
    "end_date",
    ("ann_date", "f_ann_date", "end_date"),
)
SNAPSHOT = Contract(
    "completeness_snapshot",
    ("source_name", "date_key"),
    "source_name string, date_key string, period_stock_count bigint, resolved_count bigint",
    "date_key",
    (),
)
LOG_MISSING = Contract(
    "log_missing",
    ("ts_code", "missing_entity", "missing_date"),
    "ts_code string, missing_entity string, missing_date string, try_count int, last_try_time timestamp",
    "missing_date",
    ("missing_date",),
)


def conform(df: DataFrame, contract: Contract) -> DataFrame:
    """The contract's columns in order and type; absent ones become null ('' in a text key), unknown ones go.

    Each is normalised by its kind first: days lose their dashes, numbers that are no finite number become null, texts
    that stand for nothing become '' in the key and null elsewhere. Rows without a day go.
    """
    df = df.withColumnsRenamed({s: t for s, t in contract.renames if s in df.columns and t not in df.columns})
    cols: list[Column] = []
    for f in contract.schema.fields:
        if f.name in df.columns:
            cols.append(_normal(F.col(f.name), f, contract).alias(f.name))
        else:
            blank = F.lit("") if f.name in contract.key and isinstance(f.dataType, T.StringType) else F.lit(None)
            cols.append(blank.cast(f.dataType).alias(f.name))
    day = F.length(contract.day)
    out = df.select(*cols).where(day == 8 if contract.day in contract.dates else day > 0)
    for c, values in contract.allowed:
        out = out.where(F.col(c).isin(*values))
    return out


def _normal(c: Column, f: T.StructField, contract: Contract) -> Column:
    if f.name in contract.dates:
        day = text.date_key(c)
        return day if f.name in contract.key else F.when(day != "", day)
    if isinstance(f.dataType, T.DoubleType):
        return text.number(c)
    if isinstance(f.dataType, T.StringType):
        s = text.blank_text(c)
        s = F.upper(s) if f.name in contract.upper else s
        return s if f.name in contract.key else F.when(s != "", s)
    return c.try_cast(f.dataType)


def rename(df: DataFrame, mapping: dict[str, str], keep_rest: bool = True) -> DataFrame:
    """Rename the mapped columns that exist; keep the others or drop them."""
    have = {s: t for s, t in mapping.items() if s in df.columns}
    out = df.withColumnsRenamed(have)
    return out if keep_rest else out.select(*[have[c] for c in df.columns if c in have])


def usable(df: DataFrame, required: list[str]) -> bool:
    """A landed result that can be loaded: it has the required columns and at least one row."""
    return all(c in df.columns for c in required) and not df.isEmpty()


def to_double(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every non-key column as double."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in df.columns if c not in keys])


def length_offenders(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Columns with text longer than declared: one aggregate, one row per offending column."""
    aggs = []
    for c, n in limits.items():
        over = F.length(c) > n
        aggs += [F.max(F.length(c)).alias(f"{c}|len"), F.count_if(over).alias(f"{c}|n"), F.min(F.when(over, F.col(c))).alias(f"{c}|ex")]
    row = df.agg(*aggs)
    per_col = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(n).alias("declared"),
                F.col(f"`{c}|len`").alias("longest"),
                F.col(f"`{c}|n`").cast("bigint").alias("n_rows"),
                F.col(f"`{c}|ex`").alias("example"),
            )
            for c, n in limits.items()
        ]
    )
    return row.select(F.explode(per_col).alias("o")).select("o.*").where("n_rows > 0")


def require_lengths(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """`df` itself, or an error that lists the offending columns."""
    bad = length_offenders(df, limits).collect()  # at most one row per checked column
    if bad:
        raise ValueError("text too long: " + "; ".join(f"{r.column_name} {r.longest}>{r.declared} ({r.n_rows} rows)" for r in bad))
    return df
