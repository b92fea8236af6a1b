"""Row-wise functions: arithmetic with this domain's null rules, price fields, costs, classes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.rolling import delay


def log(x: Column) -> Column:
    """Natural logarithm; null for zero and below."""
    return F.when(x > 0, F.ln(x))


def sign(x: Column) -> Column:
    """-1, 0 or 1; a null gives 0."""
    return F.when(x > 0, F.lit(1.0)).when(x < 0, F.lit(-1.0)).otherwise(F.lit(0.0))


def where(cond: Column, a: Column, b: Column) -> Column:
    """a where cond holds, else b; a null condition takes b."""
    return F.when(cond, a).otherwise(b)


def both(a: Column, b: Column) -> Column:
    return ((a != 0) & (b != 0)).cast("double")


def either(a: Column, b: Column) -> Column:
    return ((a != 0) | (b != 0)).cast("double")


def keep_if(x: Column, cond: Column) -> Column:
    return F.when(cond, x)


def adjusted(price: Column, adj_factor: Column) -> Column:
    return price * F.coalesce(adj_factor, F.lit(1.0))


def vwap(amount: Column, vol: Column) -> Column:
    return F.when(vol > 0, amount * 10.0 / vol)


def directional(open_: Column, high: Column, low: Column, close: Column) -> dict[str, Column]:
    """Directional moves and the true range of one code's bars. The first bar has no previous one: its maxima
    are taken over the terms that exist."""
    prev_open, prev_high, prev_low, prev_close = (delay(c, 1) for c in (open_, high, low, close))
    return {
        "dtm": F.when(open_ <= prev_open, F.lit(0.0)).otherwise(F.greatest(high - open_, open_ - prev_open)),
        "dbm": F.when(open_ >= prev_open, F.lit(0.0)).otherwise(F.greatest(open_ - low, open_ - prev_open)),
        "hd": F.greatest(prev_high - high, F.lit(0.0)),
        "ld": F.greatest(prev_low - low, F.lit(0.0)),
        "tr": F.greatest(high - low, F.abs(high - prev_close), F.abs(low - prev_close)),
    }


def limit_hit(close: Column, up: Column, down: Column) -> Column:
    """True at or next to a price limit; a null close is never blocked."""
    return F.coalesce(close >= up * 0.999, F.lit(False)) | F.coalesce(close <= down * 1.001, F.lit(False))


@dataclass(frozen=True)
class CostRates:
    """Commission on both sides, stamp duty on sells, slippage."""

    commission: float = 0.0003
    stamp_duty: float = 0.001
    slippage: float = 0.0


def trade_cost(delta_weight: Column, rates: CostRates = CostRates()) -> Column:
    """Cost of one trade; a negative change is a sale."""
    n = F.abs(delta_weight)
    base = n * (rates.commission + rates.slippage)
    return F.when(delta_weight < 0, base + n * rates.stamp_duty).otherwise(base)


def group_cost(buys: Column, sells: Column, rates: CostRates = CostRates()) -> Column:
    """Cost of a group's summed buys and sells."""
    return trade_cost(buys, rates) + trade_cost(-sells, rates)


def is_b_share(ts_code: Column) -> Column:
    return (F.length(ts_code) >= 6) & (ts_code.startswith("9009") | ts_code.startswith("200"))


# Board labels by exchange suffix and code prefix.
BOARDS = {
    "SH": [(("688",), "科创板(688)"), (("600", "601", "603", "605"), "沪主板(60x)"), (("900",), "沪B股(900)")],
    "SZ": [
        (("300", "301"), "创业板(300/301)"),
        (("000", "001"), "深主板(000/001)"),
        (("002", "003"), "中小板(002/003)"),
        (("200",), "深B股(200)"),
    ],
    "BJ": [(("",), "北交所(BJ)")],
}
BOARD_REST = {"SH": "沪其他", "SZ": "深其他"}


def board(ts_code: Column) -> Column:
    """Board label of a code; unknown prefixes are labelled by exchange and prefix."""
    head, tail = F.substring_index(ts_code, ".", 1), F.substring_index(ts_code, ".", -1)
    label = F.when(F.coalesce(F.instr(ts_code, ".") == 0, F.lit(True)), F.lit("未知"))
    for exchange, rows in BOARDS.items():
        for prefixes, name in rows:
            label = label.when((tail == exchange) & F.substring(head, 1, len(prefixes[0])).isin(*prefixes), F.lit(name))
        if exchange in BOARD_REST:
            rest = F.concat(F.lit(BOARD_REST[exchange] + "("), F.substring(head, 1, 3), F.lit(")"))
            label = label.when(tail == exchange, rest)
    return label.otherwise(F.concat(tail, F.lit("其他")))


# Vendor factor names by category.
FUNDAMENTAL_FACTORS = (
    "turnover_rate",
    "turnover_rate_f",
    "volume_ratio",
    "pe",
    "pe_ttm",
    "pb",
    "ps",
    "ps_ttm",
    "dv_ratio",
    "dv_ttm",
    "total_share",
    "float_share",
    "free_share",
    "total_mv",
    "circ_mv",
)
STREAK_RENAMES = {
    "downdays": "down_streak",
    "updays": "up_streak",
    "lowdays": "low_period",
    "topdays": "high_period",
}
CATEGORY_LABELS = {"fundamental": "基本面", "statistic": "统计", "technical": "技术"}


def factor_category(name: Column) -> Column:
    """Category of a vendor factor by its name."""
    return (
        F.when(name.isin(*FUNDAMENTAL_FACTORS), F.lit(CATEGORY_LABELS["fundamental"]))
        .when(name.isin(*STREAK_RENAMES), F.lit(CATEGORY_LABELS["statistic"]))
        .otherwise(F.lit(CATEGORY_LABELS["technical"]))
    )


def vendor_name(name: str) -> str:
    """Local column name of a vendor factor: the adjusted-price mark goes, four streak fields are renamed."""
    return STREAK_RENAMES.get(name, re.sub(r"_hfq(?=_|$)", "", name))


def delisted_name(name: Column, fullname: Column) -> Column:
    """True where a name carries the delisting mark."""
    hit = [F.coalesce(c.contains(m), F.lit(False)) for c in (name, fullname) for m in ("(退)", "（退）")]
    return hit[0] | hit[1] | hit[2] | hit[3]
