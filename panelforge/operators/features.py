"""Feature construction on panels with open/high/low/close and amount columns.

Oscillators and bands (MACD, RSI, KDJ, CCI, Bollinger) arrive as input columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.operators.ranks import average_rank
from panelforge.operators.series import lagged, rolling_sum

RANK_SUFFIX = "_rank_cs"


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 or missing."""
    return F.when(b != 0, a / b)


def past_return(price: Column, rows: int) -> Column:
    return ratio(price, lagged(price, rows)) - F.lit(1.0)


def with_cross_section_ranks(df: DataFrame, columns: Sequence[str], *, widest: int | None = None) -> DataFrame:
    """Add ``<column>_rank_cs``: average-tie percentile rank per date."""
    for name in columns:
        df = average_rank(df, ["trade_date"], name, f"{name}{RANK_SUFFIX}", widest=widest)
    return df


def bar_shape(open_: Column, high: Column, low: Column, close: Column) -> dict[str, Column]:
    return {
        "intraday_ret": ratio(close, open_) - F.lit(1.0),
        "lower_shadow": ratio(F.when(open_.isNotNull() & close.isNotNull(), F.least(open_, close)), low) - F.lit(1.0),
        "high_low_range": ratio(high, low) - F.lit(1.0),
    }


def band_features(upper: Column, middle: Column, lower: Column, close: Column) -> dict[str, Column]:
    return {
        "boll_width": ratio(upper - lower, middle),
        "boll_position": ratio(close - lower, upper - lower),
    }


def flow_features(buy: Column, sell: Column, amount: Column) -> dict[str, Column]:
    return {
        "net_amount_ratio": ratio(buy - sell, amount),
        "buy_amount_ratio": ratio(buy, amount),
        "sell_amount_ratio": ratio(sell, amount),
    }


def turnover_rate(volume: Column, shares: Column) -> Column:
    return ratio(volume, shares)


def with_rolling_sum(df: DataFrame, column: str, rows: int = 5) -> DataFrame:
    return df.withColumn(f"{column}_{rows}d", rolling_sum(F.col(column), rows))


def with_liquidity(df: DataFrame, market_value: str, turnover: str, *, widest: int | None = None) -> DataFrame:
    """liquidity_rank_cs: rank per date of market value × turnover."""
    df = df.withColumn("__liquidity", F.col(market_value) * F.col(turnover))
    return average_rank(df, ["trade_date"], "__liquidity", f"liquidity{RANK_SUFFIX}", widest=widest).drop("__liquidity")


def fill_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing ranks become 0.5, other missing features 0."""
    return df.na.fill({f: 0.5 if f.endswith(RANK_SUFFIX) else 0.0 for f in features})
