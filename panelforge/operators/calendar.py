"""Trading calendar: one row per date with its position.

Dates are ``YYYYMMDD`` text, so a calendar has at most 366 rows per year and every table
keyed by date alone is small; the counts measured by :func:`measure` check this.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from panelforge.session import broadcast_within


@dataclass(frozen=True)
class PanelShape:
    """Measured bounds of a panel; joins and windows are planned from these."""

    rows: int
    dates: int
    widest: int


def measure(panel: DataFrame) -> PanelShape:
    """One narrow pass: count per date (combined map-side), then three totals."""
    total = panel.groupBy("trade_date").count().agg(
        F.sum("count"), F.count("*"), F.max("count")
    ).first()
    return PanelShape(int(total[0] or 0), int(total[1]), int(total[2] or 0))


def trading_calendar(panel: DataFrame) -> DataFrame:
    """(trade_date, position) with position 0 for the first date."""
    dates = panel.select("trade_date").distinct()
    # Number within the year first, so no window spans the whole calendar.
    year = F.substring("trade_date", 1, 4)
    local = dates.withColumn("year", year).withColumn(
        "in_year", F.row_number().over(Window.partitionBy("year").orderBy("trade_date"))
    )
    years = dates.groupBy(year.alias("year")).agg(F.count("*").alias("days"))
    before = years.select(
        "year", (F.sum("days").over(Window.orderBy("year")) - F.col("days")).alias("before")
    )
    return local.join(F.broadcast(before), "year").select(
        "trade_date", (F.col("before") + F.col("in_year") - 1).cast("int").alias("position")
    )


def with_position(df: DataFrame, calendar: DataFrame, shape: PanelShape) -> DataFrame:
    """Attach the date's position; the calendar is broadcast within its counted size."""
    return df.join(broadcast_within(calendar, shape.dates), "trade_date")


def in_dates(df: DataFrame, dates: DataFrame, shape: PanelShape) -> DataFrame:
    """Keep rows whose date is in ``dates`` (semi join)."""
    return df.join(broadcast_within(dates.select("trade_date"), shape.dates), "trade_date", "left_semi")


def required_range(calendar: DataFrame, start: str, end: str, *, horizon: int, lookback: int) -> DataFrame:
    """One row (first_date, last_date): what a walk-forward over [start, end] can read."""
    bounds = calendar.where(F.col("trade_date").between(start, end)).agg(
        F.min("position").alias("from_position"), F.max("trade_date").alias("last_date")
    )
    return (
        calendar.crossJoin(F.broadcast(bounds))
        .where(F.col("position") >= F.greatest(F.lit(0), F.col("from_position") - horizon - lookback))
        .groupBy("last_date")
        .agg(F.min("trade_date").alias("first_date"))
        .select("first_date", "last_date")
    )


def prune_dates(df: DataFrame, calendar: DataFrame, start: str, end: str, *, horizon: int, lookback: int) -> DataFrame:
    """Drop dates no window needs. The two bounds are read from the calendar and become
    literals: on a panel read with ``trade_date`` as a column they reach the Parquet scan, and on
    one laid out by ``month`` other months are not listed."""
    span = required_range(calendar, start, end, horizon=horizon, lookback=lookback).first()
    if "month" in df.columns:
        df = df.where(F.col("month").cast("string").between(span.first_date[:6], span.last_date[:6]))
    return df.where(F.col("trade_date").between(span.first_date, span.last_date))
