"""Panel sources: Parquet scans, the prepared panel, and adapters for star-schema tables.

A panel has one row per (entity, trade_date); ``trade_date`` is ``YYYYMMDD`` text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from panelforge.functions.scalar import fixed, missing_if_nan
from panelforge.operators.series import led
from panelforge.session import broadcast_checked, path_exists

# Executors receive these helpers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ("entity", "trade_date")
# Rows that a task combines at a time.
COMBINED = 500_000
# Status columns that are never features.
STATUS_COLUMNS = (
    "is_basic_missing",
    "is_moneyflow_missing",
    "is_tech_warmup",
    "is_recent_listing",
    "valid_feature_ratio",
    "valuation_missing_count",
    "is_loss_or_pe_missing",
)


def normalise(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, once, at load."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            missing_if_nan(F.col(f.name)).alias(f.name) if isinstance(f.dataType, floats) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def feature_columns(available: Iterable[str], excluded: Iterable[str] = STATUS_COLUMNS) -> list[str]:
    dropped = set(excluded)
    return [name for name in available if name not in dropped]


def read_feature_list(spark: SparkSession, path: str, excluded: Iterable[str] = STATUS_COLUMNS) -> list[str]:
    """Feature names of a ``{"feature_columns": [...]}`` document, in order."""
    meta = spark.read.json(path, schema="feature_columns array<string>", multiLine=True)
    return feature_columns(meta.first()[0], excluded)


def scan(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Projected Parquet scan; repeated names are read once."""
    return spark.read.parquet(path).select(*dict.fromkeys(columns))


def load_panel(
    spark: SparkSession,
    path: str,
    start: str | None = None,
    end: str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Date-bounded, projected scan of a prepared panel; both bounds are inclusive."""
    df = spark.read.parquet(path)
    by_month = "month" in df.columns  # partition column of a prepared panel
    for bound, compare in ((start, "__ge__"), (end, "__le__")):
        if bound is not None:
            df = df.where(getattr(F.col("trade_date"), compare)(F.lit(bound)))
            if by_month:
                df = df.where(getattr(F.col("month").cast("string"), compare)(F.lit(bound[:6])))
    if columns is not None:
        df = df.select(*dict.fromkeys([*KEYS, *columns]))
    return normalise(df.withColumn("trade_date", F.col("trade_date").cast("string")))


def duplicate_keys(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def require_unique(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``df`` with a guard in its plan: the job that reads it fails at the first repeated key.

    Rows are counted per key behind an exchange and a sort by the keys, which a join or window on
    the same keys takes over, so the guard costs neither a job nor a shuffle of its own.
    """
    copies = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    named = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys])
    clash = F.raise_error(F.concat(F.lit("duplicate key "), named, F.lit(" ("), F.col("__copies").cast("string"), F.lit(" rows)")))
    return df.withColumn("__copies", copies).where(F.when(F.col("__copies") > 1, clash).otherwise(F.lit(True))).drop("__copies")


def with_forward_return(prices: DataFrame, price: str, horizon: int, out: str = "future_ret") -> DataFrame:
    """Return over the entity's next ``horizon`` rows; NULL for its last rows."""
    now, later = F.col(price), led(F.col(price), horizon)
    return prices.withColumn(out, F.when(now != 0, later / now - F.lit(1.0)))


def join_panel(features: DataFrame, prices: DataFrame, *, check: bool = True) -> DataFrame:
    """Inner join on the panel key; repeated keys on either side fail the job that reads it."""
    if check:
        features, prices = require_unique(features), require_unique(prices)
    return features.join(prices, list(KEYS), "inner")


def prepare_panel(
    features: DataFrame,
    prices: DataFrame,
    price: str,
    horizon: int,
    label: str = "future_ret",
    *,
    check: bool = True,
) -> DataFrame:
    """Features joined to price and forward return."""
    priced = with_forward_return(prices.select(*KEYS, price), price, horizon, label)
    joined = join_panel(normalise(features), normalise(priced), check=check)
    return joined.withColumn("trade_date", F.col("trade_date").cast("string"))


def build_or_reuse(spark: SparkSession, path: str, build, *, force: bool = False) -> DataFrame:
    """Read the prepared panel at ``path``; build and write it when absent or ``force``.

    Laid out by month, so a date range reads only the months it touches. The rebalance hint
    lets AQE split a month holding much of the data over many tasks and merge small ones.
    """
    ready = path_exists(spark, f"{path}/_SUCCESS")
    if force or not ready:
        df = build().withColumn("month", F.substring("trade_date", 1, 6))
        rebalanced = df.hint("rebalance", "month").sortWithinPartitions("month", *reversed(KEYS))
        rebalanced.write.mode("overwrite").partitionBy("month").parquet(path)
    return spark.read.option("basePath", path).parquet(path)


# --- adapters: star-schema tables to panels ---------------------------------------------


def _exact_sum(column: str, scale: int = 2):
    """Sum in DECIMAL, so the result does not depend on the order of rows."""
    return F.sum(F.col(column).cast(f"decimal(18,{scale})")).cast("double")


def _hundredths(column: str, scale: int = 2):
    """As :func:`_exact_sum` with a whole number per group in place of a decimal of 28 digits.

    Exact for amounts below 2**52 units of the last place.
    """
    unit = float(10**scale)
    return F.sum(F.rint(F.col(column).cast(f"decimal(18,{scale})").cast("double") * F.lit(unit)).cast("bigint")) / F.lit(unit)


def _trade_panel(lines: DataFrame, entity: str, unit: str) -> DataFrame:
    """Rows per entity and period. A scan task may hold as many groups as it reads lines, so keys and
    sums are numbers of eight bytes and become text per group, after the exchange."""
    n = F.count("*").cast("double")
    grouped = lines.groupBy(F.col(entity).alias("__entity"), F.date_trunc(unit, "l_shipdate").alias("__period")).agg(
        _hundredths("l_quantity").alias("qty"),
        _hundredths("l_extendedprice").alias("rev"),
        _hundredths("l_discount", 4).alias("__disc"),
        _hundredths("l_tax", 4).alias("__tax"),
        n.alias("n_lines"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("double").alias("__ret"),
    )
    return grouped.select(*_trade_columns())


def _trade_columns() -> list:
    """Panel columns over the sums of a group."""
    return [
        F.col("__entity").cast("string").alias("entity"),
        F.date_format("__period", "yyyyMMdd").alias("trade_date"),
        fixed(F.col("rev") / F.col("qty"), 6).alias("px"),
        F.col("qty"),
        F.col("rev"),
        F.when(F.col("n_lines") > 1, fixed(F.col("__disc") / F.col("n_lines"), 6)).alias("disc"),
        fixed(F.col("__tax") / F.col("n_lines"), 6).alias("tax"),
        F.col("n_lines"),
        fixed(F.col("__ret") / F.col("n_lines"), 6).alias("ret_share"),
    ]


def _combined(rows: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums per key of up to ``COMBINED`` rows of a task at a time: what an exchange by a part of the keys carries."""
    columns = [*keys, *sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add(held):
            found = pa.Table.from_batches(held).group_by(list(keys)).aggregate([(c, "sum") for c in sums])
            found = found.rename_columns([c.removesuffix("_sum") for c in found.column_names]).select(columns)
            return found.sort_by([(k, "ascending") for k in keys]).to_batches()  # neighbours are alike, so the exchange packs well

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= COMBINED:
                yield from add(held)
                held, size = [], 0
        if size:
            yield from add(held)

    return rows.select(*columns).mapInArrow(run, rows.select(*columns).schema)


def trade_panel_ahead(lines: DataFrame, entity: str, unit: str, horizon: int, label: str) -> DataFrame:
    """:func:`_trade_panel` with the forward return of ``px`` as ``label``, rounded to six digits.

    One exchange by entity serves the sums and the series. Lines are combined before it, so a large
    entity sends its groups and not its lines.
    """
    cents = lambda c, scale: F.rint(F.col(c).cast(f"decimal(18,{scale})").cast("double") * F.lit(float(10**scale))).cast("bigint")
    units = {"qty": ("l_quantity", 2), "rev": ("l_extendedprice", 2), "__disc": ("l_discount", 4), "__tax": ("l_tax", 4)}
    rows = lines.select(
        F.col(entity).alias("__entity"),
        F.date_trunc(unit, "l_shipdate").alias("__period"),
        *[cents(c, scale).alias(out) for out, (c, scale) in units.items()],
        F.lit(1).cast("bigint").alias("n_lines"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("bigint").alias("__ret"),
    )
    keys = ["__entity", "__period"]
    dealt = _combined(rows, keys, [*units, "n_lines", "__ret"]).repartition("__entity")
    grouped = dealt.groupBy(*keys).agg(
        *[(F.sum(out) / F.lit(float(10**scale))).alias(out) for out, (_, scale) in units.items()],
        *[F.sum(c).cast("double").alias(c) for c in ("n_lines", "__ret")],
    )
    columns = grouped.select(*keys, *_trade_columns())
    now, later = F.col("px"), F.lead("px", horizon).over(Window.partitionBy("__entity").orderBy("__period"))
    ahead = columns.withColumn(label, F.when(now != 0, later / now - F.lit(1.0))).drop(*keys)
    return ahead.withColumn(label, fixed(F.col(label), 6))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/lineitem.parquet")


def _week(ts: str):
    return F.date_format(F.date_trunc("week", ts), "yyyyMMdd")


def supplier_week(spark: SparkSession, folder: str) -> DataFrame:
    """Main panel: supplier × week (Monday) of the ship date."""
    return _trade_panel(_lines(spark, folder), "l_suppkey", "week")


def supplier_month(spark: SparkSession, folder: str) -> DataFrame:
    return _trade_panel(_lines(spark, folder), "l_suppkey", "month")


def part_week(spark: SparkSession, folder: str) -> DataFrame:
    """Gappy panel: most parts miss most weeks."""
    return _trade_panel(_lines(spark, folder), "l_partkey", "week")


def supplier_week_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Open, high, low and close unit price plus buy and sell amounts per supplier-week."""
    lines = _lines(spark, folder)
    unit = fixed(F.col("l_extendedprice") / F.col("l_quantity"), 6)
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", unit)
    amount = F.col("l_extendedprice").cast("decimal(18,2)")
    return lines.groupBy(
        F.col("l_suppkey").cast("string").alias("entity"), _week("l_shipdate").alias("trade_date")
    ).agg(
        F.min_by(unit, order).alias("open"),
        F.max(unit).alias("high"),
        F.min(unit).alias("low"),
        F.max_by(unit, order).alias("close"),
        _exact_sum("l_quantity").alias("volume"),
        _exact_sum("l_extendedprice").alias("amount"),
        F.coalesce(F.sum(F.when(F.col("l_returnflag") == "A", amount)).cast("double"), F.lit(0.0)).alias("buy"),
        F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", amount)).cast("double"), F.lit(0.0)).alias("sell"),
    )


def supplier_week_ahead(spark: SparkSession, folder: str, horizon: int, label: str, *, entities: DataFrame | None = None) -> DataFrame:
    """Main panel with its forward return; with ``entities``, one column of names, the whole series of those only."""
    lines = _lines(spark, folder)
    if entities is not None:
        named = F.col("l_suppkey").cast("string").eqNullSafe(F.col(entities.columns[0]))
        lines = lines.join(broadcast_checked(entities), named, "left_semi")
    return trade_panel_ahead(lines, "l_suppkey", "week", horizon, label)


def user_day(spark: SparkSession, folder: str) -> DataFrame:
    """Second domain: user × day of the event stream."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.groupBy(
        F.col("user_id").cast("string").alias("entity"), F.date_format("ts", "yyyyMMdd").alias("trade_date")
    ).agg(
        F.count("*").cast("double").alias("n_events"),
        F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"),
        F.countDistinct("event_type").cast("double").alias("kinds"),
    )
