"""Ranks, series windows, scalar functions, labels and samples."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from panelforge.catalog.base import (
    CALENDAR_SQL, EDGES, END, HORIZON, K, LABEL, LABELLED_SQL, MAIN_SQL, PANEL_SQL, SERIES, START, avg_rank_sql,
    fixed_sql, labelled_panel, main_calendar, main_panel, main_shape, ordinal_sql, pearson_sql, r, register, rounded,
    temporal_sql, with_sql,
)
from panelforge.functions import scalar
from panelforge.operators import calendar as cal
from panelforge.operators import labels as lab
from panelforge.operators.aggregates import pearson
from panelforge.operators.ranks import average_rank, ordinal_rank, top_rows
from panelforge.operators.series import TEMPORAL, temporal_column, with_temporals
from panelforge.sources import panel as sources

DATE = ["trade_date"]


def _ranked(spark, folder, fn, value, **options):
    panel = main_panel(spark, folder).select("entity", "trade_date", value)
    return fn(panel, DATE, value, "rank", widest=main_shape(spark, folder).widest, **options)


# --- E: ranks ----------------------------------------------------------------------------


@register("rank_pct_average", with_sql(PANEL_SQL, select=f"SELECT entity, trade_date, disc, {avg_rank_sql('disc', 'trade_date')} AS rank FROM panel"))
def rank_pct_average(spark, folder):
    return _ranked(spark, folder, average_rank, "disc")


@register("rank_pct_first", with_sql(PANEL_SQL, select=f"SELECT entity, trade_date, ret_share, {ordinal_sql('ret_share', 'trade_date', pct=True)} AS rank FROM panel"))
def rank_pct_first(spark, folder):
    return _ranked(spark, folder, ordinal_rank, "ret_share", pct=True)


@register("rank_position_descending", with_sql(PANEL_SQL, select=f"SELECT entity, trade_date, disc, CAST({ordinal_sql('disc', 'trade_date', descending=True)} AS BIGINT) AS rank FROM panel"))
def rank_position_descending(spark, folder):
    return _ranked(spark, folder, ordinal_rank, "disc", descending=True).withColumn("rank", F.col("rank").cast("long"))


@register("rank_absolute_average", with_sql(PANEL_SQL, select=f"SELECT entity, trade_date, n_lines, {avg_rank_sql('n_lines', 'trade_date', pct=False)} AS rank FROM panel"))
def rank_absolute_average(spark, folder):
    return _ranked(spark, folder, average_rank, "n_lines", pct=False)


def _sliced(spark, folder, fn, **options):
    """The same rank through the path for groups too large for one task."""
    panel = main_panel(spark, folder).select("entity", "trade_date", "disc")
    old = spark.conf.get("spark.panelforge.maxGroupRows", None)
    spark.conf.set("spark.panelforge.maxGroupRows", "20")
    try:
        return fn(panel, DATE, "disc", "rank", **options)
    finally:
        spark.conf.unset("spark.panelforge.maxGroupRows") if old is None else spark.conf.set("spark.panelforge.maxGroupRows", old)


@register("rank_average_sliced_groups", with_sql(PANEL_SQL, select=f"SELECT entity, trade_date, disc, {avg_rank_sql('disc', 'trade_date')} AS rank FROM panel"))
def rank_average_sliced_groups(spark, folder):
    return _sliced(spark, folder, average_rank)


@register("rank_ordinal_sliced_groups", with_sql(PANEL_SQL, select=f"SELECT entity, trade_date, disc, CAST({ordinal_sql('disc', 'trade_date', descending=True)} AS BIGINT) AS rank FROM panel"))
def rank_ordinal_sliced_groups(spark, folder):
    return _sliced(spark, folder, ordinal_rank, descending=True).withColumn("rank", F.col("rank").cast("long"))


@register("lead_lag_rows", with_sql(PANEL_SQL, select=f"SELECT entity, trade_date, lead(px, {HORIZON}) OVER ({SERIES}) AS ahead, lag(px, 1) OVER ({SERIES}) AS back1, lag(px, 3) OVER ({SERIES}) AS back3, lag(px, 4) OVER ({SERIES}) AS back4, lag(px, 5) OVER ({SERIES}) AS back5 FROM panel"))
def lead_lag_rows(spark, folder):
    from panelforge.operators.series import lagged, led

    px = F.col("px")
    return main_panel(spark, folder).select(
        "entity", "trade_date", led(px, HORIZON).alias("ahead"), *[lagged(px, n).alias(f"back{n}") for n in (1, 3, 4, 5)]
    )


@register(
    "rolling_two_months",
    with_sql(
        MAIN_SQL, f"m AS (SELECT substr(trade_date, 1, 6) AS month, round(avg({LABEL}), 9) AS score, count({LABEL}) AS n FROM main GROUP BY 1 HAVING count({LABEL}) >= 300)",
        select="SELECT month, CASE WHEN count(score) OVER w = 2 THEN round(avg(score) OVER w, 8) + 0e0 END AS pair FROM m WINDOW w AS (ORDER BY month ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)",
    ),
)
def rolling_two_months(spark, folder):
    """Pairs adjacent qualifying months; the month table is calendar-sized."""
    months = main_panel(spark, folder).groupBy(F.substring("trade_date", 1, 6).alias("month")).agg(
        F.round(F.avg(LABEL), 9).alias("score"), F.count(LABEL).alias("n")
    ).where("n >= 300")
    w = Window.orderBy("month").rowsBetween(-1, 0)
    return months.select("month", F.when(F.count("score").over(w) == 2, r(F.avg("score").over(w), 8)).alias("pair"))


@register("date_index", with_sql(PANEL_SQL, CALENDAR_SQL, select="SELECT entity, p.trade_date, position FROM panel p JOIN cal USING (trade_date)"))
def date_index(spark, folder):
    panel = main_panel(spark, folder).select("entity", "trade_date")
    return cal.with_position(panel, main_calendar(spark, folder), main_shape(spark, folder))


@register("age_index", with_sql(PANEL_SQL, CALENDAR_SQL, select="SELECT trade_date, (SELECT max(position) FROM cal) - position AS age FROM cal"))
def age_index(spark, folder):
    calendar = main_calendar(spark, folder)
    newest = calendar.agg(F.max("position").alias("newest"))
    return calendar.crossJoin(F.broadcast(newest)).select("trade_date", (F.col("newest") - F.col("position")).alias("age"))


@register("head_by_hash", with_sql(PANEL_SQL, select="SELECT entity, trade_date, CAST(r AS BIGINT) AS position FROM (SELECT entity, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY md5('42:' || entity), entity) AS r FROM panel) WHERE r <= 5"))
def head_by_hash(spark, folder):
    keyed = main_panel(spark, folder).select("entity", "trade_date", scalar.seeded_hash(F.col("entity"), 42).alias("h"))
    return top_rows(keyed, DATE, [F.asc("h"), F.asc("entity")], 5).select(
        "entity", "trade_date", F.col("position").cast("long").alias("position")
    )


# --- F: temporal operators ---------------------------------------------------------------


def _temporal_query(op):
    # Sums of five rounded inputs end after seven decimals; irrational results need slack.
    digits = 6 if op in ("std_20", "zscore_20", "ts_rank_20") else 9
    sql = with_sql(
        PANEL_SQL,
        select=f"SELECT entity, trade_date, round({temporal_sql(op, 'px')}, {digits}) + 0e0 AS px_value, round({temporal_sql(op, 'disc')}, 9) + 0e0 AS disc_value FROM panel",
    )

    @register(f"temporal_{op}", sql)
    def run(spark, folder):
        df = with_temporals(main_panel(spark, folder).select("entity", "trade_date", "px", "disc"), [(op, "px"), (op, "disc")])
        return df.select(
            "entity", "trade_date", r(temporal_column(op, "px"), digits).alias("px_value"),
            r(temporal_column(op, "disc"), 9).alias("disc_value"),
        )

    return run


for _op in TEMPORAL:
    _temporal_query(_op)


# --- G: top rows -------------------------------------------------------------------------


@register("top_months_by_entity", with_sql(MAIN_SQL, f"m AS (SELECT entity, substr(trade_date, 1, 6) AS month, round(abs(avg({LABEL})), 9) + 0e0 AS score FROM main WHERE {LABEL} IS NOT NULL GROUP BY 1, 2)", select="SELECT entity, month, score, CAST(r AS BIGINT) AS month_rank FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, month ASC) AS r FROM m) WHERE r <= 3"))
def top_months_by_entity(spark, folder):
    from panelforge.operators.quality import top_months

    months = main_panel(spark, folder).where(F.col(LABEL).isNotNull()).groupBy(
        F.col("entity").alias("factor"), F.substring("trade_date", 1, 6).alias("month")
    ).agg(r(F.abs(F.avg(LABEL)), 9).alias("score"))
    top = top_months(months, "score", 3)
    return top.select(F.col("factor").alias("entity"), "month", "score", F.col("month_rank").cast("long").alias("month_rank"))


@register(
    "top_bottom_by_date",
    with_sql(PANEL_SQL, select=f"""SELECT trade_date, entity, rev, 'top' AS side, CAST(p AS BIGINT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY rev DESC, entity) AS p FROM panel) WHERE p <= {K}
UNION ALL SELECT trade_date, entity, rev, 'bottom' AS side, CAST(p AS BIGINT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY rev ASC, entity) AS p FROM panel) WHERE p <= {K}"""),
)
def top_bottom_by_date(spark, folder):
    """Each side is limited before its shuffle."""
    panel = main_panel(spark, folder).select("trade_date", "entity", "rev")
    top = top_rows(panel, DATE, [F.desc("rev"), F.asc("entity")], K).withColumn("side", F.lit("top"))
    low = top_rows(panel, DATE, [F.asc("rev"), F.asc("entity")], K).withColumn("side", F.lit("bottom"))
    return top.unionByName(low).withColumn("position", F.col("position").cast("long"))


# --- I: scalar functions -----------------------------------------------------------------


def _scalar(name, sql, column, digits=10):
    @register(name, with_sql(MAIN_SQL, select=f"SELECT entity, trade_date, {sql} AS value FROM main"))
    def run(spark, folder):
        return main_panel(spark, folder).select("entity", "trade_date", (column() + F.lit(0.0)).alias("value"))

    return run


_c = F.col
_scalar("scalar_neg", "-disc + 0e0", lambda: scalar.negate(_c("disc")))
_scalar("scalar_abs", f"abs({LABEL}) + 0e0", lambda: F.abs(_c(LABEL)))
_scalar("scalar_signed_log", f"round(sign({LABEL}) * ln(1e0 + abs({LABEL})), 9) + 0e0", lambda: F.round(scalar.signed_log(_c(LABEL)), 9))
_scalar("scalar_signed_sqrt", f"round(sign({LABEL}) * sqrt(abs({LABEL})), 9) + 0e0", lambda: F.round(scalar.signed_sqrt(_c(LABEL)), 9))
_scalar("scalar_add", "px + disc + 0e0", lambda: _c("px") + _c("disc"))
_scalar("scalar_sub", f"px - {LABEL} + 0e0", lambda: _c("px") - _c(LABEL))
_scalar("scalar_mul", "px * disc + 0e0", lambda: _c("px") * _c("disc"))
_scalar("scalar_div", "CASE WHEN abs(ret_share) > 1e-8 THEN px / ret_share END + 0e0", lambda: scalar.guarded_divide(_c("px"), _c("ret_share")))
_scalar("scalar_min_max", "CASE WHEN disc IS NOT NULL AND tax IS NOT NULL THEN least(disc, tax) + greatest(disc, tax) * 1e3 END + 0e0", lambda: scalar.lower_of(_c("disc"), _c("tax")) + scalar.higher_of(_c("disc"), _c("tax")) * 1e3)
_scalar("scalar_clip", "CASE WHEN rev * 1e2 IS NOT NULL THEN greatest(least((rev - 5e4) * 1e2, 1e6), -1e6) END + 0e0", lambda: scalar.clip((_c("rev") - F.lit(5e4)) * 1e2))
_scalar("scalar_signal_linear", "disc * 2e0 - 1e0 + 0e0", lambda: scalar.signal(_c("disc"), "linear"))
_scalar("scalar_signal_binary", "sign(ret_share * 2e0 - 1e0) + 0e0", lambda: scalar.signal(_c("ret_share"), "binary"))
_scalar("scalar_signal_tanh", "round(tanh((ret_share * 2e0 - 1e0) * 2e0) / tanh(2e0), 9) + 0e0", lambda: F.round(scalar.signal(_c("ret_share"), "tanh"), 9))
_scalar("scalar_signed_power", f"round(sign({LABEL}) * pow(abs({LABEL}), 1.5e0), 8) + 0e0", lambda: F.round(scalar.signed_power(_c(LABEL), 1.5), 8))
_scalar("scalar_decay", "round(pow(0.5e0, n_lines / 5e0), 9) + 0e0", lambda: F.round(scalar.half_life_weight(_c("n_lines"), 5.0), 9))
_scalar("scalar_gain_discount", "round((pow(2e0, n_lines) - 1e0) * (1e0 / log2(n_lines + 1e0)), 8) + 0e0", lambda: F.round(scalar.gain(_c("n_lines")) * scalar.discount(_c("n_lines")), 8))
_scalar("scalar_floor_bin", "CAST(least(floor(round(ret_share * 10e0, 9)), 9) AS DOUBLE) + 0e0", lambda: scalar.floor_bin(_c("ret_share"), 10).cast("double"))


@register("scalar_hash", "SELECT CAST(s_suppkey AS VARCHAR) AS entity, md5('42:' || CAST(s_suppkey AS VARCHAR)) AS h FROM supplier")
def scalar_hash(spark, folder):
    code = F.col("s_suppkey").cast("string")
    return sources.scan(spark, f"{folder}/supplier.parquet", ["s_suppkey"]).select(code.alias("entity"), scalar.seeded_hash(code, 42).alias("h"))


# --- J: labels and samples ---------------------------------------------------------------


@register("forward_return", with_sql(PANEL_SQL, select=f"SELECT entity, trade_date, px, lead(px, {HORIZON}) OVER ({SERIES}) / px - 1e0 + 0e0 AS ret FROM panel"))
def forward_return(spark, folder):
    df = sources.with_forward_return(sources.supplier_week(spark, folder).select("entity", "trade_date", "px"), "px", HORIZON, "ret")
    return df.withColumn("ret", F.col("ret") + F.lit(0.0))


@register("target_rank", with_sql(LABELLED_SQL, select=f"SELECT entity, trade_date, {LABEL}, target_rank FROM labelled"))
def target_rank(spark, folder):
    df = lab.with_target_rank(main_panel(spark, folder), LABEL, widest=main_shape(spark, folder).widest)
    return df.select("entity", "trade_date", LABEL, "target_rank")


@register("relevance_edges", with_sql(LABELLED_SQL, select="SELECT entity, trade_date, relevance FROM labelled"))
def relevance_edges(spark, folder):
    df = lab.with_target_rank(main_panel(spark, folder), LABEL, widest=main_shape(spark, folder).widest)
    return df.select("entity", "trade_date", scalar.relevance_by_edges(F.col("target_rank"), EDGES).alias("relevance"))


@register("relevance_deciles", with_sql(LABELLED_SQL, select="SELECT entity, trade_date, CAST(least(floor(round(target_rank * 10e0, 9)), 9) AS INTEGER) AS decile FROM labelled"))
def relevance_deciles(spark, folder):
    df = lab.with_target_rank(main_panel(spark, folder), LABEL, widest=main_shape(spark, folder).widest)
    return df.select("entity", "trade_date", scalar.relevance_deciles(F.col("target_rank")).alias("decile"))


@register("target_topk", with_sql(LABELLED_SQL, select="SELECT entity, trade_date, CAST(target_position AS BIGINT) AS target_position, is_target_topk FROM labelled"))
def target_topk(spark, folder):
    df = labelled_panel(spark, folder, position=True)
    return df.select("entity", "trade_date", F.col("target_position").cast("long").alias("target_position"), "is_target_topk")


@register("target_topk_by_cut", with_sql(LABELLED_SQL, select="SELECT entity, trade_date, is_target_topk FROM labelled"))
def target_topk_by_cut(spark, folder):
    """The flag without a full ordinal: the k-th row of each date is the cut."""
    panel = main_panel(spark, folder).select("entity", "trade_date", LABEL)
    return lab.flag_top(panel, LABEL, K, "is_target_topk").drop(LABEL)


_SAMPLE = "s AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY md5('7:' || entity), entity) <= 20 AS in_entity FROM panel)"
_MONTHS = "mm AS (SELECT month FROM (SELECT DISTINCT substr(trade_date, 1, 6) AS month FROM panel) ORDER BY md5('7:' || month), month LIMIT 24)"


@register("sample_entities", with_sql(PANEL_SQL, _SAMPLE, select="SELECT entity, trade_date, px FROM s WHERE in_entity"))
def sample_entities(spark, folder):
    return lab.sample_entities(main_panel(spark, folder).select("entity", "trade_date", "px"), 20, 7)


@register("sample_months", with_sql(PANEL_SQL, _MONTHS, select="SELECT month FROM mm"))
def sample_months(spark, folder):
    return lab.sample_months(main_panel(spark, folder), 24, 7)


@register("search_mask", with_sql(PANEL_SQL, _SAMPLE, _MONTHS, select="SELECT entity, trade_date, in_entity AND substr(trade_date, 1, 6) IN (SELECT month FROM mm) AS in_search FROM s"))
def search_mask(spark, folder):
    return lab.search_mask(main_panel(spark, folder).select("entity", "trade_date"), 20, 7, months=24)


@register("trading_calendar", with_sql(PANEL_SQL, CALENDAR_SQL, select="SELECT trade_date, position FROM cal"))
def trading_calendar(spark, folder):
    return cal.trading_calendar(sources.supplier_week(spark, folder))
