"""Evaluation tables and experiment comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelforge.catalog import base
from panelforge.catalog.base import (
    CALENDAR_SQL, CATEGORIES, EDGES, HORIZON, K, LABEL, LABELLED_SQL, LIBRARY, MIN_NAMES, ORACLE, PANEL_SQL, avg_rank_sql, labelled_panel,
    main_calendar, main_panel, main_shape, ordinal_sql, pearson_sql, prepared, r, register, with_sql,
)
from panelforge.catalog.expressions import CATEGORIES_SQL, EXPRESSIONS_SQL, LEAVES_SQL, categories, expression_table
from panelforge.functions import expressions as ex
from panelforge.operators import evaluate as ev
from panelforge.operators.labels import add_labels
from panelforge.plans import experiments as xp
from panelforge.session import materialize, work_folder
from panelforge.sources import panel as sources, store


def predictions(spark, folder, score="disc"):
    """Whole labelled panel with a column used as the score (many ties, some missing).

    Written once per score with the columns of a prediction only.
    """
    def build():
        panel = main_panel(spark, folder, [score]).select("entity", "trade_date", F.col(score).alias("score"), LABEL)
        return add_labels(panel, LABEL, K, EDGES, position=False, widest=main_shape(spark, folder, [score]).widest)

    return prepared(spark, folder, f"predictions {score}", build)


def pred_sql(score="disc"):
    return LABELLED_SQL + f",\npred AS (SELECT entity, trade_date, {score} AS score, {LABEL}, target_rank, relevance, is_target_topk FROM labelled WHERE {score} IS NOT NULL AND {LABEL} IS NOT NULL)"


_GAIN = "(pow(2e0, relevance) - 1e0)"


def daily_sql(score="disc"):
    return pred_sql(score) + ",\n" + daily_of_pred_sql()


def daily_of_pred_sql():
    return f"""pos AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, entity) AS p,
 row_number() OVER (PARTITION BY trade_date ORDER BY relevance DESC, entity) AS ip,
 {avg_rank_sql('score', 'trade_date', pct=False)} AS rx, {avg_rank_sql(LABEL, 'trade_date', pct=False)} AS ry FROM pred),
seq AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM pred)),
topk AS (SELECT pos.*, i FROM pos JOIN seq USING (trade_date) WHERE p <= {K}),
kept AS (SELECT a.trade_date, count(b.entity) AS kept, max(a.i) AS i FROM topk a LEFT JOIN topk b ON a.entity = b.entity AND a.i = b.i + 1 GROUP BY 1),
agg AS (SELECT trade_date, count(*) AS n, avg(CASE WHEN p <= {K} THEN {LABEL} END) AS topk_return, avg({LABEL}) AS universe_return,
 avg(CASE WHEN p <= {K} THEN target_rank END) AS topk_mean_percentile, avg(CASE WHEN p <= {K} THEN CAST(is_target_topk AS DOUBLE) END) AS precision,
 sum(CASE WHEN p <= {K} THEN {_GAIN} / log2(p + 1e0) END) AS dcg, sum(CASE WHEN ip <= {K} THEN {_GAIN} / log2(ip + 1e0) END) AS ideal,
 avg({_GAIN}) AS mean_gain, sum(CASE WHEN p <= {K} THEN 1e0 / log2(p + 1e0) END) AS w, {pearson_sql('rx', 'ry')} AS rank_ic FROM pos GROUP BY 1),
daily AS (SELECT trade_date, topk_return, universe_return, round(topk_return - universe_return, 12) AS topk_excess, topk_mean_percentile, precision,
 CAST(least({K}, n) AS DOUBLE) / n AS random_precision, CASE WHEN ideal > 0 THEN dcg / ideal END AS ndcg, CASE WHEN ideal > 0 THEN mean_gain * w / ideal END AS random_ndcg,
 CASE WHEN i > 1 THEN 1e0 - kept / {K}e0 END AS turnover, rank_ic, substr(trade_date, 1, 6) AS month, substr(trade_date, 1, 4) AS year FROM agg JOIN kept USING (trade_date))"""


MONTHLY_SQL = "monthly AS (SELECT month, " + ", ".join(f"avg({m}) AS {m}" for m in ev.MONTHLY_METRICS) + " FROM daily GROUP BY 1)"
_DAILY = ["topk_return", "universe_return", "topk_excess", "topk_mean_percentile", "precision", "random_precision", "ndcg", "random_ndcg", "turnover", "rank_ic"]
_SUMMARY = ["topk_return", "topk_excess", "topk_mean_percentile", "precision", "random_precision", "ndcg", "random_ndcg", "turnover", "rank_ic"]


# Means of rounded labels often lie halfway between two rounded values, where the order of a
# sum decides. Both engines round values moved by this much.
HALFWAY = 1e-12


def rounds(columns, digits=9):
    return ", ".join(f"round({c} + {HALFWAY!r}, {digits}) + 0e0 AS {c}" for c in columns)


def rounded(df, columns, digits=9):
    return base.rounded(df.withColumns({c: F.col(c) + HALFWAY for c in columns}), columns, digits)


SUMMARY_SQL = (
    "summary AS (SELECT * FROM (SELECT count(*) AS days, " + ", ".join(f"avg({m}) AS {m}" for m in _SUMMARY)
    + " FROM daily), (SELECT avg(CASE WHEN topk_excess > 0 THEN 1e0 ELSE 0e0 END) AS monthly_win_rate, median(topk_excess) AS monthly_median_excess, min(topk_excess) AS worst_month_excess FROM monthly))"
)
YEAR_SQL = lambda years: ", ".join(f"round(avg(CASE WHEN year = '{y}' THEN {m} END) + {HALFWAY!r}, 9) + 0e0 AS {m}_{y}" for y in years for m in ev.YEARLY_METRICS)
_SUM_COLS = [*_SUMMARY, "monthly_win_rate", "monthly_median_excess", "worst_month_excess"]


def scored(spark, folder, score="disc"):
    return ev.scored_rows(predictions(spark, folder, score), LABEL)


def daily(spark, folder, score="disc"):
    return ev.daily_table(scored(spark, folder, score), LABEL, K, widest=main_shape(spark, folder, [score]).widest)


@register("topk_selection", with_sql(pred_sql(), select=f"SELECT entity, trade_date, score, CAST(p AS BIGINT) AS pred_position FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, entity) AS p FROM pred) WHERE p <= {K}"))
def topk_selection(spark, folder):
    top = ev.select_topk(scored(spark, folder), K)
    return top.select("entity", "trade_date", "score", F.col("pred_position").cast("long").alias("pred_position"))


def _stored(spark):
    return f"{work_folder(spark)}/stored-{uuid.uuid4().hex}"


@register("predictions_stored", ORACLE["topk_selection"])
def predictions_stored(spark, folder):
    """Predictions and the selected rows written by month; the selected rows read back."""
    ranked, path = ev.rank_predictions(predictions(spark, folder), LABEL, K, widest=main_shape(spark, folder).widest), _stored(spark)
    store.write_predictions(ranked, path)
    top = spark.read.parquet(f"{path}/topk_predictions")
    return top.select("entity", "trade_date", "score", F.col("pred_position").cast("long").alias("pred_position"))


@register("rank_predictions", with_sql(pred_sql(), select=f"SELECT entity, trade_date, score, p AS pred_position, p <= {K} AS is_pred_topk FROM (SELECT *, {ordinal_sql('score', 'trade_date', descending=True)} AS p FROM pred)"))
def rank_predictions(spark, folder):
    ranked = ev.rank_predictions(predictions(spark, folder), LABEL, K, widest=main_shape(spark, folder).widest)
    return ranked.select("entity", "trade_date", "score", F.col("pred_position").cast("long").alias("pred_position"), "is_pred_topk")


@register("daily_returns", with_sql(daily_sql(), select="SELECT trade_date, " + rounds(["topk_return", "universe_return", "topk_excess"]) + " FROM daily"))
def daily_returns(spark, folder):
    rows = scored(spark, folder)
    joined = ev.daily_universe(rows, LABEL).join(ev.daily_topk(rows, LABEL, K), ["trade_date"])
    joined = joined.withColumn("topk_excess", F.col("topk_return") - F.col("universe_return"))
    return rounded(joined.select("trade_date", "topk_return", "universe_return", "topk_excess"), ["topk_return", "universe_return", "topk_excess"], 9)


@register("daily_precision", with_sql(daily_sql(), select="SELECT trade_date, " + rounds(["topk_mean_percentile", "precision", "random_precision"]) + " FROM daily"))
def daily_precision(spark, folder):
    rows = scored(spark, folder)
    joined = ev.daily_universe(rows, LABEL).join(ev.daily_topk(rows, LABEL, K), ["trade_date"])
    joined = joined.withColumn("random_precision", F.least(F.col("names"), F.lit(K)) / F.col("names"))
    return rounded(joined.select("trade_date", "topk_mean_percentile", "precision", "random_precision"), ["topk_mean_percentile", "precision", "random_precision"], 9)


@register("ndcg_at_k", with_sql(daily_sql(), select="SELECT trade_date, " + rounds(["ndcg"]) + " FROM daily"))
def ndcg_at_k(spark, folder):
    return rounded(ev.ndcg(scored(spark, folder), K), ["ndcg"], 9)


@register("random_ndcg", with_sql(daily_sql(), select="SELECT trade_date, " + rounds(["random_ndcg"]) + " FROM daily"))
def random_ndcg(spark, folder):
    rows = scored(spark, folder)
    joined = ev.daily_universe(rows, LABEL).join(ev.daily_ideal(rows, K), ["trade_date"])
    value = F.when(F.col("ideal_dcg") > 0, F.col("mean_gain") * ev.discount_total(F.col("names"), K) / F.col("ideal_dcg"))
    return joined.select("trade_date", r(value, 9).alias("random_ndcg"))


@register("turnover", with_sql(daily_sql(), select="SELECT trade_date, " + rounds(["turnover"]) + " FROM daily"))
def turnover(spark, folder):
    return rounded(ev.turnover(scored(spark, folder), K), ["turnover"], 9)


@register("daily_rank_corr", with_sql(daily_sql(), select="SELECT trade_date, " + rounds(["rank_ic"]) + " FROM daily"))
def daily_rank_corr(spark, folder):
    return rounded(ev.daily_rank_corr(scored(spark, folder), LABEL, widest=main_shape(spark, folder).widest), ["rank_ic"], 9)


@register("evaluation_daily", with_sql(daily_sql("ret_share"), select=f"SELECT trade_date, {rounds(_DAILY)}, month, year FROM daily"))
def evaluation_daily(spark, folder):
    return rounded(daily(spark, folder, "ret_share"), _DAILY, 9)


@register("metrics_stored", ORACLE["evaluation_daily"])
def metrics_stored(spark, folder):
    """The daily metrics written as CSV and read back under their schema."""
    table, path = rounded(daily(spark, folder, "ret_share"), _DAILY, 9), _stored(spark)
    store.write_metrics({"daily": table}, path)
    return spark.read.schema(table.schema).option("header", True).csv(f"{path}/daily")


@register("evaluation_monthly", with_sql(daily_sql(), MONTHLY_SQL, select=f"SELECT month, {rounds(ev.MONTHLY_METRICS)} FROM monthly"))
def evaluation_monthly(spark, folder):
    return rounded(ev.monthly_table(daily(spark, folder)), ev.MONTHLY_METRICS, 9)


@register("evaluation_summary", with_sql(daily_sql(), MONTHLY_SQL, SUMMARY_SQL, select=f"SELECT days, {rounds(_SUM_COLS)} FROM summary"))
def evaluation_summary(spark, folder):
    return rounded(ev.evaluate_predictions(predictions(spark, folder), LABEL, K, widest=main_shape(spark, folder).widest).summary, _SUM_COLS, 9)


@register("evaluation_yearly", with_sql(daily_sql(), select="SELECT year, " + ", ".join(f"round(avg({m}) + 1e-12, 9) + 0e0 AS {m}" for m in ev.YEARLY_METRICS) + " FROM daily GROUP BY 1"))
def evaluation_yearly(spark, folder):
    return rounded(ev.yearly_table(daily(spark, folder)), ev.YEARLY_METRICS, 9)


# Every year of the tables.
_YEARS = [str(y) for y in range(1995, 2002)]


@register("evaluation_year_pivot", with_sql(daily_sql(), select="SELECT " + ", ".join(f"round(avg(CASE WHEN year = '{y}' THEN {m} END) + 1e-12, 9) + 0e0 AS {m}_{y}" for y in _YEARS for m in ev.YEARLY_METRICS) + " FROM daily"))
def evaluation_year_pivot(spark, folder):
    wide = ev.yearly_columns(daily(spark, folder), _YEARS)
    return rounded(wide, wide.columns, 9)


def tails_sql(ties):
    rank = avg_rank_sql("score", "trade_date") if ties == "average" else ordinal_sql("score", "trade_date", pct=True)
    return pred_sql("ret_share") + f""",
q AS (SELECT *, {rank} AS pct, {avg_rank_sql('score', 'trade_date', pct=False)} AS rx, {avg_rank_sql(LABEL, 'trade_date', pct=False)} AS ry FROM pred),
qd0 AS (SELECT trade_date, {pearson_sql('rx', 'ry')} AS rank_ic, count(*) AS n, avg(CASE WHEN pct >= 0.9e0 THEN {LABEL} END) AS top_return, avg(CASE WHEN pct <= 0.1e0 THEN {LABEL} END) AS bottom_return FROM q GROUP BY 1),
qd AS (SELECT *, top_return - bottom_return AS long_short FROM qd0)"""


_TAILS = ["rank_ic", "top_return", "bottom_return", "long_short"]


def _tails(spark, folder, ties):
    return ev.quantile_backtest_daily(predictions(spark, folder, "ret_share"), LABEL, ties=ties, widest=main_shape(spark, folder).widest)


@register("quantile_backtest_average", with_sql(tails_sql("average"), select=f"SELECT trade_date, {rounds(_TAILS)} FROM qd"))
def quantile_backtest_average(spark, folder):
    return rounded(_tails(spark, folder, "average"), _TAILS, 9)


@register("quantile_backtest_first", with_sql(tails_sql("first"), select=f"SELECT trade_date, {rounds(_TAILS)} FROM qd"))
def quantile_backtest_first(spark, folder):
    return rounded(_tails(spark, folder, "first"), _TAILS, 9)


_BACKTEST = ["mean_top_return", "mean_bottom_return", "mean_long_short", "long_short_win_rate", "mean_rank_ic", "rank_ic_ir"]


def backtest_sql(rate):
    return f"""SELECT count(*) AS test_days, round(avg(top_return) + 1e-12, 9) + 0e0 AS mean_top_return, round(avg(bottom_return) + 1e-12, 9) + 0e0 AS mean_bottom_return,
 round(avg(long_short) + 1e-12, 9) + 0e0 AS mean_long_short, round({rate} + 1e-12, 9) AS long_short_win_rate, round(avg(rank_ic) FILTER (WHERE n >= {MIN_NAMES}) + 1e-12, 9) + 0e0 AS mean_rank_ic,
 round(avg(rank_ic) FILTER (WHERE n >= {MIN_NAMES}) / stddev_samp(rank_ic) FILTER (WHERE n >= {MIN_NAMES}) + 1e-12, 9) + 0e0 AS rank_ic_ir FROM qd"""


def _backtest(spark, folder, missing_is_loss):
    summary = ev.backtest_summary(
        predictions(spark, folder, "ret_share"), _tails(spark, folder, "average"), LABEL, min_names=MIN_NAMES,
        missing_is_loss=missing_is_loss, widest=main_shape(spark, folder).widest,
    )
    return rounded(summary, _BACKTEST, 9)


@register("backtest_summary", with_sql(tails_sql("average"), select=backtest_sql("avg(CASE WHEN long_short > 0 THEN 1e0 ELSE 0e0 END)")))
def backtest_summary(spark, folder):
    return _backtest(spark, folder, True)


@register("backtest_summary_drop_missing", with_sql(tails_sql("average"), select=backtest_sql("avg(CASE WHEN long_short > 0 THEN 1e0 WHEN long_short IS NOT NULL THEN 0e0 END)")))
def backtest_summary_drop_missing(spark, folder):
    return _backtest(spark, folder, False)


# --- experiments -------------------------------------------------------------------------

# One experiment per nation: its suppliers' weekly results summarised like a model's.
RESULTS_SQL = PANEL_SQL + """,
nat AS (SELECT 'N' || CAST(s_nationkey AS VARCHAR) AS experiment_id, p.* FROM panel p JOIN supplier ON CAST(s_suppkey AS VARCHAR) = p.entity),
results AS (SELECT experiment_id, round(avg(disc), 9) - 0.05e0 AS topk_excess_1999, round(avg(tax), 9) - 0.039e0 AS topk_excess_2000,
 round(avg(ret_share), 9) + 0.25e0 AS monthly_win_rate, round(avg(CASE WHEN n_lines > 1 THEN disc END), 9) AS ndcg, 0.0495e0 AS random_ndcg,
 round(avg(ret_share), 9) AS monthly_median_excess, round(avg(tax), 9) AS turnover FROM nat GROUP BY 1)"""


def results(spark, folder):
    supplier = sources.scan(spark, f"{folder}/supplier.parquet", ["s_suppkey", "s_nationkey"])
    nation = supplier.select(
        F.col("s_suppkey").cast("string").alias("entity"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("experiment_id")
    )
    many = F.when(F.col("n_lines") > 1, F.col("disc"))
    return sources.supplier_week(spark, folder).join(nation, "entity").groupBy("experiment_id").agg(
        (F.round(F.avg("disc"), 9) - 0.05).alias("topk_excess_1999"),
        (F.round(F.avg("tax"), 9) - 0.039).alias("topk_excess_2000"),
        (F.round(F.avg("ret_share"), 9) + 0.25).alias("monthly_win_rate"),
        F.round(F.avg(many), 9).alias("ndcg"),
        F.lit(0.0495).alias("random_ndcg"),
        F.round(F.avg("ret_share"), 9).alias("monthly_median_excess"),
        F.round(F.avg("tax"), 9).alias("turnover"),
    )


def _winner_sql(baseline, rate):
    beats = f"ndcg > random_ndcg AND ndcg > {baseline!r}e0"
    return with_sql(
        RESULTS_SQL,
        f"tiers AS (SELECT *, CASE WHEN topk_excess_1999 > 0 AND topk_excess_2000 > 0 AND monthly_win_rate >= {rate!r}e0 AND {beats} THEN 0 WHEN {beats} THEN 1 ELSE 2 END AS tier FROM results)",
        select="SELECT * EXCLUDE (tier), tier = 0 AS eligible FROM tiers ORDER BY tier, monthly_median_excess DESC NULLS LAST, ndcg DESC NULLS LAST, turnover, experiment_id LIMIT 1",
    )


@register("select_winner", _winner_sql(0.0, 0.55))
def select_winner(spark, folder):
    return xp.select_winner(results(spark, folder), years=["1999", "2000"], baseline_ndcg=0.0, min_win_rate=0.55)


@register("select_winner_diagnostic", _winner_sql(0.0, 0.99))
def select_winner_diagnostic(spark, folder):
    """No row passes the win-rate gate, so the pool falls back."""
    return xp.select_winner(results(spark, folder), years=["1999", "2000"], baseline_ndcg=0.0, min_win_rate=0.99)


@register(
    "category_ablation",
    with_sql(
        EXPRESSIONS_SQL, LEAVES_SQL, CATEGORIES_SQL,
        "d AS (SELECT expression, feature FROM leaf WHERE part_key IN (SELECT min(part_key) FROM exprs GROUP BY expression))",
        "n AS (SELECT expression, coalesce(category, 'other') AS category, count(*) AS uses FROM d LEFT JOIN cats USING (feature) GROUP BY 1, 2)",
        select="SELECT expression, category FROM (SELECT *, row_number() OVER (PARTITION BY expression ORDER BY uses DESC, category) AS r FROM n) WHERE r = 1 AND category <> 'terms'",
    ),
)
def category_ablation(spark, folder):
    library = ex.expression_category(expression_table(spark, folder), categories(spark)).drop("uses")
    return xp.category_ablation(library, "terms")


_GAP = ("topk_excess", "ndcg", "precision", "monthly_win_rate", "turnover")


def _summary_sql(name, cond):
    means = ", ".join(f"avg({m}) AS {m}" for m in ("topk_excess", "ndcg", "precision", "turnover"))
    return f"""{name} AS (SELECT {means}, (SELECT avg(CASE WHEN e > 0 THEN 1e0 ELSE 0e0 END) FROM (SELECT avg(topk_excess) AS e FROM daily WHERE {cond} GROUP BY month)) AS monthly_win_rate FROM daily WHERE {cond})"""


@register(
    "validation_test_gap",
    with_sql(
        daily_sql(), _summary_sql("va", "trade_date < '20010101'"), _summary_sql("te", "trade_date >= '20010101'"),
        select=" UNION ALL ".join(
            f"SELECT '{m}' AS metric, round(va.{m} + 1e-12, 9) + 0e0 AS validation, round(te.{m} + 1e-12, 9) + 0e0 AS test, round(te.{m} - va.{m} + 1e-12, 9) + 0e0 AS absolute_gap, round(te.{m} / nullif(va.{m}, 0e0) + 1e-12, 8) + 0e0 AS retention FROM va, te"
            for m in _GAP
        ),
    ),
)
def validation_test_gap(spark, folder):
    panel = main_panel(spark, folder, ["disc"]).withColumnRenamed("disc", "score")
    table = materialize(ev.daily_top_table(panel, LABEL, K, EDGES))  # one row per date, read four times

    def summary(condition):
        part = table.where(condition)
        return ev.summary_table(part, ev.monthly_table(part))

    gap = xp.validation_test_gap(summary(F.col("trade_date") < "20010101"), summary(F.col("trade_date") >= "20010101"), _GAP)
    return rounded(rounded(gap, ["validation", "test", "absolute_gap"], 9), ["retention"], 8)


@register(
    "importance_shift",
    with_sql(
        PANEL_SQL, "a AS (SELECT entity AS factor, sum(n_lines) AS x FROM panel WHERE trade_date < '19960101' GROUP BY 1)",
        "b AS (SELECT entity AS factor, sum(n_lines) AS x FROM panel WHERE trade_date >= '20010701' GROUP BY 1)",
        "an AS (SELECT factor, x / sum(x) OVER () AS v FROM a)", "bn AS (SELECT factor, x / sum(x) OVER () AS v FROM b)",
        select="SELECT coalesce(an.factor, bn.factor) AS factor, coalesce(an.v, 0e0) AS validation, coalesce(bn.v, 0e0) AS test, coalesce(bn.v, 0e0) - coalesce(an.v, 0e0) AS change FROM an FULL OUTER JOIN bn ON an.factor = bn.factor ORDER BY test DESC, factor LIMIT 10",
    ),
)
def importance_shift(spark, folder):
    panel = sources.supplier_week(spark, folder)
    part = lambda cond: panel.where(cond).groupBy(F.col("entity").alias("factor")).agg(F.sum("n_lines").alias("importance"))
    return xp.importance_shift(part(F.col("trade_date") < "19960101"), part(F.col("trade_date") >= "20010701"))


@register(
    "audit_label_leakage",
    with_sql(
        PANEL_SQL, CALENDAR_SQL,
        "m AS (SELECT DISTINCT strftime(date_trunc('week', o_orderdate), '%Y%m%d') AS date, strftime(date_trunc('week', o_orderdate) - INTERVAL (CASE WHEN o_orderkey % 3 = 0 THEN 35 ELSE 42 END) DAY, '%Y%m%d') AS train_end FROM orders)",
        select=f"SELECT m.date, m.train_end, coalesce(d.position, -1) AS date_position, coalesce(t.position, 1000000000) AS train_position FROM m LEFT JOIN cal d ON d.trade_date = m.date LEFT JOIN cal t ON t.trade_date = m.train_end WHERE coalesce(t.position, 1000000000) > coalesce(d.position, -1) - {HORIZON} - 1",
    ),
)
def audit_label_leakage(spark, folder):
    """Refits dated by order weeks; those trained 35 days back break the embargo."""
    week = F.date_trunc("week", "o_orderdate")
    back = F.when(F.col("o_orderkey") % 3 == 0, 35).otherwise(42)
    models = sources.scan(spark, f"{folder}/orders.parquet", ["o_orderkey", "o_orderdate"]).select(
        F.date_format(week, "yyyyMMdd").alias("date"),
        F.date_format(F.date_sub(week.cast("date"), back), "yyyyMMdd").alias("train_end"),
    ).distinct()
    return xp.audit_label_leakage(models, main_calendar(spark, folder), main_shape(spark, folder), horizon=HORIZON)


@register("audit_topk_complete", with_sql(pred_sql(), f"t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, entity) AS p FROM pred) WHERE p <= {K * 4})", select=f"SELECT trade_date, count(*) AS rows, count(DISTINCT entity) AS names FROM t GROUP BY 1 HAVING count(*) <> {K * 4} OR count(DISTINCT entity) <> {K * 4}"))
def audit_topk_complete(spark, folder):
    return xp.audit_topk_complete(ev.select_topk(scored(spark, folder), K * 4), K * 4)
