"""Walk-forward windows, votes, encodings, sweeps, feature construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog.base import (
    CALENDAR_SQL, DIGITS, DIRECTIONS, WALK_END, HORIZON, LABEL, LABELLED_SQL, LIBRARY, LOOKBACK, MAIN_SQL, MIN_NAMES, NAMES,
    PANEL_SQL, SERIES, WALK_START, UPDATE, avg_rank_sql, factors_sql, fixed_sql, hist_sql, labelled_panel, long_sql,
    main_calendar, main_panel, main_shape, pearson_sql, prepared, r, register, rounded, with_sql,
)
from panelforge.catalog.quality import IC_SQL
from panelforge.functions import expressions as ex
from panelforge.operators import features as ft
from panelforge.operators.calendar import prune_dates
from panelforge.operators.series import lagged
from panelforge.plans import walkforward as wf
from panelforge.session import small_table
from panelforge.sources import panel as sources

CAP, TOP_FACTORS, HALF_LIFE = 0.25, 5, 5.0


def windows(spark, folder):
    calendar = main_calendar(spark, folder)
    blocks = wf.rebalance_calendar(calendar, WALK_START, WALK_END, UPDATE)
    return blocks, wf.history_windows(blocks, calendar, horizon=HORIZON, lookback=LOOKBACK)


def within_windows(spark, folder, frame, lookback=LOOKBACK, span=(WALK_START, WALK_END)):
    """Drop dates no window needs; temporals were computed on full histories before."""
    return prune_dates(frame, main_calendar(spark, folder), *span, horizon=HORIZON, lookback=lookback)


def whole_span(spark, folder, lookback=LOOKBACK):
    """First date with a full window behind it, and the last date."""
    full = F.col("position") >= HORIZON + lookback
    return tuple(main_calendar(spark, folder).agg(F.min(F.when(full, F.col("trade_date"))), F.max("trade_date")).first())


def factor_values(spark, folder):
    """Unranked factor frame over the dates the windows need, written once."""
    return prepared(
        spark, folder, "factor_values",
        lambda: within_windows(spark, folder, ex.evaluate_expressions(main_panel(spark, folder), LIBRARY, keep=[LABEL], digits=DIGITS)),
    )


def ranked_frame(spark, folder, lookback=LOOKBACK, span=(WALK_START, WALK_END)):
    """Ranked, filled frame with labels over the dates the windows need, written once."""
    keep = [LABEL, "target_rank", "relevance", "is_target_topk"]

    def build():
        wide = ex.evaluate_expressions(labelled_panel(spark, folder), LIBRARY, keep=keep, directions=DIRECTIONS, digits=DIGITS)
        return wf.ranked_factors(within_windows(spark, folder, wide, lookback, span), NAMES, widest=main_shape(spark, folder).widest)

    return prepared(spark, folder, f"ranked_frame_{lookback}_{span[0]}_{span[1]}", build)


def ic_history(spark, folder, min_ic_days=10):
    """ICs of the windows; the daily ICs are written once for every query that needs them."""
    _, history = windows(spark, folder)
    build = lambda: wf.label_ics(factor_values(spark, folder), NAMES, LABEL, min_names=MIN_NAMES, widest=main_shape(spark, folder).widest)
    ic = prepared(spark, folder, "label_ics", build)
    return wf.rolling_ic(ic, history, small_table(spark, factor=list(NAMES)), min_ic_days=min_ic_days)


HIST_IC_SQL = ",\n".join(
    [
        MAIN_SQL, CALENDAR_SQL, factors_sql("main", [LABEL]), long_sql(keep=[LABEL]), IC_SQL, hist_sql(),
        """h0 AS (SELECT h.rebalance_date, h.trade_date, h.age, f.factor, ic.ic FROM hist h CROSS JOIN (SELECT DISTINCT factor FROM long) f
 LEFT JOIN ic ON ic.factor = f.factor AND ic.trade_date = h.trade_date),
hic AS (SELECT rebalance_date, trade_date, age, factor, CASE WHEN count(ic) OVER (PARTITION BY rebalance_date, factor) >= 10 THEN ic END AS ic FROM h0)""",
    ]
)
MEAN_SQL = f"""mi AS (SELECT rebalance_date, factor, coalesce(sum(ic * pow(0.5e0, age / {HALF_LIFE!r}e0)) /
 nullif(sum(CASE WHEN ic IS NOT NULL THEN pow(0.5e0, age / {HALF_LIFE!r}e0) END), 0e0), 0e0) AS mean_ic FROM hic GROUP BY 1, 2)"""


def raw_sql(power=1.0, dead=0.02, top=TOP_FACTORS):
    return f"""r0 AS (SELECT *, CASE WHEN abs(mean_ic) < {dead!r}e0 THEN 0e0 ELSE sign(mean_ic) * pow(abs(mean_ic), {power!r}e0) END AS raw0 FROM mi),
rw AS (SELECT rebalance_date, factor, mean_ic, CASE WHEN row_number() OVER (PARTITION BY rebalance_date ORDER BY abs(raw0) DESC, factor) <= {top} THEN raw0 ELSE 0e0 END AS raw FROM r0)"""


def cap_sql(cap=CAP, keys="rebalance_date"):
    """Ten unrolled rounds; ``done`` marks blocks that stopped."""
    out = [f"""w0 AS (SELECT {keys}, factor, mean_ic, raw, CASE WHEN sum(abs(raw)) OVER (PARTITION BY {keys}) > 0
 THEN raw / sum(abs(raw)) OVER (PARTITION BY {keys}) ELSE raw END AS w, sum(abs(raw)) OVER (PARTITION BY {keys}) <= 0 AS done FROM rw)"""]
    for i in range(10):
        p = f"PARTITION BY {keys}"
        out.append(f"""s{i} AS (SELECT *, sum(CASE WHEN abs(w) > {cap} THEN 1 ELSE 0 END) OVER ({p}) AS n_over,
 sum(CASE WHEN abs(w) > {cap} THEN 0e0 ELSE abs(w) END) OVER ({p}) AS free FROM w{i}),
w{i + 1} AS (SELECT {keys}, factor, mean_ic, raw, CASE WHEN done OR n_over = 0 THEN w WHEN abs(w) > {cap} THEN sign(w) * {cap}e0
 WHEN free > 0 AND 1e0 - n_over * {cap}e0 > 0 THEN w * ((1e0 - n_over * {cap}e0) / free) ELSE w END AS w,
 done OR n_over = 0 OR NOT (free > 0 AND 1e0 - n_over * {cap}e0 > 0) AS done FROM s{i})""")
    out.append(f"wt AS (SELECT {keys}, factor, mean_ic, raw, w AS weight FROM w10)")
    return ",\n".join(out)


@register("rebalance_calendar", with_sql(PANEL_SQL, CALENDAR_SQL, hist_sql(), select="SELECT trade_date, position, rebalance_date, rebalance_position FROM blocks"))
def rebalance_calendar(spark, folder):
    return windows(spark, folder)[0]


@register("history_windows", with_sql(PANEL_SQL, CALENDAR_SQL, hist_sql(lookback=60), select="SELECT rebalance_date, trade_date, CAST(age AS INTEGER) AS age FROM hist"))
def history_windows(spark, folder):
    calendar = main_calendar(spark, folder)
    blocks = wf.rebalance_calendar(calendar, WALK_START, WALK_END, UPDATE)
    return wf.history_windows(blocks, calendar, horizon=HORIZON, lookback=60)


@register("fit_validation_split", with_sql(PANEL_SQL, CALENDAR_SQL, hist_sql(), select="SELECT rebalance_date, trade_date, CAST(age AS INTEGER) AS age, age < 5 AS is_validation FROM hist"))
def fit_validation_split(spark, folder):
    return wf.fit_validation_split(windows(spark, folder)[1], 5)


@register("rolling_ic", with_sql(HIST_IC_SQL, select="SELECT rebalance_date, trade_date, CAST(age AS INTEGER) AS age, factor, round(ic, 10) + 0e0 AS ic FROM hic"))
def rolling_ic(spark, folder):
    return rounded(ic_history(spark, folder), ["ic"]).select("rebalance_date", "trade_date", "age", "factor", "ic")


@register("decayed_mean_ic", with_sql(HIST_IC_SQL, MEAN_SQL, select="SELECT rebalance_date, factor, round(mean_ic, 10) + 0e0 AS mean_ic FROM mi"))
def decayed_mean_ic(spark, folder):
    return rounded(wf.decayed_mean_ic(ic_history(spark, folder), HALF_LIFE), ["mean_ic"])


@register("raw_weights", with_sql(HIST_IC_SQL, MEAN_SQL, raw_sql(1.5), select="SELECT rebalance_date, factor, round(mean_ic, 10) + 0e0 AS mean_ic, round(raw, 10) + 0e0 AS raw FROM rw"))
def raw_weights(spark, folder):
    means = wf.decayed_mean_ic(ic_history(spark, folder), HALF_LIFE)
    return rounded(wf.raw_weights(means, power=1.5, dead_zone=0.02, top_k=TOP_FACTORS), ["mean_ic", "raw"])


def reliability(spark, folder):
    return wf.reliability_weights(ic_history(spark, folder), half_life=HALF_LIFE, dead_zone=0.02, top_k=TOP_FACTORS, cap=CAP)


@register("cap_weights", with_sql(HIST_IC_SQL, MEAN_SQL, raw_sql(), cap_sql(), select="SELECT rebalance_date, factor, round(mean_ic, 10) + 0e0 AS mean_ic, round(raw, 10) + 0e0 AS raw, round(weight, 10) + 0e0 AS weight FROM wt"))
def cap_weights(spark, folder):
    return rounded(reliability(spark, folder), ["mean_ic", "raw", "weight"])


SIGNAL_SQL = "sig AS (SELECT factor, entity, trade_date, " + LABEL + f", sign(({avg_rank_sql('value', 'factor, trade_date')}) * 2e0 - 1e0) AS s FROM long)"
VOTE_SQL = ",\n".join([HIST_IC_SQL, MEAN_SQL, raw_sql(), cap_sql(), SIGNAL_SQL])
VOTED_SQL = f"""vote AS (SELECT s.entity, s.trade_date, b.rebalance_date, any_value(s.{LABEL}) AS {LABEL}, sum(coalesce(s.s, 0e0) * w.weight) AS score
 FROM sig s JOIN blocks b USING (trade_date) JOIN wt w ON w.rebalance_date = b.rebalance_date AND w.factor = s.factor GROUP BY 1, 2, 3)"""


def vote(spark, folder):
    shape = main_shape(spark, folder)
    blocks, _ = windows(spark, folder)
    ranks = wf.ranked_factors(factor_values(spark, folder), NAMES, fill=None, widest=shape.widest)
    return wf.vote_score(ranks, NAMES, reliability(spark, folder), blocks, shape, mode="binary")


@register("vote_score", with_sql(VOTE_SQL, VOTED_SQL, select=f"SELECT entity, trade_date, rebalance_date, {LABEL}, round(score, 9) + 0e0 AS score FROM vote"))
def vote_score(spark, folder):
    return rounded(vote(spark, folder), ["score"], 9)


# --- second-generation models ------------------------------------------------------------


def ranked_sql(lookback=LOOKBACK, names=NAMES):
    return ",\n".join(
        [
            LABELLED_SQL, CALENDAR_SQL, factors_sql("labelled", [LABEL, "target_rank", "relevance", "is_target_topk"], directions=DIRECTIONS), hist_sql(lookback),
            "rf AS (SELECT entity, trade_date, " + LABEL + ", target_rank, relevance, is_target_topk, "
            + ", ".join(f"coalesce({avg_rank_sql(n, 'trade_date')}, 0.5e0) AS {n}" for n in names) + " FROM wide)",
            long_sql("rf", [LABEL, "target_rank"], names),
        ]
    )


def ic_vote_sql(half_life=10.0):
    decay = f"pow(0.5e0, age / {half_life!r})" if half_life else "1e0"
    return f"""dic AS (SELECT factor, trade_date, {pearson_sql('value', 'target_rank')} AS ic FROM long WHERE target_rank IS NOT NULL GROUP BY 1, 2),
mi AS (SELECT h.rebalance_date, d.factor, coalesce(sum(ic * {decay}), 0e0) / sum({decay}) AS mean_ic FROM hist h JOIN dic d USING (trade_date) GROUP BY 1, 2),
wt AS (SELECT *, mean_ic / sum(abs(mean_ic)) OVER (PARTITION BY rebalance_date) AS weight FROM mi)"""


RANKED_SQL, IC_VOTE_SQL = ranked_sql(), ic_vote_sql()


@register("ic_vote_weights", with_sql(RANKED_SQL, IC_VOTE_SQL, select="SELECT rebalance_date, factor, round(mean_ic, 9) + 0e0 AS mean_ic, round(weight, 9) + 0e0 AS weight FROM wt"))
def ic_vote_weights(spark, folder):
    blocks, history = windows(spark, folder)
    weights, _ = wf.ic_vote(ranked_frame(spark, folder), NAMES, history, blocks, main_shape(spark, folder))
    return rounded(weights, ["mean_ic", "weight"], 9)


VOTES_SQL = "SELECT l.entity, l.trade_date, b.rebalance_date, round(sum((l.value - 0.5e0) * w.weight), 9) + 0e0 AS score FROM long l JOIN blocks b USING (trade_date) JOIN wt w ON w.rebalance_date = b.rebalance_date AND w.factor = l.factor GROUP BY 1, 2, 3"


@register(
    "ic_vote_score",
    with_sql(
        RANKED_SQL, IC_VOTE_SQL,
        select=VOTES_SQL,
    ),
)
def ic_vote_score(spark, folder):
    blocks, history = windows(spark, folder)
    _, scored = wf.ic_vote(ranked_frame(spark, folder), NAMES, history, blocks, main_shape(spark, folder))
    return rounded(scored, ["score"], 9).select("entity", "trade_date", "rebalance_date", "score")


def bins_sql(bins=10):
    return f"""bn AS (SELECT *, CAST(least(floor(round(value * {bins}e0, 9)), {bins - 1}) AS INTEGER) AS bin FROM long),
enc AS (SELECT h.rebalance_date, b.factor, b.bin, count(*) AS n, (sum(target_rank) + 250e0) / (count(*) + 500e0) AS encoded
 FROM hist h JOIN bn b USING (trade_date) WHERE target_rank IS NOT NULL GROUP BY 1, 2, 3)"""


BINS_SQL = bins_sql()
BINNED_SQL = f"SELECT t.entity, t.trade_date, b.rebalance_date, round(sum(coalesce(e.encoded, 0.5e0) - 0.5e0) / {len(NAMES)}e0 + 0.5e0, {{digits}}) + 0e0 AS score FROM bn t JOIN (SELECT * FROM blocks WHERE rebalance_date IN (SELECT rebalance_date FROM hist)) b USING (trade_date) LEFT JOIN enc e ON e.rebalance_date = b.rebalance_date AND e.factor = t.factor AND e.bin = t.bin GROUP BY 1, 2, 3"


@register("bin_encoding", with_sql(RANKED_SQL, BINS_SQL, select="SELECT rebalance_date, factor, bin, n, round(encoded, 10) + 0e0 AS encoded FROM enc"))
def bin_encoding(spark, folder):
    _, history = windows(spark, folder)
    per_day = wf.daily_bins(ranked_frame(spark, folder), NAMES, 10)
    return rounded(wf.bin_encoding(per_day, history), ["encoded"])


@register(
    "binning_score",
    with_sql(
        RANKED_SQL, BINS_SQL,
        select=BINNED_SQL.format(digits=10),
    ),
)
def binning_score(spark, folder):
    blocks, history = windows(spark, folder)
    scored = wf.binning_score(ranked_frame(spark, folder), NAMES, history, blocks, main_shape(spark, folder))
    return rounded(scored, ["score"]).select("entity", "trade_date", "rebalance_date", "score")


@register("sample_decay_weights", with_sql(PANEL_SQL, CALENDAR_SQL, hist_sql(), select="SELECT rebalance_date, trade_date, CAST(age AS INTEGER) AS age, round(pow(0.5e0, age / 10e0), 10) AS weight FROM hist"))
def sample_decay_weights(spark, folder):
    return rounded(wf.sample_decay_weights(windows(spark, folder)[1], 10.0), ["weight"])


# --- sweep -------------------------------------------------------------------------------

_GRID = dict(powers=(1.0, 1.5), dead_zones=(0.0, 0.02), half_lives=(3.0, 10.0), top_ks=(3, 5))
_LISTS = {k: "[" + ", ".join(f"{v}e0" if isinstance(v, float) else str(v) for v in vs) + "]" for k, vs in _GRID.items()}
_MODES = {"linear": "lin", "binary": "sign(lin)", "tanh": "tanh(lin * 2e0) / tanh(2e0)"}
SPLIT = "20000630"
SWEEP_SQL = f"""grid AS (SELECT p AS power, z AS dead_zone, h AS half_life, k AS top_k FROM (SELECT unnest({_LISTS['powers']}) AS p), (SELECT unnest({_LISTS['dead_zones']}) AS z), (SELECT unnest({_LISTS['half_lives']}) AS h), (SELECT unnest({_LISTS['top_ks']}) AS k)),
mean0 AS (SELECT half_life, rebalance_date, factor, sum(ic * pow(0.5e0, age / half_life)) / nullif(sum(CASE WHEN ic IS NOT NULL THEN pow(0.5e0, age / half_life) END), 0e0) AS mean_ic
 FROM h0, (SELECT DISTINCT half_life FROM grid) GROUP BY 1, 2, 3),
r0 AS (SELECT g.*, m.rebalance_date, m.factor, m.mean_ic, CASE WHEN abs(mean_ic) < dead_zone THEN 0e0 ELSE sign(mean_ic) * pow(abs(mean_ic), power) END AS raw0 FROM grid g JOIN mean0 m USING (half_life)),
rw AS (SELECT power, dead_zone, half_life, top_k, rebalance_date, factor, mean_ic, coalesce(CASE WHEN row_number() OVER (PARTITION BY power, dead_zone, half_life, top_k, rebalance_date ORDER BY abs(raw0) DESC NULLS LAST, factor) <= top_k THEN raw0 ELSE 0e0 END, 0e0) AS raw FROM r0),
{cap_sql(keys='power, dead_zone, half_life, top_k, rebalance_date')},
lin AS (SELECT factor, entity, trade_date, {LABEL}, ({avg_rank_sql('value', 'factor, trade_date')}) * 2e0 - 1e0 AS lin FROM long),
modes AS (""" + " UNION ALL ".join(f"SELECT factor, entity, trade_date, {LABEL}, '{m}' AS signal_mode, coalesce({e}, 0e0) AS s FROM lin" for m, e in _MODES.items()) + f"""),
sc AS (SELECT power, dead_zone, half_life, top_k, signal_mode, entity, m.trade_date, any_value({LABEL}) AS y, round(sum(s * weight), 9) + 0e0 AS score
 FROM modes m JOIN blocks b USING (trade_date) JOIN wt ON wt.rebalance_date = b.rebalance_date AND wt.factor = m.factor GROUP BY 1, 2, 3, 4, 5, 6, 7),
ok AS (SELECT * FROM sc WHERE y IS NOT NULL),
rks AS (SELECT *, {avg_rank_sql('score', 'power, dead_zone, half_life, top_k, signal_mode, trade_date', pct=False)} AS a, {avg_rank_sql('score', 'power, dead_zone, half_life, top_k, signal_mode, trade_date')} AS pct,
 {avg_rank_sql('y', 'power, dead_zone, half_life, top_k, signal_mode, trade_date', pct=False)} AS b FROM ok),
dl AS (SELECT power, dead_zone, half_life, top_k, signal_mode, trade_date, {pearson_sql('a', 'b', min_rows=MIN_NAMES)} AS ic,
 avg(CASE WHEN pct >= 0.9e0 THEN y END) - avg(CASE WHEN pct <= 0.1e0 THEN y END) AS spread FROM rks GROUP BY 1, 2, 3, 4, 5, 6)"""


@register(
    "parameter_sweep",
    with_sql(
        HIST_IC_SQL, SWEEP_SQL,
        select=f"""SELECT power, dead_zone, half_life, CAST(top_k AS BIGINT) AS top_k, signal_mode, round(avg(ic), 8) + 0e0 AS mean_rank_ic, round(avg(ic) / nullif(stddev_samp(ic), 0), 8) + 0e0 AS rank_ic_ir,
 round(avg(spread), 8) + 0e0 AS mean_long_short, round(avg(CASE WHEN spread > 0 THEN 1e0 ELSE 0e0 END), 8) + 0e0 AS long_short_win_rate,
 round(avg(CASE WHEN trade_date <= '{SPLIT}' THEN ic END), 8) + 0e0 AS early_ic, round(avg(CASE WHEN trade_date > '{SPLIT}' THEN ic END), 8) + 0e0 AS late_ic FROM dl GROUP BY 1, 2, 3, 4, 5""",
    ),
)
def parameter_sweep(spark, folder):
    shape = main_shape(spark, folder)
    blocks, _ = windows(spark, folder)
    result = wf.parameter_sweep(
        factor_values(spark, folder), NAMES, ic_history(spark, folder, 0), blocks, LABEL, shape, cap=CAP, split_date=SPLIT,
        min_names=MIN_NAMES, ranked=False, **_GRID
    )
    return rounded(result, ["mean_rank_ic", "rank_ic_ir", "mean_long_short", "long_short_win_rate", "early_ic", "late_ic"], 8)


# --- R: feature construction -------------------------------------------------------------

BARS_SQL = f"""bars AS (SELECT CAST(l_suppkey AS VARCHAR) AS entity, strftime(date_trunc('week', l_shipdate), '%Y%m%d') AS trade_date,
 arg_min(unit, (l_shipdate, l_orderkey, l_linenumber, l_partkey, unit)) AS open, max(unit) AS high, min(unit) AS low,
 arg_max(unit, (l_shipdate, l_orderkey, l_linenumber, l_partkey, unit)) AS close,
 CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount,
 coalesce(CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE), 0e0) AS buy,
 coalesce(CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE), 0e0) AS sell
 FROM (SELECT *, {fixed_sql('l_extendedprice / l_quantity')} AS unit FROM lineitem) GROUP BY 1, 2)"""


def bars(spark, folder):
    return sources.supplier_week_bars(spark, folder)


@register("feature_rank_cs", with_sql(BARS_SQL, select=f"SELECT entity, trade_date, {avg_rank_sql('close', 'trade_date')} AS close_rank_cs, {avg_rank_sql('volume', 'trade_date')} AS volume_rank_cs FROM bars"))
def feature_rank_cs(spark, folder):
    df = ft.with_cross_section_ranks(bars(spark, folder), ["close", "volume"], widest=main_shape(spark, folder).widest)
    return df.select("entity", "trade_date", "close_rank_cs", "volume_rank_cs")


@register("feature_past_returns", with_sql(BARS_SQL, select="SELECT entity, trade_date, " + ", ".join(f"close / lag(close, {n}) OVER ({SERIES}) - 1e0 + 0e0 AS ret_{n}" for n in (1, 5, 20)) + " FROM bars"))
def feature_past_returns(spark, folder):
    return bars(spark, folder).select("entity", "trade_date", *[(ft.past_return(F.col("close"), n) + F.lit(0.0)).alias(f"ret_{n}") for n in (1, 5, 20)])


@register("feature_bar_shape", with_sql(BARS_SQL, select="SELECT entity, trade_date, close / open - 1e0 + 0e0 AS intraday_ret, least(open, close) / low - 1e0 + 0e0 AS lower_shadow, high / low - 1e0 + 0e0 AS high_low_range FROM bars"))
def feature_bar_shape(spark, folder):
    made = ft.bar_shape(F.col("open"), F.col("high"), F.col("low"), F.col("close"))
    return bars(spark, folder).select("entity", "trade_date", *[(c + F.lit(0.0)).alias(n) for n, c in made.items()])


@register(
    "feature_liquidity",
    with_sql(
        BARS_SQL, "sup AS (SELECT CAST(s_suppkey AS VARCHAR) AS entity, abs(s_acctbal) AS shares FROM supplier)",
        "t AS (SELECT entity, trade_date, CASE WHEN shares <> 0 THEN volume / shares END AS turnover_rate, shares * close AS mv FROM bars JOIN sup USING (entity))",
        select=f"SELECT entity, trade_date, turnover_rate, {avg_rank_sql('liq', 'trade_date')} AS liquidity_rank_cs FROM (SELECT *, mv * turnover_rate AS liq FROM t)",
    ),
)
def feature_liquidity(spark, folder):
    supplier = sources.scan(spark, f"{folder}/supplier.parquet", ["s_suppkey", "s_acctbal"]).select(
        F.col("s_suppkey").cast("string").alias("entity"), F.abs("s_acctbal").alias("shares")
    )
    df = bars(spark, folder).join(supplier, "entity")
    df = df.withColumn("turnover_rate", ft.turnover_rate(F.col("volume"), F.col("shares"))).withColumn("mv", F.col("shares") * F.col("close"))
    df = ft.with_liquidity(df, "mv", "turnover_rate", widest=main_shape(spark, folder).widest)
    return df.select("entity", "trade_date", "turnover_rate", "liquidity_rank_cs")


@register("feature_bands", with_sql(BARS_SQL, select="SELECT entity, trade_date, CASE WHEN (high + low) / 2e0 <> 0 THEN (high - low) / ((high + low) / 2e0) END AS boll_width, CASE WHEN high - low <> 0 THEN (close - low) / (high - low) END AS boll_position FROM bars"))
def feature_bands(spark, folder):
    """Upper, middle and lower band are inputs; the bar's range stands in for them here."""
    high, low = F.col("high"), F.col("low")
    made = ft.band_features(high, (high + low) / F.lit(2.0), low, F.col("close"))
    return bars(spark, folder).select("entity", "trade_date", *[c.alias(n) for n, c in made.items()])


FLOW_SQL = "flow AS (SELECT entity, trade_date, (buy - sell) / amount + 0e0 AS net_amount_ratio, buy / amount AS buy_amount_ratio, sell / amount AS sell_amount_ratio FROM bars)"


def flow(spark, folder):
    made = ft.flow_features(F.col("buy"), F.col("sell"), F.col("amount"))
    return bars(spark, folder).select("entity", "trade_date", *[(c + F.lit(0.0)).alias(n) for n, c in made.items()])


@register("feature_flow_ratios", with_sql(BARS_SQL, FLOW_SQL, select="SELECT * FROM flow"))
def feature_flow_ratios(spark, folder):
    return flow(spark, folder)


@register("feature_rolling_sum", with_sql(BARS_SQL, FLOW_SQL, select=f"SELECT entity, trade_date, round(sum(net_amount_ratio) OVER ({SERIES} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 9) + 0e0 AS net_amount_ratio_5d FROM flow"))
def feature_rolling_sum(spark, folder):
    df = ft.with_rolling_sum(flow(spark, folder), "net_amount_ratio", 5)
    return rounded(df, ["net_amount_ratio_5d"], 9).select("entity", "trade_date", "net_amount_ratio_5d")


@register("feature_fill", with_sql(BARS_SQL, select=f"SELECT entity, trade_date, coalesce(ret_5, 0e0) AS ret_5, coalesce({avg_rank_sql('ret_5', 'trade_date')}, 0.5e0) AS ret_5_rank_cs FROM (SELECT entity, trade_date, close / lag(close, 5) OVER ({SERIES}) - 1e0 + 0e0 AS ret_5 FROM bars)"))
def feature_fill(spark, folder):
    df = bars(spark, folder).select("entity", "trade_date", (ft.past_return(F.col("close"), 5) + F.lit(0.0)).alias("ret_5"))
    df = ft.with_cross_section_ranks(df, ["ret_5"], widest=main_shape(spark, folder).widest)
    return ft.fill_features(df, ["ret_5", "ret_5_rank_cs"])
