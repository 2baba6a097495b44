"""Scans, filters, joins and plain aggregations over panels."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from panelforge.catalog.base import (
    CALENDAR_SQL, CATEGORIES, END, FEATURES, HORIZON, K, LABEL, LABELLED_SQL, LIBRARY, LOOKBACK, MAIN_SQL, MIN_NAMES,
    NAMES, PANEL_SQL, START, UPDATE, avg_rank_sql, factors_sql, fixed_sql, hist_sql, labelled_panel, long_sql, main_calendar,
    main_panel, main_shape, ordinal_sql, pearson_sql, r, register, rounded, with_sql,
)
from panelforge.functions.expressions import evaluate_expressions, to_long
from panelforge.functions.scalar import fixed
from panelforge.operators import calendar as cal
from panelforge.operators.aggregates import pearson, share, weighted_mean
from panelforge.operators.ranks import average_rank, ordinal_rank
from panelforge.plans import walkforward as wf
from panelforge.session import broadcast_within, small_table
from panelforge.sources import panel as sources
from panelforge.sources.store import audit_columns

# --- A: scans ----------------------------------------------------------------------------


@register("scan_projected", "SELECT l_orderkey, l_suppkey, l_extendedprice FROM lineitem")
def scan_projected(spark, folder):
    return sources.scan(spark, f"{folder}/lineitem.parquet", ["l_orderkey", "l_suppkey", "l_extendedprice", "l_suppkey"])


@register(
    "scan_date_bounded",
    "SELECT o_custkey AS entity, strftime(o_orderdate, '%Y%m%d') AS trade_date, o_totalprice FROM orders "
    "WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'",
)
def scan_date_bounded(spark, folder):
    """The bounds reach the Parquet scan as pushed filters."""
    orders = sources.scan(spark, f"{folder}/orders.parquet", ["o_custkey", "o_orderdate", "o_totalprice"])
    day = F.col("o_orderdate")
    kept = orders.where((day >= F.lit("1996-01-01").cast("timestamp_ntz")) & (day <= F.lit("1998-12-31").cast("timestamp_ntz")))
    return kept.select(F.col("o_custkey").alias("entity"), F.date_format(day, "yyyyMMdd").alias("trade_date"), "o_totalprice")


@register(
    "load_panel_labelled",
    with_sql(
        LABELLED_SQL,
        select="SELECT entity, trade_date, px, target_rank, relevance, is_target_topk FROM labelled "
        f"WHERE trade_date BETWEEN '{START}' AND '{END}'",
    ),
)
def load_panel_labelled(spark, folder):
    """Prepared panel written by month, read back with a date range, then labelled."""
    import uuid

    from panelforge.operators.labels import add_labels
    from panelforge.session import work_folder

    path = f"{work_folder(spark)}/panel-{uuid.uuid4().hex}"
    # Straight from the lines: the prepared panel is the only table written.
    priced = lambda: sources.with_forward_return(sources.supplier_week(spark, folder), "px", HORIZON, LABEL).withColumn(LABEL, fixed(F.col(LABEL), 6))
    sources.build_or_reuse(spark, path, priced)
    df = sources.load_panel(spark, path, START, END, ["px", LABEL, "px"])
    labelled = add_labels(df, LABEL, K, position=False)
    return labelled.select("entity", "trade_date", "px", "target_rank", "relevance", "is_target_topk")


@register("prepare_panel_reuse", with_sql(MAIN_SQL, select=f"SELECT month, count(*) AS n, round(avg({LABEL}), 10) + 0e0 AS mean_ret FROM (SELECT *, substr(trade_date, 1, 6) AS month FROM main) GROUP BY 1"))
def prepare_panel_reuse(spark, folder):
    """Second call reads what the first one wrote."""
    import uuid

    from panelforge.session import work_folder

    path = f"{work_folder(spark)}/prepared-{uuid.uuid4().hex}"
    sources.build_or_reuse(spark, path, lambda: main_panel(spark, folder))
    df = sources.build_or_reuse(spark, path, lambda: 1 / 0)
    return df.groupBy(F.col("month").cast("string").alias("month")).agg(
        F.count("*").alias("n"), r(F.avg(LABEL)).alias("mean_ret")
    )


@register("feature_list_excluded", with_sql(PANEL_SQL, select="SELECT entity, trade_date, px, qty, disc, tax, n_lines FROM panel"))
def feature_list_excluded(spark, folder):
    panel = sources.supplier_week(spark, folder)
    kept = sources.feature_columns(panel.columns, ["rev", "ret_share"])
    return panel.select(*kept)


# --- B: filters and projections ----------------------------------------------------------


@register("filter_split", with_sql(MAIN_SQL, select=f"SELECT entity, trade_date, {LABEL} FROM main WHERE trade_date <= '{END}' AND {LABEL} IS NOT NULL"))
def filter_split(spark, folder):
    return main_panel(spark, folder).where((F.col("trade_date") <= END) & F.col(LABEL).isNotNull()).select("entity", "trade_date", LABEL)


_BLOCK_DATES = with_sql(
    PANEL_SQL, CALENDAR_SQL, hist_sql(start=START, end=END), select="SELECT entity, trade_date, px FROM panel WHERE trade_date IN (SELECT trade_date FROM blocks WHERE trade_date = rebalance_date)"
)


@register("filter_date_set", _BLOCK_DATES)
def filter_date_set(spark, folder):
    blocks = wf.rebalance_calendar(main_calendar(spark, folder), START, END, UPDATE)
    firsts = blocks.where(F.col("trade_date") == F.col("rebalance_date"))
    panel = sources.supplier_week(spark, folder).select("entity", "trade_date", "px")
    return cal.in_dates(panel, firsts, main_shape(spark, folder))


@register(
    "prune_required_range",
    with_sql(
        PANEL_SQL, CALENDAR_SQL,
        select=f"""SELECT entity, trade_date, px FROM panel WHERE trade_date <= (SELECT max(trade_date) FROM cal WHERE trade_date BETWEEN '{START}' AND '{END}')
 AND trade_date >= (SELECT min(trade_date) FROM cal WHERE position >= greatest(0, (SELECT min(position) FROM cal WHERE trade_date BETWEEN '{START}' AND '{END}') - {HORIZON} - {LOOKBACK}))""",
    ),
)
def prune_required_range(spark, folder):
    panel = sources.supplier_week(spark, folder).select("entity", "trade_date", "px")
    return cal.prune_dates(panel, main_calendar(spark, folder), START, END, horizon=HORIZON, lookback=LOOKBACK)


@register("drop_missing", with_sql(MAIN_SQL, select=f"SELECT entity, trade_date, disc, {LABEL} FROM main WHERE disc IS NOT NULL AND {LABEL} IS NOT NULL"))
def drop_missing(spark, folder):
    return main_panel(spark, folder).select("entity", "trade_date", "disc", LABEL).na.drop(subset=["disc", LABEL])


@register(
    "filter_group_size",
    with_sql(PANEL_SQL, select="SELECT entity, trade_date, disc FROM panel WHERE disc IS NOT NULL AND trade_date IN (SELECT trade_date FROM panel WHERE disc IS NOT NULL GROUP BY 1 HAVING count(*) >= 20)"),
)
def filter_group_size(spark, folder):
    """Counts are combined before the shuffle; the dates kept return as a broadcast semi join."""
    rows = sources.supplier_week(spark, folder).select("entity", "trade_date", "disc").na.drop()
    big = rows.groupBy("trade_date").count().where(F.col("count") >= 20)
    return cal.in_dates(rows, big, main_shape(spark, folder))


@register(
    "filter_rank_thresholds",
    with_sql(
        PANEL_SQL,
        select=f"SELECT entity, trade_date, pct, CASE WHEN pct >= 0.9e0 THEN 'top' ELSE 'bottom' END AS tail FROM (SELECT entity, trade_date, {avg_rank_sql('px', 'trade_date')} AS pct FROM panel) WHERE pct >= 0.9e0 OR pct <= 0.1e0",
    ),
)
def filter_rank_thresholds(spark, folder):
    panel = sources.supplier_week(spark, folder).select("entity", "trade_date", "px")
    ranked = average_rank(panel, ["trade_date"], "px", "pct", widest=main_shape(spark, folder).widest)
    tails = ranked.where((F.col("pct") >= 0.9) | (F.col("pct") <= 0.1))
    return tails.select("entity", "trade_date", "pct", F.when(F.col("pct") >= 0.9, "top").otherwise("bottom").alias("tail"))


@register("period_columns", with_sql(PANEL_SQL, select="SELECT entity AS code, trade_date, substr(trade_date, 1, 6) AS month, substr(trade_date, 1, 4) AS year, CAST(n_lines AS BIGINT) AS lines FROM panel"))
def period_columns(spark, folder):
    panel = sources.supplier_week(spark, folder)
    return panel.select(
        F.col("entity").alias("code"), "trade_date", F.substring("trade_date", 1, 6).alias("month"),
        F.substring("trade_date", 1, 4).alias("year"), F.col("n_lines").cast("long").alias("lines"),
    )


@register("fill_missing", with_sql(PANEL_SQL, select=f"SELECT entity, trade_date, coalesce(pct, 0.5e0) AS pct, coalesce(disc, 0e0) AS disc FROM (SELECT entity, trade_date, disc, {avg_rank_sql('disc', 'trade_date')} AS pct FROM panel)"))
def fill_missing(spark, folder):
    panel = sources.supplier_week(spark, folder).select("entity", "trade_date", "disc")
    ranked = average_rank(panel, ["trade_date"], "disc", "pct", widest=main_shape(spark, folder).widest)
    return ranked.na.fill({"pct": 0.5, "disc": 0.0})


# --- C: joins ----------------------------------------------------------------------------


@register("join_panel_checked", with_sql(MAIN_SQL, select=f"SELECT entity, trade_date, qty, disc, px, round(lead(px, {HORIZON}) OVER (PARTITION BY entity ORDER BY trade_date) / px - 1e0, 10) + 0e0 AS {LABEL} FROM main"))
def join_panel_checked(spark, folder):
    panel = sources.supplier_week(spark, folder)
    features = panel.select("entity", "trade_date", "qty", "disc")
    prices = panel.select("entity", "trade_date", "px")
    return rounded(sources.prepare_panel(features, prices, "px", HORIZON, LABEL), [LABEL])


@register(
    "join_ic_history",
    with_sql(
        MAIN_SQL, CALENDAR_SQL, factors_sql("main", [LABEL]), long_sql(keep=[LABEL]),
        f"comp AS (SELECT * FROM long WHERE value IS NOT NULL AND {LABEL} IS NOT NULL)",
        f"rk AS (SELECT factor, trade_date, {avg_rank_sql('value', 'factor, trade_date', pct=False)} AS x, {avg_rank_sql(LABEL, 'factor, trade_date', pct=False)} AS y FROM comp)",
        f"ic AS (SELECT factor, trade_date, {pearson_sql('x', 'y')} AS ic FROM rk GROUP BY 1, 2 HAVING count(*) >= {MIN_NAMES})",
        hist_sql(start=START, end=END),
        select="SELECT h.rebalance_date, h.trade_date, CAST(h.age AS INTEGER) AS age, f.factor, round(ic.ic, 10) + 0e0 AS ic FROM hist h CROSS JOIN (SELECT DISTINCT factor FROM long) f LEFT JOIN ic ON ic.factor = f.factor AND ic.trade_date = h.trade_date",
    ),
)
def join_ic_history(spark, folder):
    """Dates without an IC appear with NULL."""
    calendar = main_calendar(spark, folder)
    blocks = wf.rebalance_calendar(calendar, START, END, UPDATE)
    windows = wf.history_windows(blocks, calendar, horizon=HORIZON, lookback=LOOKBACK)
    ic = wf.factor_ics(main_panel(spark, folder), LIBRARY, LABEL, min_names=MIN_NAMES, digits=9, widest=main_shape(spark, folder).widest)
    factors = small_table(spark, factor=list(NAMES))
    return wf.rolling_ic(ic, windows, factors).select("rebalance_date", "trade_date", "age", "factor", r("ic").alias("ic"))


@register("join_block_history", with_sql(PANEL_SQL, CALENDAR_SQL, hist_sql(start=START, end=END), select="SELECT rebalance_date, trade_date, CAST(age AS INTEGER) AS age FROM hist"))
def join_block_history(spark, folder):
    calendar = main_calendar(spark, folder)
    blocks = wf.rebalance_calendar(calendar, START, END, UPDATE)
    return wf.history_windows(blocks, calendar, horizon=HORIZON, lookback=LOOKBACK)


@register(
    "join_lookup_default",
    with_sql(PANEL_SQL, "seen AS (SELECT n_lines, avg(ret_share) AS m FROM panel GROUP BY 1 HAVING count(*) >= 50)", select="SELECT p.entity, p.trade_date, round(coalesce(m, 0.5e0), 10) + 0e0 AS encoded FROM panel p LEFT JOIN seen USING (n_lines)"),
)
def join_lookup_default(spark, folder):
    from panelforge.session import broadcast_checked

    panel = sources.supplier_week(spark, folder)
    seen = panel.groupBy("n_lines").agg(F.avg("ret_share").alias("m"), F.count("*").alias("n")).where("n >= 50").drop("n")
    joined = panel.join(broadcast_checked(seen), "n_lines", "left")
    return joined.select("entity", "trade_date", r(F.coalesce("m", F.lit(0.5))).alias("encoded"))


@register(
    "join_config_grid",
    with_sql(PANEL_SQL, "d AS (SELECT trade_date, sum(rev) AS rev FROM panel GROUP BY 1)", select="SELECT p AS power, z AS dead_zone, m AS mode, count(*) AS days FROM d, (SELECT unnest([1e0, 1.5e0]) AS p), (SELECT unnest([0e0, 0.01e0, 0.03e0]) AS z), (SELECT unnest(['linear', 'binary', 'tanh']) AS m) WHERE rev > 1e5 * p GROUP BY 1, 2, 3"),
)
def join_config_grid(spark, folder):
    """Parameter tables are crossed with a calendar-sized table."""
    daily = sources.supplier_week(spark, folder).groupBy("trade_date").agg(F.sum("rev").alias("rev"))
    power = small_table(spark, power=[1.0, 1.5])
    zone = small_table(spark, dead_zone=[0.0, 0.01, 0.03])
    mode = small_table(spark, mode=["linear", "binary", "tanh"])
    grid = power.crossJoin(zone).crossJoin(mode)  # 18 rows
    kept = daily.crossJoin(F.broadcast(grid)).where(F.col("rev") > F.lit(1e5) * F.col("power"))
    return kept.groupBy("power", "dead_zone", "mode").agg(F.count("*").alias("days"))


@register(
    "join_importance_align",
    with_sql(PANEL_SQL, "a AS (SELECT entity, sum(n_lines) AS va FROM panel WHERE trade_date < '19960101' GROUP BY 1)", "b AS (SELECT entity, sum(n_lines) AS vb FROM panel WHERE trade_date >= '20010701' GROUP BY 1)", select="SELECT coalesce(a.entity, b.entity) AS entity, coalesce(va, 0e0) AS validation, coalesce(vb, 0e0) AS test, coalesce(vb, 0e0) - coalesce(va, 0e0) AS change FROM a FULL OUTER JOIN b ON a.entity = b.entity"),
)
def join_importance_align(spark, folder):
    from panelforge.plans.experiments import align_scores

    panel = sources.supplier_week(spark, folder)
    part = lambda cond, name: panel.where(cond).groupBy("entity").agg(F.sum("n_lines").alias(name))
    return align_scores(
        part(F.col("trade_date") < "19960101", "validation"), part(F.col("trade_date") >= "20010701", "test"), "entity"
    )


@register(
    "join_audit_calendar",
    with_sql(PANEL_SQL, CALENDAR_SQL, "m AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS date, strftime(o_orderdate - INTERVAL 42 DAY, '%Y%m%d') AS train_end FROM orders)", select="SELECT m.date, m.train_end, coalesce(d.position, -1) AS date_position, coalesce(t.position, 1000000000) AS train_position FROM m LEFT JOIN cal d ON d.trade_date = m.date LEFT JOIN cal t ON t.trade_date = m.train_end"),
)
def join_audit_calendar(spark, folder):
    orders = sources.scan(spark, f"{folder}/orders.parquet", ["o_orderdate"])
    models = orders.select(
        F.date_format("o_orderdate", "yyyyMMdd").alias("date"),
        F.date_format(F.col("o_orderdate") - F.expr("INTERVAL 42 DAY"), "yyyyMMdd").alias("train_end"),
    ).distinct()
    return audit_columns(models, main_calendar(spark, folder), main_shape(spark, folder))


@register(
    "previous_membership",
    with_sql(
        LABELLED_SQL, CALENDAR_SQL,
        "t AS (SELECT l.entity, c.position FROM labelled l JOIN cal c USING (trade_date) WHERE is_target_topk = 1)",
        select="SELECT a.position, count(*) AS kept FROM t a JOIN t b ON a.entity = b.entity AND a.position = b.position + 1 GROUP BY 1",
    ),
)
def previous_membership(spark, folder):
    """Size of the intersection of each date's top-k names with the previous date's."""
    labelled = labelled_panel(spark, folder).where("is_target_topk = 1").select("entity", "trade_date")
    top = cal.with_position(labelled, main_calendar(spark, folder), main_shape(spark, folder)).select("entity", "position")
    before = top.select("entity", (F.col("position") + 1).alias("position"))
    return top.join(before, ["entity", "position"]).groupBy("position").agg(F.count("*").alias("kept"))


# --- D: aggregations ---------------------------------------------------------------------


@register("count_by_date", with_sql(PANEL_SQL, select="SELECT trade_date, count(*) AS names, count(disc) AS with_disc FROM panel GROUP BY 1"))
def count_by_date(spark, folder):
    return sources.supplier_week(spark, folder).groupBy("trade_date").agg(F.count("*").alias("names"), F.count("disc").alias("with_disc"))


@register(
    "describe_by_month",
    with_sql(MAIN_SQL, select=f"SELECT substr(trade_date, 1, 6) AS month, round(avg({LABEL}), 10) + 0e0 AS mean, count({LABEL}) AS n, round(stddev_samp({LABEL}), 10) + 0e0 AS std, round(median({LABEL}), 10) + 0e0 AS med, min({LABEL}) AS low, max({LABEL}) AS high FROM main GROUP BY 1"),
)
def describe_by_month(spark, folder):
    """Medians come from positions, so a month's values are never gathered in one task."""
    y, rows = F.col(LABEL), main_panel(spark, folder).select(F.substring("trade_date", 1, 6).alias("month"), "entity", LABEL)
    stats = rows.groupBy("month").agg(
        r(F.avg(y)).alias("mean"), F.count(y).alias("n"), r(F.stddev_samp(y)).alias("std"), F.min(y).alias("low"), F.max(y).alias("high")
    )
    placed = ordinal_rank(rows, ["month"], LABEL, "place").join(broadcast_within(stats.select("month", "n"), main_shape(spark, folder).dates), "month")
    middle = placed.where(F.col("place").between(F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2)))
    return stats.join(middle.groupBy("month").agg(r(F.avg(y)).alias("med")), "month", "left")


@register(
    "pearson_by_date",
    with_sql(
        MAIN_SQL, f"rk AS (SELECT trade_date, {avg_rank_sql('px', 'trade_date')} AS x, {avg_rank_sql('disc', 'trade_date')} AS y FROM main)",
        select=f"SELECT trade_date, round({pearson_sql('x', 'y')}, 10) + 0e0 AS corr FROM rk GROUP BY 1",
    ),
)
def pearson_by_date(spark, folder):
    widest = main_shape(spark, folder).widest
    df = average_rank(main_panel(spark, folder), ["trade_date"], "px", "x", widest=widest)
    df = average_rank(df, ["trade_date"], "disc", "y", widest=widest)
    return df.groupBy("trade_date").agg(r(pearson(F.col("x"), F.col("y"))).alias("corr"))


@register(
    "moment_correlation",
    with_sql(MAIN_SQL, select=f"SELECT substr(trade_date, 1, 6) AS month, round({pearson_sql('disc', LABEL, min_rows=20)}, 7) + 0e0 AS corr FROM main GROUP BY 1"),
)
def moment_correlation(spark, folder):
    month = F.substring("trade_date", 1, 6).alias("month")
    return main_panel(spark, folder).groupBy(month).agg(r(pearson(F.col("disc"), F.col(LABEL), min_rows=20), 7).alias("corr"))


@register("distinct_dates", with_sql(PANEL_SQL, CALENDAR_SQL, select="SELECT trade_date, position FROM cal"))
def distinct_dates(spark, folder):
    return main_calendar(spark, folder)


@register("distinct_codes", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS entity FROM events")
def distinct_codes(spark, folder):
    return sources.user_day(spark, folder).select("entity").distinct()


@register("distinct_month_count", with_sql(PANEL_SQL, select="SELECT substr(trade_date, 1, 4) AS year, count(DISTINCT substr(trade_date, 1, 6)) AS months FROM panel GROUP BY 1"))
def distinct_month_count(spark, folder):
    return sources.supplier_week(spark, folder).groupBy(F.substring("trade_date", 1, 4).alias("year")).agg(
        F.countDistinct(F.substring("trade_date", 1, 6)).alias("months")
    )


@register(
    "conditional_mean",
    with_sql(MAIN_SQL, select=f"SELECT trade_date, round(avg(CASE WHEN n_lines >= 2 THEN {LABEL} END), 10) + 0e0 AS many, round(avg(CASE WHEN n_lines < 2 THEN {LABEL} END), 10) + 0e0 AS few FROM main GROUP BY 1"),
)
def conditional_mean(spark, folder):
    many = F.col("n_lines") >= 2
    return main_panel(spark, folder).groupBy("trade_date").agg(
        r(F.avg(F.when(many, F.col(LABEL)))).alias("many"), r(F.avg(F.when(~many, F.col(LABEL)))).alias("few")
    )


@register("share_of_true", with_sql(MAIN_SQL, select=f"SELECT substr(trade_date, 1, 6) AS month, round(avg(CASE WHEN {LABEL} > 0 THEN 1e0 ELSE 0e0 END), 10) AS win_rate FROM main GROUP BY 1"))
def share_of_true(spark, folder):
    return main_panel(spark, folder).groupBy(F.substring("trade_date", 1, 6).alias("month")).agg(r(share(F.col(LABEL) > 0)).alias("win_rate"))


@register(
    "weighted_mean_missing",
    with_sql(
        PANEL_SQL,
        select="SELECT trade_date, round(sum(disc * qty) / nullif(sum(CASE WHEN disc IS NOT NULL THEN qty END), 0e0), 10) + 0e0 AS known, round(coalesce(sum(disc * qty), 0e0) / nullif(sum(qty), 0e0), 10) + 0e0 AS all_weights FROM panel GROUP BY 1",
    ),
)
def weighted_mean_missing(spark, folder):
    x, w = F.col("disc"), F.col("qty")
    return sources.supplier_week(spark, folder).groupBy("trade_date").agg(
        r(weighted_mean(x, w)).alias("known"), r(weighted_mean(x, w, count_missing=True)).alias("all_weights")
    )


@register("threshold_count", with_sql(MAIN_SQL, select=f"SELECT substr(trade_date, 1, 6) AS month, CAST(sum(CASE WHEN abs({LABEL}) >= 0.05e0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM main GROUP BY 1"))
def threshold_count(spark, folder):
    return main_panel(spark, folder).groupBy(F.substring("trade_date", 1, 6).alias("month")).agg(
        F.sum(F.when(F.abs(LABEL) >= 0.05, 1).otherwise(0)).alias("n")
    )


@register("argmax_by_group", with_sql(MAIN_SQL, f"m AS (SELECT entity, substr(trade_date, 1, 6) AS month, round(abs(avg({LABEL})), 9) AS a FROM main GROUP BY 1, 2)", select="SELECT entity, month AS peak_month, a + 0e0 AS best FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY a DESC NULLS LAST, month ASC) AS r FROM m WHERE a IS NOT NULL) WHERE r = 1"))
def argmax_by_group(spark, folder):
    """max_by with the earliest month winning ties, combined map-side."""
    monthly = main_panel(spark, folder).groupBy("entity", F.substring("trade_date", 1, 6).alias("month")).agg(
        F.round(F.abs(F.avg(LABEL)), 9).alias("a")
    ).where(F.col("a").isNotNull())
    best = F.min_by("month", F.struct(-F.col("a"), F.col("month")))
    return monthly.groupBy("entity").agg(best.alias("peak_month"), F.max("a").alias("best"))


# --- G, H: sorts and sets ----------------------------------------------------------------


@register("sorted_panel", with_sql(PANEL_SQL, select="SELECT trade_date, entity, px FROM panel"))
def sorted_panel(spark, folder):
    """Ordered by date and entity; ranges are cut from a sample, so a large date is split."""
    panel = sources.supplier_week(spark, folder).select("trade_date", "entity", "px")
    return panel.repartitionByRange("trade_date", "entity").sortWithinPartitions("trade_date", "entity")


@register("best_rows_limit", with_sql(PANEL_SQL, select="SELECT entity, trade_date, rev FROM panel ORDER BY rev DESC, trade_date, entity LIMIT 600"))
def best_rows_limit(spark, folder):
    """Candidate keep: top-k by score, planned as a distributed take-ordered."""
    return sources.supplier_week(spark, folder).select("entity", "trade_date", "rev").orderBy(F.desc("rev"), "trade_date", "entity").limit(600)


@register("union_blocks", with_sql(PANEL_SQL, select="SELECT entity, trade_date, px, 1 AS block FROM panel WHERE trade_date < '19980101' UNION ALL SELECT entity, trade_date, px, 2 AS block FROM panel WHERE trade_date >= '19980101'"))
def union_blocks(spark, folder):
    panel = sources.supplier_week(spark, folder).select("entity", "trade_date", "px")
    early = panel.where(F.col("trade_date") < "19980101").withColumn("block", F.lit(1))
    late = panel.where(F.col("trade_date") >= "19980101").select(F.lit(2).alias("block"), "px", "trade_date", "entity")
    return early.unionByName(late)


@register("detect_duplicates", "SELECT l_partkey, l_suppkey, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def detect_duplicates(spark, folder):
    lines = sources.scan(spark, f"{folder}/lineitem.parquet", ["l_partkey", "l_suppkey"])
    return sources.duplicate_keys(lines, ["l_partkey", "l_suppkey"])


@register("drop_duplicates", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def drop_duplicates(spark, folder):
    return sources.scan(spark, f"{folder}/lineitem.parquet", ["l_partkey", "l_suppkey"]).dropDuplicates(["l_partkey", "l_suppkey"])


@register("gappy_panel_label", f"""WITH p AS (SELECT CAST(l_partkey AS VARCHAR) AS entity, strftime(date_trunc('week', l_shipdate), '%Y%m%d') AS trade_date,
 {fixed_sql('CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE)')} AS px FROM lineitem GROUP BY 1, 2)
SELECT entity, trade_date, round(lead(px, 3) OVER (PARTITION BY entity ORDER BY trade_date) / px - 1e0, 10) + 0e0 AS {LABEL} FROM p""")
def gappy_panel_label(spark, folder):
    """Row windows ignore calendar gaps."""
    part = sources.part_week(spark, folder).select("entity", "trade_date", "px")
    return rounded(sources.with_forward_return(part, "px", 3, LABEL), [LABEL]).drop("px")


@register("monthly_panel_ic", f"""WITH p AS (SELECT CAST(l_suppkey AS VARCHAR) AS entity, strftime(l_shipdate, '%Y%m') || '01' AS trade_date,
 CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
 {fixed_sql('CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE)')} AS px FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, {fixed_sql('lead(px, 1) OVER (PARTITION BY entity ORDER BY trade_date) / px - 1e0')} AS y FROM p),
c AS (SELECT * FROM m WHERE y IS NOT NULL),
k AS (SELECT trade_date, {avg_rank_sql('qty', 'trade_date', pct=False)} AS a, {avg_rank_sql('y', 'trade_date', pct=False)} AS b FROM c)
SELECT trade_date, count(*) AS names, round({pearson_sql('a', 'b')}, 10) + 0e0 AS ic FROM k GROUP BY 1 HAVING count(*) >= {MIN_NAMES}""")
def monthly_panel_ic(spark, folder):
    from panelforge.operators.quality import daily_rank_ic

    df = sources.with_forward_return(sources.supplier_month(spark, folder), "px", 1, "y")
    df = df.withColumn("y", fixed(F.col("y"), 6))
    return rounded(daily_rank_ic(df, "y", value="qty", min_names=MIN_NAMES, keys=["trade_date"]), ["ic"])


@register("event_panel_ranks", f"""WITH p AS (SELECT CAST(user_id AS VARCHAR) AS entity, strftime(ts, '%Y%m%d') AS trade_date,
 CAST(count(*) AS DOUBLE) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2)
SELECT entity, trade_date, n_events, {avg_rank_sql('total', 'trade_date')} AS pct, CAST({ordinal_sql('total', 'trade_date', descending=True)} AS BIGINT) AS position FROM p""")
def event_panel_ranks(spark, folder):
    panel = sources.user_day(spark, folder)
    ranked = average_rank(panel, ["trade_date"], "total", "pct")
    ranked = ordinal_rank(ranked, ["trade_date"], "total", "position", descending=True)
    return ranked.select("entity", "trade_date", "n_events", "pct", F.col("position").cast("long").alias("position"))


@register("category_value_counts", with_sql(PANEL_SQL, select="SELECT CASE WHEN ret_share > 0.5e0 THEN 'high' WHEN ret_share > 0 THEN 'some' ELSE 'none' END AS category, count(*) AS n FROM panel GROUP BY 1"))
def category_value_counts(spark, folder):
    from panelforge.plans.experiments import value_counts

    share_ = F.col("ret_share")
    kind = F.when(share_ > 0.5, "high").when(share_ > 0, "some").otherwise("none")
    return value_counts(sources.supplier_week(spark, folder).select(kind.alias("category")), "category")
