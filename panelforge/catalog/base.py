"""Registry of runnable queries and the DuckDB statements they are checked against."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.functions.scalar import fixed
from panelforge.functions.expressions import parse, temporal_pairs
from panelforge.operators.calendar import PanelShape, measure, trading_calendar
from panelforge.operators.labels import add_labels, labels_among, search_mask
from panelforge.operators.ranks import widest_group
from panelforge.session import broadcast_checked, materialize, path_exists, write_table
from panelforge.sources import panel as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Settings of the registered queries (the tables hold 8 to 1,000 names per date).
LABEL = "future_ret"
HORIZON = 5
K = 10
MIN_NAMES = 6
MIN_DAYS = 3
EDGES = (0.90, 0.95, 0.98, 0.99)
DIGITS = 9
LOOKBACK = 30
UPDATE = 5
# One year, where bounds are the feature; windows and walks take every date the tables have.
START, END = "20000101", "20001231"
WALK_START, WALK_END = "19000101", "20991231"
FEATURES = ("px", "qty", "rev", "disc", "tax", "n_lines", "ret_share")
CATEGORIES = (
    ("px", "price"), ("qty", "size"), ("rev", "size"), ("disc", "terms"),
    ("tax", "terms"), ("n_lines", "flow"), ("ret_share", "flow"),
)
LIBRARY = {
    "f1": '["mul","qty","disc"]',
    "f2": '["div",["delta_5","px"],["std_20","px"]]',
    "f3": '["sub",["mean_5","tax"],["signed_log","n_lines"]]',
    "f4": '["max",["zscore_20","rev"],["neg","ret_share"]]',
    "f5": '["add",["ts_rank_20","disc"],["min","tax",["slope_5","px"]]]',
    "f6": '["signed_sqrt",["abs",["sub","px",["mean_5","px"]]]]',
}
DIRECTIONS = {"f1": 1, "f2": 1, "f3": -1, "f4": 1, "f5": 1, "f6": -1}
NAMES = tuple(LIBRARY)


def register(name: str, sql: str | None = None):
    """Decorator: add a query and, when given, its oracle statement."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


# --- Spark inputs ------------------------------------------------------------------------

_PREPARED: dict[tuple[str, str, str], str] = {}
_SHAPES: dict[tuple[str, str], PanelShape] = {}


def _key(spark: SparkSession, folder: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, folder


def main_panel(spark: SparkSession, folder: str, only: Sequence[str] | None = None) -> DataFrame:
    """supplier × week with the forward return.

    ``only`` names the columns a query needs besides keys and label, if any. They are built and written alone
    unless the session has written the whole panel already.
    """
    build = lambda: sources.supplier_week_ahead(spark, folder, HORIZON, LABEL)
    if only is None or _written(spark, folder, "panel"):
        return prepared(spark, folder, "panel", build)
    return prepared(spark, folder, f"panel {' '.join(only)}", lambda: build().select("entity", "trade_date", *only, LABEL))


def main_shape(spark: SparkSession, folder: str, only: Sequence[str] | None = None) -> PanelShape:
    """Measured once per prepared panel; queries on it plan from these bounds."""
    key = _key(spark, folder)
    if key not in _SHAPES:
        _SHAPES[key] = measure(main_panel(spark, folder, only))
    return _SHAPES[key]


def _written(spark: SparkSession, folder: str, name: str) -> str | None:
    path = _PREPARED.get((*_key(spark, folder), name))
    return path if path and path_exists(spark, f"{path}/_SUCCESS") else None


def prepared(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table written once per session and read by every query that needs it.

    It is written again if the shared folder was cleared in between.
    """
    path = _written(spark, folder, name)
    if path is None:
        path = _PREPARED[*_key(spark, folder), name] = write_table(build())
    return spark.read.parquet(path)


def sampled_panel(spark: SparkSession, folder: str, n: int, seed: int, months: int, *, label: str | None = None) -> DataFrame:
    """Whole histories of the entities that the search mask takes, labels of the rows it takes.

    Mask and ranks read entity, date and label of the whole panel. All columns are built for the lines
    of the entities taken only, unless the session has written the whole panel already.
    """

    def build():
        whole = main_panel(spark, folder, ()).select("entity", "trade_date", LABEL)
        taken = materialize(search_mask(whole, n, seed, months=months, label=label).where("in_search"))
        names = taken.select(F.col("entity").alias("__name")).distinct()
        if _written(spark, folder, "panel"):
            same = F.col("entity").eqNullSafe(F.col("__name"))
            rows = main_panel(spark, folder).join(broadcast_checked(names), same, "left_semi")
        else:
            rows = sources.supplier_week_ahead(spark, folder, HORIZON, LABEL, entities=names)
        labels = labels_among(taken, whole, LABEL, EDGES).drop(LABEL)
        flagged = rows.join(broadcast_checked(labels), ["entity", "trade_date"], "left")
        return flagged.withColumn("in_search", F.coalesce("in_search", F.lit(False)))

    return prepared(spark, folder, f"sampled {n} {seed} {months} {label}", build)


def labelled_panel(spark: SparkSession, folder: str, *, position: bool = False) -> DataFrame:
    widest = main_shape(spark, folder).widest
    build = lambda: add_labels(main_panel(spark, folder), LABEL, K, EDGES, position=position, widest=widest)
    return build() if position else prepared(spark, folder, "labelled", build)


def main_calendar(spark: SparkSession, folder: str) -> DataFrame:
    return prepared(spark, folder, "calendar", lambda: trading_calendar(main_panel(spark, folder)).coalesce(1))


def r(column, digits: int = 10):
    """Rounded output without a negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 10) -> DataFrame:
    return df.select(*[r(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


# --- DuckDB building blocks --------------------------------------------------------------


def fixed_sql(x: str, digits: int = 6) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5e0) / 1e{digits})"


PANEL_SQL = f"""panel AS (
  SELECT entity, trade_date, {fixed_sql('rev / qty')} AS px, qty, rev,
         CASE WHEN n_lines > 1 THEN {fixed_sql('sdisc / n_lines')} END AS disc,
         {fixed_sql('stax / n_lines')} AS tax, n_lines, {fixed_sql('sret / n_lines')} AS ret_share
  FROM (
    SELECT CAST(l_suppkey AS VARCHAR) AS entity,
           strftime(date_trunc('week', l_shipdate), '%Y%m%d') AS trade_date,
           CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS rev,
           CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) AS sdisc,
           CAST(sum(CAST(l_tax AS DECIMAL(18,4))) AS DOUBLE) AS stax,
           CAST(count(*) AS DOUBLE) AS n_lines,
           CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS sret
    FROM lineitem GROUP BY 1, 2) t)"""

SERIES = "PARTITION BY entity ORDER BY trade_date"

MAIN_SQL = PANEL_SQL + f""",
main AS (
  SELECT *, {fixed_sql(f'lead(px, {HORIZON}) OVER ({SERIES}) / px - 1e0', 6)} AS {LABEL} FROM panel)"""


def avg_rank_sql(value: str, part: str, *, pct: bool = True) -> str:
    w = f"PARTITION BY {part} ORDER BY {value} ASC NULLS LAST"
    rank = f"(rank() OVER ({w}) + count({value}) OVER ({w} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2e0"
    if pct:
        rank = f"({rank}) / count({value}) OVER (PARTITION BY {part})"
    return f"CASE WHEN {value} IS NOT NULL THEN {rank} END"


def ordinal_sql(value: str, part: str, *, descending: bool = False, pct: bool = False) -> str:
    w = f"PARTITION BY {part} ORDER BY {value} {'DESC' if descending else 'ASC'} NULLS LAST, entity ASC"
    rank = f"row_number() OVER ({w})"
    if pct:
        rank = f"{rank} / CAST(count({value}) OVER (PARTITION BY {part}) AS DOUBLE)"
    return f"CASE WHEN {value} IS NOT NULL THEN {rank} END"


def relevance_sql(rank: str) -> str:
    return " + ".join(f"(CASE WHEN {rank} >= {e!r}e0 THEN 1 ELSE 0 END)" for e in EDGES)


LABELLED_SQL = MAIN_SQL + f""",
ranked_label AS (SELECT *, {avg_rank_sql(LABEL, 'trade_date')} AS target_rank,
  {ordinal_sql(LABEL, 'trade_date', descending=True)} AS target_position FROM main),
labelled AS (SELECT *, {relevance_sql('target_rank')} AS relevance,
  CASE WHEN target_position <= {K} THEN 1 ELSE 0 END AS is_target_topk FROM ranked_label)"""

CALENDAR_SQL = """cal AS (SELECT trade_date, CAST(row_number() OVER (ORDER BY trade_date) - 1 AS INTEGER) AS position
  FROM (SELECT DISTINCT trade_date FROM panel))"""


def pearson_sql(x: str, y: str, *, min_rows: int = 1, tiny: float = 1e-12) -> str:
    both = f"FILTER (WHERE ({x}) IS NOT NULL AND ({y}) IS NOT NULL)"
    n = f"CAST(count(*) {both} AS DOUBLE)"
    sx, sy = f"sum({x}) {both}", f"sum({y}) {both}"
    sxx, syy = f"sum(({x})*({x})) {both}", f"sum(({y})*({y})) {both}"
    sxy = f"sum(({x})*({y})) {both}"
    vx = f"({sxx} - {sx} * {sx} / nullif({n}, 0e0))"
    vy = f"({syy} - {sy} * {sy} / nullif({n}, 0e0))"
    cov = f"({sxy} - {sx} * {sy} / nullif({n}, 0e0))"
    return (
        f"CASE WHEN {n} >= {min_rows} AND {vx} > {n} * {tiny!r} AND {vy} > {n} * {tiny!r} "
        f"THEN {cov} / sqrt({vx} * {vy}) END"
    )


def frame_sql(rows: int) -> str:
    return f"({SERIES} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def temporal_sql(name: str, x: str) -> str:
    lag = lambda k: f"lag({x}, {k}) OVER ({SERIES})"
    guarded = lambda agg, rows, least: (
        f"CASE WHEN count({x}) OVER {frame_sql(rows)} >= {least} THEN {agg}({x}) OVER {frame_sql(rows)} END"
    )
    if name == "delta_5":
        return f"{x} - {lag(5)}"
    if name == "slope_5":
        return f"({x} * 2e0 + {lag(1)} - {lag(3)} - {lag(4)} * 2e0) / 10e0"
    if name == "mean_5":
        return guarded("avg", 5, 3)
    if name == "std_20":
        return guarded("stddev_samp", 20, 5)
    if name == "zscore_20":
        std = guarded("stddev_samp", 20, 5)
        return f"CASE WHEN ({std}) > 1e-12 THEN ({x} - ({guarded('avg', 20, 5)})) / ({std}) END"
    seen = f"list_filter(list({x}) OVER {frame_sql(20)}, lambda v: v IS NOT NULL)"
    return (
        f"CASE WHEN {x} IS NOT NULL AND len({seen}) >= 5 THEN (len(list_filter({seen}, lambda v: v < {x})) + "
        f"(len(list_filter({seen}, lambda v: v = {x})) + 1) / 2e0) / len({seen}) END"
    )


def tree_sql(tree) -> str:
    if isinstance(tree, str):
        return f"CAST({tree} AS DOUBLE)"
    name, *rest = tree
    if name in ("delta_5", "slope_5", "mean_5", "std_20", "zscore_20", "ts_rank_20"):
        return f"{name}__{rest[0]}"
    a, *b = [f"({tree_sql(x)})" for x in rest]
    b = b[0] if b else ""
    body = {
        "neg": f"-{a}",
        "abs": f"abs({a})",
        "signed_log": f"sign({a}) * ln(1e0 + abs({a}))",
        "signed_sqrt": f"sign({a}) * sqrt(abs({a}))",
        "add": f"{a} + {b}",
        "sub": f"{a} - {b}",
        "mul": f"{a} * {b}",
        "div": f"CASE WHEN abs({b}) > 1e-8 THEN {a} / {b} END",
        "min": f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN least({a}, {b}) END",
        "max": f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest({a}, {b}) END",
    }[name]
    return f"CASE WHEN ({body}) IS NOT NULL THEN greatest(least({body}, 1e6), -1e6) END"


def factors_sql(source: str, keep: Sequence[str] = (), expressions=None, directions=None) -> str:
    """CTEs ``temporal`` and ``wide``: one rounded column per expression."""
    expressions = expressions or LIBRARY
    trees = {n: parse(t) for n, t in expressions.items()}
    extra = "".join(f", {temporal_sql(op, f)} AS {op}__{f}" for op, f in sorted(temporal_pairs(trees.values())))
    cols = ", ".join(
        f"round({tree_sql(t)}, {DIGITS}) * {(directions or {}).get(n, 1)} + 0e0 AS {n}" for n, t in trees.items()
    )
    kept = "".join(f", {c}" for c in keep)
    return f"temporal AS (SELECT *{extra} FROM {source}), wide AS (SELECT entity, trade_date{kept}, {cols} FROM temporal)"


def long_sql(source: str = "wide", keep: Sequence[str] = (), names: Sequence[str] = NAMES) -> str:
    kept = "".join(f", {c}" for c in keep)
    parts = [f"SELECT '{n}' AS factor, entity, trade_date{kept}, {n} AS value FROM {source}" for n in names]
    return "long AS (" + " UNION ALL ".join(parts) + ")"


def hist_sql(lookback: int = LOOKBACK, update: int = UPDATE, start: str = WALK_START, end: str = WALK_END) -> str:
    """CTEs ``blocks`` and ``hist`` (needs panel and cal)."""
    return f"""test AS (SELECT trade_date, position, position - min(position) OVER () AS i FROM cal
  WHERE trade_date BETWEEN '{start}' AND '{end}'),
blocks AS (SELECT trade_date, position,
  min(trade_date) OVER (PARTITION BY i // {update}) AS rebalance_date,
  min(position) OVER (PARTITION BY i // {update}) AS rebalance_position FROM test),
heads AS (SELECT DISTINCT rebalance_date, rebalance_position FROM blocks),
hist AS (SELECT h.rebalance_date, c.trade_date, h.rebalance_position - {HORIZON + 1} - c.position AS age
  FROM heads h JOIN cal c ON c.position BETWEEN h.rebalance_position - {HORIZON} - {lookback}
   AND h.rebalance_position - {HORIZON + 1}
  WHERE h.rebalance_position - {HORIZON} - {lookback} >= 0)"""


def with_sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def group_width(df: DataFrame, keys: Sequence[str] = ("trade_date",)) -> int:
    return widest_group(df, keys)
