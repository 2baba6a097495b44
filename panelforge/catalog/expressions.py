"""Jobs over expression tables, and expressions evaluated over the panel.

The candidate expressions are generated from the rows of ``part``, so their number grows
with the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog.base import (
    CATEGORIES, DIGITS, DIRECTIONS, FEATURES, LABEL, LABELLED_SQL, LIBRARY, MAIN_SQL, NAMES, PANEL_SQL, avg_rank_sql,
    factors_sql, labelled_panel, long_sql, main_panel, main_shape, r, register, rounded, with_sql,
)
from panelforge.functions import expressions as ex
from panelforge.operators.series import TEMPORAL
from panelforge.plans.walkforward import build_factor_frame
from panelforge.session import small_table
from panelforge.sources import panel as sources

_UNARY, _BINARY = list(ex.UNARY), list(ex.BINARY)


def expression_table(spark, folder):
    """(part_key, expression): five shapes of expression, one of them invalid."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    leaf = lambda n: F.concat(F.lit('"'), pick(FEATURES, n), F.lit('"'))
    u, b, b2 = pick(_UNARY, size), pick(_BINARY, key), pick(_BINARY, F.floor(key / 3))
    t = pick(TEMPORAL, F.floor(key / 7))
    l1, l2, l3 = leaf(key), leaf(size), leaf(key + size)
    text = F.concat
    shape = (
        F.when(key % 5 == 0, l1)
        .when(key % 5 == 1, text(F.lit('["'), u, F.lit('",'), l1, F.lit("]")))
        .when(key % 5 == 2, text(F.lit('["'), b, F.lit('",["'), t, F.lit('",'), l1, F.lit("],"), l2, F.lit("]")))
        .when(key % 5 == 3, text(F.lit('["'), b, F.lit('",["'), u, F.lit('",'), l1, F.lit('],["'), b2, F.lit('",'), l2, F.lit(","), l3, F.lit("]]")))
        .otherwise(text(F.lit('["'), t, F.lit('",["'), b, F.lit('",'), l1, F.lit(","), l2, F.lit("]]")))
    )
    return sources.scan(spark, f"{folder}/part.parquet", ["p_partkey", "p_size"]).select(key.alias("part_key"), shape.alias("expression"))


def _pick_sql(names, n):
    return "[" + ", ".join(f"'{x}'" for x in names) + f"][({n}) % {len(names)} + 1]"


def _leaf_sql(n):
    return f"'\"' || {_pick_sql(FEATURES, n)} || '\"'"


EXPRESSIONS_SQL = f"""pieces AS (SELECT p_partkey AS k, {_pick_sql(_UNARY, 'p_size')} AS u, {_pick_sql(_BINARY, 'p_partkey')} AS b,
 {_pick_sql(_BINARY, 'p_partkey // 3')} AS b2, {_pick_sql(TEMPORAL, 'p_partkey // 7')} AS t,
 {_leaf_sql('p_partkey')} AS l1, {_leaf_sql('p_size')} AS l2, {_leaf_sql('p_partkey + p_size')} AS l3 FROM part),
exprs AS (SELECT k AS part_key, CASE k % 5 WHEN 0 THEN l1
 WHEN 1 THEN '["' || u || '",' || l1 || ']'
 WHEN 2 THEN '["' || b || '",["' || t || '",' || l1 || '],' || l2 || ']'
 WHEN 3 THEN '["' || b || '",["' || u || '",' || l1 || '],["' || b2 || '",' || l2 || ',' || l3 || ']]'
 ELSE '["' || t || '",["' || b || '",' || l1 || ',' || l2 || ']]' END AS expression FROM pieces)"""

_SHAPE_SQL = EXPRESSIONS_SQL + """,
parts AS (SELECT e.part_key, e.expression, p.* EXCLUDE (k) FROM exprs e JOIN pieces p ON p.k = e.part_key)"""


def categories(spark):
    features, names = zip(*CATEGORIES)
    return small_table(spark, feature=list(features), category=list(names))


CATEGORIES_SQL = "cats AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{c}')" for f, c in CATEGORIES) + ") AS v(feature, category))"
LEAVES_SQL = """leaves AS (SELECT part_key, expression, unnest(list_filter(regexp_extract_all(expression, '.?"([^"]*)"', 0), lambda s: s[1] <> '[')) AS raw FROM exprs),
leaf AS (SELECT part_key, expression, regexp_extract(raw, '"([^"]*)"', 1) AS feature FROM leaves)"""


@register("expression_nodes", with_sql(EXPRESSIONS_SQL, select="""SELECT part_key, expression, (length(expression) - length(replace(expression, '"', ''))) // 2 AS nodes FROM exprs"""))
def expression_nodes(spark, folder):
    df = expression_table(spark, folder)
    return df.withColumn("nodes", ex.node_count_column(F.col("expression")).cast("long"))


@register("expression_depth", with_sql(EXPRESSIONS_SQL, select="SELECT part_key, expression, CASE part_key % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS depth FROM exprs"))
def expression_depth(spark, folder):
    df = expression_table(spark, folder)
    return df.withColumn("depth", ex.depth_column(F.col("expression")))


@register(
    "expression_text",
    with_sql(
        _SHAPE_SQL,
        select="""SELECT part_key, replace(CASE part_key % 5 WHEN 0 THEN l1 WHEN 1 THEN u || '(' || l1 || ')'
 WHEN 2 THEN b || '(' || t || '(' || l1 || '),' || l2 || ')' WHEN 3 THEN b || '(' || u || '(' || l1 || '),' || b2 || '(' || l2 || ',' || l3 || '))'
 ELSE t || '(' || b || '(' || l1 || ',' || l2 || '))' END, '"', '') AS expression_text FROM parts""",
    ),
)
def expression_text(spark, folder):
    return expression_table(spark, folder).select("part_key", ex.readable_column(F.col("expression")).alias("expression_text"))


@register("expression_valid", with_sql(EXPRESSIONS_SQL, select="SELECT part_key, part_key % 5 <> 4 AS valid FROM exprs"))
def expression_valid(spark, folder):
    return expression_table(spark, folder).select("part_key", ex.valid_column(F.col("expression")).alias("valid"))


@register(
    "expression_category",
    with_sql(
        EXPRESSIONS_SQL, LEAVES_SQL, CATEGORIES_SQL,
        "d AS (SELECT expression, feature, part_key FROM leaf WHERE part_key IN (SELECT min(part_key) FROM exprs GROUP BY expression))",
        "n AS (SELECT expression, coalesce(category, 'other') AS category, count(*) AS uses FROM d LEFT JOIN cats USING (feature) GROUP BY 1, 2)",
        select="SELECT expression, category, uses FROM (SELECT *, row_number() OVER (PARTITION BY expression ORDER BY uses DESC, category) AS r FROM n) WHERE r = 1",
    ),
)
def expression_category(spark, folder):
    return ex.expression_category(expression_table(spark, folder), categories(spark))


@register("feature_usage", with_sql(EXPRESSIONS_SQL, LEAVES_SQL, select="SELECT feature, count(*) AS uses, count(DISTINCT part_key) AS expressions FROM leaf GROUP BY 1"))
def feature_usage(spark, folder):
    return ex.feature_usage(expression_table(spark, folder))


@register("expression_profile", with_sql(EXPRESSIONS_SQL, select="""SELECT (length(expression) - length(replace(expression, '"', ''))) // 2 AS nodes, CASE part_key % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS depth, part_key % 5 <> 4 AS valid, count(*) AS n FROM exprs GROUP BY 1, 2, 3"""))
def expression_profile(spark, folder):
    profiled = ex.profile_expressions(expression_table(spark, folder))
    return profiled.groupBy(F.col("nodes").cast("long").alias("nodes"), "depth", "valid").agg(F.count("*").alias("n"))


@register("expressions_deduplicated", with_sql(EXPRESSIONS_SQL, select="SELECT DISTINCT expression FROM exprs WHERE expression NOT IN (SELECT expression FROM exprs WHERE part_key % 3 = 0)"))
def expressions_deduplicated(spark, folder):
    """New canonical texts only: de-duplicated, then an anti join to the scored ones."""
    from panelforge.plans.search import unseen

    table = expression_table(spark, folder)
    return unseen(table, table.where("part_key % 3 = 0"))


_WIDE_ROUND = ", ".join(f"{n} + 0e0 AS {n}" for n in NAMES)


@register("evaluate_wide", with_sql(MAIN_SQL, factors_sql("main"), select=f"SELECT entity, trade_date, {_WIDE_ROUND} FROM wide"))
def evaluate_wide(spark, folder):
    return rounded(ex.evaluate_expressions(main_panel(spark, folder), LIBRARY, digits=DIGITS), NAMES, 9)


@register("evaluate_long", with_sql(MAIN_SQL, factors_sql("main"), long_sql(), select="SELECT factor, entity, trade_date, value FROM long"))
def evaluate_long(spark, folder):
    wide = ex.evaluate_expressions(main_panel(spark, folder), LIBRARY, digits=DIGITS)
    return rounded(ex.to_long(wide, NAMES), ["value"], 9)


@register(
    "factor_frame_ranked",
    with_sql(
        LABELLED_SQL, factors_sql("labelled", [LABEL, "target_rank"], directions=DIRECTIONS),
        select=f"SELECT entity, trade_date, {LABEL}, target_rank, " + ", ".join(f"coalesce({avg_rank_sql(n, 'trade_date')}, 0.5e0) AS {n}" for n in NAMES) + " FROM wide",
    ),
)
def factor_frame_ranked(spark, folder):
    return build_factor_frame(
        labelled_panel(spark, folder), LIBRARY, keep=[LABEL, "target_rank"], directions=DIRECTIONS, digits=DIGITS,
        widest=main_shape(spark, folder).widest,
    )
