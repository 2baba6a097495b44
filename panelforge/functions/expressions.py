"""Factor expressions: canonical JSON text <-> Spark columns, and jobs over expression tables.

Grammar (prefix lists): a leaf is a feature name; unary and binary operators take
sub-expressions; a temporal operator takes one bare feature.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.functions import scalar
from panelforge.operators.series import TEMPORAL, temporal_column, with_temporals
from panelforge.session import tune

# SQL of each operator over operands {0} and {1}; the Column form of each is in
# functions.scalar. Text is parsed once per projection, which keeps plan building fast for
# populations of many expressions.
UNARY = {
    "neg": "-{0}",
    "abs": "abs({0})",
    "signed_log": "signum({0}) * log1p(abs({0}))",
    "signed_sqrt": "signum({0}) * sqrt(abs({0}))",
}
BINARY = {
    "add": "{0} + {1}",
    "sub": "{0} - {1}",
    "mul": "{0} * {1}",
    "div": f"CASE WHEN abs({{1}}) > {scalar.DIVISOR_FLOOR!r}D THEN {{0}} / {{1}} END",
    "min": "CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN least({0}, {1}) END",
    "max": "CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN greatest({0}, {1}) END",
}


def to_text(tree) -> str:
    """Canonical text: compact JSON, non-ASCII names kept."""
    return json.dumps(tree, ensure_ascii=False, separators=(",", ":"))


def parse(text: str):
    return json.loads(text)


def walk(tree):
    """Every node of the tree, parents first."""
    stack = [tree]
    while stack:
        node = stack.pop()
        yield node
        if not isinstance(node, str):
            stack.extend(reversed(node[1:]))


def node_count(tree) -> int:
    return sum(1 for _ in walk(tree))


def tree_depth(tree) -> int:
    level, deepest = [tree], -1
    while level:
        deepest += 1
        level = [child for node in level if not isinstance(node, str) for child in node[1:]]
    return deepest


def readable(tree) -> str:
    return tree if isinstance(tree, str) else f"{tree[0]}({','.join(map(readable, tree[1:]))})"


def is_valid(tree) -> bool:
    """A temporal operator may only be applied to one bare feature."""
    return all(
        len(node) == 2 and isinstance(node[1], str)
        for node in walk(tree)
        if not isinstance(node, str) and node[0] in TEMPORAL
    )


def temporal_pairs(trees: Iterable) -> set[tuple[str, str]]:
    return {
        (node[0], node[1])
        for tree in trees
        for node in walk(tree)
        if not isinstance(node, str) and node[0] in TEMPORAL
    }


def _clipped(value: str, max_abs: float) -> str:
    bound = f"{float(max_abs)!r}D"
    return f"CASE WHEN ({value}) IS NOT NULL AND NOT isnan({value}) THEN greatest(least({value}, {bound}), -{bound}) END"


def sql_text(tree, max_abs: float = scalar.MAX_ABS, known: Mapping[str, str] | None = None) -> str:
    """SQL for the tree. Operator results are clipped; leaves and temporals are not.

    ``known`` maps the text of sub-expressions that are columns already to their names.
    """
    if isinstance(tree, str):
        return f"CAST(`{tree}` AS DOUBLE)"
    made = (known or {}).get(to_text(tree))
    if made is not None:
        return f"`{made}`"
    name, *operands = tree
    if name in TEMPORAL:
        return f"`{temporal_column(name, operands[0])}`"
    template = {1: UNARY, 2: BINARY}.get(len(operands), {}).get(name)
    if template is None:
        raise ValueError(f"unknown operator {name!r} with {len(operands)} operands")
    return _clipped(template.format(*[f"({sql_text(o, max_abs, known)})" for o in operands]), max_abs)


def compile_tree(tree, max_abs: float = scalar.MAX_ABS) -> Column:
    """Column for one tree whose temporal columns exist."""
    return F.expr(sql_text(tree, max_abs))


def _height(tree) -> int:
    """Operator levels above features and temporal columns."""
    if isinstance(tree, str) or tree[0] in TEMPORAL:
        return 0
    return 1 + max(_height(child) for child in tree[1:])


def with_expressions(source: DataFrame, trees: Mapping[str, object], max_abs: float = scalar.MAX_ABS) -> DataFrame:
    """Add one column per tree; temporal columns must exist already.

    Sub-expressions shared by any of the trees are computed once. One projection per level
    keeps the generated code small: a clip mentions its argument several times, and nesting
    them in one expression would grow exponentially with depth.
    """
    levels: dict[int, dict[str, object]] = {}
    for tree in trees.values():
        for node in walk(tree):
            if _height(node):
                levels.setdefault(_height(node), {})[to_text(node)] = node
    known: dict[str, str] = {}
    kept = source.columns
    for level in sorted(levels):
        made = {text: f"__x{len(known) + i}" for i, text in enumerate(levels[level])}
        source = source.selectExpr(
            "*", *[f"{sql_text(node, max_abs, known)} AS `{made[text]}`" for text, node in levels[level].items()]
        )
        known.update(made)
    return source.selectExpr(
        *[f"`{c}`" for c in kept], *[f"{sql_text(tree, max_abs, known)} AS `{name}`" for name, tree in trees.items()]
    )


def evaluate_expressions(
    panel: DataFrame,
    expressions: Mapping[str, str],
    *,
    keep: Iterable[str] = (),
    max_abs: float = scalar.MAX_ABS,
    digits: int | None = None,
    directions: Mapping[str, int] | None = None,
) -> DataFrame:
    """Wide form: entity, trade_date, ``keep`` and one double column per expression.

    Temporal columns are derived first, from full histories, unless the panel has them.
    ``digits`` rounds the values, which makes ties reproducible across engines.
    """
    tune(panel.sparkSession)
    trees = {name: parse(text) for name, text in expressions.items()}
    missing = {p for p in temporal_pairs(trees.values()) if temporal_column(*p) not in panel.columns}
    source = with_expressions(with_temporals(panel, missing), trees, max_abs)
    made = []
    for name in trees:
        value = f"`{name}`" if digits is None else f"round(`{name}`, {digits})"
        if directions is not None:
            value = f"{value} * {float(directions.get(name, 1))!r}D"
        made.append(f"{value} + 0D AS `{name}`")
    return source.selectExpr("entity", "trade_date", *keep, *made)


def to_long(wide: DataFrame, names: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """(factor, entity, trade_date, keep…, value), one row per expression and panel row.

    An exploded array keeps the input's partitioning by date, which ``unpivot`` would lose,
    so a panel already laid out by date is scored without moving the long rows.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("value")) for n in names])
    return wide.select("entity", "trade_date", *keep, F.explode(cells).alias("__cell")).select(
        F.col("__cell.factor").alias("factor"), "entity", "trade_date", *keep, F.col("__cell.value").alias("value")
    )


# --- jobs over a table with a canonical-text column -------------------------------------

_TOKEN = r'"[^"]*"'
_OPERATOR_OR_LEAF = r'\["[^"]*"|"([^"]*)"'  # group 1 is empty for an operator
_TEMPORAL_ALTERNATIVES = "|".join(TEMPORAL)


def node_count_column(expression: Column) -> Column:
    return F.regexp_count(expression, F.lit(_TOKEN)).cast("int")


def depth_column(expression: Column) -> Column:
    """Deepest bracket level, tracked while scanning the brackets of the text."""
    brackets = F.split(F.regexp_replace(expression, r"[^\[\]]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(state, c):
        now = state["now"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["top"], now).alias("top"))

    return F.aggregate(brackets, start, step, lambda state: state["top"])


def readable_column(expression: Column) -> Column:
    opened = F.regexp_replace(expression, r'\["([^"]*)",', r"$1(")
    return F.regexp_replace(F.regexp_replace(opened, r"\]", ")"), '"', "")


def valid_column(expression: Column) -> Column:
    """Every temporal operator is followed by exactly one quoted feature."""
    used = F.regexp_count(expression, F.lit(rf'\["({_TEMPORAL_ALTERNATIVES})",'))
    proper = F.regexp_count(expression, F.lit(rf'\["({_TEMPORAL_ALTERNATIVES})","[^"]*"\]'))
    return used == proper


def leaves_column(expression: Column) -> Column:
    found = F.regexp_extract_all(expression, F.lit(_OPERATOR_OR_LEAF), F.lit(1))
    return F.filter(found, lambda name: name != "")


def profile_expressions(table: DataFrame, column: str = "expression") -> DataFrame:
    """Add nodes, depth, expression_text and valid."""
    e = F.col(column)
    return table.select(
        "*",
        node_count_column(e).alias("nodes"),
        depth_column(e).alias("depth"),
        readable_column(e).alias("expression_text"),
        valid_column(e).alias("valid"),
    )


def expression_category(table: DataFrame, categories: DataFrame, key: str = "expression") -> DataFrame:
    """Most frequent category of each distinct expression's leaves; ties go to the first name.

    ``categories`` is the (feature, category) dimension, bounded by the feature count.
    """
    leaves = table.select(key).distinct().select(key, F.explode(leaves_column(F.col(key))).alias("feature"))
    counted = (
        leaves.join(F.broadcast(categories), "feature", "left")
        .groupBy(key, F.coalesce("category", F.lit("other")).alias("category"))
        .agg(F.count("*").alias("uses"))
    )
    best = Window.partitionBy(key).orderBy(F.desc("uses"), F.asc("category"))
    return counted.withColumn("r", F.row_number().over(best)).where("r = 1").select(key, "category", "uses")


def feature_usage(table: DataFrame, column: str = "expression") -> DataFrame:
    """How often, and in how many rows, each feature is a leaf."""
    leaves = table.select(leaves_column(F.col(column)).alias("leaves"))
    per_row = leaves.select("leaves", F.explode(F.array_distinct("leaves")).alias("feature")).select(
        "feature", F.size(F.filter("leaves", lambda leaf: leaf == F.col("feature"))).alias("n")
    )
    return per_row.groupBy("feature").agg(F.sum("n").alias("uses"), F.count("*").alias("expressions"))
