"""Factor quality: IC, NDCG, monthly scores, fitness, review and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog.base import (
    DIGITS, FEATURES, K, LABEL, LABELLED_SQL, LIBRARY, MIN_DAYS, MIN_NAMES, NAMES, avg_rank_sql, factors_sql,
    labelled_panel, long_sql, main_panel, main_shape, pearson_sql, prepared, r, register, rounded, sampled_panel, with_sql,
)
from panelforge.functions import expressions as ex
from panelforge.operators import quality as q
from panelforge.plans import search as sr
from panelforge.session import small_table

KEEP = [LABEL, "target_rank", "relevance"]
MIN_VALID = 12


def library_values(spark, folder):
    """One column per factor, written once."""
    build = lambda: ex.evaluate_expressions(labelled_panel(spark, folder), LIBRARY, keep=KEEP, digits=DIGITS)
    return prepared(spark, folder, "library_values", build)


def library_ics(spark, folder, complete=False):
    widest = main_shape(spark, folder).widest
    return q.factor_ics(library_values(spark, folder), NAMES, complete=complete, min_names=MIN_NAMES, widest=widest)


LONG_SQL = LABELLED_SQL + ",\n" + factors_sql("labelled", KEEP) + ",\n" + long_sql(keep=KEEP)

_G = "factor, trade_date"
IC_SQL = f"""comp AS (SELECT * FROM long WHERE value IS NOT NULL AND {LABEL} IS NOT NULL),
rk AS (SELECT factor, trade_date, {avg_rank_sql('value', _G, pct=False)} AS x, {avg_rank_sql(LABEL, _G, pct=False)} AS y FROM comp),
ic AS (SELECT factor, trade_date, count(*) AS names, {pearson_sql('x', 'y')} AS ic FROM rk GROUP BY 1, 2 HAVING count(*) >= {MIN_NAMES})"""


def pre_sql(label="target_rank"):
    return f"""pre AS (SELECT factor, trade_date, {label} AS y, {avg_rank_sql('value', _G)} AS x FROM long),
ic AS (SELECT factor, trade_date, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS names, {pearson_sql('x', 'y', min_rows=MIN_NAMES)} AS ic FROM pre GROUP BY 1, 2)"""


PRE_SQL = pre_sql()
MONTH_SQL = f"""mon AS (SELECT factor, substr(trade_date, 1, 6) AS month, avg(ic) AS mean_ic, count(*) AS days FROM ic
 WHERE ic IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= {MIN_DAYS})"""
NODES_SQL = "sizes AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', CAST({ex.node_count(ex.parse(t))} AS BIGINT))" for n, t in LIBRARY.items()
) + ") AS v(factor, nodes))"
BEST_SQL = """best AS (SELECT factor, max(abs(mean_ic)) AS best, avg(abs(mean_ic)) AS top3, min(month) FILTER (WHERE r = 1) AS peak
 FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY abs(mean_ic) DESC, month ASC) AS r FROM mon) WHERE r <= 3 GROUP BY 1)"""


@register("daily_rank_ic", with_sql(LONG_SQL, IC_SQL, select="SELECT factor, trade_date, names, round(ic, 10) + 0e0 AS ic FROM ic"))
def daily_rank_ic(spark, folder):
    return rounded(library_ics(spark, folder, complete=True), ["ic"])


@register("daily_rank_ic_preranked", with_sql(LONG_SQL, PRE_SQL, select="SELECT factor, trade_date, names, round(ic, 9) + 0e0 AS ic FROM ic"))
def daily_rank_ic_preranked(spark, folder):
    return rounded(library_ics(spark, folder), ["ic"], 9)


@register("monthly_ic", with_sql(LONG_SQL, IC_SQL, MONTH_SQL, select="SELECT factor, month, round(mean_ic, 10) + 0e0 AS mean_ic, days FROM mon WHERE factor = 'f1'"))
def monthly_ic(spark, folder):
    """Flagship: expression -> daily rank IC -> monthly IC."""
    shape = main_shape(spark, folder)
    wide = ex.evaluate_expressions(main_panel(spark, folder), {"f1": LIBRARY["f1"]}, keep=[LABEL], digits=DIGITS)
    daily = q.daily_rank_ic(ex.to_long(wide, ["f1"], [LABEL]), LABEL, min_names=MIN_NAMES, widest=shape.widest)
    return rounded(q.monthly_ic(daily, min_days=MIN_DAYS), ["mean_ic"])


IC_VOL_SQL = "vol AS (SELECT factor, stddev_samp(ic) AS v, (SELECT count(*) FROM mon m WHERE m.factor = ic.factor) AS n FROM ic GROUP BY 1)"


@register(
    "ic_fitness",
    with_sql(
        LONG_SQL, PRE_SQL, MONTH_SQL, NODES_SQL, BEST_SQL, IC_VOL_SQL,
        select="SELECT factor, nodes, round(top3 - 0.05e0 * v - 0.0005e0 * nodes, 9) + 0e0 AS score, round(best, 9) + 0e0 AS best_month_abs_ic, round(top3, 9) + 0e0 AS mean_top_abs_ic, round(v, 9) + 0e0 AS daily_ic_std, CAST(n AS INTEGER) AS valid_months, peak AS peak_month FROM sizes JOIN best USING (factor) JOIN vol USING (factor)",
    ),
)
def ic_fitness(spark, folder):
    values = library_values(spark, folder)
    daily = sr.materialize(library_ics(spark, folder))
    fit = q.ic_fitness_of(daily, q.column_spread(values, NAMES), q.expression_sizes(spark, LIBRARY), min_days=MIN_DAYS)
    return rounded(fit, ["score", "best_month_abs_ic", "mean_top_abs_ic", "daily_ic_std"], 9)


_GAIN = "(pow(2e0, relevance) - 1e0) / log2(p + 1e0)"


def sides_sql(k=K, min_valid=MIN_VALID):
    side = lambda order, name: f"{name} AS (SELECT factor, trade_date, sum({_GAIN}) AS d FROM (SELECT *, row_number() OVER (PARTITION BY {_G} ORDER BY {order}, entity) AS p FROM valid) WHERE p <= {k} GROUP BY 1, 2)"
    gate = f"n >= {max(min_valid, k)} AND s >= 1e-12 AND i.d > 0"
    return f"""valid AS (SELECT * FROM long WHERE value IS NOT NULL AND target_rank IS NOT NULL),
day AS (SELECT factor, trade_date, count(*) AS n, stddev_pop(value) AS s FROM valid GROUP BY 1, 2),
{side('value DESC', 'hi')}, {side('value ASC', 'lo')}, {side('relevance DESC', 'idl')},
sides AS (SELECT factor, trade_date, CASE WHEN {gate} THEN h.d / i.d END AS pos, CASE WHEN {gate} THEN l.d / i.d END AS neg
 FROM day JOIN hi h USING (factor, trade_date) JOIN lo l USING (factor, trade_date) JOIN idl i USING (factor, trade_date))"""


IC_SIDES_SQL = f"""valid AS (SELECT * FROM long WHERE value IS NOT NULL AND target_rank IS NOT NULL),
rk AS (SELECT factor, trade_date, value, {avg_rank_sql('value', _G, pct=False)} AS x, {avg_rank_sql('target_rank', _G, pct=False)} AS y FROM valid),
raw_sides AS (SELECT factor, trade_date, stddev_pop(value) AS s, {pearson_sql('x', 'y', min_rows=max(MIN_VALID, K))} AS ic FROM rk GROUP BY 1, 2),
sides AS (SELECT factor, trade_date, CASE WHEN s >= 1e-12 THEN ic END AS pos, CASE WHEN s >= 1e-12 THEN -ic END AS neg FROM raw_sides)"""

MONTHS_SQL = f"""months AS (SELECT *, greatest(pos, neg) AS score, CASE WHEN pos >= neg THEN 1 ELSE -1 END AS direction FROM (
 SELECT factor, substr(trade_date, 1, 6) AS month, avg(pos) AS pos, avg(neg) AS neg, count(pos) AS days FROM sides GROUP BY 1, 2 HAVING count(pos) >= {MIN_DAYS}))"""
TOP3_SQL = """sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY score DESC, month ASC) AS r FROM months) WHERE r <= 3),
obj AS (SELECT factor, avg(score) AS raw, min(month) FILTER (WHERE r = 1) AS peak_month, CASE WHEN avg(pos) >= avg(neg) THEN 1 ELSE -1 END AS direction FROM sel GROUP BY 1)"""
PAIR_SQL = """roll AS (SELECT *, row_number() OVER w AS i, CASE WHEN count(score) OVER (PARTITION BY factor ORDER BY month ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2
  THEN avg(score) OVER (PARTITION BY factor ORDER BY month ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) END AS pair FROM months WINDOW w AS (PARTITION BY factor ORDER BY month)),
fin AS (SELECT factor, i AS e FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY pair DESC, month) AS q FROM roll WHERE pair IS NOT NULL) WHERE q = 1),
obj AS (SELECT roll.factor, avg(score) AS raw, max(month) AS peak_month, CASE WHEN avg(pos) >= avg(neg) THEN 1 ELSE -1 END AS direction FROM roll JOIN fin USING (factor) WHERE i BETWEEN e - 1 AND e GROUP BY 1)"""
VOL_SQL = "vol AS (SELECT factor, stddev_pop(CASE WHEN pos >= neg THEN pos ELSE neg END) AS volatility FROM sides GROUP BY 1)"
# Factors without a usable month keep the sentinel score.
_SCORE = "coalesce(round(raw - 0.05e0 * volatility - 0.0005e0 * nodes, 9) + 0e0, -1e9 - 0.0005e0 * nodes) AS score"
_REST = "coalesce(peak_month, '') AS peak_month, coalesce(direction, 1) AS direction FROM sizes LEFT JOIN (SELECT * FROM obj JOIN vol USING (factor)) USING (factor)"
_FIT = f"SELECT factor, nodes, {_SCORE}, coalesce(round(raw, 9) + 0e0, -1e9) AS raw, coalesce(round(volatility, 9) + 0e0, 0e0) AS volatility, {_REST}"


def _sides(spark, folder, kind="ndcg"):
    return q.factor_sides(library_values(spark, folder), NAMES, kind, k=K, min_valid=MIN_VALID, widest=main_shape(spark, folder).widest)


@register("daily_ndcg_sides", with_sql(LONG_SQL, sides_sql(), select="SELECT factor, trade_date, round(pos, 10) + 0e0 AS pos, round(neg, 10) + 0e0 AS neg FROM sides"))
def daily_ndcg_sides(spark, folder):
    return rounded(_sides(spark, folder), ["pos", "neg"])


@register("daily_ic_sides", with_sql(LONG_SQL, IC_SIDES_SQL, select="SELECT factor, trade_date, round(pos, 10) + 0e0 AS pos, round(neg, 10) + 0e0 AS neg FROM sides"))
def daily_ic_sides(spark, folder):
    return rounded(_sides(spark, folder, "ic"), ["pos", "neg"])


@register("directional_months", with_sql(LONG_SQL, sides_sql(), MONTHS_SQL, select="SELECT factor, month, round(pos, 10) + 0e0 AS pos, round(neg, 10) + 0e0 AS neg, days, round(score, 10) + 0e0 AS score, direction FROM months"))
def directional_months(spark, folder):
    return rounded(q.directional_months(_sides(spark, folder), min_days=MIN_DAYS), ["pos", "neg", "score"])


@register("objective_top3", with_sql(LONG_SQL, sides_sql(), MONTHS_SQL, TOP3_SQL, select="SELECT factor, round(raw, 10) + 0e0 AS raw, peak_month, direction FROM obj"))
def objective_top3(spark, folder):
    return rounded(q.top_objective(q.directional_months(_sides(spark, folder), min_days=MIN_DAYS)), ["raw"])


@register("objective_contiguous", with_sql(LONG_SQL, sides_sql(), MONTHS_SQL, PAIR_SQL, select="SELECT factor, round(raw, 10) + 0e0 AS raw, peak_month, direction FROM obj"))
def objective_contiguous(spark, folder):
    return rounded(q.contiguous_objective(q.directional_months(_sides(spark, folder), min_days=MIN_DAYS)), ["raw"])


@register("chosen_side_volatility", with_sql(LONG_SQL, sides_sql(), VOL_SQL, select="SELECT factor, round(volatility, 10) + 0e0 AS volatility FROM vol"))
def chosen_side_volatility(spark, folder):
    return rounded(q.chosen_side_volatility(_sides(spark, folder)), ["volatility"])


def _fitness(spark, folder, objective):
    daily = sr.materialize(_sides(spark, folder, "ic" if objective.endswith("_ic") else "ndcg"))
    fit = q.directional_fitness_of(daily, q.expression_sizes(spark, LIBRARY), objective=objective, min_days=MIN_DAYS)
    return rounded(fit, ["score", "raw", "volatility"], 9)


@register("fitness_ndcg_top3", with_sql(LONG_SQL, sides_sql(), MONTHS_SQL, TOP3_SQL, VOL_SQL, NODES_SQL, select=_FIT))
def fitness_ndcg_top3(spark, folder):
    return _fitness(spark, folder, "top3_ndcg")


@register("fitness_ndcg_contiguous", with_sql(LONG_SQL, sides_sql(), MONTHS_SQL, PAIR_SQL, VOL_SQL, NODES_SQL, select=_FIT))
def fitness_ndcg_contiguous(spark, folder):
    return _fitness(spark, folder, "contiguous_ndcg")


@register("fitness_ic_top3", with_sql(LONG_SQL, IC_SIDES_SQL, MONTHS_SQL, TOP3_SQL, VOL_SQL, NODES_SQL, select=_FIT))
def fitness_ic_top3(spark, folder):
    return _fitness(spark, folder, "top3_ic")


_REVIEW_SQL = f"""SELECT factor, peak AS full_peak_month, round(best, 9) + 0e0 AS full_best_month_abs_ic, round(top3, 9) + 0e0 AS full_top3_month_abs_ic,
 round(m.mean_abs, 9) + 0e0 AS full_mean_abs_month_ic, m.strong AS full_months_abs_ic_ge_005 FROM best JOIN (SELECT factor, avg(abs(mean_ic)) AS mean_abs,
 CAST(sum(CASE WHEN abs(mean_ic) >= 0.05e0 THEN 1 ELSE 0 END) AS BIGINT) AS strong FROM mon GROUP BY 1) m USING (factor)"""


def _validated(spark, folder):
    return q.review_of(library_ics(spark, folder), min_days=MIN_DAYS)


@register("validate_library", with_sql(LONG_SQL, PRE_SQL, MONTH_SQL, BEST_SQL, select=_REVIEW_SQL))
def validate_library(spark, folder):
    columns = ["full_best_month_abs_ic", "full_top3_month_abs_ic", "full_mean_abs_month_ic"]
    return rounded(_validated(spark, folder)[0], columns, 9)


@register(
    "library_reviewed",
    with_sql(
        LONG_SQL, PRE_SQL, MONTH_SQL, NODES_SQL, BEST_SQL, IC_VOL_SQL, f"review AS ({_REVIEW_SQL})",
        "texts AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{t}')" for n, t in LIBRARY.items()) + ") AS v(factor, expression))",
        select="SELECT factor AS name, expression, round(top3 - 0.05e0 * v - 0.0005e0 * nodes, 9) + 0e0 AS score, round(best, 9) + 0e0 AS best_month_abs_ic, round(top3, 9) + 0e0 AS mean_top_abs_ic, CAST(n AS INTEGER) AS valid_months, peak AS peak_month, CAST(nodes AS INTEGER) AS nodes, review.* EXCLUDE (factor) FROM texts JOIN sizes USING (factor) JOIN best USING (factor) JOIN vol USING (factor) JOIN review USING (factor)",
    ),
)
def library_reviewed(spark, folder):
    """A scored library with its full-history review, written and read back."""
    import uuid

    from panelforge.session import work_folder
    from panelforge.sources import store

    texts = small_table(spark, name=list(NAMES), expression=list(LIBRARY.values()))
    fit = ic_fitness(spark, folder).select(
        F.col("factor").alias("name"), "score", "best_month_abs_ic", "mean_top_abs_ic", "valid_months", "peak_month", F.col("nodes").cast("int").alias("nodes")
    )
    library, path = store.with_review(texts.join(fit, "name"), validate_library(spark, folder)), f"{work_folder(spark)}/library-{uuid.uuid4().hex}"
    store.write_library(library, path)
    kept = ["name", "expression", "score", "best_month_abs_ic", "mean_top_abs_ic", "valid_months", "peak_month", "nodes", *store.REVIEW]
    return store.read_library(spark, path).select(*kept)


@register("validate_library_monthly", with_sql(LONG_SQL, PRE_SQL, MONTH_SQL, select="SELECT factor, month, round(mean_ic, 9) + 0e0 AS mean_rank_ic, days AS valid_days FROM mon"))
def validate_library_monthly(spark, folder):
    return rounded(_validated(spark, folder)[1], ["mean_rank_ic"], 9)


# --- M: populations ----------------------------------------------------------------------

_OPTIONS = sr.SearchOptions(
    objective="top3_ndcg", k=K, min_valid=MIN_VALID, min_names=MIN_NAMES, min_days=MIN_DAYS, digits=DIGITS,
    names_per_date=20, temporal=("delta_5", "mean_5", "std_20", "zscore_20", "ts_rank_20", "slope_5"), seed=7,
)


def _population(spark, folder, masked):
    pairs = ex.temporal_pairs(ex.parse(t) for t in LIBRARY.values())
    if masked:
        panel, shape = sampled_panel(spark, folder, 20, 7, 40), main_shape(spark, folder, ())
    else:
        panel, shape = labelled_panel(spark, folder), main_shape(spark, folder)
    scored = sr.score_population(sr.with_temporals(panel, pairs), LIBRARY, _OPTIONS, shape, masked=masked)
    return rounded(scored, ["score"], 9)


_POP = f"SELECT factor, nodes, {_SCORE}, {_REST}"
_MASK_SQL = f"""mm AS (SELECT month FROM (SELECT DISTINCT substr(trade_date, 1, 6) AS month FROM labelled) ORDER BY md5('7:' || month), month LIMIT 40),
masked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY md5('7:' || entity), entity) AS hr FROM labelled)
 WHERE hr <= 20 AND substr(trade_date, 1, 6) IN (SELECT month FROM mm))"""
MASKED_LONG_SQL = LABELLED_SQL + ",\n" + factors_sql("labelled", KEEP) + ",\n" + _MASK_SQL + ",\n" + long_sql(
    "(SELECT w.* FROM wide w JOIN masked m USING (entity, trade_date))", KEEP
)


@register("score_population_sampled", with_sql(MASKED_LONG_SQL, sides_sql(), MONTHS_SQL, TOP3_SQL, VOL_SQL, NODES_SQL, select=_POP))
def score_population_sampled(spark, folder):
    """Temporals see full histories; only the sampled entities and months are scored."""
    return _population(spark, folder, True)


_FIRST_SQL = f"""mm AS (SELECT month FROM (SELECT DISTINCT substr(trade_date, 1, 6) AS month FROM labelled WHERE target_rank IS NOT NULL) ORDER BY md5('7:' || month), month LIMIT 40),
masked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY md5('7:' || entity), entity) AS hr FROM labelled WHERE target_rank IS NOT NULL)
 WHERE hr <= 20 AND substr(trade_date, 1, 6) IN (SELECT month FROM mm))"""
FIRST_LONG_SQL = LABELLED_SQL + ",\n" + factors_sql("labelled", KEEP) + ",\n" + _FIRST_SQL + ",\n" + long_sql(
    "(SELECT w.* FROM wide w JOIN masked m USING (entity, trade_date))", KEEP
)


@register(
    "score_population_phase_ic",
    with_sql(
        FIRST_LONG_SQL, pre_sql(avg_rank_sql("target_rank", _G)), MONTH_SQL, NODES_SQL, BEST_SQL, IC_VOL_SQL,
        select="SELECT factor, nodes, round(top3 - 0.05e0 * v - 0.0005e0 * nodes, 9) + 0e0 AS score, peak AS peak_month, 1 AS direction, round(best, 9) + 0e0 AS best_month_abs_ic, round(top3, 9) + 0e0 AS mean_top_abs_ic, CAST(n AS INTEGER) AS valid_months FROM sizes JOIN best USING (factor) JOIN vol USING (factor)",
    ),
)
def score_population_phase_ic(spark, folder):
    """First generation: only labelled rows are sampled and the label is ranked in the sample."""
    from dataclasses import replace

    panel, options = sampled_panel(spark, folder, 20, 7, 40, label=LABEL), replace(_OPTIONS, objective="phase_ic")
    rows = sr.with_temporals(panel, ex.temporal_pairs(ex.parse(t) for t in LIBRARY.values()))
    scored = sr.score_population(rows, LIBRARY, options, main_shape(spark, folder, ()))
    return rounded(scored, ["score", "best_month_abs_ic", "mean_top_abs_ic"], 9)


@register("review_full", with_sql(LONG_SQL, sides_sql(), MONTHS_SQL, TOP3_SQL, VOL_SQL, NODES_SQL, select=_POP))
def review_full(spark, folder):
    return _population(spark, folder, False)


@register(
    "rank_correlation_matrix",
    with_sql(
        LABELLED_SQL, factors_sql("labelled"),
        "rw AS (SELECT entity, trade_date, " + ", ".join(f"{avg_rank_sql(n, 'trade_date')} AS {n}" for n in NAMES) + " FROM wide)",
        select=" UNION ALL ".join(
            f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, round({pearson_sql(a, b)}, 9) + 0e0 AS correlation FROM rw"
            for i, a in enumerate(NAMES) for b in NAMES[i:]
        ),
    ),
)
def rank_correlation_matrix(spark, folder):
    matrix = sr.rank_correlation_matrix(main_panel(spark, folder), LIBRARY, digits=DIGITS, widest=main_shape(spark, folder).widest)
    return rounded(matrix, ["correlation"], 9)


# The library, near copies of its first factor and the bare features.
_CANDIDATES = [*LIBRARY.values(), '["neg",["mul","qty","disc"]]', '["mul",["mul","qty","disc"],"tax"]', *(f'"{f}"' for f in FEATURES)]
_CAND = {f"e{i}": t for i, t in enumerate(_CANDIDATES)}
# Candidates by score; each is taken if its month has room, its values are not constant and no
# chosen one correlates with it. The recursion carries the places and months of the chosen.
GREEDY_SQL = f"""cand AS (SELECT factor, score, peak_month, direction, nodes, expression, row_number() OVER (ORDER BY score DESC, expression) AS place FROM ({_FIT}) JOIN (SELECT factor, expression FROM texts) USING (factor)),
rl AS (SELECT place, entity, trade_date, {avg_rank_sql('value', 'factor, trade_date')} AS x FROM long JOIN cand USING (factor) WHERE target_rank IS NOT NULL),
rn AS (SELECT * FROM rl WHERE x IS NOT NULL),
corr AS (SELECT a.place AS later, b.place AS earlier, count(*) AS n, {pearson_sql('a.x', 'b.x')} AS c FROM rn a JOIN rn b ON a.entity = b.entity AND a.trade_date = b.trade_date AND b.place <= a.place GROUP BY 1, 2),
walk(place, taken, months) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]) UNION ALL
 SELECT c.place, CASE WHEN ok THEN list_append(taken, c.place) ELSE taken END, CASE WHEN ok THEN list_append(months, c.peak_month) ELSE months END
 FROM (SELECT w.taken, w.months, cand.place, cand.peak_month,
   len(w.taken) < {sr.LIBRARY_SIZE} AND len(list_filter(w.months, lambda m: m = cand.peak_month)) < {sr.MAX_PER_PEAK_MONTH}
   AND coalesce((SELECT n >= {MIN_VALID} AND c IS NOT NULL FROM corr WHERE later = cand.place AND earlier = cand.place), false)
   AND NOT EXISTS (SELECT 1 FROM corr WHERE later = cand.place AND earlier <> later AND list_contains(w.taken, earlier) AND abs(c) >= {sr.MAX_CORRELATION}) AS ok
  FROM walk w JOIN cand ON cand.place = w.place + 1) c),
final AS (SELECT unnest(taken) AS place, generate_subscripts(taken, 1) AS position FROM walk WHERE place = (SELECT max(place) FROM walk))"""
_CAND_SIZES = "sizes AS (SELECT factor, nodes FROM texts)"
_CAND_TEXTS = "texts AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{t}', CAST({ex.node_count(ex.parse(t))} AS BIGINT))" for n, t in _CAND.items()) + ") AS v(factor, expression, nodes))"


@register(
    "select_library",
    with_sql(
        LABELLED_SQL, factors_sql("labelled", KEEP, _CAND), long_sql(keep=KEEP, names=list(_CAND)), sides_sql(), MONTHS_SQL, TOP3_SQL, VOL_SQL,
        _CAND_TEXTS, _CAND_SIZES, GREEDY_SQL,
        select="SELECT 'factor_' || lpad(CAST(position AS VARCHAR), 2, '0') AS name, expression, score, peak_month, CAST(direction AS INTEGER) AS direction, CAST(nodes AS INTEGER) AS nodes FROM final JOIN cand USING (place)",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def select_library(spark, folder):
    """Greedy de-correlation of scored candidates (library plus near copies)."""
    shape, texts = main_shape(spark, folder), _CANDIDATES
    pairs = ex.temporal_pairs(ex.parse(t) for t in texts)
    laid_out = sr.materialize(sr.with_temporals(labelled_panel(spark, folder), pairs))
    found = rounded(sr.score_population(laid_out, _CAND, _OPTIONS, shape, masked=False), ["score"], 9)
    scored = {x.factor: x.asDict() for x in found.collect()}
    candidates = [{"expression": _CAND[n], **x, "sampled": x["score"]} for n, x in scored.items()]
    candidates.sort(key=lambda c: (-c["score"], c["expression"]))
    chosen = sr.select_library(laid_out.where("target_rank IS NOT NULL"), candidates, _OPTIONS, shape)
    library = sr.library_table(spark, chosen, _OPTIONS)
    return library.select("name", "expression", "score", "peak_month", "direction", "nodes")


@register("search_factors")
def search_factors(spark, folder):
    """The whole search: 20 generations of 80 expressions on up to 700 names of each date, a review of
    the best 600 on all rows, and a library of up to 20 factors."""
    from dataclasses import replace

    from panelforge.catalog.base import CATEGORIES

    options = replace(
        _OPTIONS, names_per_date=sr.SearchOptions.names_per_date, selection="tournament", crossover="symmetric_subtree",
        mutation="mixed", start="category_balanced", categories=dict(CATEGORIES),
    )
    return sr.search_factors(labelled_panel(spark, folder), FEATURES, options)
