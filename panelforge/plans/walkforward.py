"""Walk-forward scoring: embargoed windows, IC voting, bin encoding and parameter sweeps.

History never multiplies panel rows. Per-date statistics (ICs, bin sums) are computed once;
only those small tables are joined to the overlapping windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.functions.expressions import evaluate_expressions, to_long
from panelforge.functions.scalar import floor_bin, half_life_weight, signal, signed_power
from panelforge.operators.aggregates import information_ratio, pearson, share, weighted_mean
from panelforge.operators.calendar import PanelShape
from panelforge.operators.daily import daily_score_quality
from panelforge.operators.quality import factor_ics as quality_ics
from panelforge.operators.ranks import average_rank, average_ranks
from panelforge.session import broadcast_checked, broadcast_within, group_limit, small_table

# Default settings.
CAP_ROUNDS = 10
BIN_SHRINK = 500.0


def ranked_factors(frame: DataFrame, factors: Sequence[str], *, fill: float | None = 0.5, widest: int | None = None) -> DataFrame:
    """Replace each factor column by its percentile rank per date, missing -> ``fill``."""
    names = list(factors)
    rest = [c for c in frame.columns if c not in names]
    frame = average_ranks(frame, ["trade_date"], {n: f"__{n}" for n in names}, widest=widest)
    rank = lambda name: F.col(f"__{name}") if fill is None else F.coalesce(f"__{name}", F.lit(float(fill)))
    return frame.select(*rest, *[rank(n).alias(n) for n in names])


def build_factor_frame(
    panel: DataFrame,
    expressions: dict[str, str],
    *,
    keep: Sequence[str] = (),
    directions: dict[str, int] | None = None,
    ranked: bool = True,
    digits: int | None = None,
    widest: int | None = None,
) -> DataFrame:
    """Key, kept columns and one column per factor; ranked per date unless told otherwise."""
    wide = evaluate_expressions(panel, expressions, keep=keep, directions=directions, digits=digits)
    return ranked_factors(wide, list(expressions), widest=widest) if ranked else wide


# --- windows -----------------------------------------------------------------------------


def rebalance_calendar(calendar: DataFrame, start: str, end: str, update: int) -> DataFrame:
    """(trade_date, position, rebalance_date, rebalance_position) for the test dates.

    Positions are consecutive, so the block number is arithmetic on the position.
    """
    test = calendar.where(F.col("trade_date").between(start, end))
    first = F.broadcast(test.agg(F.min("position").alias("first")))  # one row
    step = F.floor((F.col("position") - F.col("first")) / F.lit(update)) * update
    placed = test.crossJoin(first).withColumn("rebalance_position", (F.col("first") + step).cast("int"))
    heads = calendar.select(F.col("trade_date").alias("rebalance_date"), F.col("position").alias("rebalance_position"))
    return placed.join(F.broadcast(heads), "rebalance_position").select(
        "trade_date", "position", "rebalance_date", "rebalance_position"
    )


def history_windows(
    blocks: DataFrame, calendar: DataFrame, *, horizon: int, lookback: int, require_full: bool = True
) -> DataFrame:
    """(rebalance_date, trade_date, age): the history each block may learn from.

    The last ``horizon`` dates before the block are left out because their labels are not
    known yet. ``age`` is 0 for the newest date. Blocks without a full window are dropped
    unless ``require_full`` is off. The needed positions are generated and matched by
    equality, so no range join is planned.
    """
    heads = blocks.where(F.col("trade_date") == F.col("rebalance_date"))
    newest = F.col("rebalance_position") - F.lit(horizon + 1)
    oldest = newest - F.lit(lookback - 1)
    if require_full:
        heads = heads.where(oldest >= 0)
    else:
        heads = heads.where(newest >= 0)
    wanted = heads.select(
        "rebalance_date",
        newest.alias("newest"),
        F.explode(F.sequence(F.greatest(F.lit(0), oldest), newest)).alias("position"),
    )
    return wanted.join(F.broadcast(calendar), "position").select(
        "rebalance_date", "trade_date", (F.col("newest") - F.col("position")).alias("age")
    )


def fit_validation_split(windows: DataFrame, validation: int) -> DataFrame:
    """Newest ``validation`` dates of each window validate, the older ones fit."""
    return windows.withColumn("is_validation", F.col("age") < validation)


def sample_decay_weights(windows: DataFrame, half_life: float) -> DataFrame:
    return windows.withColumn("weight", half_life_weight(F.col("age"), half_life))


# --- reliability weights -----------------------------------------------------------------


def rolling_ic(ic: DataFrame, windows: DataFrame, factors: DataFrame, *, min_ic_days: int = 0) -> DataFrame:
    """(rebalance_date, factor, trade_date, age, ic), one row per window date and factor.

    Dates without an IC stay as NULL rows; a factor with fewer than ``min_ic_days`` ICs in
    the window loses all of them.
    """
    grid = windows.crossJoin(broadcast_checked(factors.select("factor")))  # factors of one library
    joined = grid.join(ic.select("factor", "trade_date", "ic"), ["factor", "trade_date"], "left")
    if not min_ic_days:
        return joined
    have = F.count("ic").over(Window.partitionBy("rebalance_date", "factor"))
    return joined.withColumn("ic", F.when(have >= min_ic_days, F.col("ic")))


def decayed_mean_ic(history: DataFrame, half_life: float, *, count_missing: bool = False) -> DataFrame:
    """Half-life weighted mean IC per (rebalance_date, factor); nothing known -> 0."""
    weight = half_life_weight(F.col("age"), half_life)
    return history.groupBy("rebalance_date", "factor").agg(
        F.coalesce(weighted_mean(F.col("ic"), weight, count_missing=count_missing), F.lit(0.0)).alias("mean_ic")
    )


def raw_weights(
    mean_ics: DataFrame, *, power: float = 1.0, dead_zone: float = 0.0, top_k: int = 0, keys: Sequence[str] = ("rebalance_date",)
) -> DataFrame:
    """Signed power of the mean IC, zero inside the dead zone, then only the strongest k."""
    raw = F.when(F.abs("mean_ic") < dead_zone, 0.0).otherwise(signed_power(F.col("mean_ic"), power))
    weights = mean_ics.withColumn("raw", raw)
    if not top_k:
        return weights
    order = Window.partitionBy(*keys).orderBy(F.abs("raw").desc(), F.asc("factor"))
    return (
        weights.withColumn("__r", F.row_number().over(order))
        .withColumn("raw", F.when(F.col("__r") <= top_k, F.col("raw")).otherwise(0.0))
        .drop("__r")
    )


def _cap_array(raw: Column, cap: float, rounds: int) -> Column:
    """Normalise an array of weights by Σ|w| and cap it, repeating clip-and-rescale."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, w: s + F.abs(w))
    limit = F.lit(float(cap))

    def once(state, _):
        w = state["w"]
        over_n = F.size(F.filter(w, lambda v: F.abs(v) > limit))
        free = F.aggregate(w, F.lit(0.0), lambda s, v: s + F.when(F.abs(v) > limit, 0.0).otherwise(F.abs(v)))
        room = F.lit(1.0) - over_n * limit
        grow = (free > 0) & (room > 0)
        clipped = F.transform(
            w,
            lambda v: F.when(F.abs(v) > limit, F.signum(v) * limit).otherwise(
                F.when(grow, v * (room / F.when(free > 0, free).otherwise(1.0))).otherwise(v)
            ),
        )
        stop = state["done"] | (over_n == 0)
        return F.struct(F.when(stop, w).otherwise(clipped).alias("w"), (stop | ~grow).alias("done"))

    scaled = F.transform(raw, lambda v: v / total(raw))
    start = F.struct(scaled.alias("w"), F.lit(False).alias("done"))
    looped = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, once, lambda s: s["w"])
    return F.when(total(raw) > 0, looped).otherwise(raw)


def cap_weights(
    weights: DataFrame, cap: float, *, rounds: int = CAP_ROUNDS, keys: Sequence[str] = ("rebalance_date",)
) -> DataFrame:
    """Add ``weight``: normalised and capped within each block.

    A block's array has one entry per library factor, so it is small by construction.
    """
    cells = F.sort_array(F.collect_list(F.struct("factor", "mean_ic", F.coalesce("raw", F.lit(0.0)).alias("raw"))))
    blocks = weights.groupBy(*keys).agg(cells.alias("c"))
    blocks = blocks.withColumn("w", _cap_array(F.col("c.raw"), cap, rounds))
    cells = F.explode(F.arrays_zip("c", "w")).alias("x")
    return blocks.select(*keys, cells).select(
        *keys, "x.c.factor", "x.c.mean_ic", "x.c.raw", F.col("x.w").alias("weight")
    )


def reliability_weights(
    history: DataFrame,
    *,
    half_life: float = 5.0,
    power: float = 1.0,
    dead_zone: float = 0.0,
    top_k: int = 20,
    cap: float = 0.25,
) -> DataFrame:
    mean_ics = decayed_mean_ic(history, half_life)
    return cap_weights(raw_weights(mean_ics, power=power, dead_zone=dead_zone, top_k=top_k), cap)


# --- scores ------------------------------------------------------------------------------


def _weights_wide(weights: DataFrame, factors: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per block with the weights as columns w_<factor>."""
    return weights.groupBy(*keys).agg(
        *[F.coalesce(F.max(F.when(F.col("factor") == f, F.col("weight"))), F.lit(0.0)).alias(f"w_{f}") for f in factors]
    )


def _dot(factors: Sequence[str], term) -> Column:
    total = F.lit(0.0)
    for name in factors:
        total = total + term(name)
    return total


def vote_score(
    ranks: DataFrame,
    factors: Sequence[str],
    weights: DataFrame,
    blocks: DataFrame,
    shape: PanelShape,
    *,
    mode: str = "binary",
) -> DataFrame:
    """Σ signal·weight per test row; ``ranks`` holds NULL where the factor is missing.

    Wide dot product: the weights of a block arrive as one broadcast row, so scoring is a
    projection over the panel.
    """
    table = blocks.join(F.broadcast(_weights_wide(weights, factors, ["rebalance_date"])), "rebalance_date")
    scored = ranks.join(broadcast_within(table, shape.dates), "trade_date")
    score = _dot(factors, lambda f: F.coalesce(signal(F.col(f), mode), F.lit(0.0)) * F.col(f"w_{f}"))
    rest = [c for c in ranks.columns if c not in set(factors)]
    return scored.select(*rest, "rebalance_date", score.alias("score"))


def parameter_sweep(
    ranks: DataFrame,
    factors: Sequence[str],
    history: DataFrame,
    blocks: DataFrame,
    label: str,
    shape: PanelShape,
    *,
    powers: Sequence[float] = (1.0, 1.5),
    dead_zones: Sequence[float] = (0.0, 0.01, 0.03),
    half_lives: Sequence[float] = (2.0, 3.0, 5.0, 10.0),
    top_ks: Sequence[int] = (10, 20),
    modes: Sequence[str] = ("linear", "binary", "tanh"),
    cap: float = 0.25,
    split_date: str = "",
    min_names: int = 200,
    tail: float = 0.1,
    ranked: bool = True,
) -> DataFrame:
    """All parameter combinations over all blocks in one job keyed by combination.

    ``ranks`` holds percentile ranks or, unless ``ranked``, the factors' values. Dates up to the group
    limit are scored in one task each; rows per combination are made beyond it only.
    """
    spark = ranks.sparkSession
    combos = list(product(powers, dead_zones, half_lives, top_ks))
    power, zone, life, count = zip(*combos)
    grid = small_table(
        spark, combo=list(range(len(combos))), power=list(power), dead_zone=list(zone), half_life=list(life), top_k=list(count)
    )
    decay = F.pow(F.lit(0.5), F.col("age") / F.col("half_life"))
    means = (
        history.join(F.broadcast(grid.select("half_life").distinct()))
        .groupBy("rebalance_date", "factor", "half_life")
        .agg(weighted_mean(F.col("ic"), decay).alias("mean_ic"))
    )
    keyed = means.join(F.broadcast(grid), "half_life")
    raw = F.when(F.abs("mean_ic") < F.col("dead_zone"), 0.0).otherwise(
        F.signum("mean_ic") * F.pow(F.abs("mean_ic"), F.col("power"))
    )
    order = Window.partitionBy("combo", "rebalance_date").orderBy(
        F.abs("raw").desc_nulls_last(), F.asc("factor")
    )
    keyed = keyed.withColumn("raw", raw).withColumn("__r", F.row_number().over(order))
    keyed = keyed.withColumn("raw", F.when(F.col("__r") <= F.col("top_k"), F.col("raw")).otherwise(0.0))
    weights = cap_weights(keyed, cap, keys=["combo", "rebalance_date"])
    wide = _weights_wide(weights, factors, ["combo", "rebalance_date"])

    slots = small_table(
        spark,
        slot=list(range(len(combos) * len(modes))),
        combo=list(range(len(combos))) * len(modes),
        signal_mode=[m for m in modes for _ in combos],
    )
    # Votes of a block as one array ordered by combination; scores follow that order.
    votes = F.sort_array(F.collect_list(F.struct("combo", *[f"w_{f}" for f in factors])))
    per_block = wide.groupBy("rebalance_date").agg(votes.alias("votes"))
    table = blocks.select("trade_date", "rebalance_date").join(per_block, "rebalance_date")
    if shape.widest <= group_limit(spark):
        flat = table.select("trade_date", F.flatten(F.transform("votes", lambda v: F.array(*[v[f"w_{f}"] for f in factors]))).alias("votes"))
        daily = daily_score_quality(ranks, factors, flat, label, modes=modes, tail=tail, least=min_names, ranked=ranked)
    else:
        ranks = ranks if ranked else ranked_factors(ranks, factors, fill=None, widest=shape.widest)
        rows = ranks.na.drop(subset=[label]).join(broadcast_within(table, shape.dates * len(combos)), "trade_date")
        for m in modes:
            rows = rows.withColumn(f"__{m}", F.array(*[F.coalesce(signal(F.col(f), m), F.lit(0.0)) for f in factors]))

        def scores_of(m):
            terms = range(len(factors))
            return F.transform(
                "votes", lambda v: F.round(_dot(terms, lambda i: F.col(f"__{m}")[i] * v[f"w_{factors[i]}"]), 9)
            )

        scores = F.flatten(F.array(*[scores_of(m) for m in modes]))
        scored = rows.select("entity", "trade_date", label, scores.alias("scores"))
        keys = ["slot", "trade_date"]
        long = scored.select("entity", "trade_date", label, F.posexplode("scores").alias("slot", "score"))
        long = average_rank(long, keys, "score", "__x", pct=False, widest=shape.widest)
        long = average_rank(long, keys, "score", "__pct", widest=shape.widest)
        long = average_rank(long, keys, label, "__y", pct=False, widest=shape.widest)
        high, low = F.col("__pct") >= 1.0 - tail, F.col("__pct") <= tail
        daily = long.groupBy(*keys).agg(
            pearson(F.col("__x"), F.col("__y"), min_rows=min_names).alias("ic"),
            (F.avg(F.when(high, F.col(label))) - F.avg(F.when(low, F.col(label)))).alias("spread"),
        )
    daily = daily.join(F.broadcast(slots), "slot")
    result = daily.groupBy("combo", "signal_mode").agg(
        F.avg("ic").alias("mean_rank_ic"),
        information_ratio(F.col("ic")).alias("rank_ic_ir"),
        F.avg("spread").alias("mean_long_short"),
        share(F.col("spread") > 0).alias("long_short_win_rate"),
        F.avg(F.when(F.col("trade_date") <= split_date, F.col("ic"))).alias("early_ic"),
        F.avg(F.when(F.col("trade_date") > split_date, F.col("ic"))).alias("late_ic"),
    )
    return (
        grid.join(F.broadcast(result), "combo")
        .drop("combo")
        .orderBy(F.desc_nulls_last("mean_rank_ic"), F.desc_nulls_last("mean_long_short"))
    )


def ic_vote(
    ranks: DataFrame,
    factors: Sequence[str],
    windows: DataFrame,
    blocks: DataFrame,
    shape: PanelShape,
    *,
    half_life: float = 10.0,
) -> tuple[DataFrame, DataFrame]:
    """Second-generation vote on filled ranks: (weights, scored test rows).

    A date whose IC is undefined keeps its decay weight in the denominator. The ICs of all
    factors come from one aggregate over the frame, six sums per factor, without ranking again.
    """
    labelled = ranks.where(F.col("target_rank").isNotNull())
    wide = labelled.groupBy("trade_date").agg(
        *[pearson(F.col(f), F.col("target_rank")).alias(f) for f in factors]
    )
    cells = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("ic")) for f in factors])
    ic = wide.select("trade_date", F.explode(cells).alias("c")).select("trade_date", "c.factor", "c.ic")
    history = windows.join(ic, "trade_date")
    means = decayed_mean_ic(history, half_life, count_missing=True)
    total = F.sum(F.abs("mean_ic")).over(Window.partitionBy("rebalance_date"))
    weights = means.withColumn(
        "weight", F.when(total > 0, F.col("mean_ic") / total).otherwise(F.lit(0.0))
    )
    table = blocks.join(F.broadcast(_weights_wide(weights, factors, ["rebalance_date"])), "rebalance_date")
    scored = ranks.join(broadcast_within(table, shape.dates), "trade_date")
    score = _dot(factors, lambda f: (F.col(f) - F.lit(0.5)) * F.col(f"w_{f}"))
    rest = [c for c in ranks.columns if c not in set(factors)]
    return weights, scored.select(*rest, "rebalance_date", score.alias("score"))


def daily_bins(ranks: DataFrame, factors: Sequence[str], bins: int) -> DataFrame:
    """Count and label-rank sum per (factor, bin, date): additive, so windows only add rows."""
    long = to_long(ranks.where(F.col("target_rank").isNotNull()), factors, ["target_rank"])
    return long.groupBy("factor", floor_bin(F.col("value"), bins).alias("bin"), "trade_date").agg(
        F.count("*").alias("n"), F.sum("target_rank").alias("total")
    )


def bin_encoding(per_day: DataFrame, windows: DataFrame, *, shrink: float = BIN_SHRINK) -> DataFrame:
    """Shrunken mean label rank per (rebalance_date, factor, bin)."""
    seen = windows.join(per_day, "trade_date").groupBy("rebalance_date", "factor", "bin").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")
    )
    encoded = (F.col("total") + F.lit(0.5 * shrink)) / (F.col("n") + F.lit(float(shrink)))
    return seen.select("rebalance_date", "factor", "bin", "n", encoded.alias("encoded"))


def binning_score(
    ranks: DataFrame,
    factors: Sequence[str],
    windows: DataFrame,
    blocks: DataFrame,
    shape: PanelShape,
    *,
    bins: int = 10,
    shrink: float = BIN_SHRINK,
) -> DataFrame:
    """Mean over factors of the bin encoding; bins unseen in the window count as 0.5.

    Each block's encodings travel as one array per date (factors × bins entries), so test
    rows are scored by position, without exploding them per factor.
    """
    encoding = bin_encoding(daily_bins(ranks, factors, bins), windows, shrink=shrink)
    slots = [(f, b) for f in factors for b in range(bins)]
    grid = small_table(
        ranks.sparkSession, factor=[f for f, _ in slots], bin=[b for _, b in slots], slot=list(range(len(slots)))
    ).withColumn("bin", F.col("bin").cast(encoding.schema["bin"].dataType))
    heads = encoding.select("rebalance_date").distinct().crossJoin(F.broadcast(grid))
    full = heads.join(encoding, ["rebalance_date", "factor", "bin"], "left")
    entry = F.struct("slot", F.coalesce("encoded", F.lit(0.5)).alias("encoded"))
    arrays = full.groupBy("rebalance_date").agg(F.sort_array(F.collect_list(entry)).getField("encoded").alias("codes"))
    table = blocks.select("trade_date", "rebalance_date").join(arrays, "rebalance_date")
    bound = shape.dates * len(slots) // 16  # an array entry is far smaller than a row
    scored = ranks.join(broadcast_within(table, bound), "trade_date")
    first = {f: i * bins + 1 for i, f in enumerate(factors)}
    look = lambda f: F.coalesce(
        F.try_element_at("codes", (floor_bin(F.col(f), bins) + F.lit(first[f])).cast("int")), F.lit(0.5)
    ) - F.lit(0.5)
    score = _dot(factors, look) / F.lit(float(len(factors))) + F.lit(0.5)
    rest = [c for c in ranks.columns if c not in set(factors)]
    return scored.select(*rest, "rebalance_date", score.alias("score"))


def factor_ics(
    panel: DataFrame, expressions: dict[str, str], label: str, *, min_names: int, digits: int | None = None, widest: int | None = None
) -> DataFrame:
    """Daily rank IC of every factor, computed once for all windows."""
    wide = evaluate_expressions(panel, expressions, keep=[label], digits=digits)
    return label_ics(wide, list(expressions), label, min_names=min_names, widest=widest)


def label_ics(wide: DataFrame, names: Sequence[str], label: str, *, min_names: int, widest: int | None = None) -> DataFrame:
    """(factor, trade_date, names, ic) against a raw label: all factors of a date are ranked together,
    after one exchange and without a row per factor."""
    rows = wide.select("entity", "trade_date", *names, F.col(label).alias("target_rank"), F.lit(0).alias("relevance"))
    return quality_ics(rows, names, complete=True, min_names=min_names, widest=widest)
