"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A document's expected number of copies grows with its
appeal (by default the square root of its size) and is held below a bound. The whole copies are
certain; the remaining fraction ``p`` is an inclusion probability. Documents are ranked by
``(u / (1 - u)) / (p / (1 - p))`` with ``u`` drawn from a hash. The sample's fixed size is counted
in words: by rank, every document is taken that fits what is left of its source's target. So no
target is exceeded, and what is missing is less than any fraction left out.

Only DataFrame operations are used. Per-source figures come from pre-aggregated tables, so a
source that holds most rows is never gathered: sizes are counted per (source, size), ranks per
(source, cell) with 65,536 cells, and only the one cell a source's target falls into is sorted. The
document that overshoots there is left out, and the same pass goes on behind it with the documents
that still fit, for all sources at once, until none is left. A pass is kept as its bounds, however
many documents it takes.

Defined results: a missing text has size 0 and takes 0 words; a missing source is a source of its
own, last in order; rows equal in id, text and source share one draw and are taken or left
together; an empty table gives an empty result. Other columns are ignored (``mixed`` keeps them).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.llm.text import whole, word_count
from panelforge.session import broadcast_within, materialize

CELLS = 65_536
SLICE_ROWS = 100_000
LOT = "struct<rank:double,draw:bigint>"
PASSES = f"array<struct<past:{LOT},stop:{LOT},most:double>>"
# Whole copies within this distance of the expectation count as reached.
SMALL = 1e-9


def _draw(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", whole(F.col("text")), "source")


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size and the document's draw: all that sampling needs of a document."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _draw(seed).alias("draw"))


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Consecutive numbers from 0 in the given order, in slices of bounded size."""
    slices = df.count() // SLICE_ROWS + 1
    laid = materialize(df.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id()))
    ahead = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy("_slice").count().select("_slice", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    return laid.join(broadcast_within(sizes, slices), "_slice").withColumn(name, F.col("_ahead") + place - 1).drop("_slice", "_ahead")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Per source its target: weights by position in code point order, repeating, and at most
    ``most`` times the source's words; the excess is shared again by weight.

    The common level is found by raising it until no further source stops, which takes as many
    small aggregations as there are waves of stopping sources.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = materialize(
        numbered(sizes, [F.col("source").asc_nulls_last()], "place")
        .select("source", "source_size", w.alias("weight"), (F.col("source_size") * float(most)).alias("bound"))
    )
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, before = 0.0, -1.0
    while level != before:
        before = level
        stopped = F.col("bound") <= F.col("weight") * F.lit(level)
        fixed, free = table.agg(F.sum(F.when(stopped, F.col("bound"))), F.sum(F.when(~stopped, F.col("weight")))).first()
        if free:
            level = max(level, (total - (fixed or 0.0)) / free)
    return table.withColumn("target", F.least("bound", F.col("weight") * F.lit(level))).drop("weight")


def rates(counted: DataFrame, wanted: DataFrame, appeal: Callable[[Column], Column], most: float, n: int) -> DataFrame:
    """Per source the factor that turns appeal into expected copies; null when all stop at the bound.

    ``counted`` holds one row per source and size, so a source has at most as many rows as it has
    different lengths.
    """
    rows = _with_sources(counted.where("size > 0"), wanted, n).select("source", "size", "n", "target", appeal(F.col("size")).alias("x"))
    longest = Window.partitionBy("source").orderBy(F.desc("size"))
    held = F.coalesce(F.sum(F.col("n") * F.col("size") * most).over(longest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(F.col("n") * F.col("size") * F.col("x")).over(longest.rowsBetween(0, Window.unboundedFollowing))
    tried = rows.withColumn("rate", (F.col("target") - held) / rest)
    return tried.where(F.col("rate") * F.col("x") <= most).groupBy("source").agg(F.max_by("rate", "size").alias("rate"))


def _copies(appeal: Callable[[Column], Column], most: float) -> Column:
    expected = F.coalesce(F.least(F.col("rate") * appeal(F.col("size")), F.lit(float(most))), F.lit(float(most)))
    return F.when(F.col("size") > 0, F.greatest(expected, F.lit(0.0))).otherwise(0.0)


def _ranked(df: DataFrame, appeal: Callable[[Column], Column], most: float) -> DataFrame:
    """Adds certain copies, the Pareto rank of the remaining fraction and the cell of that rank."""
    sure = F.floor(F.col("_expected") + SMALL)
    part = F.greatest(F.col("_expected") - F.col("sure"), F.lit(0.0))
    u = (F.shiftrightunsigned("draw", 11).cast("double") + 0.5) / float(2**53)
    rank = F.when(F.col("_part") > SMALL, (u / (1 - u)) / (F.col("_part") / (1 - F.col("_part"))))
    cell = F.floor(F.col("rank") / (1 + F.col("rank")) * CELLS)
    return (
        df.withColumn("_expected", _copies(appeal, most)).withColumn("sure", sure).withColumn("_part", part)
        .withColumn("rank", rank).withColumn("cell", cell).drop("_expected", "_part")
    )


def _with_sources(rows: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """Rows with their source's columns; ``plan`` has at most ``n`` rows, one per source."""
    keyed = plan.withColumnRenamed("source", "_source")
    return rows.join(broadcast_within(keyed, n), rows["source"].eqNullSafe(keyed["_source"]), "left").drop("_source")


def plan_mix(
    rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0,
    appeal: Callable[[Column], Column] = F.sqrt,
) -> tuple[DataFrame, int]:
    """Per source its words, target, rate and what is taken of the fractions: ``passes``, each the
    ranks between two bounds whose size is at most ``most``. Also returns the number of sources.

    ``rows`` is what :func:`measured` returns, written to a table.
    """
    counted = materialize(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = materialize(counted.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")))
    n = sizes.count()
    wanted = targets(sizes, weights, share, most)
    factor = rates(counted, wanted, appeal, most, n)
    wanted = materialize(_with_sources(wanted.drop("bound"), factor, n))

    ranked = _ranked(_with_sources(rows, wanted, n), appeal, most)
    certain = ranked.groupBy("source").agg(F.sum(F.col("sure") * F.col("size")).alias("certain"))
    state = _with_sources(wanted.select("source", "target"), certain, n).select(
        "source", (F.col("target") - F.col("certain")).alias("gap"), F.lit(None).cast(LOT).alias("past"), F.array().cast(PASSES).alias("passes"),
        F.lit(True).alias("going"),
    )
    state = materialize(state)
    lots = ranked.where("rank IS NOT NULL").select("source", "size", "cell", "rank", "draw")
    while state.where("going AND gap > 0").limit(1).count():
        state = _next_pass(lots, state, n)
    return materialize(_with_sources(wanted, state.select("source", "passes"), n)), n


def _beyond(past: Column) -> Column:
    return past.isNull() | (F.col("rank") > past["rank"]) | ((F.col("rank") == past["rank"]) & (F.col("draw") > past["draw"]))


def _next_pass(lots: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """Takes all ranks behind ``past`` that fit, up to the first lot that overshoots, which is left out."""
    open_ = state.where("going AND gap > 0").select("source", "gap", "past")
    left = _with_sources(lots, open_, n).where((F.col("size") <= F.col("gap")) & _beyond(F.col("past")))
    cells = left.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    running = cells.withColumn("upto", F.sum("words").over(upto))
    # The cell in which the source's words pass what is open, and the words of the cells before it.
    edge = materialize(
        running.where("upto > gap").groupBy("source").agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("words")).alias("before")), "cell").alias("e"))
        .select("source", F.col("e.cell").alias("edge"), F.col("e.before").alias("before"))
    )
    here = _with_sources(left, edge, n).where("cell = edge").groupBy("source", "rank", "draw", "gap", "before").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("rank", "draw").rowsBetween(Window.unboundedPreceding, 0)
    within = here.withColumn("reached", F.col("before") + F.sum("words").over(order)).where("reached > gap")
    stop = within.groupBy("source").agg(
        F.min_by(F.struct(F.struct("rank", "draw").alias("stop"), (F.col("reached") - F.col("words")).alias("taken")), F.struct("rank", "draw")).alias("s")
    ).select("source", F.col("s.stop").alias("stop"), F.col("s.taken").alias("taken"))
    now = F.col("going") & (F.col("gap") > 0)
    done = F.struct("past", F.col("stop"), F.col("gap").alias("most"))
    return materialize(
        _with_sources(state, stop, n).select(
            "source", F.when(now & F.col("stop").isNotNull(), F.col("gap") - F.col("taken")).otherwise(F.col("gap")).alias("gap"),
            F.coalesce("stop", "past").alias("past"), F.when(now, F.concat("passes", F.array(done).cast(PASSES))).otherwise(F.col("passes")).alias("passes"),
            (now & F.col("stop").isNotNull()).alias("going"),
        )
    )


def with_copies(rows: DataFrame, plan: DataFrame, n: int, most: float = 3.0, appeal: Callable[[Column], Column] = F.sqrt) -> DataFrame:
    """Adds the number of copies the mix takes of each row. No row is shuffled when sources are few."""
    ranked = _ranked(_with_sources(rows, plan, n), appeal, most)

    def takes(p):
        before_stop = p["stop"].isNull() | (F.col("rank") < p["stop"]["rank"]) | ((F.col("rank") == p["stop"]["rank"]) & (F.col("draw") < p["stop"]["draw"]))
        return (F.col("size") <= p["most"]) & before_stop & _beyond(p["past"])

    fraction = F.col("rank").isNotNull() & F.coalesce(F.exists("passes", takes), F.lit(False))
    return ranked.withColumn("copies", (F.col("sure") + fraction.cast("int")).cast("int")).drop("sure", "rank", "cell", "passes", "rate")


def mix(docs: DataFrame, weights=(5, 2, 1), share=1.0, most=3.0, appeal=F.sqrt, seed=1) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies and taken words."""
    rows = materialize(measured(docs, seed))
    out = with_copies(rows, *plan_mix(rows, weights, share, most, appeal), most, appeal)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights=(5, 2, 1), share=1.0, most=3.0, appeal=F.sqrt, seed=1) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with all their columns."""
    rows = materialize(measured(docs, seed))
    plan, n = plan_mix(rows, weights, share, most, appeal)
    kept = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    wide = docs.select(kept, "doc_id", "source", word_count(docs["text"]).alias("size"), _draw(seed).alias("draw"))
    taken = with_copies(wide, plan, n, most, appeal).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select("_row.*")
