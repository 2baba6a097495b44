"""LambdaRank boosting on date-wise ranking gradients with Newton leaf values.

All refits grow together (:mod:`panelforge.plans.lockstep`) while a date fits a task. Wider dates
take the sliced form below, refit by refit with Spark ML trees: its gradients never gather a date.
The k best-scored rows of every date (found by a group limit) travel as one small array; each row
compares itself with that array, and the two sides of a pair are added up separately. Rows of one
date may sit in any number of tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.functions.scalar import discount, gain, half_life_weight, relevance_deciles
from panelforge.operators.evaluate import daily_ideal, ndcg
from panelforge.operators.ranks import ordinal_rank
from panelforge.plans import lockstep as ls
from panelforge.plans.models import BOOST, Block, WalkForward, rolling_boost
from panelforge.session import broadcast_within, drop_table, materialize, small_table, table_at, work_folder, write_table

DATE = ["trade_date"]
# Regularisation of leaf values, default rounds, gain per relevance.
LEAF_L1 = 0.1
LEAF_L2 = 10.0
ROUNDS = 200
PATIENCE = 15
GAINS = (0, 1, 2, 4, 8)
DECILE_GAINS = (0, 1, 2, 4, 8, 16, 32, 64, 128, 256)
# Rows of a date that a task ranks, and scores such a row may carry.
DATE_ROWS = 200_000
DATE_SLOTS = 32


def _pair(score_a, score_b, gain_a, gain_b, disc_a, disc_b, ideal):
    """(gradient, curvature) of row a against row b, weighted by the NDCG change of a swap."""
    swap = F.abs((gain_a - gain_b) * (disc_a - disc_b)) / ideal
    better = gain_a > gain_b
    # Probability that the worse row of the pair is ranked first.
    wrong = F.lit(1.0) / (F.lit(1.0) + F.exp(F.when(better, score_a - score_b).otherwise(score_b - score_a)))
    gradient = F.when(better, wrong).otherwise(-wrong) * swap
    return F.when(gain_a != gain_b, gradient).otherwise(0.0), F.when(
        gain_a != gain_b, wrong * (F.lit(1.0) - wrong) * swap
    ).otherwise(0.0)


def lambda_gradients(scored: DataFrame, k: int, *, widest: int, dates: int) -> DataFrame:
    """Add ``lambda`` and ``hessian``: sums over pairs with at least one row in the top k.

    Every row holds its date's top-k array (k entries). Rows outside the top k get their
    own sums directly. The top-k rows' sums over all other rows are added per (date,
    slot) with map-side combination: k partial sums per date leave a task.
    """
    rows = ordinal_rank(scored, DATE, "score", "rank", descending=True, widest=widest)
    rows = rows.withColumn("gain", gain(F.col("relevance"))).withColumn("disc", discount(F.col("rank")))
    cells = F.struct(F.col("rank").alias("rank"), F.col("score").alias("score"), F.col("gain").alias("gain"), F.col("disc").alias("disc"))
    top = rows.where(F.col("rank") <= k).groupBy(*DATE).agg(F.sort_array(F.collect_list(cells)).alias("top"))
    top = top.join(daily_ideal(scored, k), DATE).where(F.col("ideal_dcg") > 0)
    rows = rows.join(broadcast_within(top, dates * k), DATE)

    def both(slot):
        g, h = _pair(F.col("score"), slot["score"], F.col("gain"), slot["gain"], F.col("disc"), slot["disc"], F.col("ideal_dcg"))
        return F.struct(g.alias("g"), h.alias("h"))

    rows = rows.withColumn("pairs", F.transform("top", both))
    add = lambda f: F.aggregate("pairs", F.lit(0.0), lambda s, p: s + p[f])
    # A top-k row meets the rows below the cut through them, and its peers directly.
    own = rows.withColumn("own_g", add("g")).withColumn("own_h", add("h"))
    below = rows.where(F.col("rank") > k)
    # One aggregate per slot: the k sums of a date are combined map-side.
    sums = below.groupBy(*DATE).agg(
        *[F.sum(-F.get("pairs", F.lit(i))["g"]).alias(f"g{i}") for i in range(k)],
        *[F.sum(F.get("pairs", F.lit(i))["h"]).alias(f"h{i}") for i in range(k)],
    )
    sums = sums.select(
        *DATE,
        F.array(*[F.col(f"g{i}") for i in range(k)]).alias("top_g"),
        F.array(*[F.col(f"h{i}") for i in range(k)]).alias("top_h"),
    )
    joined = own.join(broadcast_within(sums, dates * k), DATE, "left")
    extra = lambda c: F.when(F.col("rank") <= k, F.coalesce(F.get(c, F.col("rank").cast("int") - 1), F.lit(0.0))).otherwise(0.0)
    return joined.select(
        *scored.columns,
        (F.col("own_g") + extra("top_g")).alias("lambda"),
        (F.col("own_h") + extra("top_h")).alias("hessian"),
    )


class LambdaRankModel:
    """Sum of trees with Newton leaf values."""

    def __init__(self, trees, step: float):
        self.trees, self.step = list(trees), step

    def score(self, rows: DataFrame, upto: int | None = None) -> DataFrame:
        """Add ``score``. Leaf values are literals of at most 2^depth leaves per tree."""
        total = F.lit(0.0)
        for i, (tree, leaves) in enumerate(self.trees[:upto]):
            rows = tree.setLeafCol(f"__leaf{i}").setPredictionCol(f"__pred{i}").transform(rows)
            total = total + self.step * leaf_value(f"__leaf{i}", leaves)
        rows = rows.withColumn("score", total)
        return rows.drop(*[c for c in rows.columns if c.startswith(("__leaf", "__pred"))])

    def save(self, path: str) -> None:
        """Each tree below ``path/<number>`` and one table of leaf values."""
        spark = SparkSession.active()
        for i, (tree, _) in enumerate(self.trees):
            tree.write().overwrite().save(f"{path}/{i}")
        rows = [(i, float(leaf), value) for i, (_, leaves) in enumerate(self.trees) for leaf, value in leaves.items()]
        tree, leaf, value = (list(x) for x in zip(*rows))
        leaves = small_table(spark, tree=tree, leaf=leaf, value=value, step=[self.step] * len(rows))
        leaves.write.mode("overwrite").parquet(f"{path}/leaves")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LambdaRankModel:
        rows = spark.read.parquet(f"{path}/leaves").orderBy("tree", "leaf").collect()
        leaves: dict[int, dict[float, float]] = {}
        for r in rows:
            leaves.setdefault(r.tree, {})[r.leaf] = r.value
        trees = [(DecisionTreeRegressionModel.load(f"{path}/{i}"), leaves[i]) for i in sorted(leaves)]
        return cls(trees, rows[0].step)

    @property
    def featureImportances(self):
        import numpy as np

        from pyspark.ml.linalg import Vectors

        total = sum(np.asarray(t.featureImportances.toArray()) for t, _ in self.trees)
        return Vectors.dense(total / (total.sum() or 1.0))


def _between(frame: DataFrame, first: str, last: str) -> DataFrame:
    return frame.where(F.col("trade_date").between(first, last))


def history(frame: DataFrame, block: Block) -> DataFrame:
    return _between(frame, block.train_start, block.train_end).where(F.col("target_rank").isNotNull())


def split(rows: DataFrame, block: Block) -> tuple[DataFrame, DataFrame]:
    fresh = F.col("trade_date") >= block.validation_start
    return rows.where(~fresh), rows.where(fresh)




def run_blocks(
    frame: DataFrame,
    blocks: Sequence[Block],
    fit: Callable[[DataFrame, Block], tuple[object, dict]],
    score: Callable[[object, DataFrame], DataFrame],
    *,
    label: str,
    threads: int = 4,
    columns: Sequence[str] = ("target_rank", "relevance", "is_target_topk"),
) -> WalkForward:
    """Fit every block (a few at a time) and score its test dates.

    A block's scores are written when its model is ready, so the result is one table with a
    short plan however many refits there are.
    """
    folder = f"{work_folder(frame.sparkSession)}/predictions-{uuid.uuid4().hex}"

    def one(block: Block):
        rows = history(frame, block).persist()
        try:
            model, record = fit(rows, block)
            record = {
                "rebalance_date": block.rebalance_date,
                "train_start": block.train_start,
                "train_end": block.train_end,
                **record,
            }
        finally:
            rows.unpersist()
        test = _between(frame, block.rebalance_date, block.test_end)
        scored = score(model, test).select(
            "entity", "trade_date", F.lit(block.rebalance_date).alias("rebalance_date"), label, *columns, "score"
        )
        scored.write.parquet(f"{folder}/block={block.rebalance_date}")
        return model, record

    with ThreadPoolExecutor(max_workers=threads) as pool:
        done = list(pool.map(one, blocks))
    predictions = frame.sparkSession.read.parquet(folder).drop("block")
    return WalkForward(predictions, [r for _, r in done], {r["rebalance_date"]: m for m, r in done})


def _fit(rows: DataFrame, *, rounds, step, depth, bins, min_rows, k, l2, weight, widest, dates, seed, on_round=None) -> LambdaRankModel:
    """Boosts ``rows``; each round's table is deleted when the next one is written."""
    spark, model, before = rows.sparkSession, LambdaRankModel([], step), None
    current = rows.withColumn("score", F.lit(0.0))
    for number in range(rounds):
        graded = lambda_gradients(current, k, widest=widest, dates=dates)
        if weight is not None:
            graded = graded.withColumn("lambda", F.col("lambda") * weight).withColumn("hessian", F.col("hessian") * weight)
        graded = graded.withColumn("direction", F.when(F.col("hessian") > 0, F.col("lambda") / F.col("hessian")).otherwise(0.0))
        path = write_table(graded)  # cuts the lineage of the round
        graded = table_at(graded, path)
        drop_table(spark, before)
        before = path
        tree = DecisionTreeRegressor(
            featuresCol="features", labelCol="lambda", maxDepth=depth, maxBins=bins,
            minInstancesPerNode=min_rows, seed=seed + number, leafCol="leaf", predictionCol="raw",
        ).fit(graded)
        leaves = tree.transform(graded).groupBy("leaf").agg((F.sum("lambda") / (F.sum("hessian") + F.lit(l2))).alias("value"))
        values = {x.leaf: float(x.value) for x in leaves.collect()}  # at most 2^depth rows
        model.trees.append((tree, values))
        current = tree.transform(graded).select(*rows.columns, (F.col("score") + step * leaf_value("leaf", values)).alias("score"))
        if on_round is not None and on_round(model, number + 1):
            break
    drop_table(spark, before)
    return model


def leaf_value(leaf: str, values: dict):
    """The value of a leaf as literals, at most 2^depth of them."""
    value = F.lit(0.0)
    for number, v in values.items():
        value = F.when(F.col(leaf) == number, v).otherwise(value)
    return value


class RunningScore:
    """Validation rows with the score of the trees so far: each round adds one tree."""

    def __init__(self, rows: DataFrame, k: int):
        self.rows, self.k, self.path = rows.withColumn("score", F.lit(0.0)), k, None

    def add(self, model: LambdaRankModel) -> float | None:
        """NDCG@k after the newest tree."""
        tree, leaves = model.trees[-1]
        columns = self.rows.columns
        scored = tree.setLeafCol("leaf").setPredictionCol("raw").transform(self.rows)
        score = F.col("score") + model.step * leaf_value("leaf", leaves)
        path = write_table(scored.select(*[c for c in columns if c != "score"], score.alias("score")))
        self.rows = table_at(self.rows, path)
        drop_table(self.rows.sparkSession, self.path)
        self.path = path
        return ndcg(self.rows, self.k).agg(F.avg("ndcg")).first()[0]

    def close(self):
        drop_table(self.rows.sparkSession, self.path)


def rolling_lambdarank(
    frame: DataFrame,
    factors: Sequence[str],
    blocks: Sequence[Block],
    *,
    label: str,
    k: int = 50,
    eval_at: int | None = None,
    relevance: str = "relevance",
    gains: Sequence[float] = GAINS,
    candidates: Sequence[dict] = ({},),
    rounds: int = ROUNDS,
    step: float = BOOST["step"],
    depth: int = BOOST["depth"],
    leaves: int = BOOST["leaves"],
    bins: int = BOOST["bins"],
    min_rows: int = BOOST["min_rows"],
    min_gain: float = BOOST["min_gain"],
    row_share: float = BOOST["row_share"],
    feature_share: float = BOOST["feature_share"],
    l1: float = LEAF_L1,
    l2: float = LEAF_L2,
    half_life: float = 10.0,
    patience: int = PATIENCE,
    seed: int = BOOST["seed"],
    widest: int,
    dates: int,
) -> WalkForward:
    """Ranker per refit; candidate and rounds chosen by NDCG on the newest dates.

    Pairs with a row among the first ``k`` count; quality is measured at ``eval_at`` (as ``k`` unless
    given). The first generation ranks ``relevance="decile"`` with ``DECILE_GAINS``, two candidates
    and no half-life, both at 500.
    """
    if widest > DATE_ROWS:
        return sliced_lambdarank(
            frame, factors, blocks, label=label, k=k, rounds=rounds, step=step, depth=depth, bins=bins, min_rows=min_rows, l2=l2,
            half_life=half_life, patience=patience, seed=seed, widest=widest, dates=dates,
        )
    if relevance == "decile":
        frame = frame.withColumn("decile", relevance_deciles(F.col("target_rank")))
    settings = dict(
        max_iter=rounds, step=step, depth=depth, leaves=leaves, bins=bins, min_rows=min_rows, min_gain=min_gain, row_share=row_share,
        feature_share=feature_share, l1=l1, l2=l2, seed=seed,
    )
    objective = ls.Objective("ranker", relevance, half_life, k=k, eval_at=eval_at or k, gains=tuple(float(g) for g in gains))
    return rolling_boost(
        frame, factors, blocks, objective, label=label, candidates=candidates, settings=settings, patience=patience,
        metric=f"ndcg@{eval_at or k}", slots=DATE_SLOTS,
    )


def sliced_lambdarank(
    frame: DataFrame,
    factors: Sequence[str],
    blocks: Sequence[Block],
    *,
    label: str,
    k: int = 50,
    rounds: int = ROUNDS,
    step: float = 0.03,
    depth: int = 3,
    bins: int = 63,
    min_rows: int = 3000,
    l2: float = LEAF_L2,
    half_life: float = 10.0,
    patience: int = PATIENCE,
    seed: int = 42,
    widest: int,
    dates: int,
    threads: int = 4,
) -> WalkForward:
    """Ranker per block for dates of any width: rounds chosen by validation NDCG@k, then refitted on all history."""
    from pyspark.ml.functions import array_to_vector

    size = len(factors)
    bytes_of = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (F.conv(F.hex(F.substring("bins", i, F.lit(1))), 16, 10).cast("double") + 0.5) / bins)
    frame = materialize(frame.withColumn("features", array_to_vector(bytes_of)).drop("bins"))

    def quality(model, rows, upto):
        return ndcg(model.score(rows, upto), k).agg(F.avg("ndcg")).first()[0]

    def fit(rows, block):
        older, newer = split(rows, block)
        last = rows.agg(F.max("position")).first()[0]
        weight = half_life_weight(F.lit(last) - F.col("position"), half_life) if half_life else None
        options = dict(step=step, depth=depth, bins=bins, min_rows=min_rows, k=k, l2=l2, weight=weight, widest=widest, dates=dates, seed=seed)
        best, running = {"value": -1.0, "round": 1}, RunningScore(newer, k)

        def watch(model, number):
            value = running.add(model)
            if value is not None and value > best["value"]:
                best.update(value=value, round=number)
            return number - best["round"] >= patience

        _fit(older, rounds=rounds, on_round=watch, **options)
        running.close()
        model = _fit(rows, rounds=best["round"], **options)
        return model, {
            "best_iteration": best["round"],
            "validation_metric": best["value"],
            "validation_metric_name": f"ndcg@{k}",
            "train_ndcg": quality(model, rows, None),
            "train_rows": rows.count(),
        }

    return run_blocks(frame, blocks, fit, lambda m, test: m.score(test), label=label, threads=threads)
