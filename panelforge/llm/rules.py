"""Quality scores by a sparse ensemble of rules over text statistics.

Statistics of whole texts are computed in one pass. Shallow trees of a random forest are fitted to
the labelled rows; each path from a root is a rule, a conjunction of thresholds on statistics.
Logistic regression with an L1 penalty weighs the rules and drops most of them. The remaining
rules are compiled into one Spark column expression, which scores documents without a model
object or Python.

Fitting uses at most ``SAMPLE`` labelled rows, the smallest by a hash of the id, and never rows of
the held-out fifth. Scoring covers every row.

Defined results: a missing text counts as empty and is scored like any other; a document with a
missing id is scored and, its checksum being missing, is not held out; documents labelled several
times are used as often; without labels of both kinds the score is the share of good labels (0.5
without any); repeated rows each get a row; an empty table gives an empty result; other columns
are ignored (``kept`` keeps them).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from panelforge.session import materialize

# Executors receive these helpers by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 20_000
TREES, DEPTH, PENALTY = 24, 3, 0.002
FOLDS = 5
THRESHOLD = 0.3
STATISTICS = (
    "log_words", "word_length", "long_words", "distinct_words", "top_word", "upper", "digits", "marks", "odd_marks", "sentence_marks",
    "capitals_words", "marked_words", "line_length", "short_lines", "repeated_lines", "repeated_pairs", "not_ascii",
)
# ASCII classes.
_UPPER, _DIGIT = slice(65, 91), slice(48, 58)
_ENDS = np.frombuffer(b".,;:?", "u1")
_MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_ODD = np.array([b for b in _MARKS if chr(b) not in ".,;:?'\"-()"])


def statistics(text: str | None) -> tuple[float, ...]:
    """The statistics of one text, all 0 for an empty one."""
    words = (text or "").split()
    if not words:
        return (0.0,) * len(STATISTICS)
    raw = np.bincount(np.frombuffer(text.encode(), "u1"), minlength=256)
    n, size = len(words), np.fromiter(map(len, words), "i8", len(words))
    lines = [line for line in text.split("\n") if line.strip()]
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 0
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    total = int(raw[33:].sum()) or 1
    return (
        float(np.log1p(n)), float(size.mean()), float((size > 14).mean()), len(counts) / n, max(counts.values()) / n, int(raw[_UPPER].sum()) / total,
        int(raw[_DIGIT].sum()) / total, int(raw[_MARKS].sum()) / total, int(raw[_ODD].sum()) / total, int(raw[_ENDS].sum()) / n,
        sum(w.isupper() for w in words) / n, sum(not w[-1].isalnum() for w in words) / n, n / len(lines), sum(len(x) < 30 for x in lines) / len(lines),
        1 - len(set(lines)) / len(lines), 1 - pairs / max(1, n - 1), int(raw[128:].sum()) / total,
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(t.as_py()) for t in batch.column("text")], "f8").reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(values[:, i]) for i in range(len(STATISTICS)))], names=["doc_id", *STATISTICS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


Rule = tuple[tuple[str, bool, float], ...]


def _paths(node, features: Sequence[str], so_far: Rule) -> Iterator[Rule]:
    """Every path below a node of a fitted tree; a later threshold on the same side replaces an
    earlier one, which it implies."""
    if so_far:
        yield so_far
    if node.subtreeDepth():
        split = node.split()
        name, cut = features[split.featureIndex()], float(split.threshold())
        for child, below in ((node.leftChild(), True), (node.rightChild(), False)):
            rest = tuple(c for c in so_far if c[:2] != (name, below))
            yield from _paths(child, features, tuple(sorted((*rest, (name, below, cut)))))


def condition(rule: Rule) -> Column:
    return reduce(and_, [F.col(name) <= cut if below else F.col(name) > cut for name, below, cut in rule])


def fit(rows: DataFrame, trees=TREES, depth=DEPTH, penalty=PENALTY, seed=1) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules from rows with statistics and ``quality``."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    good, n = rows.agg(F.sum("quality"), F.count(F.lit(1))).first()
    if not n or good in (0, n):
        share = 0.5 if not n else min(max(good / n, 1e-6), 1 - 1e-6)
        return float(np.log(share / (1 - share))), []
    label = F.col("quality").cast("double").alias("label")
    points = rows.select(label, array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(points)
    rules = sorted({r for tree in forest.trees for r in _paths(tree._java_obj.rootNode(), STATISTICS, ())})
    if not rules:
        share = good / n
        return float(np.log(share / (1 - share))), []
    # One column holds all rules as 0 or 1; written once, as every step of the fit reads it.
    held = materialize(rows.select(label, F.array(*[condition(r).cast("double") for r in rules]).alias("rules")))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False)
    model = lasso.fit(held.select("label", array_to_vector("rules").alias("features")))
    return float(model.intercept), [(r, float(w)) for r, w in zip(rules, model.coefficients) if w]


def compile_rules(intercept: float, rules: Sequence[tuple[Rule, float]]) -> Column:
    """The ensemble as one column expression between 0 and 1."""
    total = reduce(lambda a, rw: a + F.when(condition(rw[0]), F.lit(rw[1])).otherwise(0.0), rules, F.lit(intercept))
    return 1 / (1 + F.exp(-total))


def training_sample(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labels outside the held-out fold: (doc_id, quality)."""
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality IS NOT NULL").where(~held_out(F.col("doc_id")))
    return materialize(marked.orderBy(F.xxhash64("doc_id"), "quality").limit(sample))


def _settled(rows: DataFrame) -> DataFrame:
    """Training rows in an order of their own, so that the fit does not depend on the reading."""
    return materialize(rows.repartition(4, "doc_id").sortWithinPartitions("doc_id", *STATISTICS))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    stats = materialize(measured(docs))
    # The sample's size is bounded by its parameter.
    model = fit(_settled(stats.join(F.broadcast(training_sample(labels, sample)), "doc_id")))
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), compile_rules(*model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def kept(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are predicted good, with all their columns, where they are read."""
    chosen = training_sample(labels, sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    model = fit(_settled(measured(texts).join(F.broadcast(chosen), "doc_id")))
    # Numbered names inside: no column of the rows can clash with the statistics.
    fields, text = [f"c{i}" for i in range(len(docs.columns))], f"c{docs.columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(t.as_py()) for t in batch.column(text)], "f8").reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in fields), *(pa.array(values[:, i]) for i in range(len(STATISTICS)))], names=[*fields, *STATISTICS])

    kinds = [f"{c} {f.dataType.simpleString()}" for c, f in zip(fields, docs.schema)] + [f"{s} double" for s in STATISTICS]
    wide = docs.toDF(*fields).mapInArrow(run, ", ".join(kinds)).where(compile_rules(*model) >= threshold)
    return wide.select(*[F.col(c).alias(name) for c, name in zip(fields, docs.columns)])
