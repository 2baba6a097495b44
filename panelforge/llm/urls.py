"""URL filters by host and path prefix as a sort-merge range join.

A rule ``host/path`` becomes the interval of canonical keys that start with the host's labels in
reverse, a separator and the path. A URL has one key per host its own host lies under. Rules and
URL keys are sorted together by range partitions. Intervals of prefixes are nested or disjoint, so
the sweep carries the stack of rules that were open at the last rule start, and the deepest rule
of that stack whose key starts the URL's key is the innermost one. Each range partition inherits
the stack of the last rule before it, one row per partition.

Only DataFrame operations are used. URLs are first reduced to distinct pairs of host and path, so
a host with most pages is spread over partitions by its paths, and a repeated URL is judged once.
A host has keys only for ends of as many labels as the longest rule host, so the keys of a very
long host do not grow with the square of its length.

Defined results: without ``://`` or when missing, host and path are empty; without a fitting rule
the verdict is the default and the rule is missing; of rules equal in host and path, block wins;
of fitting rules the longest text wins, then the longer host; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelforge.session import broadcast_checked, materialize, small_table

# Separates host and path; sorts before every character of either.
CUT = "\u0001"


def lowered(host: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s).*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s).*?://[^/?#]*([^?#]*)", 1)


def _key(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit(CUT), path)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (verdict, host, path)."""
    verdict, host, path = (pa.array(x, pa.string()) for x in (zip(*rules) if rules else ((), (), ())))
    return small_table(spark, verdict=verdict, host=host, path=path)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Per rule its key and the rules open there: itself and those whose key is a proper prefix."""
    own = rules.select("verdict", lowered(F.col("host")).alias("host"), "path").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    own = own.select(
        _key(F.col("host"), F.col("path")).alias("key"),
        F.struct(
            F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("labels"), F.concat("host", "path").alias("rule"),
            F.col("verdict").alias("verdict"), _key(F.col("host"), F.col("path")).alias("key"),
        ).alias("open"),
    )
    starts = F.expr("transform(sequence(instr(key, '\u0001'), length(key)), i -> left(key, i))")
    inner = own.select(F.col("key").alias("inner"), F.explode(starts).alias("key"))
    return materialize(inner.join(own, "key").groupBy(F.col("inner").alias("key")).agg(F.sort_array(F.collect_list("open"), asc=False).alias("stack")))


def sweep(points: DataFrame, stacks: DataFrame, slices: int) -> DataFrame:
    """For each key of ``points`` the innermost rule, or null.

    ``points`` has one row per distinct key.
    """
    rows = stacks.select("key", F.lit(0).alias("kind"), "stack").unionByName(points.select("key", F.lit(1).alias("kind")), allowMissingColumns=True)
    laid = materialize(rows.repartitionByRange(slices, "key", "kind").withColumn("slice", F.spark_partition_id()))
    last = laid.groupBy("slice").agg(F.max(F.when(F.col("kind") == 0, F.struct("key", "stack"))).alias("m"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("slice", F.last("m.stack", ignorenulls=True).over(before).alias("carried"))
    sorted_ = Window.partitionBy("slice").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    stack = F.coalesce(F.last("stack", ignorenulls=True).over(sorted_), F.col("carried"))
    held = laid.join(broadcast_checked(carried), "slice").withColumn("stack", stack).where("kind = 1")
    return held.select("key", F.expr("get(filter(stack, r -> startswith(key, r.key)), 0)").alias("hit"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    spark = pages.sparkSession
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", "\\.")
    # A rule's host has at most so many labels; longer ends of a host cannot equal one.
    most = rules.agg(F.max(F.size(labels))).first()[0] or 1
    first = F.greatest(F.lit(1), F.size(labels) - (most - 1))
    under = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = rows.where("host != ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    probes = materialize(pairs.select("host", "path", F.explode(under).alias("above")).select("host", "path", _key(F.col("above"), F.col("path")).alias("key")))
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hits = sweep(probes.select("key").distinct(), rule_stacks(rules), slices).where("hit IS NOT NULL")
    best = probes.join(hits, "key").groupBy("host", "path").agg(F.max("hit").alias("hit"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict")
    )
