"""Sinks and artifact readers: libraries, predictions, metric tables, model records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.functions.expressions import profile_expressions
from panelforge.operators.calendar import PanelShape
from panelforge.session import broadcast_within, drop_table

LIBRARY_SCHEMA = (
    "name string, expression string, expression_text string, direction int, category string, score double, "
    "peak_month string, depth int, nodes int, sampled_search_score double, "
    "best_month_abs_ic double, mean_top_abs_ic double, valid_months int, full_peak_month string, "
    "full_best_month_abs_ic double, full_top3_month_abs_ic double, full_mean_abs_month_ic double, "
    "full_months_abs_ic_ge_005 bigint"
)
# What a full-history review adds to a library.
REVIEW = ("full_peak_month", "full_best_month_abs_ic", "full_top3_month_abs_ic", "full_mean_abs_month_ic", "full_months_abs_ic_ge_005")
# Positions of dates absent from the calendar.
UNKNOWN_DATE = -1
UNKNOWN_TRAIN_END = 1_000_000_000


def write_library(library: DataFrame, path: str) -> None:
    """``factors`` as JSON lines, plus a CSV copy without the expression."""
    library.write.mode("overwrite").json(f"{path}/json")
    library.drop("expression").write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """Library table. Reads what :func:`write_library` wrote, or one JSON document with a
    ``factors`` array whose expressions are nested lists; those are kept as raw text. Libraries
    of the first generation name their score ``search_score``; fields a library lacks are NULL."""
    if path.endswith(".json"):
        document = spark.read.text(path, wholetext=True)
        # Nested lists have no fixed depth, so they are taken out of the text as VARIANT.
        factors = document.select(F.explode(F.expr("cast(parse_json(value):factors as array<variant>)")).alias("f"))
        field = lambda name, kind: F.expr(f"try_variant_get(f, '$.{name}', '{kind}')").alias(name)
        rows = factors.select(
            field("name", "string"),
            F.expr("to_json(variant_get(f, '$.expression', 'variant'))").alias("expression"),
            field("direction", "int"), field("category", "string"),
            F.coalesce(field("score", "double"), field("search_score", "double")).alias("score"),
            field("peak_month", "string"), field("sampled_search_score", "double"),
            field("best_month_abs_ic", "double"), field("mean_top_abs_ic", "double"), field("valid_months", "int"),
            *[field(c, {"full_peak_month": "string", "full_months_abs_ic_ge_005": "bigint"}.get(c, "double")) for c in REVIEW],
        )
        return profile_expressions(rows).drop("valid")
    return spark.read.schema(LIBRARY_SCHEMA).json(f"{path}/json")


def with_review(library: DataFrame, review: DataFrame) -> DataFrame:
    """The library with the columns of a full-history review (one row per factor)."""
    return library.drop(*REVIEW).join(review.select(F.col("factor").alias("name"), *REVIEW), "name", "left")


def library_expressions(library: DataFrame) -> tuple[dict[str, str], dict[str, int]]:
    """Expressions and directions by factor name; a library holds a few dozen rows."""
    rows = library.select("name", "expression", F.coalesce("direction", F.lit(1)).alias("direction")).orderBy("name").collect()
    return {x.name: x.expression for x in rows}, {x.name: x.direction for x in rows}


def write_predictions(ranked: DataFrame, path: str) -> None:
    """All predictions, and separately the selected top-k rows, both by month."""
    out = ranked.withColumn("month", F.substring("trade_date", 1, 6))
    out.write.mode("overwrite").partitionBy("month").parquet(f"{path}/predictions")
    out.where("is_pred_topk").write.mode("overwrite").partitionBy("month").parquet(f"{path}/topk_predictions")


def write_metrics(tables: Mapping[str, DataFrame], path: str) -> None:
    """Each metric table as CSV with a header."""
    for name, table in tables.items():
        table.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def write_records(records: DataFrame, path: str) -> None:
    """Model records, one JSON object per refit."""
    records.write.mode("overwrite").json(path)


def write_refit_log(log: DataFrame, path: str) -> None:
    """``models.csv`` in the folder ``path``: one line per refit of a walk."""
    spark, part = log.sparkSession, f"{path}/_models"
    log.coalesce(1).write.mode("overwrite").option("header", True).csv(part)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/models.csv")
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written = system.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{part}/part-*"))
    system.delete(target, False)
    system.rename(written[0].getPath(), target)
    drop_table(spark, part)


def read_refit_logs(spark: SparkSession, root: str) -> DataFrame:
    """Every ``models.csv`` below ``root`` with the path it came from; dates stay text."""
    schema = "date string, train_start string, train_end string, rows bigint, iteration int"
    files = (
        spark.read.schema(schema)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "models.csv")
        .csv(root)
    )
    return files.select("*", F.col("_metadata.file_path").alias("source_path"))


def audit_columns(models: DataFrame, calendar: DataFrame, shape: PanelShape) -> DataFrame:
    """Add the calendar positions of ``date`` and ``train_end``; unknown dates get the
    values that make the embargo check fail."""
    small = broadcast_within(calendar, shape.dates)
    at = lambda key, out: small.select(F.col("trade_date").alias(key), F.col("position").alias(out))
    return (
        models.join(at("date", "date_position"), "date", "left")
        .join(at("train_end", "train_position"), "train_end", "left")
        .na.fill({"date_position": UNKNOWN_DATE, "train_position": UNKNOWN_TRAIN_END})
    )
