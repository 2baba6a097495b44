"""Small tables with the awkward cases every operator must handle."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

LONG = " ".join(f"Word{i % 997} tail{i % 13}." for i in range(12_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows(seed=0, n=120):
    """Nulls in every column, empty and very long texts, ties, copies, near copies, repeated rows."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "tu") for b in ("ra", "si", "vo", "pe", "du", "zi")]
    out = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 160)))
        out.append((i, text.capitalize() + ".", "en", f"s{i % 7}", len(text)))
    base = " ".join(rng.choice(words) for _ in range(220))
    for i in range(n, n + 30):  # near copies: one word changed
        parts = base.split()
        parts[rng.randrange(len(parts))] = "changed"
        out.append((i, " ".join(parts), "en", "s1", 0))
    for i in range(n + 30, n + 60):  # equal after white space is evened out
        out.append((i, base.replace(" ", rng.choice([" ", "  ", "\t", "\n\n", " \x0b\r "])), None, "s2", None))
    m = n + 60
    out += [(m, None, None, None, None), (m + 1, "", "en", "s3", 0), (m + 2, " \n\t ", "en", None, 3), (m + 3, LONG, "en", "é", len(LONG))]
    out += [(m + 4, "A\u00a0b \U0001f600 ÀÉ 漢字", "fr", "\U0001f600", 9), (m + 5, "one two", "en", "s3", 7), (m + 5, "one two", "en", "s3", 7)]
    out += [(None, "no id here at all", "en", "s4", None), (None, base, "en", "s4", None)]
    return out


CLASHING = ("size", "hash", "sha", "fp", "key", "n", "copies", "target", "_row", "_t", "_id", "_stats", "rank", "cell", "draw", "piece", "length", "log_words", "uid", "slots", "part")


def frame(spark, data=None, clashing=False):
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(f"x{c}") for c in CLASHING}) if clashing else df
