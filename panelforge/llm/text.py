"""Column expressions for the words and white space of whole texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space is U+0020 and U+0009 to U+000D, everything else belongs to words.
WORD = "[^\\x20\\x09-\\x0D]+"
# One alternative for runs, one for single characters that are not a space, so that the single
# spaces of ordinary prose are never matched.
UNEVEN_SPACE = "[\\x20\\x09-\\x0D]{2,}|[\\x09-\\x0D]"


def whole(text: Column) -> Column:
    """The text, empty when missing."""
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def single_spaced(text: Column) -> Column:
    """Every run of white space replaced by one space."""
    return F.regexp_replace(whole(text), UNEVEN_SPACE, " ")
