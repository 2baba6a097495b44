"""Secret scans: fixed patterns and strings of high entropy, with positions.

Three fixed kinds are searched in whole texts. Beyond them, candidate strings (runs of characters
that keys are made of) are scanned with a sliding window per character class: the counts of the
window's characters are updated for the character that enters and the one that leaves, and the
window's Shannon entropy follows from them. Windows at or above the class's threshold are joined
to spans. Candidates on the allow-list, and spans inside a fixed one, are suppressed.

Only DataFrame operations are used. One pass per kind splits a text into the gap before each match
and the match itself, so positions are sums of lengths; texts without a trace of a kind are left
out by a cheaper test. Nothing is shuffled, rows stay where they are read.

Defined results: a missing or empty text has no spans; candidates of any length are scanned in time
that grows with their length; positions count code points, the end is
exclusive; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.llm.text import whole

# Fixed patterns, in the order in which kinds are listed.
ASSIGN = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
ASSIGN_REST = "[\"']?\\x20*[:=]\\x20*[\"']?"
ASSIGN_VALUE = "[A-Za-z0-9+/_.=-]+"
# The runs of these two that are too short hold no other start that would be long enough.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
BASE = ("assign", "access", "hex")
LEAST_VALUE = 8

CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
DIGITS = "0123456789"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SAMPLE = ("example", "sample", "dummy", "placeholder", "changeme")
_ANY, _BEHIND = "|".join(SAMPLE), "|".join(f"(?<={x})" for x in SAMPLE)
_WORD = "(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)"
# Candidates that are known to be harmless: identifiers in their usual notation, dates and times,
# words joined by hyphens, underscores or slashes, one repeated character, and sample values. A date
# or sample word excuses a candidate only if no 20 characters, the least candidate, are left beside it.
# Repeated groups are possessive: the engine takes them in a loop, however many words there are, and
# giving words back could only leave more characters over.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    f"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?:T[0-9-]+Z?)?(?:[/_=+-]++{_WORD}(?=[/_=+-]|$))*+[/_=+-]*.{{0,19}}$",
    f"^[/_=+-]*{_WORD}(?:[/_=+-]++{_WORD})*+[/_=+-]*$",
    "^(.)\\1+$",
    f"(?i)^(?=.*(?:{_ANY}))(?!.*(?:^|{_BEHIND})(?:(?!{_ANY}).){{20}})",
)


@dataclass(frozen=True)
class CharacterClass:
    """Candidates made of ``alphabet`` alone and matching ``form`` are scanned with its window."""

    name: str
    alphabet: str
    form: str
    window: int
    bits: float


CLASSES = (
    CharacterClass("entropy_hex", DIGITS + "abcdefABCDEF", "^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+$", 20, 3.0),
    CharacterClass("entropy_key", DIGITS + LETTERS + LETTERS.upper() + "+/_=-", "^(?=.*[0-9])(?=.*[a-zA-Z])(?=.*[^0-9a-fA-F]).+$", 20, 3.7),
)


def occurrences(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches.

    The pattern must not contain capturing groups. ``\\G`` ties every attempt to the end of the
    match before, so the rest behind the last match is read once.
    """
    split = f"(?s)\\G(.*?)({pattern})"
    parts = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(split), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(split), F.lit(2)).alias("value")
    )
    kind = "array<struct<start:int,end:int,value:string>>"
    none = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))

    def step(acc, part):
        start = acc["at"] + F.length(part["gap"])
        end = start + F.length(part["value"])
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"), part["value"].alias("value")))).alias("found"))

    return F.aggregate(parts, none, step, lambda acc: acc["found"])


def _only_if(text: Column, trace: str, found: Column) -> Column:
    return F.when(text.rlike(trace), found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _x_log_x(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def entropy_spans(value: Column, kind: CharacterClass) -> Column:
    """array<struct<start, end>> within ``value`` covered by windows of at least ``kind.bits``.

    With counts c over a window of w characters the entropy is log2(w) - sum(c log2 c) / w. The
    sum changes only by the entering and the leaving character. The value is turned into places in
    the alphabet once and meets itself ``w`` later, so the work grows with its length.
    """
    w, symbols = kind.window, len(kind.alphabet)
    spans = "array<struct<start:int,end:int>>"
    none = F.array().cast(spans)
    zero = F.struct(
        F.array_repeat(F.lit(0), symbols).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("start"), F.lit(-1).alias("end"), none.alias("closed"),
    )
    enough = F.lit(float(w)) * (F.log2(F.lit(float(w))) - F.lit(kind.bits)) + 1e-9
    span = lambda start, end: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))

    def step(acc, x):
        enters, leaves, i = x["enters"], x["leaves"], x["i"]
        moved = (enters != leaves).cast("int")
        gain = F.element_at(acc["counts"], enters)
        loss = F.when(leaves > 0, F.element_at(acc["counts"], F.greatest(leaves, F.lit(1)))).otherwise(1)
        change = _x_log_x(gain + 1) - _x_log_x(gain) + F.when(leaves > 0, _x_log_x(loss - 1) - _x_log_x(loss)).otherwise(0.0)
        counts = F.transform(acc["counts"], lambda c, j: c + moved * ((j + 1 == enters).cast("int") - (j + 1 == leaves).cast("int")))
        total = acc["sum"] + moved * change
        hot = (i >= w - 1) & (total <= enough)
        opens = hot & (i - (w - 1) > acc["end"])
        return F.struct(
            counts.alias("counts"), total.alias("sum"), F.when(opens, i - (w - 1)).otherwise(acc["start"]).alias("start"),
            F.when(hot, i + 1).otherwise(acc["end"]).alias("end"),
            # Spans are copied only when one of them is closed.
            F.when(opens & (acc["end"] > 0), F.concat(acc["closed"], F.array(span(acc["start"], acc["end"])))).otherwise(acc["closed"]).alias("closed"),
        )

    def walk(places):
        n = F.size(places)
        earlier = F.slice(F.concat(F.array_repeat(F.lit(0), w), places), F.lit(1), n)
        steps = F.arrays_zip(places.alias("enters"), earlier.alias("leaves"), F.sequence(F.lit(0), n - 1).alias("i"))
        close = lambda acc: F.when(acc["end"] > 0, F.concat(acc["closed"], F.array(span(acc["start"], acc["end"])))).otherwise(acc["closed"])
        return F.aggregate(steps, zero, step, close)

    places = F.transform(F.split(value, ""), lambda c: F.call_function("instr", F.lit(kind.alphabet), c))
    return F.when(F.length(value) >= w, _let(places, walk)).otherwise(none)


def _named(found: Column, place: int, name: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(name).alias("kind")))


def _class_spans(candidates: Column, kind: CharacterClass) -> Column:
    """Spans in text positions of the candidates of one character class."""

    def spans(s):
        return F.transform(
            entropy_spans(s["value"], kind), lambda h: F.struct((s["start"] + h["start"]).alias("start"), (s["start"] + h["end"]).alias("end"))
        )

    return F.flatten(F.transform(F.filter(candidates, lambda s: s["value"].rlike(kind.form)), spans))


def scan(docs: DataFrame, classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """doc_id, ``base`` and ``spans``: sorted array<struct<start, place, end, kind>> each."""
    text = F.col("_t")
    assign = F.filter(
        occurrences(text, ASSIGN + ASSIGN_REST + ASSIGN_VALUE),
        lambda s: F.length(F.regexp_extract(s["value"], f"^{ASSIGN}{ASSIGN_REST}({ASSIGN_VALUE})", 1)) >= LEAST_VALUE,
    )
    found = docs.select("doc_id", whole(F.col("text")).alias("_t")).select(
        "doc_id",
        _only_if(text, ASSIGN + "[\"']?\\x20*[:=]", assign).alias("assign"), _only_if(text, ACCESS, occurrences(text, ACCESS)).alias("access"),
        _only_if(text, HEX, occurrences(text, HEX)).alias("hex"), _only_if(text, CANDIDATE, occurrences(text, CANDIDATE)).alias("candidates"),
    )
    base = F.concat(*[_named(F.col(k), i, k) for i, k in enumerate(BASE)])
    found = found.select("doc_id", F.array_sort(base).alias("base"), "candidates")
    suspect = F.filter("candidates", lambda s: ~F.greatest(*[s["value"].rlike(p) for p in allowed], F.lit(False)))
    found = found.withColumn("candidates", suspect)
    extra = [_named(_class_spans(F.col("candidates"), kind), i, kind.name) for i, kind in enumerate(classes, start=len(BASE))]
    new = F.filter(F.concat(*extra), lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", F.when(F.size("candidates") > 0, new).otherwise(F.slice("base", 1, 0)))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts per fixed kind, the digest of the fixed spans and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
