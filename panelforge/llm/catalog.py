"""Registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.llm import conversations, exact, masked, mixing, negatives, packing, prefixes, rules, secrets, simhash, suffixes, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Fixed rules of the URL query: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register("op1_mix_sources")
def mix_sources(spark, folder):
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@register(
    "op2_url_filter",
    r"""
WITH p AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') ELSE '' END AS h,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), q AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
hits AS (
  SELECT q.host, q.path, max_by(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost || rpath)) AS best
  FROM (SELECT DISTINCT host, path FROM q) q JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY q.host, q.path
)
SELECT page_id, q.host, q.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM q LEFT JOIN hits ON q.host = hits.host AND q.path = hits.path
""",
)
def url_filter(spark, folder):
    return urls.judge(table(spark, folder, "pages").select("page_id", "url"), urls.rule_table(spark, RULES))


@register("op3_secret_scan")
def secret_scan(spark, folder):
    return secrets.digest(secrets.scan(table(spark, folder, "documents")))


@register(
    "op4_warc_index",
    r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda k:
    CASE WHEN substr(from_hex(hex)::BIT::VARCHAR, (5 * i + k + 1)::BIGINT, 1) = '1' THEN (16 >> k::INT) ELSE 0 END))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
""",
)
def warc_index(spark, folder):
    pages = table(spark, folder, "pages")
    index = warc.write(pages, warc.archive_folder(pages))
    return warc.read(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op5_simhash_neardup")
def simhash_neardup(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register(
    "op6_exact_dedup",
    r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
""",
)
def exact_dedup(spark, folder):
    return exact.groups(table(spark, folder, "documents"))


@register("op7_quality_rules")
def quality_rules(spark, folder):
    return rules.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register("op8_masked_lm")
def masked_lm(spark, folder):
    return masked.scored(table(spark, folder, "documents"), by_word=True)


@register("op9_best_fit_packing")
def best_fit_packing(spark, folder):
    return packing.packed(table(spark, folder, "documents"))


@register("op10_prefix_fingerprints")
def prefix_fingerprints(spark, folder):
    return prefixes.fingerprinted(table(spark, folder, "documents"))


@register(
    "op11_hard_negatives",
    r"""
WITH q AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.uid, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
  coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0)::BIGINT AS score
  FROM q a JOIN q b ON a.uid <> b.uid WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.uid, p.other_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
  s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.uid = s.uid AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
""",
)
def hard_negatives(spark, folder):
    return negatives.mined(table(spark, folder, "embeddings"))


@register(
    "op12_suffix_dedup",
    r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT row_id, s, hash(substr(h, 2 * s + 1, 800)) AS a, hash(substr(h, 2 * s + 1, 799)) AS b
  FROM (SELECT row_id, h, unnest(range(length(h) // 2 - 399)) AS s FROM d WHERE length(h) >= 800)),
c AS (SELECT a, b FROM w GROUP BY a, b HAVING count(*) > 1),
m AS (SELECT row_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY row_id ORDER BY s) <= 400 THEN 0 ELSE 1 END AS opens FROM w JOIN c USING (a, b)),
r AS (SELECT row_id, min(s) AS start, max(s) + 400 AS stop FROM (SELECT row_id, s, sum(opens) OVER (PARTITION BY row_id ORDER BY s) AS run FROM m) GROUP BY row_id, run),
p AS (SELECT row_id, start, stop, coalesce(lag(stop) OVER (PARTITION BY row_id ORDER BY start), 0) AS before FROM r),
k AS (SELECT row_id, h, count(*) AS n_spans, sum(stop - start) AS n_removed, max(stop) AS last, string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (start - before))::BIGINT), '' ORDER BY start) AS head
  FROM p JOIN d USING (row_id) GROUP BY row_id, h)
SELECT doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(from_hex(coalesce(head || substr(d.h, (2 * last + 1)::BIGINT), d.h))) AS kept_sha256
FROM d LEFT JOIN k USING (row_id)
""",
)
def suffix_dedup(spark, folder):
    return suffixes.without_repeats(table(spark, folder, "documents"), kept=False).drop("kept")


def _repair_sql() -> str:
    """Dynamic programme over the rows of each conversation: one state per kind of the last turn."""
    kinds = {"n": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    move = lambda state, cost, letter: f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'e': {state}.e || '{letter}'}} END"
    least = lambda options: f"list_min(list_filter([{', '.join(options)}], lambda v: v IS NOT NULL))"
    # One insertion per gap: two in a row never pay (deleting costs less, or the kind is the same again).
    wide = lambda q: ", ".join(
        least([f"{q}.{k}", *[move(f"{q}.{b}", 5, "I") for b, f in kinds.items() for r, to in f.items() if to == k and r != "s"]]) + f" AS {k}" for k in kinds
    )

    def after(k):
        options = [move(f"q.{k}", 2, "D")]
        for b, f in kinds.items():
            for role, to in f.items():
                if to == k:
                    options.append(f"CASE WHEN NOT gone AND initial = '{role}' THEN {move(f'q.{b}', 'stay', 'K')} END")
                    if role != "s":
                        options.append(f"CASE WHEN NOT gone AND initial <> '{role}' THEN {move(f'q.{b}', 'stay + 1', 'R')} END")
        return f"{least(options)} AS {k}"

    return rf"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
bits AS (SELECT DISTINCT k, encode(k) AS b FROM src),
crc(k, b, i, v) AS (SELECT k, b, 0, 4294967295::BIGINT FROM bits UNION ALL
  SELECT k, b, i + 1, list_reduce([xor(v, ('0x' || substr(hex(b), 2 * i + 1, 2))::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) FROM crc WHERE i < octet_length(b)),
fates AS (SELECT k, xor(v, 4294967295) % 20 AS fate FROM crc WHERE i = octet_length(b)),
damaged AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM src JOIN fates USING (k) WHERE fate <> 0),
signed AS (SELECT *, unhex(sha256(length(role)::VARCHAR || ':' || role || text)) AS sign, left(role, 1) AS initial,
  regexp_replace(text, '[ 	-
]+$', '') AS seen FROM damaged),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sign, copy) AS i,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sign, copy) || initial AS pair FROM signed),
judged AS (SELECT *, seen = '' AS blank, seen <> '' AND i > min(i) OVER (PARTITION BY conv_id, role, text) AS duplicate,
  right(seen, 1) NOT IN ('.', '!', '?') AND seen <> '' AS unended FROM ordered),
turns AS (SELECT *, blank OR duplicate AS gone, CASE WHEN unended THEN 5 ELSE 0 END AS stay FROM judged),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
  count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE unended AND NOT duplicate) AS truncated,
  count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
walk(conv_id, i, n, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0, 'e': ''}}, NULL::STRUCT(c INTEGER, e VARCHAR), NULL::STRUCT(c INTEGER, e VARCHAR), NULL::STRUCT(c INTEGER, e VARCHAR) FROM counts
  UNION ALL SELECT q.conv_id, q.i + 1, {", ".join(after(k) for k in kinds)}
  FROM (SELECT conv_id, i, {wide("w")} FROM walk w) q JOIN turns t ON t.conv_id IS NOT DISTINCT FROM q.conv_id AND t.i = q.i + 1),
ends AS (SELECT w.conv_id, {wide("w")} FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i),
best AS (SELECT conv_id, {least(["n", "a"])} AS v FROM ends),
edits AS (SELECT conv_id, v.e AS audit, unnest(range(1, length(v.e) + 1)) AS j FROM best),
steps AS (SELECT conv_id, j, substr(audit, j, 1) AS edit, j - length(replace(left(audit, j), 'I', '')) AS inserted,
  length(replace(left(audit, j), 'D', '')) AS place FROM edits),
lines AS (SELECT st.conv_id, st.place, CASE WHEN edit = 'K' THEN t.role END AS kept,
  CASE WHEN edit = 'I' THEN '' ELSE t.text END AS text, max(CASE WHEN edit = 'K' AND place = 1 AND t.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY st.conv_id) AS system
  FROM steps st LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM st.conv_id AND t.i = st.j - st.inserted AND edit <> 'I' WHERE edit <> 'D'),
texts AS (SELECT conv_id, string_agg(coalesce(kept, CASE WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY place) AS whole FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v.c, 0)::BIGINT AS cost, coalesce(v.e, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@register("op13_conversation_repair", _repair_sql())
def conversation_repair(spark, folder):
    return conversations.repaired_after_damage(table(spark, folder, "conversations"))


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
