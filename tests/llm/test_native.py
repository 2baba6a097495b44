"""Mixing, URL filters, secret scans and exact dedup against brute force."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelforge.llm import exact, mixing, secrets, urls
from tests.llm.data import SCHEMA, frame, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sizes(data):
    return [len(WORD.findall(r[1] or "")) for r in data]


def water(words, weights, most=3.0):
    """Targets by resharing the excess until no source is above its bound."""
    total, out, free = sum(words.values()), {}, set(words)
    left = total
    while free:
        w = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / w > most * words[s]]
        if not over:
            out |= {s: left * weights[s] / w for s in free}
            break
        for s in over:
            out[s] = most * words[s]
            left -= out[s]
            free.discard(s)
    return out


def test_mix_targets_and_bounds(spark):
    data = rows()
    got = mixing.mix(frame(spark, clashing=True)).collect()
    assert sorted(r["size"] for r in got) == sorted(sizes(data))
    words = defaultdict(int)
    for r, n in zip(data, sizes(data)):
        words[r[3]] += n
    order = sorted((s for s in words if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = water(words, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == words[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in words:
        assert want[s] - largest[s] <= taken[s] <= want[s] + 1e-6
    again = mixing.mix(frame(spark).repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mix_rates_rise_with_appeal(spark):
    data = [(i, "w " * (10 if i % 2 else 90), None, "a" if i < 600 else "b", 0) for i in range(1200)]
    got = mixing.mix(frame(spark, data), weights=(1, 3)).where("source = 'a'").collect()
    mean = lambda n: sum(r.copies for r in got if r["size"] == n) / sum(1 for r in got if r["size"] == n)
    # Copies follow the square root of the size: three times as many of the texts nine times as long.
    assert 2.4 < mean(90) / mean(10) < 3.6


def test_mixed_repeats_rows_with_all_columns(spark):
    df = frame(spark, clashing=True)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    want = defaultdict(int)
    for r in mixing.mix(df).collect():
        want[r.doc_id, r["size"]] += r.copies
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id, len(WORD.findall(r.text or ""))] += 1
    assert {k: v for k, v in want.items() if v and k[1]} == {k: v for k, v in got.items() if k[1]}


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = mixing.mix(frame(spark, [(1, None, None, None, None), (2, "", None, "a", 0)])).collect()
    assert [r.taken for r in blank] == [0, 0] and {r.target for r in blank} == {0.0}


def test_sources_are_numbered_across_slices(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 7)
    df = spark.createDataFrame([(f"s{i:03d}",) for i in range(40)] + [(None,)], "source string")
    from pyspark.sql import functions as F

    got = {r.source: r.place for r in mixing.numbered(df, [F.col("source").asc_nulls_last()], "place").collect()}
    assert got == {f"s{i:03d}": i for i in range(40)} | {None: 40}


# --- URLs -----------------------------------------------------------------------------------


def judged(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = max(
        ((len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, 0, None, "allow")
    )
    return host, path, best[2], best[3]


RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.net", "/en/x"), ("allow", "example.net", "/en/x/y"),
    ("block", "a.example.net", ""), ("block", "org", "/fr/"), ("allow", "www.b.org", "/"), ("block", "com", "/a"), ("allow", "com", "/ab"), ("block", "x.com", "/"),
]
URLS = [
    None, "", "no scheme", "http://", "://net/", "HTTP://EXAMPLE.NET/en/", "http://example.net", "http://example.net/", "http://example.net/en",
    "http://www.example.net/en/x/y/z?q#f", "http://a.example.net?x=/en/", "http://badexample.net/en/", "http://net/", "http://b.org/fr/1", "http://www.b.org/fr/",
    "http://x.com/", "http://y.x.com/ab#://z", "http://com/abc", "http://com/a\nb", "http://u@h.com:80/ab", "http://.net/", "http://a..net/", "x://é.com/ab", "http://x.com//a", "a\nb://net/",
]


def test_urls_match_brute_force(spark):
    rng = random.Random(3)
    hosts = ["net", "example.net", "a.example.net", "b.a.example.net", "org", "b.org", "www.b.org", "com", "x.com", "q.x.com"]
    more = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/x', '/en/x/y', '/en/xz', '/fr/', '/fr', '/a', '/ab', '/abc'])}" for _ in range(400)]
    data = list(enumerate(URLS + more)) + [(None, "http://net/"), (5, URLS[5])]
    pages = spark.createDataFrame(data, "page_id bigint, url string").selectExpr("*", "'k' AS key", "1 AS host", "2 AS path", "3 AS n", "'r' AS rule").repartition(4)
    got = urls.judge(pages.drop("host", "path", "rule"), urls.rule_table(spark, RULES)).collect()
    assert sorted(map(repr, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(map(repr, ((i, *judged(u, RULES)) for i, u in data)))


def test_urls_of_many_labels_and_other_letters(spark):
    hosts = ["a." * 20_000 + "example.net", "\u00c9.NET", "\u00e9.net", "net", "x.\u00c9.net"]
    rules = [("block", "\u00c9.net", "/"), ("allow", "example.net", "/"), ("block", "x.y.example.net", "/")]
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(hosts)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, urls.rule_table(spark, rules)).collect()}
    block = ("\u00c9.net/", "block")
    assert got == {0: ("example.net/", "allow"), 1: block, 2: (None, "allow"), 3: (None, "allow"), 4: block}


def test_urls_without_pages_or_rules(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert urls.judge(none, urls.rule_table(spark, RULES)).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    assert urls.judge(one, urls.rule_table(spark, [])).collect()[0].verdict == "allow"


# --- secrets --------------------------------------------------------------------------------

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)


def scanned(text):
    """Fixed and entropy spans by recomputing every window from scratch."""
    text = text or ""
    base = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    extra = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        if any(re.search(p, m[0]) for p in secrets.ALLOWED):
            continue
        for i, c in enumerate(secrets.CLASSES, start=3):
            if not re.search(c.form, m[0]):
                continue
            spans = []
            for s in range(len(m[0]) - c.window + 1):
                part = m[0][s : s + c.window]
                h = -sum(part.count(x) / c.window * math.log2(part.count(x) / c.window) for x in set(part))
                if h >= c.bits - 1e-9:
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = s + c.window
                    else:
                        spans.append([s, s + c.window])
            extra += [(m.start() + a, i, m.start() + b, c.name) for a, b in spans]
    extra = [e for e in extra if not any(b[0] <= e[0] and e[2] <= b[2] for b in base)]
    return sorted(base), sorted(base + extra)


def texts():
    rng = random.Random(5)
    any_ = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
    key = lambda n, a=any_: "".join(rng.choice(a) for _ in range(n))
    out = [None, "", "token=", "token: short", "Password = 'abcdefgh'", "api_key:token=abcdefgh1", "token: api_key: abcdefgh12", "PASSWD=\"a.b-c/d+e=f\"", "AKIA" + "A" * 11, "AKIA" * 5]
    out += ["secret:\x20\x20" + key(12), "\U0001f600 é token=" + key(10) + "\n" + key(40, "0123456789abcdef"), "x" * 50, "ab" * 30, key(64, "0123456789abcdef").upper()]
    out += [key(30), "id " + key(200) + " end", key(24) + " " + key(19), "550e8400-e29b-41d4-a716-446655440000", "some-long-hyphen-words-in-a-row", "EXAMPLE" + key(30), "a" * 25 + key(25) + "b1" * 30]
    out += [" ".join(rng.choice([key(rng.randint(5, 60)), "word", "token=" + key(9), "tokens", key(35, "0123456789abcdef")]) for _ in range(40)) for _ in range(30)]
    return out


def test_secrets_match_brute_force(spark):
    data = list(enumerate(texts()))
    docs = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "'b' AS base", "1 AS spans", "2 AS candidates", "3 AS hex", "'t' AS _t")
    joined = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(docs)).collect()}
    extra = 0
    for i, text in data:
        base, spans = scanned(text)
        r = got[i]
        assert r.spans == joined(spans), text
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[3] == k for b in base) for k in secrets.BASE)
        extra += len(spans) - len(base)
    assert extra > 20
    assert secrets.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# --- exact dedup ----------------------------------------------------------------------------


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("capacity", [exact.CAPACITY, 4])
def test_exact_groups_match_brute_force(spark, capacity):
    data = rows()
    found = defaultdict(list)
    for r in data:
        found[normal(r[1])].append(r[0])
    got = exact.groups(frame(spark, clashing=True), capacity=capacity).collect()
    assert len(got) == len(data)
    want = sorted(
        repr((r[0], min((i for i in found[normal(r[1])] if i is not None), default=None), len(found[normal(r[1])]), hashlib.sha256(normal(r[1]).encode()).hexdigest()))
        for r in data
    )
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    assert sum(r.kept for r in got) == len(found) and all(r.kept <= (r.doc_id == r.keep_id) for r in got)


def test_exact_keeps_one_row_of_each_text(spark):
    df = frame(spark, clashing=True)
    out = exact.deduplicated(df, capacity=8)
    assert out.columns == df.columns
    first = {}
    for r in rows():
        first.setdefault(normal(r[1]), []).append(r[0])
    got = sorted((normal(r.text), r.doc_id) for r in out.collect())
    assert got == sorted((t, min((i for i in ids if i is not None), default=None)) for t, ids in first.items())
    assert exact.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_buckets_split_until_they_fit(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id bigint, text string")
    index = exact.index(exact.routed(exact.keys_of(df), 16), capacity=16)
    counts = index.groupBy("depth", "bucket").count().collect()
    assert max(r["count"] for r in counts) <= 16 and len({r.depth for r in counts}) > 1
    # Every hash lies in its bucket, and the buckets cover the key space without overlap.
    assert sum(1 / 2**r.depth for r in counts) <= 1
    assert all((h.hash % 2**64) >> (64 - h.depth) == h.bucket for h in index.collect() if h.depth)


def test_copies_are_decided_in_the_buckets_of_the_directory(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"text {i % 40}") for i in range(200)], "doc_id bigint, text string").repartition(4)
    whole = {tuple(r) for r in exact.groups(df, capacity=8).collect()}
    assert len(whole) == 200 and sum(r[3] for r in whole) == 40
    keys = exact.routed(exact.keys_of(df), 8)
    entries = exact.index(keys, 8)
    assert entries.count() == 40 and {r.n for r in entries.collect()} == {5}
    by_bucket = keys.groupBy("depth", "bucket").agg(F.countDistinct("hash").alias("hashes")).collect()
    assert max(r.hashes for r in by_bucket) <= 8 and len(by_bucket) > 4
    # A directory that lacks buckets loses their entries.
    lost = exact.directory
    monkeypatch.setattr(exact, "directory", lambda hashes, capacity: lost(hashes, capacity).where("bucket % 2 = 0"))
    assert {tuple(r) for r in exact.groups(df, capacity=8).collect()} != whole
