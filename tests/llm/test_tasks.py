"""WARC, SimHash, classifier, masked scores, packing and prefix hashes against brute force."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from panelforge.llm import components, masked, packing, prefixes, rules, simhash, warc
from tests.llm.data import SCHEMA, frame, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- WARC -----------------------------------------------------------------------------------


def page_rows():
    out = [(i, f"http://h{i % 5}.com/{i}", f"<p>page {i % 17}</p>" * (i % 4)) for i in range(80)]
    out += [(90, None, None), (91, "http://a/\r\nb%0A", "é\U0001f600\r\n\r\nWARC/1.1\r\n"), (92, "u", "x" * 300_000), (93, "u", "x" * 300_000), (None, "n", "x" * 300_000), (None, "m", "only")]
    return out + [(94, "r", "twice"), (94, "r", "twice")]


@pytest.mark.parametrize("archive_bytes", [warc.ARCHIVE_BYTES, 2_000])
def test_warc_round_trip(spark, archive_bytes):
    data = page_rows()
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string").selectExpr("*", "'x' AS sha", "1 AS first", "2 AS file").repartition(3)
    folder = warc.archive_folder(pages)
    index = warc.write(pages, folder, archive_bytes=archive_bytes)
    first = defaultdict(list)
    for i, _, h in data:
        first[h or ""].append(i)
    got = warc.read(index).collect()
    want = []
    for i, u, h in data:
        raw = (h or "").encode()
        low = min((x for x in first[h or ""] if x is not None), default=None)
        refers = low if low != i and len(first[h or ""]) > 1 else None
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((i, u, len(raw), digest, "response" if refers is None else "revisit", refers, None if refers is not None else raw))
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, want)) == sorted(key((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))) for r in got)
    assert index.select("file").distinct().count() > (3 if archive_bytes < 10_000 else 0)
    some = warc.read(index.where("page_id % 7 = 0"), payload=False)
    assert sorted(r.page_id for r in some.collect()) == sorted(i for i, *_ in data if i is not None and i % 7 == 0)


def test_warc_archives_are_plain_gzip_members(spark):
    pages = spark.createDataFrame([(1, "http://a/", "hello")], "page_id bigint, url string, html string")
    row = warc.write(pages, warc.archive_folder(pages)).collect()[0]
    system, path = warc.open_folder(row.file)
    raw = zlib.decompress(system.open_input_file(path).read(), 31)
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\nhello\r\n\r\n")
    none = warc.write(pages.limit(0), warc.archive_folder(pages))
    assert none.count() == 0 and warc.read(none).count() == 0
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"hello", b"hullo"))


def test_warc_least_payload(spark):
    pages = spark.createDataFrame([(1, "a", "abc"), (2, "a", "abc"), (3, "a", "abcdef"), (4, "a", "abcdef")], "page_id bigint, url string, html string")
    got = {r.page_id: r.record_type for r in warc.write(pages, warc.archive_folder(pages), least=4).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_ranges_are_coalesced():
    near = [("f", i * 100, 100) for i in range(10)]
    assert list(warc.ranges(near)) == [("f", 0, 1000, list(range(10)))]
    apart = [("f", 0, 10), ("f", 10 + warc.GAP + 1, 10), ("g", 0, warc.READ_BYTES), ("g", warc.READ_BYTES, 1)]
    assert [r[3] for r in warc.ranges(apart)] == [[0], [1], [2], [3]]


# --- SimHash --------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    parent = list(range(len(fps)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates_match_brute_force(spark):
    data = rows()
    fps = [slow_fingerprint(r[1]) for r in data]
    root = slow_components(fps)
    low = {}
    for r, c in zip(data, root):
        if r[0] is not None:
            low[c] = min(low.get(c, r[0]), r[0])
    got = simhash.near_duplicates(frame(spark, clashing=True)).collect()
    want = [(r[0], f, low.get(c)) for r, f, c in zip(data, fps, root)]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.fp % 2**64, r.component_id)) for r in got)
    assert len(low) < len(set(fps))
    df = frame(spark, clashing=True)
    kept = simhash.one_per_component(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    # Two rows share the id 185 and are both kept when it stands for its component.
    assert ids == sorted(r[0] for r, c in zip(data, root) if r[0] is not None and r[0] == low.get(c))


def test_pairs_with_three_shared_bytes_meet_and_are_dropped_by_the_tally(spark):
    assert len(simhash.CHOICES) == 20
    for four in itertools.combinations(range(8), 4):
        assert any(set(c) <= set(four) for c in simhash.CHOICES)
    # Equal at the bytes 0, 1 and 2 only: in one list, below the minimum of the tally.
    a, b = 0x0101010101_000000 | 0xABCDEF, 0x0202020202_000000 | 0xABCDEF
    assert simhash.tallied(np.array([a], "u8"), np.array([b], "u8")).tolist() == [3]
    df = spark.createDataFrame([(a,), (b,)], "fp bigint")
    keys = df.select("fp", F.explode(F.array(*[simhash._posting(i) for i in range(20)])).alias("key"))
    assert keys.groupBy("key").count().where("count = 2").count() == 1
    near, apart = np.array([a, a ^ 0xF0_0000_0000_0000], "u8"), np.array([a, b], "u8")
    assert simhash._linked(near)[0, 1] and not simhash._linked(apart)[0, 1]
    assert simhash.tallied(near[:1], near[1:]).tolist() == [7] and simhash.links(df).count() == 0


@pytest.mark.parametrize("dense", [simhash.DENSE, 16, 2])
def test_links_in_lists_of_any_size(spark, monkeypatch, dense):
    """Random fingerprints, and clusters around centres so that posting lists get long."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(dense)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1, 15, 31}
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(50):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp bigint").repartition(3)
    root = {r.node: r.root for r in components.components(simhash.links(df)).collect()}
    groups = defaultdict(set)
    for s in signed:
        groups[root.get(s, s)].add(s)
    want = defaultdict(set)
    for s, c in zip(signed, slow_components(fps)):
        want[c].add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1100)] + [(2000, 2000), (-5, 7000), (7000, -5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 1000 for i in range(1001, 1100)} | {7000: -5}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


# --- classifier -----------------------------------------------------------------------------


def labelled(spark):
    rng = random.Random(2)
    data = []
    for i in range(400):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 80))]
        bad = i % 5 == 1
        data.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words).capitalize() + ".", "en", "s", 0))
    labels = [(i, int(i % 5 != 1), 0) for i in range(0, 400, 2)] + [(None, 1, None), (3, None, 0), (99_999, 1, 0)]
    return data, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_rules_separate_held_out_rows_and_match_their_text(spark):
    data, labels = labelled(spark)
    df = frame(spark, data + rows()[-9:], clashing=True)
    got = rules.score(df, labels).collect()
    assert len(got) == len(data) + 9
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    wrong = [r.doc_id for r in got if r.held_out and r.doc_id is not None and r.doc_id < 180 and r.predicted != int(r.doc_id % 5 != 1)]
    assert not wrong
    kept = rules.kept(df, labels)
    assert kept.columns == df.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r.doc_id) for r in got if r.predicted)


def test_compiled_rules_equal_their_sum(spark):
    found = [((("upper", False, 0.5),), -1.5), ((("digits", True, 0.1), ("log_words", False, 1.0)), 0.75)]
    stats = rules.measured(frame(spark))
    from pyspark.sql import functions as F

    for r in stats.withColumn("p", rules.compile_rules(0.25, found)).collect():
        z = 0.25 - 1.5 * (r.upper > 0.5) + 0.75 * (r.digits <= 0.1 and r.log_words > 1.0)
        assert abs(r.p - 1 / (1 + np.exp(-z))) < 1e-12
    assert stats.where(F.col("log_words").isNull()).count() == 0


def test_rules_without_two_kinds_of_labels(spark):
    df = frame(spark, rows()[:20])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in rules.score(df, none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id bigint, quality int")
    assert all(r.predicted == 1 for r in rules.score(df, ones).collect())
    assert rules.score(spark.createDataFrame([], SCHEMA), ones).count() == 0


def test_statistics_never_divide_by_nothing():
    for text in (None, "", " \n", "a", "\n\na\n", " ", "!", "A" * 100_000, "é" * 10):
        values = rules.statistics(text)
        assert len(values) == len(rules.STATISTICS) and np.isfinite(values).all()


# --- masked scores --------------------------------------------------------------------------


def slow_score(text, vocabulary, network):
    slots = [zlib.crc32(w.encode()) % masked.SLOTS for w in (text or "").lower().split()]
    own = [int(vocabulary.classes[s]) for s in slots]
    total = 0.0
    for i, s in enumerate(slots):
        h = np.zeros(masked.WIDTH)
        for t, o in enumerate([-2, -1, 1, 2]):
            h = h + network.embed[t][own[i + o] if 0 <= i + o < len(own) else masked.CLASSES]
        z = np.tanh(h) @ network.out.astype("f8") + network.bias
        total += z[own[i]] - np.log(np.exp(z - z.max()).sum()) - z.max() + vocabulary.share[s]
    return total


def test_masked_scores_match_brute_force_and_training_helps(spark):
    df = frame(spark, clashing=True)
    got = masked.scored(df).collect()
    table = masked.materialize(masked.tokens(df))
    vocabulary, network = masked.train(table)
    by_id = {r[0]: r[1] for r in rows()}
    for r in got:
        if r.doc_id is None:
            continue
        text = by_id[r.doc_id]
        assert r.n_tokens == len((text or "").lower().split())
        if r.n_tokens < 500:
            assert abs(r.log_likelihood - slow_score(text, vocabulary, network)) < 1e-2
        assert (r.mean_log_likelihood is None) == (r.n_tokens == 0)
    n = sum(r.n_tokens for r in got)
    fresh, trained = masked.Network(vocabulary), sum(r.log_likelihood for r in got) / n
    start = sum(masked.document_score(np.frombuffer(r.slots, "<u2"), vocabulary, fresh) for r in table.collect()) / n
    assert trained > start + 0.05
    assert masked.scored(spark.createDataFrame([], SCHEMA)).count() == 0


def test_masked_training_follows_context(spark):
    """In alternating words the neighbours say which one is masked."""
    data = [(i, " ".join(["tick tock"] * 60), None, None, 0) for i in range(120)] + [(500, "tick tick tock tick tock tock tock tick", None, None, 0)]
    got = {r.doc_id: r.mean_log_likelihood for r in masked.scored(frame(spark, data), rounds=6).collect()}
    assert got[0] > -0.2 and got[500] < got[0] - 0.3


def test_probabilities_sum_to_one():
    counts = np.zeros(masked.SLOTS, "i8")
    counts[:5000] = np.arange(5000)
    v = masked.Vocabulary(counts)
    n = masked.Network(v)
    context = np.random.default_rng(0).integers(0, masked.CLASSES, (4, 3))
    log_p = np.stack([n.log_probabilities(context, np.full(3, c)) for c in range(masked.CLASSES)])
    assert np.allclose(np.exp(log_p).sum(0), 1, atol=1e-4)
    assert np.allclose(np.bincount(v.classes, np.exp(v.share), masked.CLASSES), 1)


# --- packing --------------------------------------------------------------------------------


def test_packing_covers_every_token_once(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    data = rows() + [(900 + i, t, None, None, 0) for i, t in enumerate(["<|endoftext|> a", "don't  we'll\tI'M  x́ é ́", "a\n\n\nb\r\nc", "\U0001f600‍\U0001f600 İ ﬁ ½"])]
    got = packing.packed(frame(spark, data, clashing=True)).collect()
    want = []
    for r in data:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for n, s in enumerate(range(0, len(ids), 2048)):
            want.append((r[0], n, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.packed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_groups_are_bounded(spark):
    laid = packing.materialize(packing.pieces(frame(spark), packing.tokenizer_path()))
    got = packing.pack(laid, group=40).collect()
    groups = defaultdict(int)
    for r in got:
        groups[r.sequence_id >> 32] += 1
    assert len(got) == laid.count() and len(groups) > 3


def test_two_replace_the_smallest():
    # Greedy fills 6 + 3 and leaves a gap of 1; 3 gives way to two pieces of 2 that fill the bin.
    assert sorted(map(sorted, packing.best_two_fit(np.array([6, 3, 2, 2]), 10))) == [[2, 2, 6], [3]]
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = rng.integers(1, 101, rng.integers(1, 200))
        bins = list(packing.best_two_fit(sizes, 100))
        assert sorted(itertools.chain(*bins)) == sorted(sizes.tolist()) and all(sum(b) <= 100 for b in bins)


def test_very_long_texts_are_tokenised_in_parts(monkeypatch):
    words = packing.WordIds(packing.tokenizer_path())
    text = " ".join(f"w{i}" for i in range(3000)) + " " + "z" * 5000 + " end"
    whole = words([text])[0]
    monkeypatch.setattr(packing, "CHARACTERS", 1000)
    monkeypatch.setattr(packing, "REMEMBERED", 100)
    again = packing.WordIds(packing.tokenizer_path())
    assert np.array_equal(whole, np.concatenate([again([t])[0] for t in packing._parts(text)]))
    lengths = [0] * 4
    for taken, cut in packing._cut(pa.array([text, None, "a b", text]), again, 2048):
        for i, (_, _, n, _) in zip(taken, cut):
            lengths[i] += n
    assert lengths == [len(whole) + 1, 1, 3, len(whole) + 1]


def test_ids_equal_those_of_whole_texts():
    words = packing.WordIds(packing.tokenizer_path())
    rng = random.Random(7)
    bits = ["a", "Ab", "É", "é", "e\u0301", "\u03a3", "\u03c2", "\u0130", "\u00df", "\u01c5", "1", "12", "'s", "'", "\u2019", "don't", ".", "..", ",", "!?", "***", "$", "_", "-", "\u201c", "\u2026", "\u00a0", "\t", "\r", "\n", " ", "  ", "\U0001f600", "\u200d", "\u6f22\u5b57", "\u0e01\u0e33", "\u1100\u1161", "\ufb01", "\u00aa", "\u02b0", "<|endoftext|>", "<|", "|>", packing.MARK, "\x0b", "\u2028", "\u0345", "x."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    want = [e.ids for e in words.whole.encode_batch(texts, add_special_tokens=False)]
    for text, a, b in zip(texts, words(texts), want):
        assert a.tolist() == b, ascii(text)
    # In lots, with and without words that need a look each.
    for lot in (["Plain words, twice.", "", "plain  Words\nand more!"], ["<|endof", "text|>"], ["\u03a3\u03a3 a", packing.MARK, "b"], []):
        again = packing.WordIds(packing.tokenizer_path())
        assert [x.tolist() for x in again(lot)] == [words.whole.encode(t, add_special_tokens=False).ids for t in lot]


# --- prefix hashes --------------------------------------------------------------------------


def test_fingerprints_and_edits_match_brute_force(spark):
    data = [r for r in rows() if r[0] is not None][:-1]  # ids are unique here
    got = {r.doc_id: r for r in prefixes.fingerprinted(frame(spark, data, clashing=True)).collect()}
    assert len(got) == len(data)
    order = sorted(data)
    powers = prefixes.Powers()
    for one, two in zip(order, order[1:] + order[:1]):
        text, other = one[1] or "", two[1] or ""
        edited = text[: len(text) - len(text) // 4] + other[: len(text) // 4]
        r = got[one[0]]
        own, changed = prefixes.Document(text, powers).print, prefixes.Document(edited, powers).print
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own, changed)
        assert r.near_edited == prefixes.likeness(own, changed) and r.near_next == prefixes.likeness(own, prefixes.Document(other, powers).print)
        common = next((i for i, (a, b) in enumerate(zip(text, other)) if a != b), min(len(text), len(other)))
        assert r.common_next == common


def test_repeated_and_missing_ids_all_get_a_row(spark):
    assert prefixes.fingerprinted(frame(spark)).count() == len(rows())
    one = prefixes.fingerprinted(frame(spark, [(1, "a single text that is its own next", None, None, None)])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert prefixes.fingerprinted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_span_equality_and_extensions():
    rng = random.Random(1)
    powers = prefixes.Powers()
    for _ in range(40):
        a, b = ("".join(rng.choice("ab\U0001f600") for _ in range(rng.randint(1, 60))) for _ in range(2))
        p, q = prefixes.Prefixes(a, powers), prefixes.Prefixes(b, powers)
        for _ in range(20):
            i, j = rng.randrange(len(a)), rng.randrange(len(b))
            n = rng.randint(0, min(len(a) - i, len(b) - j))
            assert p.equal(i, q, j, n) == (a[i : i + n] == b[j : j + n])
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            assert p.extension(i, q, j) == k


def test_likeness_estimates_common_spans():
    rng = random.Random(4)
    powers, errors = prefixes.Powers(), []
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        a = "".join(rng.choice("abcdefgh ") for _ in range(4000))
        b = a[: int(4000 * share)] + "".join(rng.choice("abcdefgh ") for _ in range(4000 - int(4000 * share)))
        spans = [{t[i : i + prefixes.SPAN] for i in range(len(t) - prefixes.SPAN + 1)} for t in (a, b)]
        errors.append(abs(len(spans[0] & spans[1]) / len(spans[0] | spans[1]) - prefixes.likeness(prefixes.Document(a, powers).print, prefixes.Document(b, powers).print)))
    assert max(errors) < 0.2 and errors[-1] == 0
    assert prefixes.likeness("ffff" * 64, "ffff" * 64) == 1.0
