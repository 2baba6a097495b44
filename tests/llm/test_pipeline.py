"""The pipeline stage by stage against the operators' own decisions and brute force."""

import re
from collections import Counter

import corpus_pipeline
from panelforge.llm import rules
from tests.llm.data import CLASHING, SCHEMA, frame
from tests.llm.test_tasks import slow_components, slow_fingerprint

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    columns, out = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, FOLDER))
        out.append(docs.collect())
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    good, single, distinct, mixed, packed = out
    raw = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = {r.doc_id for r in rules.score(raw, labels).collect() if r.predicted}
    assert {r.doc_id for r in good} == want and len(good) == len(want)
    marked = {r.doc_id: r.quality for r in labels.collect()}
    assert not [i for i, q in marked.items() if q == 1 and i not in want]  # clean documents stay

    first = {}
    for r in sorted(good, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert sorted(r.doc_id for r in single) == sorted(first.values())

    ordered = sorted(single, key=lambda r: r.doc_id)
    roots = slow_components([slow_fingerprint(r.text) for r in ordered])
    assert sorted(r.doc_id for r in distinct) == [r.doc_id for i, r in enumerate(ordered) if roots[i] == i]

    assert {r.doc_id for r in mixed} <= {r.doc_id for r in distinct}
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
    assert Counter(r.doc_id for r in mixed) == Counter(r.doc_id for r in packed if r.piece == 0)


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def walked(spark, docs, folder):
    """Rows after each stage."""
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder))
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
        out[name] = docs.collect()
    return out


def test_awkward_rows_and_clashing_columns(spark, tmp_path):
    """Missing and empty texts, missing ids, repeated rows, very long texts, columns named like the stages' own."""
    docs = frame(spark, clashing=True)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(180)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = walked(spark, docs, str(tmp_path))
    good, single, distinct, mixed, packed = out.values()
    text = lambda r: re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
    assert len(single) == len({text(r) for r in good}) == len({text(r) for r in single})
    assert {r.doc_id for r in distinct} <= {r.doc_id for r in single} and len(distinct) <= len(single)
    for rows in (good, single, distinct, mixed):
        assert all(r[c] == f"x{c}" for r in rows for c in CLASHING)
    assert Counter(r.doc_id for r in mixed) == Counter(r.doc_id for r in packed if r.piece == 0)


def test_no_labels_and_no_documents(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    empty.write.parquet(f"{tmp_path}/labels.parquet")
    assert all(rows == [] for rows in walked(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).values())
    docs = frame(spark)
    for marks, share in (((), 1), ((1,), 1), ((0,), 0)):
        spark.createDataFrame([(i, q, 0) for q in marks for i in range(100)], "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        kept = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and kept.count() == share * docs.count()
