import pytest

import corpus_pipeline
from stemma.llm import packing, quality_rules
from tests.llm.test_pii import brute
from tests.llm.test_tokens_and_rules import _brute_groups, _brute_print


def _row_key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "")


def test_stages_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_classifier", "quality_rules", "near_dedup", "pii", "packing"]
    good = stage["quality_classifier"](spark, docs, folder).cache()
    assert good.schema.fieldNames() == docs.schema.fieldNames()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    own = [(d in kept) == (q == 1) for d, q in labels.items()]
    assert sum(own) / len(own) > 0.95
    ruled = stage["quality_rules"](spark, good, folder).cache()
    want = [r for r in good.collect() if quality_rules.measure(r.text)[0] >= 50]
    assert {r.doc_id for r in ruled.collect()} <= {r.doc_id for r in want}
    assert ruled.count() > 0.9 * len(want)
    unique = stage["near_dedup"](spark, ruled, folder).cache()
    prints = {r.doc_id: _brute_print(r.text) for r in ruled.collect()}
    root = _brute_groups(sorted(set(prints.values())))
    least = {}
    for d in sorted(prints):
        least.setdefault(root[prints[d]], d)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(least.values())
    clean = stage["pii"](spark, unique, folder).cache()
    before, after = {r.doc_id: r for r in unique.collect()}, {r.doc_id: r for r in clean.collect()}
    assert set(before) == set(after)
    for d, r in after.items():
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (before[d].lang, before[d].source)
        assert not brute(r.text)
        if not brute(before[d].text) and "token" not in before[d].text:
            assert r.text == before[d].text
    packed = stage["packing"](spark, clean, folder).collect()
    assert {r.doc_id for r in packed} == set(after)
    assert sum(r.length for r in packed) <= packing.CAPACITY * len({r.sequence_id for r in packed})


@pytest.mark.parametrize("empty", [False, True])
def test_edge_cases(spark, empty, tmp_path):
    prose = " ".join(f"word{i} and then some" for i in range(80))
    rows = [(1, prose, "x", 1.5), (1, prose, "x", 1.5), (2, prose + " end", None, None), (None, prose + " end", None, None), (3, None, "y", 2.0), (4, "", None, 0.0), (1, "other " + prose[::-1], "z", None)]
    docs = spark.createDataFrame([] if empty else rows, "doc_id long, text string, row string, k double")
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        n = out.count()
        assert n == 0 if empty else n >= 0
        if name == "near_dedup" and not empty:
            assert n == 3  # the prose with all its copies, the empty texts, the other


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows[0].asDict())
