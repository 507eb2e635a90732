import pytest

from stemma.llm import toxicity


def _held_out(rows, folds, fold):
    import zlib

    return [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % folds == fold]


def test_toxicity_on_held_out_rows(spark):
    from stemma.llm import queries

    folder = "/root/testdata/sf0.1"
    rows = queries.op8_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert {r.doc_id for r in rows if r.held_out} == {r.doc_id for r in _held_out(rows, 5, 0)}
    rows = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    hit = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    wrong = sum(r.predicted for r in rows if not r.toxic) / sum(not r.toxic for r in rows)
    print("toxicity held-out", hit, wrong)
    assert hit > 0.8 and wrong < 0.02


@pytest.mark.parametrize("labels", [[], [(0, 0), (1, 0)], [(0, 0), (1, 1), (2, None), (1, 1), (9, 1)]])
def test_toxicity_edge_cases(spark, labels):
    docs = spark.createDataFrame([(0, "a nice day", 5), (1, "you bad bad thing", 6), (2, None, 7), (None, "", 8), (3, "é" * 100_000, 9), (1, "you bad bad thing", 6)], "doc_id long, text string, score int")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(toxicity.labelled_rows(docs, marks, "toxic", 5, 9))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    if len(labels) > 2:
        by = {r.doc_id: r.score for r in rows}
        assert by[1] > 0.5 > by[0]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_quality_on_held_out_rows(spark):
    from stemma.llm import queries

    folder = "/root/testdata/sf0.1"
    rows = queries.op7_quality_classifier(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert {r.doc_id for r in rows if r.held_out} == {r.doc_id for r in _held_out(rows, 4, 2)}
    rows = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    kept = sum(r.predicted for r in rows if r.quality) / sum(r.quality for r in rows)
    wrong = sum(r.predicted for r in rows if not r.quality) / sum(not r.quality for r in rows)
    assert kept > 0.98 and wrong < 0.1


def _word_hash(word):
    import numpy as np

    from stemma.llm import quality_classifier as q

    h = sum((b + 1) * pow(q._FACTOR, i, 1 << 64) for i, b in enumerate(word.encode())) % (1 << 64)
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 % (1 << 64)
    return np.uint64(h ^ h >> 32)


TWENTY = ["One two three, one TWO", "x", None, "", "a b", "one two", "é ü ß", "\x1c\x85 a", "w" * 300 + " end", "a\tb\nc\rd", "bad BAD bad!! bad", "  lead and trail  "] + [f"text {i} of {i % 3} twenty twenty" for i in range(8)]


@pytest.mark.parametrize("slice_bytes,slice_words", [(1 << 20, 1 << 17), (16, 3)])
def test_word_vectors_and_pooled_features_equal_a_plain_count(spark, monkeypatch, slice_bytes, slice_words):
    import re

    import numpy as np

    from stemma.llm import quality_classifier as q

    index, sums, read = q.index_vectors(), {}, []
    for t in TWENTY:
        own = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        hashes = [_word_hash(w) for w in own]
        bucket = [int(h >> np.uint64(64 - q.BITS)) for h in hashes]
        read.append((own, bucket))
        for i, b in enumerate(bucket):
            for j in range(max(0, i - 2), min(len(bucket), i + 3)):
                if i != j:
                    sums[b] = sums.get(b, 0) + index[bucket[j]].astype(int)
    want = np.zeros((1 << q.BITS, q.DIMENSIONS))
    for b, v in sums.items():
        want[b] = np.rint(127 * v / max(np.linalg.norm(v), 1e-9))
    monkeypatch.setattr(q, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(q, "SLICE_WORDS", slice_words)
    row, h = q.words([t or "" for t in TWENTY])
    assert [q.buckets(h[row == i]).tolist() for i in range(len(TWENTY))] == [b for _, b in read]
    vectors = q.word_vectors(spark.createDataFrame([(t,) for t in TWENTY], "text string"))
    assert np.array_equal(vectors, want)
    table = np.zeros((1 << q.BITS, q.DIMENSIONS), np.int32)
    q.add_contexts(table, row, q.buckets(h))
    assert all(np.array_equal(table[b], v) for b, v in sums.items())
    got = q.pool([t or "" for t in TWENTY], vectors)
    for (own, bucket), x in zip(read, got, strict=True):
        n = max(len(own), 1)
        mean = sum((want[b] for b in bucket), np.zeros(q.DIMENSIONS)) / 127 / n
        extra = [sum(a == b for a, b in zip(own, own[1:])) / n, len(set(own)) / n, np.log1p(len(own)) / 10]
        assert np.allclose(x, [*mean, *extra], atol=1e-6)


def test_sums_beyond_a_byte_survive_the_parts():
    import numpy as np
    import pyarrow as pa

    from stemma.llm import quality_classifier as q

    rng = np.random.default_rng(1)
    table = np.zeros((1 << q.BITS, q.DIMENSIONS), np.int32)
    table[::997] = rng.integers(-10**6, 10**6, (len(table[::997]), q.DIMENSIONS))
    parts = list(q._part_rows(table))
    out = {b.column("part")[0].as_py(): np.frombuffer(b.column("v")[0].as_py(), np.int8) for b in q._sum_parts(iter(sorted([*parts, *parts], key=lambda b: b.column("part")[0].as_py())))}
    want = np.rint(127 * table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9))
    assert np.array_equal(np.concatenate([out[p] for p in sorted(out)]).reshape(-1, q.DIMENSIONS), want)


def test_scores_and_temperature_of_a_small_model():
    import numpy as np

    from stemma.llm import quality_classifier as q

    rng = np.random.default_rng(0)
    y = (rng.random(1500) < 0.6).astype(float)
    x = rng.normal(size=(1500, 5)) + 0.8 * y[:, None]
    model = q.fit_network(x, y, None)
    for own, p in zip(x[:20], model.probabilities(x[:20]), strict=True):
        z = sum(np.tanh(sum((own[i] - model.mean[i]) / model.spread[i] * model.w1[i, j] for i in range(5)) + model.b1[j]) * model.w2[j] for j in range(len(model.w2))) + model.b2
        assert abs(p - 1 / (1 + np.exp(-z / model.temperature))) < 1e-9
    assert 0.02 < model.temperature < 50
    fresh = (rng.random(4000) < 0.6).astype(float)
    p = model.probabilities(rng.normal(size=(4000, 5)) + 0.8 * fresh[:, None])
    for low in (0.0, 0.2, 0.4, 0.6, 0.8):  # probabilities mean what they say
        own = (p >= low) & (p < low + 0.2)
        assert abs(p[own].mean() - fresh[own].mean()) < 0.08
    apart = q.fit_network(np.where(y == 1, 3.0, -3.0)[:, None] + rng.normal(0, 0.1, (1500, 1)), y, None)
    assert 0.02 < apart.temperature < 50  # also where the classes lie wholly apart


def test_figures_with_and_without_the_extra_features(spark):
    import numpy as np

    from stemma.llm import quality_classifier as q

    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    vectors = q.word_vectors(docs)
    rows = [(r.text or "", r.quality, held) for r in docs.join(labels, "doc_id").collect() for held in [bool(_held_out([r], 4, 2))]]
    x = q.pool([t for t, _, _ in rows], vectors).astype(float)
    y, held = np.array([v for _, v, _ in rows], float), np.array([h for _, _, h in rows])
    for name, own in (("word vectors alone", slice(0, q.DIMENSIONS)), ("all", slice(None)), ("repeats alone", slice(q.DIMENSIONS, None))):
        model = q.fit_network(x[~held][:, own], y[~held], None)
        p = model.probabilities(x[held][:, own])
        right = ((p >= 0.7) == y[held]).mean()
        print(name, "accuracy at 0.7", round(float(right), 4), "temperature", round(model.temperature, 3))
        assert right >= {"word vectors alone": 0.975, "all": 0.985, "repeats alone": 0.9}[name]
        assert 0.02 < model.temperature < 50


@pytest.mark.parametrize("labels", [[], [(0, 0), (1, 0)], [(0, 0), (1, 1), (2, None), (1, 1), (9, 1)]])
def test_quality_edge_cases(spark, labels):
    from stemma.llm import quality_classifier as q

    docs = spark.createDataFrame([(0, "a nice day", 5), (1, "BAD!! bad bad", 6), (2, None, 7), (None, "", 8), (3, "é" * 100_000, 9), (1, "BAD!! bad bad", 6)], "doc_id long, text string, score int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    model = q.train(docs, toxicity.labelled_rows(docs, marks, "quality", 4, 9))
    rows = q.score(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert q.score(docs.limit(0), q.train(docs.limit(0), toxicity.labelled_rows(docs.limit(0), marks, "quality", 4, 9))).count() == 0


def _brute_buckets(text):
    """Distinct buckets of a text's 3-, 5- and 7-grams of characters, one by one."""
    low = [ord(c) if ord(c) > 127 or c.isalnum() else 32 for c in text.lower()]
    out = set()
    for n in toxicity.SIZES:
        for at in range(len(low) - n + 1):
            h = 0
            for c in low[at : at + n]:
                h = h * 0x01000193 % (1 << 32) ^ c
            out.add((h * 0x9E3779B1 % (1 << 32) ^ n * 0x01000193 % (1 << 32)) >> (32 - toxicity.BITS))
    return out


@pytest.mark.parametrize("slice_chars", [1 << 20, 5])
def test_grams_counts_ratios_and_scores_of_twenty_texts(spark, monkeypatch, slice_chars):
    import math

    import numpy as np

    texts = [t or "" for t in TWENTY]
    marks = [i % 3 == 0 for i in range(len(texts))]
    monkeypatch.setattr(toxicity, "SLICE_CHARS", slice_chars)
    read = toxicity.Reader()
    want = [_brute_buckets(t) for t in texts]
    assert [set(read.buckets(t).tolist()) for t in texts] == want and all(len(read.buckets(t)) == len(w) for t, w in zip(texts, want, strict=True))
    labelled = spark.createDataFrame([(i, t, int(m)) for i, (t, m) in enumerate(zip(texts, marks, strict=True))], "k long, t string, y int")
    counts = {r.bucket: (r.c0, r.c1) for r in toxicity.bucket_counts(labelled).collect()}
    assert counts == {b: tuple(sum(b in w and m == own for w, m in zip(want, marks, strict=True)) for own in (False, True)) for b in set().union(*want)}
    n1 = sum(marks)
    n0, q = len(texts) - n1, n1 / len(texts)
    c0, c1 = (np.array([c[i] for c in counts.values()]) for i in (0, 1))
    ratio, apart = toxicity.ratios(c0, c1, n0, n1)
    for i, (a, b) in enumerate(counts.values()):
        assert math.isclose(ratio[i], math.log((b + q) / (n1 + q) / ((a + 1 - q) / (n0 + 1 - q))), abs_tol=1e-12)
        p = (a + b) / len(texts)
        assert math.isclose(apart[i], abs(b / n1 - a / n0) / math.sqrt(max(p * (1 - p), 1e-12) * (1 / n0 + 1 / n1)), rel_tol=1e-9, abs_tol=1e-9)
    model = toxicity.train(labelled)
    got = {r.doc_id: r.score for r in toxicity.score(labelled.selectExpr("k as doc_id", "t as text"), model).collect()}
    for i, own in enumerate(want):
        kept = [b for b in own if model.weight[b]]
        z = sum(float(model.weight[b]) for b in kept) / math.sqrt(max(len(kept), 1)) + model.intercept
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_all_telling_grams_count_whatever_their_number():
    import numpy as np

    apart = np.r_[np.full(5000, 9.0), np.full(100, 1.0)]
    assert len(toxicity.telling(apart)) == 5000
    assert toxicity.telling(apart[-100:], 10).tolist() == list(range(10))


def test_a_row_that_comes_very_often_cannot_fill_the_sample(spark):
    rows = spark.createDataFrame([(1, "same", 1)] * 3000 + [(i, f"t {i}", 0) for i in range(3000)], "k long, t string, y int")
    found = toxicity.sampled(rows, 100_000, {0: 3000, 1: 3000})
    assert found.where("y = 1").count() == 1 and found.where("y = 0").count() == 3000
    assert {r.k for r in toxicity.sampled(rows, 300, {0: 3000, 1: 3000}).collect()} == {r.k for r in toxicity.sampled(rows.repartition(7), 300, {0: 3000, 1: 3000}).collect()}


def test_rarer_toxic_phrases_keep_their_grams(spark):
    import random

    rng = random.Random(1)
    phrases = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=250)) for _ in range(20)]  # about 740 n-grams each
    rows = [(p, 1) for i, p in enumerate(phrases) for _ in range(40 - i)] + [("a nice day in the garden", 0)] * 300
    labelled = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k long, t string, y int")
    weight = toxicity.train(labelled).weight
    assert (weight[toxicity.Reader().buckets(phrases[-1])] > 0).mean() > 0.95
