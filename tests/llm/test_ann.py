import numpy as np
import pytest

from stemma.llm import ann


def _brute(rows, every, k):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows]
    out = {}
    for i, q in good:
        if i % every == 0:
            scored = sorted((-float(np.sum(q * v)), j) for j, v in good if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def test_recall_against_brute_force(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = _brute(rows, 20, 20)
    got = {}
    for r in sorted(ann.nearest(spark.read.parquet(f"{folder}/embeddings.parquet")).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert set(got) == set(want)
    assert all(len(v) == 20 for v in got.values())
    vector = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - float(np.sum(vector[q] * vector[i]))) < 1e-9 for i, s in found)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    print("recall", recall)
    assert recall >= 0.95


def _tables():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 64))
    noise = rng.normal(size=(4000, 256))
    return {
        "clusters": centres[rng.integers(0, 40, 4000)] + 0.15 * rng.normal(size=(4000, 64)),
        "skewed lengths": rng.normal(size=(4000, 64)) * rng.lognormal(0, 1, 4000)[:, None],
        "256 components": noise / np.linalg.norm(noise, axis=1)[:, None],
        "large numbers": rng.normal(size=(2000, 16)) * 1e60,
    }


@pytest.mark.parametrize("name", list(_tables()))
def test_recall_of_a_shard(name):
    v = _tables()[name]
    order, layers = ann.build(ann.augmented(v)[0], 1)
    level, scale = ann.augmented(v)
    for layer in layers:  # every node can be reached on its level
        reached, edge = {0}, [0]
        while edge:
            edge = list(set(layer.links[edge].ravel().tolist()) - reached)
            reached |= set(edge)
        assert len(reached) > 0.99 * len(layer.nodes)
    asked = np.arange(0, len(v), 20)
    q = np.hstack([v[asked] / scale, np.zeros((len(asked), 1))]).astype(np.float32)
    found = order[ann.search(layers, q)]
    hits = 0
    for i, own in zip(asked, found, strict=True):
        score = v @ v[i]
        score[i] = -np.inf
        best = sorted((x for x in own if x != i), key=lambda x: -score[x])[:20]
        hits += len(set(best) & set(np.argsort(-score)[:20].tolist()))
    print(name, "recall", hits / 20 / len(asked))
    assert hits / 20 / len(asked) >= 0.95


def test_lengths_are_searched_apart_and_doubles_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8 if i % 3 else 5) * 1e200 ** (i % 2)).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.nearest(df, every=10).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 90, 10):
        own = [(j, float(np.sum(np.array(v) * np.array(rows[q][1])))) for j, v in rows if j != q and len(v) == len(rows[q][1])]
        assert {i for i, _ in got[q]} == {i for i, _ in sorted(own, key=lambda x: -x[1])[:20]}
        assert all(abs(s - dict(own)[i]) <= 1e-12 * abs(s) for i, s in got[q])


@pytest.mark.parametrize("shard_rows", [8192, 50])
def test_ties_copies_and_rows_that_take_no_part(spark, shard_rows):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 8)).astype(np.float32)
    rows = [(i, base[i % 12].tolist() if i % 3 else base[0].tolist()) for i in range(200)]
    bad = [(1000, None), (1020, [0.0] * 8), (1040, [1.0, None] * 4), (1060, [float("nan")] * 8), (1080, [float("inf")] + [1.0] * 7), (1100, [1.0]), (None, base[1].tolist())]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows + bad], "vec_id long, embedding array<float>, rank int, score double")
    got = {}
    for r in sorted(ann.nearest(df, shard_rows=shard_rows).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {q: [i for i, _ in found] for q, found in _brute(rows, 20, 20).items()}
    assert got == want


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df).collect()] == [(0, 1, 1, 5.0), (0, 2, 1, 5.0)]
    assert ann.nearest(df.where("vec_id = 1")).count() == 0
    assert ann.nearest(df.limit(0)).count() == 0
