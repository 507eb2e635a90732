import random

import pytest
from pyspark.sql import functions as F

from stemma.llm import _components
from stemma.llm._components import components, dealt


def _brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root if find(x) != x}


def _random():
    rng = random.Random(4)
    return [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(330)]


CASES = {
    "low star": [(i, 0) for i in range(1, 400)],
    "high star": [(1000, i) for i in range(400)],
    "two stars joined late": [(1000, i) for i in range(200)] + [(i, 1000) for i in range(2000, 2200)] + [(-5, 2100)],
    "path": [(i, i + 1) for i in range(300)],
    "random": _random(),
    "loops and repeats": [(1, 1), (2, 1), (1, 2), (2, 1), (3, 3)],
    "none": [],
}


@pytest.mark.parametrize("heavy", [None, 2, 5])
@pytest.mark.parametrize("case", CASES)
def test_equals_brute_force(spark, case, heavy):
    rows = spark.createDataFrame(CASES[case], "u long, v long")
    found = components(rows, heavy=heavy).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.root for r in found} == _brute(CASES[case])


@pytest.mark.parametrize("case", ["low star", "high star", "two stars joined late", "random"])
def test_no_task_gets_a_large_group_and_edges_stay_few(spark, case):
    edges = spark.createDataFrame(sorted({(max(e), min(e)) for e in CASES[case] if e[0] != e[1]}), "u long, v long")
    n = edges.count()
    sent = dealt(edges, 10).groupBy("g").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in sent) <= 2 * n + n  # each edge twice, and a row for each salt of ten
    assert max(r.n for r in sent) <= 40  # a salt's edges lie about the bound, and do not grow with the group


def test_written_edges_of_a_round(spark, monkeypatch):
    sizes = []
    keep = _components.materialise

    def counted(df, label):
        out = keep(df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(_components, "materialise", counted)
    components(spark.createDataFrame(CASES["two stars joined late"], "u long, v long"), heavy=5)
    assert max(sizes) <= 3 * sizes[0]
