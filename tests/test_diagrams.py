"""Connectors meet nodes by place: the results of all pairs, without all pairs."""

import math
import random

from pyspark.sql import functions as F

from stemma.functions import geometry as G
from stemma.operators import visuals

CONNECTORS = "diagram int, connector long, x0 double, y0 double, x1 double, y1 double"


def _nodes(spark, rows):
    nodes = spark.createDataFrame(rows, "diagram int, node long, x0 double, y0 double, x1 double, y1 double")
    return nodes.select("diagram", "node", G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("box"))


def _rows_out(plan) -> list[int]:
    """The rows that each operator of a plan that ran gave."""
    name = plan.getClass().getSimpleName()
    own = plan.metrics().get("numOutputRows")
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    if name == "AdaptiveSparkPlanExec":
        below = [plan.executedPlan()]
    elif name.endswith("QueryStageExec"):
        below = [plan.plan()]
    return ([own.get().value()] if own.isDefined() else []) + [n for p in below for n in _rows_out(p)]


def _nearest(nodes, diagram, x, y, reach=24.0):
    found = []
    for d, node, x0, y0, x1, y1 in nodes:
        if d == diagram and None not in (x0, y0, x1, y1):
            dx, dy = max(x0 - x, 0.0, x - x1), max(y0 - y, 0.0, y - y1)
            found.append((math.sqrt(dx * dx + dy * dy), node))
    best = min((f for f in found if f[0] <= reach), default=None)
    return best[1] if best else None


def test_connector_ends_equal_all_pairs(spark):
    rng = random.Random(7)
    nodes = []
    for i in range(240):
        x, y, side = rng.randint(-300, 300), rng.randint(-300, 300), rng.choice([0, 1, 5, 40, 300, 5000])
        nodes.append((i % 3, i, float(x), float(y), float(x + side), float(y + rng.randint(0, side + 1))))
    nodes += [(0, 1000 + i, *nodes[0][2:]) for i in range(5)] + [(1, 2000, None, 0.0, 1.0, 1.0), (1, 2001, 50.0, 50.0, 40.0, 60.0), (2, 2002, 1e12, 1e12, 1e12 + 1, 1e12 + 1)]
    connectors = [(i % 4, i, *(float(rng.randint(-340, 340)) for _ in range(4))) for i in range(400)]
    connectors += [(0, 900, nodes[0][2] - 24.0, nodes[0][3], 1e9, 0.0), (2, 901, 1e12 - 24, 1e12, 0.0, 0.0), (2, 902, float("nan"), 0.0, 0.0, 0.0), (2, 903, float("inf"), 0.0, 0.0, 0.0)]
    want = set()
    for d, c, x0, y0, x1, y1 in connectors:
        a, b = (_nearest(nodes, d, *p) if all(map(math.isfinite, p)) else None for p in ((x0, y0), (x1, y1)))
        if a is not None and b is not None and a != b:
            want.add((d, c, a, b))
    got = visuals.connector_ends(spark.createDataFrame(connectors, CONNECTORS), _nodes(spark, nodes), "diagram").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50


def test_connectors_do_not_meet_every_node(spark):
    n = 2000
    spread = [(0, i, 100.0 * i, 0.0, 100.0 * i + 40, 30.0) for i in range(n)]
    piled = [(1, i, 100.0 * (i % 4), 0.0, 100.0 * (i % 4) + 40, 30.0) for i in range(n)]
    ends = [(d, i, 100.0 * (i % (n if d == 0 else 4)), -5.0, 100.0 * ((i + 1) % (n if d == 0 else 4)), -5.0) for d in (0, 1) for i in range(n)]
    out = visuals.connector_ends(spark.createDataFrame(ends, CONNECTORS), _nodes(spark, spread + piled), "diagram")
    assert len(out.collect()) == 2 * n
    assert max(_rows_out(out._jdf.queryExecution().executedPlan())) <= 50 * n
