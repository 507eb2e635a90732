"""Connected components of an edge list.

Every edge joins a node to a lower one, its parent. In each round an edge goes to the task of its upper node and to the
task of its lower node; a task joins all edges it got and ties each of its nodes to the least node it is connected
to. So a node's several parents meet, and its children meet its parents. It has settled when a round changes
nothing: then each node has one parent, and that is the component's least node.

No task holds a large group, at any size: a node with more children or more parents than `share` of the mean of a shuffle
partition is heavy, and those edges are salted over as many tasks as that takes. Each salt of a heavy node's
children also gets the node's least parent; its other parents meet that one in the node's own tasks. There are at most
2 * share * partitions heavy nodes, whatever the table, so their list may be broadcast. A round writes each edge
at most twice, and one row for each salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm._common import materialise, release, ship

#: Heavy is what exceeds this part of the edges of a mean shuffle partition, but never fewer than LEAST_HEAVY edges: a
#: salt must merge several parents for a round to make way.
SHARE, LEAST_HEAVY = 8, 32


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node connected to it) of all nodes that are not the least themselves."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        if np.array_equal(high, low):
            break
        np.minimum.at(root, high, low)
        while not np.array_equal(jump := root[root], root):
            root = jump
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v, size = [], [], 0
    for batch in batches:
        u.append(batch.column("u").to_numpy())
        v.append(batch.column("v").to_numpy())
        size += batch.num_rows
        if size > 1 << 20:
            u, v = ([x] for x in least_reached(np.concatenate(u), np.concatenate(v)))
            size = 0
    if u:
        u, v = least_reached(np.concatenate(u), np.concatenate(v))
        for at in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(u[at : at + (1 << 16)]), pa.array(v[at : at + (1 << 16)])], ["u", "v"])


def dealt(edges: DataFrame, heavy: int) -> DataFrame:
    """(g, u, v): each of the distinct edges for the task of its upper and of its lower node, and the least parents of nodes that
    have more than `heavy` children or parents. Counts are summed before they are shuffled."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("v").alias("node"), F.lit(1).alias("child"), F.lit(None).cast("long").alias("parent")), F.struct(F.col("u").alias("node"), F.lit(0).alias("child"), F.col("v").alias("parent")))))
    counts = ends.groupBy("node").agg(F.sum("child").alias("children"), F.count("parent").alias("parents"), F.min("parent").alias("least"))
    salts = lambda n: F.when(F.col(n) > heavy, F.ceil(F.col(n) / heavy)).otherwise(0).cast("int")
    over = counts.where((F.col("children") > heavy) | (F.col("parents") > heavy)).select("node", "least", salts("children").alias("below"), salts("parents").alias("above"))
    below = F.broadcast(over.select(F.col("node").alias("v"), "below"))
    above = F.broadcast(over.select(F.col("node").alias("u"), "above"))
    salt = lambda node, n, by, sign: F.when(F.coalesce(F.col(n), F.lit(0)) > 0, F.xxhash64(node, F.lit(sign) * (F.pmod(F.xxhash64(by, F.lit(sign)), F.col(n)) + 1))).otherwise(F.xxhash64(node, F.lit(0).cast("long")))
    both = edges.join(below, "v", "left").join(above, "u", "left")
    to = F.array(salt("u", "above", "v", -1), salt("v", "below", "u", 1))
    sent = both.select(F.explode(to).alias("g"), "u", "v")
    places = F.when(F.col("below") > 0, F.sequence(F.lit(1), F.col("below"))).otherwise(F.array(F.lit(0)))
    known = over.where("least is not null").select("node", "least", F.explode(places).alias("s"))
    return sent.unionAll(known.select(F.xxhash64("node", F.col("s").cast("long")).alias("g"), F.col("node").alias("u"), F.col("least").alias("v")))


def components(edges: DataFrame, most_rounds: int = 60, heavy: int | None = None) -> DataFrame:
    """edges (u bigint, v bigint) -> (node, root): root is the least node of the node's component, and each node
    that is not a root comes once. Self loops, repeats and both directions are fine. What it returns was written down
    and can be released. heavy: the bound of dealt(), of at least 2."""
    spark = edges.sparkSession
    ship(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    for _ in range(most_rounds):
        bound = heavy or max(LEAST_HEAVY, seen[0] // (SHARE * tasks))
        after = dealt(now, bound).repartition(tasks, "g").select("u", "v").mapInArrow(_contract, "u long, v long").distinct()
        after = materialise(after, "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        release(now)
        now = after
        if mark == seen or not mark[0]:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._stemma_path = now._stemma_path
            return out
        seen = mark
    raise RuntimeError("components did not settle")
