"""Trees kept as rows with a parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def descendants(children: DataFrame, roots: DataFrame, node: str, parent: str, most_depth: int = 64) -> DataFrame:
    """(root, node, depth) for every root and all below it, itself at depth 0. A level at a time: a join on the parent; ends
    with the first empty level. A tree deeper than most_depth, or a cycle, is an error."""
    level = roots.select(F.col(node).alias("root"), F.col(node), F.lit(0).alias("depth"))
    down = children.select(F.col(node).alias("_child"), F.col(parent).alias("_parent"))
    out = level
    for depth in range(1, most_depth + 1):
        level = level.join(down, level[node] == down["_parent"]).select("root", F.col("_child").alias(node), F.lit(depth).alias("depth"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise RuntimeError(f"deeper than {most_depth} levels, or a cycle")
