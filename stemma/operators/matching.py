"""Matching of blocks, objects, labels and tokens. Every join has the page, document or pair as its equi key, so the theta
part is a residual on rows of one page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import geometry as G
from stemma.functions import patterns as P

PAGE = ["source", "page"]


def caption_targets(captions: DataFrame, objects: DataFrame, reach: int = 48) -> DataFrame:
    """captions (page, line_no, box), objects (page, object_no, kind, box) -> each caption's object: one that it overlaps
    across comes first, then the nearest above or below within reach; at most one."""
    pairs = captions.withColumnRenamed("box", "a").join(objects.withColumnRenamed("box", "b"), PAGE)
    across = G.horizontal_overlap(F.col("a"), F.col("b")) > 0
    pairs = pairs.withColumns({"distance": G.vertical_distance(F.col("a"), F.col("b")), "apart": F.when(across, 0).otherwise(1)})
    first = Window.partitionBy(*PAGE, "line_no").orderBy("apart", "distance", "object_no")
    return pairs.where(F.col("distance") <= reach).withColumn("r", F.row_number().over(first)).where("r = 1").select(*PAGE, "line_no", "object_no", "kind", "distance")


def best_caption(captions: DataFrame, objects: DataFrame, body: int = 10) -> DataFrame:
    """Each object's caption: the nearest that stands over or under it; one of a figure that stands above it counts
    as a little further away."""
    limit = max(30, body * 8)
    pairs = objects.withColumnRenamed("box", "b").join(captions.withColumnRenamed("box", "a"), PAGE)
    a, b = F.col("a"), F.col("b")
    distance = G.vertical_distance(a, b)
    score = distance + F.when(F.col("line").rlike("(?i)^(?:figure|fig\\.)") & (a["y1"] <= b["y0"]), body * 0.75).otherwise(0.0)
    near = pairs.withColumns({"distance": distance, "score": score}).where((F.col("distance") <= limit) & G.affine(a, b, body))
    return near.groupBy(*PAGE, "object_no").agg(F.min(F.struct("score", "line_no", "distance")).alias("m")).select(*PAGE, "object_no", F.col("m.line_no").alias("line_no"), F.col("m.score").alias("score"))


def touching(objects: DataFrame, regions: DataFrame) -> DataFrame:
    """(page, object_no, line_no): pairs of an object and a region that share area."""
    pairs = objects.withColumnRenamed("box", "b").join(regions.withColumnRenamed("box", "a"), PAGE)
    return pairs.where(G.intersects(F.col("a"), F.col("b"))).select(*PAGE, "object_no", "line_no")


def not_covered(objects: DataFrame, regions: DataFrame, least: float = 0.72) -> DataFrame:
    """Objects that no region of their page covers."""
    o, r = objects.alias("o"), regions.alias("r")
    same = (F.col("o.source") == F.col("r.source")) & (F.col("o.page") == F.col("r.page"))
    return o.join(r, same & G.covers(F.col("r.box"), F.col("o.box"), least), "left_anti")


def relations_within(relations: DataFrame, nodes: DataFrame, keys: list[str], source: str, target: str, node: str) -> DataFrame:
    """Relations whose two ends are both among the nodes."""
    ends = nodes.select(*keys, node)
    out = relations.join(ends.withColumnRenamed(node, source), [*keys, source], "left_semi")
    return out.join(ends.withColumnRenamed(node, target), [*keys, target], "left_semi")


def multiset_overlap(left: DataFrame, right: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, n_left, n_right, common): items count as often as they come; common is the size of the intersection."""
    a = left.groupBy(*keys, item).agg(F.count("*").alias("l"))
    b = right.groupBy(*keys, item).agg(F.count("*").alias("r"))
    both = a.join(b, [*keys, item], "full").fillna(0, ["l", "r"])
    return both.groupBy(*keys).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"), F.sum(F.least("l", "r")).alias("common"))


def f1(n_left: Column, n_right: Column, common: Column) -> Column:
    """1 if both are empty."""
    return F.when(common > 0, 2 * common / (n_left + n_right)).when(n_left + n_right == 0, 1.0).otherwise(0.0)


def is_caption(line: Column) -> Column:
    return line.rlike(P.CAPTION_MARKER)
