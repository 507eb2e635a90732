"""Visual objects: what an image or drawing shows, and diagrams of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import geometry as G

CLASSES = ("graph-flowchart", "chart", "diagram", "ordinary-image", "equation-image", "logo", "decoration", "separator", "background", "unresolved-visual")


def classify(rows: DataFrame) -> DataFrame:
    """rows (id, class_hint, source_kind, hints, n_images, vector_nodes, vector_edges, rules, nodes, edges, ambiguous, width, height,
    has_source, chart_structure) -> adds class, classification, structure and disposition. Vectors come before pixels; what
    stays uncertain is kept as its source."""
    c = F.col
    hints = F.lower(F.coalesce(c("hints"), F.lit("")))
    said = lambda words: hints.rlike(rf"\b(?:{words})\b")
    explicit = F.when(c("class_hint").isin(*CLASSES), c("class_hint"))
    graph = (c("nodes") >= 2) & (c("edges") >= 1) & ~c("ambiguous")
    thin = (c("rules") > 0) & ((c("width") > c("height") * 8) | (c("height") < 4))
    chart, logo, equation, plain = said("chart|plot|histogram|bar chart|line chart|scatter plot"), said("logo"), said("equation|formula|math|mathematical"), said("decoration|separator|background")
    kind = F.coalesce(
        explicit,
        F.when(c("source_kind") == "source-page", "background")
        .when(said("separator"), "separator")
        .when(said("background"), "background")
        .when(said("decoration"), "decoration")
        .when(logo, "logo")
        .when(equation & (c("n_images") > 0), "equation-image")
        .when(chart, "chart")
        .when(said("diagram|flowchart|schematic|workflow") & (c("n_images") > 0), "diagram")
        .when(graph, "graph-flowchart")
        .when(c("vector_nodes") >= 2, "diagram")
        .when(c("n_images") > 0, "ordinary-image")
        .when(thin, "separator")
        .otherwise("unresolved-visual"),
    )
    rows = rows.withColumn("class", kind)
    k = c("class")
    sure = plain | (c("source_kind") == "source-page")
    quiet = k.isin("decoration", "separator", "background")
    image = k.isin("ordinary-image", "equation-image", "logo")
    structure = (
        F.when(k == "graph-flowchart", F.when(graph | ((c("vector_nodes") >= 2) & (c("vector_edges") >= 1)), 0.88).otherwise(0.42))
        .when(k == "chart", F.coalesce(c("chart_structure"), F.lit(0.25)))
        .when(image, 0.92)
        .when(quiet, F.when(sure, 0.93).otherwise(0.65))
        .when(k == "diagram", F.when(c("vector_nodes") >= 2, 0.56).otherwise(0.3))
        .otherwise(0.2)
    )
    known = explicit.isNotNull()
    classification = (
        F.when(k == "graph-flowchart", F.when(graph, 0.91).otherwise(0.7))
        .when(k == "chart", F.when(chart | (c("class_hint") == "chart"), 0.9).otherwise(0.72))
        .when(image, F.when(known | logo | equation, 0.9).otherwise(0.78))
        .when(quiet, F.when(sure, 0.94).otherwise(0.58))
        .otherwise(F.when(known, 0.95).otherwise(0.46))
    )
    rows = rows.withColumns({"structure": structure, "classification": classification})
    least = F.least("classification", "structure")
    disposition = F.when(quiet & (least >= 0.9), "omitted-decoration").when(k.isin("graph-flowchart", "chart") & (least >= 0.86) & c("has_source"), "reconstructed-with-source").otherwise("preserved-source")
    return rows.withColumn("disposition", disposition)


def connector_ends(connectors: DataFrame, nodes: DataFrame, key: str, reach: float = 24.0) -> DataFrame:
    """connectors (key, connector, x0, y0, x1, y1), nodes (key, node, box) -> (key, connector, source, target): the nearest node to
    each end within reach, the smallest of equally near ones; both must exist and differ. An end without finite coordinates has none.

    Ends at one point are placed once, and of nodes with one box only the smallest can win. Points and boxes meet in cells: a
    box, grown by reach, lies in at most four cells of the power of two above its size, so that a point meets only the boxes around it."""
    c = F.col
    ends = connectors.select(key, "connector", F.inline(F.array(*(F.struct(F.lit(e).alias("end"), c(f"x{e}").cast("double").alias("x"), c(f"y{e}").cast("double").alias("y")) for e in (0, 1)))))
    ends = ends.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    b = c("box")
    slack = (F.greatest(*(F.abs(b[k]) for k in ("x0", "y0", "x1", "y1"))) + reach) * 1e-9 + reach  # more than rounding may add
    boxes = nodes.where("box is not null").groupBy(key, "box").agg(F.min("node").alias("node"))
    once = lambda **cols: F.inline(F.array(F.struct(*(v.alias(k) for k, v in cols.items()))))  # noqa: E731  computed once, not in every use
    boxes = boxes.select("*", once(left=b["x0"] - slack, right=b["x1"] + slack, top=b["y0"] - slack, bottom=b["y1"] + slack)).where("left <= right and top <= bottom")
    boxes = boxes.select("*", once(level=F.ceil(F.log2(F.greatest(c("right") - c("left"), c("bottom") - c("top"), F.lit(1.0))))))
    cell = lambda v: F.floor(v / F.pow(F.lit(2.0), c("level")))
    across = lambda low, high: F.explode(F.sequence(cell(c(low)), cell(c(high))))
    levels = boxes.agg(F.collect_set("level").alias("levels"))  # one row; a double has at most 2,100 powers of two
    points = ends.select(key, "x", "y").distinct().join(F.broadcast(levels)).withColumn("level", F.explode("levels"))
    points = points.select(key, "x", "y", "level", cell(c("x")).alias("cx"), cell(c("y")).alias("cy"))
    boxes = boxes.withColumn("cx", across("left", "right")).withColumn("cy", across("top", "bottom")).select(key, "node", "box", "level", "cx", "cy")
    near = points.join(boxes, [key, "level", "cx", "cy"]).withColumn("d", G.point_distance(c("x"), c("y"), b)).where(c("d") <= reach)
    place = near.groupBy(key, "x", "y").agg(F.min(F.struct("d", "node")).alias("m"))
    best = ends.join(place, [key, "x", "y"]).groupBy(key, "connector", "end").agg(F.min("m").alias("m"))
    both = best.groupBy(key, "connector").agg(F.max(F.when(c("end") == 0, c("m.node"))).alias("source"), F.max(F.when(c("end") == 1, c("m.node"))).alias("target"))
    return both.where("source is not null and target is not null and source <> target")


def compare_topology(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Edges (key, source, target) of two readings -> (key, common, only_left, only_right, contradiction, contradicts)."""
    a = left.select(key, "source", "target").distinct().withColumn("l", F.lit(1))
    b = right.select(key, "source", "target").distinct().withColumn("r", F.lit(1))
    both = a.join(b, [key, "source", "target"], "full").fillna(0, ["l", "r"])
    out = both.groupBy(key).agg(F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("common"), F.count_if(F.col("r") == 0).alias("only_left"), F.count_if(F.col("l") == 0).alias("only_right"))
    share = (F.col("only_left") + F.col("only_right")) / F.greatest(F.lit(1), F.col("common") + F.col("only_left") + F.col("only_right"))
    return out.withColumn("contradiction", F.round(share, 6)).withColumn("contradicts", F.col("contradiction") > 0.5)


def to_mermaid(nodes: DataFrame, edges: DataFrame, key: str, direction: str = "TD") -> DataFrame:
    """(key, mermaid): a flowchart in text, nodes then edges, in order of their ids."""
    label = F.regexp_replace(F.col("label"), r'["\[\]{}<>|`]', " ")
    n = nodes.select(key, F.lit(0).alias("part"), F.col("node").cast("string").alias("a"), F.lit("").alias("b"), F.concat(F.lit("  n"), "node", F.lit('["'), label, F.lit('"]')).alias("line"))
    e = edges.select(key, F.lit(1).alias("part"), F.col("source").cast("string").alias("a"), F.col("target").cast("string").alias("b"), F.concat(F.lit("  n"), "source", F.lit(" --> n"), "target").alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "a", "b", "line"))), lambda x: x["line"]), "\n")
    return n.unionByName(e).groupBy(key).agg(F.concat(F.lit(f"flowchart {direction}\n"), body).alias("mermaid"))


def to_plantuml(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, plantuml): a package diagram in text, nodes then edges, in order of their ids."""
    label = F.regexp_replace(F.col("label"), r'["\[\]{}<>|`]', " ")
    n = nodes.select(key, F.lit(0).alias("part"), F.col("node").cast("string").alias("a"), F.lit("").alias("b"), F.concat(F.lit('package "'), label, F.lit('" as n'), "node").alias("line"))
    e = edges.select(key, F.lit(1).alias("part"), F.col("source").cast("string").alias("a"), F.col("target").cast("string").alias("b"), F.concat(F.lit("n"), "source", F.lit(" ..> n"), "target").alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "a", "b", "line"))), lambda x: x["line"]), "\n")
    return n.unionByName(e).groupBy(key).agg(F.concat(F.lit("@startuml\n"), body, F.lit("\n@enduml")).alias("plantuml"))


def output_format(plantuml: Column, mermaid: Column) -> Column:
    """Which text form of a diagram is written: plantuml, mermaid or its source."""
    return F.when(plantuml, "plantuml").when(mermaid, "mermaid").otherwise("source")


def dedupe_by_overlap(rows: DataFrame, key: list[str], order: str = "no", least: float = 0.97) -> DataFrame:
    """Rows whose box no earlier row of the key overlaps by that much. With chains this keeps fewer than a greedy pass
    would; see greedy_dedupe for that."""
    a, b = rows.alias("a"), rows.alias("b")
    same = F.col(f"b.{order}") < F.col(f"a.{order}")
    for k in key:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, same & (G.overlap_ratio(F.col("a.box"), F.col("b.box")) >= least), "left_anti")


def ranked(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key: a report, not a limit on the work."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def evaluate_edges(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Edges (key, source, target) as wanted and as found -> (key, right, missing, extra, reversed, passed). An edge found the other
    way round is both missing and extra, and counted as reversed."""
    e = expected.select(key, "source", "target").distinct().withColumn("e", F.lit(1))
    a = actual.select(key, "source", "target").distinct().withColumn("a", F.lit(1))
    turned = a.select(key, F.col("target").alias("source"), F.col("source").alias("target"), F.lit(1).alias("t"))
    both = e.join(a, [key, "source", "target"], "full").join(turned, [key, "source", "target"], "left")
    out = both.groupBy(key).agg(
        F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("right"),
        F.count_if(F.col("a").isNull()).alias("missing"),
        F.count_if(F.col("e").isNull()).alias("extra"),
        F.count_if(F.col("e").isNotNull() & F.col("a").isNull() & F.col("t").isNotNull()).alias("reversed"),
    )
    return out.withColumn("passed", (F.col("missing") == 0) & (F.col("extra") == 0))
