"""Page layout: columns, reading order, block classes, and runs of lines. Boxes are columns x0, y0, x1, y1 of a page of
WIDTH by HEIGHT points; rows are keyed by source, page and line_no."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import patterns as P
from stemma.functions import text as T

WIDTH, HEIGHT = 612, 792
WIDE = WIDTH * 0.72
PAGE = ("source", "page")


def upper_median(values: Column) -> Column:
    """The middle value of an array, the upper one of two."""
    ordered = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def page_stats(placed: DataFrame) -> DataFrame:
    """(page, body, line_height): upper medians of a page's sizes and heights."""
    return placed.groupBy(*PAGE).agg(upper_median(F.collect_list("size")).alias("body"), upper_median(F.collect_list(F.col("y1") - F.col("y0"))).alias("line_height"))


def detect_columns(placed: DataFrame) -> DataFrame:
    """One row for each page: n_columns, split_at, gutter, confidence and reason. Two columns need a wide gap between starts of
    narrow blocks, enough blocks on each side, and hardly any overlap at the gap."""
    narrow = F.col("x1") - F.col("x0") < WIDE
    real = placed.where("x1 > x0")
    per = real.groupBy(*PAGE).agg(F.count_if(narrow).alias("n"), upper_median(F.collect_list("size")).alias("body"))
    starts = real.where(narrow).select(*PAGE, F.round("x0", 1).alias("x")).distinct()
    gap = F.lead("x").over(Window.partitionBy(*PAGE).orderBy("x")) - F.col("x")
    gaps = starts.withColumn("gap", gap).groupBy(*PAGE).agg(F.max(F.struct("gap", (-F.col("x")).alias("at"))).alias("g"))
    cut = gaps.select(*PAGE, F.col("g.gap").alias("gap"), (-F.col("g.at") + F.col("g.gap") / 2).alias("split_at"))
    sides = real.where(narrow).join(cut, list(PAGE))
    left = F.col("x0") < F.col("split_at")
    sides = sides.groupBy(*PAGE).agg(F.count_if(left).alias("n_left"), F.count_if(~left).alias("n_right"), F.max(F.when(left, F.col("x1"))).alias("left_end"), F.min(F.when(~left, F.col("x0"))).alias("right_start"))
    rows = placed.select(*PAGE).distinct().join(per, list(PAGE), "left").join(cut, list(PAGE), "left").join(sides, list(PAGE), "left")
    members = F.greatest(F.lit(2), F.floor(F.col("n") * 0.18))
    reason = (
        F.when(F.coalesce("n", F.lit(0)) < 4, "insufficient-column-evidence")
        .when(F.col("gap").isNull() | (F.col("gap") < F.greatest(F.col("body") * 3.5, F.lit(WIDTH * 0.055))), "single-column")
        .when((F.col("n_left") < members) | (F.col("n_right") < members), "ambiguous-column-split")
        .when(F.col("left_end") - F.col("right_start") > WIDTH * 0.025, "overlapping-column-evidence")
        .otherwise("stable-column-gutter")
    )
    out = rows.withColumn("reason", reason)
    stable = F.col("reason") == "stable-column-gutter"
    sure = F.when(stable, F.round(F.least(F.lit(1.0), 0.62 + F.least(F.lit(0.28), F.col("gap") / WIDTH)), 6))
    for name, value in (("insufficient-column-evidence", 0.35), ("single-column", 0.82), ("ambiguous-column-split", 0.55), ("overlapping-column-evidence", 0.48)):
        sure = sure.when(F.col("reason") == name, value)
    return out.select(*PAGE, F.when(stable, 2).otherwise(1).alias("n_columns"), F.when(stable, F.col("split_at")).alias("split_at"), F.when(stable, F.col("gap")).alias("gutter"), sure.alias("confidence"), "reason")


def reading_order(placed: DataFrame, columns: DataFrame) -> DataFrame:
    """Adds order_no from 0 and column_no. On pages of two columns blocks across the page are anchors; between two of them a
    column is read to its end before the next. Blocks that begin beside an anchor come last."""
    rows = placed.join(columns.select(*PAGE, "n_columns", "split_at", F.col("confidence").alias("column_confidence"), "reason"), list(PAGE))
    two = F.col("n_columns") == 2
    anchor = two & (F.col("x1") - F.col("x0") >= WIDE)
    rows = rows.withColumn("anchor", anchor).withColumn("column_no", F.when(two & ((F.col("x0") + F.col("x1")) / 2 > F.col("split_at")), 1).otherwise(0))
    page = Window.partitionBy(*PAGE)
    above = page.orderBy("y0").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(
        {
            "before": F.count_if("anchor").over(above),
            "last_end": F.max(F.when(F.col("anchor"), F.struct("y0", "x0", "y1"))).over(above)["y1"],
            "anchors": F.count_if("anchor").over(page),
            "nth": F.sum(F.col("anchor").cast("int")).over(page.orderBy("y0", "x0", "line_no")),
        }
    )
    beside = (F.col("before") == F.col("anchors")) | (F.col("before") > 0) & (F.col("y0") < F.col("last_end"))
    section = F.when(~two, 0).when(F.col("anchor"), F.col("nth") - 1).when(beside, F.col("anchors")).otherwise(F.col("before"))
    order = page.orderBy(section, F.col("anchor"), F.when(two, F.col("column_no")).otherwise(0), "y0", "x0", "line_no")
    return rows.withColumn("order_no", F.row_number().over(order) - 1).drop("before", "last_end", "anchors", "nth", "anchor")


def classify(ordered: DataFrame, font: Column | None = None) -> DataFrame:
    """Type, heading and list level, confidence and disposition of each block, from its text and its place among its
    neighbours in reading order."""
    rows = ordered.join(page_stats(ordered), list(PAGE)).withColumns({"t": F.trim("line"), "font": F.lit("") if font is None else font})
    order = Window.partitionBy(*PAGE).orderBy("order_no")
    above = F.col("y0") - F.coalesce(F.lag("y1").over(order), F.lit(0))
    below = F.coalesce(F.lead("y0").over(order), F.lit(HEIGHT)) - F.col("y1")
    relative = F.col("size") / F.greatest(F.lit(1), F.col("body"))
    t = F.col("t")
    number = F.regexp_extract(t, P.NUMBERING, 1)
    parts = (
        (t.rlike(P.NUMBERING), 0.35),
        (F.col("font").rlike("(?i)bold|semibold|black|title|heading"), 0.2),
        (relative >= 1.12, 0.16),
        ((above > F.col("line_height") * 1.35) | (below > F.col("line_height") * 1.1), 0.14),
        ((F.length(t) <= 180) & ~t.rlike("[.!?]$"), 0.1),
        (F.abs((F.col("x0") + F.col("x1")) / 2 - WIDTH / 2) < WIDTH * 0.08, 0.05),
    )
    score = F.lit(0.0)
    for cue, weight in parts:
        score = score + F.when(cue, weight).otherwise(0.0)
    rows = rows.withColumns({"score": F.round(score, 2), "number": number, "relative": relative})
    listed = t.rlike(P.LIST_MARKER)
    kind = (
        F.when(F.col("score") >= 0.48, "heading")
        .when(listed, "list-item")
        .when(t.rlike(P.CAPTION_MARKER), "caption")
        .when(t.rlike(P.FOOTNOTE_MARKER) & (F.col("y0") > HEIGHT * 0.72) & (F.col("size") < F.col("body") * 0.9), "footnote")
        .when(t.rlike(r"^>\s+"), "quote")
        .when(t.rlike(P.MATH_SIGN) & (F.length(t) < 160), "equation")
        .otherwise("paragraph")
    )
    depth = F.size(F.filter(F.split(F.regexp_replace(F.col("number"), "[.)]$", ""), r"\."), lambda x: x != ""))
    level = F.when(F.col("number") != "", depth).when(F.col("relative") >= 1.55, 1).when(F.col("relative") >= 1.3, 2).otherwise(3)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    first = F.first(F.when(listed, F.col("x0")), ignorenulls=True).over(before)
    indent = F.floor((F.col("x0") - first) / F.greatest(F.lit(1.0), F.col("body") * 2.2) + 0.5)
    own = F.col("score")
    for name, value in (("list-item", 0.86), ("caption", 0.84), ("footnote", 0.74), ("quote", 0.82), ("equation", 0.56), ("paragraph", 0.58)):
        own = F.when(F.col("type") == name, value).otherwise(own)
    doubtful = F.col("reason").isin("ambiguous-column-split", "overlapping-column-evidence")
    sure = F.when(doubtful, F.least(own, F.col("column_confidence"))).otherwise(own)
    rows = rows.withColumn("type", kind).withColumns(
        {
            "heading_level": F.when(F.col("type") == "heading", F.greatest(F.lit(1), F.least(F.lit(6), level))).cast("int"),
            "list_level": F.when(F.col("type") == "list-item", F.greatest(F.lit(0), F.coalesce(indent, F.lit(0)))).cast("int"),
            "confidence": sure,
        }
    )
    disposition = F.when(F.col("confidence") < 0.6, "needs-review").otherwise("reconstructed")
    return rows.select(*PAGE, "line_no", "order_no", "column_no", "type", "heading_level", "list_level", "score", "confidence", disposition.alias("disposition"))


def gap_clusters(values: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """(keys, cluster_no, n, low, high, total): sorted values fall into clusters wherever the gap to the one before is over
    the tolerance."""
    order = Window.partitionBy(*keys).orderBy(value)
    new = F.when(F.col(value) - F.lag(value).over(order) > tolerance, 1).otherwise(0)
    marked = values.where(F.col(value).isNotNull()).withColumn("new", new).withColumn("cluster_no", F.sum("new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*keys, "cluster_no").agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.sum(value).alias("total"))


def islands(rows: DataFrame, keys: list[str], order: str, inside: Column, breaks: Column | None = None) -> DataFrame:
    """Adds island: a number for each maximal run of consecutive rows for which inside holds and no break begins; null
    outside."""
    by = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("_in", F.coalesce(inside, F.lit(False)))
    starts = ~F.coalesce(F.lag("_in").over(by), F.lit(False))
    if breaks is not None:
        starts = starts | F.coalesce(breaks, F.lit(False))
    rows = rows.withColumn("_new", F.when(F.col("_in") & starts, 1).otherwise(0))
    return rows.withColumn("island", F.when(F.col("_in"), F.sum("_new").over(by))).drop("_in", "_new")


def code_runs(placed: DataFrame, body: int = 10) -> DataFrame:
    """(page, first, last, n, text): runs of two or more code-like lines, at least two of them plainly code."""
    by = Window.partitionBy(*PAGE).orderBy("line_no")
    far = F.col("y0") - F.lag("y0").over(by) > max(22, body * 3.1)
    rows = islands(placed.withColumn("signal", T.code_signal(F.col("line"))), list(PAGE), "line_no", F.col("signal") > 0, far).where("island is not null")
    runs = rows.groupBy(*PAGE, "island").agg(
        F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.count("*").alias("n"), F.count_if(F.col("signal") >= 2).alias("anchors"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.trim(x["line"])), "\n").alias("text"),
    )
    return runs.where("n >= 2 and anchors >= 2").select(*PAGE, "first", "last", "n", "text")


def table_runs(cells: DataFrame) -> DataFrame:
    """cells (page, line_no, n_cells) -> (page, first, last, columns): three or more lines with two cells or more, most of
    them with the median number."""
    rows = islands(cells, list(PAGE), "line_no", F.col("n_cells") >= 2).where("island is not null")
    runs = rows.groupBy(*PAGE, "island").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.collect_list("n_cells").alias("counts"))
    runs = runs.withColumn("columns", upper_median(F.col("counts")))
    same = F.size(F.filter("counts", lambda c: c == F.col("columns"))) / F.size("counts")
    return runs.where((F.size("counts") >= 3) & F.col("columns").between(2, 8) & (same >= 0.75)).select(*PAGE, "first", "last", "columns")


def word_cells(words: DataFrame, keys: list[str]) -> DataFrame:
    """words (keys, word_no, text, x0, x1, y0, y1, confidence) -> one row for each cell of a line: words are one cell while
    the gaps between them are small for the line's height."""
    good = words.where("confidence >= 58 and text <> '' and x1 > x0 and y1 > y0")
    line, by = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("x0", "word_no")
    height = upper_median(F.collect_list(F.col("y1") - F.col("y0")).over(line))
    new = F.when(F.col("x0") - F.lag("x1").over(by) > F.greatest(F.lit(10.0), height * 1.15), 1).otherwise(0)
    rows = good.withColumn("_new", new).withColumn("cell_no", F.sum("_new").over(by))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_no", "text"))), lambda w: w["text"]), " ")
    return rows.groupBy(*keys, "cell_no").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("confidence").alias("confidence"))
