"""Operators on the lines of Markdown documents, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import patterns as P


def ordered_text(order: list[str], line: str = "line", separator: str = "\n") -> Column:
    """Aggregate: a group's lines as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line))), lambda x: x[line]), separator)


def in_fence(by: Window, line: str = "line") -> Column:
    """Whether a line stands inside a code fence or is one of its ends."""
    fence = F.col(line).rlike(P.FENCE_LINE)
    before = F.coalesce(F.sum(F.when(fence, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return fence | (before % 2 == 1)


def repair_hyphens(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, text): words broken by a hyphen at the end of a line are joined with the next line, over as many
    lines as need be. Fences, page markers and structural lines stay."""
    by = Window.partitionBy(*keys).orderBy("line_no")
    line, nxt = F.col("line"), F.col("next")
    free = ~F.col("fenced") & ~line.rlike(P.PAGE_MARKER) & ~F.trim(line).rlike(P.STRUCTURAL_LINE)
    goes_on = nxt.rlike(P.WRAP_START) & ~nxt.rlike(P.PAGE_MARKER) & ~F.trim(nxt).rlike(P.STRUCTURAL_LINE)
    rows = lines.withColumns({"fenced": in_fence(by), "next": F.lead("line").over(by)}).withColumn("open", F.coalesce(free, F.lit(False)))
    # What goes on is no structural line, so only the first line of a run can be one that must stay alone.
    rows = rows.withColumn("joins", F.coalesce(F.col("open") & line.rlike(P.WRAP_END) & goes_on, F.lit(False)))
    rows = rows.withColumn("joined", F.coalesce(F.lag("joins").over(by), F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.when(~F.col("joined"), 1).otherwise(0)).over(by))
    rows = rows.withColumn("part", F.when(F.col("joined"), F.ltrim("line")).otherwise(F.col("line")))
    rows = rows.withColumn("part", F.when(F.col("joins"), F.regexp_replace("part", r"-\s*$", "")).otherwise(F.col("part")))
    whole = rows.groupBy(*keys, "run").agg(F.min("line_no").alias("first"), ordered_text(["line_no"], "part", "").alias("text"))
    return whole.select(*keys, "first", "text")


def page_joins(pages: DataFrame) -> DataFrame:
    """(source, page, next_page, action): whether the last line of a page and the first of the next are one paragraph;
    join, join without the hyphen, or none."""
    line = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = pages.select("source", "page", F.trim(F.element_at(line, 1)).alias("head"), F.trim(F.element_at(line, -1)).alias("tail"))
    by = Window.partitionBy("source").orderBy("page")
    rows = rows.withColumns({"next_page": F.lead("page").over(by), "b": F.lead("head").over(by)}).where("next_page is not null")
    a, b = F.col("tail"), F.col("b")
    apart = a.isNull() | b.isNull() | a.rlike(P.STRUCTURAL_LINE) | b.rlike(P.STRUCTURAL_LINE) | (F.length(a) < 35) | a.rlike("[.!?:;]$") | ~b.rlike(r"^\p{Ll}")
    action = F.when(apart, "none").when(a.rlike("-$") & b.rlike("^[a-z]"), "join-hyphen").otherwise("join")
    return rows.select("source", "page", "next_page", action.alias("action"))


def block_tokens(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block_no, kind, first, last): lines as blocks. Fences and display math run to their end; table rows and
    paragraph lines run together; every other line is a block."""
    by = Window.partitionBy(*keys).orderBy("line_no")
    prior = by.rowsBetween(Window.unboundedPreceding, -1)
    t = F.trim("line")
    fence, math = F.col("line").rlike(P.FENCE_LINE), t == "$$"
    rows = lines.withColumns({"f": F.coalesce(F.sum(F.when(fence, 1).otherwise(0)).over(prior), F.lit(0)), "is_fence": fence})
    code = F.col("is_fence") | (F.col("f") % 2 == 1)
    rows = rows.withColumns({"code": code, "is_math": math & ~code})
    rows = rows.withColumn("m", F.coalesce(F.sum(F.when(F.col("is_math"), 1).otherwise(0)).over(prior), F.lit(0)))
    kind = (
        F.when(F.col("code"), "fence")
        .when(F.col("is_math") | (F.col("m") % 2 == 1), "math")
        .when(F.col("line").rlike(P.PAGE_MARKER), "page")
        .when(t.rlike("^<!--.*-->$"), "comment")
        .when(t.rlike(r"^#{1,6}\s"), "heading")
        .when(t.rlike(r"^[-*+]\s"), "bullet")
        .when(t.rlike(r"^\d+[.)]\s"), "number")
        .when(t.rlike(r"^\|.*\|$"), "table")
        .when(t.rlike(r"^\[(?:SOURCE_VISUAL|VISUAL_PLACEHOLDER)"), "visual")
        .otherwise("paragraph")
    )
    rows = rows.withColumn("kind", kind)
    opens = F.when(F.col("kind") == "fence", F.col("is_fence") & (F.col("f") % 2 == 0)).when(F.col("kind") == "math", F.col("is_math") & (F.col("m") % 2 == 0))
    joined = F.col("kind").isin("table", "paragraph") & (F.lag("kind").over(by) == F.col("kind"))
    new = F.when(F.col("kind").isin("fence", "math"), opens).otherwise(~F.coalesce(joined, F.lit(False)))
    rows = rows.withColumn("block_no", F.sum(F.when(new, 1).otherwise(0)).over(by) - 1)
    return rows.groupBy(*keys, "block_no", "kind").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"))


def heading_hierarchy(pages: DataFrame, text: str = "text") -> DataFrame:
    """Adds outline: the text with headings in order. Empty ones and repeats of the one before go; a number in front sets
    the level; else a level is at most one deeper than the one before. A fold, since each level depends on the last."""
    heading = r"^\s*(#{1,6})\s+(.+?)\s*$"
    empty = F.array().cast("array<struct<i:int,line:string>>")
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    state = F.struct(F.lit(0).alias("level"), F.lit("").alias("key"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        line = x["line"]
        title = F.trim(F.regexp_replace(F.regexp_extract(line, heading, 2), r"\s+", " "))
        own = F.length(F.regexp_extract(line, heading, 1))
        number = F.regexp_extract(title, P.NUMBERED_TITLE, 1)
        deep = (acc["level"] > 0) & (own > acc["level"] + 1)
        level = F.when(title.rlike(P.NUMBERED_TITLE), F.least(F.lit(6), F.size(F.split(number, r"\.")))).when(title.rlike(P.CHAPTER), 1).when(deep, acc["level"] + 1).otherwise(own)
        key = F.lower(title)
        drop = (title == "") | (key == acc["key"])
        written = F.struct(x["i"].alias("i"), F.when(~drop, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), title)).alias("line"))
        return F.struct(F.when(drop, acc["level"]).otherwise(level).alias("level"), F.when(drop, acc["key"]).otherwise(key).alias("key"), F.concat(acc["out"], F.array(written)).alias("out"))

    # Only headings are folded; a page without one stays as it is.
    rows = pages.withColumn("_l", lines).withColumn("_h", F.filter("_l", lambda x: x["line"].rlike(heading)))
    rows = rows.withColumn("_n", F.aggregate("_h", state, step, lambda acc: F.map_from_entries(acc["out"])))
    new = F.transform("_l", lambda x: F.when(F.map_contains_key("_n", x["i"]), F.try_element_at("_n", x["i"])).otherwise(x["line"]))
    joined = F.array_join(F.filter(new, lambda x: x.isNotNull()), "\n")
    return rows.withColumn("outline", F.when(F.size("_h") == 0, F.col(text)).otherwise(joined)).drop("_l", "_h", "_n")
