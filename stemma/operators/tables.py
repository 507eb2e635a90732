"""Tables reconstructed from cells, and what they can be written as. Cells are rows (table_id, row, col, text, row_span, col_span,
observed_empty)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions import text as T


def diagnose(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """tables (table_id, structure) -> (table_id, columns, n_rows, missing, empty, confidence, disposition). A row that covers
    fewer columns than the table has, or a blank cell not seen to be empty, leaves the structure in doubt."""
    own = cells.groupBy("table_id", "row").agg(F.sum("col_span").alias("covered"), F.max(F.col("col") + F.col("col_span")).alias("wide"), F.count("*").alias("n"), F.count_if((F.trim("text") == "") & ~F.col("observed_empty")).alias("blank"))
    wide = own.groupBy("table_id").agg(F.max("wide").alias("columns"), F.count("*").alias("n_rows"))
    per = own.join(wide, "table_id").groupBy("table_id", "columns", "n_rows").agg(F.count_if(F.col("covered") < F.col("columns")).alias("missing"), F.sum("blank").alias("empty"))
    rows = tables.join(per, "table_id").withColumn("confidence", F.when((F.col("missing") > 0) | (F.col("empty") > 0), F.least("structure", F.lit(0.61))).otherwise(F.col("structure")))
    disposition = F.when(F.col("confidence") >= 0.82, "reconstructed").when(F.col("confidence") >= 0.62, "reconstructed-with-source").otherwise("preserved-source")
    return rows.select("table_id", "columns", "n_rows", "missing", "empty", "confidence", disposition.alias("disposition"))


def representable(cells: DataFrame, diagnosed: DataFrame) -> DataFrame:
    """(table_id, markdown boolean): two rows or more, each with exactly one plain cell for every column."""
    row = cells.groupBy("table_id", "row").agg(F.count("*").alias("n"), F.bool_and((F.col("row_span") == 1) & (F.col("col_span") == 1) & ((F.trim("text") != "") | F.col("observed_empty"))).alias("plain"))
    good = row.join(diagnosed.select("table_id", "columns"), "table_id").groupBy("table_id").agg(F.bool_and(F.col("plain") & (F.col("n") == F.col("columns"))).alias("grid"))
    return diagnosed.join(good, "table_id").select("table_id", ((F.col("columns") >= 1) & (F.col("n_rows") >= 2) & (F.col("confidence") >= 0.82) & F.col("grid")).alias("markdown"))


def _cells(value: Column, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", value.alias("v")))), lambda x: x["v"]), separator)


def _rows(separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), separator)


def to_markdown(cells: DataFrame) -> DataFrame:
    """(table_id, markdown)."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\\", r"\\\\"), r"\|", r"\\|"), r"\r?\n", "<br>")
    rows = cells.groupBy("table_id", "row").agg(_cells(text, " | ").alias("line"), F.count("*").alias("n"))
    rule = F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), F.col("n").cast("int")), " | "), F.lit(" |"))
    first = F.min("row").over(_table())
    rows = rows.withColumn("line", F.concat(F.lit("| "), "line", F.lit(" |"), F.when(F.col("row") == first, rule).otherwise("")))
    return rows.groupBy("table_id").agg(_rows("\n").alias("markdown"))


def to_html(cells: DataFrame) -> DataFrame:
    """(table_id, html)."""
    span = lambda name, c: F.when(F.col(c) > 1, F.concat(F.lit(f' {name}="'), c, F.lit('"'))).otherwise("")
    cell = F.concat(F.lit("<td"), span("rowspan", "row_span"), span("colspan", "col_span"), F.lit(">"), T.escape_html(F.col("text")), F.lit("</td>"))
    rows = cells.groupBy("table_id", "row").agg(_cells(cell, "").alias("line"))
    rows = rows.withColumn("line", F.concat(F.lit('<tr data-row-index="'), "row", F.lit('">'), "line", F.lit("</tr>")))
    return rows.groupBy("table_id").agg(F.concat(F.lit("<table><tbody>"), _rows(""), F.lit("</tbody></table>")).alias("html"))


def _table():
    from pyspark.sql import Window

    return Window.partitionBy("table_id")


def parse_markdown(rows: DataFrame, line: str = "line") -> DataFrame:
    """Adds cells array<string>: a table row without its outer bars; an escaped bar is text. Null for a separator row."""
    inner = F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))
    separator = F.col(line).rlike(r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?\s*$")
    return rows.withColumn("cells", F.when(~separator, cells))


def place_in_grid(items: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """items (keys, item, x0, y0, x1, y1), rules (keys, axis h or v, at) -> (keys, item, row, col, row_span, col_span): the cell
    between sorted rules that holds an item's middle, and how many cells it reaches over."""
    lists = rules.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col("axis") == "h", F.col("at")))).alias("hs"), F.array_sort(F.collect_set(F.when(F.col("axis") == "v", F.col("at")))).alias("vs"))
    rows = items.join(lists, keys)
    below = lambda name, v: F.size(F.filter(name, lambda r: r <= v)) - 1
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    rows = rows.withColumns({"row": below("hs", y), "col": below("vs", x)})
    inside = (F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < F.size("hs") - 1) & (F.col("col") < F.size("vs") - 1)
    spans = {
        "row_span": F.greatest(F.lit(1), F.size(F.filter("hs", lambda r: (r > F.col("y0")) & (r < F.col("y1")))) + 1),
        "col_span": F.greatest(F.lit(1), F.size(F.filter("vs", lambda r: (r > F.col("x0")) & (r < F.col("x1")))) + 1),
    }
    return rows.where(inside).withColumns(spans).select(*keys, "item", "row", "col", "row_span", "col_span")


def rule_axis(width: Column, height: Column, thin: float = 3.0) -> Column:
    """h or v for a thin box, by its longer side; else null."""
    return F.when((height <= thin) & (width > height), "h").when((width <= thin) & (height > width), "v")
