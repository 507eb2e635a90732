"""Tables and the views over them that operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.sources import fixtures


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, page, text): a source is the document, each of its texts a page; with the literal pages."""
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), "text")
    return docs.unionByName(fixtures.pages(spark))


def lines_of(pages: DataFrame) -> DataFrame:
    """(source, page, line_no, line), line_no from 0, without empty lines."""
    return pages.select("source", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.trim("line") != "")


def geometry_of(lines: DataFrame) -> DataFrame:
    """Lines as a typesetter would place them on a page of 612 by 792 points: (…, x0, y0, x1, y1, size). Every third page
    has two columns, with its first line across both. All values are whole numbers of points."""
    rows = F.max("line_no").over(_page()) + 1
    half = F.floor((rows + 1) / 2)
    two = (F.pmod("page", F.lit(3)) == 0) & (rows >= 8)
    wide = two & (F.col("line_no") == 0)
    right = two & ~wide & (F.col("line_no") >= half)
    row = F.when(right, F.col("line_no") - half + 1).otherwise(F.col("line_no"))
    size = F.when(F.col("line_no") == 0, 16).otherwise(10)
    x0 = F.when(right, 330).otherwise(72)
    room = F.when(wide, 468).when(two, 200).otherwise(468)
    width = F.when(wide, 468).otherwise(F.least(6 * F.length("line"), room))
    y0 = 60 + 14 * row
    box = {"x0": x0, "y0": y0, "x1": x0 + width, "y1": y0 + size, "size": size}
    return lines.withColumns({k: v.cast("int") for k, v in box.items()})


def _page():
    from pyspark.sql import Window

    return Window.partitionBy("source", "page")


#: The same in DuckDB's SQL.
PAGES_SQL = f"""{fixtures.pages_sql()},
v_pages AS (SELECT source, doc_id AS page, text FROM documents UNION ALL SELECT * FROM fixture_pages)"""
LINES_SQL = f"""{PAGES_SQL},
v_lines AS (SELECT * FROM (SELECT source, page, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS line_no, unnest(string_split(text, chr(10))) AS line FROM v_pages) WHERE trim(line) <> '')"""
GEOMETRY_SQL = f"""{LINES_SQL},
v_sized AS (SELECT *, max(line_no) OVER (PARTITION BY source, page) + 1 AS n FROM v_lines),
v_split AS (SELECT *, ((page % 3) + 3) % 3 = 0 AND n >= 8 AS two, (n + 1) // 2 AS half FROM v_sized),
v_geom AS (SELECT source, page, line_no, line,
    CASE WHEN two AND line_no > 0 AND line_no >= half THEN 330 ELSE 72 END AS x0,
    (60 + 14 * CASE WHEN two AND line_no > 0 AND line_no >= half THEN line_no - half + 1 ELSE line_no END)::INT AS y0,
    (CASE WHEN two AND line_no > 0 AND line_no >= half THEN 330 ELSE 72 END + CASE WHEN two AND line_no = 0 THEN 468 ELSE least(6 * length(line), CASE WHEN two THEN 200 ELSE 468 END) END)::INT AS x1,
    (60 + 14 * CASE WHEN two AND line_no > 0 AND line_no >= half THEN line_no - half + 1 ELSE line_no END + CASE WHEN line_no = 0 THEN 16 ELSE 10 END)::INT AS y1,
    CASE WHEN line_no = 0 THEN 16 ELSE 10 END AS size FROM v_split)"""
