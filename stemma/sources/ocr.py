"""Recognised words as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TSV = "level int, page int, block int, par int, line int, word int, left double, top double, width double, height double, conf double, text string"


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Word tables as recognisers write them: tab-separated, with a header, quotes being text."""
    return spark.read.schema(TSV).option("sep", "\t").option("header", True).option("quote", "").csv(path)


def lines_from_words(words: DataFrame, scale_x: float = 1.0, scale_y: float = 1.0) -> DataFrame:
    """(page, block, par, line, text, x0, y0, x1, y1, confidence): words of level 5 with a text and a confidence of 0 or more, joined in
    order; the box around them, scaled; the mean confidence from 0 to 1."""
    good = words.where("level = 5 and conf >= 0 and trim(text) <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", F.trim("text").alias("t")))), lambda w: w["t"]), " ")
    box = {"x0": F.min("left") * scale_x, "y0": F.min("top") * scale_y, "x1": F.max(F.col("left") + F.col("width")) * scale_x, "y1": F.max(F.col("top") + F.col("height")) * scale_y}
    return good.groupBy("page", "block", "par", "line").agg(text.alias("text"), *(c.alias(n) for n, c in box.items()), F.round(F.avg("conf") / 100, 6).alias("confidence"))


def lines_from_blocks(pages: DataFrame, blocks: str = "blocks") -> DataFrame:
    """Nested blocks of paragraphs of lines, one row for each line: (page, block, par, line, text, box)."""
    b = pages.select("page", F.posexplode(blocks).alias("block", "b"))
    p = b.select("page", "block", F.posexplode("b.paragraphs").alias("par", "p"))
    return p.select("page", "block", "par", F.posexplode("p.lines").alias("line", "l")).select("page", "block", "par", "line", "l.text", "l.bbox")


def lines_from_text(pages: DataFrame, text: str = "text") -> DataFrame:
    """Plain text without geometry: line i gets the band from 2i to 2i + 1, so that the order stays."""
    rows = pages.select("page", F.posexplode(F.split(text, "\n")).alias("line", "text"))
    return rows.select("page", "line", F.trim("text").alias("text"), F.lit(0.0).alias("x0"), (F.col("line") * 2.0).alias("y0"), F.lit(0.0).alias("x1"), (F.col("line") * 2.0 + 1).alias("y1"))
