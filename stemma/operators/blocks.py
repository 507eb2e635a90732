"""Blocks of Markdown and their types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions import patterns as P
from stemma.functions import text as T


def split_blocks(pages: DataFrame, separator: str = "\n") -> DataFrame:
    """(source, page, block_no, markdown): a page without its page markers, cut at the separator (a pattern)."""
    clean = F.regexp_replace("text", "(?m)" + P.PAGE_MARKER, "")
    blocks = pages.select("source", "page", F.posexplode(F.split(clean, separator)).alias("block_no", "markdown"))
    return blocks.withColumn("markdown", F.trim("markdown")).where("markdown <> ''")


def block_type(markdown: Column, kind: Column | None = None) -> Column:
    """footnote, heading, list, caption or paragraph from the text; the extractor's own kind comes first."""
    plain = T.squeeze(F.regexp_replace(markdown, r"(?s)<!--.*?-->", " "))
    by_text = (
        F.when(markdown.rlike(P.FOOTNOTE), "footnote")
        .when(markdown.rlike(r"^#{1,6}\s+"), "heading")
        .when(markdown.rlike(P.LIST_ITEM), "list")
        .when(plain.rlike(P.CAPTION), "caption")
        .otherwise("paragraph")
    )
    if kind is None:
        return by_text
    k = F.lower(F.coalesce(kind, F.lit("")))
    known = F.when(k.isin("table", "caption"), k).when(k.isin("equation", "equation-fallback"), "equation").when(k.isin("visual", "source-page", "diagram", "chart", "image"), "figure")
    return F.coalesce(known.when(k.isin("footnote", "foot-note"), "footnote"), by_text)


#: How a block of a type was found when nothing says so. Fixed values.
METHODS = {
    "heading": "heading-classifier",
    "paragraph": "mupdf-structured-text",
    "text-block": "legacy-text",
    "list": "layout-list",
    "table": "validated-table-geometry",
    "figure": "source-preservation",
    "equation": "validated-equation",
    "caption": "layout-caption",
    "footnote": "layout-footnote",
}


def extraction_method(kind: Column, given: Column) -> Column:
    by_type = F.lit("layout-text")
    for name, method in METHODS.items():
        by_type = F.when(kind == name, method).otherwise(by_type)
    return F.coalesce(F.nullif(given, F.lit("")), by_type)


def confidence(kind: Column, method: Column, given: Column) -> Column:
    """struct of value and where it is from."""
    kept = F.greatest(F.lit(0.0), F.least(F.lit(1.0), given))
    rule = lambda value, source: F.struct(value.cast("double").alias("value"), F.lit(source).alias("source"))
    return (
        F.when(given.isNotNull() & ~F.isnan(given), rule(kept, "extractor"))
        .when(method.rlike("(?i)ocr"), rule(F.lit(0.72), "ocr-default"))
        .when(method.rlike("(?i)source-preservation|fallback"), rule(F.lit(0.5), "preservation-default"))
        .when(kind.isin("heading", "table", "equation"), rule(F.lit(0.5), "unvalidated-default"))
        .otherwise(rule(F.lit(0.5), "not-provided"))
    )
