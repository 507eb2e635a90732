"""Small literal pages with what the tables lack: Markdown objects, running headers, wrapped words. Queries add them to
the documents so that no rule passes for want of a case; their page numbers are negative."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: source, page, text.
PAGES = [
    ("report", -1, "The Annual Report 1\n# 1 Introduction\nThe first para-\ngraph goes on and on over the page without an end\nPage 1"),
    ("report", -2, "The Annual Report 2\ncontinued here in lower case, then done.\n# 1 Introduction\n#### 1.2.3 Deep Title\nPage 2"),
    ("report", -3, "The Annual Report 3\nChapter 2 Methods\n- first item\n- second item\n1. numbered\n> quoted words\nPage 3"),
    ("report", -4, "The Annual Report 4\n```\nre-\nturn x\n```\nA wrapped exam-\nple stays whole\nPage 4"),
    ("report", -5, "The Annual Report 5\n$$\nE = mc^2\n$$\nFigure 1: The curve of sin x\n| a | b |\n|---|---|\n| 1 | 2 \\| 3 |\n| 5 | 6 |\nPage 5"),
    ("report", -6, '[SOURCE_VISUAL page=6 id="v1" kind="equation" bbox="1,2,3,4" caption="A plot"]\n[VISUAL_PLACEHOLDER x]\n<!-- page: 6 -->\nAppendix A Tables\niv'),
    ("manual", -7, "ACME MANUAL · 12/40\nDraft copy\nGET /api/v1/items\nstatus = ok\nMAX_SIZE\n{\n}\n1.1 Setup ..... 7\n1.2 Use ..... 9\nContents"),
    ("manual", -8, "ACME MANUAL · 13/40\nDraft copy\n[^1]: A note\n☐ open task\n☑ done task\n**Bold** and _light_ and `code` \\* \\# \\-\n99/100"),
    ("manual", -9, "ACME MANUAL · 14/40\nDraft copy\nنص عربي طويل\nmixed نص\nf(x) = a_1 + b^2 <= 4\nTable 2. Sums\nxii"),
]


def pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAGES, "source string, page long, text string")


def pages_sql() -> str:
    rows = ",\n".join(f"($f${s}$f$, {p}::BIGINT, $f${t}$f$)" for s, p, t in PAGES)
    return f"fixture_pages(source, page, text) AS (VALUES {rows})"
