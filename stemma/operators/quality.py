"""Quality of extracted documents: audit, confidence summaries, evidence policy, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severity of each issue. Fixed values.
SEVERITY = {
    "LOW_TEXT_PAGES": "warning", "UNPRESERVED_GAPS": "error", "STRUCTURE_COLLAPSE": "error", "NO_TECHNICAL_OBJECTS": "warning", "LOW_TECHNICAL_OBJECTS": "warning",
    "WRAP_HYPHENS": "warning", "RUNNING_MATTER": "warning", "TEXT_ENCODING_DAMAGE": "warning", "SOURCE_EVIDENCE_MISSING": "error", "OCR_ONLY_PAGES": "warning",
    "LOW_LAYOUT_CONFIDENCE": "warning", "OCR_ONLY_DOCUMENT": "warning", "PAGE_EXTRACTION_ERRORS": "error", "INCOMPLETE_DOCUMENT": "error", "PARTIAL_DOCUMENT": "warning",
}
ACCEPT, REVIEW = 0.82, 0.55
WEIGHTS = ("recognition", "parse_validity", "visual_similarity", "crop_quality", "node_accuracy", "topology_confidence", "structural", "semantic", "overall", "quality")
#: Pages named in an issue.
LISTED = 50


def audit(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """pages (source, page, characters, ocr_applied, text_blocks, corrupt, gaps, preserved, fallback_failed,
    layout_confidence, failed), documents (source, words, cues, objects, hyphens, leaked, source_pages, selected_pages) ->
    (source, code, severity, count, pages): the issues of each document, with up to LISTED of the pages concerned."""
    characters, blocks, ocr = F.col("characters"), F.col("text_blocks"), F.col("ocr_applied")
    substantial = ~ocr & (characters >= 250)
    rules = {
        "LOW_TEXT_PAGES": characters < 20,
        "UNPRESERVED_GAPS": F.coalesce("gaps", F.lit(0)) > F.coalesce("preserved", F.lit(0)),
        "STRUCTURE_COLLAPSE": substantial & (blocks <= 1),
        "TEXT_ENCODING_DAMAGE": F.col("corrupt"),
        "SOURCE_EVIDENCE_MISSING": F.col("fallback_failed"),
        "OCR_ONLY_PAGES": ocr & (F.coalesce(blocks, F.lit(0)) == 0),
        "LOW_LAYOUT_CONFIDENCE": F.col("layout_confidence") < 0.6,
        "PAGE_EXTRACTION_ERRORS": F.col("failed"),
    }
    aggregates = [F.count("*").alias("n"), F.count_if(ocr).alias("ocr"), F.count_if(substantial).alias("substantial")]
    aggregates += [F.count_if(F.coalesce(cond, F.lit(False))).alias(f"{code}_n") for code, cond in rules.items()]
    rows = pages.groupBy("source").agg(*aggregates).join(documents, "source")
    # Pages are ranked before they are gathered, so a document of many pages gathers LISTED of each issue.
    hit = pages.select("source", "page", F.explode(F.array_compact(F.array(*(F.when(cond, F.lit(code)) for code, cond in rules.items())))).alias("code"))
    first = hit.withColumn("r", F.row_number().over(Window.partitionBy("source", "code").orderBy("page"))).where(F.col("r") <= LISTED)
    lists = first.groupBy("source", "code").agg(F.array_sort(F.collect_list("page")).alias("own"))
    rows = rows.join(lists.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("code", "own"))).alias("own")), "source", "left")
    c = F.col
    technical = (c("words") > 10000) & (c("cues") > 20)
    fires = {code: c(f"{code}_n") > 0 for code in rules}
    fires["STRUCTURE_COLLAPSE"] = (c("substantial") >= 10) & (c("STRUCTURE_COLLAPSE_n") / c("substantial") >= 0.7) & (c("words") > 1000)
    counts = {code: c(f"{code}_n") for code in rules}
    listed = {code: F.coalesce(F.try_element_at("own", F.lit(code)), F.array().cast("array<long>")) for code in rules}
    more = {
        "NO_TECHNICAL_OBJECTS": (technical & (c("objects") == 0), F.lit(1)),
        "LOW_TECHNICAL_OBJECTS": (technical & (c("objects") > 0) & (c("objects") < F.greatest(F.lit(2), F.ceil(c("n") / 50))), c("objects")),
        "WRAP_HYPHENS": (c("hyphens") > 20, c("hyphens")),
        "RUNNING_MATTER": (c("leaked") > 0, c("leaked")),
        "OCR_ONLY_DOCUMENT": ((c("n") > 0) & (c("ocr") == c("n")), c("ocr")),
        "INCOMPLETE_DOCUMENT": ((c("selected_pages") > c("n")) & (c("PAGE_EXTRACTION_ERRORS_n") == 0), c("selected_pages") - c("n")),
        "PARTIAL_DOCUMENT": (c("source_pages") > c("selected_pages"), F.lit(1)),
    }
    for code, (cond, count) in more.items():
        fires[code], counts[code] = cond, count
    none = F.array().cast("array<long>")
    issues = [
        F.when(fires[code], F.struct(F.lit(code).alias("code"), F.lit(s).alias("severity"), counts[code].cast("long").alias("count"), listed.get(code, none).cast("array<long>").alias("pages")))
        for code, s in SEVERITY.items()
    ]
    return rows.select("source", F.explode(F.array_compact(F.array(*issues))).alias("i")).select("source", "i.*")


def status(issues: DataFrame, documents: DataFrame) -> DataFrame:
    """(source, status, issues): needs-review with any error, warnings with any issue, else pass."""
    found = issues.groupBy("source").agg(F.bool_or(F.col("severity") == "error").alias("bad"), F.count("*").alias("issues"))
    rows = documents.select("source").distinct().join(found, "source", "left")
    return rows.select("source", F.when(F.col("bad"), "needs-review").when(F.col("issues") > 0, "warnings").otherwise("pass").alias("status"), F.coalesce("issues", F.lit(0)).alias("issues"))


def weighted_score(parts: dict[str, Column]) -> Column:
    """Weighted mean of the known parts; parts that are no named component weigh half; 0 without any."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, value in parts.items():
        w = 1.0 if name in WEIGHTS else 0.5
        total = total + F.when(value.isNotNull(), value * w).otherwise(0.0)
        weight = weight + F.when(value.isNotNull(), w).otherwise(0.0)
    return F.when(weight > 0, total / weight).otherwise(0.0)


def policy(score: Column, any_part: Column, level: Column, given: Column, accept: float = ACCEPT, review: float = REVIEW) -> Column:
    """Disposition from a score and the level of validation evidence (high, medium, low, missing or null). Medium evidence
    asks for review even over the accepting score."""
    rank = F.when(level == "high", 3).when(level == "medium", 2).when(level == "low", 1).otherwise(0)
    return F.coalesce(
        given,
        F.when(~any_part & level.isNull(), "preserved")
        .when((rank >= 3) & (score >= accept), "accepted")
        .when((rank >= 2) & (score >= review), "review")
        .when(score >= accept, "accepted")
        .when(score >= review, "review")
        .otherwise("preserved"),
    )


def review_queue(items: DataFrame, cap: int | None = None) -> DataFrame:
    """Items in order of page and id. A queue over the cap is an error, not a shorter queue."""
    if cap is not None:
        n = items.agg(F.count("*").alias("n")).select(F.assert_true(F.col("n") <= cap, f"more than {cap} review items").alias("ok"))
        items = items.join(F.broadcast(n), F.col("ok").isNull()).drop("ok")
    return items.orderBy("page", "id")


def decide(action: Column, disposition: Column, mandatory_passed: Column, parsed: Column, confidence: Column) -> Column:
    """What a reviewer's action makes of an item."""
    return (
        F.when(action == "accept", F.when(mandatory_passed & (disposition != "preserved"), "accepted").otherwise("review"))
        .when(action == "edit", F.when(parsed & (confidence >= ACCEPT), "review").otherwise("preserved"))
        .otherwise("preserved")
    )


def confidence_summary(rows: DataFrame, keys: list[str], dimensions: list[str], null_is_zero: bool = False) -> DataFrame:
    """(keys, dimension, known, unknown, least, most, mean): null is unknown, not nothing, unless null_is_zero."""
    long = rows.select(*keys, *dimensions).unpivot(keys, dimensions, "dimension", "value")
    value = F.coalesce("value", F.lit(0.0)) if null_is_zero else F.col("value")
    return long.groupBy(*keys, "dimension").agg(
        F.count("value").alias("known"), F.count_if(F.col("value").isNull()).alias("unknown"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean")
    )
