"""Queries on formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import mathir
from stemma.operators import equations as EQ
from stemma.plans import sql as S
from stemma.plans.registry import query
from stemma.sources.views import LINES_SQL, lines_of, pages, table

_N = S.words("v")
_SIGNS = S.count("v", r"[=<>≤≥≠≈+−×÷∑∏∫√∞]")


@query(
    "EQ02 EQ03 EQ12",
    f"""WITH {LINES_SQL}, t AS (SELECT source, page, line_no, trim(line) AS v, {S.math_score("trim(line)")} AS score FROM v_lines)
SELECT source, page, line_no, NOT (v = '' OR length(v) > 240 OR len({_N}) > 28 OR {S.hit("v", EQ.HEADED)} OR {S.hit("v", EQ.THEOREM)} OR {S.hit("v", r"^\s*[|>]")} OR {S.hit("v", EQ.DRAWN)} OR {S.hit("v", EQ.PROTOCOL)} OR {S.hit("v", "[?]")})
AND ({S.hit("v", EQ.COMMAND)} OR {S.hit("v", EQ.SCRIPT)} OR ({S.hit("v", EQ.RELATION)} AND ({S.hit("v", EQ.OPERATOR)} OR (len(regexp_extract_all(v, '[A-Za-z]+')) > 0 AND len(list_filter(regexp_extract_all(v, '[A-Za-z]+'), lambda w: length(w) > 3)) = 0))))
AND score >= 2 AND NOT ({S.hit("v", EQ.PROSE)} AND score < 7) AS native,
NOT (v = '' OR length(v) > 220 OR {S.hit("v", EQ.HEADED)} OR len({_N}) > 24 OR {S.hit("v", r"^\s*[|>]")} OR {S.hit("v", EQ.PROTOCOL)} OR {S.hit("v", r"[=<>≤≥≠≈+−×÷]\s*$")} OR ({S.hit("v", EQ.PROSE)} AND len({_N}) > 5 AND {_SIGNS} < 4))
AND {S.hit("v", EQ.RELATION)} AND {_SIGNS} > 0 AND score >= CASE WHEN {S.hit("v", EQ.PROSE)} THEN 7 ELSE 4 END AS ocr, round(greatest(0.15, least(0.99, 0.52 + 0.09 * score)), 6)::DOUBLE AS confidence FROM t""",
)
def equation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.trim("line")
    return lines_of(pages(spark, sf_dir)).select("source", "page", "line_no", EQ.is_equation(v).alias("native"), EQ.is_ocr_equation(v).alias("ocr"), F.round(EQ.candidate_confidence(v), 6).alias("confidence"))


@query(
    "EQ10 EQ16",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag <> 'N' AS parsed, l_linestatus = 'F' AS equivalent, CASE WHEN l_suppkey % 3 = 0 THEN 'native' WHEN l_suppkey % 3 = 1 THEN 'tesseract-ocr' ELSE 'other' END AS provider, l_partkey % 2 = 0 AS exact, l_quantity / 50 AS recognition, l_discount * 10 AS overall, l_partkey % 5 = 0 AS has_gold FROM lineitem)
SELECT d, count(*)::BIGINT AS n FROM (SELECT CASE WHEN parsed AND equivalent AND ((has_gold AND overall >= 0.82) OR (provider = 'native' AND exact AND overall >= 0.55) OR (provider = 'tesseract-ocr' AND recognition >= 0.82 AND overall >= 0.55)) THEN 'accepted' WHEN parsed AND overall >= 0.55 THEN 'review' ELSE 'preserved' END AS d FROM c) GROUP BY d""",
)
def equation_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    provider = F.when(c("l_suppkey") % 3 == 0, "native").when(c("l_suppkey") % 3 == 1, "tesseract-ocr").otherwise("other")
    d = EQ.accepted(c("l_returnflag") != "N", c("l_linestatus") == "F", provider, c("l_partkey") % 2 == 0, c("l_quantity") / 50, c("l_discount") * 10, c("l_partkey") % 5 == 0)
    return table(spark, sf_dir, "lineitem").groupBy(d.alias("d")).agg(F.count("*").alias("n"))


_FORMULA = f"""length(v) BETWEEN 3 AND 240 AND len({_N}) <= 18 AND ({S.hit("v", EQ.RELATION)} OR {S.count("v", EQ.SIGN)} >= 2 OR {S.hit("v", r"[\^_]")}) AND {S.count("v", EQ.SIGN)} > 0
AND NOT (len(list_filter({_N}, lambda w: length({S.sub("w", (r"\P{L}", ""))}) > 3 AND lower({S.sub("w", (r"^\\+", ""))}) NOT IN ({", ".join(map(S.q, EQ.NAMES))}))) > 0 AND {S.count("v", EQ.SIGN)} < 2) AND NOT {S.hit("v", "[?!]")}"""


@query("EQ04", f"WITH {LINES_SQL}, t AS (SELECT source, page, line_no, {S.squeeze('line')} AS v FROM v_lines) SELECT source, page, line_no, v AS formula FROM t WHERE {_FORMULA}")
def plain_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemma.functions.text import squeeze

    rows = lines_of(pages(spark, sf_dir)).select("source", "page", "line_no", squeeze(F.col("line")).alias("formula"))
    return rows.where(EQ.is_plain_formula(F.col("formula")))


@query("EQ05 EQ06 EQ07 EQ08")
def inline_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheap test for a relation or a mark runs before the Python function sees a line."""
    lines = lines_of(pages(spark, sf_dir)).where(F.col("line").rlike(r"[=<>≤≥≠≈≡]|\$|\\\("))
    return lines.select("source", "page", "line_no", F.explode(mathir.inline_formulas(F.col("line"))).alias("f")).select("source", "page", "line_no", "f.*")


@query("EQ09 VAL05")
def latex_to_mathir(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inline_equations(spark, sf_dir).withColumn("ir", mathir.parsed(F.col("latex")))
    return found.select("source", "page", "line_no", "latex", "ir.success", "ir.errors", "ir.root_type", F.size("ir.nodes").alias("n_nodes"))
