"""Queries on tables, visuals, bundles, evaluation and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import geometry as G
from stemma.functions import text as T
from stemma.operators import bundle as B
from stemma.operators import evaluation as E
from stemma.operators import tables as TB
from stemma.operators import visuals as V
from stemma.plans import sql as S
from stemma.plans.registry import query
from stemma.sources.views import GEOMETRY_SQL, LINES_SQL, geometry_of, lines_of, pages, table

# Tables: one for each region, a row for each nation; every fifth nation's comment cell is blank, and one is merged.
_CELLS = """v_rows AS (SELECT n_regionkey AS table_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS row, * FROM nation),
v_cells AS (SELECT table_id, row, 0 AS col, n_nationkey::VARCHAR AS text, 1 AS row_span, 1 AS col_span, false AS observed_empty FROM v_rows
    UNION ALL SELECT table_id, row, 1, n_name || CASE WHEN n_nationkey % 7 = 0 THEN ' | <x>' ELSE '' END, 1, CASE WHEN n_nationkey = 13 THEN 2 ELSE 1 END, false FROM v_rows
    UNION ALL SELECT table_id, row, 2, CASE WHEN n_nationkey % 5 = 4 THEN '' ELSE 'no. ' || n_nationkey END, 1, 1, n_nationkey % 2 = 0 FROM v_rows WHERE n_nationkey <> 13),
v_own AS (SELECT table_id, row, sum(col_span) AS covered, max(col + col_span) AS wide, count(*) AS n, count(*) FILTER (trim(text) = '' AND NOT observed_empty) AS blank, bool_and(row_span = 1 AND col_span = 1 AND (trim(text) <> '' OR observed_empty)) AS plain FROM v_cells GROUP BY ALL),
v_wide AS (SELECT table_id, max(wide) AS columns, count(*) AS n_rows FROM v_own GROUP BY table_id),
v_diag AS (SELECT o.table_id, columns, n_rows, count(*) FILTER (covered < columns) AS missing, sum(blank) AS empty FROM v_own o JOIN v_wide w ON o.table_id = w.table_id GROUP BY ALL),
v_sure AS (SELECT *, CASE WHEN missing > 0 OR empty > 0 THEN 0.61 ELSE 0.85 END::DOUBLE AS confidence FROM v_diag)"""


def _table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    row = (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).cast("int")
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("table_id"), row.alias("row"), F.col("n_nationkey").alias("n"), "n_name")
    n = F.col("n")
    cell = lambda col, text, span, empty: F.struct(F.lit(col).alias("col"), text.alias("text"), F.lit(1).alias("row_span"), span.alias("col_span"), empty.alias("observed_empty"))
    three = F.array(
        cell(0, n.cast("string"), F.lit(1), F.lit(False)),
        cell(1, F.concat("n_name", F.when(n % 7 == 0, " | <x>").otherwise("")), F.when(n == 13, 2).otherwise(1), F.lit(False)),
        cell(2, F.when(n % 5 == 4, "").otherwise(F.concat(F.lit("no. "), n)), F.lit(1), n % 2 == 0),
    )
    return rows.select("table_id", "row", F.inline(F.when(n == 13, F.slice(three, 1, 2)).otherwise(three)))


def _diagnosed(cells: DataFrame) -> DataFrame:
    return TB.diagnose(cells, cells.select("table_id").distinct().withColumn("structure", F.lit(0.85)))


@query(
    "TB07 VAL06 ST04",
    f"WITH {_CELLS} SELECT table_id, columns::INT AS columns, n_rows::BIGINT AS n_rows, missing::BIGINT AS missing, empty::BIGINT AS empty, confidence, CASE WHEN confidence >= 0.82 THEN 'reconstructed' WHEN confidence >= 0.62 THEN 'reconstructed-with-source' ELSE 'preserved-source' END AS disposition FROM v_sure",
)
def table_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diagnosed(_table_cells(spark, sf_dir))


@query(
    "TB08",
    f"WITH {_CELLS} SELECT s.table_id, s.columns >= 1 AND n_rows >= 2 AND confidence >= 0.82 AND bool_and(plain AND n = s.columns) AS markdown FROM v_sure s JOIN v_own o ON s.table_id = o.table_id GROUP BY s.table_id, s.columns, n_rows, confidence",
)
def table_representability(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _table_cells(spark, sf_dir)
    return TB.representable(cells, _diagnosed(cells))


@query(
    "SNK12",
    f"""WITH {_CELLS}, m AS (SELECT table_id, row, '| ' || string_agg({S.sub(S.sub(S.sub("text", (chr(92) * 2, chr(92) * 4)), (r"\|", r"\\|")), (r"\r?\n", "<br>"))}, ' | ' ORDER BY col) || ' |' || CASE WHEN row = 0 THEN chr(10) || '|' || repeat(' --- |', count(*)::INT) ELSE '' END AS line FROM v_cells GROUP BY table_id, row)
SELECT table_id, string_agg(line, chr(10) ORDER BY row) AS markdown FROM m GROUP BY table_id""",
)
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TB.to_markdown(_table_cells(spark, sf_dir))


@query(
    "SNK12 TXT23",
    f"""WITH {_CELLS}, h AS (SELECT table_id, row, '<tr data-row-index="' || row || '">' || string_agg('<td' || CASE WHEN col_span > 1 THEN ' colspan="' || col_span || '"' ELSE '' END || '>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td>', '' ORDER BY col) || '</tr>' AS line FROM v_cells GROUP BY table_id, row)
SELECT table_id, '<table><tbody>' || string_agg(line, '' ORDER BY row) || '</tbody></table>' AS html FROM h GROUP BY table_id""",
)
def table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TB.to_html(_table_cells(spark, sf_dir))


@query(
    "SRC14",
    f"""WITH {LINES_SQL}, r AS (SELECT *, {S.hit("line", r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?\s*$")} AS separator, replace(trim(line), chr(92) || '|', chr(1)) AS held FROM v_lines WHERE {S.hit("trim(line)", r"^\|.*\|$")})
SELECT source, page, line_no, CASE WHEN NOT separator THEN list_transform(string_split({S.sub("held", (r"^\||\|$", ""))}, '|'), lambda x: trim(replace(x, chr(1), '|'))) END AS cells FROM r""",
)
def markdown_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines_of(pages(spark, sf_dir)).where(F.trim("line").rlike(r"^\|.*\|$"))
    return TB.parse_markdown(rows).select("source", "page", "line_no", "cells")


_GRID = """v_items AS (SELECT l_orderkey AS page, l_linenumber AS item, 20.0 + l_linenumber * 60 AS x0, 20.0 + l_linenumber * 60 + 20 + (l_partkey % 4) * 30 AS x1, 30.0 + (l_suppkey % 6) * 25 AS y0, 30.0 + (l_suppkey % 6) * 25 + 10 + (l_partkey % 3) * 15 AS y1 FROM lineitem),
v_hs AS (SELECT unnest([25, 50, 75, 100, 125, 150, 175])::DOUBLE AS pos), v_vs AS (SELECT unnest([10, 110, 210, 310, 410])::DOUBLE AS pos)"""


@query(
    "TB03 TB04 TB09",
    f"""WITH {_GRID}, p AS (SELECT *, (SELECT count(*) FROM v_hs WHERE pos <= (y0 + y1) / 2) - 1 AS row, (SELECT count(*) FROM v_vs WHERE pos <= (x0 + x1) / 2) - 1 AS col, (SELECT count(*) FROM v_hs WHERE pos > y0 AND pos < y1) + 1 AS rs, (SELECT count(*) FROM v_vs WHERE pos > x0 AND pos < x1) + 1 AS cs FROM v_items)
SELECT row::INT AS row, col::INT AS col, rs::INT AS row_span, cs::INT AS col_span, count(*)::BIGINT AS n FROM p WHERE row >= 0 AND col >= 0 AND row < 6 AND col < 4 GROUP BY ALL""",
)
def vector_grid_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    x0, y0 = F.lit(20.0) + n * 60, F.lit(30.0) + s % 6 * 25
    items = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("grid"), n.alias("item"), x0.alias("x0"), (x0 + 20 + p % 4 * 30).alias("x1"), y0.alias("y0"), (y0 + 10 + p % 3 * 15).alias("y1"))
    lines = [(0, float(w), float(h), float(at)) for w, h, ats in ((400, 1, range(25, 176, 25)), (1, 400, range(10, 411, 100))) for at in ats]
    rules = spark.createDataFrame(lines, "grid int, w double, h double, at double").withColumn("axis", TB.rule_axis(F.col("w"), F.col("h")))
    return TB.place_in_grid(items, F.broadcast(rules), ["grid"]).groupBy("row", "col", "row_span", "col_span").agg(F.count("*").alias("n"))


_EVIDENCE = """v_visuals AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN 'diagram' WHEN p_partkey % 17 = 0 THEN 'chart' END AS class_hint, CASE WHEN p_partkey % 29 = 0 THEN 'source-page' ELSE 'vector' END AS source_kind,
    (['bar chart of', 'logo', 'separator', 'background', 'equation', 'workflow', 'photo', 'decoration', 'plain'])[p_size % 9 + 1] || ' ' || lower(p_type) AS hints, p_size % 2 AS n_images, p_size % 4 AS vector_nodes, p_partkey % 3 AS vector_edges, p_partkey % 5 AS rules,
    p_partkey % 4 AS nodes, p_partkey % 2 AS edges, p_partkey % 7 = 0 AS ambiguous, (p_size * 10)::DOUBLE AS width, (p_partkey % 40)::DOUBLE AS height, p_partkey % 3 > 0 AS has_source, CASE WHEN p_partkey % 11 < 6 THEN 0.9 END::DOUBLE AS chart_structure FROM part)"""


def _visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    words = F.array(*map(F.lit, ("bar chart of", "logo", "separator", "background", "equation", "workflow", "photo", "decoration", "plain")))
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 13 == 0, "diagram").when(k % 17 == 0, "chart").alias("class_hint"), F.when(k % 29 == 0, "source-page").otherwise("vector").alias("source_kind"),
        F.concat(F.element_at(words, (s % 9 + 1).cast("int")), F.lit(" "), F.lower("p_type")).alias("hints"), (s % 2).alias("n_images"), (s % 4).alias("vector_nodes"), (k % 3).alias("vector_edges"), (k % 5).alias("rules"),
        (k % 4).alias("nodes"), (k % 2).alias("edges"), (k % 7 == 0).alias("ambiguous"), (s * 10).cast("double").alias("width"), (k % 40).cast("double").alias("height"), (k % 3 > 0).alias("has_source"), F.when(k % 11 < 6, 0.9).alias("chart_structure"),
    )


@query(
    "VS01 AG13",
    f"""WITH {_EVIDENCE}, h AS (SELECT *, nodes >= 2 AND edges >= 1 AND NOT ambiguous AS graph, regexp_matches(hints, '\\b(?:decoration|separator|background)\\b') AS quiet_said FROM v_visuals),
k AS (SELECT *, coalesce(class_hint, CASE WHEN source_kind = 'source-page' THEN 'background' WHEN regexp_matches(hints, '\\bseparator\\b') THEN 'separator' WHEN regexp_matches(hints, '\\bbackground\\b') THEN 'background' WHEN regexp_matches(hints, '\\bdecoration\\b') THEN 'decoration'
    WHEN regexp_matches(hints, '\\blogo\\b') THEN 'logo' WHEN regexp_matches(hints, '\\bequation\\b') AND n_images > 0 THEN 'equation-image' WHEN regexp_matches(hints, '\\bchart\\b') THEN 'chart' WHEN regexp_matches(hints, '\\bworkflow\\b') AND n_images > 0 THEN 'diagram'
    WHEN graph THEN 'graph-flowchart' WHEN vector_nodes >= 2 THEN 'diagram' WHEN n_images > 0 THEN 'ordinary-image' WHEN rules > 0 AND (width > height * 8 OR height < 4) THEN 'separator' ELSE 'unresolved-visual' END) AS class FROM h),
s AS (SELECT *, CASE WHEN class = 'graph-flowchart' THEN CASE WHEN graph OR (vector_nodes >= 2 AND vector_edges >= 1) THEN 0.88 ELSE 0.42 END WHEN class = 'chart' THEN coalesce(chart_structure, 0.25) WHEN class IN ('ordinary-image', 'equation-image', 'logo') THEN 0.92
    WHEN class IN ('decoration', 'separator', 'background') THEN CASE WHEN quiet_said OR source_kind = 'source-page' THEN 0.93 ELSE 0.65 END WHEN class = 'diagram' THEN CASE WHEN vector_nodes >= 2 THEN 0.56 ELSE 0.3 END ELSE 0.2 END::DOUBLE AS structure,
    CASE WHEN class = 'graph-flowchart' THEN CASE WHEN graph THEN 0.91 ELSE 0.7 END WHEN class = 'chart' THEN CASE WHEN regexp_matches(hints, '\\bchart\\b') OR class_hint = 'chart' THEN 0.9 ELSE 0.72 END
    WHEN class IN ('ordinary-image', 'equation-image', 'logo') THEN CASE WHEN class_hint IS NOT NULL OR regexp_matches(hints, '\\b(?:logo|equation)\\b') THEN 0.9 ELSE 0.78 END
    WHEN class IN ('decoration', 'separator', 'background') THEN CASE WHEN quiet_said OR source_kind = 'source-page' THEN 0.94 ELSE 0.58 END WHEN class_hint IS NOT NULL THEN 0.95 ELSE 0.46 END::DOUBLE AS classification FROM k)
SELECT id, class, classification, structure, CASE WHEN class IN ('decoration', 'separator', 'background') AND least(classification, structure) >= 0.9 THEN 'omitted-decoration' WHEN class IN ('graph-flowchart', 'chart') AND least(classification, structure) >= 0.86 AND has_source THEN 'reconstructed-with-source' ELSE 'preserved-source' END AS disposition FROM s""",
)
def visual_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.classify(_visuals(spark, sf_dir)).select("id", "class", "classification", "structure", "disposition")


_DIAGRAMS = """v_nodes AS (SELECT s_suppkey % 5 AS diagram, s_suppkey AS node, (s_suppkey % 10 * 60)::DOUBLE AS bx0, (s_suppkey // 10 % 8 * 50)::DOUBLE AS by0 FROM supplier),
v_connectors AS (SELECT c_custkey % 5 AS diagram, c_custkey AS connector, (c_custkey % 10 * 61)::DOUBLE AS x0, (c_custkey // 10 % 8 * 52)::DOUBLE AS y0, (c_custkey % 7 * 83)::DOUBLE AS x1, (c_custkey % 5 * 37)::DOUBLE AS y1 FROM customer),
v_ends AS (SELECT diagram, connector, unnest([0, 1]) AS e, unnest([x0, x1]) AS x, unnest([y0, y1]) AS y FROM v_connectors),
v_near AS (SELECT e.diagram, connector, e, node, sqrt(greatest(bx0 - x, 0, x - bx0 - 40) ** 2 + greatest(by0 - y, 0, y - by0 - 30) ** 2) AS d FROM v_ends e JOIN v_nodes n ON e.diagram = n.diagram),
v_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY diagram, connector, e ORDER BY d, node) AS r FROM v_near WHERE d <= 24) WHERE r = 1),
v_edges AS (SELECT a.diagram, a.connector, a.node AS source, b.node AS target FROM v_best a JOIN v_best b ON a.diagram = b.diagram AND a.connector = b.connector AND a.e = 0 AND b.e = 1 WHERE a.node <> b.node)"""


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    box = G.of_size((s % 10 * 60).cast("double"), (F.floor(s / 10) % 8 * 50).cast("double"), F.lit(40.0), F.lit(30.0))
    nodes = table(spark, sf_dir, "supplier").select((s % 5).alias("diagram"), s.alias("node"), F.col("s_name").alias("label"), box.alias("box"))
    ends = {"x0": c % 10 * 61, "y0": F.floor(c / 10) % 8 * 52, "x1": c % 7 * 83, "y1": c % 5 * 37}
    connectors = table(spark, sf_dir, "customer").select((c % 5).alias("diagram"), c.alias("connector"), *(v.cast("double").alias(n) for n, v in ends.items()))
    return nodes, V.connector_ends(connectors, nodes, "diagram")


@query("JN12 JN11 VS02", f"WITH {_DIAGRAMS} SELECT * FROM v_edges")
def flowchart_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)[1]


@query(
    "JN13 ST09",
    f"""WITH {_DIAGRAMS}, a AS (SELECT DISTINCT diagram, source, target, true AS l FROM v_edges WHERE connector % 3 < 2), b AS (SELECT DISTINCT diagram, source, target, true AS r FROM v_edges WHERE connector % 3 > 0),
c AS (SELECT diagram, count(*) FILTER (l AND r) AS common, count(*) FILTER (r IS NULL) AS only_left, count(*) FILTER (l IS NULL) AS only_right FROM a FULL JOIN b USING (diagram, source, target) GROUP BY diagram),
d AS (SELECT *, round((only_left + only_right) / greatest(1, common + only_left + only_right), 6)::DOUBLE AS contradiction FROM c)
SELECT diagram, common::BIGINT AS common, only_left::BIGINT AS only_left, only_right::BIGINT AS only_right, contradiction, contradiction > 0.5 AS contradicts FROM d""",
)
def topology_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)[1]
    return V.compare_topology(edges.where("connector % 3 < 2"), edges.where("connector % 3 > 0"), "diagram")


@query(
    "EV06",
    f"""WITH {_DIAGRAMS}, e AS (SELECT DISTINCT diagram, source, target, true AS e FROM v_edges WHERE connector % 3 < 2), a AS (SELECT DISTINCT diagram, CASE WHEN connector % 4 = 1 THEN target ELSE source END AS source, CASE WHEN connector % 4 = 1 THEN source ELSE target END AS target, true AS a FROM v_edges WHERE connector % 3 > 0),
b AS (SELECT *, EXISTS (SELECT 1 FROM a t WHERE t.diagram = x.diagram AND t.source = x.target AND t.target = x.source) AS t FROM (SELECT * FROM e FULL JOIN a USING (diagram, source, target)) x)
SELECT diagram, count(*) FILTER (e AND a)::BIGINT AS right_edges, count(*) FILTER (a IS NULL)::BIGINT AS missing, count(*) FILTER (e IS NULL)::BIGINT AS extra, count(*) FILTER (e AND a IS NULL AND t)::BIGINT AS reversed, count(*) FILTER (a IS NULL OR e IS NULL) = 0 AS passed FROM b GROUP BY diagram""",
)
def diagram_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)[1]
    turn = F.col("connector") % 4 == 1
    found = edges.where("connector % 3 > 0").select("diagram", F.when(turn, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(turn, F.col("source")).otherwise(F.col("target")).alias("target"))
    return V.evaluate_edges(edges.where("connector % 3 < 2"), found, "diagram").withColumnRenamed("right", "right_edges")


@query(
    "SNK11 VS04 VS06",
    f"""WITH {_DIAGRAMS}, n AS (SELECT s_suppkey % 5 AS diagram, 0 AS part, s_suppkey::VARCHAR AS a, '' AS b, '  n' || s_suppkey || '["' || {S.sub("s_name", (r'["\[\]{}<>|`]', " "))} || '"]' AS line FROM supplier
    UNION ALL SELECT DISTINCT diagram, 1, source::VARCHAR, target::VARCHAR, '  n' || source || ' --> n' || target FROM v_edges)
SELECT diagram, 'flowchart TD' || chr(10) || string_agg(line, chr(10) ORDER BY part, a, b) AS mermaid FROM n GROUP BY diagram""",
)
def diagram_mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _edges(spark, sf_dir)
    return V.to_mermaid(nodes, edges.select("diagram", "source", "target").distinct(), "diagram")


@query(
    "SNK11",
    f"""WITH {_DIAGRAMS}, n AS (SELECT s_suppkey % 5 AS diagram, 0 AS part, s_suppkey::VARCHAR AS a, '' AS b, 'package "' || {S.sub("s_name", (r'["\[\]{}<>|`]', " "))} || '" as n' || s_suppkey AS line FROM supplier
    UNION ALL SELECT DISTINCT diagram, 1, source::VARCHAR, target::VARCHAR, 'n' || source || ' ..> n' || target FROM v_edges)
SELECT diagram, '@startuml' || chr(10) || string_agg(line, chr(10) ORDER BY part, a, b) || chr(10) || '@enduml' AS plantuml FROM n GROUP BY diagram""",
)
def diagram_plantuml(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _edges(spark, sf_dir)
    return V.to_plantuml(nodes, edges.select("diagram", "source", "target").distinct(), "diagram")


_MANIFEST = f"""v_files AS (SELECT lang AS bundle, coalesce(nullif(substr({S.sub("source", (r"[^A-Za-z0-9._-]+", "-"), (r"^-+|-+$", ""))}, 1, 120), ''), 'item') AS stem, octet_length(encode(text))::BIGINT AS bytes, sha256(text) AS sha256 FROM documents),
v_manifest AS (SELECT bundle, 'documents/' || stem || CASE WHEN row_number() OVER w > 1 THEN '-' || row_number() OVER w ELSE '' END || '.md' AS path, bytes, sha256 FROM v_files WINDOW w AS (PARTITION BY bundle, stem ORDER BY sha256, bytes))"""


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.manifest(table(spark, sf_dir, "documents").withColumnRenamed("lang", "bundle"), "bundle", "source", "text")


@query("SNK08 SRC16", f"WITH {_MANIFEST} SELECT * FROM v_manifest")
def bundle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir)


@query(
    "SNK09 JN15",
    f"""WITH {_MANIFEST}, f AS (SELECT bundle, CASE WHEN bytes % 13 = 0 THEN path || '.bak' ELSE path END AS path, bytes + CASE WHEN bytes % 17 = 0 THEN 1 ELSE 0 END AS bytes, CASE WHEN bytes % 19 = 0 THEN 'x' ELSE sha256 END AS sha256 FROM v_manifest WHERE bytes % 11 <> 0)
SELECT * FROM (SELECT coalesce(a.bundle, b.bundle) AS bundle, coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'unlisted' WHEN a.bytes <> b.bytes THEN 'size' WHEN a.sha256 <> b.sha256 THEN 'digest' END AS problem FROM v_manifest a FULL JOIN f b ON a.bundle = b.bundle AND a.path = b.path) WHERE problem IS NOT NULL""",
)
def bundle_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _manifest(spark, sf_dir)
    size = F.col("bytes")
    found = listed.where(size % 11 != 0).select(
        "bundle", F.when(size % 13 == 0, F.concat("path", F.lit(".bak"))).otherwise(F.col("path")).alias("path"), (size + F.when(size % 17 == 0, 1).otherwise(0)).alias("bytes"), F.when(size % 19 == 0, "x").otherwise(F.col("sha256")).alias("sha256")
    )
    return B.verify(listed, found, "bundle")


_PAIRS = f"v_eval AS (SELECT item_id, {S.evaluation_text('b.text')} AS gold, {S.evaluation_text('d.text')} AS got FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)"


def _eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "benchmark").select("item_id", T.evaluation_text(F.col("text")).alias("gold"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), T.evaluation_text(F.col("text")).alias("got"))
    return gold.join(docs, "item_id")


# DuckDB's levenshtein works on bytes, so the oracle gives every other sign of its texts, which are lower case, a stand-in: the
# capitals and the signs that no text holds. One for one, so distances stay.
_OTHERS = "v_others AS (SELECT string_agg(c, '' ORDER BY c) AS c FROM (SELECT DISTINCT unnest(regexp_extract_all(gold || got, '[^\\x00-\\x7f]')) AS c FROM v_eval))"
_STAND_INS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(f"' || chr({i}) || '" for i in [*range(1, 9), *range(14, 32)])
_BYTES = lambda c: f"translate({c}, c, left('{_STAND_INS}', length(c)))"


@query("EV01", f"WITH {_PAIRS}, {_OTHERS}, a AS (SELECT item_id, {_BYTES('gold')} AS gold, {_BYTES('got')} AS got FROM v_eval, v_others) SELECT item_id, round(CASE WHEN length(gold) > 0 THEN levenshtein(gold, got) / length(gold) ELSE CASE WHEN length(got) > 0 THEN 1 ELSE 0 END END, 6)::DOUBLE AS error FROM a")
def character_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eval(spark, sf_dir).select("item_id", F.round(E.character_error_rate(F.col("gold"), F.col("got")), 6).alias("error"))


@query("EV01")
def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eval(spark, sf_dir).select("item_id", F.round(E.word_error_rate(F.col("gold"), F.col("got")), 6).alias("error"))


@query("EV02 JN09")
def reading_order_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    gold = turns.where("role = 'user'").select("conv_id", F.col("turn").cast("int").alias("gold_no"), T.evaluation_text(F.col("text")).alias("text"))
    gold = gold.join(gold.groupBy("conv_id").agg(F.min("gold_no").alias("m")), "conv_id").select("conv_id", F.floor((F.col("gold_no") - F.col("m")) / 2).cast("int").alias("gold_no"), "text")
    lines = turns.where("role = 'assistant'").select("conv_id", F.col("turn").cast("int").alias("line_no"), T.evaluation_text(F.col("text")).alias("text"))
    aligned = E.align_lines(gold, lines, "conv_id", accept=0.9)
    return E.reading_order_error(aligned, gold, "conv_id").select("conv_id", F.round("error", 6).alias("error"))


@query(
    "AG09 AG17 EV04",
    """SELECT o_orderpriority AS class, count(*)::BIGINT AS runs, median(round(o_totalprice * 100)::BIGINT)::DOUBLE AS median_cents, list_sort(list(round(o_totalprice * 100)::BIGINT))[count(*) // 2 + 1] AS upper_median_cents FROM orders GROUP BY o_orderpriority""",
)
def class_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("class"), cents.alias("cents"))
    # The upper median without holding a class in one array: the value at its place among counted values.
    counts = rows.groupBy("class", "cents").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy("class")
    placed = counts.withColumns({"upto": F.sum("n").over(w.orderBy("cents")), "all": F.sum("n").over(w)})
    upper = placed.where((F.col("upto") > F.floor(F.col("all") / 2)) & (F.col("upto") - F.col("n") <= F.floor(F.col("all") / 2))).select("class", F.col("cents").alias("upper_median_cents"))
    return rows.groupBy("class").agg(F.count("*").alias("runs"), F.median("cents").alias("median_cents")).join(upper, "class")


@query(
    "JN08 EV05 ST08",
    """WITH r AS (SELECT l_shipdate::DATE AS class, l_linenumber AS repeat, CASE WHEN l_returnflag = 'R' THEN 'browser' ELSE 'native' END AS mode, l_quantity AS latency FROM lineitem),
p AS (SELECT class, repeat, count(*) FILTER (mode = 'browser') AS b, count(*) FILTER (mode = 'native') AS c, max(latency) FILTER (mode = 'browser') AS bl, max(latency) FILTER (mode = 'native') AS cl FROM r GROUP BY ALL)
SELECT class, count(*)::BIGINT AS pairs, count(*) FILTER (cl < bl)::BIGINT AS wins, count(*) FILTER (cl < bl) >= ceil(count(*) * 2 / 3) AS promoted FROM p WHERE b = 1 AND c = 1 GROUP BY class""",
)
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("l_returnflag") == "R", "b").otherwise("c")
    runs = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("class"), F.col("l_linenumber").alias("repeat"), mode.alias("mode"), F.col("l_quantity").alias("latency"))
    pairs = runs.groupBy("class", "repeat").pivot("mode", ["b", "c"]).agg(F.count("latency").alias("n"), F.max("latency").alias("l")).where("b_n = 1 and c_n = 1")
    won = F.count_if(F.col("c_l") < F.col("b_l"))
    return pairs.groupBy("class").agg(F.count("*").alias("pairs"), won.alias("wins"), (won >= F.ceil(F.count("*") * 2 / 3)).alias("promoted"))


@query(
    "SRC04 GR01",
    """WITH RECURSIVE tree(root, pid, depth) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier UNION ALL SELECT t.root, s.s_suppkey, depth + 1 FROM tree t JOIN supplier s ON s.s_suppkey // 3 = t.pid AND s.s_suppkey <> t.pid)
SELECT root, count(*)::BIGINT AS processes, max(depth)::INT AS depth, sum(round(s_acctbal * 100)::BIGINT)::BIGINT AS total FROM tree JOIN supplier ON s_suppkey = pid GROUP BY root""",
)
def process_tree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemma.operators.trees import descendants

    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pid"), F.floor(F.col("s_suppkey") / 3).alias("parent"), F.round(F.col("s_acctbal") * 100).cast("long").alias("cents"))
    tree = descendants(rows.where("parent <> pid"), rows, "pid", "parent")
    return tree.join(rows.select("pid", "cents"), "pid").groupBy("root").agg(F.count("*").alias("processes"), F.max("depth").cast("int").alias("depth"), F.sum("cents").alias("total"))


@query(
    "SRC07",
    """WITH w AS (SELECT l_orderkey AS page, 1 + l_linenumber % 2 AS block, 1 AS par, 1 + l_suppkey % 3 AS line, l_linenumber AS word, (l_partkey % 97 - 3)::DOUBLE AS conf, CASE WHEN l_partkey % 31 = 0 THEN ' ' ELSE l_linestatus || l_linenumber END AS text, l_linenumber * 40.0 AS x0, 10.0 * (l_suppkey % 3) AS y0, CASE WHEN l_partkey % 23 = 0 THEN 4 ELSE 5 END AS level FROM lineitem)
SELECT page, block, par, line, string_agg(trim(text), ' ' ORDER BY word, trim(text)) AS text, min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, max(x0 + 30)::DOUBLE AS x1, max(y0 + 8)::DOUBLE AS y1, round(avg(conf) / 100, 6) AS confidence FROM w WHERE level = 5 AND conf >= 0 AND trim(text) <> '' GROUP BY page, block, par, line""",
)
def ocr_tsv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemma.sources.ocr import lines_from_words

    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    words = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), (n % 2 + 1).alias("block"), F.lit(1).alias("par"), (s % 3 + 1).alias("line"), n.alias("word"), (p % 97 - 3).cast("double").alias("conf"),
        F.when(p % 31 == 0, " ").otherwise(F.concat("l_linestatus", n)).alias("text"), (n * 40.0).alias("left"), (s % 3 * 10.0).alias("top"), F.lit(30.0).alias("width"), F.lit(8.0).alias("height"), F.when(p % 23 == 0, 4).otherwise(5).alias("level"),
    )
    return lines_from_words(words)


_TWICE = f"""{GEOMETRY_SQL},
v_twice AS (SELECT source, page, line_no, line AS text, 0 AS origin, x0, y0, x1, y1 FROM v_geom
    UNION ALL SELECT source, page, line_no, line, 1, x0 + line_no % 5 * 4, y0 + page % 3, x1 + line_no % 5 * 4, y1 + page % 3 FROM v_geom)"""


@query(
    "ST01 ST02 ST06",
    f"""WITH {_TWICE}, a AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM v_twice),
gone AS (SELECT b.source, b.page, b.line_no FROM a b JOIN a k ON k.source = b.source AND k.page = b.page AND k.text = b.text AND k.origin = 0 AND b.origin = 1
    WHERE least(b.area, k.area) > 0 AND greatest(0, least(b.x1, k.x1) - greatest(b.x0, k.x0)) * greatest(0, least(b.y1, k.y1) - greatest(b.y0, k.y0)) / least(b.area, k.area) >= 0.94)
SELECT source, page, line_no, origin FROM a WHERE origin = 0 OR NOT EXISTS (SELECT 1 FROM gone g WHERE g.source = a.source AND g.page = a.page AND g.line_no = a.line_no)""",
)
def block_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of one text on a page from two sources, one of which places lines up to 16 points further on: the first stays."""
    from stemma.operators.folds import greedy_dedupe

    placed = geometry_of(lines_of(pages(spark, sf_dir)))
    x, y = F.col("line_no") % 5 * 4, F.pmod("page", F.lit(3))
    box = lambda dx, dy: G.box(F.col("x0") + dx, F.col("y0") + dy, F.col("x1") + dx, F.col("y1") + dy)
    own = lambda origin, dx, dy: placed.select("source", "page", "line_no", F.col("line").alias("text"), F.lit(origin).alias("origin"), box(dx, dy).alias("box"))
    rows = own(0, F.lit(0), F.lit(0)).unionByName(own(1, x, y))
    return greedy_dedupe(rows, ["source", "page", "text"], ["origin", "line_no"]).select("source", "page", "line_no", "origin")
