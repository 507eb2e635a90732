"""Queries on boxes and page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.functions import geometry as G
from stemma.functions import patterns as P
from stemma.operators import layout as L
from stemma.plans import sql as S
from stemma.plans.registry import query
from stemma.sources.views import GEOMETRY_SQL, geometry_of, lines_of, pages, table


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry_of(lines_of(pages(spark, sf_dir)))


def _box(prefix: str = ""):
    return G.box(*(F.col(prefix + c) for c in ("x0", "y0", "x1", "y1")))


def _page_box():
    return G.box(F.lit(0), F.lit(0), F.lit(L.WIDTH), F.lit(L.HEIGHT))


_MEDIANS = f"""{GEOMETRY_SQL}, v_stats AS (SELECT source, page, list_sort(list(size))[len(list(size)) // 2 + 1] AS body, list_sort(list(y1 - y0))[len(list(y1)) // 2 + 1] AS line_height FROM v_geom GROUP BY source, page)"""


@query("AG08", f"WITH {_MEDIANS} SELECT source, page, body::INT AS body, line_height::INT AS line_height FROM v_stats")
def upper_median_line_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_stats(_placed(spark, sf_dir))


_COLUMNS = f"""{_MEDIANS},
v_narrow AS (SELECT * FROM v_geom WHERE x1 - x0 < 612 * 0.72 AND x1 > x0),
v_starts AS (SELECT source, page, x0, lead(x0) OVER (PARTITION BY source, page ORDER BY x0) - x0 AS gap FROM (SELECT DISTINCT source, page, x0 FROM v_narrow)),
v_cut AS (SELECT source, page, gap, x0 + gap / 2 AS split_at FROM (SELECT *, row_number() OVER (PARTITION BY source, page ORDER BY gap DESC, x0) AS r FROM v_starts WHERE gap IS NOT NULL) WHERE r = 1),
v_sides AS (SELECT n.source, n.page, count(*) AS n, any_value(gap) AS gap, any_value(split_at) AS split_at, count(*) FILTER (x0 < split_at) AS n_left, count(*) FILTER (x0 >= split_at) AS n_right,
    max(x1) FILTER (x0 < split_at) AS left_end, min(x0) FILTER (x0 >= split_at) AS right_start FROM v_narrow n LEFT JOIN v_cut c ON n.source = c.source AND n.page = c.page GROUP BY n.source, n.page),
v_reason AS (SELECT p.source, p.page, s.gap, s.split_at, CASE WHEN coalesce(s.n, 0) < 4 THEN 'insufficient-column-evidence'
    WHEN s.gap IS NULL OR s.gap < greatest(p.body * 3.5, 612 * 0.055) THEN 'single-column'
    WHEN n_left < greatest(2, floor(n * 0.18)) OR n_right < greatest(2, floor(n * 0.18)) THEN 'ambiguous-column-split'
    WHEN left_end - right_start > 612 * 0.025 THEN 'overlapping-column-evidence' ELSE 'stable-column-gutter' END AS reason FROM v_stats p LEFT JOIN v_sides s ON p.source = s.source AND p.page = s.page),
v_columns AS (SELECT source, page, CASE WHEN reason = 'stable-column-gutter' THEN 2 ELSE 1 END AS n_columns, CASE WHEN reason = 'stable-column-gutter' THEN split_at END::DOUBLE AS split_at,
    CASE WHEN reason = 'stable-column-gutter' THEN gap END::INT AS gutter, CASE reason WHEN 'stable-column-gutter' THEN round(least(1, 0.62 + least(0.28, gap / 612)), 6)
    WHEN 'insufficient-column-evidence' THEN 0.35 WHEN 'single-column' THEN 0.82 WHEN 'ambiguous-column-split' THEN 0.55 ELSE 0.48 END::DOUBLE AS confidence, reason FROM v_reason)"""


@query("WN11 QA03", f"WITH {_COLUMNS} SELECT * FROM v_columns")
def column_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.detect_columns(_placed(spark, sf_dir))
    return out.withColumns({"split_at": F.col("split_at").cast("double"), "gutter": F.col("gutter").cast("int"), "confidence": F.col("confidence").cast("double")})


_ORDER = f"""{_COLUMNS},
v_rows AS (SELECT g.*, n_columns, confidence AS column_confidence, reason, n_columns = 2 AND x1 - x0 >= 612 * 0.72 AS anchor, CASE WHEN n_columns = 2 AND (x0 + x1) / 2 > split_at THEN 1 ELSE 0 END AS column_no
    FROM v_geom g JOIN v_columns c ON g.source = c.source AND g.page = c.page),
v_anchors AS (SELECT *, row_number() OVER (PARTITION BY source, page ORDER BY y0, x0, line_no) - 1 AS i, lag(y1) OVER (PARTITION BY source, page ORDER BY y0, x0, line_no) AS lower FROM v_rows WHERE anchor),
v_section AS (SELECT r.*, CASE WHEN n_columns = 1 THEN 0 WHEN anchor THEN (SELECT i FROM v_anchors a WHERE a.source = r.source AND a.page = r.page AND a.line_no = r.line_no)
    ELSE coalesce((SELECT min(i) FROM v_anchors a WHERE a.source = r.source AND a.page = r.page AND r.y0 < a.y0 AND (a.lower IS NULL OR r.y0 >= a.lower)), 1000000) END AS section FROM v_rows r),
v_ordered AS (SELECT *, (row_number() OVER (PARTITION BY source, page ORDER BY section, anchor, CASE WHEN n_columns = 2 THEN column_no ELSE 0 END, y0, x0, line_no) - 1)::INT AS order_no FROM v_section)"""


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _placed(spark, sf_dir)
    return L.reading_order(placed, L.detect_columns(placed))


@query("WN12 SO01", f"WITH {_ORDER} SELECT source, page, line_no, order_no, column_no FROM v_ordered")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir).select("source", "page", "line_no", "order_no", "column_no")


_CLASSES = f"""{_ORDER},
v_around AS (SELECT o.*, s.body, s.line_height, trim(line) AS t, CASE WHEN o.page % 5 = 0 AND line_no = 0 THEN 'Times Bold' ELSE 'Times' END AS font,
    y0 - coalesce(lag(y1) OVER w, 0) AS above, coalesce(lead(y0) OVER w, 792) - y1 AS below, size / greatest(1, body) AS relative
    FROM v_ordered o JOIN v_stats s ON o.source = s.source AND o.page = s.page WINDOW w AS (PARTITION BY o.source, o.page ORDER BY order_no)),
v_scored AS (SELECT *, {S.hit("t", P.LIST_MARKER)} AS listed, regexp_extract(t, {S.q(P.NUMBERING)}, 1) AS number, round(CASE WHEN {S.hit("t", P.NUMBERING)} THEN 0.35 ELSE 0 END::DOUBLE + CASE WHEN {S.hit("font", "(?i)bold|semibold|black|title|heading")} THEN 0.2 ELSE 0 END
    + CASE WHEN relative >= 1.12 THEN 0.16 ELSE 0 END + CASE WHEN above > line_height * 1.35 OR below > line_height * 1.1 THEN 0.14 ELSE 0 END
    + CASE WHEN length(t) <= 180 AND NOT {S.hit("t", "[.!?]$")} THEN 0.1 ELSE 0 END + CASE WHEN abs((x0 + x1) / 2 - 306) < 612 * 0.08 THEN 0.05 ELSE 0 END, 2) AS score FROM v_around),
v_typed AS (SELECT *, CASE WHEN score >= 0.48 THEN 'heading' WHEN listed THEN 'list-item' WHEN {S.hit("t", P.CAPTION_MARKER)} THEN 'caption'
    WHEN {S.hit("t", P.FOOTNOTE_MARKER)} AND y0 > 792 * 0.72 AND size < body * 0.9 THEN 'footnote' WHEN {S.hit("t", r"^>\s+")} THEN 'quote'
    WHEN {S.hit("t", P.MATH_SIGN)} AND length(t) < 160 THEN 'equation' ELSE 'paragraph' END AS type,
    first(CASE WHEN listed THEN x0 END IGNORE NULLS) OVER (PARTITION BY source, page ORDER BY order_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first_x FROM v_scored),
v_sure AS (SELECT *, CASE type WHEN 'heading' THEN score WHEN 'list-item' THEN 0.86 WHEN 'caption' THEN 0.84 WHEN 'footnote' THEN 0.74 WHEN 'quote' THEN 0.82 WHEN 'equation' THEN 0.56 ELSE 0.58 END::DOUBLE AS own FROM v_typed),
v_classes AS (SELECT source, page, line_no, order_no, column_no, type,
    CASE WHEN type = 'heading' THEN greatest(1, least(6, CASE WHEN number <> '' THEN len(list_filter(string_split({S.sub("number", ("[.)]$", ""))}, '.'), lambda x: x <> '')) WHEN relative >= 1.55 THEN 1 WHEN relative >= 1.3 THEN 2 ELSE 3 END)) END::INT AS heading_level,
    CASE WHEN type = 'list-item' THEN greatest(0, coalesce(floor((x0 - first_x) / greatest(1, body * 2.2) + 0.5), 0)) END::INT AS list_level, score::DOUBLE AS score,
    CASE WHEN reason IN ('ambiguous-column-split', 'overlapping-column-evidence') THEN least(own, column_confidence) ELSE own END AS confidence FROM v_sure)"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    font = F.when((F.col("page") % 5 == 0) & (F.col("line_no") == 0), "Times Bold").otherwise("Times")
    return L.classify(_ordered(spark, sf_dir), font)


@query("WN13 WN14 TXT29", f"WITH {_CLASSES} SELECT *, CASE WHEN confidence < 0.6 THEN 'needs-review' ELSE 'reconstructed' END AS disposition FROM v_classes")
def block_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir)


@query(
    "AG05 AG06",
    f"""WITH {_CLASSES} SELECT source, page, type, count(*)::BIGINT AS blocks, count(*) FILTER (confidence < 0.6)::BIGINT AS doubtful, round(avg(confidence), 6) AS mean_confidence FROM v_classes GROUP BY source, page, type""",
)
def block_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).groupBy("source", "page", "type").agg(F.count("*").alias("blocks"), F.count_if(F.col("confidence") < 0.6).alias("doubtful"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(
    "AG04",
    f"""WITH {_CLASSES}, d AS (SELECT *, CASE WHEN confidence < 0.6 THEN 'needs-review' ELSE 'reconstructed' END AS disposition FROM v_classes)
SELECT source, type, disposition, count(*)::BIGINT AS n FROM d GROUP BY GROUPING SETS ((source, type), (source, disposition), (source))""",
)
def quality_report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified(spark, sf_dir)
    return rows.groupingSets([["source", "type"], ["source", "disposition"], ["source"]], "source", "type", "disposition").agg(F.count("*").alias("n")).select("source", "type", "disposition", "n")


_RUNS = f"""{GEOMETRY_SQL}, s AS (SELECT *, {S.code_signal("trim(line)")} AS signal FROM v_geom),
b AS (SELECT *, CASE WHEN signal > 0 AND (coalesce(lag(signal) OVER w, 0) = 0 OR y0 - lag(y0) OVER w > 31.0) THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY source, page ORDER BY line_no)),
i AS (SELECT *, sum(new) OVER (PARTITION BY source, page ORDER BY line_no) AS island FROM b WHERE signal > 0)"""


@query(
    "WN17 WN24",
    f"WITH {_RUNS} SELECT source, page, min(line_no)::INT AS first, max(line_no)::INT AS last, count(*)::BIGINT AS n, string_agg(trim(line), chr(10) ORDER BY line_no) AS text FROM i GROUP BY source, page, island HAVING count(*) >= 2 AND count(*) FILTER (signal >= 2) >= 2",
)
def code_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.code_runs(_placed(spark, sf_dir))


_CELLS = f"{GEOMETRY_SQL}, c AS (SELECT source, page, line_no, len(list_filter(string_split(line, '|'), lambda x: trim(x) <> ''))::INT AS n_cells FROM v_geom)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.size(F.filter(F.split("line", r"\|"), lambda x: F.trim(x) != ""))
    return lines_of(pages(spark, sf_dir)).select("source", "page", "line_no", cells.alias("n_cells"))


@query(
    "WN10 TB01",
    f"""WITH {_CELLS}, b AS (SELECT *, CASE WHEN n_cells >= 2 AND coalesce(lag(n_cells) OVER (PARTITION BY source, page ORDER BY line_no), 0) < 2 THEN 1 ELSE 0 END AS new FROM c),
i AS (SELECT *, sum(new) OVER (PARTITION BY source, page ORDER BY line_no) AS island FROM b WHERE n_cells >= 2),
r AS (SELECT source, page, min(line_no) AS first, max(line_no) AS last, list(n_cells) AS counts, list_sort(list(n_cells))[count(*) // 2 + 1] AS columns FROM i GROUP BY source, page, island)
SELECT source, page, first, last, columns FROM r WHERE len(counts) >= 3 AND columns BETWEEN 2 AND 8 AND len(list_filter(counts, lambda x: x = columns)) / len(counts) >= 0.75""",
)
def table_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.table_runs(_cells(spark, sf_dir))


@query(
    "AG12",
    f"""WITH {_CELLS}, f AS (SELECT source, page, n_cells, count(*)::BIGINT AS n, min(line_no) AS seen FROM c WHERE n_cells BETWEEN 2 AND 8 GROUP BY ALL)
SELECT source, page, n_cells AS columns, n FROM (SELECT *, row_number() OVER (PARTITION BY source, page ORDER BY n DESC, seen) AS r FROM f) WHERE r = 1""",
)
def modal_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _cells(spark, sf_dir).where(F.col("n_cells").between(2, 8)).groupBy("source", "page", "n_cells").agg(F.count("*").alias("n"), F.min("line_no").alias("seen"))
    best = F.max_by(F.struct("n_cells", "n"), F.struct("n", (-F.col("seen")).alias("first")))
    return counts.groupBy("source", "page").agg(best.alias("b")).select("source", "page", F.col("b.n_cells").alias("columns"), F.col("b.n").alias("n"))


@query(
    "WN06",
    """WITH v AS (SELECT c_nationkey, round(c_acctbal * 100)::BIGINT AS cents FROM customer),
b AS (SELECT *, CASE WHEN cents - lag(cents) OVER (PARTITION BY c_nationkey ORDER BY cents) > 20000 THEN 1 ELSE 0 END AS new FROM v),
k AS (SELECT *, sum(new) OVER (PARTITION BY c_nationkey ORDER BY cents) AS cluster_no FROM b)
SELECT c_nationkey, cluster_no::BIGINT AS cluster_no, count(*)::BIGINT AS n, min(cents) AS low, max(cents) AS high, sum(cents)::BIGINT AS total FROM k GROUP BY c_nationkey, cluster_no""",
)
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "customer").select("c_nationkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    return L.gap_clusters(values, ["c_nationkey"], "cents", 20000)


_WORDS = """w AS (SELECT o_orderkey AS page, l_linenumber AS line_no, o_orderpriority AS text, ((l_linenumber * 37 + l_partkey % 5 * 31) % 400)::DOUBLE AS x0, (l_linenumber * 37 + l_partkey % 5 * 31) % 400 + 6.0 * length(o_orderpriority) AS x1,
    100.0 AS y0, 100.0 + 8 + l_suppkey % 5 AS y1, (40 + l_partkey % 60)::DOUBLE AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(
    "WN22 TB05 SRC08",
    f"""WITH {_WORDS}, g AS (SELECT * FROM w WHERE confidence >= 58 AND text <> '' AND x1 > x0 AND y1 > y0),
h AS (SELECT page, list_sort(list(y1 - y0))[count(*) // 2 + 1] AS height FROM g GROUP BY page),
b AS (SELECT g.*, CASE WHEN x0 - lag(x1) OVER (PARTITION BY g.page ORDER BY x0, line_no) > greatest(10, height * 1.15) THEN 1 ELSE 0 END AS new FROM g JOIN h USING (page)),
k AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY x0, line_no) AS cell_no FROM b)
SELECT page, cell_no::BIGINT AS cell_no, string_agg(text, ' ' ORDER BY x0, line_no) AS text, min(x0) AS x0, max(x1) AS x1, min(y0)::DOUBLE AS y0, max(y1) AS y1, min(confidence) AS confidence FROM k GROUP BY page, cell_no""",
)
def ocr_word_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    x0 = (F.col("l_linenumber") * 37 + F.col("l_partkey") % 5 * 31) % 400
    words = rows.select(
        F.col("o_orderkey").alias("page"), F.col("l_linenumber").alias("word_no"), F.col("o_orderpriority").alias("text"), x0.cast("double").alias("x0"), (x0 + 6.0 * F.length("o_orderpriority")).alias("x1"),
        F.lit(100.0).alias("y0"), (F.lit(108.0) + F.col("l_suppkey") % 5).alias("y1"), (F.lit(40) + F.col("l_partkey") % 60).cast("double").alias("confidence"),
    )
    return L.word_cells(words, ["page"])


_PAIRS = f"""{GEOMETRY_SQL}, p AS (SELECT source, page, line_no, x0, y0, x1, y1, lead(x0) OVER w AS bx0, lead(y0) OVER w AS by0, lead(x1) OVER w AS bx1, lead(y1) OVER w AS by1 FROM v_geom WINDOW w AS (PARTITION BY source, page ORDER BY line_no)),
a AS (SELECT *, greatest(0, least(x1, bx1) - greatest(x0, bx0)) * greatest(0, least(y1 + 6, by1) - greatest(y0, by0)) AS shared, (x1 - x0) * (y1 + 6 - y0) AS one, (bx1 - bx0) * (by1 - by0) AS two FROM p WHERE bx0 IS NOT NULL)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line, six points taller, and the next."""
    order = Window.partitionBy("source", "page").orderBy("line_no")
    rows = _placed(spark, sf_dir).withColumn("b", F.lead(_box()).over(order)).where("b is not null")
    return rows.withColumn("a", G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1") + 6))


@query(
    "GEO03 GEO04 GEO05",
    f"""WITH {_PAIRS} SELECT source, page, line_no, round(CASE WHEN least(one, two) > 0 THEN shared / least(one, two) ELSE 0 END, 6)::DOUBLE AS overlap,
round(CASE WHEN least(y1 + 6 - y0, by1 - by0) > 0 THEN greatest(0, least(y1 + 6, by1) - greatest(y0, by0)) / least(y1 + 6 - y0, by1 - by0) ELSE 0 END, 6)::DOUBLE AS vertical,
round(CASE WHEN least(x1 - x0, bx1 - bx0) > 0 THEN greatest(0, least(x1, bx1) - greatest(x0, bx0)) / least(x1 - x0, bx1 - bx0) ELSE 0 END, 6)::DOUBLE AS horizontal,
shared / greatest(1, two) >= 0.1 AND least(greatest(1, one), greatest(1, two)) / greatest(one, two, 1) >= 0.62 AS covered FROM a""",
)
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, sf_dir).select(
        "source", "page", "line_no", F.round(G.overlap_ratio(a, b), 6).alias("overlap"), F.round(G.vertical_overlap(a, b), 6).alias("vertical"), F.round(G.horizontal_overlap(a, b), 6).alias("horizontal"), G.covers(a, b, 0.1).alias("covered")
    )


@query(
    "GEO01 GEO02 GEO06 GEO07",
    f"""WITH {GEOMETRY_SQL}, u AS (SELECT source, page, min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, max(x1)::DOUBLE AS x1, max(y1)::DOUBLE AS y1 FROM v_geom GROUP BY source, page)
SELECT source, page, x0, y0, x1, y1, round(x0 / 612, 6) AS nx0, round(y1 / 792, 6) AS ny1, greatest(0, x0 - 100) AS px0, least(612, x1 + 100) AS px1 FROM u""",
)
def page_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = [F.min(c).alias(c) for c in ("x0", "y0")] + [F.max(c).alias(c) for c in ("x1", "y1")]
    rows = _placed(spark, sf_dir).groupBy("source", "page").agg(*least).withColumn("b", _box())
    rows = rows.withColumns({"n": G.normalised(F.col("b"), _page_box()), "p": G.padded(F.col("b"), _page_box(), 100)})
    return rows.select("source", "page", "b.x0", "b.y0", "b.x1", "b.y1", F.col("n.x0").alias("nx0"), F.col("n.y1").alias("ny1"), F.col("p.x0").alias("px0"), F.col("p.x1").alias("px1"))


@query(
    "GEO08 GEO09 GEO10 GEO11 GEO12",
    f"""WITH {_PAIRS} SELECT source, page, line_no, least(x1, bx1) - greatest(x0, bx0) > 0 OR abs((x0 + x1) / 2 - (bx0 + bx1) / 2) <= greatest(80, (x1 - x0) * 0.45) AS affine,
greatest(0, greatest(y0, by0) - least(y1 + 6, by1))::DOUBLE AS distance, round(sqrt(greatest(bx0 - 300, 0, 300 - bx1) ** 2 + greatest(by0 - 400, 0, 400 - by1) ** 2), 6) AS reach, (x0 * 2)::DOUBLE AS sx0, (y1 + 6) * 0.5 AS sy1, (x0 - 20)::DOUBLE AS mx0, (y0 + 30)::DOUBLE AS my1 FROM a""",
)
def box_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    scaled = G.scaled(a, F.lit(2.0), F.lit(0.5))
    mapped = G.from_matrix(F.lit(10.0), F.lit(0.0), F.lit(-20.0), F.lit(30.0), a["x0"], a["y0"])
    return _pairs(spark, sf_dir).select(
        "source", "page", "line_no", G.affine(a, b, 10).alias("affine"), G.vertical_distance(a, b).alias("distance"), F.round(G.point_distance(F.lit(300.0), F.lit(400.0), b), 6).alias("reach"),
        scaled["x0"].alias("sx0"), scaled["y1"].alias("sy1"), mapped["x0"].alias("mx0"), mapped["y1"].alias("my1"),
    )
