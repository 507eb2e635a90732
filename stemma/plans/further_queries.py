"""Further queries: checkpoints, contracts, exports, ordered folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.functions import geometry as G
from stemma.functions import patterns as P
from stemma.functions import text as T
from stemma.operators import blocks as BL
from stemma.operators import bundle as B
from stemma.operators import folds as FO
from stemma.operators import layout as L
from stemma.operators import markdown as M
from stemma.operators import running as R
from stemma.operators import visuals as V
from stemma.plans import sql as S
from stemma.plans.layout_queries import _ORDER, _ordered
from stemma.plans.registry import query
from stemma.plans.text_queries import _DECIDED, _decisions
from stemma.sources.views import GEOMETRY_SQL, LINES_SQL, geometry_of, lines_of, pages, table

_UPPER, _DENSE = S.upper_share("v"), f"length({S.sub('v', (chr(92) + 'P{L}', ''))}) / greatest(1, length(v))"
_NUMBERED = r"^(\d+(?:\.\d+){0,5})\.?\s+(.+)$"
_BARE_PAGE = r"\s+\d{1,4}\s*$"
_MATHY = r"[=<>≤≥≠≈+\-−×÷√∑∫∏∞∈∪∩^_/\\]"


def _ocr_level(v):
    """Heading level of a recognised line, on stricter evidence than for a printed one."""
    number, title = F.regexp_extract(v, _NUMBERED, 1), F.trim(F.regexp_replace(F.trim(F.regexp_extract(v, _NUMBERED, 2)), _BARE_PAGE, ""))
    upper = lambda c: F.coalesce(T.upper_share(c), F.lit(0.0))
    words = F.regexp_extract_all(v, F.lit(r"\p{L}+"), F.lit(0))
    letters = F.length(F.regexp_replace(v, r"\P{L}", ""))
    bad = (title == "") | (F.length(title) > 130) | (F.size(T.words(title)) > 16) | title.rlike("[.!?;:]$") | title.rlike(r"^[^:]{1,55}:\s+\S") | title.rlike(P.TITLE_VERB) | (~F.contains(number, F.lit(".")) & (upper(title) < 0.72))
    short = v.rlike(r"^[A-Z]{1,6}$")
    plain = (F.length(v) <= 90) & (F.size(words) <= 14) & (letters / F.greatest(F.lit(1), F.length(v)) >= 0.55) & ((F.size(words) != 1) | (F.length(F.get(words, F.lit(0))) >= 7)) & (upper(v) > 0.82)
    return (
        F.when(v.rlike(_NUMBERED), F.when(~bad, F.least(F.lit(6), F.size(F.split(number, r"\.")))))
        .when(v.rlike(r"(?i)^(?:chapter|appendix)\s+(?:\d+|[ivxlcdm]+)\b") | v.rlike(r"(?i)^(?:contents|list of (?:figures|tables)|preface|references|index)$"), 1)
        .when(v.rlike(_MATHY) | short, None)
        .when(plain, 1)
    )


_TITLE = f"trim({S.sub(f'trim(regexp_extract(v, {S.q(_NUMBERED)}, 2))', (_BARE_PAGE, ''))})"
_NUM = f"regexp_extract(v, {S.q(_NUMBERED)}, 1)"


@query(
    "TXT09",
    f"""WITH {LINES_SQL}, t AS (SELECT source, page, line_no, trim(line) AS v FROM v_lines)
SELECT source, page, line_no, CASE WHEN {S.hit("v", _NUMBERED)} THEN CASE WHEN NOT ({_TITLE} = '' OR length({_TITLE}) > 130 OR len({S.words(_TITLE)}) > 16 OR {S.hit(_TITLE, "[.!?;:]$")} OR {S.hit(_TITLE, r"^[^:]{1,55}:\s+\S")} OR {S.hit(_TITLE, P.TITLE_VERB)}
    OR (NOT contains({_NUM}, '.') AND coalesce({S.upper_share(_TITLE)}, 0) < 0.72)) THEN least(6, len(string_split({_NUM}, '.'))) END
WHEN {S.hit("v", r"(?i)^(?:chapter|appendix)\s+(?:\d+|[ivxlcdm]+)\b")} OR {S.hit("v", r"(?i)^(?:contents|list of (?:figures|tables)|preface|references|index)$")} THEN 1
WHEN {S.hit("v", _MATHY)} OR {S.hit("v", "^[A-Z]{1,6}$")} THEN NULL
WHEN length(v) <= 90 AND {S.count("v", r"\p{L}+")} <= 14 AND {_DENSE} >= 0.55 AND ({S.count("v", r"\p{L}+")} <> 1 OR length(regexp_extract(v, '\\p{{L}}+')) >= 7) AND coalesce({_UPPER}, 0) > 0.82 THEN 1 END::INT AS level FROM t""",
)
def ocr_heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(pages(spark, sf_dir)).select("source", "page", "line_no", _ocr_level(F.trim("line")).cast("int").alias("level"))


@query(
    "TXT18",
    f"""WITH {LINES_SQL}, f AS (SELECT *, {S.hit("line", P.FENCE_LINE)} OR coalesce(sum(CASE WHEN {S.hit("line", P.FENCE_LINE)} THEN 1 ELSE 0 END) OVER (PARTITION BY source, page ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS code FROM v_lines)
SELECT source, page, string_agg(line, chr(10) ORDER BY line_no) AS text FROM f WHERE code OR NOT ({S.hit("line", P.PAGE_MARKER)} OR line LIKE '[SOURCE_VISUAL%') GROUP BY source, page""",
)
def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("source", "page").orderBy("line_no")
    lines = lines_of(pages(spark, sf_dir)).withColumn("code", M.in_fence(by))
    kept = lines.where(F.col("code") | ~(F.col("line").rlike(P.PAGE_MARKER) | F.col("line").startswith("[SOURCE_VISUAL")))
    return kept.groupBy("source", "page").agg(M.ordered_text(["line_no"]).alias("text"))


_METHODS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BL.METHODS.items())


@query(
    "TXT27",
    f"""WITH k AS (SELECT p_partkey, (['heading', 'paragraph', 'list', 'table', 'figure', 'equation', 'caption', 'other'])[p_size % 8 + 1] AS kind, CASE WHEN p_partkey % 9 = 0 THEN 'tesseract-ocr' WHEN p_partkey % 10 = 0 THEN '' END AS given, CASE WHEN p_partkey % 4 = 0 THEN p_retailprice / 1000 END AS c FROM part),
m AS (SELECT *, coalesce(nullif(given, ''), CASE kind {_METHODS} ELSE 'layout-text' END) AS method FROM k)
SELECT p_partkey, method, CASE WHEN c IS NOT NULL THEN greatest(0, least(1, c)) WHEN regexp_matches(method, '(?i)ocr') THEN 0.72 ELSE 0.5 END::DOUBLE AS confidence,
CASE WHEN c IS NOT NULL THEN 'extractor' WHEN regexp_matches(method, '(?i)ocr') THEN 'ocr-default' WHEN regexp_matches(method, '(?i)source-preservation|fallback') THEN 'preservation-default' WHEN kind IN ('heading', 'table', 'equation') THEN 'unvalidated-default' ELSE 'not-provided' END AS origin FROM m""",
)
def extraction_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kinds = F.col("p_partkey"), F.array(*map(F.lit, ("heading", "paragraph", "list", "table", "figure", "equation", "caption", "other")))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.element_at(kinds, (F.col("p_size") % 8 + 1).cast("int")).alias("kind"), F.when(k % 9 == 0, "tesseract-ocr").when(k % 10 == 0, "").alias("given"), F.when(k % 4 == 0, F.col("p_retailprice") / 1000).alias("c")
    )
    rows = rows.withColumn("method", BL.extraction_method(F.col("kind"), F.col("given"))).withColumn("x", BL.confidence(F.col("kind"), F.col("method"), F.col("c")))
    return rows.select("p_partkey", "method", F.col("x.value").alias("confidence"), F.col("x.source").alias("origin"))


@query(
    "SNK05",
    """WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS revision FROM events)
SELECT user_id, event_type, event_id, revision FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM e WHERE revision >= 10) WHERE r = 1""",
)
def latest_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("revision", F.get_json_object("props", "$.k").cast("int")).where("revision >= 10")
    return rows.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "revision"), F.struct("ts", "event_id")).alias("m")).select("user_id", "event_type", "m.*")


@query("SNK04", "SELECT doc_id, base64(encode(text)) AS content, lower(hex(encode(lang))) AS tag FROM documents")
def workspace_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "[\r\n]", "").alias("content"), F.lower(F.hex(F.encode("lang", "UTF-8"))).alias("tag"))


@query(
    "SNK10 VAL12",
    """WITH m AS (SELECT o_orderpriority AS chart, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f FROM orders GROUP BY ALL)
SELECT chart, '{"$schema":"https://vega.github.io/schema/vega-lite/v5.json","data":{"values":[' || string_agg('{"month":"' || month || '","orders":' || n || ',"finished":' || f || '}', ',' ORDER BY month) || ']},"mark":"bar","encoding":{"x":{"field":"month","type":"temporal"},"y":{"field":"orders","type":"quantitative"}},"title":"' || chart || '"}' AS vega, count(*)::BIGINT AS rows, 'month,orders,finished' || chr(10) || string_agg(month || ',' || n || ',' || f, chr(10) ORDER BY month) AS csv, bool_and(try_cast(month || '-01' AS DATE) IS NOT NULL AND n >= f) AS valid FROM m GROUP BY chart""",
)
def chart_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("chart"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    line = F.concat_ws(",", T.escape_csv(F.col("month")), "n", "f")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("month", line.alias("line")))), lambda x: x["line"]), "\n")
    good = F.try_to_timestamp(F.concat("month", F.lit("-01"))).isNotNull() & (F.col("n") >= F.col("f"))
    value = F.struct("month", F.col("n").alias("orders"), F.col("f").alias("finished"))
    grouped = months.groupBy("chart").agg(F.count("*").alias("rows"), F.concat(F.lit("month,orders,finished\n"), body).alias("csv"), F.bool_and(good).alias("valid"), F.array_sort(F.collect_list(value)).alias("values"))
    field = lambda name, kind: F.struct(F.lit(name).alias("field"), F.lit(kind).alias("type"))
    schema = F.lit("https://vega.github.io/schema/vega-lite/v5.json").alias("$schema")
    encoding = F.struct(field("month", "temporal").alias("x"), field("orders", "quantitative").alias("y"))
    spec = F.struct(schema, F.struct("values").alias("data"), F.lit("bar").alias("mark"), encoding.alias("encoding"), F.col("chart").alias("title"))
    return grouped.withColumn("vega", F.to_json(spec)).drop("values")


_PATHS = "v_paths AS (SELECT p_mfgr_like AS bundle, path, p_size::BIGINT AS bytes FROM (SELECT p_brand AS p_mfgr_like, (['docs/', '/', '../', 'a//b/', 'C:', 'ok/./', 'x\\'])[p_size % 7 + 1] || replace(p_name, ' ', '_') AS path, p_size FROM part))"


@query(
    "VAL09",
    f"""WITH {_PATHS} SELECT bundle, path, NOT regexp_matches(path, '^/|\\\\|^[A-Za-z]:|[\\x00-\\x1f]') AND len(list_filter(string_split(path, '/'), lambda p: p IN ('', '.', '..'))) = 0 AND count(*) OVER (PARTITION BY bundle) <= 4096 AND sum(bytes) OVER (PARTITION BY bundle) <= 805306368 AS safe FROM v_paths""",
)
def bundle_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.array(*map(F.lit, ("docs/", "/", "../", "a//b/", "C:", "ok/./", "x\\")))
    path = F.concat(F.element_at(starts, (F.col("p_size") % 7 + 1).cast("int")), F.replace("p_name", F.lit(" "), F.lit("_")))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("bundle"), path.alias("path"), F.col("p_size").cast("long").alias("bytes"))
    return B.unsafe_paths(rows, "bundle").select("bundle", "path", "safe")


_UNSAFE = r"(?i)\b(?:javascript|vbscript|file|data):|<script\b|<foreignObject\b|\bon[a-z]+\s*="


@query("VAL10", f"SELECT page_id, {S.hit('html', _UNSAFE)} AS unsafe, octet_length(encode(html)) > 262144 AS too_long FROM pages")
def visual_source_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.col("html").rlike(_UNSAFE).alias("unsafe"), (F.octet_length("html") > 262144).alias("too_long"))


@query(
    "VAL08 VAL07",
    """SELECT s_suppkey, s_nationkey % 3 = 1 AS same_major, CASE WHEN s_nationkey % 3 = 1 THEN least(s_suppkey % 10, 6) END::BIGINT AS minor, s_suppkey % 17 BETWEEN 1 AND 16 AND s_acctbal BETWEEN 0 AND 9000 AS chunk_ok FROM supplier""",
)
def protocol_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    major = F.col("s_nationkey") % 3 == 1
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", major.alias("same_major"), F.when(major, F.least(F.col("s_suppkey") % 10, F.lit(6))).cast("long").alias("minor"), ((F.col("s_suppkey") % 17).between(1, 16) & F.col("s_acctbal").between(0, 9000)).alias("chunk_ok")
    )


@query("VAL01")
def structured_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = [(-1, '{"__proto__": 1}'), (-2, "[" * 40 + "]" * 40), (-3, "{oops"), (-4, '{"a": [NaN]}'), (-5, None)]
    rows = table(spark, sf_dir, "events").select("event_id", "props").unionByName(spark.createDataFrame(bad, "event_id long, props string"))
    return FO.safe_json(rows, ["event_id"], "props")


@query(
    "JN05 AG10",
    f"""WITH {_DECIDED}, c AS (SELECT source, page, count(*) AS n FROM v_decided WHERE action = 'REMOVE' GROUP BY ALL)
SELECT p.source, p.page, coalesce(n, 0)::BIGINT AS removed, {S.count("text", r"\[SOURCE_VISUAL")}::INT AS preserved, {S.count("text", "(?i)figure")}::INT AS detected FROM v_pages p LEFT JOIN c ON p.source = c.source AND p.page = c.page""",
)
def page_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = _decisions(pages(spark, sf_dir)).where("action = 'REMOVE'").groupBy("source", "page").agg(F.count("*").alias("n"))
    rows = pages(spark, sf_dir).join(removed, ["source", "page"], "left")
    return rows.select("source", "page", F.coalesce("n", F.lit(0)).alias("removed"), T.count_of(F.col("text"), r"\[SOURCE_VISUAL").alias("preserved"), T.count_of(F.col("text"), "(?i)figure").alias("detected"))


@query("JN14", "SELECT event_id, user_id FROM events w WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'purchase' AND r.user_id = w.user_id AND r.ts > w.ts)")
def open_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    # The latest success of a user decides, so no pairs of events are formed.
    last = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("recovered"))
    return events.where("event_type = 'error'").join(last, "user_id", "left").where("recovered is null or ts >= recovered").select("event_id", "user_id")


@query(
    "QA02",
    f"""WITH {_ORDER}, o AS (SELECT source, page, round(count(*) FILTER (order_no = nth - 1) / count(*), 3)::DOUBLE AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY source, page ORDER BY line_no) AS nth FROM v_ordered) GROUP BY source, page) SELECT * FROM o""",
)
def reading_order_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("source", "page").orderBy("line_no")) - 1
    rows = _ordered(spark, sf_dir).withColumn("nth", nth)
    return rows.groupBy("source", "page").agg(F.round(F.count_if(F.col("order_no") == F.col("nth")) / F.count("*"), 3).alias("accuracy"))


@query(
    "SO03 SO04 EQ15",
    f"""WITH {GEOMETRY_SQL} SELECT source, page, line_no, rank FROM (SELECT *, row_number() OVER (PARTITION BY source, page ORDER BY (x1 - x0) * (y1 - y0) DESC, line_no)::INT AS rank FROM v_geom WHERE x1 > x0) WHERE rank <= 4""",
)
def largest_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = geometry_of(lines_of(pages(spark, sf_dir))).where("x1 > x0")
    area = G.area(G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    return V.ranked(placed, ["source", "page"], [area.desc(), F.col("line_no")], 4).select("source", "page", "line_no", "rank")


@query(
    "WN08 WN09",
    f"""WITH {GEOMETRY_SQL}, b AS (SELECT *, CASE WHEN lag(line_no) OVER w IS NULL OR {S.hit("line", P.LIST_ITEM)} OR {S.hit("line", r"^#{1,6}\s")} OR {S.hit("lag(line) OVER w", r"^#{1,6}\s")} OR y0 - lag(y1) OVER w > 9 OR abs(x0 - lag(x0) OVER w) > 60 OR {S.hit("lag(line) OVER w", "[.!?]$")} THEN 1 ELSE 0 END AS new FROM v_geom WINDOW w AS (PARTITION BY source, page ORDER BY line_no)),
p AS (SELECT *, sum(new) OVER (PARTITION BY source, page ORDER BY line_no) AS paragraph FROM b)
SELECT source, page, paragraph::BIGINT AS paragraph, min(line_no)::INT AS first, count(*)::BIGINT AS lines, string_agg(trim(line), ' ' ORDER BY line_no) AS text FROM p GROUP BY source, page, paragraph""",
)
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("source", "page").orderBy("line_no")
    line, before = F.col("line"), F.lag("line").over(by)
    new = before.isNull() | line.rlike(P.LIST_ITEM) | line.rlike(r"^#{1,6}\s") | before.rlike(r"^#{1,6}\s") | (F.col("y0") - F.lag("y1").over(by) > 9) | (F.abs(F.col("x0") - F.lag("x0").over(by)) > 60) | before.rlike("[.!?]$")
    rows = geometry_of(lines_of(pages(spark, sf_dir))).withColumn("new", F.when(new, 1).otherwise(0)).withColumn("paragraph", F.sum("new").over(by)).withColumn("line", F.trim("line"))
    return rows.groupBy("source", "page", "paragraph").agg(F.min("line_no").alias("first"), F.count("*").alias("lines"), M.ordered_text(["line_no"], separator=" ").alias("text"))


_DRAWN = r"(?:\+[-=]{3,}\+|[-=]{4,}|_{4,}|\|.*\|)"


@query(
    "WN16",
    f"""WITH {GEOMETRY_SQL}, d AS (SELECT *, {S.hit("line", _DRAWN)} AS drawn, row_number() OVER (PARTITION BY source, page ORDER BY line_no) AS i FROM v_geom),
g AS (SELECT *, i - row_number() OVER (PARTITION BY source, page ORDER BY line_no) AS island FROM d WHERE drawn)
SELECT source, page, min(line_no)::INT AS first, max(line_no)::INT AS last, count(*)::BIGINT AS n, string_agg(line, chr(10) ORDER BY line_no) AS text FROM g GROUP BY source, page, island HAVING count(*) >= 2""",
)
def diagram_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of drawn lines, two of them plainly drawn."""
    drawn = F.col("line").rlike(_DRAWN)
    rows = L.islands(geometry_of(lines_of(pages(spark, sf_dir))), ["source", "page"], "line_no", drawn).where("island is not null")
    return rows.groupBy("source", "page", "island").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.count("*").alias("n"), M.ordered_text(["line_no"]).alias("text")).where("n >= 2").drop("island")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = geometry_of(lines_of(pages(spark, sf_dir)))
    words = placed.select("source", "page", "line_no", "y0", "x0", F.posexplode(T.words(F.trim("line"))).alias("i", "text"))
    x = F.col("x0") + F.col("i") * 40.0
    return words.select("source", "page", (F.col("line_no") * 100_000 + F.col("i")).cast("long").alias("no"), "text", x.alias("x0"), F.col("y0").cast("double").alias("y0"), (x + 35).alias("x1"), (F.col("y0") + 10.0 + F.col("i") % 3).alias("y1"))


def _packed_spans(spark: SparkSession, sf_dir: str, keep=None) -> DataFrame:
    """The same spans, those of a line as arrays in one row, and a page's lines one after the other: geometry_of() has a page in one
    partition. keep: of the place of a word in its line, whether it stays."""
    placed = geometry_of(lines_of(pages(spark, sf_dir))).sortWithinPartitions("source", "page", "line_no")
    rows = placed.select("source", "page", "line_no", F.col("x0").alias("left"), F.col("y0").cast("double").alias("top"), T.words(F.trim("line")).alias("w"))
    places = F.transform("w", lambda _, i: i)
    rows = rows.select("*", (F.filter(places, keep) if keep else places).alias("at"))
    each = lambda f: F.transform("at", f)
    x = lambda i: F.col("left") + i * 40.0
    return rows.select(
        "source", "page", "line_no", each(lambda i: (F.col("line_no") * 100_000 + i).cast("long")).alias("no"), each(lambda i: F.get("w", i)).alias("text"),
        each(x).alias("x0"), each(lambda i: F.col("top")).alias("y0"), each(lambda i: x(i) + 35).alias("x1"), each(lambda i: F.col("top") + 10.0 + i % 3).alias("y1"),
    )


_SPANS = f"""{GEOMETRY_SQL},
v_spans AS (SELECT source, page, line_no::BIGINT * 100000 + i AS no, line_no, text, (x0 + i * 40)::DOUBLE AS x0, y0::DOUBLE AS y0, (x0 + i * 40 + 35)::DOUBLE AS x1, (y0 + 10 + i % 3)::DOUBLE AS y1
    FROM (SELECT *, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS i FROM (SELECT *, {S.words("trim(line)")} AS w FROM v_geom)))"""


@query(
    "WN03",
    f"""WITH RECURSIVE {_SPANS}, s AS (SELECT *, row_number() OVER (PARTITION BY source, page ORDER BY y0, x0, no) AS i FROM v_spans),
f AS (SELECT source, page, 0::BIGINT AS i, NULL::DOUBLE AS x0, NULL::DOUBLE AS x1, NULL::BIGINT AS slot, []::STRUCT(a DOUBLE, b DOUBLE)[] AS bands FROM s GROUP BY source, page
    UNION ALL SELECT source, page, i, x0, x1, slot, CASE WHEN slot > len(bands) THEN list_append(bands, struct_pack(a := y0, b := y1))
        ELSE list_concat(list_concat(bands[:slot - 1], [struct_pack(a := least(bands[slot].a, y0), b := greatest(bands[slot].b, y1))]), bands[slot + 1:]) END
    FROM (SELECT s.source, s.page, s.i, s.x0, s.x1, s.y0, s.y1, f.bands, coalesce(list_position(list_transform(f.bands, lambda x: least(x.b - x.a, s.y1 - s.y0) > 0 AND (least(x.b, s.y1) - greatest(x.a, s.y0)) / least(x.b - x.a, s.y1 - s.y0) >= 0.5), true), len(f.bands) + 1)::BIGINT AS slot
        FROM f JOIN s ON s.source = f.source AND s.page = f.page AND s.i = f.i + 1))
SELECT source, page, slot - 1 AS line_no, count(*)::BIGINT AS spans, min(x0) AS x0, max(x1) AS x1 FROM f WHERE slot IS NOT NULL GROUP BY source, page, slot""",
)
def span_line_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.spans_to_lines(_spans(spark, sf_dir), ["source", "page"]).groupBy("source", "page", "line_no").agg(F.count("*").alias("spans"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


_JOINED = "s.x0 + 4.5 >= f.x0 AND greatest(0, s.x0 - f.x1, f.x0 - s.x1) <= 8.5 AND ((least(s.y1 - s.y0, f.y1 - f.y0) > 0 AND (least(s.y1, f.y1) - greatest(s.y0, f.y0)) / least(s.y1 - s.y0, f.y1 - f.y0) >= 0.2) OR abs(s.y1 - f.y1) <= 4.2)"


@query(
    "WN01",
    f"""WITH RECURSIVE {_SPANS}, s AS (SELECT *, row_number() OVER (PARTITION BY source, page ORDER BY no) AS i FROM v_spans WHERE trim(text) <> ''),
f AS (SELECT source, page, i, no, text, x0, y0, x1, y1 FROM s WHERE i = 1
    UNION ALL SELECT s.source, s.page, s.i, CASE WHEN {_JOINED} THEN f.no ELSE s.no END, CASE WHEN {_JOINED} THEN f.text || CASE WHEN s.x0 - f.x1 <= 1 OR f.text LIKE '% ' THEN '' ELSE ' ' END || s.text ELSE s.text END,
        CASE WHEN {_JOINED} THEN least(f.x0, s.x0) ELSE s.x0 END, CASE WHEN {_JOINED} THEN least(f.y0, s.y0) ELSE s.y0 END, CASE WHEN {_JOINED} THEN greatest(f.x1, s.x1) ELSE s.x1 END, CASE WHEN {_JOINED} THEN greatest(f.y1, s.y1) ELSE s.y1 END
    FROM f JOIN s ON s.source = f.source AND s.page = f.page AND s.i = f.i + 1)
SELECT source, page, no, max_by(text, i) AS text, max_by(x0, i) AS x0, max_by(x1, i) AS x1 FROM f GROUP BY source, page, no""",
)
def visual_line_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.merge_visual_lines(_spans(spark, sf_dir).withColumn("size", F.lit(10.0)), ["source", "page"]).select("source", "page", "no", "text", "x0", "x1")


@query(
    "WN05",
    f"""WITH RECURSIVE {_SPANS}, s AS (SELECT source, page, y0 AS y, row_number() OVER (PARTITION BY source, page ORDER BY y0) AS i FROM v_spans),
f AS (SELECT source, page, i, y, 0 AS row_no, y AS mean, 1 AS n FROM s WHERE i = 1
    UNION ALL SELECT s.source, s.page, s.i, s.y, CASE WHEN abs(s.y - mean) > 7.2 THEN row_no + 1 ELSE row_no END, CASE WHEN abs(s.y - mean) > 7.2 THEN s.y ELSE mean + (s.y - mean) / (n + 1) END, CASE WHEN abs(s.y - mean) > 7.2 THEN 1 ELSE n + 1 END
    FROM f JOIN s ON s.source = f.source AND s.page = f.page AND s.i = f.i + 1)
SELECT source, page, row_no::BIGINT AS row_no, count(*)::BIGINT AS n, min(y) AS y FROM f GROUP BY source, page, row_no""",
)
def row_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _spans(spark, sf_dir).select("source", "page", F.col("y0").alias("y"))
    return FO.rows_by_drifting_mean(items, ["source", "page"]).groupBy("source", "page", "row_no").agg(F.count("*").alias("n"), F.min("y").alias("y"))


@query(
    "WN18",
    f"""WITH {_SPANS}, c AS (SELECT source, page, line_no, min(y0) AS y, list_sort(list(x0)) AS starts, bool_and(length(text) <= 90 AND NOT {S.hit("text", "[{}]")}) AS short FROM v_spans GROUP BY source, page, line_no),
a AS (SELECT *, row_number() OVER w AS i, y - lag(y) OVER w AS gap FROM c WHERE short AND len(starts) BETWEEN 2 AND 8 WINDOW w AS (PARTITION BY source, page ORDER BY line_no)),
p AS (SELECT b.source, b.page, b.i, b.line_no AS first, len(b.starts) AS columns, e.line_no AS last,
    bool_and(e.i = b.i OR (len(e.starts) = len(b.starts) AND e.gap <= 52 AND len(list_filter(list_zip(e.starts, b.starts), lambda x: abs(x[1] - x[2]) > 22)) = 0)) OVER (PARTITION BY b.source, b.page, b.i ORDER BY e.i) AS ok FROM a b JOIN a e ON e.source = b.source AND e.page = b.page AND e.i >= b.i),
r AS (SELECT source, page, i, first, columns, max(last) AS last, count(*) AS n FROM p WHERE ok GROUP BY ALL)
SELECT source, page, first::BIGINT AS first, last::BIGINT AS last, columns::BIGINT AS columns FROM (SELECT *, row_number() OVER (PARTITION BY source, page ORDER BY n DESC, i) AS k FROM r WHERE n >= 3) WHERE k = 1""",
)
def aligned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _spans(spark, sf_dir).withColumn("row_no", F.floor(F.col("no") / 100_000))
    return FO.longest_aligned_run(FO.cell_rows(cells, ["source", "page"]), ["source", "page"])


@query("WN21")
def vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = FO.group_by_proximity(_spans(spark, sf_dir).drop("text"), ["source", "page"], 24.0)
    return FO.graphics(groups, ["source", "page"])


@query("WN20")
def image_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other word of a line as an image: those near each other on the line become one."""
    return FO.fragments_on_a_line(_packed_spans(spark, sf_dir, lambda i: i % 5 != 3), ["source", "page"], together=True)


@query("WN19")
def collapsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines of a page captured as one, and the visual lines it is split into."""
    spans = _packed_spans(spark, sf_dir).withColumn("size", F.transform("no", lambda _: F.lit(10.0))).withColumn("capture", F.floor(F.col("line_no") / 2))
    return FO.baseline_texts(spans, ["source", "page", "capture"], together=True)


@query(
    "EQ14",
    f"""WITH RECURSIVE {GEOMETRY_SQL}, k AS (SELECT source, page, line_no, line, y0, {S.hit("line", "[=|&%#]")} AS eq FROM v_geom),
s AS (SELECT *, row_number() OVER (PARTITION BY source, page, line ORDER BY line_no) AS i FROM k WHERE eq),
f AS (SELECT source, page, line, line_no, i, y0 AS last, true AS kept FROM s WHERE i = 1
    UNION ALL SELECT s.source, s.page, s.line, s.line_no, s.i, CASE WHEN abs(s.y0 - last) > 32 THEN s.y0 ELSE last END, abs(s.y0 - last) > 32 FROM f JOIN s ON s.source = f.source AND s.page = f.page AND s.line = f.line AND s.i = f.i + 1)
SELECT source, page, line_no AS no, 'text' AS kind FROM k WHERE NOT eq UNION ALL SELECT source, page, line_no, 'equation' FROM f WHERE kept""",
)
def equation_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = geometry_of(lines_of(pages(spark, sf_dir)))
    kind = F.when(F.col("line").rlike("[=|&%#]"), "equation").otherwise("text")
    entries = lines.select("source", "page", F.col("line_no").alias("no"), kind.alias("kind"), F.col("line").alias("markdown"), F.col("y0").cast("double").alias("y"))
    return FO.dedupe_nearby(entries, ["source", "page"]).select("source", "page", "no", "kind")


@query(
    "SM04",
    """WITH RECURSIVE c AS (SELECT user_id::VARCHAR AS job_id, CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS number, event_type AS sha256, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT job_id, 0::BIGINT AS i, 0::BIGINT AS number, '' AS sha256, NULL::VARCHAR AS verdict, []::VARCHAR[] AS known FROM c GROUP BY job_id
    UNION ALL SELECT c.job_id, c.i, c.number, c.sha256, CASE WHEN c.number = len(known) THEN 'accepted' WHEN c.number > len(known) THEN 'out-of-order' WHEN known[c.number + 1] = c.sha256 THEN 'repeated' ELSE 'conflict' END,
        CASE WHEN c.number = len(known) THEN list_append(known, c.sha256) ELSE known END FROM f JOIN c ON c.job_id = f.job_id AND c.i = f.i + 1)
SELECT job_id, number AS chunk_sequence, sha256, verdict FROM f WHERE verdict IS NOT NULL""",
)
def chunk_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemma.streaming.jobs import chunk_verdicts as judge

    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), F.pmod(k, F.lit(5)).alias("chunk_sequence"), F.col("event_type").alias("sha256"), F.col("event_id").alias("arrival"))
    return judge(rows)


@query("RM05")
def cleaned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps in their order: normalise, take running matter out, mend headings, mend wrapped words, join."""
    rows = pages(spark, sf_dir).withColumn("text", T.normalise_text(F.col("text")))
    kept = R.strip_running_matter(rows, _decisions(rows)).select("source", "page", "text")
    outlined = M.heading_hierarchy(kept).select("source", "page", F.col("outline").alias("text"))
    mended = M.repair_hyphens(lines_of(outlined), ["source", "page"])
    return mended.groupBy("source", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: x["text"]), "\n").alias("markdown"))
