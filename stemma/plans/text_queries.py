"""Queries on lines and running matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import patterns as P
from stemma.functions import text as T
from stemma.operators import running
from stemma.plans import sql as S
from stemma.plans.registry import query
from stemma.sources.views import GEOMETRY_SQL, LINES_SQL, PAGES_SQL, geometry_of, lines_of, pages


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(pages(spark, sf_dir))


_PLAIN = f"{LINES_SQL}, v_plain AS (SELECT *, {S.plain_line('line')} AS plain FROM v_lines)"


@query("TXT02 TXT17", f"WITH {LINES_SQL} SELECT source, page, line_no, {S.plain_line('line')} AS plain, {S.sub('line', (P.ESCAPED_PUNCTUATION, r'\\1'))} AS unescaped FROM v_lines".replace(r"\\1", r"\1"))
def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    return _lines(spark, sf_dir).select("source", "page", "line_no", T.plain_line(line).alias("plain"), T.unescape_punctuation(line).alias("unescaped"))


@query("TXT03", f"WITH {_PLAIN} SELECT source, page, line_no, {S.signature_of_plain('plain')} AS signature FROM v_plain")
def line_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("source", "page", "line_no", T.line_signature(F.col("line")).alias("signature"))


@query(
    "TXT04 TXT05 TXT07",
    f"WITH {_PLAIN} SELECT source, page, line_no, {S.label('plain')} AS page_label, {S.fragment('plain')} AS running_fragment, {S.structural('plain')} AS structural FROM v_plain",
)
def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    return _lines(spark, sf_dir).select(
        "source", "page", "line_no", T.is_page_label(line).alias("page_label"), T.is_running_fragment(line).alias("running_fragment"), T.is_structural_edge(line).alias("structural")
    )


@query("TXT06", f"WITH {_PLAIN}, t AS (SELECT source, unnest({S.words('plain')}) AS token FROM v_plain) SELECT source, {S.edge_token('token')} AS token, count(*)::BIGINT AS n FROM t GROUP BY ALL")
def edge_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _lines(spark, sf_dir).select("source", F.explode(T.words(T.plain_line(F.col("line")))).alias("token"))
    return tokens.groupBy("source", T.edge_token(F.col("token")).alias("token")).agg(F.count("*").alias("n"))


_SIZED = f"{GEOMETRY_SQL}, v_trim AS (SELECT *, trim(line) AS value, CASE WHEN page % 5 = 0 AND line_no = 0 THEN 'Times-Bold' ELSE 'Times' END AS font FROM v_geom)"


@query("TXT08", f"WITH {_SIZED} SELECT source, page, line_no, {S.heading_level('value', 'size', '10', 'font')} AS level FROM v_trim")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = geometry_of(_lines(spark, sf_dir))
    font = F.when((F.col("page") % 5 == 0) & (F.col("line_no") == 0), "Times-Bold").otherwise("Times")
    return placed.select("source", "page", "line_no", T.heading_level(F.col("line"), F.col("size"), F.lit(10), font).cast("int").alias("level"))


_RANKED = f"""{_PLAIN},
v_marked AS (SELECT *, {S.label("plain")} AS is_label, {S.fragment("plain")} AS is_fragment, CASE WHEN count(*) OVER (PARTITION BY source, page) >= 8 THEN 2 ELSE 1 END AS depth,
    row_number() OVER (PARTITION BY source, page ORDER BY line_no) AS top, row_number() OVER (PARTITION BY source, page ORDER BY line_no DESC) AS bottom FROM v_plain),
v_before AS (SELECT *, coalesce(bool_and(is_label) OVER (PARTITION BY source, page ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS top_labels,
    coalesce(bool_and(is_label) OVER (PARTITION BY source, page ORDER BY line_no DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS bottom_labels FROM v_marked),
v_edges AS (SELECT source, page, line_no, line, plain, 'header' AS position FROM v_before WHERE top <= depth OR (top_labels AND (is_label OR is_fragment))
    UNION ALL SELECT source, page, line_no, line, plain, 'footer' FROM v_before WHERE bottom <= depth OR (bottom_labels AND (is_label OR is_fragment)))"""
_REPEATED = f"""{_RANKED},
v_keys AS (SELECT *, {S.signature_of_plain("plain")} AS key FROM v_edges),
v_total AS (SELECT source, count(DISTINCT page) AS n_pages FROM v_lines GROUP BY source),
v_repeated AS (SELECT source, key, count(DISTINCT page) AS pages FROM v_keys JOIN v_total USING (source) WHERE length(key) BETWEEN 3 AND 160 GROUP BY source, key, n_pages
    HAVING count(DISTINCT page) >= CASE WHEN n_pages <= 2 THEN 2 ELSE least(3, greatest(2, ceil(n_pages * 0.25))) END)"""


@query("RM01", f"WITH {_RANKED} SELECT source, page, line_no, line, position FROM v_edges")
def edge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running.edge_lines(pages(spark, sf_dir))


@query("AG01", f"WITH {_REPEATED} SELECT source, key, pages::BIGINT AS pages FROM v_repeated")
def running_matter_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running.repeated_signatures(running.edge_lines(pages(spark, sf_dir)))


_COMMON = f"""{_REPEATED},
v_outer AS (SELECT source, page, position, CASE WHEN position = 'header' THEN min_by(plain, line_no) ELSE max_by(plain, line_no) END AS plain FROM v_edges GROUP BY source, page, position),
v_tokens AS (SELECT source, page, position, CASE WHEN position = 'header' THEN {S.words("plain")} ELSE list_reverse({S.words("plain")}) END AS tokens FROM v_outer),
v_heads AS (SELECT source, position, n_pages, min(len(tokens)) AS least, min_by(tokens, page) AS first FROM v_tokens JOIN v_total USING (source)
    GROUP BY ALL HAVING count(*) FILTER (len(tokens) >= 2) = n_pages AND n_pages >= 2),
v_places AS (SELECT source, position, unnest(tokens[1:12]) AS token, generate_subscripts(tokens[1:12], 1) - 1 AS pos FROM v_tokens),
v_alike AS (SELECT source, position, pos, count(DISTINCT {S.edge_token("token")}) AS kinds, count(*) AS pages FROM v_places GROUP BY ALL),
v_stop AS (SELECT source, position, min(pos) AS stop FROM v_alike JOIN v_heads USING (source, position) WHERE kinds > 1 OR pages < n_pages GROUP BY ALL),
v_sizes AS (SELECT h.source, h.position, h.first, unnest(range(2, least(coalesce(stop, 12), least, 12) + 1)) AS size FROM v_heads h LEFT JOIN v_stop s ON h.source = s.source AND h.position = s.position),
v_samples AS (SELECT source, position, size, array_to_string(CASE WHEN position = 'header' THEN first[1:size] ELSE list_reverse(first[1:size]) END, ' ') AS sample FROM v_sizes),
v_common AS (SELECT source, position, max(size)::INT AS size, max_by(sample, size) AS sample FROM v_samples
    WHERE length(sample) BETWEEN 6 AND 160 AND NOT ({S.hit("sample", "[.!?]$")} AND size > 5) AND {S.fragment("sample")} GROUP BY ALL)"""


@query("AG03", f"WITH {_COMMON} SELECT * FROM v_common")
def common_edge_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running.common_tokens(running.edge_lines(pages(spark, sf_dir)))


_DECIDED = f"""{_COMMON},
v_once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, page, position, key ORDER BY line_no) AS nth FROM v_keys WHERE trim(line) <> '') WHERE nth = 1),
v_seen AS (SELECT o.*, r.key IS NOT NULL AS repeated, {S.label("plain")} AS page_label, {S.structural("plain")} AS structural, c.sample, c.size, {S.words("plain")} AS tokens
    FROM v_once o LEFT JOIN v_repeated r ON o.source = r.source AND o.key = r.key LEFT JOIN v_common c ON o.source = c.source AND o.position = c.position),
v_same AS (SELECT *, coalesce(len(tokens) >= size AND
    list_transform(CASE WHEN position = 'header' THEN tokens[1:size] ELSE tokens[len(tokens) - size + 1:] END, lambda t: {S.edge_token("t")})
    = list_transform(string_split(sample, ' '), lambda t: {S.edge_token("t")}), false) AS common FROM v_seen),
v_decided AS (SELECT source, page, position, line_no, key, CASE WHEN structural THEN 'KEEP' WHEN page_label OR repeated THEN 'REMOVE' WHEN common THEN 'MERGE' ELSE 'KEEP' END AS action,
    CASE WHEN structural THEN 0.93 WHEN page_label OR repeated THEN 0.9 WHEN common THEN 0.82 ELSE 0.62 END::DOUBLE AS confidence, repeated, common, page_label, structural,
    CASE WHEN NOT structural AND NOT page_label AND NOT repeated AND common THEN array_to_string(CASE WHEN position = 'header' THEN tokens[size + 1:] ELSE tokens[:len(tokens) - size] END, ' ') END AS merged FROM v_same)"""


def _decisions(rows: DataFrame) -> DataFrame:
    edges = running.edge_lines(rows)
    return running.decisions(edges, running.repeated_signatures(edges), running.common_tokens(edges))


@query("RM02 ST03", f"WITH {_DECIDED} SELECT * FROM v_decided")
def running_matter_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(pages(spark, sf_dir))


@query(
    "AG15",
    f"WITH {_DECIDED} SELECT source, page, count(*) FILTER (action = 'REMOVE')::BIGINT AS remove, count(*) FILTER (action = 'KEEP')::BIGINT AS keep, count(*) FILTER (action = 'MERGE')::BIGINT AS merge FROM v_decided GROUP BY source, page",
)
def running_matter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.count_if(F.col("action") == a).alias(a.lower()) for a in ("REMOVE", "KEEP", "MERGE")]
    return _decisions(pages(spark, sf_dir)).groupBy("source", "page").agg(*counts)


@query(
    "RM03 RM04",
    f"""WITH {_DECIDED}, cut AS (SELECT l.source, l.page, l.line_no, CASE WHEN count(d.action) = 0 THEN l.line ELSE coalesce(max(CASE WHEN d.action = 'MERGE' THEN d.merged END), '') END AS line
    FROM v_lines l LEFT JOIN v_decided d ON d.action <> 'KEEP' AND d.source = l.source AND d.page = l.page AND d.line_no = l.line_no GROUP BY l.source, l.page, l.line_no, l.line)
SELECT source, page, count(*)::BIGINT AS lines, string_agg(line, chr(10) ORDER BY line_no) AS text FROM cut WHERE trim(line) <> '' GROUP BY source, page""",
)
def without_running_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir)
    return running.strip_running_matter(rows, _decisions(rows))


@query(
    "AG02 SO05",
    f"""WITH {GEOMETRY_SQL}, k AS (SELECT DISTINCT source, page, CASE WHEN y0 <= 792 * 0.14 THEN 'header' WHEN y1 >= 792 - 792 * 0.14 THEN 'footer' END AS position, lower({S.squeeze("line")}) AS key FROM v_geom),
t AS (SELECT source, count(DISTINCT page) AS n FROM v_geom GROUP BY source)
SELECT source, position, key, list_sort(list(page)) AS pages FROM k JOIN t USING (source) WHERE position IS NOT NULL AND key <> '' GROUP BY source, position, key, n HAVING count(*) >= greatest(2, ceil(n * 0.35))""",
)
def repeated_header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running.repeated_by_place(geometry_of(_lines(spark, sf_dir)))


@query(
    "TXT31",
    f"""WITH {LINES_SQL}, r AS (SELECT *, {S.squeeze("line")} AS t, row_number() OVER (PARTITION BY source, page ORDER BY line_no) AS i FROM v_lines),
p AS (SELECT source, page, count(*)::BIGINT AS lines, count(*) FILTER ({S.toc_entry("line")})::BIGINT AS entries, bool_or(i <= 8 AND {S.hit("t", P.TOC_TITLE)}) AS titled FROM r GROUP BY source, page)
SELECT *, titled OR (lines >= 8 AND entries / lines >= 0.38) AS contents FROM p""",
)
def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("source", "page").orderBy("line_no"))
    rows = _lines(spark, sf_dir).withColumns({"i": rank, "t": T.squeeze(F.col("line"))})
    per = rows.groupBy("source", "page").agg(
        F.count("*").alias("lines"), F.count_if(T.is_toc_entry(F.col("line"))).alias("entries"), F.bool_or((F.col("i") <= 8) & F.col("t").rlike(P.TOC_TITLE)).alias("titled")
    )
    return per.withColumn("contents", F.col("titled") | ((F.col("lines") >= 8) & (F.col("entries") / F.col("lines") >= 0.38)))


_SOURCE_EQ = r'(?m)^\[SOURCE_VISUAL\b[^\]]*\bkind="equation"[^\]]*\]$'


@query(
    "TXT24 SNK02",
    f"""WITH {PAGES_SQL} SELECT source, page, {S.count(S.plain_text("text"), r"[\p{L}\p{N}]+")}::INT AS words, {S.count("text", r"(?m)^#{1,6}\s")}::INT AS headings,
{S.count("text", r"(?m)^\|.*\|\n\|[-: |]+\|")}::INT AS tables, ({S.count("text", r"(?m)^\$\$")} // 2 + {S.count("text", _SOURCE_EQ)})::BIGINT AS equations,
{S.count("text", r"\[(?:VISUAL_PLACEHOLDER|SOURCE_VISUAL)")}::INT AS visuals, {S.count("text", r"\[SOURCE_VISUAL")}::INT AS source_visuals, {S.plain_text("text")} AS plain FROM v_pages""",
)
def document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir)
    return rows.select("source", "page", *(c.alias(n) for n, c in T.document_metrics(F.col("text")).items()), T.plain_text(F.col("text")).alias("plain"))


@query(
    "EQ01 TXT30",
    f"WITH {LINES_SQL}, t AS (SELECT *, trim(line) AS v FROM v_lines) SELECT source, page, line_no, {S.math_score('line')} AS math_score, {S.code_signal('v')} AS code_signal FROM t",
)
def line_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    return _lines(spark, sf_dir).select("source", "page", "line_no", T.math_score(line).alias("math_score"), T.code_signal(line).cast("int").alias("code_signal"))


@query(
    "TXT25 TXT26",
    f"""WITH {PAGES_SQL}, b AS (SELECT source, page, unnest(b) AS block, generate_subscripts(b, 1) - 1 AS block_no FROM (SELECT source, page, string_split({S.sub("text", (r"(?m)^\s*<!--\s*page:\s*(\d+)\s*-->\s*$", ""))}, chr(10)) AS b FROM v_pages)),
t AS (SELECT source, page, block_no::INT AS block_no, trim(block) AS m FROM b WHERE trim(block) <> '')
SELECT source, page, block_no, CASE WHEN {S.hit("m", P.FOOTNOTE)} THEN 'footnote' WHEN {S.hit("m", r"^#{1,6}\s+")} THEN 'heading' WHEN {S.hit("m", P.LIST_ITEM)} THEN 'list'
WHEN {S.hit(S.squeeze(S.sub("m", (r"(?s)<!--.*?-->", " "))), P.CAPTION)} THEN 'caption' ELSE 'paragraph' END AS type FROM t""",
)
def block_type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemma.operators.blocks import block_type, split_blocks

    return split_blocks(pages(spark, sf_dir)).select("source", "page", "block_no", block_type(F.col("markdown")).alias("type"))


@query("TXT19", f"WITH {LINES_SQL} SELECT source, page, line_no, {S.evaluation_text('line')} AS text FROM v_lines")
def evaluation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("source", "page", "line_no", T.evaluation_text(F.col("line")).alias("text"))
