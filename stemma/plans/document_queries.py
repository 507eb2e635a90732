"""Queries on matching, Markdown documents and their outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.functions import geometry as G
from stemma.functions import patterns as P
from stemma.functions import text as T
from stemma.operators import markdown as M
from stemma.operators import matching as J
from stemma.plans import sql as S
from stemma.plans.layout_queries import _CLASSES, _classified
from stemma.plans.registry import query
from stemma.plans.text_queries import _DECIDED, _decisions
from stemma.sources.views import GEOMETRY_SQL, LINES_SQL, PAGES_SQL, geometry_of, lines_of, pages, table


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placed lines, short lines as captions, and a figure, table or equation under every long line."""
    placed = geometry_of(lines_of(pages(spark, sf_dir))).withColumn("box", G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    captions = placed.where((F.length("line") <= 60) | J.is_caption(F.col("line"))).select("source", "page", "line_no", "line", "box")
    kind = F.element_at(F.array(F.lit("figure"), F.lit("table"), F.lit("equation")), (F.col("line_no") % 3 + 1).cast("int"))
    under = G.of_size(F.col("x0"), F.col("y1") + 2, F.lit(180), F.lit(60))
    objects = placed.where(F.length("line") > 300).select("source", "page", F.col("line_no").alias("object_no"), kind.alias("kind"), under.alias("box"))
    return placed, captions, objects


_OBJECTS = f"""{GEOMETRY_SQL}, v_captions AS (SELECT * FROM v_geom WHERE length(line) <= 60 OR {S.hit("line", P.CAPTION_MARKER)}),
v_objects AS (SELECT source, page, line_no AS object_no, (['figure', 'table', 'equation'])[line_no % 3 + 1] AS kind, x0 AS bx0, y1 + 2 AS by0, x0 + 180 AS bx1, y1 + 62 AS by1 FROM v_geom WHERE length(line) > 300),
v_pairs AS (SELECT c.*, object_no, kind, bx0, by0, bx1, by1, greatest(0, greatest(y0, by0) - least(y1, by1))::DOUBLE AS distance FROM v_captions c JOIN v_objects o ON c.source = o.source AND c.page = o.page)"""


@query(
    "JN01",
    f"WITH {_OBJECTS}, r AS (SELECT *, row_number() OVER (PARTITION BY source, page, line_no ORDER BY CASE WHEN x1 > x0 AND least(x1, bx1) > greatest(x0, bx0) THEN 0 ELSE 1 END, distance, object_no) AS r FROM v_pairs WHERE distance <= 48) SELECT source, page, line_no, object_no, kind, distance FROM r WHERE r = 1",
)
def caption_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, captions, objects = _boxes(spark, sf_dir)
    return J.caption_targets(captions, objects)


@query(
    "JN02",
    f"""WITH {_OBJECTS}, s AS (SELECT *, distance + CASE WHEN {S.hit("line", r"(?i)^(?:figure|fig\.)")} AND y1 <= by0 THEN 7.5 ELSE 0 END AS score FROM v_pairs
WHERE distance <= 80 AND (least(x1, bx1) - greatest(x0, bx0) > 0 OR abs((x0 + x1) / 2 - (bx0 + bx1) / 2) <= greatest(80, (x1 - x0) * 0.45)))
SELECT source, page, object_no, line_no, score FROM (SELECT *, row_number() OVER (PARTITION BY source, page, object_no ORDER BY score, line_no) AS r FROM s) WHERE r = 1""",
)
def nearest_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, captions, objects = _boxes(spark, sf_dir)
    return J.best_caption(captions, objects)


@query("JN03", f"WITH {_OBJECTS} SELECT o.source, o.page, object_no, line_no FROM v_objects o JOIN v_geom g ON o.source = g.source AND o.page = g.page AND x0 < bx1 AND x1 > bx0 AND y0 < by1 AND y1 > by0")
def objects_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _, objects = _boxes(spark, sf_dir)
    return J.touching(objects, placed.select("source", "page", "line_no", "box"))


@query(
    "JN04",
    f"""WITH {_OBJECTS} SELECT source, page, object_no, kind FROM v_objects o WHERE NOT EXISTS (SELECT 1 FROM v_geom g WHERE o.source = g.source AND o.page = g.page
AND greatest(0, least(x1, bx1) - greatest(x0, bx0)) * greatest(0, least(y1 + 40, by1) - greatest(y0, by0)) / 10800 >= 0.5 AND least(10800, greatest(1, (x1 - x0) * (y1 + 40 - y0))) / greatest(10800, (x1 - x0) * (y1 + 40 - y0)) >= 0.62)""",
)
def overlap_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _, objects = _boxes(spark, sf_dir)
    tall = placed.select("source", "page", G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1") + 40).alias("box"))
    return J.not_covered(objects, tall, 0.5).select("source", "page", "object_no", "kind")


@query(
    "JN06 JN07 VAL04",
    f"""WITH {_DECIDED}, kept AS (SELECT l.* FROM v_lines l WHERE NOT EXISTS (SELECT 1 FROM v_decided d WHERE d.action = 'REMOVE' AND d.source = l.source AND d.page = l.page AND d.line_no = l.line_no))
SELECT a.source, a.page, a.line_no AS from_line, b.line_no AS to_line FROM kept a JOIN kept b ON a.source = b.source AND a.page = b.page AND b.line_no = a.line_no + 1""",
)
def relationship_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir)
    lines, judged = lines_of(rows), _decisions(rows)
    gone = judged.where("action = 'REMOVE'").select("source", "page", "line_no").distinct()
    kept = lines.join(gone, ["source", "page", "line_no"], "left_anti")
    follows = lines.select("source", "page", F.col("line_no").alias("from_line"), (F.col("line_no") + 1).alias("to_line"))
    return J.relations_within(follows, kept, ["source", "page"], "from_line", "to_line", "line_no").select("source", "page", "from_line", "to_line")


@query(
    "EV03 JN10",
    f"""WITH {_CLASSES}, e AS (SELECT source, page, CASE type WHEN 'list-item' THEN 'list' WHEN 'quote' THEN 'paragraph' WHEN 'equation' THEN 'paragraph' ELSE type END AS label FROM v_classes),
a AS (SELECT source, page, CASE WHEN {S.hit("trim(line)", P.FOOTNOTE)} THEN 'footnote' WHEN {S.hit("trim(line)", r"^#{1,6}\s+")} THEN 'heading' WHEN {S.hit("trim(line)", P.LIST_ITEM)} THEN 'list' WHEN {S.hit(S.squeeze("line"), P.CAPTION)} THEN 'caption' ELSE 'paragraph' END AS label FROM v_lines),
c AS (SELECT source, page, coalesce(x.n, 0) AS l, coalesce(y.n, 0) AS r FROM (SELECT source, page, label, count(*) AS n FROM e GROUP BY ALL) x FULL JOIN (SELECT source, page, label, count(*) AS n FROM a GROUP BY ALL) y USING (source, page, label))
SELECT source, page, round(CASE WHEN sum(least(l, r)) > 0 THEN 2 * sum(least(l, r)) / (sum(l) + sum(r)) ELSE 0 END, 6)::DOUBLE AS f1 FROM c GROUP BY source, page""",
)
def structure_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemma.operators.blocks import block_type

    label = F.when(F.col("type") == "list-item", "list").when(F.col("type").isin("quote", "equation"), "paragraph").otherwise(F.col("type"))
    expected = _classified(spark, sf_dir).select("source", "page", label.alias("label"))
    clean = F.trim("line")
    actual = lines_of(pages(spark, sf_dir)).select("source", "page", block_type(clean).alias("label"))
    both = J.multiset_overlap(expected, actual, ["source", "page"], "label")
    return both.select("source", "page", F.round(J.f1(F.col("n_left"), F.col("n_right"), F.col("common")), 6).alias("f1"))


_TURNS = f"""t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations),
a AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest({S.words("lower(text)")}) AS w FROM t WHERE next IS NOT NULL) GROUP BY ALL),
b AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest({S.words("lower(next)")}) AS w FROM t WHERE next IS NOT NULL) GROUP BY ALL)"""


@query(
    "EQ11",
    f"WITH {_TURNS} SELECT conv_id, turn, round(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) / greatest(sum(coalesce(a.n, 0)), sum(coalesce(b.n, 0))), 6)::DOUBLE AS similarity FROM a FULL JOIN b USING (conv_id, turn, w) GROUP BY conv_id, turn",
)
def token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next is not null")
    side = lambda c: turns.select("conv_id", "turn", F.explode(T.words(F.lower(c))).alias("w"))
    both = J.multiset_overlap(side("text"), side("next"), ["conv_id", "turn"], "w")
    return both.select("conv_id", "turn", F.round(F.col("common") / F.greatest("n_left", "n_right"), 6).alias("similarity"))


@query(
    "TXT13",
    f"""WITH {PAGES_SQL}, l AS (SELECT source, page, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM v_pages),
n AS (SELECT source, page, lead(page) OVER w AS next_page, trim(l[len(l)]) AS a, lead(trim(l[1])) OVER w AS b FROM l WINDOW w AS (PARTITION BY source ORDER BY page))
SELECT source, page, next_page, CASE WHEN a IS NULL OR b IS NULL OR {S.hit("a", P.STRUCTURAL_LINE)} OR {S.hit("b", P.STRUCTURAL_LINE)} OR length(a) < 35 OR {S.hit("a", "[.!?:;]$")} OR NOT {S.hit("b", r"^\p{Ll}")} THEN 'none'
WHEN {S.hit("a", "-$")} AND {S.hit("b", "^[a-z]")} THEN 'join-hyphen' ELSE 'join' END AS action FROM n WHERE next_page IS NOT NULL""",
)
def cross_page_paragraph_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.page_joins(pages(spark, sf_dir))


_FENCED = f"""{LINES_SQL}, v_f AS (SELECT *, coalesce(sum(CASE WHEN {S.hit("line", P.FENCE_LINE)} THEN 1 ELSE 0 END) OVER (PARTITION BY source, page ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f,
    {S.hit("line", P.FENCE_LINE)} AS is_fence, lead(line) OVER (PARTITION BY source, page ORDER BY line_no) AS nxt FROM v_lines)"""


@query(
    "TXT11 WN02",
    f"""WITH {_FENCED}, o AS (SELECT *, NOT (is_fence OR f % 2 = 1) AND NOT {S.hit("line", P.PAGE_MARKER)} AND NOT {S.hit("trim(line)", P.STRUCTURAL_LINE)} AS open,
    coalesce({S.hit("line", P.WRAP_END)} AND {S.hit("nxt", P.WRAP_START)} AND NOT {S.hit("nxt", P.PAGE_MARKER)} AND NOT {S.hit("trim(nxt)", P.STRUCTURAL_LINE)}, false) AS goes FROM v_f),
j AS (SELECT *, coalesce(lag(open AND goes) OVER (PARTITION BY source, page ORDER BY line_no), false) AS joined FROM o),
r AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY source, page ORDER BY line_no) AS run, CASE WHEN joined THEN ltrim(line) ELSE line END AS part FROM j)
SELECT source, page, min(line_no)::INT AS first, string_agg(CASE WHEN open AND goes THEN regexp_replace(part, '-\\s*$', '') ELSE part END, '' ORDER BY line_no) AS text FROM r GROUP BY source, page, run""",
)
def line_wrap_hyphen_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.repair_hyphens(lines_of(pages(spark, sf_dir)), ["source", "page"])


@query(
    "TXT20 TXT12",
    f"""WITH {_FENCED}, c AS (SELECT *, is_fence OR f % 2 = 1 AS code, trim(line) AS t FROM v_f), m AS (SELECT *, t = '$$' AND NOT code AS is_math FROM c),
n AS (SELECT *, coalesce(sum(CASE WHEN is_math THEN 1 ELSE 0 END) OVER (PARTITION BY source, page ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM m),
k AS (SELECT *, CASE WHEN code THEN 'fence' WHEN is_math OR m % 2 = 1 THEN 'math' WHEN {S.hit("line", P.PAGE_MARKER)} THEN 'page' WHEN {S.hit("t", "^<!--.*-->$")} THEN 'comment' WHEN {S.hit("t", r"^#{1,6}\s")} THEN 'heading'
    WHEN {S.hit("t", r"^[-*+]\s")} THEN 'bullet' WHEN {S.hit("t", r"^\d+[.)]\s")} THEN 'number' WHEN {S.hit("t", r"^\|.*\|$")} THEN 'table' WHEN {S.hit("t", r"^\[(?:SOURCE_VISUAL|VISUAL_PLACEHOLDER)")} THEN 'visual' ELSE 'paragraph' END AS kind FROM n),
b AS (SELECT *, CASE WHEN kind = 'fence' THEN is_fence AND f % 2 = 0 WHEN kind = 'math' THEN is_math AND m % 2 = 0 ELSE NOT coalesce(kind IN ('table', 'paragraph') AND lag(kind) OVER (PARTITION BY source, page ORDER BY line_no) = kind, false) END AS new FROM k),
x AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY source, page ORDER BY line_no) - 1 AS block_no FROM b)
SELECT source, page, block_no::BIGINT AS block_no, kind, min(line_no)::INT AS first, max(line_no)::INT AS last FROM x GROUP BY source, page, block_no, kind""",
)
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.block_tokens(lines_of(pages(spark, sf_dir)), ["source", "page"])


@query(
    "SNK01",
    f"""WITH {PAGES_SQL}, c AS (SELECT source, page, {S.sub("text", (r"^\s+|\s+\z", ""))} AS t FROM v_pages)
SELECT source, count(*)::BIGINT AS pages, string_agg('<!-- page: ' || page || ' -->' || chr(10) || chr(10) || t, chr(10) || chr(10) ORDER BY page) AS markdown FROM c WHERE t <> '' GROUP BY source""",
)
def document_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).withColumn("t", F.regexp_replace("text", r"^\s+|\s+\z", "")).where("t <> ''")
    rows = rows.withColumn("line", F.concat(F.lit("<!-- page: "), F.col("page"), F.lit(" -->\n\n"), F.col("t")))
    return rows.groupBy("source").agg(F.count("*").alias("pages"), M.ordered_text(["page"], separator="\n\n").alias("markdown"))


_HEADED = r"^\s*(#{1,6})\s+(.+?)\s*$"
_TITLE = f"trim({S.sub(f"regexp_extract(line, {S.q(_HEADED)}, 2)", (r"\s+", " "))})"


@query(
    "TXT10",
    f"""WITH RECURSIVE {PAGES_SQL}, l AS (SELECT source, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM v_pages),
h AS (SELECT *, {_TITLE} AS title, length(regexp_extract(line, {S.q(_HEADED)}, 1)) AS own, row_number() OVER (PARTITION BY source, page ORDER BY n) AS i FROM l WHERE {S.hit("line", _HEADED)}),
w AS (SELECT *, CASE WHEN {S.hit("title", P.NUMBERED_TITLE)} THEN least(6, len(string_split(regexp_extract(title, {S.q(P.NUMBERED_TITLE)}, 1), '.'))) WHEN {S.hit("title", P.CHAPTER)} THEN 1 END AS fixed FROM h),
f AS (SELECT source, page, 0::BIGINT AS i, 0::BIGINT AS n, 0::BIGINT AS level, '' AS key, false AS gone, '' AS title FROM w GROUP BY source, page
    UNION ALL SELECT w.source, w.page, w.i, w.n, CASE WHEN w.title = '' OR lower(w.title) = f.key THEN f.level ELSE coalesce(w.fixed, CASE WHEN f.level > 0 AND w.own > f.level + 1 THEN f.level + 1 ELSE w.own END) END,
        CASE WHEN w.title = '' THEN f.key ELSE lower(w.title) END, w.title = '' OR lower(w.title) = f.key, w.title FROM f JOIN w ON w.source = f.source AND w.page = f.page AND w.i = f.i + 1)
SELECT l.source, l.page, coalesce(string_agg(CASE WHEN f.n IS NULL THEN l.line ELSE repeat('#', f.level::INT) || ' ' || f.title END, chr(10) ORDER BY l.n) FILTER (NOT coalesce(f.gone, false)), '') AS outline FROM l LEFT JOIN f ON f.i > 0 AND f.source = l.source AND f.page = l.page AND f.n = l.n GROUP BY l.source, l.page""",
)
def heading_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.heading_hierarchy(pages(spark, sf_dir)).select("source", "page", "outline")


@query(
    "TXT14 TXT16 TXT22 TXT23",
    f"""WITH {LINES_SQL}, e AS (SELECT source, page, line_no, line, {S.sub("line", (r"([`*])", r"\\\1"))} AS m FROM v_lines)
SELECT source, page, line_no, CASE WHEN {S.hit("m", r"^\s*(?:#{1,6}\s|[-+*]\s|>\s|```|~~~)")} THEN {S.sub("m", (r"^(\s*)(\S)", r"\1\\\2"))} ELSE m END AS markdown,
replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
CASE WHEN regexp_matches(line, '[",\r\n]') THEN '"' || replace(line, '"', '""') || '"' ELSE line END AS csv,
coalesce(nullif(substr({S.sub("line", (r"[^A-Za-z0-9._-]+", "-"), (r"^-+|-+$", ""))}, 1, 120), ''), 'item') AS identifier,
{S.sub("line", (r"^\s*[☐□]\s+", "- [ ] "), (r"^\s*[☑✓✔]\s+", "- [x] "))} AS task FROM e""",
)
def escaped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    task = F.regexp_replace(F.regexp_replace(line, r"^\s*[☐□]\s+", "- [ ] "), r"^\s*[☑✓✔]\s+", "- [x] ")
    return lines_of(pages(spark, sf_dir)).select(
        "source", "page", "line_no", T.escape_markdown(line).alias("markdown"), T.escape_html(line).alias("html"), T.escape_csv(line).alias("csv"), T.safe_identifier(line).alias("identifier"), task.alias("task")
    )


@query(
    "TXT28 SRC10",
    f"""WITH {PAGES_SQL}, l AS (SELECT source, page, text, {S.sub("text", (r"\P{L}", ""))} AS letters FROM v_pages)
SELECT source, page, {S.count("text", r"\p{Arabic}")} > {S.count("text", r"\p{Latin}")} AS right_to_left, length(letters) > 0 AND length({S.sub("letters", (r"[^\x{0590}-\x{08ff}\x{fb1d}-\x{fdff}\x{fe70}-\x{fefc}]", ""))}) / nullif(length(letters), 0) > 0.35 AS likely_rtl,
contains(text, chr(65533)) OR length(text) < 40 AS needs_ocr FROM l""",
)
def ocr_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    letters = F.regexp_replace(t, r"\P{L}", "")
    rtl = F.length(F.regexp_replace(letters, "[^\\x{0590}-\\x{08ff}\\x{fb1d}-\\x{fdff}\\x{fe70}-\\x{fefc}]", ""))
    return pages(spark, sf_dir).select(
        "source", "page", (T.count_of(t, r"\p{IsArabic}") > T.count_of(t, r"\p{IsLatin}")).alias("right_to_left"), ((F.length(letters) > 0) & F.coalesce(rtl / F.nullif(F.length(letters), F.lit(0)) > 0.35, F.lit(False))).alias("likely_rtl"),
        (F.contains(t, F.lit("�")) | (F.length(t) < 40)).alias("needs_ocr"),
    )


@query("TXT15", f"WITH {PAGES_SQL} SELECT source, page, {S.squeeze(S.sub('text', (r'(\p{L})-\s+(\p{Ll})', r'\1\2')))} AS joined FROM v_pages")
def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("source", "page", T.join_wrapped(F.split("text", "\n")).alias("joined"))


_NORMAL = S.sub("nfc_normalize(text)", ("[\u200b-\u200d\u2060\ufeff\u00ad]", ""), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), (r"([\p{L}\p{N}\])}*_])‚(\s|[\p{L}\p{N}(\[\"“])", r"\1,\2"), (r"(?m)[ \t]+$", ""), (r"\n{4,}", "\n\n\n"), (r"^\s+|\s+\z", ""))


@query("TXT01", f"WITH {PAGES_SQL} SELECT source, page, {_NORMAL} AS text FROM v_pages")
def normalised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemma.functions.unicode import normal_form

    return pages(spark, sf_dir).select("source", "page", T.normalise_text(normal_form(F.col("text"))).alias("text"))


_FIELD = r"([a-z]+)=(?:\"([^\"]*)\"|([^ \]]+))"


@query(
    "TXT21",
    f"""WITH {LINES_SQL}, m AS (SELECT source, page, line_no, unnest(regexp_extract_all(line, '{_FIELD.replace(chr(92) + '"', '"')}', 1)) AS field, unnest(regexp_extract_all(line, '{_FIELD.replace(chr(92) + '"', '"')}', 2)) AS quoted, unnest(regexp_extract_all(line, '{_FIELD.replace(chr(92) + '"', '"')}', 3)) AS bare FROM v_lines WHERE line LIKE '[SOURCE_VISUAL%')
SELECT source, page, line_no, field, coalesce(nullif(quoted, ''), bare) AS value FROM m""",
)
def source_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(pages(spark, sf_dir)).where(F.col("line").startswith("[SOURCE_VISUAL"))
    part = lambda i: F.regexp_extract_all("line", F.lit(_FIELD.replace('\\"', '"')), F.lit(i))
    fields = lines.select("source", "page", "line_no", F.explode(F.arrays_zip(part(1).alias("field"), part(2).alias("quoted"), part(3).alias("bare"))).alias("x"))
    return fields.select("source", "page", "line_no", "x.field", F.coalesce(F.nullif("x.quoted", F.lit("")), F.col("x.bare")).alias("value"))
