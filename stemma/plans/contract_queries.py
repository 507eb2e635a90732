"""Queries on contracts: quotas, retention, messages, requests, runs, logs, reading rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.operators import contracts as C
from stemma.plans.reconstruction_queries import _DIAGRAMS, _edges
from stemma.plans.registry import query
from stemma.sources.views import PAGES_SQL, pages, table

_SIZE = "CAST(floor(o_totalprice * 20) AS BIGINT)"


@query(
    "AG18",
    f"""WITH s AS (SELECT o_custkey, sum({_SIZE})::BIGINT AS bytes FROM orders GROUP BY o_custkey)
SELECT o_custkey, bytes, (SELECT sum(bytes) FROM s) + 1048576 <= {C.MOST_RUNTIME} AND bytes + 1048576 <= {C.MOST_SESSION} AS allowed FROM s""",
)
def storage_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select("o_custkey", F.expr(_SIZE).alias("bytes"))
    return C.storage(jobs, "o_custkey", "bytes", 1 << 20)


_RESULTS = """v_results AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('view', 'signup') THEN 'ack' ELSE 'result' END AS kind, CAST(json_extract(props, '$.k') AS BIGINT) % 7 AS job, (CAST(json_extract(props, '$.k') AS BIGINT) % 40 + 1) * 1048576 AS bytes FROM events)"""


@query(
    "SM08",
    f"""WITH RECURSIVE {_RESULTS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM v_results),
f AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BOOLEAN AS kept, []::STRUCT(job BIGINT, bytes BIGINT)[] AS held FROM n GROUP BY user_id
    UNION ALL SELECT n.user_id, n.i, n.event_id, CASE WHEN kind = 'result' THEN len(held) < 8 AND coalesce(list_sum(list_transform(held, lambda x: x.bytes)), 0) + n.bytes <= {C.MOST_RESULT_BYTES} END,
        CASE WHEN kind = 'ack' THEN list_filter(held, lambda x: x.job <> n.job) WHEN len(held) < 8 AND coalesce(list_sum(list_transform(held, lambda x: x.bytes)), 0) + n.bytes <= {C.MOST_RESULT_BYTES}
            THEN list_append(held, struct_pack(job := n.job, bytes := n.bytes::BIGINT)) ELSE held END FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
SELECT user_id, event_id, kept FROM f WHERE kept IS NOT NULL""",
)
def retained_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type").isin("view", "signup"), "ack").otherwise("result")
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", kind.alias("kind"), (k % 7).alias("job"), ((k % 40 + 1) * 1048576).alias("bytes"))
    return C.retained(rows, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "kept")


_TYPES = ("worker-started", "engine-loading", "engine-ready", "page-start", "ocr-progress", "ocr-error", "page", "done", "error", "other")


@query(
    "VAL03",
    f"""WITH m AS (SELECT event_id, ({list(_TYPES)})[event_id % 10 + 1] AS kind, k - 3 AS page, CASE WHEN event_id % 4 > 0 THEN k * 1500 END AS elapsed, k / 40.0 AS progress, repeat('x', (k * 60)::INT) AS text, CASE WHEN event_id % 3 > 0 THEN '{C.LOAD_STAGE}' END AS stage, CASE WHEN k % 5 > 0 THEN '{C.ENGINE}' END AS engine
    FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)),
p AS (SELECT *, CASE WHEN page NOT BETWEEN 1 AND {C.MOST_PAGE_NUMBER} THEN 'page' END AS paged, CASE WHEN stage IS NULL THEN 'stage' WHEN elapsed IS NULL OR elapsed NOT BETWEEN 0 AND {C.MOST_START} THEN 'elapsed' END AS start, CASE WHEN length(text) > 2048 THEN 'message' END AS long FROM m)
SELECT event_id, CASE kind WHEN 'worker-started' THEN NULL WHEN 'engine-loading' THEN start WHEN 'engine-ready' THEN CASE WHEN engine IS NULL THEN 'engine' ELSE start END WHEN 'page-start' THEN paged WHEN 'page' THEN paged
    WHEN 'ocr-progress' THEN coalesce(paged, CASE WHEN progress NOT BETWEEN 0 AND 1 THEN 'progress' END) WHEN 'ocr-error' THEN coalesce(paged, long) WHEN 'done' THEN CASE WHEN page NOT BETWEEN 1 AND {C.MOST_PAGES} THEN 'total' END
    WHEN 'error' THEN coalesce(long, CASE WHEN stage IS NULL AND elapsed IS NOT NULL THEN 'elapsed' WHEN stage IS NOT NULL THEN start END) ELSE 'type' END AS problem FROM p""",
)
def worker_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, i = F.get_json_object("props", "$.k").cast("long"), F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (i % 10 + 1).cast("int"))
    found = C.message_problem(kind, k - 3, F.when(i % 4 > 0, k * 1500), k / 40.0, F.repeat(F.lit("x"), (k * 60).cast("int")), F.when(i % 3 > 0, C.LOAD_STAGE), F.when(k % 5 > 0, C.ENGINE))
    return table(spark, sf_dir, "events").select("event_id", found.alias("problem"))


@query(
    "VAL02",
    f"""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN ['type', 'pages', 'proto'] ELSE ['type', 'buffer', 'pages'] END AS keys, CASE WHEN p_partkey % 11 > 0 THEN 'extract' ELSE 'print' END AS kind, p_partkey % 7 * 100 AS size,
    list_transform(range(p_size - 2, p_size * 3), lambda x: CASE WHEN p_partkey % 5 = 0 THEN x // 2 ELSE x + 2 END) AS pages, (['eng', 'rus', 'fas', 'deu'])[p_partkey % 4 + 1] AS language FROM part)
SELECT p_partkey, CASE WHEN len(list_filter(keys, lambda x: x NOT IN {C.REQUEST_KEYS})) > 0 THEN 'keys' WHEN kind <> 'extract' THEN 'type' WHEN size <= 0 THEN 'bytes' WHEN len(pages) NOT BETWEEN 1 AND {C.MOST_PAGES} THEN 'pages'
    WHEN len(list_filter(pages, lambda x: x < 1 OR x > {C.MOST_PAGE_NUMBER})) > 0 THEN 'page' WHEN len(list_distinct(pages)) < len(pages) THEN 'duplicates' WHEN language NOT IN {C.LANGUAGES} THEN 'language' END AS problem FROM r""",
)
def extraction_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    named = lambda *x: F.array(*map(F.lit, x))
    numbers = F.transform(F.sequence(F.col("p_size") - 2, F.col("p_size") * 3 - 1), lambda x: F.when(p % 5 == 0, F.floor(x / 2)).otherwise(x + 2).cast("long"))
    language = F.element_at(named("eng", "rus", "fas", "deu"), (p % 4 + 1).cast("int"))
    found = C.request_problem(F.when(p % 9 == 0, named("type", "pages", "proto")).otherwise(named("type", "buffer", "pages")), F.when(p % 11 > 0, "extract").otherwise("print"), p % 7 * 100, numbers, language)
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("problem"))


@query(
    "SRC15",
    """WITH gold(class, document, pages) AS (VALUES ('text-heavy', 'd0', 1), ('scanned-english', 'd1', 2), ('multi-column', 'd2', 3), ('table', 'd3', 1), ('equation', 'd4', 2), ('image-heavy', 'd5', 3)),
r AS (SELECT o_orderkey AS run, (['text-heavy', 'scanned-english', 'multi-column', 'table', 'equation', 'image-heavy', 'odd'])[o_custkey % 7 + 1] AS class, o_orderkey % 400 AS repeat, (['browser', 'companion', 'other'])[o_orderkey % 3 + 1] AS mode, 'd' || (o_custkey % 7 + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END) AS document,
    o_custkey % 3 + 1 AS pages, CASE WHEN o_orderkey % 17 > 0 THEN '1.0' ELSE '' END AS engine FROM orders),
j AS (SELECT r.*, g.document AS gd, g.pages AS gp, row_number() OVER (PARTITION BY r.class, repeat, mode ORDER BY run) AS nth FROM r LEFT JOIN gold g ON g.class = r.class)
SELECT run, unnest(list_filter([CASE WHEN gd IS NULL THEN 'class' END, CASE WHEN gd IS NOT NULL AND nth > 1 THEN 'duplicate' END, CASE WHEN document <> gd THEN 'document' END, CASE WHEN gd IS NOT NULL AND repeat < 1 THEN 'repeat' END,
    CASE WHEN gd IS NOT NULL AND mode NOT IN ('browser', 'companion') THEN 'mode' END, CASE WHEN gd IS NOT NULL AND engine = '' THEN 'engine' END, CASE WHEN pages <> gp THEN 'pages' END], lambda x: x IS NOT NULL)) AS problem FROM j""",
)
def benchmark_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("text-heavy", "scanned-english", "multi-column", "table", "equation", "image-heavy")
    gold = spark.createDataFrame([(n, f"d{i}", i % 3 + 1) for i, n in enumerate(names)], "class string, document string, pages long")
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    pick = lambda at, *x: F.element_at(F.array(*map(F.lit, x)), (at + 1).cast("int"))
    runs = table(spark, sf_dir, "orders").select(
        o.alias("run"), pick(c % 7, *names, "odd").alias("class"), (o % 400).alias("repeat"), pick(o % 3, "browser", "companion", "other").alias("mode"), F.concat(F.lit("d"), c % 7 + F.when(o % 13 == 0, 1).otherwise(0)).alias("document"),
        (c % 3 + 1).alias("pages"), F.when(o % 17 > 0, "1.0").otherwise("").alias("engine"),
    )
    return C.run_problems(runs, gold)


@query(
    "SRC12",
    """WITH c AS (SELECT user_id, max_by(CAST(json_extract(props, '$.k') AS INT), (ts, event_id)) AS version FROM events GROUP BY user_id)
SELECT e.user_id, CASE WHEN version >= 10 THEN version ELSE -1 END AS version, CASE WHEN version >= 10 THEN list_sort(list(DISTINCT CAST(json_extract(props, '$.k') AS INT))) ELSE [] END AS pages FROM events e JOIN c USING (user_id) GROUP BY e.user_id, version""",
)
def workspace_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workspaces by their newest checkpoint: of an older format the pages go and the version is -1."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(k, F.struct("ts", "event_id")).alias("v"), F.array_sort(F.collect_set(k)).alias("own"))
    fits = F.col("v") >= 10
    return rows.select("user_id", F.when(fits, F.col("v")).otherwise(-1).alias("version"), F.when(fits, F.col("own")).otherwise(F.array().cast("array<int>")).alias("pages"))


@query(
    "SNK06",
    """WITH l AS (SELECT user_id, ts, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' [' || upper(CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END) || '] [' || event_type || '] event ' || event_id || ' ' || props AS line FROM events)
SELECT user_id, count(*)::BIGINT AS lines, string_agg(line, chr(10) ORDER BY ts, event_id) AS log FROM l GROUP BY user_id""",
)
def activity_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.upper(F.when(F.col("event_type") == "error", "error").otherwise("info"))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" ["), level, F.lit("] ["), "event_type", F.lit("] event "), "event_id", F.lit(" "), "props")
    rows = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", line.alias("line")).alias("x"))
    return rows.groupBy("user_id").agg(F.count("*").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("log"))


@query(
    "VS03",
    f"""WITH {_DIAGRAMS}, a AS (SELECT DISTINCT diagram, source, target, true AS l FROM v_edges WHERE connector % 3 < 2), b AS (SELECT DISTINCT diagram, source, target, true AS r FROM v_edges WHERE connector % 3 > 0 AND diagram % 2 = 0 UNION SELECT DISTINCT diagram, target, source, true FROM v_edges WHERE connector % 3 > 0 AND diagram % 2 = 1),
c AS (SELECT diagram, count(*) FILTER (l AND r) AS common, count(*) AS n FROM a FULL JOIN b USING (diagram, source, target) GROUP BY diagram),
d AS (SELECT diagram, round((n - common) / greatest(1, n), 6) AS contradiction FROM c)
SELECT diagram, contradiction::DOUBLE AS contradiction, CASE WHEN contradiction > 0.5 THEN 'review' ELSE 'accepted' END AS disposition, CASE WHEN contradiction > 0.5 THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM d""",
)
def provider_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemma.operators import visuals as V

    edges = _edges(spark, sf_dir)[1]
    turn = F.col("diagram") % 2 == 1
    other = edges.where("connector % 3 > 0").select("diagram", "connector", F.when(turn, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(turn, F.col("source")).otherwise(F.col("target")).alias("target"))
    found = V.compare_topology(edges.where("connector % 3 < 2"), other, "diagram")
    against = F.col("contradiction") > 0.5
    return found.select("diagram", "contradiction", F.when(against, "review").otherwise("accepted").alias("disposition"), F.when(against, F.least(F.lit(0.9), F.lit(0.5))).otherwise(0.9).alias("confidence"))


@query(
    "AG13",
    "SELECT l_orderkey AS page, l_returnflag AS kind, count(*)::BIGINT AS n, sum(count(*)) OVER (PARTITION BY l_orderkey)::BIGINT AS objects FROM lineitem GROUP BY l_orderkey, l_returnflag",
)
def object_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a page by kind, and all of the page."""
    from pyspark.sql import Window

    kinds = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"))
    return kinds.withColumn("objects", F.sum("n").over(Window.partitionBy("page")))


@query(
    "SRC09",
    f"""WITH {PAGES_SQL}, l AS (SELECT source, page, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM v_pages)
SELECT page, line::INT AS line, trim(text) AS text, 0.0::DOUBLE AS x0, (line * 2)::DOUBLE AS y0, 0.0::DOUBLE AS x1, (line * 2 + 1)::DOUBLE AS y1 FROM l""",
)
def recognised_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemma.sources.ocr import lines_from_text

    return lines_from_text(pages(spark, sf_dir))


_WORDS = """v_words AS (SELECT l_orderkey AS page, l_linenumber::BIGINT AS no, CASE WHEN l_orderkey % 3 = 0 THEN 'نص ' || l_linestatus ELSE l_returnflag END AS text, (l_partkey % 500)::DOUBLE AS x0, (l_suppkey % 4 * 9 + l_partkey % 3)::DOUBLE AS y0, (l_suppkey % 4 * 9 + l_partkey % 3 + 8 + l_linenumber % 5)::DOUBLE AS y1 FROM lineitem)"""


@query(
    "WN07",
    f"""WITH RECURSIVE {_WORDS}, s AS (SELECT *, greatest(1, y1 - y0) AS h, row_number() OVER (PARTITION BY page ORDER BY y0, x0, no) AS i FROM v_words),
f AS (SELECT page, i, no, 0 AS row_no, y0 AS y, h FROM s WHERE i = 1
    UNION ALL SELECT s.page, s.i, s.no, CASE WHEN abs(s.y0 - f.y) <= greatest(s.h, f.h) * 0.35 THEN f.row_no ELSE f.row_no + 1 END, CASE WHEN abs(s.y0 - f.y) <= greatest(s.h, f.h) * 0.35 THEN f.y ELSE s.y0 END, CASE WHEN abs(s.y0 - f.y) <= greatest(s.h, f.h) * 0.35 THEN greatest(f.h, s.h) ELSE s.h END FROM f JOIN s ON s.page = f.page AND s.i = f.i + 1),
r AS (SELECT w.*, f.row_no, sum(len(regexp_extract_all(text, '\\p{{Arabic}}'))) OVER p > sum(len(regexp_extract_all(text, '\\p{{Latin}}'))) OVER p AS rtl FROM v_words w JOIN f USING (page, no) WINDOW p AS (PARTITION BY w.page, f.row_no))
SELECT page, no, row_no, rtl, (row_number() OVER (PARTITION BY page ORDER BY row_no, CASE WHEN rtl THEN -x0 ELSE x0 END, no) - 1)::INT AS place FROM r""",
)
def ocr_reading_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    y0 = (s % 4 * 9 + p % 3).cast("double")
    text = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("نص "), "l_linestatus")).otherwise(F.col("l_returnflag"))
    words = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), n.cast("long").alias("no"), text.alias("text"), (p % 500).cast("double").alias("x0"), y0.alias("y0"), (y0 + 8 + n % 5).cast("double").alias("y1"))
    return C.reading_rows(words, ["page"]).select("page", "no", "row_no", "rtl", "place")


def _cell_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    y = (F.col("l_orderkey") % 4 * 5 + F.floor((n - 1) / 2)) * 14.0
    text = F.concat("l_returnflag", F.when(p % 19 == 0, F.lit(" and that")).otherwise(""))
    x = (n - 1) % 2 * 200.0
    return table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 4).alias("page"), (F.col("l_orderkey") % 4 * 10 + n).alias("no"), text.alias("text"), (x + p % 3 * 9).alias("x0"), y.alias("y0"), (x + 100).alias("x1"), (y + 10).alias("y1")
    )


@query("TB02")
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.page_tables(_cell_items(spark, sf_dir), ["page"])


@query("TB06")
def table_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    page = F.floor(o / 4)
    rules = table(spark, sf_dir, "orders").groupBy(page.alias("page")).agg(F.max(o % 5).cast("int").alias("horizontal"), F.max(o % 2).cast("int").alias("vertical"), F.max(F.when(o % 3 == 0, "Table 1")).alias("caption"))
    return C.table_evidence(_cell_items(spark, sf_dir), rules, ["page"])


@query("WN15")
def wrapped_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as entries; those in larger type are headings."""
    from stemma.operators.headings import merge_wrapped
    from stemma.sources.views import geometry_of, lines_of

    placed = geometry_of(lines_of(pages(spark, sf_dir)))
    raw = F.trim(F.regexp_replace("line", r"^#{1,6}\s+", ""))
    markdown = F.when(F.col("size") > 10, F.concat(F.lit("# "), raw)).otherwise(F.col("line"))
    entries = placed.select("source", "page", F.col("line_no").alias("no"), F.lit("text").alias("kind"), markdown.alias("markdown"), raw.alias("raw"), F.col("y0").cast("double").alias("y"))
    return merge_wrapped(entries, ["source", "page"]).select("source", "page", "no", "markdown")


@query("WN23")
def split_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns as captures of words, the first three in larger type."""
    from stemma.operators.headings import split_capture

    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.concat(F.upper(F.substring("text", 1, 20)), F.substring("text", 21, 400), F.lit(" Table 2. Sums")), " ")).alias("no", "w"))
    chars = words.select("conv_id", "turn", "no", F.concat("w", F.lit(" ")).alias("text"), F.when(F.col("no") < 3, 16.0).otherwise(10.0).alias("size"))
    return split_capture(chars, ["conv_id", "turn"])
