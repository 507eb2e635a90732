"""Queries on jobs, events, quality and review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.functions import patterns as P
from stemma.functions import text as T
from stemma.operators import layout as L
from stemma.operators import quality as Q
from stemma.operators import running
from stemma.operators import workflow as W
from stemma.plans import sql as S
from stemma.plans.layout_queries import _COLUMNS
from stemma.plans.registry import query
from stemma.plans.text_queries import _REPEATED
from stemma.sources.views import geometry_of, lines_of, pages, table

_EVENTS = "v_events AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)"
_STATES = {"signup": "created", "view": "receiving", "click": "queued", "purchase": "running", "error": "failed"}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return W.numbered(events, "user_id", ["ts", "event_id"])


@query(
    "SM01 SM02 SM03",
    f"""WITH {_EVENTS}, s AS (SELECT user_id, max(sequence) AS latest, greatest(1, max(sequence) - 127) AS earliest, min(k)::BIGINT AS after FROM v_events GROUP BY user_id)
SELECT user_id, after, latest, earliest, after + 1 < earliest AS gap, CASE WHEN after + 1 < earliest THEN 0 ELSE greatest(0, least(128, latest - after)) END::BIGINT AS delivered FROM s""",
)
def event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    cursors = events.groupBy("user_id").agg(F.min("k").cast("long").alias("after"))
    return W.replay(events, cursors, "user_id")


@query("SM02", "SELECT user_id, event_id AS after, next, next - event_id - 1 AS missing FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events) WHERE next > event_id + 1")
def event_sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sequence_gaps(table(spark, sf_dir, "events"), "user_id", "event_id")


_CASE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _STATES.items()) + " END"


@query(
    "SM06",
    f"""WITH {_EVENTS}, l AS (SELECT user_id, sequence, {_CASE} AS state, lag({_CASE}) OVER (PARTITION BY user_id ORDER BY sequence) AS previous FROM v_events)
SELECT user_id, sequence, previous, state, CASE WHEN previous IS NULL THEN state = 'created' ELSE (previous, state) IN ({", ".join(str(t) for t in W.TRANSITIONS)}) END AS legal FROM l""",
)
def job_state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.create_map(*(F.lit(x) for pair in _STATES.items() for x in pair))[F.col("event_type")]
    rows = _events(spark, sf_dir).select("user_id", "sequence", state.alias("state"))
    return W.transitions(rows, "user_id").select("user_id", "sequence", "previous", "state", "legal")


@query("SM05", "SELECT user_id, event_type, count(*)::BIGINT AS requests, count(DISTINCT props)::BIGINT AS distinct_requests, count(DISTINCT props) > 1 AS conflict FROM events GROUP BY user_id, event_type")
def idempotent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.idempotent(table(spark, sf_dir, "events"), ["user_id", "event_type"], "props").withColumnRenamed("distinct", "distinct_requests")


@query(
    "SM07",
    """WITH g AS (SELECT *, CASE WHEN epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 1800000 THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM g)
SELECT user_id, session_no::BIGINT AS session_no, min(ts) AS first, max(ts) AS last, count(*)::BIGINT AS n, last(event_type ORDER BY ts, event_id) AS last_event, last(event_type ORDER BY ts, event_id) <> 'purchase' AS abandoned FROM s GROUP BY user_id, session_no""",
)
def abandoned_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.sessions(table(spark, sf_dir, "events"), "user_id")
    return out.withColumn("abandoned", F.col("last_event") != "purchase")


@query(
    "TM01 TM02",
    """WITH d AS (SELECT event_type, epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS ms, value * 40 AS load FROM events)
SELECT event_type, CASE WHEN ms < 100 THEN 'under_100ms' WHEN ms < 500 THEN '100_499ms' WHEN ms < 2000 THEN '500_1999ms' WHEN ms < 10000 THEN '2_9s' WHEN ms IS NOT NULL THEN '10s_plus' END AS duration_band,
CASE WHEN load < 0 THEN NULL WHEN load < 800 THEN 'under_800ms' WHEN load < 2500 THEN '800_2500ms' WHEN load < 4000 THEN '2500_4000ms' WHEN load IS NOT NULL THEN 'over_4000ms' END AS load_band, count(*)::BIGINT AS n FROM d GROUP BY ALL""",
)
def duration_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    lag = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").withColumn("ms", F.timestamp_diff("MILLISECOND", lag, F.col("ts")))
    bands = [W.band(F.col("ms"), W.DURATION_BANDS).alias("duration_band"), W.band(F.col("value") * 40, W.LOAD_BANDS).alias("load_band")]
    return rows.groupBy("event_type", *bands).agg(F.count("*").alias("n"))


@query("VAL11 VAL03", f"WITH {_EVENTS} SELECT event_type, CASE WHEN k IN (1, 2, 3, 5, 8) THEN k::VARCHAR ELSE 'other' END AS action, count(*)::BIGINT AS n FROM v_events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY ALL")
def allowlisted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    allow = spark.createDataFrame([("click",), ("view",), ("purchase",)], "event_type string")
    kept = W.allowed(_events(spark, sf_dir), allow, "event_type", F.col("k").cast("string"), ["1", "2", "3", "5", "8"])
    return kept.groupBy("event_type", "action").agg(F.count("*").alias("n"))


@query(
    "SM09",
    f"WITH {_EVENTS} SELECT user_id, sequence, stage, CASE stage WHEN 'page-started' THEN 0 WHEN 'page-progress' THEN 50 ELSE 100 END::INT AS percent FROM (SELECT user_id, sequence, unnest(['page-started', 'page-progress', 'page-completed']) AS stage FROM v_events WHERE event_type = 'view')",
)
def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(p).alias("percent")) for s, p in (("page-started", 0), ("page-progress", 50), ("page-completed", 100))))
    return _events(spark, sf_dir).where("event_type = 'view'").select("user_id", "sequence", F.inline(stages))


@query(
    "SRC11",
    """WITH r AS (SELECT p_partkey, p_size || '-' || (p_size + 3) || ', ' || (p_size % 7 + 1) || CASE WHEN p_size % 11 = 0 THEN ', x' ELSE '' END AS asked FROM part),
p AS (SELECT p_partkey, asked, trim(unnest(string_split(asked, ','))) AS part FROM r),
n AS (SELECT p_partkey, asked, regexp_matches(part, '^\\d+(\\s*-\\s*\\d+)?$') AS ok, try_cast(regexp_extract(part, '^(\\d+)', 1) AS INT) AS a, coalesce(try_cast(nullif(regexp_extract(part, '^\\d+\\s*-\\s*(\\d+)$', 1), '') AS INT), try_cast(regexp_extract(part, '^(\\d+)', 1) AS INT)) AS b FROM p)
SELECT p_partkey, asked, CASE WHEN bool_and(ok AND a >= 1 AND b >= a AND b <= 50) THEN list_sort(list_distinct(flatten(list(range(a, b + 1))))) END AS pages FROM n GROUP BY p_partkey, asked""",
)
def page_range_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    asked = F.concat(size, F.lit("-"), size + 3, F.lit(", "), size % 7 + 1, F.when(size % 11 == 0, ", x").otherwise(""))
    return W.page_ranges(table(spark, sf_dir, "part").select("p_partkey", asked.alias("asked")), "asked", F.lit(50))


@query("ST07", "SELECT source, doc_id AS page, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20)::BIGINT AS batch_no FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def extraction_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"))
    done = docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page")), "page", "left_semi")
    return W.batches(docs, done, "source", "page")


@query(
    "SRC03 ST05 JN16 SM11",
    """WITH s AS (SELECT doc_id AS id, 'structured' AS engine, 0 AS r FROM documents WHERE n_chars >= 2000 UNION ALL SELECT doc_id, 'ocr', 1 FROM labels UNION ALL SELECT doc_id, 'plain', 2 FROM documents)
SELECT id, engine, r AS source_rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r) AS n FROM s) WHERE n = 1""",
)
def engine_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    named = lambda df, e: df.select(F.col("doc_id").alias("id"), F.lit(e).alias("engine"))
    return W.first_available([named(docs.where("n_chars >= 2000"), "structured"), named(labels, "ocr"), named(docs, "plain")], ["id"])


_LEAK = r"^[A-Z][A-Za-z &-]+\s+\d{1,4}$"
_HYPHEN = r"\p{L}{2,}-\n+\p{Ll}{2,}"


def _audit_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages with what an extractor would report, derived from their text, and each document's totals."""
    rows = pages(spark, sf_dir)
    lines = lines_of(rows)
    columns = L.detect_columns(geometry_of(lines)).select("source", "page", F.col("confidence").alias("layout_confidence"))
    t = F.col("text")
    ocr = t.rlike("[ñÑ]")
    blocks = F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""))
    quality = rows.select(
        "source", "page", F.length(t).alias("characters"), ocr.alias("ocr_applied"), F.when(ocr, 0).otherwise(blocks).alias("text_blocks"), F.contains(t, F.lit("%%%")).alias("corrupt"),
        T.count_of(t, "###").alias("gaps"), T.count_of(t, r"\*\*\*").alias("preserved"), F.contains(t, F.lit("$$$")).alias("fallback_failed"), (t.rlike("ß") & (F.length(t) < 200)).alias("failed"),
    ).join(columns, ["source", "page"], "left")
    repeated = running.repeated_signatures(running.edge_lines(rows)).select("source", "key", F.lit(True).alias("repeated"))
    marked = lines.withColumns({"plain": T.plain_line(F.col("line")), "key": T.line_signature(F.col("line"))}).join(repeated, ["source", "key"], "left")
    leaked = marked.groupBy("source").agg(F.count_if((F.col("plain").rlike(P.PAGE_LABEL) | F.coalesce("repeated", F.lit(False))) & F.col("plain").rlike(_LEAK)).alias("leaked"))
    m = T.document_metrics(t)
    totals = rows.groupBy("source").agg(
        F.sum(m["words"]).alias("words"), F.sum(T.count_of(t, P.TECHNICAL_CUE)).alias("cues"), F.sum(m["equations"] + m["tables"] + m["source_visuals"]).alias("objects"), F.sum(T.count_of(t, _HYPHEN)).alias("hyphens"),
        (F.count("*") + 2).alias("source_pages"), (F.count("*") + 1).alias("selected_pages"),
    )
    return quality, totals.join(leaked, "source")


def _audit_sql() -> str:
    # The views of repeated signatures begin with the same lines as those of columns do.
    tail = _REPEATED[_REPEATED.index("v_plain AS") :]
    eq = r'(?m)^\[SOURCE_VISUAL\b[^\]]*\bkind="equation"[^\]]*\]$'
    on = lambda cond, code: f"count(*) FILTER ({cond}) AS {code}_n, list_sort(coalesce(list(page) FILTER ({cond}), []::BIGINT[]))[1:50] AS {code}_p"
    rules = {
        "LOW_TEXT_PAGES": "characters < 20", "UNPRESERVED_GAPS": "gaps > preserved", "STRUCTURE_COLLAPSE": "NOT ocr AND characters >= 250 AND blocks <= 1", "TEXT_ENCODING_DAMAGE": "corrupt",
        "SOURCE_EVIDENCE_MISSING": "lost", "OCR_ONLY_PAGES": "ocr AND blocks = 0", "LOW_LAYOUT_CONFIDENCE": "layout < 0.6", "PAGE_EXTRACTION_ERRORS": "failed",
    }
    fires = {c: f"{c}_n > 0" for c in rules} | {
        "STRUCTURE_COLLAPSE": "substantial >= 10 AND STRUCTURE_COLLAPSE_n / substantial >= 0.7 AND words > 1000", "NO_TECHNICAL_OBJECTS": "words > 10000 AND cues > 20 AND objects = 0",
        "LOW_TECHNICAL_OBJECTS": "words > 10000 AND cues > 20 AND objects > 0 AND objects < greatest(2, ceil(n / 50))", "WRAP_HYPHENS": "hyphens > 20", "RUNNING_MATTER": "leaked > 0", "OCR_ONLY_DOCUMENT": "ocr_n = n",
        "INCOMPLETE_DOCUMENT": "PAGE_EXTRACTION_ERRORS_n = 0", "PARTIAL_DOCUMENT": "true",
    }
    counts = {c: f"{c}_n" for c in rules} | {"NO_TECHNICAL_OBJECTS": "1", "LOW_TECHNICAL_OBJECTS": "objects", "WRAP_HYPHENS": "hyphens", "RUNNING_MATTER": "leaked", "OCR_ONLY_DOCUMENT": "ocr_n", "INCOMPLETE_DOCUMENT": "1", "PARTIAL_DOCUMENT": "1"}
    parts = [f"SELECT source, '{c}' AS code, '{s}' AS severity, ({counts[c]})::BIGINT AS count, {f'{c}_p' if c in rules else '[]::BIGINT[]'} AS pages FROM a WHERE {fires[c]}" for c, s in Q.SEVERITY.items()]
    return f"""{_COLUMNS}, {tail},
q AS (SELECT p.source, p.page, length(text) AS characters, regexp_matches(text, '[ñÑ]') AS ocr, CASE WHEN regexp_matches(text, '[ñÑ]') THEN 0 ELSE len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) END AS blocks,
    contains(text, '%%%') AS corrupt, {S.count("text", "###")} AS gaps, {S.count("text", r"\*\*\*")} AS preserved, contains(text, '$$$') AS lost, regexp_matches(text, 'ß') AND length(text) < 200 AS failed, c.confidence AS layout
    FROM v_pages p LEFT JOIN v_columns c ON p.source = c.source AND p.page = c.page),
leak AS (SELECT l.source, count(*) FILTER (({S.label("plain")} OR r.key IS NOT NULL) AND {S.hit("plain", _LEAK)}) AS leaked FROM (SELECT *, {S.signature_of_plain("plain")} AS key FROM v_plain) l LEFT JOIN v_repeated r ON l.source = r.source AND l.key = r.key GROUP BY l.source),
tot AS (SELECT source, sum({S.count(S.plain_text("text"), r"[\p{L}\p{N}]+")}) AS words, sum({S.count("text", P.TECHNICAL_CUE)}) AS cues,
    sum({S.count("text", r"(?m)^\$\$")} // 2 + {S.count("text", eq)} + {S.count("text", r"(?m)^\|.*\|\n\|[-: |]+\|")} + {S.count("text", r"\[SOURCE_VISUAL")}) AS objects, sum({S.count("text", _HYPHEN)}) AS hyphens FROM v_pages GROUP BY source),
g AS (SELECT source, count(*) AS n, count(*) FILTER (ocr) AS ocr_n, count(*) FILTER (NOT ocr AND characters >= 250) AS substantial, {", ".join(on(cond, code) for code, cond in rules.items())} FROM q GROUP BY source),
a AS (SELECT g.*, leaked, words, cues, objects, hyphens FROM g JOIN leak USING (source) JOIN tot USING (source)),
issues AS ({" UNION ALL ".join(parts)})"""


@query("QA01", f"WITH {_audit_sql()} SELECT * FROM issues")
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.audit(*_audit_inputs(spark, sf_dir))


@query(
    "SNK03",
    f"WITH {_audit_sql()} SELECT a.source, CASE WHEN bool_or(severity = 'error') THEN 'needs-review' WHEN count(code) > 0 THEN 'warnings' ELSE 'pass' END AS status, count(code)::BIGINT AS issues FROM a LEFT JOIN issues i ON a.source = i.source GROUP BY a.source",
)
def quality_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, documents = _audit_inputs(spark, sf_dir)
    return Q.status(Q.audit(rows, documents), documents)


_EVIDENCE = """v_evidence AS (SELECT d.doc_id, CASE WHEN quality IS NOT NULL THEN 0.5 + 0.45 * quality END AS recognition, CASE WHEN n_chars > 200 THEN 0.9 END AS structural, CASE WHEN toxic IS NOT NULL THEN 0.95 - 0.6 * toxic END AS extra,
    CASE d.lang WHEN 'en' THEN 'high' WHEN 'de' THEN 'medium' WHEN 'fr' THEN 'low' END AS level, CASE WHEN n_chars > 20000 THEN 'preserved' END AS given FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
v_score AS (SELECT *, CASE WHEN recognition IS NULL AND structural IS NULL AND extra IS NULL THEN 0 ELSE round((coalesce(recognition, 0) + coalesce(structural, 0) + coalesce(extra * 0.5, 0)) / (CASE WHEN recognition IS NULL THEN 0 ELSE 1 END + CASE WHEN structural IS NULL THEN 0 ELSE 1 END + CASE WHEN extra IS NULL THEN 0 ELSE 0.5 END), 6) END::DOUBLE AS score FROM v_evidence),
v_policy AS (SELECT *, coalesce(given, CASE WHEN recognition IS NULL AND structural IS NULL AND extra IS NULL AND level IS NULL THEN 'preserved' WHEN level = 'high' AND score >= 0.82 THEN 'accepted' WHEN level IN ('high', 'medium') AND score >= 0.55 THEN 'review' WHEN score >= 0.82 THEN 'accepted' WHEN score >= 0.55 THEN 'review' ELSE 'preserved' END) AS disposition FROM v_score)"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    parts = {
        "recognition": F.when(F.col("quality").isNotNull(), 0.5 + 0.45 * F.col("quality")),
        "structural": F.when(F.col("n_chars") > 200, 0.9),
        "extra": F.when(F.col("toxic").isNotNull(), 0.95 - 0.6 * F.col("toxic")),
    }
    rows = docs.select("doc_id", "lang", "n_chars", *(c.alias(n) for n, c in parts.items()))
    level = F.when(F.col("lang") == "en", "high").when(F.col("lang") == "de", "medium").when(F.col("lang") == "fr", "low")
    known = F.col("recognition").isNotNull() | F.col("structural").isNotNull() | F.col("extra").isNotNull()
    rows = rows.withColumns({"score": F.round(Q.weighted_score({n: F.col(n) for n in parts}), 6), "level": level, "given": F.when(F.col("n_chars") > 20000, "preserved")})
    return rows.withColumn("disposition", Q.policy(F.col("score"), known, F.col("level"), F.col("given")))


@query("AG14 EQ13", f"WITH {_EVIDENCE} SELECT doc_id, score, disposition FROM v_policy")
def evidence_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("doc_id", "score", "disposition")


@query(
    "AG04 AG07 AG16",
    f"""WITH {_EVIDENCE}, l AS (SELECT disposition, unnest(['recognition', 'structural', 'extra']) AS dimension, unnest([recognition, structural, extra])::DOUBLE AS value FROM v_policy)
SELECT disposition, dimension, count(value)::BIGINT AS known, count(*) FILTER (value IS NULL)::BIGINT AS unknown, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM l GROUP BY disposition, dimension""",
)
def confidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.confidence_summary(_evidence(spark, sf_dir), ["disposition"], ["recognition", "structural", "extra"])


@query(
    "RV01 SO02",
    f"WITH {_EVIDENCE} SELECT (row_number() OVER (ORDER BY e.doc_id // 10, e.doc_id) - 1)::BIGINT AS place, e.doc_id AS id, e.doc_id // 10 AS page, disposition FROM v_policy e WHERE disposition <> 'accepted'",
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _evidence(spark, sf_dir).where("disposition <> 'accepted'").select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 10).alias("page"), "disposition")
    # Places over the whole queue without one big window: counts of the pages before, and places in a page.
    before = items.groupBy("page").agg(F.count("*").alias("n"))
    blocks = before.withColumn("block", F.floor(F.col("page") / 1000))
    sums = blocks.groupBy("block").agg(F.sum("n").alias("m"))
    sums = sums.withColumn("block_start", F.coalesce(F.sum("m").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = blocks.join(sums, "block").withColumn("start", F.col("block_start") + F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = items.join(starts.select("page", "start"), "page").withColumn("place", F.col("start") + F.row_number().over(Window.partitionBy("page").orderBy("id")) - 1)
    return Q.review_queue(placed.select("place", "id", "page", "disposition"))


@query(
    "RV02",
    f"""WITH {_EVIDENCE}, a AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'accept' WHEN doc_id % 3 = 1 THEN 'edit' ELSE 'keep-original' END AS action FROM v_policy)
SELECT doc_id, action, CASE action WHEN 'accept' THEN CASE WHEN score >= 0.6 AND disposition <> 'preserved' THEN 'accepted' ELSE 'review' END WHEN 'edit' THEN CASE WHEN structural IS NOT NULL AND score >= 0.82 THEN 'review' ELSE 'preserved' END ELSE 'preserved' END AS decided FROM a""",
)
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("doc_id") % 3 == 0, "accept").when(F.col("doc_id") % 3 == 1, "edit").otherwise("keep-original")
    rows = _evidence(spark, sf_dir).withColumn("action", action)
    decided = Q.decide(F.col("action"), F.col("disposition"), F.col("score") >= 0.6, F.col("structural").isNotNull(), F.col("score"))
    return rows.select("doc_id", "action", decided.alias("decided"))


@query(
    "AG11 AG19",
    f"WITH {_EVIDENCE} SELECT e.disposition, d.lang AS kind, count(*)::BIGINT AS n FROM v_policy e JOIN documents d ON e.doc_id = d.doc_id GROUP BY GROUPING SETS ((e.disposition), (d.lang), ())",
)
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evidence(spark, sf_dir).withColumnRenamed("lang", "kind")
    return rows.groupingSets([["disposition"], ["kind"], []], "disposition", "kind").agg(F.count("*").alias("n")).select("disposition", "kind", "n")
