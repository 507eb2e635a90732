"""Jobs and their events: replay, state machine, idempotent requests, sessions, bands, allow-lists, plans of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The legal steps of a job. Fixed values.
TRANSITIONS = [
    ("created", "receiving"), ("receiving", "queued"), ("queued", "running"), ("running", "cancelling"), ("cancelling", "cancelled"), ("running", "completed"),
    ("created", "cancelled"), ("receiving", "cancelled"), ("queued", "cancelled"), ("created", "failed"), ("receiving", "failed"), ("queued", "failed"), ("running", "failed"),
]
RING = 128
#: Upper bounds in milliseconds and names of durations; then of load times and of layout shifts. Fixed values.
DURATION_BANDS = [(100, "under_100ms"), (500, "100_499ms"), (2000, "500_1999ms"), (10000, "2_9s"), (None, "10s_plus")]
LOAD_BANDS = [(800, "under_800ms"), (2500, "800_2500ms"), (4000, "2500_4000ms"), (None, "over_4000ms")]


def numbered(events: DataFrame, job: str, order: list[str]) -> DataFrame:
    """Adds sequence, from 1 in each job."""
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy(job).orderBy(*order)).cast("long"))


def replay(events: DataFrame, cursors: DataFrame, job: str, limit: int = RING) -> DataFrame:
    """cursors (job, after) -> (job, after, earliest, latest, delivered, gap): what a client that has read up to `after` gets. Only
    the last RING events are held; one that needs an earlier event has a gap and gets none."""
    span = events.groupBy(job).agg(F.max("sequence").alias("latest"))
    span = span.withColumn("earliest", F.greatest(F.lit(1), F.col("latest") - RING + 1))
    out = cursors.join(span, job).withColumn("gap", F.col("after") + 1 < F.col("earliest"))
    rest = F.greatest(F.lit(0), F.least(F.lit(limit), F.col("latest") - F.col("after")))
    return out.withColumn("delivered", F.when(F.col("gap"), 0).otherwise(rest).cast("long"))


def sequence_gaps(events: DataFrame, job: str, sequence: str) -> DataFrame:
    """(job, after, next, missing) wherever numbers are left out."""
    nxt = F.lead(sequence).over(Window.partitionBy(job).orderBy(sequence))
    rows = events.withColumn("next", nxt).where(F.col("next") > F.col(sequence) + 1)
    return rows.select(job, F.col(sequence).alias("after"), "next", (F.col("next") - F.col(sequence) - 1).alias("missing"))


def transitions(events: DataFrame, job: str, state: str = "state") -> DataFrame:
    """Adds previous and legal; a job's first state is legal if it is created."""
    legal = events.sparkSession.createDataFrame(TRANSITIONS, "previous string, next string").withColumn("ok", F.lit(True))
    rows = events.withColumn("previous", F.lag(state).over(Window.partitionBy(job).orderBy("sequence")))
    rows = rows.join(F.broadcast(legal.withColumnRenamed("next", state)), ["previous", state], "left")
    return rows.withColumn("legal", F.when(F.col("previous").isNull(), F.col(state) == "created").otherwise(F.coalesce("ok", F.lit(False)))).drop("ok")


def idempotent(requests: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """(keys, requests, distinct, conflict): repeats of a request are fine, another under the same key is a conflict."""
    out = requests.groupBy(*keys).agg(F.count("*").alias("requests"), F.countDistinct(digest).alias("distinct"))
    return out.withColumn("conflict", F.col("distinct") > 1)


def sessions(events: DataFrame, job: str, ts: str = "ts", idle_seconds: int = 1800, last: str = "event_type") -> DataFrame:
    """(job, session_no, first, last, n, last_event): a pause over idle_seconds ends a session."""
    by = Window.partitionBy(job).orderBy(ts, "event_id")
    pause = F.timestamp_diff("MILLISECOND", F.lag(ts).over(by), F.col(ts))
    rows = events.withColumn("_new", F.when(pause > idle_seconds * 1000, 1).otherwise(0))
    rows = rows.withColumn("session_no", F.sum("_new").over(by))
    return rows.groupBy(job, "session_no").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"), F.max_by(last, F.struct(ts, "event_id")).alias("last_event"))


def band(value: Column, bands: list[tuple[float | None, str]]) -> Column:
    """Name of the first band whose bound is over the value; null for what is negative or no number."""
    out = F.lit(bands[-1][1])
    for bound, name in reversed(bands[:-1]):
        out = F.when(value < bound, name).otherwise(out)
    return F.when((value >= 0) & ~F.isnan(value.cast("double")), out)


def allowed(events: DataFrame, allow: DataFrame, event: str, action: Column, actions: list[str]) -> DataFrame:
    """Events of the allow-list only; an unknown action becomes other."""
    return events.join(F.broadcast(allow), event, "left_semi").withColumn("action", F.when(action.isin(actions), action).otherwise("other"))


def page_ranges(requests: DataFrame, text: str, total: Column) -> DataFrame:
    """Adds pages array<int>, sorted and distinct, from "1-3, 7"; null if any part is malformed or out of range."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    start = lambda p: F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")
    end = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"^\d+\s*-\s*(\d+)$", 1), F.lit("")).try_cast("int"), start(p))
    good = F.forall(parts, lambda p: F.coalesce(p.rlike(r"^\d+(?:\s*-\s*\d+)?$") & (start(p) >= 1) & (end(p) >= start(p)) & (end(p) <= total), F.lit(False)))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(start(p), end(p))))))
    return requests.withColumn("pages", F.when(good, pages))


def numbered_in_stretches(rows: DataFrame, keys: list[str], order: list[str], stretch: Column) -> DataFrame:
    """Adds nth, from 1 in order within the keys, without a task that gets all rows of a key: rows are numbered inside stretches of
    the order, and only the stretches' sizes meet. stretch must rise with the order and be no other for equal rows."""
    rows = rows.withColumn("stretch", stretch)
    sizes = rows.groupBy(*keys, "stretch").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(*keys, "stretch").orderBy(*order))
    return rows.join(sizes.select(*keys, "stretch", before.alias("before")), [*keys, "stretch"]).withColumn("nth", own + F.col("before")).drop("stretch", "before")


def batches(pages: DataFrame, done: DataFrame, document: str, page: str, size: int = 20) -> DataFrame:
    """(document, page, batch_no) of the pages that have no checkpoint yet."""
    pending = numbered_in_stretches(pages.join(done, [document, page], "left_anti"), [document], [page], F.floor(F.col(page) / 4096))
    return pending.withColumn("batch_no", F.floor((F.col("nth") - 1) / size)).drop("nth")


def first_available(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the first source that has the key: a chain of fallbacks. Adds source_rank."""
    ranked = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    rows = ranked[0]
    for s in ranked[1:]:
        rows = rows.unionByName(s)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("source_rank"))).where("_r = 1").drop("_r")
