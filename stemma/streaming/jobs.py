"""Streams of job events and chunks, with state for each job. `transform` functions work on the rows of one job in order, so
the batch forms and the streams give the same results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stemma.operators.workflow import RING

CHUNK_OUT = "job_id string, chunk_sequence long, sha256 string, verdict string"
CHUNK_STATE = "next long, hashes string"


def _judge(part: pd.DataFrame, following: int, hashes: list[str]) -> tuple[list[str], int, list[str]]:
    """Verdicts for a job's chunks as they arrive: accepted, repeated, conflict (the number is known with other content) or
    out-of-order (a number is left out)."""
    verdicts = []
    for number, digest in zip(part["chunk_sequence"], part["sha256"], strict=True):
        if number == following:
            hashes.append(digest)
            following += 1
            verdicts.append("accepted")
        elif number > following:
            verdicts.append("out-of-order")
        else:
            verdicts.append("repeated" if hashes[number] == digest else "conflict")
    return verdicts, following, hashes


def chunk_verdicts(chunks: DataFrame, order: str = "arrival") -> DataFrame:
    """Batch: chunks (job_id, chunk_sequence from 0, sha256, arrival) with a verdict each."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        verdicts, _, _ = _judge(part, 0, [])
        return part.assign(verdict=verdicts)[["job_id", "chunk_sequence", "sha256", "verdict"]]

    return chunks.groupBy("job_id").applyInPandas(run, CHUNK_OUT)


def stream_chunk_verdicts(chunks: DataFrame, order: str = "arrival", idle: str | None = None) -> DataFrame:
    """Stream: the same, keeping for each job the next number and the digests so far. With `idle`, such as "30 minutes", a job that
    was idle that long is forgotten; such a stream has to run on, as its clock does."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        following, hashes = state.get if state.exists else (0, "")
        known = hashes.split(",") if hashes else []
        part = pd.concat(list(parts)).sort_values(order)
        verdicts, following, known = _judge(part, following, known)
        state.update((following, ",".join(known)))
        if idle:
            state.setTimeoutDuration(pd.Timedelta(idle).value // 1_000_000)
        yield part.assign(verdict=verdicts)[["job_id", "chunk_sequence", "sha256", "verdict"]]

    return chunks.groupBy("job_id").applyInPandasWithState(run, CHUNK_OUT, CHUNK_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


LOG_OUT = "job_id string, earliest long, latest long, gap boolean, terminal boolean"
LOG_STATE = "earliest long, latest long, gap boolean, terminal boolean"
TERMINAL = ("completed", "cancelled", "failed")


def _append(part: pd.DataFrame, earliest: int, latest: int, gap: bool, terminal: bool) -> tuple[int, int, bool, bool]:
    for number, kind in zip(part["sequence"], part["event_type"], strict=True):
        gap = gap or (latest > 0 and number > latest + 1)
        latest = max(latest, number)
        terminal = terminal or kind in TERMINAL
    return max(earliest, latest - RING + 1, 1), latest, gap, terminal


def event_log(events: DataFrame) -> DataFrame:
    """Batch: each job's span of held events, whether a number was left out, and whether it has ended."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        e, n, gap, end = _append(part.sort_values("sequence"), 1, 0, False, False)
        return pd.DataFrame([(part["job_id"].iloc[0], e, n, gap, end)], columns=["job_id", "earliest", "latest", "gap", "terminal"])

    return events.groupBy("job_id").applyInPandas(run, LOG_OUT)


def stream_event_log(events: DataFrame) -> DataFrame:
    """Stream, update mode: the same after each micro-batch, for the jobs it had events of. The state of a job is four
    values, whatever its length."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else (1, 0, False, False)
        after = _append(pd.concat(list(parts)).sort_values("sequence"), *before)
        state.update(after)
        yield pd.DataFrame([(*key, *after)], columns=["job_id", "earliest", "latest", "gap", "terminal"])

    return events.groupBy("job_id").applyInPandasWithState(run, LOG_OUT, LOG_STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Stream or batch: events by kind in windows of time, without those that come later than the watermark allows."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sink_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str):
    """Writes a stream of page checkpoints so that the newest of each key stays: each micro-batch is one folder, written whole
    again if it is repeated."""
    from pyspark.sql import Window

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_latest(spark, path: str, keys: list[str], order: str) -> DataFrame:
    from pyspark.sql import Window

    rows = spark.read.parquet(path)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("batch")))).where("_r = 1").drop("_r", "batch")
