import random

import pandas as pd

from stemma.streaming import jobs


def _stream(spark, rows, schema, tmp_path, parts=3):
    """The rows as files of a stream, in order."""
    folder = tmp_path / "in"
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder / f"p{i}"))
    files = [f"{folder}/p{i}" for i in range(parts)]
    one = str(tmp_path / "stream")
    (tmp_path / "stream").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(one)
    return stream, files, one


def _run(spark, build, files, one, tmp_path, mode):
    import glob
    import shutil

    out = []
    stream = build
    for i, f in enumerate(files):
        for j, p in enumerate(sorted(glob.glob(f"{f}/*.parquet"))):
            shutil.copy(p, f"{one}/{i}-{j}.parquet")
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, n: out.append(df.toPandas())).start()
        query.awaitTermination()
    return pd.concat(out)


def test_chunks_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for job in range(6):
        number = 0
        for arrival in range(30):
            n = rng.choice([number, number, number, number + 1, max(0, number - 1)])
            rows.append((f"j{job}", n, rng.choice(["a", "a", "b"]), arrival * 10 + job))
            number += n == number
    rows.sort(key=lambda r: r[3])
    schema = "job_id string, chunk_sequence long, sha256 string, arrival long"
    want = jobs.chunk_verdicts(spark.createDataFrame(rows, schema)).toPandas()
    assert set(want["verdict"]) == {"accepted", "repeated", "conflict", "out-of-order"}
    stream, files, one = _stream(spark, rows, schema, tmp_path)
    got = _run(spark, jobs.stream_chunk_verdicts(stream), files, one, tmp_path, "append")
    key = ["job_id", "chunk_sequence", "sha256", "verdict"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, want[key].values))


def test_log_stream_ends_as_batch(spark, tmp_path):
    rows = [(f"j{j}", i, "page-completed" if i < 300 else "completed") for i in range(1, 301) for j in range(4) if not (j == 2 and i == 150)]
    schema = "job_id string, sequence long, event_type string"
    want = {r.job_id: tuple(r) for r in jobs.event_log(spark.createDataFrame(rows, schema)).collect()}
    assert want["j0"] == ("j0", 173, 300, False, True) and want["j2"][3]
    stream, files, one = _stream(spark, rows, schema, tmp_path)
    got = _run(spark, jobs.stream_event_log(stream), files, one, tmp_path, "update")
    last = {r.job_id: tuple(r)[1:] for r in got.itertuples()}
    assert last == want


def test_latest_checkpoints(spark, tmp_path):
    rows = [(1, "a", 1), (1, "b", 2), (2, "c", 1), (1, "d", 3), (2, "e", 1)]
    stream, files, one = _stream(spark, rows, "page long, text string, version long", tmp_path, parts=2)
    import os
    import shutil
    from glob import glob

    for i, f in enumerate(files):
        for p in glob(f"{f}/*.parquet"):
            shutil.copy(p, f"{one}/{i}-{os.path.basename(p)}")
    jobs.sink_latest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["page"], "version").trigger(availableNow=True).start().awaitTermination()
    got = {(r.page, r.version) for r in jobs.read_latest(spark, str(tmp_path / "out"), ["page"], "version").collect()}
    assert got == {(1, 3), (2, 1)}


def test_windowed_counts(spark):
    rows = spark.sql("select timestamp'2024-01-01 10:00:00' as ts, 'view' as event_type union all select timestamp'2024-01-01 23:00:00', 'view' union all select timestamp'2024-01-02 01:00:00', 'click'")
    assert sorted(r.n for r in jobs.windowed_counts(rows).collect()) == [1, 2]
