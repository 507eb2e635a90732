"""Runs registered queries against their SQL: python tests/compare.py FOLDER [NAME ...]."""

import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for _, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if hasattr(v, "as_tuple"):
        return round(float(v), 9)
    return v


def differs(spark, query, folder, con):
    """None, or how the two results differ."""
    df = query.run(spark, folder)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if query.sql is None:
        return None if got else "no rows"
    found = con.execute(query.sql)
    have = [d[0] for d in found.description]
    if sorted(have) != names:
        return f"columns {names} and {sorted(have)}"
    at = [have.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    if got == want:
        return None if got else "no rows"
    a, b = [x for x in got if x not in set(want)][:3] if len(got) < 50000 else [], [x for x in want if x not in set(got)][:3] if len(want) < 50000 else []
    return f"{len(got)} and {len(want)} rows; only here {a}; only there {b}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    from stemma.plans.registry import every

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder, names = sys.argv[1], sys.argv[2:]
    con = connect(folder)
    for name, query in every().items():
        if not names or name in names:
            at = time.time()
            try:
                said = differs(spark, query, folder, con)
            except Exception as e:
                said = f"{type(e).__name__} {str(e)[:1500]}"
            print(f"{'ok  ' if said is None else 'BAD '} {name} {time.time() - at:.1f} s {'' if query.sql else '(no SQL)'} {said or ''}", flush=True)
