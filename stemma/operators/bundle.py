"""Bundles of files: manifest with digests, and checking one against what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators.workflow import numbered_in_stretches

#: Bounds on a bundle. Fixed values.
MOST_ENTRIES, MOST_BYTES = 4096, 768 * 1024 * 1024


def manifest(files: DataFrame, bundle: str, name: str, content: str, folder: str = "documents") -> DataFrame:
    """(bundle, path, bytes, sha256): safe names; files of one name get a number behind it, in order of their digest."""
    digest = F.sha2(F.encode(content, "UTF-8"), 256)
    rows = files.select(bundle, T.safe_identifier(F.col(name)).alias("stem"), F.octet_length(content).cast("long").alias("bytes"), digest.alias("sha256"))
    nth = F.col("nth")
    rows = numbered_in_stretches(rows, [bundle, "stem"], ["sha256", "bytes"], F.substring("sha256", 1, 3))
    rows = rows.withColumn("path", F.concat(F.lit(f"{folder}/"), "stem", F.when(nth > 1, F.concat(F.lit("-"), nth)).otherwise(""), F.lit(".md")))
    return rows.select(bundle, "path", "bytes", "sha256")


def verify(listed: DataFrame, found: DataFrame, bundle: str) -> DataFrame:
    """(bundle, path, problem) of files that are missing, not listed, or not as listed."""
    a, b = listed.alias("a"), found.alias("b")
    both = a.join(b, (F.col(f"a.{bundle}") == F.col(f"b.{bundle}")) & (F.col("a.path") == F.col("b.path")), "full")
    problem = (
        F.when(F.col("b.path").isNull(), "missing").when(F.col("a.path").isNull(), "unlisted").when(F.col("a.bytes") != F.col("b.bytes"), "size").when(F.col("a.sha256") != F.col("b.sha256"), "digest")
    )
    return both.select(F.coalesce(f"a.{bundle}", f"b.{bundle}").alias(bundle), F.coalesce("a.path", "b.path").alias("path"), problem.alias("problem")).where("problem is not null")


def unsafe_paths(entries: DataFrame, bundle: str) -> DataFrame:
    """Adds safe: a relative path without empty, dot or parent parts, backslashes, drives or control signs, inside the
    bounds on entries and bytes of its bundle."""
    path = F.col("path")
    good = ~path.rlike(r"^/|\\|^[A-Za-z]:|[\x00-\x1f]") & ~F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))
    w = Window.partitionBy(bundle)
    return entries.withColumn("safe", good & (F.count("*").over(w) <= MOST_ENTRIES) & (F.sum("bytes").over(w) <= MOST_BYTES))
