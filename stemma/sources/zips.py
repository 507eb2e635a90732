"""Bundles as ZIP files: their entries, read without unpacking anything to disk."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from stemma.operators.bundle import MOST_BYTES, MOST_ENTRIES

#: An entry that would grow more than this on unpacking is refused.
MOST_RATIO = 200
ENTRIES = "bundle string, path string, bytes long, sha256 string, problem string"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(bundle, path, bytes, sha256, problem) of every entry of the ZIP files under path."""
    return entries_of(spark.read.format("binaryFile").load(path).select("path", "content"))


def _inspect(name: str, content: bytes) -> list[tuple]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return [(name, None, None, None, "not-a-zip")]
    listed = archive.infolist()
    if len(listed) > MOST_ENTRIES or sum(e.file_size for e in listed) > MOST_BYTES:
        return [(name, None, None, None, "too-large")]
    rows = []
    for e in listed:
        parts = e.filename.split("/")
        if e.is_dir():
            continue
        if e.filename.startswith("/") or "\\" in e.filename or any(p in ("", ".", "..") for p in parts):
            rows.append((name, e.filename, e.file_size, None, "unsafe-path"))
        elif e.file_size > MOST_RATIO * max(e.compress_size, 1):
            rows.append((name, e.filename, e.file_size, None, "ratio"))
        elif e.flag_bits & 1:
            rows.append((name, e.filename, e.file_size, None, "encrypted"))
        else:
            digest = hashlib.sha256()
            with archive.open(e) as f:
                while block := f.read(1 << 20):
                    digest.update(block)
            rows.append((name, e.filename, e.file_size, digest.hexdigest(), None))
    return rows


def entries_of(files: DataFrame) -> DataFrame:
    """The same from a table (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [r for name, content in zip(part["path"], part["content"], strict=True) for r in _inspect(name, bytes(content))]
            yield pd.DataFrame(rows, columns=["bundle", "path", "bytes", "sha256", "problem"]).astype({"bytes": "Int64"})

    return files.select("path", "content").mapInPandas(run, ENTRIES)
