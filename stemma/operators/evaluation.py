"""Evaluation of recognised text against gold text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def character_error_rate(gold: Column, text: Column) -> Column:
    """Edit distance over the gold's length; with empty gold 0 or 1."""
    return F.when(F.length(gold) > 0, F.levenshtein(gold, text) / F.length(gold)).otherwise(F.when(F.length(text) > 0, 1.0).otherwise(0.0))


def edit_distance(a: list, b: list) -> int:
    """Between two sequences of anything hashable, a row of the table at a time."""
    if len(a) < len(b):
        a, b = b, a
    codes: dict = {}
    x, y = (np.array([codes.setdefault(t, len(codes)) for t in s], dtype=np.int64) for s in (a, b))
    steps = np.arange(len(y) + 1)
    row = steps.copy()
    for i, code in enumerate(x.tolist(), 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (y != code))
        new = np.concatenate([[i], best])
        row = np.minimum.accumulate(new - steps) + steps  # insertions run along the row
    return int(row[-1])


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of strings."""

    @F.pandas_udf("long")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else edit_distance(list(p), list(q)) for p, q in zip(left, right, strict=True)], dtype="Int64")

    return run(a, b)


def word_error_rate(gold: Column, text: Column) -> Column:
    """Token edit distance over the gold's number of words."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    g, t = words(gold), words(text)
    return F.when(F.size(g) > 0, token_distance(g, t) / F.size(g)).otherwise(F.when(F.size(t) > 0, 1.0).otherwise(0.0))


def align_lines(gold: DataFrame, lines: DataFrame, key: str, accept: float = 0.65) -> DataFrame:
    """gold (key, gold_no, text), lines (key, line_no, text) -> (key, line_no, gold_no, rate): each line's best gold line; null where
    none comes near."""
    pairs = lines.withColumnRenamed("text", "t").join(gold.withColumnRenamed("text", "g"), key)
    rate = character_error_rate(F.col("g"), F.col("t"))
    best = pairs.groupBy(key, "line_no").agg(F.min(F.struct(rate.alias("rate"), F.col("gold_no"))).alias("m"))
    return best.select(key, "line_no", F.when(F.col("m.rate") <= accept, F.col("m.gold_no")).alias("gold_no"), F.col("m.rate").alias("rate"))


def reading_order_error(aligned: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """(key, error): edit distance between the gold order and the order of the aligned lines, over the gold's lines."""
    n = gold.groupBy(key).agg(F.count("*").cast("int").alias("n"))
    rows = aligned.join(n, key)
    got = rows.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("gold_no", F.col("n") + F.col("line_no")).cast("string").alias("g")))).alias("x"))
    want = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i.cast("string"))
    return got.select(key, (token_distance(want, F.transform("x", lambda p: p["g"])) / F.greatest(F.lit(1), "n")).alias("error"))
