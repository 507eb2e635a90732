"""Contracts on records: what is wrong with a message, a request, a run; quotas and retention."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of a runtime, a session and what is kept of results. Fixed values.
MOST_RUNTIME, MOST_SESSION = 1024 * 1024 * 1024, 512 * 1024 * 1024
MOST_RESULTS, MOST_RESULT_BYTES = 8, 128 * 1024 * 1024
#: Keys of a request, languages and pages of one. Fixed values.
REQUEST_KEYS = ("type", "buffer", "pages", "options", "password", "ocrPaths")
LANGUAGES = ("eng", "rus", "fas")
MOST_PAGES, MOST_PAGE_NUMBER = 100, 100_000
#: What a worker may say of its start. Fixed values.
LOAD_STAGE, ENGINE, MOST_START = "mupdf-load", "mupdf-wasm", 120_000


def storage(jobs: DataFrame, session: str, size: str, addition: int) -> DataFrame:
    """(session, bytes, allowed): what each session holds and whether `addition` more bytes fit its quota and the runtime's."""
    held = jobs.groupBy(session).agg(F.sum(size).alias("bytes"))
    runtime = held.agg(F.sum("bytes").alias("runtime"))  # one row
    fits = (F.col("runtime") + addition <= MOST_RUNTIME) & (F.col("bytes") + addition <= MOST_SESSION)
    return held.join(F.broadcast(runtime), F.col("runtime").isNotNull()).select(session, "bytes", fits.alias("allowed"))


def retained(events: DataFrame, session: str, order: list[str], most: int = MOST_RESULTS, most_bytes: int = MOST_RESULT_BYTES) -> DataFrame:
    """events (session, order, kind result or ack, job, bytes) -> the results, with kept: a result stays if with those kept so far
    there are at most `most` of at most `most_bytes`; an ack releases its job's results. A task goes through its sorted
    rows once and holds `most` of them."""
    kinds = events.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for part in batches:
            kept = []
            for key, kind, job, size in part[[session, "kind", "job", "bytes"]].itertuples(index=False, name=None):
                if key != now:
                    now, held = key, []
                if kind == "ack":
                    held = [x for x in held if x[0] != job]
                    kept.append(None)
                else:
                    fits = len(held) < most and sum(x[1] for x in held) + size <= most_bytes
                    held = [*held, (job, size)] if fits else held
                    kept.append(fits)
            out = part.assign(kept=pd.array(kept, dtype="boolean"))
            yield out[out["kind"] == "result"]

    rows = events.repartition(session).sortWithinPartitions(session, *order)
    return rows.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kinds)}, kept boolean")


def message_problem(kind: Column, page: Column, elapsed: Column, progress: Column, text: Column, stage: Column, engine: Column) -> Column:
    """Why a worker's message breaks the contract of its type, or null."""
    paged = F.when(page.isNull() | ~page.between(1, MOST_PAGE_NUMBER), "page")
    start = F.when(stage.isNull() | (stage != LOAD_STAGE), "stage").when(elapsed.isNull() | ~elapsed.between(0, MOST_START), "elapsed")
    long = F.when(F.length(text) > 2048, "message")
    return (
        F.when(kind.isNull(), "type")
        .when(kind == "worker-started", None)
        .when(kind == "engine-loading", start)
        .when(kind == "engine-ready", F.coalesce(F.when(engine.isNull() | (engine != ENGINE), "engine"), start))
        .when(kind.isin("page-start", "page"), paged)
        .when(kind == "ocr-progress", F.coalesce(paged, F.when(progress.isNull() | ~progress.between(0, 1), "progress")))
        .when(kind.isin("ocr-error", "page-error"), F.coalesce(paged, long))
        .when(kind == "done", F.when(page.isNull() | ~page.between(1, MOST_PAGES), "total"))
        .when(kind == "error", F.coalesce(long, F.when(stage.isNull() & elapsed.isNotNull(), "elapsed"), F.when(stage.isNotNull(), start)))
        .otherwise("type")
    )


def request_problem(keys: Column, kind: Column, size: Column, pages: Column, language: Column) -> Column:
    """Why an extraction request is refused, or null."""
    return (
        F.when(F.size(F.array_except(keys, F.array(*map(F.lit, REQUEST_KEYS)))) > 0, "keys")
        .when(kind.isNull() | (kind != "extract"), "type")
        .when(F.coalesce(size, F.lit(0)) <= 0, "bytes")
        .when(pages.isNull() | ~F.size(pages).between(1, MOST_PAGES), "pages")
        .when(F.exists(pages, lambda p: p.isNull() | ~p.between(1, MOST_PAGE_NUMBER)), "page")
        .when(F.size(F.array_distinct(pages)) < F.size(pages), "duplicates")
        .when(language.isNotNull() & ~language.isin(*LANGUAGES), "language")
    )


def run_problems(runs: DataFrame, gold: DataFrame) -> DataFrame:
    """runs (run, class, repeat, mode, document, pages, engine), gold (class, document, pages) -> (run, problem), one row for each thing
    that is wrong with a run; of runs with one key the first is right."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("class", "repeat", "mode").orderBy("run"))
    known = gold.select("class", F.col("document").alias("gold_document"), F.col("pages").alias("gold_pages"))
    rows = runs.withColumn("nth", nth).join(F.broadcast(known), "class", "left")  # one row for each of six classes
    there = F.col("gold_document").isNotNull()
    wrong = {
        "class": ~there, "duplicate": there & (F.col("nth") > 1), "document": there & ~F.col("document").eqNullSafe(F.col("gold_document")), "repeat": there & (F.coalesce("repeat", F.lit(0)) < 1),
        "mode": there & ~F.coalesce(F.col("mode").isin("browser", "companion"), F.lit(False)), "engine": there & (F.coalesce("engine", F.lit("")) == ""), "pages": there & ~F.col("pages").eqNullSafe(F.col("gold_pages")),
    }
    return rows.select("run", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in wrong.items())))).alias("problem"))


def reading_rows(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines (keys, no, text, x0, y0, y1) -> adds row_no and place: by y0 a line joins the row before it if it starts within .35 of the greater
    height of the row's first line; a row with more Arabic than Latin letters is read from the right."""
    from pyspark.sql import Window

    by = Window.partitionBy(*keys)
    own = F.array_sort(F.collect_list(F.struct("y0", "x0", "no", F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")).alias("h"))))
    state = F.struct(F.lit(-1).alias("row"), F.lit(0.0).alias("y"), F.lit(0.0).alias("h"), F.array().cast("array<struct<no:long,row:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        same = (acc["row"] >= 0) & (F.abs(x["y0"] - acc["y"]) <= F.greatest(x["h"], acc["h"]) * 0.35)
        row = F.when(same, acc["row"]).otherwise(acc["row"] + 1)
        out = F.concat(acc["out"], F.array(F.struct(x["no"].cast("long").alias("no"), row.alias("row"))))
        return F.struct(row.alias("row"), F.when(same, acc["y"]).otherwise(x["y0"]).alias("y"), F.when(same, F.greatest(acc["h"], x["h"])).otherwise(x["h"]).alias("h"), out.alias("out"))

    rows = lines.groupBy(*keys).agg(own.alias("own")).select(*keys, F.inline(F.aggregate("own", state, step, lambda a: a["out"])))
    placed = lines.join(rows.withColumnRenamed("row", "row_no"), [*keys, "no"])
    letters = lambda pattern: F.sum(F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).over(Window.partitionBy(*keys, "row_no"))
    turned = placed.withColumn("rtl", letters(r"\p{IsArabic}") > letters(r"\p{IsLatin}"))
    return turned.withColumn("place", F.row_number().over(by.orderBy("row_no", F.when(F.col("rtl"), -F.col("x0")).otherwise(F.col("x0")), "no")) - 1)


def page_tables(items: DataFrame, keys: list[str], body: float = 10.0, width: float = 612.0) -> DataFrame:
    """items (keys, no, text, x0, y0, x1, y1) -> (keys, rows, columns, confidence, y, cells array<array<string>>): the table of a page, if its longest
    run of aligned rows is sure enough and no prose. Rows by the running mean of the middles; rows of 2 to 8 short cells count; a
    run's rows have as many cells, which start where those of its first row do. Items without a text or an area are none."""
    from stemma.operators.batches import in_groups, running_rows, spreading

    rows_of, spread = running_rows(), spreading()
    most_gap, reach, shift = max(body * 4.8, 52), max(2.5, body * 0.72), max(body * 2.2, width * 0.035)

    def work(table, starts):
        import re

        import numpy as np
        import pyarrow as pa

        prose = re.compile(r"\b(?:the|and|that|this|with|from|which|because|therefore)\b", re.I)
        text = table.column("text").combine_chunks()
        coded = text.dictionary_encode()
        known, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        short = np.array([len(t) <= 90 and len(t.split()) <= 12 and not re.search("[{}]", t) for t in known])
        prosy = np.array([len(t.split()) > 10 or bool(prose.search(t)) for t in known])
        rank = np.empty(len(known), dtype=np.int64)
        rank[sorted(range(len(known)), key=known.__getitem__)] = np.arange(len(known))
        x, y = (table.column(c).to_numpy() for c in ("x", "y"))
        sizes = np.diff(np.append(starts, len(x)))
        group = np.repeat(np.arange(len(starts)), sizes)
        order = np.lexsort((x, y, group))
        new, means = rows_of(starts, y[order], np.full(len(starts), reach))
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(x)))
        order = order[np.lexsort((y[order], rank[code[order]], x[order], np.cumsum(new)))]  # the cells of a row from the left
        x, code = x[order], code[order]
        able = np.flatnonzero((n >= 2) & (n <= 8) & np.logical_and.reduceat(short[code], first))
        first, n, mean, page = first[able], n[able], means[first + n - 1][able], group[first][able]
        cells = np.zeros((len(able), 8))
        for c in range(8):
            has = n > c
            cells[has, c] = x[first[has] + c]
        length, going, k = np.ones(len(able), dtype=np.int64), np.arange(len(able)), 1
        while len(going):
            going = going[going + k < len(able)]
            j = going + k
            fits = (page[j] == page[going]) & (n[j] == n[going]) & (mean[j] - mean[j - 1] <= most_gap) & (np.abs(cells[j] - cells[going]) <= shift).all(axis=1)
            going = going[fits]
            length[going] += 1
            k += 1
        pages = np.flatnonzero(np.diff(page, prepend=-1))
        ables = np.diff(np.append(pages, len(able)))
        best = np.maximum.reduceat(length, pages) if len(pages) else length
        hits = np.flatnonzero(length == np.repeat(best, ables))
        run = hits[np.unique(page[hits], return_index=True)[1]]  # the earliest of the longest
        good = (best >= 3) & (sizes[page[run]] >= 6)
        run, best, ables = run[good], best[good], ables[good]
        lines = spread(run, best)
        count = best * n[run]
        said = np.add.reduceat(prosy[code[spread(first[lines], n[lines])]].astype(np.int64), np.cumsum(count) - count) if len(run) else count
        sure = np.array([round(min(0.99, 0.45 + b / m * 0.25 + 0.3) + 1e-12, 3) for b, m in zip(best.tolist(), ables.tolist(), strict=True)], dtype=float)
        good = (said / np.maximum(count, 1) <= 0.28) & (sure >= 0.82)
        run, best, sure = run[good], best[good], sure[good]
        lines = spread(run, best)
        own = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[lines])), pa.int32()), text.take(pa.array(order[spread(first[lines], n[lines])])))
        found = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(best)), pa.int32()), own)
        at = pa.array(starts[page[run]])
        return pa.table([*(table.column(k).take(at) for k in keys), best, n[run], sure, mean[run], found], names=[*keys, "rows", "columns", "confidence", "y", "cells"])

    kinds = ", ".join(f"`{k}` {items.schema[k].dataType.simpleString()}" for k in keys)
    rows = _with_area(items).where("text <> ''").select(*keys, "text", F.col("x0").alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    return in_groups(rows, keys, f"{kinds}, rows long, columns long, confidence double, y double, cells array<array<string>>", work)


def _with_area(items: DataFrame) -> DataFrame:
    """Items whose box has an area, the box as doubles. To Spark NaN is greater than all."""
    boxes = items.withColumns({c: F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")})
    return boxes.where("x1 > x0 and y1 > y0 and not isnan(x1) and not isnan(y1)")


def table_evidence(items: DataFrame, rules: DataFrame, keys: list[str], body: float = 10.0, width: float = 612.0) -> DataFrame:
    """items (keys, no, text, x0, y0, x1, y1): cells of a page; rules (keys, horizontal, vertical, caption): how many rules of each kind it has, and
    its caption -> (keys, rows, columns, signals, diagnostics, detection, structure, disposition) of pages whose cells start at two places
    again and again. What does not fit leaves a diagnostic and is never filled in. Of several rows of rules for a page the greatest counts."""
    from stemma.operators.batches import in_groups, running_rows, spreading

    rows_of, spread = running_rows(), spreading()
    near, wide = max(body * 1.8, width * 0.018), max(body * 1.45, 3)

    def work(table, starts):
        import numpy as np
        import pyarrow as pa

        y, x0, x1, height = (table.column(c).to_numpy() for c in ("y", "x0", "x1", "height"))
        sizes = np.diff(np.append(starts, len(y)))
        group = np.repeat(np.arange(len(starts)), sizes)
        typical = height[np.lexsort((height, group))][starts + sizes // 2]
        order = np.lexsort((x1, x0, y, group))
        new, _ = rows_of(starts, y[order], np.maximum(2.5, typical * 0.8))
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(y)))
        page = group[first]
        begins = np.flatnonzero(np.diff(page, prepend=-1))  # every page has a row
        rows, longest = np.diff(np.append(begins, len(page))), np.maximum.reduceat(n, begins)
        row = np.cumsum(new) - 1
        order = order[np.lexsort((x1[order], x0[order], row))]
        apart = np.full(len(y), -np.inf)
        apart[1:] = np.where(row[1:] == row[:-1], x0[order][1:] - x1[order][:-1], -np.inf)
        gaps = np.add.reduceat((apart >= wide).astype(np.int64), starts)

        # Starts that follow each other closely are one place, at their mean.
        x = x0[np.lexsort((x0, group))]
        opens = np.ones(len(x), dtype=bool)
        opens[1:] = (group[1:] != group[:-1]) | (x[1:] - x[:-1] > near)
        at = np.flatnonzero(opens)
        many = np.diff(np.append(at, len(x)))
        _, means = rows_of(at, x, np.full(len(at), np.inf))
        centre = means[at + many - 1]
        held = np.add.reduceat((np.abs(x - np.repeat(centre, many)) <= near).astype(np.int64), at)
        owner = group[at]
        columns = np.bincount(owner[held >= np.maximum(2, np.ceil(rows * 0.45))[owner]], minlength=len(starts))
        whole = np.add.reduceat((n == columns[page]).astype(np.int64), begins)

        good = np.flatnonzero((sizes >= 3) & (rows >= 3) & (longest >= 2) & (columns >= 2))
        rows, columns, whole, gaps = rows[good], columns[good], whole[good], gaps[good]
        share = whole / rows
        base = 0.45 + share * 0.3 + np.minimum(0.2, columns * 0.04)
        out = [rows, columns, gaps >= np.maximum(2, rows - 1), whole == rows]
        for more in (0, 0.08):
            structure = np.minimum(0.98, base + more)
            values, back = np.unique(structure, return_inverse=True)
            rounded = np.array([round(v, 6) for v in values.tolist()], dtype=float)[back]
            out += [rounded, np.where((structure >= 0.82) & (share == 1), "reconstructed", np.where(structure >= 0.62, "reconstructed-with-source", "preserved-source"))]
        names = ["rows", "columns", "grid", "whole", "plain", "plain_disposition", "ruled", "ruled_disposition"]
        return pa.table([*(table.column(k).take(pa.array(starts[good])) for k in keys), *(pa.array(v, pa.string()) if v.dtype.kind == "U" else v for v in out)], names=[*keys, *names])

    c = F.col
    kinds = ", ".join(f"`{k}` {items.schema[k].dataType.simpleString()}" for k in keys)
    cells = _with_area(items).where("text is null or text <> ''").select(*keys, "x0", "x1", ((c("y0") + c("y1")) / 2).alias("y"), (c("y1") - c("y0")).alias("height"))
    found = in_groups(cells, keys, f"{kinds}, rows long, columns long, grid boolean, whole boolean, plain double, plain_disposition string, ruled double, ruled_disposition string", work)
    rule = rules.groupBy(*keys).agg(F.max(F.struct("horizontal", "vertical", "caption")).alias("rule"))
    level, upright = (F.coalesce(c(f"rule.{k}").cast("long"), F.lit(0)) for k in ("horizontal", "vertical"))
    captioned = F.coalesce(c("rule.caption").cast("string").rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))
    some = lambda *pairs: F.array_compact(F.array(*(F.when(when, F.lit(name)) for name, when in pairs)))
    always = [(name, F.lit(True)) for name in ("repeated-x-starts", "repeated-y-bands", "cell-like-boxes", "repeated-row-patterns")]
    signals = some(*always, ("whitespace-grid", c("grid")), ("vector-rules", level + upright > 0), ("nearby-caption", captioned))
    diagnostics = some(("unresolved-cell", ~c("whole")), ("borderless-evidence", upright == 0))
    detection = F.when(level != 0, round(min(0.98, 0.55 + 0.18 + 0.15), 6)).otherwise(round(min(0.98, 0.55 + 0.18 + 0), 6))
    either = lambda name: F.when(level >= 3, c(f"ruled{name}")).otherwise(c(f"plain{name}"))
    return found.join(rule, keys, "left").select(
        *keys, "rows", "columns", signals.alias("signals"), diagnostics.alias("diagnostics"), detection.alias("detection"), either("").alias("structure"), either("_disposition").alias("disposition")
    )
