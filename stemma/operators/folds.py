"""Operators whose result depends on what earlier rows became: ordered folds over the rows of one page or one key.

They run in Arrow batches with one key's rows together (`applyInPandas`); a key is a page or a text of a page, which bounds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ratio(a, b) -> float:
    """Shared area over the smaller area."""
    across = max(0.0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]))
    down = max(0.0, min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]))
    smaller = min((r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) for r in (a, b))
    return across * down / smaller if smaller > 0 else 0.0


def greedy_dedupe(rows: DataFrame, keys: list[str], order: list[str], least: float = 0.94) -> DataFrame:
    """Rows in order, without those whose box overlaps that of a kept row of the same key by `least`. What is kept has boxes
    apart from each other, so the kept rows of a page are few. Keys may be many and small: a task goes through its sorted
    rows once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept = None, []
        for part in batches:
            keep = []
            for own, box in zip(part[keys].itertuples(index=False, name=None), part["box"], strict=True):
                if own != key:
                    key, kept = own, []
                fresh = not any(_ratio(box, other) >= least for other in kept)
                if fresh:
                    kept.append(box)
                keep.append(fresh)
            yield part[keep]

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, rows.schema)


def merge_visual_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines (keys, no, text, x0, y0, x1, y1, size) -> the same, with neighbours of one visual line merged. A line is compared with what
    the one before it has become."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for row in part.sort_values("no").to_dict("records"):
            if not (row["text"] or "").strip():
                continue
            last = out[-1] if out else None
            if last and _same_line(last, row):
                gap = row["x0"] - last["x1"]
                space = "" if gap <= 1 or last["text"].endswith(" ") else " "
                last |= {"text": last["text"] + space + row["text"], "x0": min(last["x0"], row["x0"]), "y0": min(last["y0"], row["y0"]), "x1": max(last["x1"], row["x1"]), "y1": max(last["y1"], row["y1"])}
            else:
                out.append(dict(row))
        return pd.DataFrame(out, columns=part.columns)

    return lines.groupBy(*keys).applyInPandas(run, lines.schema)


def _same_line(a: dict, b: dict) -> bool:
    if b["x0"] + max(2.0, b["size"] * 0.45) < a["x0"]:
        return False
    size = max(6.0, min(a["size"], b["size"]))
    if max(0.0, b["x0"] - a["x1"], a["x0"] - b["x1"]) > max(3.0, size * 0.85):
        return False
    shared = min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
    lower = min(a["y1"] - a["y0"], b["y1"] - b["y0"])
    return (lower > 0 and shared / lower >= 0.2) or abs(a["y1"] - b["y1"]) <= size * 0.42


def rows_by_drifting_mean(items: DataFrame, keys: list[str], value: str = "y", tolerance: float = 7.2) -> DataFrame:
    """Adds row_no: sorted values join the last row while they are within tolerance of its running mean."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(value, kind="stable")
        numbers, mean, n, at = [], 0.0, 0, -1
        for v in part[value]:
            if n == 0 or abs(v - mean) > tolerance:
                at, mean, n = at + 1, float(v), 1
            else:
                n += 1
                mean += (v - mean) / n
            numbers.append(at)
        return part.assign(row_no=numbers)

    from pyspark.sql import types as t

    return items.groupBy(*keys).applyInPandas(run, t.StructType([*items.schema.fields, t.StructField("row_no", t.LongType())]))


def group_by_proximity(vectors: DataFrame, keys: list[str], proximity: float) -> DataFrame:
    """vectors (keys, no, x0, y0, x1, y1) -> (keys, group_no, n, x0, y0, x1, y1): a vector joins the first group whose grown box it comes
    near, and grows it."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        groups: list[list] = []
        for v in part.sort_values("no").itertuples(index=False):
            for g in groups:
                if not (v.x1 < g[1] - proximity or v.x0 > g[3] + proximity or v.y1 < g[2] - proximity or v.y0 > g[4] + proximity):
                    g[:] = [g[0] + 1, min(g[1], v.x0), min(g[2], v.y0), max(g[3], v.x1), max(g[4], v.y1)]
                    break
            else:
                groups.append([1, v.x0, v.y0, v.x1, v.y1])
        key = {k: part[k].iloc[0] for k in keys}
        return pd.DataFrame([{**key, "group_no": i, "n": g[0], "x0": g[1], "y0": g[2], "x1": g[3], "y1": g[4]} for i, g in enumerate(groups)])

    kinds = ", ".join(f"`{k}` {vectors.schema[k].dataType.simpleString()}" for k in keys)
    return vectors.groupBy(*keys).applyInPandas(run, f"{kinds}, group_no long, n long, x0 double, y0 double, x1 double, y1 double")


def dedupe_nearby(entries: DataFrame, keys: list[str], body: float = 10.0) -> DataFrame:
    """entries (keys, no, kind, markdown, y): without equations that repeat the last kept one of the same text close by."""
    limit = max(12.0, body * 3.2)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        last: dict[str, float] = {}
        keep = []
        for r in part.sort_values("no").itertuples(index=False):
            equation = r.kind in ("equation", "equation-fallback") and bool(r.markdown)
            if equation and r.markdown in last and abs(r.y - last[r.markdown]) <= limit:
                continue
            if equation:
                last[r.markdown] = r.y
            keep.append(r)
        return pd.DataFrame(keep, columns=part.columns)

    return entries.groupBy(*keys).applyInPandas(run, entries.schema)


def spans_to_lines(spans: DataFrame, keys: list[str], reach: float = 0.5) -> DataFrame:
    """spans (keys, no, text, x0, y0, x1, y1) -> adds line_no: by y then x, a span joins the first line whose band it shares at least `reach`
    of the lower height with, and widens the band. First fit, so the order matters."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["y0", "x0", "no"], kind="stable")
        bands: list[list[float]] = []
        numbers = []
        for s in part.itertuples(index=False):
            for i, band in enumerate(bands):
                lower = min(band[1] - band[0], s.y1 - s.y0)
                if lower > 0 and (min(band[1], s.y1) - max(band[0], s.y0)) / lower >= reach:
                    band[0], band[1] = min(band[0], s.y0), max(band[1], s.y1)
                    numbers.append(i)
                    break
            else:
                bands.append([s.y0, s.y1])
                numbers.append(len(bands) - 1)
        return part.assign(line_no=numbers)

    from pyspark.sql import types as t

    return spans.groupBy(*keys).applyInPandas(run, t.StructType([*spans.schema.fields, t.StructField("line_no", t.LongType())]))


def safe_json(texts: DataFrame, keys: list[str], text: str, depth: int = 32, nodes: int = 100_000) -> DataFrame:
    """(keys, problem): null where a JSON text is fine; else malformed, depth, nodes, number (not finite) or key (one that
    would reach an object's prototype)."""
    import json
    import math

    def check(raw: str | None) -> str | None:
        if raw is None:
            return "malformed"
        try:
            stack, seen = [(json.loads(raw), 1)], 0
        except (ValueError, RecursionError):
            return "malformed"
        while stack:
            value, level = stack.pop()
            seen += 1
            if level > depth:
                return "depth"
            if seen > nodes:
                return "nodes"
            if isinstance(value, float) and not math.isfinite(value):
                return "number"
            if isinstance(value, dict):
                if not value.keys().isdisjoint({"__proto__", "prototype", "constructor"}):
                    return "key"
                stack += [(v, level + 1) for v in value.values()]
            elif isinstance(value, list):
                stack += [(v, level + 1) for v in value]
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield part[keys].assign(problem=[check(t) for t in part[text]])

    kinds = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)
    return texts.select(*keys, text).mapInPandas(run, f"{kinds}, problem string")


def cell_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """cells (keys, row_no, text, x0, y0) -> (keys, row_no, y, starts): the rows that can be a table's, of 2 to 8 cells, each of
    at most 90 characters and 12 words and without braces. Other rows are no part of a table, as a whole."""
    short = (F.length("text") <= 90) & (F.size(F.split("text", r"\s+")) <= 12) & ~F.col("text").rlike("[{}]")
    rows = cells.groupBy(*keys, "row_no").agg(F.min("y0").alias("y"), F.array_sort(F.collect_list("x0")).alias("starts"), F.bool_and(short).alias("short"))
    return rows.where(F.col("short") & F.size("starts").between(2, 8)).drop("short")


def longest_aligned_run(rows: DataFrame, keys: list[str], tolerance: float = 22.0, most_gap: float = 52.0) -> DataFrame:
    """rows (keys, row_no, y, starts array<double>) -> (keys, first, last, columns): the longest run of three rows or more whose cells are as many
    and start where those of the run's first row do; the earliest of equal ones. Keys without one have no row."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row_no")
        starts, ys, numbers = [list(s) for s in part["starts"]], part["y"].tolist(), part["row_no"].tolist()
        best = (0, 0)
        for i, own in enumerate(starts):
            j = i + 1
            while j < len(starts) and len(starts[j]) == len(own) and ys[j] - ys[j - 1] <= most_gap and all(abs(a - b) <= tolerance for a, b in zip(starts[j], own, strict=True)):
                j += 1
            if j - i > best[1] - best[0]:
                best = (i, j)
        i, j = best
        found = [{**{k: part[k].iloc[0] for k in keys}, "first": numbers[i], "last": numbers[j - 1], "columns": len(starts[i])}] if j - i >= 3 else []
        return pd.DataFrame(found, columns=[*keys, "first", "last", "columns"])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, first long, last long, columns long")


def fragments_on_a_line(boxes: DataFrame, keys: list[str], shared: float = 0.65, alike: float = 0.55, gap: float = 12.0, gap_share: float = 1.1, together: bool = False) -> DataFrame:
    """boxes (keys, no, x0, y0, x1, y1) -> (keys, x0, y0, x1, y1): boxes of about one height on one visual line become one, until no two
    can any more. A box takes in all it touches, grows and looks again; boxes one below the other stay apart. Boxes with a bare strip
    between them, or a wider gap than their heights allow, never meet, so the parts of a page between such gaps are merged side by
    side. together: each key's rows already lie one after the other in one partition, each row with arrays of boxes."""

    def parts(box, group):
        """The part of each box: numbers that rise with the group."""
        import numpy as np

        def cut(low, high, owner, free):
            order = np.lexsort((low, owner))
            by_high = np.argsort(high, kind="stable")
            rank = np.empty(len(high), dtype=np.int64)
            rank[by_high] = np.arange(len(high))
            reached = high[by_high[np.maximum.accumulate(owner[order] * len(high) + rank[order]) % len(high)]]
            new = np.ones(len(low), dtype=bool)
            new[1:] = (owner[order][1:] != owner[order][:-1]) | free(low[order][1:], reached[:-1], owner[order][1:])
            out = np.empty(len(low), dtype=np.int64)
            out[order] = np.cumsum(new) - 1
            return out, order, np.flatnonzero(new)

        x0, y0, x1, y1 = box.T
        band, order, first = cut(y0, y1, group, lambda low, reached, _: low >= reached)
        height = np.maximum.reduceat(y1[order], first) - np.minimum.reduceat(y0[order], first)
        reach = np.maximum(gap, np.maximum(1.0, height) * max(gap_share, 0.0))
        return cut(x0, x1, band, lambda low, reached, owner: low - reached > reach[owner])[0]

    def merged(box, first, count):
        """The boxes that are left of each part, and their parts; a part's boxes lie one after the other. All parts take their next box at once."""
        import numpy as np

        order = np.argsort(-count, kind="stable")
        first, left = first[order], -count[order]
        done, alive, used = np.zeros((len(first), 4, 4)), np.zeros((len(first), 4), dtype=bool), 0
        out, owners = [], []

        def flush(m):
            part, at = np.nonzero(alive[m:, :used])
            out.append(done[m:][part, at])
            owners.append(order[m + part])

        for i in range(int(count.max(initial=0))):
            m = int(np.searchsorted(left, -i))
            if m < len(done):
                flush(m)
                done, alive = done[:m], alive[:m]
            if used == done.shape[1]:  # those taken in make room
                at = np.argsort(~alive, axis=1, kind="stable")
                used = int(alive.sum(axis=1).max())
                at = at[:, :used]
                wider = np.zeros((m, 2 * used + 2, 4))
                wider[:, :used] = np.take_along_axis(done, at[:, :, None], axis=1)
                lives = np.zeros(wider.shape[:2], dtype=bool)
                lives[:, :used] = np.take_along_axis(alive, at, axis=1)
                done, alive = wider, lives
            own = box[first[:m] + i]
            open_ = np.arange(m)
            while used and len(open_):
                d, b = done[open_, :used], own[open_][:, None, :]
                tall, high = d[:, :, 3] - d[:, :, 1], b[:, :, 3] - b[:, :, 1]
                low, top = np.minimum(np.maximum(1.0, tall), np.maximum(1.0, high)), np.maximum(np.maximum(1.0, tall), np.maximum(1.0, high))
                lower = np.minimum(tall, high)
                down = np.minimum(d[:, :, 3], b[:, :, 3]) - np.maximum(d[:, :, 1], b[:, :, 1])
                over = np.where(lower > 0, np.maximum(0, down) / np.where(lower > 0, lower, 1), 0)
                apart = np.maximum(0, np.maximum(d[:, :, 0], b[:, :, 0]) - np.minimum(d[:, :, 2], b[:, :, 2]))
                near = alive[open_, :used] & (over >= shared) & (low / top >= alike) & (apart <= np.maximum(gap, low * gap_share))
                hit = near.any(axis=1)
                open_, at = open_[hit], near[hit].argmax(axis=1)
                other = done[open_, at]
                alive[open_, at] = False
                own[open_] = np.hstack([np.minimum(own[open_, :2], other[:, :2]), np.maximum(own[open_, 2:], other[:, 2:])])
            done[:, used], alive[:, used] = own, True
            used += 1
        flush(0)
        return np.vstack(out), np.concatenate(owners)

    def work(table, starts):
        import numpy as np
        import pyarrow as pa

        box = np.column_stack([table.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")])
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(box))))
        part = parts(box, group) if shared > 0 else group
        order = np.lexsort((table.column("no").to_numpy(), part))
        first = np.flatnonzero(np.diff(part[order], prepend=-1))
        count = np.diff(np.append(first, len(box)))
        found, owner = merged(box[order], first, count)
        at = pa.array(starts[group[order][first]][owner])
        return pa.table([*(table.column(k).take(at) for k in keys), *found.T.copy()], names=[*keys, "x0", "y0", "x1", "y1"])

    from stemma.operators.batches import in_groups

    kinds = ", ".join(f"`{k}` {boxes.schema[k].dataType.simpleString()}" for k in keys)
    kind = "array<double>" if together else "double"
    rows = boxes.select(*keys, "no", *(F.col(c).cast(kind).alias(c) for c in ("x0", "y0", "x1", "y1")))
    return in_groups(rows, keys, f"{kinds}, x0 double, y0 double, x1 double, y1 double", work, together)


def _baseline_parts():
    """The function (starts, no, x0, y0, y1, size) -> the part of each character, as split_by_baseline() says."""

    def parts(starts, no, x0, y0, y1, size):
        import numpy as np

        sizes = np.diff(np.append(starts, len(no)))
        group = np.repeat(np.arange(len(starts)), sizes)
        middle, height = (y0 + y1) / 2, y1 - y0
        typical = height[np.lexsort((height, group))][starts + sizes // 2]
        typical = np.where(typical > 4.0, typical, 4.0)
        mixed = (sizes >= 2) & ~(np.maximum.reduceat(middle, starts) - np.minimum.reduceat(middle, starts) <= typical * 0.8)
        out = np.zeros(len(no), dtype=np.int64)
        rows = np.flatnonzero(mixed[group])
        if not len(rows):
            return out
        least = np.where(size < typical[group], size, typical[group]) * 0.65
        least = np.where(least > 2.0, least, 2.0)
        rows = rows[np.lexsort((no[rows], x0[rows], middle[rows], group[rows]))]
        # Equal ones in a row go the same way: the line that took the first in has only come nearer.
        owner, value, reach = group[rows], middle[rows], least[rows]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1]) | (reach[1:] != reach[:-1])
        run = np.flatnonzero(new)
        many = np.diff(np.append(run, len(rows)))
        owner, value, reach = owner[run], value[run], reach[run]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        count = np.diff(np.append(first, len(run)))
        order = np.argsort(-count, kind="stable")
        start, left = first[order], -count[order]
        total, n, centre = (np.zeros(len(run)) for _ in range(3))  # a group's lines have the places of its runs
        lines, slot = np.zeros(len(first), dtype=np.int64), np.zeros(len(run), dtype=np.int64)
        for i in range(int(count.max())):
            m = int(np.searchsorted(left, -i))
            at = start[:m] + i
            place, rest, s = lines[:m].copy(), np.arange(m), 0
            while len(rest := rest[lines[rest] > s]):
                fits = np.abs(value[at[rest]] - centre[start[rest] + s]) <= reach[at[rest]]
                place[rest[fits]] = s
                rest = rest[~fits]
                s += 1
            lines[:m] += place == lines[:m]
            to = start[:m] + place
            total[to] += value[at] * many[at]
            n[to] += many[at]
            centre[to] = total[to] / n[to]
            slot[at] = place
        there = np.flatnonzero(n)
        base = np.repeat(first, count)  # of each run or line its group's first place
        by = there[np.lexsort((there, centre[there], base[there]))]
        rank = np.empty(len(run), dtype=np.int64)
        opens = np.flatnonzero(np.diff(base[by], prepend=-1))
        rank[by] = np.arange(len(by)) - np.repeat(opens, np.diff(np.append(opens, len(by))))
        out[rows] = np.repeat(rank[base + slot], many)
        return out

    return parts


def split_by_baseline(chars: DataFrame, keys: list[str]) -> DataFrame:
    """chars (keys, no, text, x0, y0, x1, y1, size) of one captured line each -> adds part: 0 where all characters lie about one height, else the
    number, from above, of the visual line that a character's middle belongs to. First fit against a line's mean."""
    from pyspark.sql import types as t

    from stemma.operators.batches import in_groups

    parts = _baseline_parts()

    def work(table, starts):
        import pyarrow as pa

        return table.append_column("part", pa.array(parts(starts, *(table.column(c).to_numpy() for c in ("no", "x0", "y0", "y1", "size")))))

    return in_groups(chars, keys, t.StructType([*chars.schema.fields, t.StructField("part", t.LongType())]), work)


def baseline_texts(chars: DataFrame, keys: list[str], together: bool = False) -> DataFrame:
    """The same chars -> (keys, part, text): the visual lines of split_by_baseline(), each joined from the left by blanks. A character without
    a text adds none. together: each key's rows already lie one after the other in one partition, each row with arrays of characters."""
    from stemma.operators.batches import in_groups

    parts = _baseline_parts()

    def work(table, starts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        no, x0, y0, y1, size = (table.column(c).to_numpy() for c in ("no", "x0", "y0", "y1", "size"))
        part = parts(starts, no, x0, y0, y1, size)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(no))))
        order = np.lexsort((no, x0, part, group))
        own, part = group[order], part[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        text = table.column("text").combine_chunks()
        said = text.is_valid().to_numpy(zero_copy_only=False)[order]
        ends = np.append(0, np.cumsum(np.add.reduceat(said.astype(np.int64), first)))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), text.take(pa.array(order[said])))
        at = pa.array(starts[own[first]])
        return pa.table([*(table.column(k).take(at) for k in keys), part[first], pc.binary_join(lists, " ")], names=[*keys, "part", "text"])

    kinds = ", ".join(f"`{k}` {chars.schema[k].dataType.simpleString()}" for k in keys)
    rows = chars.select(*keys, "no", "text", "x0", "y0", "y1", "size")
    return in_groups(rows, keys, f"{kinds}, part long, text string", work, together)


def graphics(groups: DataFrame, keys: list[str], width: float = 612.0, height: float = 792.0, most: int = 10) -> DataFrame:
    """groups of group_by_proximity() -> those that are graphics: of 4 members or more, a part of the page between .004 and .65, wider than .12
    and higher than .025 of it; the first ten of a page, which is what a page reports."""
    from pyspark.sql import Window

    across, down = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    share = across * down / (width * height)
    good = groups.where((F.col("n") >= 4) & (share >= 0.004) & (share < 0.65) & (across > width * 0.12) & (down > height * 0.025))
    return good.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("group_no"))).where(F.col("r") <= most).drop("r")
