"""Folds over many groups at once: the results of one group after the other."""

import random
import time

from stemma.operators import contracts, folds


def _plain_rows(values, reach):
    rows = []
    for v in values:
        if not rows or abs(v - sum(rows[-1]) / len(rows[-1])) > reach:
            rows.append([])
        rows[-1].append(v)
    return rows


def test_rows_join_within_reach_of_their_mean():
    import numpy as np

    from stemma.operators.batches import running_rows

    rng = random.Random(3)
    groups = [sorted(rng.random() * 40 for _ in range(rng.choice([1, 2, 7, 60]))) for _ in range(90)]
    starts = np.cumsum([0, *map(len, groups)])[:-1]
    reach = np.array([rng.choice([0.0, 0.3, 2.5, 90.0]) for _ in groups])
    new, mean = running_rows()(starts, np.array([v for g in groups for v in g]), reach)
    want = [r for g, far in zip(groups, reach, strict=True) for r in _plain_rows(g, far)]
    ends = np.append(np.flatnonzero(new)[1:], len(new)) - 1
    assert np.diff(np.append(np.flatnonzero(new), len(new))).tolist() == [len(r) for r in want]
    assert mean[ends].tolist() == [sum(r) / len(r) for r in want]


def test_a_group_longer_than_a_batch_is_whole(spark):
    from pyspark.sql import functions as F

    from stemma.operators.batches import in_groups

    def work(table, starts):
        import numpy as np
        import pyarrow as pa

        return pa.table({"k": table.column("k").take(pa.array(starts)), "n": np.diff(np.append(starts, len(table)))})

    rows = spark.range(700_000).select(F.when(F.col("id") % 100 == 0, F.when(F.col("id") % 300 > 0, F.col("id").cast("string"))).otherwise("long").alias("k"))
    got = {r.k: r.n for r in in_groups(rows, ["k"], "k string, n long", work).collect()}
    assert got.pop("long") == 693_000 and got.pop(None) == 2_334 and len(got) == 4_666 and set(got.values()) == {1}
    assert in_groups(rows.where("false"), ["k"], "k string, n long", work).collect() == []


def test_many_small_pages_of_tables_are_quick(spark):
    from pyspark.sql import functions as F

    c = F.col("id") % 8
    items = spark.range(1_600_000).select(
        F.floor(F.col("id") / 8).alias("page"), c.alias("no"), F.lit("w").alias("text"), (c % 2 * 200.0).alias("x0"), (F.floor(c / 2) * 14.0).alias("y0"), (c % 2 * 200.0 + 100).alias("x1"), (F.floor(c / 2) * 14.0 + 10).alias("y1")
    )
    rules = spark.range(1).select(F.lit(0).cast("long").alias("page"), F.lit(3).alias("horizontal"), F.lit(None).cast("int").alias("vertical"), F.lit(" ").alias("caption"))
    began = time.perf_counter()
    tables = contracts.page_tables(items, ["page"]).groupBy("rows", "columns", "confidence").count().collect()
    evidence = contracts.table_evidence(items, rules, ["page"]).groupBy("disposition", "signals").count().collect()
    assert [tuple(r) for r in tables] == [(4, 2, 0.99, 200_000)]
    assert sorted((r.disposition, "vector-rules" in r.signals, r["count"]) for r in evidence) == [("reconstructed", False, 199_999), ("reconstructed", True, 1)]
    assert time.perf_counter() - began < 45


def test_items_without_text_or_area_are_no_cells(spark):
    nan = float("nan")
    grid = [(1, 10 * r + c, "a", 50.0 + 150 * c, 14.0 * r, 150.0 + 150 * c, 10 + 14.0 * r) for r in range(3) for c in range(2)]
    odd = [(1, 90, "", 0.0, 0.0, 9.0, 9.0), (1, 91, None, 5.0, 90.0, 5.0, 99.0), (1, 92, "b", 0.0, 0.0, nan, 9.0), (1, 93, "b", 0.0, None, 9.0, 9.0), (1, 94, "b", 9.0, 0.0, 0.0, 9.0), (2, 0, "", 0.0, 0.0, 9.0, 9.0)]
    items = spark.createDataFrame(grid + odd, "page long, no long, text string, x0 double, y0 double, x1 double, y1 double")
    assert [(r.page, r.rows, r.columns, r.cells) for r in contracts.page_tables(items, ["page"]).collect()] == [(1, 3, 2, [["a", "a"]] * 3)]


def _plain_fragments(boxes, shared=0.65, alike=0.55, gap=12.0, gap_share=1.1):
    done = []
    for box in boxes:
        at = 0
        while at < len(done):
            other = done[at]
            tall, high = other[3] - other[1], box[3] - box[1]
            low, top = sorted((max(1.0, tall), max(1.0, high)))
            lower = min(tall, high)
            over = max(0.0, min(other[3], box[3]) - max(other[1], box[1])) / lower if lower > 0 else 0.0
            apart = max(0.0, max(other[0], box[0]) - min(other[2], box[2]))
            at += 1
            if over >= shared and low / top >= alike and apart <= max(gap, low * gap_share):
                box, at = (min(box[0], other[0]), min(box[1], other[1]), max(box[2], other[2]), max(box[3], other[3])), 0
                done.remove(other)
        done.append(box)
    return sorted(done)


def test_fragments_of_many_pages_equal_those_of_one(spark):
    rng, rows, want = random.Random(5), [], {}
    for page in range(120):
        boxes, n, wide = [], rng.choice([1, 3, 12, 40, 150]), rng.choice([60, 400, 3000])
        for _ in range(n):
            x, y = rng.random() * wide, rng.choice([float(rng.randint(0, 9) * 14), rng.random() * 60])
            boxes.append((x, y, x + rng.choice([-3.0, 0.0, 8.0, 35.0]), y + rng.choice([0.0, 6.0, 10.0, 12.0, 30.0])))
        rows += [(page, no, *b) for no, b in enumerate(boxes)]
        want[page] = _plain_fragments(boxes)
    rng.shuffle(rows)
    got = {}
    for r in folds.fragments_on_a_line(spark.createDataFrame(rows, "page long, no long, x0 double, y0 double, x1 double, y1 double"), ["page"]).collect():
        got.setdefault(r.page, []).append((r.x0, r.y0, r.x1, r.y1))
    assert {p: sorted(b) for p, b in got.items()} == want


def _plain_parts(own):
    """own: (no, text, x0, y0, x1, y1, size) -> the part of each."""
    middle = [(c[3] + c[5]) / 2 for c in own]
    typical = max(4.0, sorted(c[5] - c[3] for c in own)[len(own) // 2])
    if len(own) < 2 or max(middle) - min(middle) <= typical * 0.8:
        return [0] * len(own)
    held, at = [], [0] * len(own)
    for i in sorted(range(len(own)), key=lambda i: (middle[i], own[i][2], own[i][0])):
        reach = max(2.0, min(typical, own[i][6]) * 0.65)
        g = next((j for j, h in enumerate(held) if abs(middle[i] - sum(h) / len(h)) <= reach), len(held))
        if g == len(held):
            held.append([])
        held[g].append(middle[i])
        at[i] = g
    centre = [sum(h) / len(h) for h in held]
    rank = {g: r for r, g in enumerate(sorted(range(len(held)), key=lambda g: centre[g]))}
    return [rank[g] for g in at]


def test_baselines_of_many_captures_equal_those_of_one(spark):
    rng, rows, want, texts = random.Random(11), [], {}, {}
    for key in range(150):
        own = []
        for no in range(rng.choice([1, 2, 9, 60])):
            x, y = float(rng.randint(0, 30)), rng.choice([float(rng.randint(0, 6) * 7), rng.random() * 90])
            own.append((no, rng.choice(["a", "bé", "", None]), x, y, x + 5, y + rng.choice([3.0, 10.0, 12.0]), rng.choice([2.0, 10.0, 40.0])))
        rows += [(key, *c) for c in own]
        parts = _plain_parts(own)
        want |= {(key, c[0]): p for c, p in zip(own, parts, strict=True)}
        for p in set(parts):
            line = sorted((c[2], c[0], c[1]) for c, q in zip(own, parts, strict=True) if q == p and c[1] is not None)
            texts[key, p] = " ".join(t for _, _, t in line)
    rng.shuffle(rows)
    chars = spark.createDataFrame(rows, "line long, no long, text string, x0 double, y0 double, x1 double, y1 double, size double")
    assert {(r.line, r.no): r.part for r in folds.split_by_baseline(chars, ["line"]).collect()} == want
    assert {(r.line, r.part): r.text for r in folds.baseline_texts(chars, ["line"]).collect()} == texts


def test_many_small_captures_are_quick(spark):
    from pyspark.sql import functions as F

    c = F.col("id") % 8
    chars = spark.range(4_800_000).select(
        F.floor(F.col("id") / 8).alias("line"), c.alias("no"), F.lit("w").alias("text"), (c % 4 * 50.0).alias("x0"), (F.floor(c / 4) * 20.0).alias("y0"), (c % 4 * 50.0 + 45).alias("x1"), (F.floor(c / 4) * 20.0 + 10).alias("y1"), F.lit(10.0).alias("size")
    )
    began = time.perf_counter()
    parts = folds.baseline_texts(chars, ["line"]).groupBy("part", "text").count().collect()
    boxes = folds.fragments_on_a_line(chars, ["line"]).groupBy("x0", "y0", "x1", "y1").count().collect()
    assert sorted(map(tuple, parts)) == [(0, "w w w w", 600_000), (1, "w w w w", 600_000)]
    assert sorted(map(tuple, boxes)) == [(0.0, 0.0, 195.0, 10.0, 600_000), (0.0, 20.0, 195.0, 30.0, 600_000)]
    assert time.perf_counter() - began < 60


def test_packed_spans_are_the_spans(spark):
    from pyspark.sql import functions as F

    from stemma.operators.batches import in_groups
    from stemma.plans import further_queries as Q

    folder = "/root/testdata/sf0.001"
    names = ["source", "page", "no", "text", "x0", "y0", "x1", "y1"]

    def work(table, starts):
        return table

    plain = Q._spans(spark, folder).select(names)
    for keep, where in ((None, "true"), (lambda i: i % 5 != 3, "no % 100000 % 5 <> 3")):
        packed = Q._packed_spans(spark, folder, keep).select(names)
        assert dict(packed.dtypes) == {c: f"array<{t}>" if c not in ("source", "page") else t for c, t in plain.dtypes}
        got = in_groups(packed, ["source", "page"], plain.schema, work, together=True).collect()
        pages = [(r.source, r.page) for r in got]
        assert len(set(pages)) == 1 + sum(a != b for a, b in zip(pages, pages[1:]))  # a page's rows lie together
        assert sorted(got) == sorted(plain.where(where).orderBy(F.col("no")).collect())
