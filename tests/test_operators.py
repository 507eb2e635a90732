"""Small fixtures: what the operators must and must not do."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from stemma.functions import geometry as G
from stemma.functions import text as T
from stemma.operators import bundle, evaluation, folds, layout, markdown, quality, running, tables, visuals, workflow
from stemma.operators.trees import descendants
from stemma.sources import ocr, zips


def _lines(spark, pages):
    rows = [(s, p, i, line) for s, p, text in pages for i, line in enumerate(text.split("\n")) if line.strip()]
    return spark.createDataFrame(rows, "source string, page long, line_no int, line string")


def test_running_heads_go_and_chapters_stay(spark):
    rows = [("a", i, f"Annual Report {i}\nChapter One\n{'text body ' * 5}{i}\nPage {i}") for i in range(1, 5)]
    pages = spark.createDataFrame(rows, "source string, page long, text string")
    edges = running.edge_lines(pages)
    judged = running.decisions(edges, running.repeated_signatures(edges), running.common_tokens(edges))
    actions = {(r.key, r.action) for r in judged.collect()}
    assert ("annual report", "REMOVE") in actions and not any(a == "REMOVE" for k, a in actions if "chapter" in k)
    left = {x for r in running.strip_running_matter(pages, judged).collect() for x in r.text.split("\n")}
    assert "Chapter One" in left and not any(x.startswith(("Annual", "Page ")) for x in left)


def test_edges_run_on_over_labels(spark):
    text = "1\n\n2 / 9\nANNUAL REPORT\nbody text that goes on and on\nmore of it\n9"
    edges = running.edge_lines(spark.createDataFrame([("a", 1, text), ("a", 2, "one\n" * 9), ("a", 3, " \n")], "source string, page long, text string")).collect()
    got = {(r.page, r.position): [] for r in edges}
    for r in sorted(edges, key=lambda r: r.line_no):
        got[r.page, r.position].append(r.line_no)
    assert got == {(1, "header"): [0, 2, 3], (1, "footer"): [6], (2, "header"): [0, 1], (2, "footer"): [7, 8]}


def test_merged_lines_keep_their_own_words(spark):
    judged = spark.createDataFrame([("a", 1, 0, "MERGE", "Own words"), ("a", 1, 2, "REMOVE", None), ("a", 1, 1, "KEEP", None)], "source string, page long, line_no int, action string, merged string")
    pages = spark.createDataFrame([("a", 1, "Annual Report Own words\nbody\n7\nend"), ("a", 2, "left\n\nas it is")], "source string, page long, text string")
    assert {r.page: (r.lines, r.text) for r in running.strip_running_matter(pages, judged).collect()} == {1: (3, "Own words\nbody\nend"), 2: (2, "left\nas it is")}


def test_numbering_in_stretches(spark):
    from stemma.operators.workflow import numbered_in_stretches

    rows = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 3 * i) for i in range(9)], "d string, p long")
    got = {(r.d, r.p): r.nth for r in numbered_in_stretches(rows, ["d"], ["p"], F.floor(F.col("p") / 7)).collect()}
    assert got == {("a", i): i + 1 for i in range(50)} | {("b", 3 * i): i + 1 for i in range(9)}


def test_two_pages_need_two_repeats(spark):
    n = spark.createDataFrame([(i,) for i in (1, 2, 8, 9, 100)], "n long").select(running.least_pages(F.col("n")).alias("k")).collect()
    assert [r.k for r in n] == [2, 2, 2, 3, 3]


@pytest.mark.parametrize(
    "line,size,font,level",
    [("1.2 Deep Title", 10, "", 2), ("1 The list is long", 10, "", None), ("Chapter IV", 10, "", 1), ("CONTENTS", 10, "", 1), ("Contents", 10, "", None), ("A Title of Words", 15, "", 1), ("A Title of Words", 12.5, "", 2), ("not a title", 15, "", None), ("2024 was good", 15, "", None), ("Ends here.", 20, "Bold", None)],
)
def test_heading_levels(spark, line, size, font, level):
    row = spark.createDataFrame([(line,)], "l string").select(T.heading_level(F.col("l"), F.lit(float(size)), F.lit(10.0), F.lit(font)).alias("x")).first()
    assert row.x == level


def test_heading_hierarchy_is_clamped(spark):
    text = "# A\n#### B\n#### B\n### 1.2 C\nplain\n# chapter 3 D\n###### E"
    out = markdown.heading_hierarchy(spark.createDataFrame([("s", 1, text)], "source string, page long, text string")).first().outline
    assert out == "# A\n## B\n## 1.2 C\nplain\n# chapter 3 D\n## E"


def test_hyphens_are_mended_outside_fences_only(spark):
    lines = _lines(spark, [("a", 1, "an exam-\nple that goes o-\nn and com-\npounds\n```\nx-\nyz\n```\n- list-\nitem")])
    out = [r.text for r in markdown.repair_hyphens(lines, ["source", "page"]).orderBy("first").collect()]
    assert out == ["an example that goes o-", "n and compounds", "```", "x-", "yz", "```", "- list-", "item"]


def _boxes(spark, rows):
    return spark.createDataFrame([("d", 1, i, t, *b, s) for i, (t, b, s) in enumerate(rows)], "source string, page int, line_no int, line string, x0 int, y0 int, x1 int, y1 int, size int")


def test_two_columns_with_a_title_across(spark):
    rows = [("Title", (50, 20, 560, 40), 16)] + [(f"L{i}", (50, 60 + 20 * i, 280, 70 + 20 * i), 10) for i in range(4)] + [(f"R{i}", (320, 60 + 20 * i, 550, 70 + 20 * i), 10) for i in range(4)]
    placed = _boxes(spark, rows)
    columns = layout.detect_columns(placed)
    assert columns.first().n_columns == 2
    order = [r.line for r in layout.reading_order(placed, columns).orderBy("order_no").collect()]
    assert order == ["Title", "L0", "L1", "L2", "L3", "R0", "R1", "R2", "R3"]


@pytest.mark.parametrize("right,reason", [([(320, 60, 550, 70)], "ambiguous-column-split"), ([(270, 60 + 20 * i, 500, 70 + 20 * i) for i in range(4)], "overlapping-column-evidence")])
def test_no_columns_from_sparse_or_overlapping_evidence(spark, right, reason):
    left = [(50, 60 + 20 * i, 300, 70 + 20 * i) for i in range(4)]
    found = layout.detect_columns(_boxes(spark, [("x", b, 10) for b in [*left, *right]])).first()
    assert (found.n_columns, found.reason) == (1, reason)


def test_box_algebra(spark):
    row = spark.range(1).select(G.box(*map(F.lit, (0, 0, 10, 10))).alias("a"), G.box(*map(F.lit, (5, 5, 25, 10))).alias("b"), G.box(F.lit(float("nan")), F.lit(0), F.lit(1), F.lit(1)).alias("none"))
    a, b = F.col("a"), F.col("b")
    got = row.select(G.overlap_ratio(a, b), G.vertical_overlap(a, b), G.intersects(a, b), G.union(a, b)["x1"], F.col("none").isNull(), G.point_distance(F.lit(13.0), F.lit(14.0), a)).first()
    assert tuple(got) == (0.25, 1.0, True, 25.0, True, 5.0)


def test_tables_do_not_invent_cells(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a|b", 1, 1, False), (1, 0, 1, "c", 1, 1, False), (1, 1, 0, "", 1, 1, False), (1, 1, 1, "d", 1, 1, False), (2, 0, 0, "x", 1, 2, False), (2, 1, 0, "y", 1, 1, False)], "table_id int, row int, col int, text string, row_span int, col_span int, observed_empty boolean")
    found = tables.diagnose(cells, spark.createDataFrame([(1, 0.9), (2, 0.9)], "table_id int, structure double"))
    rows = {r.table_id: r for r in found.collect()}
    assert rows[1].empty == 1 and rows[1].confidence == 0.61 and rows[2].missing == 1
    assert not any(r.markdown for r in tables.representable(cells, found).collect())
    assert tables.to_markdown(cells).where("table_id = 1").first().markdown == "| a\\|b | c |\n| --- | --- |\n|  | d |"
    parsed = tables.parse_markdown(spark.createDataFrame([("| a \\| b | c |",), ("|---|:---:|",)], "line string")).collect()
    assert [r.cells for r in parsed] == [["a | b", "c"], None]


def test_visual_classes(spark):
    base = dict(id=0, class_hint=None, source_kind="vector", hints="", n_images=0, vector_nodes=0, vector_edges=0, rules=0, nodes=0, edges=0, ambiguous=False, width=10.0, height=10.0, has_source=True, chart_structure=None)
    cases = [({"nodes": 2, "edges": 1}, "graph-flowchart", "reconstructed-with-source"), ({"nodes": 2, "edges": 1, "ambiguous": True}, "unresolved-visual", "preserved-source"), ({"hints": "a separator"}, "separator", "omitted-decoration"), ({"rules": 1, "height": 1.0}, "separator", "preserved-source"), ({"hints": "Bar chart"}, "chart", "preserved-source"), ({"hints": "bar chart", "chart_structure": 0.9}, "chart", "reconstructed-with-source"), ({"n_images": 1}, "ordinary-image", "preserved-source")]
    schema = "id int, class_hint string, source_kind string, hints string, n_images int, vector_nodes int, vector_edges int, rules int, nodes int, edges int, ambiguous boolean, width double, height double, has_source boolean, chart_structure double"
    rows = spark.createDataFrame([tuple((base | c | {"id": i}).values()) for i, (c, _, _) in enumerate(cases)], schema)
    assert [(r["class"], r.disposition) for r in visuals.classify(rows).orderBy("id").collect()] == [(k, d) for _, k, d in cases]


def test_page_ranges(spark):
    rows = spark.createDataFrame([("1-3, 7,2",), ("0-2",), ("3-1",), ("a",), ("9",), ("4 - 5",)], "t string")
    assert [r.pages for r in workflow.page_ranges(rows, "t", F.lit(8)).collect()] == [[1, 2, 3, 7], None, None, None, None, [4, 5]]


def test_replay_has_a_gap_beyond_the_ring(spark):
    events = spark.createDataFrame([("a", i) for i in range(1, 201)], "job string, sequence long")
    cursors = spark.createDataFrame([("a", 10), ("a", 72), ("a", 150), ("a", 200)], "job string, after long")
    got = {r.after: (r.gap, r.delivered) for r in workflow.replay(events, cursors, "job").collect()}
    assert got == {10: (True, 0), 72: (False, 128), 150: (False, 50), 200: (False, 0)}


def test_policy_asks_for_review_on_medium_evidence(spark):
    rows = spark.createDataFrame([(0.9, "high"), (0.9, "medium"), (0.9, None), (0.6, "low"), (0.3, "high")], "s double, l string")
    got = rows.select(quality.policy(F.col("s"), F.lit(True), F.col("l"), F.lit(None).cast("string")).alias("d")).collect()
    assert [r.d for r in got] == ["accepted", "review", "accepted", "review", "preserved"]


def test_a_queue_over_its_cap_is_an_error(spark):
    items = spark.createDataFrame([(2, "b"), (1, "a")], "page int, id string")
    assert [r.id for r in quality.review_queue(items, 2).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="more than 1 review items"):
        quality.review_queue(items, 1).collect()


def test_edit_distances(spark):
    assert evaluation.edit_distance(list("kitten"), list("sitting")) == 3
    assert evaluation.edit_distance([], ["a"]) == 1 and evaluation.edit_distance(["a", "b"], ["b", "a"]) == 2
    row = spark.createDataFrame([("a b c", "a x c d"), ("", "x"), ("", "")], "g string, t string").select(evaluation.word_error_rate(F.col("g"), F.col("t")).alias("w")).collect()
    assert [round(r.w, 4) for r in row] == [0.6667, 1.0, 0.0]


def test_reading_order_error(spark):
    gold = spark.createDataFrame([("d", i, t) for i, t in enumerate(["first line", "second thing", "third part"])], "k string, gold_no int, text string")
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(["second thinq", "first line", "third part"])], "k string, line_no int, text string")
    aligned = evaluation.align_lines(gold, lines, "k")
    assert [r.gold_no for r in aligned.orderBy("line_no").collect()] == [1, 0, 2]
    assert round(evaluation.reading_order_error(aligned, gold, "k").first().error, 4) == 0.6667


def test_bundles(spark, tmp_path):
    files = spark.createDataFrame([("b", "a?", "x"), ("b", "a!", "y"), ("b", "", "z")], "bundle string, name string, text string")
    listed = bundle.manifest(files, "bundle", "name", "text")
    assert sorted(r.path for r in listed.collect()) == ["documents/a-2.md", "documents/a.md", "documents/item.md"]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("documents/a.md", "x")
        z.writestr("../evil", "x")
        z.writestr("documents/big", "0" * 1_000_000, compress_type=zipfile.ZIP_DEFLATED)
    (tmp_path / "b.zip").write_bytes(buffer.getvalue())
    (tmp_path / "c.zip").write_bytes(b"no zip")
    got = {(r.path, r.problem) for r in zips.read_entries(spark, str(tmp_path)).collect()}
    assert got == {("documents/a.md", None), ("../evil", "unsafe-path"), ("documents/big", "ratio"), (None, "not-a-zip")}


def test_recognised_words(spark):
    words = [(5, 1, 1, 1, 1, 2, 40.0, 10.0, 30.0, 9.0, 90.0, "b"), (5, 1, 1, 1, 1, 1, 0.0, 12.0, 30.0, 9.0, 70.0, "a"), (4, 1, 1, 1, 1, 3, 0.0, 0.0, 9.0, 9.0, 90.0, "no"), (5, 1, 1, 1, 1, 4, 0.0, 0.0, 9.0, 9.0, -1.0, "no"), (5, 1, 1, 1, 1, 5, 0.0, 0.0, 9.0, 9.0, 90.0, " ")]
    row = ocr.lines_from_words(spark.createDataFrame(words, ocr.TSV), 0.5, 0.5).first()
    assert (row.text, row.x0, row.y0, row.x1, row.y1, row.confidence) == ("a b", 0.0, 5.0, 35.0, 10.5, 0.8)


def test_ordered_folds(spark):
    spans = spark.createDataFrame([(1, i, t, float(x), float(y), float(x + 20), float(y + 10)) for i, (t, x, y) in enumerate([("b", 40, 1), ("a", 0, 0), ("c", 0, 30), ("d", 30, 33)])], "page int, no long, text string, x0 double, y0 double, x1 double, y1 double")
    got = {r.text: r.line_no for r in folds.spans_to_lines(spans, ["page"]).collect()}
    assert got["a"] == got["b"] != got["c"] == got["d"]
    boxes = spark.createDataFrame([(1, i, (0.0, 0.0, 10.0, w)) for i, w in enumerate((10.0, 9.9, 5.0, 10.0))], "page int, no int, box struct<x0:double,y0:double,x1:double,y1:double>")
    assert [r.no for r in folds.greedy_dedupe(boxes, ["page"], ["no"], 1.01).orderBy("no").collect()] == [0, 1, 2, 3]
    assert [r.no for r in folds.greedy_dedupe(boxes, ["page"], ["no"]).collect()] == [0]
    rows = spark.createDataFrame([(1, float(y)) for y in (0, 5, 9, 13, 30)], "page int, y double")
    assert sorted((r.y, r.row_no) for r in folds.rows_by_drifting_mean(rows, ["page"], tolerance=6.0).collect()) == [(0.0, 0), (5.0, 0), (9.0, 1), (13.0, 1), (30.0, 2)]
    entries = spark.createDataFrame([(1, i, k, m, float(y)) for i, (k, m, y) in enumerate([("equation", "x", 0), ("equation", "x", 20), ("equation", "x", 50), ("text", "x", 51)])], "page int, no int, kind string, markdown string, y double")
    assert [r.no for r in folds.dedupe_nearby(entries, ["page"]).orderBy("no").collect()] == [0, 2, 3]


def test_rows_of_cells_are_whole_lines(spark):
    def row(no, texts):
        return [(1, no, t, 72.0 + 40 * i, 60.0 + 14 * no) for i, t in enumerate(texts)]

    lines = [["w"] * 9, ["w"] * 12, ["w"] * 20, ["a", "b"], ["c", "d"], ["e", "f"], ["one"], ["x" * 91, "y"], ["{", "y"], ["w " * 12 + "w", "y"], ["x" * 90, "y"], ["w"] * 8]
    cells = spark.createDataFrame([c for no, texts in enumerate(lines) for c in row(no, texts)], "page int, row_no long, text string, x0 double, y0 double")
    rows = folds.cell_rows(cells, ["page"])
    assert sorted((r.row_no, len(r.starts)) for r in rows.collect()) == [(3, 2), (4, 2), (5, 2), (10, 2), (11, 8)]
    assert [tuple(r) for r in folds.longest_aligned_run(rows.where("row_no < 10"), ["page"]).collect()] == [(1, 3, 5, 2)]


def test_prose_is_no_aligned_run(spark, tmp_path):
    from stemma.plans.registry import every

    text = "\n".join(" ".join(["word"] * n) for n in (10, 14, 9, 12, 11))
    spark.createDataFrame([(1, "s", text), (2, "s", "a b\nc d\ne f")], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = every()["aligned_runs"].run(spark, str(tmp_path)).where("source = 's'").collect()
    assert [tuple(r) for r in got] == [("s", 2, 0, 2, 2)]


def test_longest_aligned_run(spark):
    rows = [(1, 0, 0.0, [0.0, 90.0]), (1, 1, 20.0, [0.0, 50.0]), (1, 2, 40.0, [5.0, 55.0]), (1, 3, 60.0, [0.0, 50.0]), (1, 4, 200.0, [0.0, 50.0]), (2, 0, 0.0, [0.0, 1.0]), (2, 1, 9.0, [0.0])]
    df = spark.createDataFrame(rows, "page int, row_no long, y double, starts array<double>")
    assert [tuple(r) for r in folds.longest_aligned_run(df, ["page"]).collect()] == [(1, 1, 3, 2)]


def test_trees(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 3)], "pid long, parent long")
    got = {(r.root, r.pid, r.depth) for r in descendants(rows, rows, "pid", "parent").collect()}
    assert (1, 4, 2) in got and (3, 4, 1) in got and len(got) == 8
    loop = spark.createDataFrame([(1, 2), (2, 1)], "pid long, parent long")
    with pytest.raises(RuntimeError, match="cycle"):
        descendants(loop, loop, "pid", "parent", most_depth=3)


def test_unicode_forms(spark):
    from stemma.functions.unicode import normal_form

    row = spark.createDataFrame([("éﬁ",), (None,), ("abc",)], "t string").select(T.normalise_text(normal_form(F.col("t"))).alias("x")).collect()
    assert [r.x for r in row] == ["éfi", None, "abc"]


def test_page_table_from_aligned_lines(spark):
    from stemma.operators.contracts import page_tables

    def page(n, rows, shift=0.0):
        return [(n, 10 * r + c, text, 50.0 + 150 * c + (shift if r == 1 else 0), 100.0 + 14 * r, 150.0 + 150 * c, 110.0 + 14 * r) for r, own in enumerate(rows) for c, text in enumerate(own)]

    grid = [["Name", "Sum"], ["a", "1"], ["b", "2"], ["c", "3"]]
    rows = page(1, grid) + page(2, grid, 40.0) + page(3, [["with the best", "from that"], *grid[:2]]) + page(4, grid[:2]) + page(5, [*grid, ["alone"]]) + page(6, [*grid, *[["x", "y", "z"]] * 5])
    items = spark.createDataFrame(rows, "page long, no long, text string, x0 double, y0 double, x1 double, y1 double")
    got = {r.page: (r.rows, r.columns, r.confidence, r.cells) for r in page_tables(items, ["page"]).collect()}
    assert got[1] == (4, 2, 0.99, grid) and got[5] == (4, 2, 0.99, grid)  # a row of one cell is none of a table's
    assert set(got) == {1, 5, 6}  # 2: starts differ; 3: prose; 4: too few lines
    assert got[6][:3] == (5, 3, 0.889)


def test_results_are_kept_within_bounds_and_released(spark):
    from stemma.operators.contracts import retained

    rows = [("s", i, "result", i, 10) for i in range(3)] + [("s", 3, "ack", 0, 0), ("s", 4, "result", 4, 10), ("s", 5, "result", 5, 1), ("t", 0, "result", 0, 26), ("t", 1, "result", 1, 25)]
    events = spark.createDataFrame(rows, "session string, at long, kind string, job long, bytes long")
    got = {(r.session, r.job): r.kept for r in retained(events, "session", ["at"], 3, 25).collect()}
    assert got == {("s", 0): True, ("s", 1): True, ("s", 2): False, ("s", 4): True, ("s", 5): True, ("t", 0): False, ("t", 1): True}


def test_fragments_join_until_none_can(spark):
    boxes = [(1, 0, 0, 0, 10, 20), (1, 1, 40, 0, 50, 20), (1, 2, 20, 1, 30, 21), (1, 3, 0, 40, 10, 60), (1, 4, 60, 0, 70, 8), (2, 0, 0, 0, 5, 5)]
    rows = spark.createDataFrame([(p, n, *map(float, b)) for p, n, *b in boxes], "page long, no long, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for r in folds.fragments_on_a_line(rows, ["page"]).collect():
        got.setdefault(r.page, set()).add((r.x0, r.y0, r.x1, r.y1))
    # The third box bridges the first two; the fourth lies below; the fifth is too low.
    assert got == {1: {(0, 0, 50, 21), (0, 40, 10, 60), (60, 0, 70, 8)}, 2: {(0, 0, 5, 5)}}


def test_collapsed_line_is_split_by_baseline(spark):
    def char(key, no, c, x, y):
        return (key, no, c, float(x), float(y), x + 5.0, y + 10.0, 10.0)

    rows = [char("a", i, c, 6 * i, i % 3) for i, c in enumerate("level")]
    rows += [char("b", i, c, 6 * (i % 3), 30 - 15 * (i // 3)) for i, c in enumerate("belowabove"[:6])]
    chars = spark.createDataFrame(rows, "line string, no long, text string, x0 double, y0 double, x1 double, y1 double, size double")
    got = {(r.line, r.no): r.part for r in folds.split_by_baseline(chars, ["line"]).collect()}
    assert got == {("a", i): 0 for i in range(5)} | {("b", i): 1 for i in range(3)} | {("b", i): 0 for i in range(3, 6)}


def test_graphics_are_large_groups(spark):
    rows = [(1, 0, 4, 0.0, 0.0, 100.0, 100.0), (1, 1, 3, 0.0, 0.0, 100.0, 100.0), (1, 2, 9, 0.0, 0.0, 60.0, 100.0), (1, 3, 9, 0.0, 0.0, 612.0, 792.0), (1, 4, 9, 0.0, 0.0, 300.0, 10.0)]
    groups = spark.createDataFrame(rows, "page long, group_no long, n long, x0 double, y0 double, x1 double, y1 double")
    assert [r.group_no for r in folds.graphics(groups, ["page"]).collect()] == [0]


def test_table_evidence_signals_and_confidence(spark):
    from stemma.operators.contracts import table_evidence

    def page(n, rows):
        return [(n, 10 * r + c, text, 50.0 + 150 * c, 100.0 + 14 * r, 100.0 + 150 * c, 110.0 + 14 * r) for r, own in enumerate(rows) for c, text in enumerate(own) if text]

    full = [["a", "b", "c"]] * 4
    rows = page(1, full) + page(2, [*full[:3], ["a", "", "c"]]) + page(3, [["a"], ["b"], ["c"]]) + page(4, full[:2]) + page(5, full)
    items = spark.createDataFrame(rows, "page long, no long, text string, x0 double, y0 double, x1 double, y1 double")
    rules = spark.createDataFrame([(1, 3, 2, "Table 1"), (2, 0, 0, None)], "page long, horizontal int, vertical int, caption string")
    got = {r.page: r for r in table_evidence(items, rules, ["page"]).collect()}
    assert set(got) == {1, 2, 5}  # 3: one column; 4: two rows
    assert (got[1].rows, got[1].columns, got[1].detection, got[1].structure, got[1].disposition) == (4, 3, 0.88, 0.95, "reconstructed")
    assert got[1].signals[-3:] == ["whitespace-grid", "vector-rules", "nearby-caption"] and got[1].diagnostics == []
    assert (got[2].detection, got[2].structure, got[2].disposition) == (0.73, 0.795, "reconstructed-with-source")
    assert got[2].diagnostics == ["unresolved-cell", "borderless-evidence"] and got[5].diagnostics == ["borderless-evidence"]
    assert got[5].disposition == "reconstructed" and got[5].structure == 0.87


def test_wrapped_headings_become_one_and_repeats_go(spark):
    from stemma.operators.headings import merge_wrapped

    rows = [
        (1, 0, "text", "# The Long Title", "The Long Title", 100.0), (1, 1, "text", "of the Book", "of the Book", 116.0), (1, 2, "text", "plain prose goes on here.", "plain prose goes on here.", 130.0),
        (2, 0, "text", "A Message", "A Message", 10.0), (2, 1, "text", "said someone in a long line.", "said someone in a long line.", 60.0), (2, 2, "text", "## A  Message", "A  Message", 110.0),
        (3, 0, "text", "# One", "One", 0.0), (3, 1, "text", "## Two", "Two", 10.0), (3, 2, "text", "## Far", "Far", 90.0), (3, 3, "table", "# Three", "Three", 95.0),
    ]
    entries = spark.createDataFrame(rows, "page long, no long, kind string, markdown string, raw string, y double")
    got = {}
    for r in sorted(merge_wrapped(entries, ["page"]).collect(), key=lambda r: (r.page, r.no)):
        got.setdefault(r.page, []).append(r.markdown)
    assert got == {1: ["# The Long Title of the Book", "plain prose goes on here."], 2: ["said someone in a long line.", "## A  Message"], 3: ["# One", "## Two", "## Far", "# Three"]}


def test_captures_are_split_into_title_body_and_caption(spark):
    from stemma.operators.headings import split_capture

    def capture(key, title, rest):
        return [(key, i, c, 16.0) for i, c in enumerate(title)] + [(key, len(title) + i, c, 10.0) for i, c in enumerate(rest)]

    rows = capture("a", "BIG TITLE", " and then a body of many words. See Table 1 there. Figure 2.1: A plot") + capture("b", "", "only a body of words") + capture("c", "Lower title", " body words are here") + capture("d", "TOP", " rest is longer than the top")
    chars = spark.createDataFrame(rows, "capture string, no long, text string, size double")
    got = {}
    for r in sorted(split_capture(chars, ["capture"]).collect(), key=lambda r: (r.capture, r.part)):
        got.setdefault(r.capture, []).append((r.kind, r.text))
    assert got["a"] == [("title", "BIG TITLE"), ("body", "and then a body of many words. See Table 1 there."), ("caption", "Figure 2.1: A plot")]
    assert got["b"] == [("body", "only a body of words")] and got["c"] == [("body", "Lower title body words are here")]
    assert got["d"] == [("title", "TOP"), ("body", "rest is longer than the top")]
