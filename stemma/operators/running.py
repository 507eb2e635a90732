"""Running matter: headers and footers that repeat over the pages of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions import patterns as P
from stemma.functions import text as T


def edge_lines(pages: DataFrame) -> DataFrame:
    """pages (source, page, text) -> the lines at a page's two edges: (source, page, line_no, line, position). Two at each edge of a
    page of eight lines or more, else one; where all of these are page labels the edge runs on over further labels and one line
    that may be running matter. A page is a row, so nothing is shuffled, and only lines at the edges are tested."""
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))), lambda x: F.trim(x["line"]) != "")
    rows = pages.select("source", "page", kept.alias("down")).where("size(down) > 0").withColumns({"up": F.reverse("down"), "depth": F.when(F.size("down") >= 8, 2).otherwise(1)})

    def edge(side: str) -> Column:
        first = F.slice(side, F.lit(1), F.col("depth"))
        # Only where all of these are labels is the rest looked at: as far as labels go, and at the line after them.
        other = F.array_position(F.transform(side, lambda x: T.is_page_label(x["line"])), False).cast("int")
        labels = F.when(other == 0, F.size(side)).otherwise(other - 1)
        after = F.get(F.col(side), labels)
        far = F.when(after.isNotNull() & T.is_running_fragment(after["line"]), labels + 1).otherwise(labels)
        return F.when(F.forall(first, lambda x: T.is_page_label(x["line"])), F.slice(side, F.lit(1), far)).otherwise(first)

    marked = lambda side, name: F.transform(edge(side), lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), F.lit(name).alias("position")))
    return rows.select("source", "page", F.inline(F.concat(marked("down", "header"), marked("up", "footer"))))


def least_pages(n: Column) -> Column:
    """How many of a document's n pages must show a line for it to count as repeated."""
    return F.when(n <= 2, 2).otherwise(F.least(F.lit(3), F.greatest(F.lit(2), F.ceil(n * 0.25)))).cast("long")


def page_counts(edges: DataFrame) -> DataFrame:
    """(source, n_pages): every page with a line has one at its edges."""
    return edges.groupBy("source").agg(F.countDistinct("page").alias("n_pages"))


def repeated_signatures(edges: DataFrame) -> DataFrame:
    """(source, key, pages) of the signatures on enough pages. A page counts once for a signature."""
    # Exploded, so that the filter reads the signature instead of computing it again.
    keys = edges.select("source", "page", F.explode(F.array(T.line_signature(F.col("line")))).alias("key")).where(F.length("key").between(3, 160)).distinct()
    counts = keys.groupBy("source", "key").agg(F.count("*").alias("pages"))
    return counts.join(page_counts(edges), "source").where(F.col("pages") >= least_pages(F.col("n_pages"))).select("source", "key", "pages")


def common_tokens(edges: DataFrame) -> DataFrame:
    """(source, position, size, sample): what the outermost edge lines of all pages of a document begin (headers) or end
    (footers) with, up to twelve tokens, page numbers alike. Every page must have at least two tokens there."""
    outer = F.when(F.col("position") == "header", F.min_by("line", "line_no")).otherwise(F.max_by("line", "line_no"))
    line = edges.groupBy("source", "page", "position").agg(F.first("position").alias("p"), outer.alias("line"))
    tokens = T.words(T.plain_line(F.col("line")))
    rows = line.select("source", "page", "position", F.when(F.col("position") == "header", tokens).otherwise(F.reverse(tokens)).alias("tokens"))
    heads = rows.groupBy("source", "position").agg(F.count_if(F.size("tokens") >= 2).alias("n"), F.min(F.size("tokens")).alias("least"), F.min_by("tokens", "page").alias("first"))
    heads = heads.join(page_counts(edges), "source").where((F.col("n") == F.col("n_pages")) & (F.col("n_pages") >= 2))
    places = rows.select("source", "position", "page", F.posexplode(F.slice("tokens", 1, 12)).alias("at", "token"))
    alike = places.groupBy("source", "position", "at").agg(F.countDistinct(T.edge_token(F.col("token"))).alias("kinds"), F.count("*").alias("pages"))
    broken = alike.join(heads.select("source", "position", "n_pages"), ["source", "position"]).where((F.col("kinds") > 1) | (F.col("pages") < F.col("n_pages")))
    first_broken = broken.groupBy("source", "position").agg(F.min("at").alias("stop"))
    found = heads.join(first_broken, ["source", "position"], "left").withColumn("count", F.least(F.coalesce("stop", F.lit(12)), "least", F.lit(12))).where("count >= 2")
    sizes = found.select("source", "position", "first", F.explode(F.expr("sequence(2, count)")).alias("size"))
    own = F.slice("first", F.lit(1), F.col("size"))
    sample = F.array_join(F.when(F.col("position") == "header", own).otherwise(F.reverse(own)), " ")
    sized = sizes.withColumn("sample", sample)
    fits = F.length("sample").between(6, 160) & ~(F.col("sample").rlike("[.!?]$") & (F.col("size") > 5)) & T.is_running_fragment(F.col("sample"))
    return sized.where(fits).groupBy("source", "position").agg(F.max("size").alias("size"), F.max_by("sample", "size").alias("sample"))


def decisions(edges: DataFrame, repeated: DataFrame, common: DataFrame) -> DataFrame:
    """KEEP, REMOVE or MERGE for each distinct edge line of a page, with the evidence and a confidence. Structural lines,
    such as chapter titles, are kept even if they repeat."""
    keyed = edges.where(F.trim("line") != "").select("*", F.explode(F.array(F.struct(T.line_signature(F.col("line")).alias("key"), T.plain_line(F.col("line")).alias("plain")))).alias("x")).select(*edges.columns, "x.*")
    once = Window.partitionBy("source", "page", "position", "key").orderBy("line_no")
    keyed = keyed.withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth")
    found = keyed.join(repeated.select("source", "key", F.lit(True).alias("repeated")), ["source", "key"], "left").join(common, ["source", "position"], "left")
    tokens, wanted = T.words(F.col("plain")), F.split("sample", r"\s+")
    n = F.size(wanted)
    own = F.when(F.col("position") == "header", F.slice(tokens, F.lit(1), n)).otherwise(F.slice(tokens, F.size(tokens) - n + 1, n))
    same = F.when(F.col("sample").isNotNull() & (F.size(tokens) >= n), F.transform(own, T.edge_token) == F.transform(wanted, T.edge_token)).otherwise(False)
    flags = {"is_label": F.col("plain").rlike(P.PAGE_LABEL), "structural": F.col("plain").rlike(P.STRUCTURAL_EDGE) | F.col("plain").rlike(P.NUMBERED_EDGE), "repeated": F.coalesce("repeated", F.lit(False)), "common": same}
    action = F.when(F.col("structural"), "KEEP").when(F.col("is_label") | F.col("repeated"), "REMOVE").when(F.col("common"), "MERGE").otherwise("KEEP")
    sure = F.when(F.col("structural"), 0.93).when(F.col("action") == "REMOVE", 0.9).when(F.col("action") == "MERGE", 0.82).otherwise(0.62)
    rest = F.when(F.col("position") == "header", F.slice(tokens, n + 1, F.size(tokens))).otherwise(F.slice(tokens, F.lit(1), F.size(tokens) - n))
    out = found.withColumns(flags).withColumn("action", action).withColumn("confidence", sure).withColumn("merged", F.when(F.col("action") == "MERGE", F.array_join(rest, " ")))
    return out.select("source", "page", "position", "line_no", "key", "action", "confidence", "repeated", "common", F.col("is_label").alias("page_label"), "structural", "merged")


def strip_running_matter(pages: DataFrame, judged: DataFrame) -> DataFrame:
    """(source, page, lines, text): the pages without blank lines and those judged REMOVE, and without the common tokens of lines
    judged MERGE. A page of which nothing is left has no row. The few lines judged meet the pages as one row for each page."""
    plan = F.collect_set(F.struct("line_no", "cut")).alias("plan")
    gone = judged.where("action <> 'KEEP'").withColumn("cut", F.when(F.col("action") == "MERGE", F.col("merged"))).groupBy("source", "page").agg(plan)
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    own = lambda x: F.filter("plan", lambda p: p["line_no"] == x["i"])  # noqa: E731  a line may be judged as header and as footer
    left = F.transform(lines, lambda x: F.when(F.coalesce(F.size(own(x)), F.lit(0)) <= 0, x["line"]).otherwise(F.coalesce(F.array_max(F.transform(own(x), lambda p: p["cut"])), F.lit(""))))
    kept = F.filter(left, lambda x: F.trim(x) != "")
    rows = pages.join(gone, ["source", "page"], "left").select("source", "page", kept.alias("kept")).where("size(kept) > 0")
    return rows.select("source", "page", F.size("kept").cast("long").alias("lines"), F.array_join("kept", "\n").alias("text"))


def repeated_by_place(placed: DataFrame, height: int = 792, share: float = 0.35) -> DataFrame:
    """(source, position, key, pages array): equal texts in the top or bottom 14 % of enough pages."""
    key = F.lower(T.squeeze(F.col("line")))
    position = F.when(F.col("y0") <= height * 0.14, "header").when(F.col("y1") >= height - height * 0.14, "footer")
    found = placed.select("source", "page", position.alias("position"), key.alias("key")).where("position is not null and key <> ''").distinct()
    total = placed.groupBy("source").agg(F.countDistinct("page").alias("n_pages"))
    grouped = found.groupBy("source", "position", "key").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    enough = F.size("pages") >= F.greatest(F.lit(2), F.ceil(F.col("n_pages") * share))
    return grouped.join(total, "source").where(enough).select("source", "position", "key", "pages")
