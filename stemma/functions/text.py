"""Text functions on columns. Each is an expression of built-in functions, so it stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemma.functions import patterns as P


def squeeze(c: Column) -> Column:
    """Runs of blanks become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def plain_line(c: Column) -> Column:
    """A Markdown line without heading or quote prefix, emphasis and escapes."""
    for pattern, new in ((P.HEADING_PREFIX, ""), (P.QUOTE_PREFIX, ""), (P.EMPHASIS, ""), (P.ESCAPED_SIGN, "$1"), (r"\\-", "-")):
        c = F.regexp_replace(c, pattern, new)
    return squeeze(c)


def line_signature(c: Column) -> Column:
    """What stays of a line when page numbers at its ends go; equal lines of several pages have one signature."""
    c = squeeze(F.regexp_replace(plain_line(c), P.LEADING_PAGE, ""))
    c = F.regexp_replace(c, P.TRAILING_FRACTION, "<page>/<pages>")

    def without_page(cut: Column) -> Column:
        return bound(F.regexp_extract(cut, P.TRAILING_PAGE, 1), lambda head: F.lower(F.when(F.length(head) >= 3, F.trim(head)).otherwise(cut)))

    return bound(c, without_page)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_page_label(c: Column) -> Column:
    return plain_line(c).rlike(P.PAGE_LABEL)


def is_structural_edge(c: Column) -> Column:
    plain = plain_line(c)
    return plain.rlike(P.STRUCTURAL_EDGE) | plain.rlike(P.NUMBERED_EDGE)


def upper_share(c: Column) -> Column:
    """Share of letters that equal their upper case; null without letters."""
    letters = F.regexp_replace(c, r"\P{L}", "")
    same = F.length(F.regexp_replace(letters, r"[\p{Ll}]", ""))
    return F.when(F.length(letters) > 0, same / F.length(letters))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def is_running_fragment(c: Column) -> Column:
    """A short line that is a page label, mostly capitals, or a few title-case words."""

    def test(plain: Column) -> Column:
        own = words(plain)
        titled = (F.size(own) <= 8) & F.forall(own, lambda w: w.rlike(P.TITLE_WORD))
        letters = plain.rlike(r"\p{L}")
        return (F.size(own) > 0) & (F.length(plain) <= 160) & (plain.rlike(P.PAGE_LABEL) | (letters & ((upper_share(plain) > 0.72) | titled)))

    return bound(plain_line(c), test)


def edge_token(c: Column) -> Column:
    """A token of a page edge: page numbers of any form become one token."""
    c = F.lower(F.regexp_replace(F.regexp_replace(c, r"^[_*`]+|[_*`]+$", ""), r"\\([.!])", "$1"))
    return F.when(c.rlike(P.EDGE_NUMBER), F.lit("<page>")).otherwise(c)


def heading_level(c: Column, size: Column, body: Column, font: Column) -> Column:
    """Heading level 1 to 6 of a line, or null; evidence is numbering, wording, size and weight."""
    value = F.trim(c)
    own = words(value)
    bold = F.coalesce(font, F.lit("")).rlike("(?i)bold|semibold|demi|black")
    upper = F.coalesce(upper_share(value), F.lit(0.0))
    number = F.regexp_extract(value, P.NUMBERED_TITLE, 1)
    numbered = value.rlike(P.NUMBERED_TITLE)
    title = F.trim(F.regexp_replace(F.substring(value, F.length(number) + 1, F.length(value)), r"^\.\s*", ""))
    depth = F.size(F.split(number, r"\."))
    named = title.rlike("^[A-Z]") & ~title.rlike("[.!?;:]$") & ~title.rlike(P.TITLE_VERB)
    larger = lambda f: size >= body * f
    titled = (upper > 0.72) | F.forall(own, lambda w: w.rlike(P.HEADING_WORD))
    refused = (value == "") | (F.length(value) > 140) | (F.size(own) > 16) | value.rlike("[.!?,;:]$") | value.rlike(r"^\d{4}\b")
    none = F.lit(None).cast("int")
    return (
        F.when(refused, none)
        .when(numbered, F.when(named & ((depth > 1) | larger(1.12) | (upper > 0.72) | bold), F.least(depth, F.lit(6))))
        .when(value.rlike(P.CHAPTER), 1)
        .when(value.rlike(P.FRONT_MATTER) | value.rlike(P.APPENDIX), F.when(larger(1.05) | (upper > 0.72) | bold, 1))
        .when(~titled, none)
        .when((larger(1.45) | bold) & (F.size(own) <= 14), 1)
        .when((larger(1.22) | bold) & (F.size(own) <= 16), 2)
    )


def plain_text(c: Column) -> Column:
    """Markdown as plain text."""
    steps = (
        (r"(?s)<!--.*?-->", ""),
        (r"(?m)^#{1,6}\s+", ""),
        (r"(?m)^>\s?", ""),
        (r"(?m)^[-*+]\s+", ""),
        (P.EMPHASIS, ""),
        (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\[([^\]]+)\]\([^)]*\)", "$1"),
        (r"(?m)^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?$", ""),
        (r"\|", "\t"),
        (P.ESCAPED_SIGN, "$1"),
        (r"\\-", "-"),
        (r"\n{3,}", "\n\n"),
        (r"^\s+|\s+\z", ""),
    )
    for pattern, new in steps:
        c = F.regexp_replace(c, pattern, new)
    return c


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def document_metrics(c: Column) -> dict[str, Column]:
    """Counts of words and of Markdown objects."""
    source = r"(?m)^\[SOURCE_VISUAL\b[^\]]*\bkind=\"equation\"[^\]]*\]$"
    return {
        "words": count_of(plain_text(c), r"[\p{L}\p{N}]+"),
        "headings": count_of(c, r"(?m)^#{1,6}\s"),
        "tables": count_of(c, r"(?m)^\|.*\|\n\|[-: |]+\|"),
        "equations": F.floor(count_of(c, r"(?m)^\$\$") / 2) + count_of(c, source),
        "visuals": count_of(c, r"\[(?:VISUAL_PLACEHOLDER|SOURCE_VISUAL)"),
        "source_visuals": count_of(c, r"\[SOURCE_VISUAL"),
    }


def escape_markdown(c: Column, table: bool = False) -> Column:
    """Backticks and asterisks escaped, in tables bars too, and what would begin a block."""
    c = F.regexp_replace(c, r"([`*])", r"\\$1")
    if table:
        c = F.regexp_replace(c, r"\|", r"\\|")
    return F.when(c.rlike(r"^\s*(?:#{1,6}\s|[-+*]\s|>\s|```|~~~)"), F.regexp_replace(c, r"^(\s*)(\S)", r"$1\\$2")).otherwise(c)


def unescape_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, P.ESCAPED_PUNCTUATION, "$1")


def escape_html(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def escape_csv(c: Column) -> Column:
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def safe_identifier(c: Column, fallback: str = "item") -> Column:
    """Letters, digits, dots, hyphens and underscores; at most 120 characters."""
    c = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(c, 1, 120), F.lit("")), F.lit(fallback))


def join_wrapped(lines: Column) -> Column:
    """Lines as one text; a word broken by a hyphen at a line's end is joined."""
    return squeeze(F.regexp_replace(F.array_join(lines, " "), r"(\p{L})-\s+(?=\p{Ll})", "$1"))


def normalise_text(c: Column) -> Column:
    """Without zero-width signs, soft hyphens, ligatures, blanks at line ends and more than two empty lines. Texts are
    taken to be composed (NFC); compose() makes them so."""
    c = F.regexp_replace(c, "[\u200b-\u200d\u2060\ufeff\u00ad]", "")
    for sign, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        c = F.replace(c, F.lit(sign), F.lit(letters))
    c = F.regexp_replace(c, r"(?<=[\p{L}\p{N}\])}*_])‚(?=\s|[\p{L}\p{N}(\[\"“])", ",")
    c = F.regexp_replace(F.regexp_replace(c, r"(?m)[ \t]+$", ""), r"\n{4,}", "\n\n\n")
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def code_signal(c: Column) -> Column:
    """0 to 2: how much a line looks like source code."""
    v = F.trim(c)
    return (
        F.when((v == "") | (F.length(v) > 180), 0)
        .when(v.rlike(P.CODE_BRACKETS) | v.rlike(P.CODE_REQUEST) | v.rlike(P.CODE_PAIR), 2)
        .when(v.rlike(P.CODE_CONSTANT) | v.rlike(P.CODE_CAMEL) | (v.rlike(P.CODE_NAME) & (F.length(v) <= 42)), 1)
        .otherwise(0)
    )


def is_toc_entry(c: Column) -> Column:
    return (F.length(c) <= 180) & c.rlike(P.TOC_END) & (c.rlike(P.TOC_LEADER) | c.rlike(P.TOC_NUMBERED))


def math_score(c: Column) -> Column:
    """Signs and scripts count two, function names one, brackets 0.35."""
    return count_of(c, P.MATH_SYMBOL) * 2 + count_of(c, P.MATH_SCRIPT) * 2 + count_of(c, P.MATH_FUNCTION) + count_of(c, r"[()\[\]{}]") * F.lit(0.35)


def evaluation_text(c: Column) -> Column:
    """Text as the measures compare it: no markup, lower case, single spaces. Compatibility forms are left alone."""
    steps = (
        (r"(?i)\[SOURCE_VISUAL\b[^\]\r\n]*(?:\]|$)", " "),
        (r"(?m)^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$", " "),
        (r"(?m)^\s*\$\$\s*$", " "),
        (r"(?m)^\s{0,3}#{1,6}\s+", ""),
        (r"\*\*(.*?)\*\*", "$1"),
        (r"__(.*?)__", "$1"),
        (r"\*(.*?)\*", "$1"),
        (r"_(.*?)_", "$1"),
        (r"`{1,3}", ""),
        (r"\|", " "),
    )
    for pattern, new in steps:
        c = F.regexp_replace(c, pattern, new)
    return squeeze(F.lower(c))
