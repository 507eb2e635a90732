"""Equations among the lines of a page: predicates, candidates and what becomes of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemma.functions import text as T

#: Words that speak against a formula.
PROSE = r"(?i)\b(?:the|and|that|this|with|from|where|which|then|than|for|are|was|were|have|has|into|when)\b"
PROTOCOL = r"(?i)\b(?:GET|POST|PUT|PATCH|DELETE|HTTP|HTTPS|JSON|API|URL|status|command(?:Id)?|type|version|endpoint|token|certificate|websocket)\b"
HEADED = r"(?i)^(?:figure|fig\.|table|chapter|source|note|proof)\b"
THEOREM = r"(?i)^(?:theorem|lemma|proposition|corollary|example)\b"
RELATION, OPERATOR = r"[=<>≤≥≠≈]", r"[+*/^_×÷∑∏∫√]|(?:^|\s)-"
COMMAND = r"\\(?:frac|sqrt|sum|prod|int|sin|cos|tan|log|ln|exp)\b"
SCRIPT = r"\b[A-Za-z]\s*_\s*[A-Za-z0-9({\[]|\^\s*[A-Za-z0-9({\[]"
DRAWN = r"\+[-=]{3,}\+|[-=]{4,}|_{4,}|\|.*\|"


def n_words(c: Column) -> Column:
    return F.size(T.words(c))


def is_equation(c: Column) -> Column:
    """A printed line is a formula: it relates things, by commands, scripts, operators or short names, and is not prose."""
    score, relation, command, script = T.math_score(c), c.rlike(RELATION), c.rlike(COMMAND), c.rlike(SCRIPT)
    names = F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0))
    compact = (F.size(names) > 0) & F.forall(names, lambda w: F.length(w) <= 3)
    refused = (c == "") | (F.length(c) > 240) | (n_words(c) > 28) | c.rlike(HEADED) | c.rlike(THEOREM) | c.rlike(r"^\s*[|>]") | c.rlike(DRAWN) | c.rlike(PROTOCOL) | c.rlike("[?]")
    told = command | script | (relation & (c.rlike(OPERATOR) | compact))
    return ~refused & told & (score >= 2) & ~(c.rlike(PROSE) & (score < 7))


def is_ocr_equation(c: Column) -> Column:
    """The same for recognised text, which must relate things and score higher."""
    score, signs, prose = T.math_score(c), T.count_of(c, r"[=<>≤≥≠≈+−×÷∑∏∫√∞]"), c.rlike(PROSE)
    refused = (c == "") | (F.length(c) > 220) | c.rlike(HEADED) | (n_words(c) > 24) | c.rlike(r"^\s*[|>]") | c.rlike(PROTOCOL) | c.rlike(r"[=<>≤≥≠≈+−×÷]\s*$") | (prose & (n_words(c) > 5) & (signs < 4))
    return ~refused & c.rlike(RELATION) & (signs > 0) & (score >= F.when(prose, 7).otherwise(4))


def candidate_confidence(c: Column) -> Column:
    return F.greatest(F.lit(0.15), F.least(F.lit(0.99), 0.52 + 0.09 * T.math_score(c)))


def accepted(parsed: Column, equivalent: Column, provider: Column, exact: Column, recognition: Column, overall: Column, has_gold: Column) -> Column:
    """accepted, review or preserved. A formula that does not parse is never accepted."""
    sure = F.coalesce((has_gold & (overall >= 0.82)) | ((provider == "native") & exact & (overall >= 0.55)) | ((provider == "tesseract-ocr") & (recognition >= 0.82) & (overall >= 0.55)), F.lit(False))
    return F.when(parsed & equivalent & sure, "accepted").when(parsed & (overall >= 0.55), "review").otherwise("preserved")


#: Names that do not make a line prose.
NAMES = "sin cos tan log ln exp max min sqrt frac alpha beta gamma delta theta lambda mu pi sigma omega".split()
SIGN = r"[=<>≤≥≠≈+\-−*/×÷^_∑∏∫√]"


def is_plain_formula(c: Column) -> Column:
    """A line of an engine that knows no layout is a formula: few words, a relation, script or two operators, and either no
    long word or at least two operators."""
    operators = T.count_of(c, SIGN)
    long_words = F.exists(T.words(c), lambda w: (F.length(F.regexp_replace(w, r"\P{L}", "")) > 3) & ~F.lower(F.regexp_replace(w, r"^\\+", "")).isin(NAMES))
    told = c.rlike(RELATION) | (operators >= 2) | c.rlike(r"[\^_]")
    return F.length(c).between(3, 240) & (n_words(c) <= 18) & told & (operators > 0) & ~(long_words & (operators < 2)) & ~c.rlike("[?!]")
