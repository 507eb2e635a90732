"""Pieces of DuckDB's SQL for the text rules, for the queries' oracles. RE2 has no look-around."""

from __future__ import annotations

from stemma.functions import patterns as P


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, *steps: tuple[str, str]) -> str:
    for pattern, new in steps:
        x = f"regexp_replace({x}, {q(pattern)}, {q(new)}, 'g')"
    return x


def hit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def squeeze(x: str) -> str:
    return f"trim({sub(x, (r'\s+', ' '))})"


def plain_line(x: str) -> str:
    return squeeze(sub(x, (P.HEADING_PREFIX, ""), (P.QUOTE_PREFIX, ""), (P.EMPHASIS, ""), (P.ESCAPED_SIGN, r"\1"), (r"\\-", "-")))


def signature_of_plain(x: str) -> str:
    """x: a plain line that is a column."""
    cut = sub(squeeze(sub(x, (P.LEADING_PAGE, ""))), (P.TRAILING_FRACTION, "<page>/<pages>"))
    head = f"regexp_extract({cut}, {q(P.TRAILING_PAGE)}, 1)"
    return f"lower(CASE WHEN length({head}) >= 3 THEN trim({head}) ELSE {cut} END)"


def label(x: str) -> str:
    return hit(x, P.PAGE_LABEL)


def structural(x: str) -> str:
    return f"({hit(x, P.STRUCTURAL_EDGE)} OR {hit(x, P.NUMBERED_EDGE)})"


def upper_share(x: str) -> str:
    letters = sub(x, (r"\P{L}", ""))
    return f"(length({sub(letters, (r'\p{Ll}', ''))}) / nullif(length({letters}), 0))"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(r'\s+')}), lambda w: w <> '')"


def fragment(x: str) -> str:
    """x: a plain line."""
    own = words(x)
    titled = f"(len({own}) <= 8 AND len(list_filter({own}, lambda w: NOT {hit('w', P.TITLE_WORD)})) = 0)"
    return f"(len({own}) > 0 AND length({x}) <= 160 AND ({label(x)} OR ({hit(x, r'\p{L}')} AND (coalesce({upper_share(x)} > 0.72, false) OR {titled}))))"


def edge_token(x: str) -> str:
    cut = f"lower({sub(x, (r'^[_*`]+|[_*`]+$', ''), (r'\\([.!])', r'\1'))})"
    return f"CASE WHEN {hit(cut, P.EDGE_NUMBER)} THEN '<page>' ELSE {cut} END"


def heading_level(x: str, size: str, body: str, font: str) -> str:
    """x: a trimmed line."""
    own, number = words(x), f"regexp_extract({x}, {q(P.NUMBERED_TITLE)}, 1)"
    bold, upper = f"regexp_matches({font}, '(?i)bold|semibold|demi|black')", f"coalesce({upper_share(x)}, 0)"
    title = f"trim({sub(f'substr({x}, length({number}) + 1)', (r'^\.\s*', ''))})"
    depth = f"len(string_split({number}, '.'))"
    titled = f"({upper} > 0.72 OR len(list_filter({own}, lambda w: NOT {hit('w', P.HEADING_WORD)})) = 0)"
    return f"""CASE WHEN {x} = '' OR length({x}) > 140 OR len({own}) > 16 OR {hit(x, '[.!?,;:]$')} OR {hit(x, r'^\d{4}\b')} THEN NULL
        WHEN {hit(x, P.NUMBERED_TITLE)} THEN CASE WHEN {hit(title, '^[A-Z]')} AND NOT {hit(title, '[.!?;:]$')} AND NOT {hit(title, P.TITLE_VERB)}
            AND ({depth} > 1 OR {size} >= {body} * 1.12 OR {upper} > 0.72 OR {bold}) THEN least({depth}, 6) END
        WHEN {hit(x, P.CHAPTER)} THEN 1
        WHEN {hit(x, P.FRONT_MATTER)} OR {hit(x, P.APPENDIX)} THEN CASE WHEN {size} >= {body} * 1.05 OR {upper} > 0.72 OR {bold} THEN 1 END
        WHEN NOT {titled} THEN NULL
        WHEN ({size} >= {body} * 1.45 OR {bold}) AND len({own}) <= 14 THEN 1
        WHEN ({size} >= {body} * 1.22 OR {bold}) AND len({own}) <= 16 THEN 2 END::INT"""


def plain_text(x: str) -> str:
    return sub(
        x,
        (r"(?s)<!--.*?-->", ""),
        (r"(?m)^#{1,6}\s+", ""),
        (r"(?m)^>\s?", ""),
        (r"(?m)^[-*+]\s+", ""),
        (P.EMPHASIS, ""),
        (r"!\[([^\]]*)\]\([^)]*\)", r"\1"),
        (r"\[([^\]]+)\]\([^)]*\)", r"\1"),
        (r"(?m)^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?$", ""),
        (r"\|", "\t"),
        (P.ESCAPED_SIGN, r"\1"),
        (r"\\-", "-"),
        (r"\n{3,}", "\n\n"),
        (r"^\s+|\s+\z", ""),
    )


def evaluation_text(x: str) -> str:
    cut = sub(
        x,
        (r"(?i)\[SOURCE_VISUAL\b[^\]\r\n]*(?:\]|$)", " "),
        (r"(?m)^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$", " "),
        (r"(?m)^\s*\$\$\s*$", " "),
        (r"(?m)^\s{0,3}#{1,6}\s+", ""),
        (r"\*\*(.*?)\*\*", r"\1"),
        (r"__(.*?)__", r"\1"),
        (r"\*(.*?)\*", r"\1"),
        (r"_(.*?)_", r"\1"),
        (r"`{1,3}", ""),
        (r"\|", " "),
    )
    return squeeze(f"lower({cut})")


def code_signal(x: str) -> str:
    """x: a trimmed line."""
    return f"""CASE WHEN {x} = '' OR length({x}) > 180 THEN 0 WHEN {hit(x, P.CODE_BRACKETS)} OR {hit(x, P.CODE_REQUEST)} OR {hit(x, P.CODE_PAIR)} THEN 2
        WHEN {hit(x, P.CODE_CONSTANT)} OR {hit(x, P.CODE_CAMEL)} OR ({hit(x, P.CODE_NAME)} AND length({x}) <= 42) THEN 1 ELSE 0 END"""


def toc_entry(x: str) -> str:
    return f"(length({x}) <= 180 AND {hit(x, P.TOC_END)} AND ({hit(x, P.TOC_LEADER)} OR {hit(x, P.TOC_NUMBERED)}))"


def math_score(x: str) -> str:
    return f"({count(x, P.MATH_SYMBOL)} * 2 + {count(x, P.MATH_SCRIPT)} * 2 + {count(x, P.MATH_FUNCTION)} + {count(x, r'[()\[\]{}]')} * 0.35::DOUBLE)"
