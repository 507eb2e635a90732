"""Formulas in LaTeX as a flat list of nodes.

A scanner cuts the text into tokens by one pattern; a table says how many operands a command takes and what node it makes; one loop
reads items until a closing sign. Nodes refer to each other by number, the root is node 0. Errors are listed and never guessed
away: unknown commands, missing operands, delimiters that do not match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The commands that are understood, by what they make.
SYMBOLS = "infty alpha beta gamma theta lambda mu pi sigma phi omega Gamma Delta Theta Lambda Sigma Phi Omega".split()
OPERATORS = "times cdot div pm leq geq neq approx equiv sim propto in to".split()
FUNCTIONS = "sin cos tan log ln exp max min arg".split()
STYLES = "mathrm mathbf mathit mathcal mathbb mathsf text operatorname".split()
ACCENTS = "hat bar vec dot tilde".split()
BIG = "sum prod int".split()
SPACES = ["space", "quad", "qquad", ",", ";", ":", "!"]
SIGNS = {"+": "plus", "-": "minus", "=": "equals", "*": "times", "/": "divide", "&": "separator", "<": "less-than", ">": "greater-than"}
SYMBOL_TEXT = {
    "≤": "\\leq", "≥": "\\geq", "≠": "\\neq", "≈": "\\approx", "∞": "\\infty", "∑": "\\sum", "∏": "\\prod", "∫": "\\int", "×": "\\times", "÷": "\\div", "μ": "\\mu",
    "σ": "\\sigma", "λ": "\\lambda", "α": "\\alpha", "β": "\\beta", "γ": "\\gamma", "δ": "\\delta", "θ": "\\theta", "π": "\\pi", "ρ": "\\rho", "τ": "\\tau", "φ": "\\phi", "½": "\\frac{1}{2}",
}
MOST_NODES, MOST_DEPTH = 8192, 128

_scan = re.compile(r"\\\\|\\[A-Za-z]+|\\.|[{}()\[\]]|[=+\-*/^_&<>]|[^\s\\{}()\[\]^_&=+\-*/<>]+")
_closing = {"{": "}", "(": ")", "[": "]"}
NODES = "array<struct<id:int,type:string,value:string,parts:array<int>>>"
RESULT = f"success boolean, errors array<string>, confidence double, root_type string, nodes {NODES}"


@dataclass
class _Reader:
    tokens: list[str]
    at: int = 0
    nodes: list[tuple] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def make(self, kind: str, value: str | None = None, parts: tuple = ()) -> int:
        if len(self.nodes) >= MOST_NODES:
            raise OverflowError("too many nodes")
        self.nodes.append((len(self.nodes), kind, value, [p for p in parts if p is not None]))
        return len(self.nodes) - 1

    def sequence(self, until: str | None, depth: int) -> int:
        """Items up to a closing sign, which is taken."""
        if depth > MOST_DEPTH:
            raise OverflowError("too deep")
        items, pending = [], None
        while (t := self.peek()) is not None and t not in _closing.values() and t not in ("\\right", "\\end"):
            item = self.scripted(depth)
            items.append(item)
            pending = self.nodes[item] if self.nodes[item][1] == "operator" else None
        if pending and pending[2] != "separator":
            self.errors.append(f"operator {pending[2]} misses an operand")
        if until is not None:
            if self.peek() == until:
                self.at += 1
            else:
                self.errors.append(f"mismatched or unclosed delimiter, {until} expected")
                if self.peek() in _closing.values():
                    self.at += 1
        return items[0] if len(items) == 1 else self.make("sequence", None, tuple(items))

    def operand(self, depth: int, who: str) -> int | None:
        t = self.peek()
        if t is None or t in _closing.values() or t in ("\\right", "\\end"):
            self.errors.append(f"{who} requires an operand")
            return None
        return self.atom(depth + 1)

    def scripted(self, depth: int) -> int:
        base = self.atom(depth)
        while self.peek() in ("_", "^"):
            sign = self.peek()
            self.at += 1
            base = self.make("subscript" if sign == "_" else "superscript", None, (base, self.operand(depth, sign)))
        return base

    def limits(self, depth: int) -> list[int | None]:
        found = {}
        while self.peek() in ("_", "^") and self.peek() not in found:
            sign = self.peek()
            self.at += 1
            found[sign] = self.operand(depth, sign)
        return [found.get("_"), found.get("^")]

    def atom(self, depth: int) -> int:
        t = self.peek()
        self.at += 1
        if t in _closing:
            return self.sequence(_closing[t], depth + 1)
        if not t.startswith("\\"):
            if t in SIGNS:
                return self.make("operator", SIGNS[t])
            if t in ("_", "^"):
                self.errors.append(f"{t} has no base")
                return self.make("text", t)
            return self.make("number" if re.fullmatch(r"\d+(?:\.\d+)?", t) else "identifier", t)
        name = t[1:]
        if name == "\\":
            return self.make("linebreak")
        if name in SYMBOLS:
            return self.make("symbol", name)
        if name in OPERATORS:
            return self.make("operator", name)
        if name in SPACES or name == " ":
            return self.make("text", " ")
        if name == "frac":
            return self.make("fraction", None, (self.operand(depth, t), self.operand(depth, t)))
        if name == "sqrt":
            index = None
            if self.peek() == "[":
                self.at += 1
                index = self.sequence("]", depth + 1)
            return self.make("root", None, (index, self.operand(depth, t)))
        if name in STYLES:
            return self.make("text", name, (self.operand(depth, t),))
        if name in ACCENTS:
            return self.make("accent", name, (self.operand(depth, t),))
        if name in FUNCTIONS:
            return self.make("function", name, (*self.limits(depth), self.operand(depth, t)))
        if name in BIG:
            low, high = self.limits(depth)
            if self.peek() is None or self.peek() in _closing.values():
                self.errors.append(f"{t} requires a body operand")
                body = None
            else:
                body = self.scripted(depth + 1)
            return self.make("integral" if name == "int" else name, None, (low, high, body))
        if name == "left":
            return self.stretched(depth)
        if name == "begin":
            return self.environment(depth)
        self.errors.append(f"unsupported command {t}")
        return self.make("unsupported", name)

    def stretched(self, depth: int) -> int:
        opening = self.peek()
        self.at += opening is not None
        inner = self.sequence(None, depth + 1)
        if self.peek() != "\\right":
            self.errors.append("unclosed \\left delimiter")
            return self.make("group", opening, (inner,))
        self.at += 1
        closing = self.peek()
        self.at += closing is not None
        return self.make("group", f"{opening}{closing}", (inner,))

    def environment(self, depth: int) -> int:
        name = self.word()
        body = self.sequence(None, depth + 1)
        if self.peek() == "\\end":
            self.at += 1
            if self.word() != name:
                self.errors.append(f"environment {name} is mismatched")
        else:
            self.errors.append(f"unclosed environment {name}")
        return self.make("environment", name, (body,))

    def word(self) -> str:
        """The text of a braced group."""
        if self.peek() != "{":
            return ""
        end = self.tokens.index("}", self.at) if "}" in self.tokens[self.at :] else len(self.tokens)
        text = "".join(self.tokens[self.at + 1 : end])
        self.at = end + 1
        return text


def parse(latex: str) -> dict:
    """success, errors, confidence (1 without errors, less a quarter for each), the root's type and the nodes, root first."""
    text = latex.strip()
    for sign in ("$$", "$"):
        if len(text) > 2 * len(sign) and text.startswith(sign) and text.endswith(sign):
            text = text[len(sign) : -len(sign)]
            break
    reader = _Reader(_scan.findall(text))
    try:
        root = reader.sequence(None, 0)
        while reader.peek() is not None:
            reader.errors.append(f"mismatched delimiter {reader.peek()}")
            reader.at += 1
            reader.sequence(None, 0)
    except (OverflowError, RecursionError) as e:
        return {"success": False, "errors": [str(e) or "too deep"], "confidence": 0.0, "root_type": None, "nodes": []}
    if not reader.tokens:
        reader.errors.append("empty formula")
    place = {root: 0} | {n[0]: i for i, n in enumerate((n for n in reader.nodes if n[0] != root), 1)}
    nodes = sorted(({"id": place[i], "type": t, "value": v, "parts": [place[p] for p in parts]} for i, t, v, parts in reader.nodes), key=lambda n: n["id"])
    return {"success": not reader.errors, "errors": reader.errors, "confidence": max(0.0, 1 - 0.25 * len(reader.errors)), "root_type": nodes[0]["type"], "nodes": nodes}


def parsed(latex: Column) -> Column:
    """struct of RESULT for each formula; null stays null."""

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        none = dict.fromkeys(("success", "errors", "confidence", "root_type", "nodes"))
        return pd.DataFrame([none if t is None else parse(t) for t in texts], columns=list(none))

    return run(latex)


def root_signs(text: str) -> str:
    """√ with what it covers, a bracketed group or a word, as a command. One without anything to cover stays."""
    out, at = [], 0
    for m in re.finditer("√\\s*", text):
        if m.start() < at:
            continue
        out.append(text[at : m.start()])
        at = m.end()
        first = text[at : at + 1]
        if first in _closing and first:
            depth, end = 0, at
            while end < len(text):
                depth += (text[end] == first) - (text[end] == _closing[first])
                end += 1
                if depth == 0:
                    break
            if depth == 0:
                out.append("\\sqrt{" + root_signs(text[at + 1 : end - 1]) + "}")
                at = end
                continue
        word = re.match(r"[^\s=<>≤≥≠≈+−\-*×÷/,;√(\[{]+", text[at:])
        if word:
            out.append("\\sqrt{" + word[0] + "}")
            at += len(word[0])
        else:
            out.append(m[0])
    return "".join(out) + text[at:]


def to_latex(text: str) -> str:
    """Mathematical signs as commands."""
    text = root_signs(text)
    for sign, command in SYMBOL_TEXT.items():
        text = text.replace(sign, command)
    return text


_explicit = re.compile(r"\\\(([^\n]{1,240}?)\\\)|(?<!\$)\$([^$\n]{1,240})\$(?!\$)")
_term = r"(?:\\[A-Za-z]+|[A-Za-zα-ωΑ-Ω]\w*(?:\([^()\n]{0,60}\))?|\d+(?:\.\d+)?)(?:[_^](?:\w|\{[^{}\n]{1,40}\}))*"
_implicit = re.compile(rf"(?<![\w$]){_term}(?:\s*[+\-−×÷*/^]\s*{_term}){{0,12}}\s*[=≤≥≠≈≡<>]\s*{_term}(?:\s*[+\-−×÷*/^=≤≥≠≈≡<>]\s*{_term}){{0,12}}")


def inline(text: str) -> list[dict]:
    """start, end, latex and explicit of the formulas in a line; marked ones come first, others must not touch them."""
    found = [(m.start(), m.end(), m[1] or m[2], True) for m in _explicit.finditer(text)]
    for m in _implicit.finditer(text):
        if not any(m.start() < e and s < m.end() for s, e, _, _ in found):
            found.append((m.start(), m.end(), m[0], False))
    return [{"start": s, "end": e, "latex": to_latex(body.strip()), "explicit": x} for s, e, body, x in sorted(found)]


def inline_formulas(text: Column) -> Column:
    @F.pandas_udf("array<struct<start:int,end:int,latex:string,explicit:boolean>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(inline, na_action="ignore")

    return run(text)
