import pytest
from pyspark.sql import functions as F

from stemma.functions import mathir


def _types(latex):
    return [n["type"] for n in mathir.parse(latex)["nodes"]]


@pytest.mark.parametrize(
    "latex,root,inside",
    [
        ("x_i^2", "superscript", ["subscript"]),
        ("\\frac{1}{x+1}", "fraction", ["number", "sequence"]),
        ("\\int_0^1 x^2 \\mathrm{d}x", "sequence", ["integral", "superscript"]),
        ("\\sum_{i=1}^n i^2 + \\sin\\left(x\\right)", "sequence", ["sum", "function", "group", "superscript"]),
        ("$$\\sqrt[3]{y}$$", "root", ["number", "identifier"]),
        ("\\begin{cases} a & b \\\\ c & d \\end{cases}", "environment", ["linebreak"]),
    ],
)
def test_good_formulas(latex, root, inside):
    found = mathir.parse(latex)
    assert found["success"], found["errors"]
    assert found["root_type"] == root and set(inside) <= set(_types(latex))
    assert all(0 <= p < len(found["nodes"]) and p != n["id"] for n in found["nodes"] for p in n["parts"])


@pytest.mark.parametrize("latex,said", [("\\unknown{1}", "unsupported"), ("x =", "operand"), ("\\frac{1}{x]", "mismatched"), ("\\frac{1}", "operand"), ("(a", "unclosed"), ("", "empty"), ("\\left(x", "unclosed"), ("{" * 300, "too deep")])
def test_bad_formulas_are_reported(latex, said):
    found = mathir.parse(latex)
    assert not found["success"] and any(said in e for e in found["errors"]), found["errors"]


def test_long_formulas_stay_small():
    assert len(mathir.parse(" + ".join(f"x_{i}" for i in range(100)))["nodes"]) < 500


@pytest.mark.parametrize("text,want", [("√(a+b) = c", "\\sqrt{a+b} = c"), ("√x+1", "\\sqrt{x}+1"), ("√", "√"), ("√((a)b)", "\\sqrt{(a)b}"), ("√(a", "√(a"), ("a ≤ π½", "a \\leq \\pi\\frac{1}{2}")])
def test_signs(text, want):
    assert mathir.to_latex(text) == want


def test_inline_formulas_do_not_overlap(spark):
    text = "take \\(a=b\\) and $c_1 < d$ where f(x) = a_1 + b^2 <= 4, no more"
    found = mathir.inline(text)
    assert [f["explicit"] for f in found] == [True, True, False]
    assert all(a["end"] <= b["start"] for a, b in zip(found, found[1:], strict=False))
    rows = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(mathir.inline_formulas(F.col("t")).alias("f"), mathir.parsed(F.col("t")).alias("p")).collect()
    assert [r.f and len(r.f) for r in rows] == [3, None, []] and rows[1].p.success is None
