"""PII (operator 9): weak-supervision aggregation. DataFrame operations only.

Base spans come from fixed patterns and checks and always stay. Further candidates come from looser patterns: values of
credentials, e-mail addresses written around their signs, national phone numbers, bank account numbers. Five
labelers vote for, against or not at all on every candidate: its strict form, its checksum or size, a gazetteer of known
prefixes and endings, words of context before it, and what adjoins it. The votes of the whole corpus are counted by
kind and pattern of votes, a table of a fixed size. On the driver, expectation-maximisation over that table
estimates each labeler's reliability without labels, and a logistic span classifier is fitted to its
posteriors, with the span's length and share of digits as further features. Candidates that it accepts and
that do not touch a base span are added.

Patterns are written so that the engine neither recurses nor backtracks over long runs; they match what the plain
ones given in comments match.

Defined results: null text is empty; a text is read whole and a span may be of any length; of spans of one start the
kind listed first comes first; two added spans that overlap both stay, and redact() replaces them as one; each input row gives one row; a null id stays null; other input columns are not
carried; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm._common import materialise, plain_text

#: kind -> (pattern, what a text must hold for it to match).
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:[A-Za-z0-9.-](?<!\.(?![A-Za-z0-9-])))*+", "@"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    # [0-9]([\x20-]?[0-9])+
    "card": (r"[0-9](?:[0-9\x20-](?<![\x20-](?![0-9])))++", None),
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
#: kind -> (pattern, group of the span; it ends the match).
LOOSE = {
    "secret": (r"(?i)(?<![a-z0-9])(?:api[_ -]?key|access[_ -]?key|token|secret|password|passwd)[\"']?\s*+[:=]\s*+[\"']?([A-Za-z0-9+/_.=-]{8,}+)", 1),
    "obfuscated_email": (r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[a-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[a-z0-9-]{2,}+|\.[a-z0-9-]{2,}+)++", 0),
    "local_phone": (r"(?<![0-9A-Za-z+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])", 0),
    # The standard allows 34 signs.
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0),
}
KINDS = [*BASE, *LOOSE]
LABELERS = ("form", "checksum", "gazetteer", "context", "borders")
CONTEXT = 32

#: What a labeler looks for, by kind.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9.-]*\.[A-Za-z]{2,24}$",
    "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^(?:[0-9]{12,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})$",
    "phone": r"^\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,4}$",
    "secret": r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_.=-]{16,}$",
    "obfuscated_email": r"(?i)^[a-z0-9._%+-]+ ?[\[(]at[\])] ?[a-z0-9-]+ ?[\[(]dot[\])] ?[a-z0-9.-]+$",
    "local_phone": r"^\([2-9][0-9]{2}\)[ .-][2-9][0-9]{2}[ .-][0-9]{4}$|^[2-9][0-9]{2}([ .-])[2-9][0-9]{2}\1[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?$|^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$",
}
#: Known endings of mail hosts, prefixes of cards, calling codes, registries of accounts; forms of generated keys.
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|be|us|ca|test|example)$",
    "ip": r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|4[4-9]|5)|3(?:0|6|8))",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"^(?:[0-9a-fA-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{10,}.*)$",
    "obfuscated_email": r"(?i)(?:dot[\])] ?|\.)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "local_phone": r"^\(?(?:[2-9][0-8][0-9])",
    "iban": r"^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
}
CUES = {
    "email": r"(?i)mail|contact|write|e-?mail|correo|courriel",
    "ip": r"(?i)\bip\b|addr|server|host|client",
    "card": r"(?i)card|visa|master|credit|debit|karte|tarjeta|carte|pay",
    "phone": r"(?i)tel|phone|call|fax|mobile|handy|whatsapp",
    "secret": r"(?i)key|token|secret|passw",
    "obfuscated_email": r"(?i)mail|contact|write|e-?mail|correo|courriel",
    "local_phone": r"(?i)tel|phone|call|fax|mobile",
    "iban": r"(?i)iban|account|konto|cuenta|compte|bank",
}
#: Context that speaks against a number.
AGAINST = r"(?i)(?:version|release|isbn|order|invoice|serial|section|\bv)[\s.:#no]{0,6}$"


def positions(text: Column, matches: Column, pieces: Column) -> Column:
    """Start of each match in code points, from the matches and what split() left around them. Sums go over runs of 64,
    so many matches cost little more than few."""
    step = F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.when(i > 0, F.length(F.get(matches, i - 1))).otherwise(0))

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def place(steps: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / 64).cast("int")), lambda b: total(F.slice(steps, b * 64 + 1, F.lit(64))))
        return F.get(F.transform(F.array(runs), lambda r: F.transform(steps, lambda _, i: total(F.slice(r, F.lit(1), F.floor(i / 64).cast("int"))) + total(F.slice(steps, F.floor(i / 64).cast("int") * 64 + 1, i % 64 + 1)))), F.lit(0))

    return F.when(F.size(matches) > 0, F.get(F.transform(F.array(step), place), F.lit(0))).otherwise(F.array().cast("array<int>"))


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(9, 15)


def _checksum(kind: str, value: Column) -> Column:
    """1 for, -1 against, 0 no vote."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind in BASE and kind != "email":
        return F.when(_valid(kind, value), 1).otherwise(-1)
    if kind == "iban":
        # Letters count as two digits; the number with its first four signs moved to the end leaves 1 modulo 97.
        signs = F.regexp_replace(value, " ", "")
        turned = F.split(F.concat(F.substring(signs, 5, 64), F.substring(signs, 1, 4)), "")
        rest = F.aggregate(turned, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).when(c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).otherwise(a))
        return F.when(rest == 1, 1).otherwise(-1)
    if kind == "local_phone":
        return F.when(F.length(digits) == 10, 1).otherwise(-1)
    if kind == "secret":
        distinct = F.size(F.array_distinct(F.split(value, "")))
        return F.when(distinct >= 8, 1).otherwise(-1)
    return F.lit(0)


def _votes(kind: str, value: Column, before: Column, after: Column) -> Column:
    """One character for each labeler: 2 for, 0 against, 1 no vote."""
    form = F.when(value.rlike(STRICT[kind]), 1).otherwise(-1)
    known = F.when(value.rlike(GAZETTEER[kind]), 1).otherwise(-1)
    cue = F.when(before.rlike(CUES[kind]), 1).when(before.rlike(AGAINST), -1).otherwise(0)
    joined = before.rlike(r"[A-Za-z0-9]$") | after.rlike(r"^[A-Za-z0-9]")
    border = F.when(joined, -1).otherwise(1)
    return F.concat(*((v + 1).cast("string") for v in (form, _checksum(kind, value), known, cue, border)))


def _matches(text: str, pattern: str, able: Column, group: int) -> list[Column]:
    """(spans' texts, whole matches, pieces around them); no regex runs on a text that cannot match."""
    t = F.col(text)
    none = F.array().cast("array<string>")
    whole = F.when(able, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none)
    own = F.when(able, F.regexp_extract_all(t, F.lit(pattern), F.lit(group))).otherwise(none) if group else whole
    return [own, whole]


#: Part of each loose pattern, which a text must match for the whole to match.
_NEEDS = {"secret": "[:=]", "obfuscated_email": r"(?i)[\[(]at[\])]", "local_phone": "[0-9]", "iban": "[0-9]"}
_SPAN = "struct<kind:int,start:int,end:int,base:boolean,votes:string,long:int,digits:int>"


def _spans(kind: str, number: int, last: bool) -> Column:
    """Candidates of one kind, from its columns; last: the span is a group that ends the match."""

    def span(value: Column, i: Column) -> Column:
        start = F.get(F.col(f"{kind}_at"), i)
        n = F.length(value)
        if last:
            start = start + F.length(F.get(F.col(f"{kind}_whole"), i)) - n
        before = F.substring(F.col("t"), F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
        after = F.substring(F.col("t"), start + n + 1, F.lit(4))
        share = F.floor(F.length(F.regexp_replace(value, "[^0-9]", "")) * 3 / F.greatest(n, F.lit(1))).cast("int")
        size = F.when(n < 10, 0).when(n < 16, 1).when(n < 32, 2).otherwise(3)
        base = _valid(kind, value) if kind in BASE else F.lit(False)
        return F.struct(F.lit(number).alias("kind"), start.alias("start"), (start + n).alias("end"), base.alias("base"), _votes(kind, value, before, after).alias("votes"), size.alias("long"), share.alias("digits"))

    return F.transform(f"{kind}_own", span).cast(f"array<{_SPAN}>")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(k, t, each column kept, spans array): all candidates of a text, with votes. kind is a number in KINDS."""
    rows = docs.select(F.col(id_col).alias("k"), plain_text(text_col).alias("t"), *keep)
    base = {k: (p, F.contains(F.col("t"), F.lit(n)) if n else F.col("t").rlike("[0-9]"), 0) for k, (p, n) in BASE.items()}
    found = base | {k: (p, F.col("t").rlike(_NEEDS[k]), g) for k, (p, g) in LOOSE.items()}
    columns = {}
    for kind, (pattern, able, group) in found.items():
        own, whole = _matches("t", pattern, able, group)
        columns |= {f"{kind}_own": own} | ({f"{kind}_whole": whole} if group else {})
    rows = rows.withColumns(columns)
    pieces = {f"{kind}_pieces": F.when(F.size(f"{kind}_own") > 0, F.split("t", pattern)).otherwise(F.array().cast("array<string>")) for kind, (pattern, _, _) in found.items()}
    rows = rows.withColumns(pieces)
    starts = {f"{kind}_at": positions(F.col("t"), F.col(f"{kind}_whole" if group else f"{kind}_own"), F.col(f"{kind}_pieces")) for kind, (_, _, group) in found.items()}
    rows = rows.withColumns(starts)
    spans = [_spans(kind, number, bool(group)) for number, (kind, (_, _, group)) in enumerate(found.items())]
    return rows.select("k", "t", *keep, F.array_sort(F.concat(*spans)).alias("spans"))


@dataclass
class Model:
    """Log odds of the span classifier, by feature; prior and reliability are what EM found."""

    weights: dict[str, list[float]]
    prior: dict[int, float] = field(default_factory=dict)
    reliability: list[list[list[float]]] = field(default_factory=list)

    def odds(self, span: Column) -> Column:
        def pick(name: str, at: Column) -> Column:
            return F.get(F.array(*map(F.lit, self.weights[name])), at)

        out = pick("kind", span["kind"]) + pick("long", span["long"]) + pick("digits", span["digits"])
        for i, name in enumerate(LABELERS):
            out = out + pick(name, F.substring(span["votes"], i + 1, 1).cast("int"))
        return out


def expectation_maximisation(table: list[tuple[int, str, int]], rounds: int = 40) -> tuple[dict[tuple[int, str], float], dict[int, float], list[list[list[float]]]]:
    """(kind, votes, count) -> posterior of each (kind, votes), prior of each kind, P(vote | class) of each
    labeler. Starts from labelers that are right four times in five; counts are smoothed."""
    reliability = [[[0.7, 0.2, 0.1], [0.1, 0.2, 0.7]] for _ in LABELERS]  # [class][vote]
    prior = {k: 0.5 for k, _, _ in table}
    posterior: dict[tuple[int, str], float] = {}
    for _ in range(rounds):
        for kind, votes, _ in table:
            log = [math.log(1 - prior[kind]), math.log(prior[kind])]
            for own, v in zip(reliability, votes, strict=True):
                for c in (0, 1):
                    log[c] += math.log(own[c][int(v)])
            posterior[kind, votes] = 1 / (1 + math.exp(min(700, log[0] - log[1])))
        for kind in prior:
            n = sum(m for k, _, m in table if k == kind)
            prior[kind] = (sum(m * posterior[k, v] for k, v, m in table if k == kind) + 1) / (n + 2)
        for i, own in enumerate(reliability):
            for c in (0, 1):
                share = [2.0 * x for x in ((0.7, 0.2, 0.1), (0.1, 0.2, 0.7))[c]]
                for kind, votes, m in table:
                    p = posterior[kind, votes]
                    share[int(votes[i])] += m * (p if c else 1 - p)
                own[c] = [x / sum(share) for x in share]
    return posterior, prior, reliability


def fit_classifier(rows: list[tuple[int, str, int, int, float, int]], rounds: int = 400, rate: float = 1.0, penalty: float = 1e-3) -> dict[str, list[float]]:
    """rows (kind, votes, long, digits, posterior, count) -> weights of a logistic classifier with those features."""
    weights = {"kind": [0.0] * len(KINDS), "long": [0.0] * 4, "digits": [0.0] * 4} | {n: [0.0] * 3 for n in LABELERS}
    total = sum(math.sqrt(r[5]) for r in rows) or 1.0
    slots = [[("kind", r[0]), ("long", r[2]), ("digits", r[3]), *((n, int(v)) for n, v in zip(LABELERS, r[1], strict=True))] for r in rows]
    for _ in range(rounds):
        step = {k: [penalty * x for x in v] for k, v in weights.items()}
        for own, r in zip(slots, rows, strict=True):
            z = sum(weights[n][i] for n, i in own)
            g = math.sqrt(r[5]) / total * (1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) - r[4])
            for n, i in own:
                step[n][i] += g
        for k, v in weights.items():
            weights[k] = [x - rate * s for x, s in zip(v, step[k], strict=True)]
    return weights


def train(found: DataFrame) -> Model:
    """From the votes on all candidates; their counts by pattern are a table of a fixed size."""
    table = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.long", "s.digits").agg(F.count("*").alias("n")).collect()
    table = sorted((r["kind"], r["votes"], r["long"], r["digits"], r["n"]) for r in table)
    counts: dict[tuple[int, str], int] = {}
    for kind, votes, _, _, n in table:
        counts[kind, votes] = counts.get((kind, votes), 0) + n
    posterior, prior, reliability = expectation_maximisation([(k, v, n) for (k, v), n in sorted(counts.items())])
    return Model(fit_classifier([(k, v, a, b, posterior[k, v], n) for k, v, a, b, n in table]), prior, reliability)


def chosen(found: DataFrame, model: Model) -> DataFrame:
    """Adds base (the base spans) and all (with the accepted candidates), by start, then kind."""
    base = F.filter("spans", lambda s: s["base"])
    loose = F.filter("spans", lambda s: (s["kind"] >= len(BASE)) & (model.odds(s) > 0) & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    def order(spans: Column) -> Column:
        return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))

    return found.withColumn("base", base).withColumn("all", order(F.concat(F.col("base"), loose))).withColumn("base", order(F.col("base")))


def spelled(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """(k, [t], columns kept, base, all): spans are structs of start, kind, end."""
    found = candidates(docs, id_col, text_col, keep)
    found = materialise(found if with_text else found.drop("t"), "candidates")
    return chosen(found, train(found)).drop("spans")


def redact(found: DataFrame, text: str = "t", spans: str = "all") -> Column:
    """The text with every span replaced by its kind in angle brackets; of spans that touch, the first counts and the
    text runs on after the last end."""
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(gap, F.get(names, s["kind"])))).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(F.col(spans), start, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text)))))
    return F.when(F.size(spans) == 0, F.col(text)).otherwise(whole)
