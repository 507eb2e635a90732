"""Quality rules (operator 6): a rule bitmask ledger.

``ledger`` evaluates every rule once for each document and stores the measurements with one bit for each failed
rule. A policy is a named, versioned set of rules; applying one, or asking what each of its rules alone
removes, reads only the bits.

Defined results: a null text has no words; a text of any length is read whole; a line counts once and its repeats as duplicates,
whichever comes first; each input row gives one row; a null id stays null; other input columns
are not carried; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import mul

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm._common import BLANKS, enter, plain_text, ship

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shout_words", "n_exclaims", "longest_word")

#: name -> SQL predicate over the measurements, true where the rule fails. Bit i is the i-th rule; append only.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 40 * n_words",
    "shouting": "100 * n_shout_words > 60 * n_words",
    "exclamations": "100 * n_exclaims > 60 * n_words",
    "word_length": "word_chars > 40 * n_words or word_chars < 2 * n_words",
    "repeated_lines": "n_lines >= 6 and 100 * n_dup_lines > 60 * n_lines",
}


@dataclass(frozen=True)
class Policy:
    """Rejects a document that fails any of its rules."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STRICT = Policy("prose", 1, tuple(RULES))
POLICIES = {(p.name, p.version): p for p in (BASE, STRICT)}

_word = re.compile(f"[^{BLANKS}]+")


def measure(text: str) -> tuple[int, ...]:
    """The values of MEASURES for one text."""
    words = _word.findall(text)
    n = len(words)
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if _word.search(x)]
    repeated = 0
    if n > 2:
        seen = Counter(zip(words, words[1:], words[2:], strict=False))
        if len(seen) < n - 2:
            reach = 0
            for i, window in enumerate(zip(words, words[1:], words[2:], strict=False)):
                if seen[window] > 1:
                    repeated += i + 3 - max(i, reach)
                    reach = i + 3
    lengths = list(map(len, words))
    shout = sum(map(mul, map(str.isupper, words), map((2).__le__, lengths)))
    return n, sum(lengths), symbols, len(lines) - len(set(lines)), repeated, len(lines), shout, text.count("!"), max(lengths, default=0)


def _measure_rows(kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality_rules")
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                columns = list(zip(*map(measure, part.column("t").to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(c, pa.int64()) for c in columns)], [*kept, *MEASURES])

    return run


def measured(rows: DataFrame) -> DataFrame:
    """Replaces the text column t, which must not be null, by the measurements and failed."""
    ship(rows.sparkSession)
    kept = [c for c in rows.columns if c != "t"]
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"{m} long" for m in MEASURES]
    bits = " | ".join(f"if({rule}, {1 << i}L, 0L)" for i, rule in enumerate(RULES.values()))
    return rows.mapInArrow(_measure_rows(kept), ", ".join(kinds)).withColumn("failed", F.expr(bits))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, every measurement, failed long): failed holds one bit for each rule."""
    rows = measured(docs.select(F.col(id_col).alias("k"), plain_text(text_col).alias("t")))
    return rows.select(F.col("k").alias(id_col), *MEASURES, "failed")


def fails(policy: Policy, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) != 0


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """Adds policy, policy_version and kept."""
    return entries.withColumns({"policy": F.lit(policy.name), "policy_version": F.lit(policy.version), "kept": ~fails(policy)})


def ablation(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: how many documents fail it, how many fail it alone, so would come back
    without it, and how many the policy still rejects then. One aggregation over the bits."""
    own = F.col("failed").bitwiseAND(F.lit(policy.mask))
    counts = []
    for rule in policy.rules:
        bit = 1 << list(RULES).index(rule)
        counts += [F.count_if(own.bitwiseAND(F.lit(bit)) != 0).alias(f"{rule}_n"), F.count_if(own == bit).alias(f"{rule}_only"), F.count_if(own.bitwiseAND(F.lit(~bit)) != 0).alias(f"{rule}_rest")]
    stack = ", ".join(f"'{r}', {r}_n, {r}_only, {r}_rest" for r in policy.rules)
    return entries.agg(*counts).select(F.expr(f"stack({len(policy.rules)}, {stack}) as (rule, n_failed, n_only, n_rejected_without)"))


def ledger_sql(base: Policy = BASE, policy: Policy = STRICT) -> str:
    """The measurements and verdicts in DuckDB's SQL, over a table documents without repeated ids."""
    word, failed = f"[^{BLANKS}]+", lambda p: " OR ".join(f"({RULES[r]})" for r in p.rules)
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams JOIN again USING (doc_id, g)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{word}') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines, len(list_filter(w, lambda x: length(x) >= 2 AND upper(x) = x AND lower(x) <> x)) AS n_shout_words, length(t) - length(replace(t, '!', '')) AS n_exclaims
    FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id LEFT JOIN lines l ON w.doc_id = l.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed(base)} AS base_failed, NOT ({failed(policy)}) AS kept FROM m"""


def ablation_sql(policy: Policy = STRICT) -> str:
    """ablation() of every document in DuckDB's SQL."""
    all_but = lambda r: " OR ".join(f"({RULES[x]})" for x in policy.rules if x != r)
    measures = ledger_sql().rsplit("\nSELECT", 1)[0]
    return measures + " UNION ALL ".join(
        f"\nSELECT '{r}' AS rule, count(*) FILTER ({RULES[r]}) AS n_failed, count(*) FILTER (({RULES[r]}) AND NOT ({all_but(r)})) AS n_only, count(*) FILTER ({all_but(r)}) AS n_rejected_without FROM m" for r in policy.rules
    )
