import random

import pytest

from stemma.llm import licenses, queries

NOTES = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0.": "apache",
}


def test_finds_the_planted_lines_and_little_else(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op1_licenses(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(rows) == len(docs)
    planted = extra = missed = 0
    for d in docs:
        want = {f for line in d.text.split("\n") for note, f in NOTES.items() if note in line}
        got = set((rows[d.doc_id].families or "").split(",")) - {""}
        planted += len(want)
        missed += len(want - got)
        extra += len(got - want)
    print(planted, missed, extra)
    assert planted > 200 and missed <= planted * 0.02 and extra <= planted * 0.02


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_accuracy_with_unknown_class(spark, model):
    rng = random.Random(99)
    noise = ["Wherha", "onto", "erlich", "que", "le", "shanded", "tion."]
    rows = [(licenses._disturbed(rng, t, noise), f) for f, own in licenses.TEMPLATES.items() for t in own for _ in range(10)]
    rows += [(" ".join(rng.choice(noise + ["the", "of", "free", "work", "public", "under"]) for _ in range(rng.randrange(4, 30))), None) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: {x.family for x in r.licences} for r in licenses.scan(df, model).collect()}
    right = [got[i] == ({f} if f else set()) for i, (_, f) in enumerate(rows)]
    assert sum(right[:-200]) / len(right[:-200]) > 0.85
    assert sum(right[-200:]) / 200 > 0.97


def test_edge_cases(spark, model):
    rows = [(1, None, 1), (2, "", 2), (None, "Released under the MIT License.\n\n \nReleased under the ISC License.", 3), (3, "x " * 200_000, 4), (4, "MIT", 5), (4, "MIT", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, licences int")
    out = licenses.scan(df, model).collect()
    assert len(out) == 6
    own = next(r for r in out if r.doc_id is None)
    assert [(x.paragraph, x.family, x.confirmed) for x in own.licences] == [(0, "mit", True), (1, "isc", True)]
    assert rows[2][1][own.licences[1].start : own.licences[1].end] == "Released under the ISC License."
    assert licenses.scan(df.limit(0), licenses.train(df.limit(0))).count() == 0


def test_features_similarity_and_probabilities_by_plain_code(spark, model):
    import math
    import re as r

    def plain(text):
        return [t.rstrip(".-") for t in r.findall(r"[a-z0-9][a-z0-9.+-]*", text.lower())]

    known = {g for family in licenses.FAMILIES for t, _ in licenses.notices(family) if t not in licenses.OTHER for n in (1, 2, 3) for g in zip(*(plain(t)[i:] for i in range(n)), strict=False)}
    key = {}
    for g in known:
        ids = [licenses.grams().word[w] for w in g]
        key[g] = sum(x * licenses.grams().base ** (len(ids) - 1 - i) for i, x in enumerate(ids))
    assert len(set(key.values())) == len(known) and sorted(key.values()) == licenses.grams().sorted.tolist()
    at = {k: i for i, k in enumerate(licenses.grams().sorted.tolist())}
    rng = random.Random(2)
    texts = [licenses._disturbed(rng, t, ["wherha", "Onto,", "x"]) for own in list(licenses.TEMPLATES.values())[:10] for t in own[:2]]
    row, feature = licenses.rows_of([licenses.grams().ids(t.split()) for t in texts])
    p = model.probabilities(row, feature, len(texts))
    for i, t in enumerate(texts):
        words = plain(t)
        mine = {g for n in (1, 2, 3) for g in zip(*(words[j:] for j in range(n)), strict=False)} & known
        assert sorted(feature[row == i].tolist()) == sorted(at[key[g]] for g in mine)
        z = [model.bias[c] + sum(model.weight[at[key[g]], c] for g in mine) / math.sqrt(max(len(mine), 1)) for c in range(len(licenses.FAMILIES))]
        e = [math.exp((x - max(z)) / model.temperature) for x in z]
        assert all(abs(p[i][c] - e[c] / sum(e)) < 1e-9 for c in range(len(e)))
        pairs = set(zip(words, words[1:], strict=False))
        for family in licenses.TEMPLATES:
            best = 0
            for x, _ in licenses.notices(family):
                other = set(zip(plain(x), plain(x)[1:], strict=False))
                best = max(best, len(pairs & other) / len(other), len(pairs & other) / len(pairs) if len(pairs) >= 6 else 0)
            assert abs(licenses.similarity(t, family) - best) < 1e-9


def test_a_wrapped_notice_is_one_paragraph(spark, model):
    import textwrap

    rows = [(i, "Intro line.\n\n" + textwrap.fill(max(own, key=len), 72) + "\n\nEnd.") for i, own in enumerate(licenses.TEMPLATES.values())]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, family in enumerate(licenses.TEMPLATES):
        assert got[i].n_paragraphs == 3
        assert {x.family for x in got[i].licences if x.confirmed} == {family}, family


def test_paragraphs():
    text = "One\ntwo.\nthree\n \nfour (five)\nsix!)\n\n"
    assert [[text[a:b] for a, b in p] for p in licenses.paragraphs(text)] == [["One", "two."], ["three"], ["four (five)", "six!)"]]


def test_a_line_in_unfinished_lines_is_found(spark, model):
    text = "some words | of junk | that go on\n" * 30 + "Licensed under CC BY-NC 4.0.\nmore | junk"
    (r,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [(x.family, text[x.start : x.end]) for x in r.licences if x.confirmed] == [("cc-by-nc", "Licensed under CC BY-NC 4.0.")]


def test_reliability_on_licences_and_families_held_out(spark, model):
    """Families left out of the training whole should be unknown; what is unlisted should be too."""
    named = ["Distributed under the Boost Software License, Version 1.0.", "Licensed under the European Union Public Licence.", "Permission is granted to copy this document under the terms of the GNU Free Documentation License."]
    row, feature = licenses.rows_of([licenses.grams().ids(t.split()) for t in named])
    p = model.probabilities(row, feature, len(named))
    assert ((p.argmax(1) == len(licenses.TEMPLATES)) | (p.max(1) <= licenses.LEAST)).all()
    row, feature = licenses.rows_of([licenses.grams().ids("SPDX-License-Identifier: Apache-2.0".split())])
    assert licenses.FAMILIES[model.probabilities(row, feature, 1).argmax()] == "apache"
    sure = []
    for family in ("mpl", "isc", "proprietary"):
        held = licenses.fit([], without=frozenset([family]))
        own = licenses.TEMPLATES[family]
        row, feature = licenses.rows_of([licenses.grams().ids(t.split()) for t in own])
        p = held.probabilities(row, feature, len(own))
        sure += [(family, licenses.FAMILIES[c], round(float(x), 2)) for c, x in zip(p.argmax(1), p.max(1), strict=True)]
    print("held out whole:", sure, "temperature", model.temperature)
    assert sum(f != "unknown" and x > 0.9 for _, f, x in sure) <= len(sure) // 4
