import hashlib
import random
import re

from pyspark.sql import functions as F

from stemma.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    odd = [int(d) for d in digits[::-1]]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(odd)) % 10 == 0


def _valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and _luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    out = []
    for i, (kind, p) in enumerate(PLAIN.items()):
        out += [(m.start(), i, m.end()) for m in re.finditer(p, text or "") if _valid(kind, m[0])]
    return sorted(out)


TEXTS = [
    None,
    "",
    "a@b.c_d@e.f x@y..z q@-.-..r .@a.b.@c.d %@a.b a@b.",
    "é🙂 mail.1@x-y.example.com, tel +49 (30) 1234-5678) 192.168.000.1.5 1.2.3 256.1.1.1 00255.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111 378282246310005 1 2 3 4-5",
    "+1 (286) 555-5136 +12 +123456789 +1234567890123456 ++1 23456789",
    "9" * 20000 + "@x.y",
    "a" * 20000 + ".b" * 9000 + "@" + "c." * 9000 + "d",
    "1 " * 9000,
    'token = "f0ddae3b09ae356cbefecdd3232fa5489bb400d6" end. api_key: abcd1234efgh5678ijkl',
    "contact john [at] mail [dot] com or call 415-555-2671, IBAN DE89 3704 0044 0532 0130 00.",
    "+1\n4111111111111111\n1.1.1.1\n",
] + ["x1@y.zz " * 700]


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)] + [(None, "a@b.cd", None, 2)], "doc_id long, text string, kind string, spans int")


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(11)
    signs = ["a", "B", "1", "23", "255", ".", ".", "@", "-", "_", "%", "+", " ", "(", ")", "é", "🙂", "\n", "4111111111111111"]
    texts = TEXTS + ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(1500)]
    for r in pii.find(_docs(spark, texts)).collect():
        text = "a@b.cd" if r.k is None else texts[r.k]
        got = [(s.start, s.kind, s.end) for s in r.base]
        assert got == brute(text), (text or "")[:200]
        spans = [(s.start, s.kind, s.end) for s in r.all]
        assert set(got) <= set(spans) and spans == sorted(spans)
        assert all(not (a[0] < b[2] and b[0] < a[2]) for a in spans if a[1] >= 4 for b in got)


def test_added_spans_and_redaction(spark):
    texts = TEXTS + [f'user{i}@mail.example.com is here, secret = "{hashlib.sha1(str(i).encode()).hexdigest()}" done' for i in range(40)]
    found = pii.find(_docs(spark, texts), with_text=True)
    rows = {r.k: r for r in found.withColumn("red", pii.redact(found)).collect()}
    assert rows[9].red.startswith('token = "<secret>" end.')
    assert rows[20].red == '<email> is here, secret = "<secret>" done'
    assert rows[1].red == "" and rows[0].red == ""
    assert "john [at]" not in rows[10].red and "DE89" not in rows[10].red


def test_em_finds_the_unreliable_labeler():
    rng = random.Random(2)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.4
        votes = "".join(("2" if y else "0") if rng.random() < right else ("0" if y else "2") for right in (0.95, 0.9, 0.9, 0.85, 0.5))
        counts[votes] = counts.get(votes, 0) + 1
    posterior, prior, reliability = pii.expectation_maximisation([(0, v, n) for v, n in counts.items()])
    assert abs(prior[0] - 0.4) < 0.05
    assert reliability[0][1][2] > 0.9 and abs(reliability[4][1][2] - 0.5) < 0.07
    assert posterior[0, "22220"] > 0.9 > 0.1 > posterior[0, "00002"]


def test_query_columns(spark, sf):
    rows = queries.op9_pii(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    names = list(PLAIN)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
    assert queries.op9_pii(spark, sf).limit(0).count() == 0
    assert pii.find(spark.read.parquet(f"{sf}/documents.parquet").where(F.lit(False))).count() == 0


def test_loose_candidates_need_no_digit_and_no_lower_case(spark):
    texts = ["api_key = abcdefghijklmnop", "PASSWORD: HUNTERHUNTER", "CONTACT: JOHN[AT]EXAMPLE[DOT]COM", "john (At) example.com", "token of thanks at noon"]
    rows = pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("k").collect()
    got = [[(pii.KINDS[s.kind], r.t[s.start : s.end]) for s in r.spans] for r in rows]
    assert got == [[("secret", "abcdefghijklmnop")], [("secret", "HUNTERHUNTER")], [("obfuscated_email", "JOHN[AT]EXAMPLE[DOT]COM")], [("obfuscated_email", "john (At) example.com")], []]


def test_long_secrets_go_whole(spark):
    rng = random.Random(5)
    long = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789", k=k)) for k in (300, 5000)]
    texts = [f'api_key = "{x}" and more' for x in long] + ["write to " + "a" * 200 + " [at] " + "b" * 100 + " [dot] example [dot] com."] + [t for t in TEXTS if t and "token" in t] * 3
    found = pii.find(_docs(spark, texts), with_text=True)
    out = {r.k: (r.found, r.clean) for r in found.select("k", F.col("all").alias("found"), pii.redact(found).alias("clean")).collect()}
    for i, x in enumerate(long):
        assert [(s.end - s.start) for s in out[i][0]] == [len(x)]
        assert out[i][1] == 'api_key = "<secret>" and more'
    assert "<obfuscated_email>" in out[2][1] and "b" * 10 not in out[2][1]
