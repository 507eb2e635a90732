import hashlib
import random
import re
from collections import Counter

import public_tokenizers as vocab
import pytest
import tiktoken
import xxhash

from stemma.llm import byte_bpe, quality_rules, simhash

RANKS = vocab.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "a", "the the the the", "x" * 5000, " " * 3000 + "b", "é" * 700 + " ü\n\n\tß", "don't we'll\r\n  it's 12 345 ☃☃ 漢字", "\x1c \x85   a"]


def _texts():
    rng = random.Random(7)
    words = ["alpha", "beta,", "ça", "über", "12", "!!", "\n", "\n\n ", "'s", "\t", "漢", "🙂", "  "]
    return ODD + [" ".join(rng.choice(words) for _ in range(rng.randrange(400))) for _ in range(30)] + ["ab ab"] * 3


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "k", "t") for i, t in enumerate(texts)] + [(None, "no id", None, None)], "doc_id long, text string, k string, ids string")


THREES = r"\p{N}{1,3}| ?\p{L}+|\s*[\r\n]+|\s+(?!\S)|\s+|[^\s\p{L}\p{N}]+"


@pytest.mark.parametrize("pattern", [vocab.PATTERN, THREES])
@pytest.mark.parametrize("chunk,overlap,spread", [(4096, 256, 1 << 20), (64, 16, 1 << 20), (60, 12, 60), (32, 4, 100), (64, 64, 64)])
def test_bpe_equals_library_and_round_trips(spark, pattern, chunk, overlap, spread):
    texts = [*_texts(), "a" + "1234567" * 60, "ab " * 50 + "7" * 500 + " x" * 90, ("  \n" * 9 + "we're ") * 20]
    plain = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    out = byte_bpe.decode(byte_bpe.encode(_docs(spark, texts), RANKS, pattern, chunk_chars=chunk, overlap_chars=overlap, spread_chars=spread), RANKS).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        text = "no id" if r.doc_id is None else texts[r.doc_id] or ""
        assert r.ids == plain.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()


@pytest.mark.parametrize("pattern", [vocab.PATTERN, THREES])
def test_cuts_are_boundaries_whatever_the_text(pattern):
    import regex

    rng, find = random.Random(11), regex.compile(pattern).finditer
    for _ in range(400):
        text = "".join(rng.choice(["a", "we're", " ", "  ", "\n", "7", "1234567", "!!", "é", "漢字", "'s", "\t", "'"]) * rng.choice([1, 1, 1, 9]) for _ in range(rng.randrange(60)))
        chunk = rng.randrange(4, 40)
        cuts = byte_bpe.stitch(find, text, chunk, rng.randrange(3, chunk + 1))
        assert cuts == sorted(cuts) and set(cuts) <= {m.start() for m in find(text)} | {0, len(text)}


def test_share_of_texts_that_are_stitched():
    import duckdb
    import regex

    find = regex.compile(vocab.PATTERN).finditer
    texts = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.1/documents.parquet'").fetchall()]
    cut = [byte_bpe.stitch(find, t, byte_bpe.CHUNK_CHARS, byte_bpe.OVERLAP_CHARS) for t in texts if len(t) > byte_bpe.CHUNK_CHARS]
    joints = sum(len(c) - 2 for c in cut)
    print("texts stitched", len(cut), "of", len(texts), "with", joints, "joints")
    assert len(cut) > 0.1 * len(texts) and joints > len(cut)


def _brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_ledger_measures_and_policies(spark):
    texts = _texts() + ["a b c d a b c\nx\nx\nx", "ab " * 60, "#" * 99]
    out = quality_rules.ledger(_docs(spark, texts))
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:6] == _brute_rules(t), t
        assert bool(got[i].failed & 1) == (got[i].n_words < 50)
    policy = quality_rules.STRICT
    kept = {r.doc_id: r.kept for r in quality_rules.apply_policy(out, policy).collect()}
    for row in quality_rules.ablation(out, policy).collect():
        bit = 1 << list(quality_rules.RULES).index(row.rule)
        assert row.n_failed == sum(bool(r.failed & bit) for r in got.values())
        assert row.n_only == sum(r.failed == bit for r in got.values())
        assert row.n_rejected_without == sum(bool(r.failed & ~bit) for r in got.values())
    assert kept == {k: r.failed == 0 for k, r in got.items()}


def _brute_print(text, width=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    rows = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _brute_groups(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= 3:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("cell_rows", [simhash.CELL_ROWS, 40])
def test_links_find_every_component(spark, cell_rows):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for p in list(prints):
        for _ in range(rng.randrange(12)):
            p ^= sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 5))})
            prints.add(p)
    centre = rng.getrandbits(64)
    prints |= {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), cell_rows=cell_rows)
    roots = {r.node: r.root for r in simhash.components(found).collect()}
    want, got = _brute_groups(sorted(prints)), {}
    for p in signed:
        got.setdefault(roots.get(p, p), set()).add(p % (1 << 64))
    groups = {}
    for p, r in want.items():
        groups.setdefault(r, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_group_on_texts(spark):
    base = "one two three four five six seven eight nine ten " * 40
    texts = _texts() + [base, base + "eleven", base.upper(), "zero " + base]
    out = simhash.group(_docs(spark, texts)).collect()
    assert len(out) == len(texts) + 1
    prints = {i: _brute_print(t) for i, t in enumerate(texts)} | {None: _brute_print("no id")}
    root = _brute_groups(sorted(set(prints.values())))
    for r in out:
        assert r.fp % (1 << 64) == prints[r.doc_id]
        assert r.component_id == min((i for i, p in prints.items() if i is not None and root[p] == root[prints[r.doc_id]]), default=None)


def test_empty_tables(spark):
    none = _docs(spark, []).limit(0)
    assert byte_bpe.decode(byte_bpe.encode(none, RANKS, vocab.PATTERN), RANKS).count() == 0
    assert simhash.group(none).count() == 0
    assert quality_rules.ledger(none).count() == 0


def test_digests_of_the_query(spark, sf):
    from stemma.llm import queries

    plain = tiktoken.Encoding("t", pat_str=vocab.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op2_byte_bpe(spark, sf).collect():
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
