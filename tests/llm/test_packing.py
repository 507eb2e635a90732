import random
import zlib

import numpy as np
import public_tokenizers as vocab
import pytest
from tokenizers import Tokenizer

from stemma.llm import packing

VOCABULARY = vocab.path("word_bpe_49k.json")
TEXTS = ["good night <|endoftext|> moon", "A<|startoftext|>B <|EndOfText|> É<|endoftext|>", None, "", " ", "Hello, World's end", "x" * 9000, "ÀÉ ñ ça <|endoftext|> don't", "a\x1cb\x85c d 　e​f", "é ́x İI", "one two " * 3000]


def _texts():
    rng = random.Random(5)
    words = ["Alpha", "beta,", "ça", "ÜBER", "12", "!!", "\n", "\x1f", " ", "漢", "🙂", "it's", "Σ", "ΣΑΣ"]
    return TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randrange(900))) for _ in range(60)] + ["same text"] * 5


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "no id", 2, None)], "doc_id long, text string, piece int, length string")


@pytest.mark.parametrize("capacity,block", [(2048, 8192), (64, 100)])
def test_every_piece_once_and_gapless(spark, capacity, block):
    texts = _texts()
    model = Tokenizer.from_file(VOCABULARY)
    rows = packing.pack(packing.pieces(_docs(spark, texts), VOCABULARY, capacity=capacity), capacity=capacity, block_items=block).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {*range(len(texts)), None}
    total = 0
    for i, own in by.items():
        ids = model.encode("no id" if i is None else texts[i] or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        for r in own:
            part = ids[r.piece * capacity : (r.piece + 1) * capacity]
            assert (r.start, r.length, r.ids_crc32) == (r.piece * capacity, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    if block == 8192:
        assert len(bins) <= -(-total // capacity) + 1


def test_special_tokens_as_text(spark):
    model = Tokenizer.from_file(VOCABULARY)
    assert packing.token_bytes(["good night <|endoftext|> moon"], VOCABULARY) == [np.array([886, 930, 49407, 3293], "<u4").tobytes()]
    model.encode_special_tokens = True
    want = [np.array(model.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in TEXTS]
    assert packing.token_bytes([t or "" for t in TEXTS], VOCABULARY, special_as_text=True) == want


def test_crossover_gains_bins_over_best_fit(spark):
    rng = np.random.default_rng(0)
    length = rng.integers(500, 1024, 600)  # plain best fit by length is far from the bound here
    plain = packing._seed(length, 2048, 0, rng)
    start = [packing._seed(length, 2048, noise, rng) for noise in (0.1, 0.2, 0.3, 0.4)]
    child = packing.cross(length, start[1], start[2], 2048, rng)
    for bins in (*start, child):
        assert (packing._free(length, bins, 2048) >= 0).all()
        assert len(np.unique(bins)) == bins.max() + 1
    found, made, better = packing.evolve(length, start, 2048, rng, children=200)
    assert made == 200 and better > 10  # children better than both of their parents
    gain = plain.max() - found[0].max()
    print("children", made, "better than both parents", better, "bins gained", gain, "of", plain.max() + 1)
    assert gain >= 5


def test_no_island_rests_before_its_first_children():
    rng = np.random.default_rng(0)
    length = np.full(50, 1024)  # any packing meets the bound
    assert packing.evolve(length, [], 2048, rng, least=packing.LEAST_CHILDREN)[1] == packing.LEAST_CHILDREN
    assert packing.evolve(np.array([5]), [], 2048, rng, least=2)[0][0].tolist() == [0]


def test_islands_start_apart_and_run_in_several_tasks(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    rows = [(b, [(b * 300 + i, int(n)) for i, n in enumerate(rng.integers(500, 1024, 300))]) for b in range(4)]
    gathered = spark.createDataFrame(rows, "block long, own array<struct<uid: long, n: int>>")
    (one,) = packing.islands_of(gathered, 8, epochs=1)
    assert one.groupBy(F.spark_partition_id()).count().count() > 1 or one.select(F.input_file_name()).distinct().count() > 2
    by = {}
    for r in one.collect():
        assert r.made >= packing.LEAST_CHILDREN
        by.setdefault(r.block, set()).add(bytes(r.population[0]))
    assert all(len(own) == packing.ISLANDS for own in by.values())
    last = packing.islands_of(gathered, 8)[-1].collect()
    assert len(last) == 4 * packing.ISLANDS  # none is at the bound here, so all go on
    for r in last:
        length = np.array(r.lengths)
        plain = packing._seed(length, 2048, 0, rng)
        assert r.n_bins < plain.max() + 1 and r.better > 0


def test_own_columns_replace_those_of_the_input(spark):
    rows = spark.createDataFrame([(1, 5, "a", "b"), (2, 2048, "c", "d")], "doc_id long, length int, sequence_id string, offset string")
    got = {r.doc_id: (r.length, r.offset) for r in packing.pack(rows).collect()}
    assert got == {1: (5, 0), 2: (2048, 0)}


def test_empty(spark):
    assert packing.pack(packing.pieces(_docs(spark, []).limit(0), VOCABULARY)).count() == 0
