"""Quality classifier (operator 7): random-indexing word vectors, pooled, then a two-layer network.

A word is a run of anything but the six ASCII blanks, as it is written. Every word has a sparse random index vector, by its
hash, out of 2**BITS. Its word vector is the sum of the index vectors of the words up to two words away, over the
whole corpus, scaled to length 1. A document pools the mean vector of its words, and how they repeat, which no mean of
word vectors can show: the share of words equal to the one before, of different words, and the length. A network of one
tanh layer and one logistic output is fitted with numpy on a bounded sample of labelled rows (about `sample_rows`, by
hash of id and text); a fifth of the sample is kept apart to fit the temperature that the output is divided by, against
labels smoothed by one row of each class, so a sample that the network tells apart wholly still has a best temperature.

A task sums its word vectors in a table of a fixed size and sends that in parts, whose cells are one byte but for the few
that need more; parts meet in one task each. What comes to the driver is of a fixed size.

Defined results: null and empty texts pool to zero vectors and are scored like any other; a text of any length is read whole,
and so is a word; of equal scores none comes first; each input row gives one row; a null id stays null; other input
columns are not carried; an empty table gives an empty table; without training rows of both classes every score is the
share of label 1 (0.5 if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm._common import enter, keeps, materialise, plain_text, release, ship
from stemma.llm.toxicity import sampled

BITS, DIMENSIONS, NONZERO, WINDOW = 17, 48, 4, 2
#: Parts of the table of word vectors, each summed by one task.
PARTS = 64
SAMPLE_ROWS = 20_000
#: Bytes of text hashed and words summed at once.
SLICE_BYTES, SLICE_WORDS = 1 << 20, 1 << 17

#: The factor of the rolling hash of words, and its inverse modulo 2**64.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_blank = np.zeros(256, dtype=bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True
_held: dict[str, np.ndarray] = {}
keeps("quality_classifier", _held.clear)


def _powers(name: str, base: int, n: int) -> np.ndarray:
    if len(_held.get(name, ())) < n:
        out = np.full(max(n, SLICE_BYTES + 1), np.uint64(base))
        out[0] = 1
        _held[name] = np.cumprod(out)
    return _held[name][:n]


def index_vectors() -> np.ndarray:
    """The random index vector of each bucket."""
    if "index" not in _held:
        rng, n = np.random.default_rng(20), 1 << BITS
        place = np.argsort(rng.random((n, DIMENSIONS), dtype=np.float32), axis=1)[:, :NONZERO]
        out = np.zeros((n, DIMENSIONS), dtype=np.int8)
        np.put_along_axis(out, place, rng.choice(np.array([-1, 1], np.int8), place.shape), 1)
        _held["index"] = out
    return _held["index"]


def hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of some bytes: a polynomial of its bytes, stirred."""
    blank = _blank[data]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers("factor", _FACTOR, len(data)), out=total[1:])
    h = (total[end] - total[start]) * _powers("inverse", _INVERSE, len(data) + 1)[start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return start, h ^ h >> np.uint64(32)


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, number of the text that each stretch of them belongs to, as pairs of end and text), some at a time, cut at blanks only."""
    held, ends, size = [], [], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        at = 0
        while at < len(raw) or not raw:
            to = min(len(raw), at + SLICE_BYTES)
            if to < len(raw):  # back to a blank, or on to the word's end
                cut = max(raw.rfind(b, at, to) for b in (b" ", b"\n", b"\t", b"\x0b", b"\x0c", b"\r"))
                to = cut if cut > at else min((x for b in (b" ", b"\n", b"\t", b"\x0b", b"\x0c", b"\r") if (x := raw.find(b, to)) >= 0), default=len(raw))
            held.append(raw[at:to] + b" ")
            size += to - at + 1
            ends.append((size, i))
            if size >= SLICE_BYTES:
                yield np.frombuffer(b"".join(held), np.uint8), np.array(ends)
                held, ends, size = [], [], 0
            at = to
            if not raw:
                break
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.array(ends)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word of the texts, in order."""
    row, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for data, ends in _pieces(texts):
        start, h = hashed(data)
        row.append(ends[np.searchsorted(ends[:, 0], start, "right"), 1])
        out.append(h)
    return np.concatenate(row), np.concatenate(out)


def buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def add_contexts(table: np.ndarray, row: np.ndarray, word: np.ndarray) -> None:
    """Adds to each word's vector the index vectors around it in its text."""
    index = index_vectors()
    for at in range(0, len(word), SLICE_WORDS):
        to = min(len(word), at + SLICE_WORDS)
        low, high = max(0, at - WINDOW), min(len(word), to + WINDOW)
        near, own = index[word[low:high]], row[low:high]
        context = np.zeros_like(near)
        for step in range(1, WINDOW + 1):
            same = (own[step:] == own[:-step])[:, None]
            context[step:] += near[:-step] * same
            context[:-step] += near[step:] * same
        context, mine = context[at - low : to - low], word[at:to]
        order = np.argsort(mine, kind="stable")
        first = np.flatnonzero(np.diff(mine[order], prepend=-1))
        table[mine[order[first]]] += np.add.reduceat(context[order], first, axis=0, dtype=np.int32)


def _part_rows(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The parts of a table of sums: their lowest bytes, and the rest of the cells that need more."""
    cells = table.reshape(PARTS, -1)
    for part in np.flatnonzero(cells.any(axis=1)).tolist():
        low = cells[part].astype(np.int8)
        rest = cells[part] - low
        more = np.flatnonzero(rest)
        columns = [[part], [low.tobytes()], [more.astype(np.int32).tobytes()], [rest[more].astype(np.int32).tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "low", "at", "rest"])


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts, in order -> each part's word vectors, scaled to length 1 and 127 steps."""

    def done(part: int, cells: np.ndarray) -> pa.RecordBatch:
        v = cells.reshape(-1, DIMENSIONS).astype(np.float64)
        v = np.rint(127 * v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.int8)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["part", "v"])

    now, cells = None, None
    for batch in batches:
        for r in range(batch.num_rows):
            part = batch.column("part")[r].as_py()
            low, at, rest = (np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in (("low", np.int8), ("at", np.int32), ("rest", np.int32)))
            if part != now:
                if cells is not None:
                    yield done(now, cells)
                now, cells = part, np.zeros(len(low), np.int64)
            cells += low
            cells[at] += rest
    if cells is not None:
        yield done(now, cells)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The word vector of each bucket, from the whole corpus."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality_classifier")
        table = np.zeros((1 << BITS, DIMENSIONS), dtype=np.int32)
        for batch in batches:
            row, h = words(batch.column("t").to_pylist())
            add_contexts(table, row, buckets(h))
        yield from _part_rows(table)

    parts = docs.select(plain_text(text_col).alias("t")).mapInArrow(run, "part int, low binary, at binary, rest binary")
    summed = parts.repartition(PARTS, "part").sortWithinPartitions("part").mapInArrow(_sum_parts, "part int, v binary").toArrow()
    out = np.zeros((PARTS, (1 << BITS) // PARTS * DIMENSIONS), dtype=np.int8)
    for part, v in zip(summed.column("part").to_pylist(), summed.column("v").to_pylist(), strict=True):
        out[part] = np.frombuffer(v, np.int8)
    return out.reshape(-1, DIMENSIONS)


EXTRA = 3


def pool(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """One row of features for each text: the mean word vector, then how words repeat."""
    row, h = words(texts)
    n = np.bincount(row, minlength=len(texts))
    out = np.zeros((len(texts), DIMENSIONS + EXTRA), dtype=np.float64)
    word = buckets(h)
    for at in range(0, len(word), SLICE_WORDS):
        own, part = row[at : at + SLICE_WORDS], vectors[word[at : at + SLICE_WORDS]]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[first], :DIMENSIONS] += np.add.reduceat(part, first, axis=0, dtype=np.int64)
    size = np.maximum(n, 1)
    out[:, :DIMENSIONS] /= 127 * size[:, None]
    again = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    key = h + row.astype(np.uint64) * np.uint64(_FACTOR)
    different = row[np.unique(key, return_index=True)[1]]
    out[:, DIMENSIONS:] = np.stack([np.bincount(row[1:][again], minlength=len(texts)) / size, np.bincount(different, minlength=len(texts)) / size, np.log1p(n) / 10], 1)
    return out.astype(np.float32)


@dataclass
class Model:
    vectors: np.ndarray  # of all buckets, 127 steps
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x).astype(np.float64) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z)) if len(y) else 0.0


def fit_network(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, hidden: int = 32, epochs: int = 60, penalty: float = 1e-4) -> Model:
    """Adam on the log loss over four fifths of the rows, then the temperature on the rest."""
    n, d = x.shape
    rng = np.random.default_rng(7)
    order = rng.permutation(n)
    apart, own = order[: n // 5], order[n // 5 :]
    model = Model(vectors, x.mean(0), x.std(0) + 1e-3, rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0, 1.0)
    share = (y.sum() + 1) / (n + 2)
    model.b2 = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < n:
        return model
    state = [model.w1, model.b1, model.w2, np.array([model.b2])]
    first, second = [np.zeros_like(p) for p in state], [np.zeros_like(p) for p in state]
    z, t = (x - model.mean) / model.spread, 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        for part in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
            h = np.tanh(z[part] @ state[0] + state[1])
            g = (_sigmoid(h @ state[2] + state[3]) - y[part]) / len(part)
            back = np.outer(g, state[2]) * (1 - h * h)
            steps = [z[part].T @ back + penalty * state[0], back.sum(0), h.T @ g + penalty * state[2], g.sum(keepdims=True)]
            t += 1
            for p, s, m, v in zip(state, steps, first, second, strict=True):
                m += 0.1 * (s - m)
                v += 0.001 * (s * s - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = *state[:3], float(state[3][0])
    if 0 < y[apart].sum() < len(apart):
        z, some = model.logits(x[apart]), y[apart].sum()
        smooth = np.where(y[apart] == 1, (some + 1) / (some + 2), 1 / (len(apart) - some + 2))
        model.temperature = float(min(np.geomspace(0.02, 50, 241), key=lambda s: _loss(z / s, smooth)))
    return model


def features(rows: DataFrame, vectors: np.ndarray) -> DataFrame:
    """Replaces the text column t by x array<float>."""
    ship(rows.sparkSession)
    kept = [c for c in rows.columns if c != "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality_classifier")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = pool(part.column("t").to_pylist(), vectors)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(list(x), pa.list_(pa.float32()))], [*kept, "x"])

    return rows.mapInArrow(run, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", x array<float>")


def train(docs: DataFrame, labelled: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """docs: the whole corpus, for the word vectors. labelled: (k, t string, y int in 0, 1)."""
    vectors = word_vectors(docs, text_col)
    labelled = materialise(labelled.select("k", "t", "y"), "labelled")
    total = labelled.count()
    rows = features(sampled(labelled, sample_rows, {0: total, 1: total}).select("t", F.col("y").cast("int").alias("y")), vectors).toArrow()
    release(labelled)
    size = DIMENSIONS + EXTRA
    if not rows.num_rows:
        return Model(vectors, np.zeros(size), np.ones(size), np.zeros((size, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0)
    x = rows.column("x").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, size)
    y = rows.column("y").to_numpy().astype(np.float64)
    order = np.lexsort([*x[:, -EXTRA:].T, *x[:, :2].T, y])  # rows come in any order, the fit must not depend on it
    return fit_network(x[order], y[order], vectors)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score double): the calibrated probability of label 1."""
    return scored(docs.select(F.col(id_col).alias("k"), plain_text(text_col).alias("t")), model).withColumnRenamed("k", id_col)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """Replaces the text column t, which must not be null, by score double."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality_classifier")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                p = model.probabilities(pool(part.column("t").to_pylist(), model.vectors))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(p.astype(np.float64))], [*kept, "score"])

    kept = [c for c in rows.columns if c != "t"]
    return rows.mapInArrow(run, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", score double")
