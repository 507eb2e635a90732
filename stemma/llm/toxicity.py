"""Toxicity (operator 8): a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased, ASCII that is neither letter nor digit becomes a blank, and the n-grams of 3, 5 and 7 characters are
hashed into 2**BITS buckets. How many toxic and other texts hold each bucket is counted over all labelled training rows. A
bucket's feature is its presence, scaled by the log ratio of its two smoothed shares; the smoothing is by one text, split as
the classes are, so a bucket seen once says little. Buckets count whose shares differ by more than TELLING standard
errors, and LEAST_FEATURES that differ most if there are fewer; how many that are grows with the training rows. Logistic
regression on the scaled presence of these is fitted on a bounded sample of the training rows (about `sample_rows` of each
class, by hash of id and text). Scoring reads a table of one weight for each bucket.

Defined results: null and empty texts have no n-gram and get the score of the intercept; a text of any length is read
whole, SLICE_CHARS at a time; a bucket counts once for a text; of buckets that differ alike the lower counts first; each
input row gives one row; a null id stays null; other input columns are not carried; an empty table gives an empty table;
without training rows of both classes every score is the training share of toxic rows (0.5 if there are none).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm._common import enter, materialise, plain_text, release, ship

SIZES, BITS = (3, 5, 7), 19
TELLING, LEAST_FEATURES, SAMPLE_ROWS = 3.0, 1000, 4000
#: Labels of up to this many bytes, ids and all, are sent to every executor; more are joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: Characters hashed at once.
SLICE_CHARS = 1 << 20
#: ASCII other than letters and digits becomes a blank.
_fold = np.array([b if chr(b).isalnum() else 32 for b in range(128)], dtype=np.uint32)


@dataclass
class Model:
    weight: np.ndarray  # by bucket
    intercept: float


def _codes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(data < 128, _fold[np.minimum(data, 127)], data)


def _hashes(data: np.ndarray) -> Iterator[np.ndarray]:
    """For each size, the bucket of the characters from each position on."""
    h, done = np.zeros(len(data), dtype=np.uint32), 0
    for n in SIZES:
        if len(data) < n:
            return
        h = h[: len(data) - n + 1].copy()
        for i in range(done, n):
            h *= np.uint32(0x01000193)
            h ^= data[i : i + len(h)]
        done = n
        yield (h * np.uint32(0x9E3779B1) ^ np.uint32(n * 0x01000193)) >> np.uint32(32 - BITS)


class Reader:
    """Texts -> their distinct buckets. Keeps a scratch number for each bucket."""

    def __init__(self) -> None:
        self.last = np.zeros(1 << BITS, dtype=np.int32)

    def _once(self, found: np.ndarray) -> np.ndarray:
        at = np.arange(len(found), dtype=np.int32)
        self.last[found] = at  # the last of equal buckets stays
        return found[self.last[found] == at]

    def buckets(self, text: str) -> np.ndarray:
        own, text = np.zeros(0, np.uint32), text.lower()
        for at in range(0, max(len(text), 1), SLICE_CHARS):
            part = _codes(text[at : at + SLICE_CHARS + SIZES[-1] - 1])
            own = self._once(np.concatenate([own, *_hashes(part)]))
        return own


def bucket_counts(labelled: DataFrame) -> DataFrame:
    """labelled (t string, y int) -> (bucket, texts with y = 0, with y = 1), over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        counts, read = np.zeros((2, 1 << BITS), dtype=np.int64), Reader()
        for batch in batches:
            for t, y in zip(batch.column("t").to_pylist(), batch.column("y").to_pylist(), strict=True):
                counts[y][read.buckets(t)] += 1
        some = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])], ["bucket", "c0", "c1"])

    return labelled.select("t", "y").mapInArrow(run, "bucket long, c0 long, c1 long").groupBy("bucket").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def ratios(c0: np.ndarray, c1: np.ndarray, n0: int, n1: int) -> tuple[np.ndarray, np.ndarray]:
    """(log ratio of the smoothed shares, how many standard errors the shares lie apart) of each bucket."""
    q = n1 / (n0 + n1)
    ratio = np.log((c1 + q) / (n1 + q)) - np.log((c0 + 1 - q) / (n0 + 1 - q))
    p = (c0 + c1) / (n0 + n1)
    return ratio, np.abs(c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n0 + 1 / n1))


def telling(apart: np.ndarray, least: int = LEAST_FEATURES) -> np.ndarray:
    """Places of the buckets that count, in order."""
    first = np.argsort(-apart, kind="stable")
    return np.sort(first[: max(least, int((apart > TELLING).sum()))])


def presence(sample: DataFrame, wanted: np.ndarray) -> DataFrame:
    """sample (t, y) -> (y, n, gaps) with the wanted buckets of each text: their number, and the gaps between them in order,
    compressed, since all of them go to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        read = Reader()
        for batch in batches:
            found = [np.sort(b[wanted[b]]).astype(np.int32) for b in map(read.buckets, batch.column("t").to_pylist())]
            gaps = [zlib.compress(np.diff(b, prepend=0).astype(np.int32).tobytes(), 1) for b in found]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([len(b) for b in found], pa.int32()), pa.array(gaps, pa.binary())], ["y", "n", "gaps"])

    return sample.select("t", F.col("y").cast("int").alias("y")).mapInArrow(run, "y int, n int, gaps binary")


def fit_linear(size: np.ndarray, col: np.ndarray, y: np.ndarray, scale: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.3, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by steps on small batches, each weight at its own falling rate, so little is held beside the features. Row
    i has the next size[i] features of col. Both classes weigh alike in the fit. The order of the rows does not matter."""
    end = np.cumsum(size)
    sums = np.add.reduceat(np.append(col, 0).astype(np.int64), np.append(end - size, len(col)))[:-1] * (size > 0)
    order = np.lexsort((sums, size, y))
    share = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) * len(y)
    rng = np.random.default_rng(8)
    w, b, seen, seen_b = np.zeros(len(scale)), 0.0, np.full(len(scale), 1e-8), 1e-8
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(order), max(1, len(order) // batch)):
            own = np.concatenate([col[end[i] - size[i] : end[i]] for i in part])
            row = np.repeat(np.arange(len(part)), size[part])
            value = scale[own] / np.sqrt(np.maximum(size[part], 1))[row]
            z = np.bincount(row, weights=value * w[own], minlength=len(part)) + b
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * share[part] / len(part)
            step = np.bincount(own, weights=value * g[row], minlength=len(scale)) + penalty * w
            seen += step**2
            seen_b += g.sum() ** 2
            w -= rate * step / np.sqrt(seen)
            b -= rate * g.sum() / np.sqrt(seen_b)
    return w, b


def sampled(rows: DataFrame, most: int, total: dict[int, int]) -> DataFrame:
    """rows (k, t, y): about `most` of each label at most, by hash of id and text, so the same whatever the partitions are. Rows
    alike in all three are one, so a row that comes very often cannot fill the sample."""
    chance = F.when(F.col("y") == 1, min(1.0, most / max(total.get(1, 0), 1))).otherwise(min(1.0, most / max(total.get(0, 0), 1)))
    some = rows.select("k", "t", "y", F.xxhash64("k", "t").alias("h")).where(F.pmod("h", F.lit(1 << 30)) < chance * (1 << 30))
    return some.dropDuplicates(["h", "y"]).drop("h")


def train(labelled: DataFrame, least_features: int = LEAST_FEATURES, sample_rows: int = SAMPLE_ROWS) -> Model:
    """labelled (k, t string, y int in 0, 1)."""
    ship(labelled.sparkSession)
    labelled = materialise(labelled.select("k", "t", "y"), "labelled")
    total = {r.y: r.n for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    none = np.zeros(1 << BITS, dtype=np.float32)
    if not n0 or not n1:
        p = min(max(n1 / (n0 + n1), 1e-6), 1 - 1e-6) if n0 + n1 else 0.5
        return Model(none, float(np.log(p / (1 - p))))
    counts = bucket_counts(labelled).toArrow().sort_by("bucket")  # at most 2**BITS rows
    bucket, c0, c1 = (counts.column(c).to_numpy() for c in ("bucket", "c0", "c1"))
    ratio, apart = ratios(c0, c1, n0, n1)
    kept = telling(apart, least_features)
    wanted = np.zeros(1 << BITS, dtype=bool)
    wanted[bucket[kept]] = True
    sample = presence(sampled(labelled, sample_rows, total), wanted).toArrow()
    release(labelled)
    size = sample.column("n").to_numpy()
    place = np.zeros(1 << BITS, dtype=np.int32)
    place[bucket[kept]] = np.arange(len(kept))
    col, at = np.zeros(size.sum(), dtype=np.int32), 0
    for gaps, n in zip(sample.column("gaps"), size.tolist(), strict=True):
        col[at : at + n] = place[np.cumsum(np.frombuffer(zlib.decompress(gaps.as_py()), np.int32))]
        at += n
    own, b = fit_linear(size, col, sample.column("y").to_numpy(), ratio[kept])
    weight = none.copy()
    weight[bucket[kept]] = own * ratio[kept]
    return Model(weight, float(b))


def score_texts(texts: list[str], model: Model) -> np.ndarray:
    read, wanted = Reader(), model.weight != 0
    z = np.zeros(len(texts))
    for i, text in enumerate(texts):
        own = read.buckets(text)
        own = own[wanted[own]]
        z[i] = model.weight[own].sum(dtype=np.float64) / np.sqrt(max(len(own), 1)) + model.intercept
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score double)."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(score_texts(batch.column("t").to_pylist(), model))], ["k", "score"])

    rows = docs.select(F.col(id_col).alias("k"), plain_text(text_col).alias("t"))
    return rows.mapInArrow(run, f"k {kind}, score double").withColumnRenamed("k", id_col)


def held_out(id_col: str, folds: int, fold: int):
    """crc32 of the id as text leaves this remainder; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % folds == fold


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, t, y) of the documents that have a label and are not held out."""
    own = labels.select(F.col(id_col).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out("k", folds, fold))
    size = own.agg(F.sum(F.length(F.coalesce(F.col("k").cast("string"), F.lit(""))) + 24)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        own = F.broadcast(own)  # the texts stay where they are
    return docs.select(F.col(id_col).alias("k"), plain_text(text_col).alias("t")).join(own, "k")
