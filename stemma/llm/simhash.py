"""SimHash near-dedup (operator 4): anchor-point covering.

Equal fingerprints are one node, so copies cost nothing. Of two fingerprints that differ in at most three bits,
one 32-bit half differs in at most one. For each half the anchors are the words of a covering code: the binary
Golay code on 23 bits, the Hamming code on 7, both perfect, and all words on the last 2. A half's home is the
nearest anchor, within the covering radii. A fingerprint is replicated to every anchor within the covering
radius plus one, so the two of a pair meet at the home of either. At each anchor its own fingerprints are
compared with all that were sent there; what leaves is a spanning forest of the links found, never all pairs.
An anchor with very many fingerprints is cut into a grid of cells, each compared by a task of its own.

Defined results: null and wordless texts have fingerprint 0 and are linked like any other; a very long text is read whole, some
65,536 shingles at a time; a bit set in exactly half the shingles is 0; repeated rows and repeated
ids each give a row; rows with a null id get their group's smallest id (null if it has none); other input
columns are not carried; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm._common import enter, materialise, plain_text, release, ship
from stemma.llm._components import components

SEED = 42
#: Rows of an anchor's cell; beyond it the anchor is cut into more cells.
CELL_ROWS = 32768
#: Pairs compared at once.
PAIRS = 1 << 21


def fingerprint(text: str, width: int) -> int:
    """The unsigned fingerprint of one text."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower: A-Z only; split: the six ASCII blanks
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), SEED)
    ones, n = np.zeros(64, dtype=np.int64), len(words) - width + 1
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + width - 1]
        rows = zip(*(part[i:] for i in range(width)), strict=False)
        h = np.array([digest(b" ".join(r), SEED) for r in rows], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id_col, fp bigint): the 64 bits of each whole text's fingerprint."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("simhash")
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                fp = np.array([fingerprint(t, width) for t in part.column("t").to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(fp.view(np.int64))], ["k", "fp"])

    rows = docs.select(F.col(id_col).alias("k"), plain_text(text_col).alias("t"))
    return rows.mapInArrow(run, f"k {kind}, fp long").select(F.col("k").alias(id_col), "fp")


def _remainder(word: np.ndarray, n: int, generator: int, degree: int) -> np.ndarray:
    """Of each word of n bits as a polynomial over GF(2)."""
    word = word.copy()
    for bit in range(n - 1, degree - 1, -1):
        word ^= np.where(word >> bit & 1, generator << (bit - degree), 0).astype(word.dtype)
    return word


def _leaders(n: int, generator: int, degree: int, radius: int) -> np.ndarray:
    """The one error of at most `radius` bits for each remainder of a perfect code."""
    errors = [0]
    for _ in range(radius):
        errors = sorted({e | 1 << i for e in errors for i in range(n)} | set(errors))
    errors = np.array(errors, dtype=np.int64)
    table = np.zeros(1 << degree, dtype=np.int64)
    table[_remainder(errors, n, generator, degree)] = errors
    return table


#: Bits, generator polynomial, its degree, covering radius.
GOLAY, HAMMING = (23, 0b101011100011, 11, 3), (7, 0b1011, 3, 1)


def homes(half: np.ndarray) -> np.ndarray:
    """The 18-bit number of the nearest anchor of each 32-bit half."""
    out = half >> 30  # the last two bits are their own anchor
    for (n, generator, degree, radius), shift in ((GOLAY, 0), (HAMMING, 23)):
        word = half >> shift & (1 << n) - 1
        code = word ^ _leaders(n, generator, degree, radius)[_remainder(word, n, generator, degree)]
        out = out << n - degree | code >> degree
    return out


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, whether it is the row's home) of all replicas of unsigned fingerprints."""
    row, anchor, home = [], [], []
    flips = np.array([0] + [1 << i for i in range(32)], dtype=np.int64)
    for h in (0, 1):
        half = (fp >> np.uint64(32 * h) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        near = homes((half[:, None] ^ flips[None, :]).ravel()).reshape(-1, 33)
        own = near[:, 0].copy()
        near.sort(axis=1)
        first = np.ones_like(near, dtype=bool)
        first[:, 1:] = near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(first)
        row.append(r)
        anchor.append(near[r, c] | h << 18)
        home.append(near[r, c] == own[r])
    return np.concatenate(row), np.concatenate(anchor), np.concatenate(home)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 4096):
            part = fp[at : at + 4096]
            row, anchor, home = anchors(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row]), pa.array(home)], ["anchor", "fp", "home"])


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges: as many as are needed for the same components."""
    if not len(u):
        return u, v
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root, keep = np.arange(len(nodes)), []
    live = np.arange(len(u))
    while len(live):
        high, low = np.maximum(root[a[live]], root[b[live]]), np.minimum(root[a[live]], root[b[live]])
        apart = high != low
        live, high, low = live[apart], high[apart], low[apart]
        if not len(live):
            break
        child, pick = np.unique(high, return_index=True)
        root[child] = low[pick]
        keep.append(live[pick])
        while not np.array_equal(jump := root[root], root):
            root = jump
    keep = np.concatenate(keep) if keep else np.zeros(0, np.int64)
    return u[keep], v[keep]


def _compare(most_bits: int):
    """Rows sorted by cell -> links between different fingerprints of a cell, thinned to a forest."""

    def links(cell: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        size = np.diff(np.r_[start, len(cell)])
        group = np.repeat(np.arange(len(start)), size)
        left = np.flatnonzero(home & (size[group] > 1))
        us, vs, held = [], [], 0
        reach = np.cumsum(size[group[left]])
        at = 0
        while at < len(left):
            done = reach[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(reach, done + PAIRS, "right")))
            own = left[at:to]
            n = size[group[own]]
            a = np.repeat(own, n)
            b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[group[own]], n)
            near = (np.bitwise_count(fp[a] ^ fp[b]) <= most_bits) & (fp[a] != fp[b])
            us.append(fp[a[near]])
            vs.append(fp[b[near]])
            held += len(us[-1])
            if held > PAIRS:
                u, v = forest(np.concatenate(us), np.concatenate(vs))
                us, vs, held = [u], [v], 0
            at = to
        return forest(np.concatenate(us), np.concatenate(vs)) if us else (fp[:0], fp[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None

        def out(cell, fp, home):
            u, v = links(cell, fp.view(np.uint64), home)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "fp", "home")]
            if not len(now[0]):
                continue
            kept = now if kept is None else [np.concatenate(x) for x in zip(kept, now, strict=True)]
            last = int(np.searchsorted(kept[0], kept[0][-1], "left"))
            if last:
                yield out(*(x[:last] for x in kept))
                kept = [x[last:] for x in kept]
        if kept is not None:
            yield out(*kept)

    return run


def links(prints: DataFrame, most_bits: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (u, v) that join all of the distinct fingerprints `fp` at `most_bits` (3 or fewer) differing bits
    into the right components. They are written down and can be released."""
    if most_bits > 3:
        raise ValueError("the anchors cover at most three differing bits")
    ship(prints.sparkSession)
    # Written down: it is read for the sizes of the anchors and for the cells.
    spread = materialise(prints.mapInArrow(_replicate, "anchor long, fp long, home boolean"), "replicas")
    # Cells of a large anchor: its own fingerprints go by one number, all that were sent there by another.
    large = spread.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("h")).where(F.col("n") > cell_rows)
    large = large.select("anchor", F.ceil(F.col("n") / cell_rows).cast("long").alias("b"), F.ceil(F.col("h") / cell_rows).cast("long").alias("a"))
    placed = spread.join(large, "anchor", "left").fillna(1, ["a", "b"])
    own = placed.where("home").select("anchor", "fp", F.lit(True).alias("home"), F.expr("pmod(xxhash64(fp, 1), a)").alias("i"), F.explode(F.expr("sequence(0L, b - 1)")).alias("j"))
    sent = placed.select("anchor", "fp", F.lit(False).alias("home"), F.explode(F.expr("sequence(0L, a - 1)")).alias("i"), F.expr("pmod(xxhash64(fp, 2), b)").alias("j"))
    cells = own.unionByName(sent).select(F.expr("if(i = 0 and j = 0, anchor, xxhash64(anchor, i, j))").alias("cell"), "fp", "home")
    found = materialise(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(most_bits), "u long, v long"), "links")
    release(spread)
    return found


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most_bits: int = 3) -> DataFrame:
    """(id_col, fp, component_id): component_id is the smallest id of the texts reachable over links."""
    rows = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    found = links(nodes.select("fp"), most_bits)
    roots = components(found)
    release(found)
    linked = roots.select(F.col("node").alias("fp"), "root").unionAll(roots.select(F.col("root").alias("fp"), "root").distinct())
    named = linked.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    moved = linked.join(named, "root").select("fp", "component_id")
    # Written down, so the join with the rows is of two tables, whose hot fingerprint Spark splits.
    by_print = materialise(nodes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "components")
    for done in (nodes, roots):
        release(done)
    return rows.join(by_print, "fp", "left").select(id_col, "fp", "component_id")


def hex_digits(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
