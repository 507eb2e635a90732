"""Best-fit packing (operator 3): a grouping genetic algorithm on islands.

Documents are tokenised and only those longer than a sequence are cut. The pieces are dealt into blocks of a bounded
number of pieces, each with several islands: populations of whole packings. Every island starts from its own best fits of
orders disturbed by chance, none from the plain order. A child takes well-filled bins of one parent whole, drops the
other parent's bins that hold any of their pieces and the emptiest ones, and gets the pieces thus displaced back: first
where one fills a loose bin better than one or two of its pieces, which are displaced in turn, then by best fit, longest
first. Between epochs each island's best packing moves on to the next island. Every island makes at least LEAST_CHILDREN
children; after that it rests once its best packing meets the lower bound on the number of bins, which no packing can
beat. The best packing of any island is the block's.

Ids are the tokenizer's own with add_special_tokens=False: the strings of its special tokens in a text give those tokens'
ids, unless `special_as_text` is set.

Defined results: null and empty texts are the closing id alone; a very long text is read whole; of pieces of equal length
any may take a place; each input row gives its pieces, so repeated rows and repeated ids are packed as often as they
come; a null id stays null; other input columns of documents are not carried, those of pack() are, but for its own
two, which replace theirs; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm._common import enter, keeps, materialise, plain_text, release, ship

CAPACITY = 2048
BLOCK_ITEMS, ISLANDS, EPOCHS = 8192, 2, 3
POPULATION, CHILDREN, LEAST_CHILDREN = 4, 24, 6
#: Bins that a child opens beside those it must; pieces of a bin of which pairs are tried; tasks of an epoch for each core.
OPENED, PAIRED, TASKS_A_CORE = 8, 24, 2
#: Words, and words without case and punctuation, whose ids a worker keeps; a table is emptied when full.
MEMO_WORDS, MEMO_CORES = 1_000_000, 600_000

_state: dict[str, _Memo] = {}
keeps("packing", _state.clear)
_odd_blank = re.compile("[\x1c-\x1f]")
#: Letters that stay single letters in lower case and under composition, then punctuation without an apostrophe: the
#: tokenizer cuts such a word between the two. Or any other word; one on each line.
_parts = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]{1,64})([!-&(-/:-@\[-`{-~]{0,16})|(.*))$", re.M).findall


def _latin(text: str) -> bool:
    """All characters are in Latin-1, whose lower case is the tokenizer's own whatever stands around them."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Memo:
    """One tokenizer and its tables of ids, as bytes, for each worker process."""

    def __init__(self, vocabulary_path: str, special_as_text: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(vocabulary_path)
        self.model.encode_special_tokens = special_as_text
        self.special = () if special_as_text else tuple({t.content[:2] for t in self.model.get_added_tokens_decoder().values()})
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {"": b""}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_letters(self, cores: list[str]) -> None:
        """All of them as one text, whose ids are cut after each word's last."""
        ids = np.asarray(self.model.encode(" ".join(cores), add_special_tokens=False).ids, dtype="<u4")
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(cuts) != len(cores):
            raise ValueError("the vocabulary does not mark the ends of words")
        data = ids.tobytes()
        self.cores.update(zip(cores, map(data.__getitem__, map(slice, [0, *cuts[:-1].tolist()], cuts.tolist())), strict=True))

    def learn(self, words: list[str]) -> dict[str, bytes]:
        if len(self.cores) > MEMO_CORES:
            self.cores = {"": b""}
        lines = [w for w in words if "\n" not in w]
        parts = _parts("\n".join(lines)) if lines else []
        rest = [w for w, (_, _, other) in zip(lines, parts, strict=True) if other] + [w for w in words if "\n" in w]
        # One string for both tables where a word is all letters.
        cut = [(w, w if core == w and w.islower() else core.lower(), mark) for w, (core, mark, other) in zip(lines, parts, strict=True) if not other]
        known = self.cores
        cores, marks = ([x for x in {c[i] for c in cut} if x not in known] for i in (1, 2))
        for at in range(0, len(cores), 4096):
            self._learn_letters(cores[at : at + 4096])
        known.update(zip(marks, self.whole(marks), strict=True))
        out = {w: known[a] + known[b] for w, a, b in cut}
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            out.update(zip(part, self.whole(part), strict=True))
        return out


def token_bytes(texts: list[str], vocabulary_path: str, special_as_text: bool = False) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers. The tokenizer drops blanks and no merge
    crosses one, so a word between blanks is encoded once and looked up after that."""
    name = f"{vocabulary_path}\n{special_as_text}"
    if name not in _state:
        _state[name] = _Memo(vocabulary_path, special_as_text)
    memo = _state[name]

    def cut(text: str) -> list[str]:
        if _odd_blank.search(text):  # str.split takes these for blanks, the tokenizer does not
            return [text]
        exact = any(s in text for s in memo.special)  # special tokens are found before the tokenizer turns to lower case
        return (text.lower() if not exact and _latin(text) else text).split()

    words = list(map(cut, texts))
    if len(memo.words) > MEMO_WORDS:
        memo.words.clear()
    new = list(set().union(*words).difference(memo.words))
    memo.words.update(memo.learn(new))
    out = [b"".join(map(memo.words.__getitem__, own)) for own in words]
    for w in new:
        if len(w) > 64:
            del memo.words[w]
    return out


def pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """(id_col, piece int, start long, length long, ids_crc32 long[, ids binary]) of every document."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["k", "piece", "start", "length", "crc", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("packing")
        close = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                row, rest = [], []
                for i, ids in enumerate(token_bytes(part.column("t").to_pylist(), vocabulary_path, special_as_text)):
                    ids += close
                    for no, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        row.append(i)
                        rest.append((no, start // 4, len(own) // 4, zlib.crc32(own), own))
                columns = list(zip(*rest, strict=True))[: 4 + with_ids]
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(row)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=False))], names)

    rows = docs.select(F.col(id_col).alias("k"), plain_text(text_col).alias("t"))
    out = rows.mapInArrow(run, f"k {kind}, piece int, start long, length long, crc long" + ", ids binary" * with_ids)
    return out.withColumnsRenamed({"k": id_col, "crc": "ids_crc32"})


def best_fit(length: np.ndarray, items: np.ndarray, bins: np.ndarray, free: list[int], capacity: int) -> None:
    """Puts items, longest first, where they leave least room; opens bins as needed. Changes bins and free."""
    slots: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_at = 0
    for b, room in enumerate(free):
        if room:
            slots[room].append(b)
            open_at |= 1 << room
    order = items[np.argsort(-length[items], kind="stable")]
    for i, need in zip(order.tolist(), length[order].tolist(), strict=True):
        fit = open_at >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            b = slots[room].pop()
            if not slots[room]:
                open_at ^= 1 << room
        else:
            room, b = capacity, len(free)
            free.append(0)
        bins[i] = b
        free[b] = room = room - need
        if room:
            slots[room].append(b)
            open_at |= 1 << room


def _free(length: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    return capacity - np.bincount(bins, weights=length).astype(np.int64)


def _rank(length: np.ndarray, bins: np.ndarray, capacity: int) -> tuple:
    """Fewer bins are better, then fuller ones."""
    fill = capacity - _free(length, bins, capacity)
    return int(bins.max()) + 1, -float((fill.astype(float) ** 2).sum())


def least_bins(length: np.ndarray, capacity: int) -> int:
    return max(-(-int(length.sum()) // capacity), int((2 * length > capacity).sum()))


def _seed(length: np.ndarray, capacity: int, noise: float, rng: np.random.Generator) -> np.ndarray:
    """Best fit by length, with the order disturbed by noise."""
    bins, free = np.zeros(len(length), dtype=np.int32), []
    if not noise:
        best_fit(length, np.arange(len(length)), bins, free, capacity)
        return bins
    keys = length * (1 + noise * rng.random(len(length)))
    for part in np.array_split(np.argsort(-keys, kind="stable"), 16):
        best_fit(length, part, bins, free, capacity)
    return bins


def replace_items(length: np.ndarray, bins: np.ndarray, free: list[int], displaced: np.ndarray) -> np.ndarray:
    """In each bin with room, puts the displaced item that fills it best in the place of one or two smaller ones. Changes bins
    and free; returns the items now displaced."""
    if not len(displaced) or not free:
        return displaced
    by: dict[int, list[int]] = {}
    some = 0
    for i, n in zip(displaced.tolist(), length[displaced].tolist(), strict=True):
        by.setdefault(n, []).append(i)
        some |= 1 << n
    inside = np.ones(len(bins), dtype=bool)
    inside[displaced] = False
    own = np.flatnonzero(inside & (np.array(free, dtype=np.int64) > 0)[bins])
    own = own[np.argsort(bins[own], kind="stable")]
    cuts = np.flatnonzero(np.diff(bins[own], prepend=-1, append=-1)).tolist()
    for at, to in zip(cuts, cuts[1:], strict=False):
        items = own[at:to].tolist()
        sizes, b = length[own[at:to]].tolist(), int(bins[items[0]])
        out = [(n, (x,)) for x, n in enumerate(sizes)]
        if len(items) <= PAIRED:
            out += [(n + sizes[y], (x, y)) for x, n in enumerate(sizes) for y in range(x)]
        best = (0, 0, ())
        for n, places in out:
            most = (some & (1 << n + free[b] + 1) - 1).bit_length() - 1
            best = max(best, (most - n, most, places))
        gain, n, places = best
        if gain > 0:
            bins[by[n].pop()] = b
            if not by[n]:
                some ^= 1 << n
            free[b] -= gain
            for x in places:
                by.setdefault(sizes[x], []).append(items[x])
                some |= 1 << sizes[x]
    return np.array([i for same in by.values() for i in same], dtype=np.int64)


def cross(length: np.ndarray, giver: np.ndarray, other: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child with well-filled bins of the giver, whole, and what they leave of the other parent."""
    room = _free(length, giver, capacity)
    chosen = (room <= np.quantile(room, 0.5)) & (rng.random(len(room)) < rng.uniform(0.2, 0.8))
    held = chosen[giver]
    broken = np.zeros(int(other.max()) + 1, dtype=bool)
    broken[other[held]] = True
    spare = np.flatnonzero(~broken)
    if len(spare):  # the emptiest of the untouched bins are opened too
        spare_room = _free(length, other, capacity)[spare]
        broken[spare[np.argsort(-spare_room, kind="stable")[:OPENED]]] = True
    displaced = np.flatnonzero(~held & broken[other])
    source = np.where(held, giver, other + len(room))
    kept = np.ones(len(length), dtype=bool)
    kept[displaced] = False
    child = np.zeros(len(length), dtype=np.int32)
    _, child[kept] = np.unique(source[kept], return_inverse=True)
    free = _free(length[kept], child[kept], capacity).tolist() if kept.any() else []
    best_fit(length, replace_items(length, child, free, displaced), child, free, capacity)
    return child


def evolve(length: np.ndarray, population: list[np.ndarray], capacity: int, rng: np.random.Generator, size: int = POPULATION, children: int = CHILDREN, least: int = 0) -> tuple[list[np.ndarray], int, int]:
    """One epoch of an island: (packings, the best first; children; children better than both parents). At least `least`
    children are made."""
    goal, made, better = least_bins(length, capacity), 0, 0
    noise = rng.uniform(0.02, 0.5, size)
    population = [*population, *(_seed(length, capacity, n, rng) for n in noise[len(population) :])]
    ranked = sorted(((_rank(length, b, capacity), i, b) for i, b in enumerate(population)), key=lambda x: x[:2])
    while made < children and len(ranked) > 1 and (made < least or ranked[0][0][0] > goal):
        a, b = rng.choice(len(ranked), 2, replace=False)
        child = cross(length, ranked[a][2], ranked[b][2], capacity, rng)
        rank = _rank(length, child, capacity)
        better += rank < min(ranked[a][0], ranked[b][0])
        made += 1
        ranked.append((rank, len(population) + made, child))
        ranked.sort(key=lambda x: x[:2])
        del ranked[size:]
    return [b for _, _, b in ranked], made, int(better)


def _evolve_rows(capacity: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("islands")
        for batch in batches:
            for row in batch.to_pylist():
                length = np.array(row["lengths"], dtype=np.int64)
                population = [np.frombuffer(p, dtype=np.int32) for p in [*(row["population"] or []), row["migrant"]] if p]
                rng = np.random.default_rng([row["block"], row["island"], epoch])
                population, made, better = evolve(length, population, capacity, rng, least=0 if epoch else LEAST_CHILDREN)
                n_bins, fill = _rank(length, population[0], capacity)
                packed = [b.astype(np.int32).tobytes() for b in population]
                told = {"n_bins": n_bins, "rests": n_bins == least_bins(length, capacity), "fill": fill, "made": (row["made"] or 0) + made, "better": (row["better"] or 0) + better}
                yield pa.RecordBatch.from_pylist([{**{c: row[c] for c in ("block", "island", "lengths")}, "population": packed, **told}], schema=_schema)

    return run


_schema = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("lengths", pa.list_(pa.int32())), ("population", pa.list_(pa.binary())), ("n_bins", pa.int64()), ("rests", pa.bool_()), ("fill", pa.float64()), ("made", pa.int64()), ("better", pa.int64())])
_ddl = "block long, island int, lengths array<int>, population array<binary>, n_bins long, rests boolean, fill double, made long, better long"


def _place(blocks: int):
    """The best packing of a block -> each piece's sequence and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                length = np.array([x["n"] for x in row["own"]], dtype=np.int64)
                bins = np.frombuffer(row["best"], dtype=np.int32)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(length[order])
                first = np.r_[True, bins[order][1:] != bins[order][:-1]]
                begin = (ends - length[order])[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
                offset = np.empty(len(order), dtype=np.int64)
                offset[order] = ends - length[order] - begin
                uid = pa.array([x["uid"] for x in row["own"]], pa.int64())
                yield pa.RecordBatch.from_arrays([uid, pa.array(bins.astype(np.int64) * blocks + row["block"]), pa.array(offset)], ["uid", "sequence_id", "offset"])

    return run


def islands_of(gathered: DataFrame, tasks: int, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS) -> list[DataFrame]:
    """gathered (block, own array of (uid, n)) -> tables of one row for each island, written down after each epoch. Blocks with an
    island at the bound are in no later epoch, as nothing can be better."""
    state = gathered.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("own.n").alias("lengths"))
    state = state.withColumns({"population": F.lit(None).cast("array<binary>"), "migrant": F.lit(None).cast("binary"), "made": F.lit(0), "better": F.lit(0)})
    out = []
    for epoch in range(epochs):
        out.append(materialise(state.repartition(tasks, "block", "island").mapInArrow(_evolve_rows(capacity, epoch), _ddl), "islands"))
        live = out[-1].join(out[-1].where("rests").select("block").distinct(), "block", "left_anti")
        elite = live.select("block", F.expr(f"cast((island + 1) % {islands} as int)").alias("island"), F.col("population")[0].alias("migrant"))
        state = live.drop("n_bins", "rests", "fill").join(elite, ["block", "island"])
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Adds sequence_id and offset to rows that have a `length` of 1 to capacity. Every other column is carried."""
    spark = items.sparkSession
    ship(spark)
    names = [c for c in items.columns if c not in ("sequence_id", "offset")]
    numbered = materialise(items.select(F.struct(*names).alias("item"), F.col("length").cast("int").alias("n"), F.monotonically_increasing_id().alias("uid")), "pieces")
    some = numbered.where(F.col("n") < capacity)
    blocks = max(1, -(-some.count() // block_items))
    block = F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block")
    gathered = materialise(some.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("uid", "n"))).alias("own")), "blocks")
    tasks = min(blocks * islands, TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    states = islands_of(gathered, max(2, tasks), capacity, islands, epochs)
    every = reduce(DataFrame.unionByName, (x.select("block", F.col("population")[0].alias("bins"), F.struct("n_bins", "fill", "island").alias("rank")) for x in states))
    best = every.groupBy("block").agg(F.min_by("bins", "rank").alias("best"))
    where = materialise(gathered.join(best, "block").mapInArrow(_place(blocks), "uid long, sequence_id long, offset long"), "places")
    for done in (*states, gathered):
        release(done)
    shared = some.join(where, "uid").select("item.*", "sequence_id", "offset")
    alone = numbered.where(F.col("n") >= capacity).select("item.*", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(alone)
