"""Approximate nearest neighbours by inner product (operator 5): one small-world graph for each shard.

Rows are dealt into shards by hash, as many as there are cores while each has LEAST_ROWS rows, and never of more than
SHARD_ROWS rows on average. Vectors of another length are another set of shards, as only vectors of one length have an inner
product. Inside a shard equal vectors become one node that keeps the smallest k + 1 ids (no more of them can be among k
results). Vectors get one more component that gives all of them the same length, so the nearest in Euclidean distance
has the largest inner product. Each node has a random highest level. Nodes are inserted in random order, a batch at
a time: a search of the graph so far, and the others of the batch, give a node's candidates at each of its levels; its own
links are chosen from these, dropping one that lies closer to a link already chosen; the nearest of those that link
to a node are linked back. A graph is stored as flat arrays. Queries come in blocks to each shard of their length, walk
greedily down the levels and search level 0 with a beam, all queries of a block in step. Shard results are scored
exactly in double precision and merged.

Every query goes to every shard: with N vectors, N / every queries and N / SHARD_ROWS shards, which is the method's own
fan-out. At 10^9 vectors of 64 floats and one query in 20 that is 7,630 shards.

Defined results: a vector that is null, zero, or holds a null, NaN or infinity takes no part, neither as query nor as
candidate. An id names a row: candidates are all rows whose id is not the query's, repeated ids are candidates each, a
repeated id with one vector is one query. Ties go to the smaller id. A null id takes no part. Other input columns are
not carried; an empty table, or no query, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm._common import materialise, release, ship

SHARD_ROWS, LEAST_ROWS = 131_072, 8192
#: Links that a node chooses and that are kept back (each), beams of insertion and of search, nodes inserted at once.
LINKS, BUILD_BEAM, BEAM, BATCH = 32, 96, 256, 256
#: Nodes of the beam whose links are looked at together.
STEP = 4
QUERY_BLOCK = 256


def _choose(distance: np.ndarray, between: np.ndarray, most: int) -> np.ndarray:
    """Which of a row's candidates, nearest first, become links: those not closer to a chosen one than to the node, then
    the nearest others."""
    real = np.isfinite(distance)
    keep = np.zeros(distance.shape, dtype=bool)
    for c in range(distance.shape[1]):
        blocked = (keep & (between[:, c, :] < distance[:, c, None])).any(1)
        keep[:, c] = ~blocked & real[:, c] & (keep.sum(1) < most)
    spare = most - keep.sum(1)
    rest = real & ~keep
    return keep | (rest & (np.cumsum(rest, axis=1) <= spare[:, None]))


class Layer:
    """One level. Its nodes have numbers in order of insertion; `nodes` are their numbers on level 0."""

    def __init__(self, vectors: np.ndarray, nodes: np.ndarray, links: np.ndarray):
        self.v, self.nodes, self.links = vectors, nodes, links
        self.square = (vectors * vectors).sum(1)

    @classmethod
    def empty(cls, vectors: np.ndarray, nodes: np.ndarray, links: int) -> Layer:
        """A node without links has itself in their places: chosen ones first, then those back."""
        layer = cls(vectors, nodes, np.repeat(np.arange(len(nodes), dtype=np.int32)[:, None], 2 * links, 1))
        layer.far = np.full((len(nodes), links), np.inf, np.float32)
        return layer

    def search(self, q: np.ndarray, start: np.ndarray, beam: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, squared distances) of each query's beam among the first `size` nodes, nearest first; -1 where there are
        fewer."""
        m, beam = len(q), min(beam, size)
        own = (q * q).sum(1)
        node, dist = np.full((m, beam), -1, np.int32), np.full((m, beam), np.inf, np.float32)
        done, seen = np.ones((m, beam), dtype=bool), np.zeros((m, size), dtype=bool)
        node[:, 0], done[:, 0] = start, False
        dist[:, 0] = own + self.square[start] - 2 * np.einsum("qd,qd->q", q, self.v[start])
        seen[np.arange(m), start] = True
        live = np.arange(m)
        while True:
            key = np.where(done[live], np.inf, dist[live])
            pick = np.argpartition(key, STEP - 1, axis=1)[:, :STEP] if beam > STEP else np.argsort(key, axis=1)
            real = np.isfinite(np.take_along_axis(key, pick, 1))
            go = real.any(1)
            live, pick, real = live[go], pick[go], real[go]
            if not len(live):
                return node, dist
            done[live[:, None], pick] = True
            row, col = np.nonzero(real)
            near = self.links[node[live[row], pick[row, col]]]
            row, near = np.repeat(row, near.shape[1]), near.ravel()
            fresh = ~seen[live[row], near]
            pair = np.unique(row[fresh].astype(np.int64) * size + near[fresh])
            row, near = pair // size, (pair % size).astype(np.int32)
            seen[live[row], near] = True
            d = own[live[row]] + self.square[near] - 2 * np.einsum("rd,rd->r", q[live[row]], self.v[near])
            better = d < dist[live[row], -1]
            row, near, d = row[better], near[better], d[better]
            if not len(row):
                continue
            count = np.bincount(row, minlength=len(live))
            hit = np.flatnonzero(count)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            new_d, new_n = np.full((len(live), count.max()), np.inf, np.float32), np.full((len(live), count.max()), -1, np.int32)
            new_d[row, place], new_n[row, place] = d, near
            own_rows = live[hit]
            all_d, all_n = np.hstack([dist[own_rows], new_d[hit]]), np.hstack([node[own_rows], new_n[hit]])
            all_done = np.hstack([done[own_rows], ~np.isfinite(new_d[hit])])
            order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[own_rows] = np.take_along_axis(all_d, order, 1)
            node[own_rows] = np.take_along_axis(all_n, order, 1)
            done[own_rows] = np.take_along_axis(all_done, order, 1)

    def insert(self, at: int, to: int, start: np.ndarray, beam: int) -> None:
        """Links the nodes from `at` to `to` with those before them and with each other."""
        q, m, links = self.v[at:to], to - at, self.far.shape[1]
        if at:
            near, d = self.search(q, start, beam, at)
        else:
            near, d = np.zeros((m, 0), np.int32), np.zeros((m, 0), np.float32)
        if others := min(links, m - 1):
            inner = self.square[at:to, None] + self.square[None, at:to] - 2 * q @ q.T
            inner[np.arange(m), np.arange(m)] = np.inf
            closest = np.argpartition(inner, others - 1, axis=1)[:, :others]
            near = np.hstack([near, (closest + at).astype(np.int32)])
            d = np.hstack([d, np.take_along_axis(inner, closest, 1)])
        if not near.shape[1]:
            return
        d = np.where(near >= 0, d, np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        near, d = np.maximum(np.take_along_axis(near, order, 1), 0), np.take_along_axis(d, order, 1)
        x, square = self.v[near], self.square[near]
        keep = _choose(d, square[:, :, None] + square[:, None, :] - 2 * (x @ x.transpose(0, 2, 1)), links)
        row, col = np.nonzero(keep)
        target, far = near[row, col], d[row, col].astype(np.float32)
        n = keep.sum(1)
        self.links[at + row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = target
        touched = np.unique(target)
        row_t, col_t = np.nonzero(np.isfinite(self.far[touched]))
        to_ = np.concatenate([touched[row_t], target])
        source = np.concatenate([self.links[touched[row_t], links + col_t], at + row])
        far = np.concatenate([self.far[touched[row_t], col_t], far])
        order = np.lexsort((far, to_))
        to_, source, far = to_[order], source[order], far[order]
        place = np.arange(len(to_)) - np.searchsorted(to_, to_)
        fits = place < links
        self.links[to_[fits], links + place[fits]] = source[fits]
        self.far[to_[fits], place[fits]] = far[fits]


def _descend(layers: list[Layer], q: np.ndarray, sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Greedy walk from the top: (where the queries are on each level, the start on level 0). Levels without nodes are passed over."""
    start, places = np.zeros(len(q), dtype=np.int64), [np.zeros(len(q), dtype=np.int64) for _ in layers]
    for height in range(len(layers) - 1, 0, -1):
        if sizes[height]:
            found, _ = layers[height].search(q, start, 1, sizes[height])
            places[height] = found[:, 0]
            start = np.searchsorted(layers[height - 1].nodes, layers[height].nodes[found[:, 0]])
    return places, start


def build(vectors: np.ndarray, seed: int, links: int = LINKS, beam: int = BUILD_BEAM, batch: int = BATCH) -> tuple[np.ndarray, list[Layer]]:
    """(order of insertion, levels from 0 up). vectors are of one length."""
    rng, n = np.random.default_rng(seed), len(vectors)
    order = rng.permutation(n)
    level = np.floor(-np.log(1 - rng.random(n)) / np.log(2 * links)).astype(int)
    layers = []
    for height in range(level.max(initial=0) + 1):
        nodes = np.flatnonzero(level >= height)
        layers.append(Layer.empty(vectors[order[nodes]], nodes, links))
    at = 0
    while at < n:
        to = min(n, at + min(batch, max(1, at)))
        sizes = [int(np.searchsorted(x.nodes, at)) for x in layers]
        ends = [int(np.searchsorted(x.nodes, to)) for x in layers]
        places, start = _descend(layers, layers[0].v[at:to], sizes)
        places[0] = start
        for layer, a, b, place in zip(layers, sizes, ends, places, strict=True):
            if b > a:
                layer.insert(a, b, place[layer.nodes[a:b] - at], beam)
        at = to
    return order, layers


def search(layers: list[Layer], queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """The beam of each query: node numbers in order of insertion, nearest first, -1 where there are fewer."""
    sizes = [len(x.nodes) for x in layers]
    return layers[0].search(queries, _descend(layers, queries, sizes)[1], beam, sizes[0])[0]


def augmented(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """(vectors scaled to numbers near 1, with the component that makes them equally long, as floats; the scale)."""
    scale = float(np.abs(vectors).max(initial=0)) or 1.0
    v = vectors.astype(np.float64) / scale
    square = (v * v).sum(1)
    return np.hstack([v, np.sqrt(np.maximum(square.max(initial=0) - square, 0))[:, None]]).astype(np.float32), scale


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


_index_schema = pa.schema([("shard", pa.int64()), ("vectors", pa.binary()), ("first", pa.binary()), ("ids", pa.binary()), ("level_nodes", pa.list_(pa.binary())), ("level_links", pa.list_(pa.binary()))])
_index_ddl = "shard long, vectors binary, first binary, ids binary, level_nodes array<binary>, level_links array<binary>"


def _build_rows(copies: int):
    """Rows (shard, id, v), sorted by shard and id -> one row for each shard, with vectors in order of insertion."""

    def graph(shard: int, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        distinct, which = np.unique(v, axis=0, return_inverse=True)
        order, layers = build(augmented(distinct)[0], shard & 0xFFFFFFFF)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        node = place[which.ravel()]
        by = np.lexsort((ids, node))
        begin = np.searchsorted(node[by], np.arange(len(distinct)))
        kept = by[np.arange(len(ids)) - begin[node[by]] < copies]  # ids of equal vectors, smallest first
        starts = np.r_[0, np.cumsum(np.minimum(np.bincount(node), copies))].astype(np.int64)
        row = {"shard": shard, "vectors": _bytes(distinct[order]), "first": _bytes(starts), "ids": _bytes(ids[kept])}
        row |= {"level_nodes": [_bytes(x.nodes) for x in layers], "level_links": [_bytes(x.links) for x in layers]}
        return pa.RecordBatch.from_pylist([row], schema=_index_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None
        for batch in batches:
            shard, ids = batch.column("shard").to_numpy(), batch.column("id").to_numpy()
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]).tolist() if len(shard) else []
            for at, to in zip(cuts, [*cuts[1:], len(shard)], strict=True):
                if held and shard[at] != now:
                    yield graph(now, *(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                now = int(shard[at])
                v = batch.column("v").slice(at, to - at).flatten().to_numpy(zero_copy_only=False)
                held.append((ids[at:to], v.reshape(to - at, -1)))
        if held:
            yield graph(now, *(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, size) of the rows that take part; v keeps doubles as doubles."""
    exact = "double" if vectors.schema[vector_col].dataType.elementType.simpleString() not in ("float", "tinyint", "smallint") else "float"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{exact}>").alias("v")).where("id is not null and size(v) > 0")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    return rows.withColumn("size", F.size("v"))


def _shards(valid: DataFrame, shard_rows: int) -> DataFrame:
    """(size, shards): how many shards the vectors of a length have."""
    cores = valid.sparkSession.sparkContext.defaultParallelism
    n = F.col("count")
    spread = F.least(F.lit(cores), F.ceil(n / min(LEAST_ROWS, shard_rows)))
    return valid.groupBy("size").count().select("size", F.greatest(F.ceil(n / shard_rows), spread).cast("long").alias("shards"))


#: Number of a length's shard among all.
_SHARD = "size * 4294967296L + "


def build_index(valid: DataFrame, shards: DataFrame, k: int = 20) -> DataFrame:
    """One row for each shard: its distinct vectors, their ids, and the graph's levels as flat arrays."""
    ship(valid.sparkSession)
    tasks = 2 * (shards.agg(F.sum("shards")).first()[0] or 1)
    dealt = valid.join(shards, "size").select(F.expr(_SHARD + "pmod(xxhash64(id), shards)").alias("shard"), "id", "v")
    dealt = dealt.repartition(tasks, "shard").sortWithinPartitions("shard", "id")
    return dealt.mapInArrow(_build_rows(k + 1), _index_ddl)


def _search_rows(k: int, kind: type):
    """A shard's graph, then blocks of queries -> the shard's results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers = vectors = starts = ids = scale = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["qids"] is None:
                    starts, ids = np.frombuffer(row["first"], np.int64), np.frombuffer(row["ids"], np.int64)
                    vectors = np.frombuffer(row["vectors"], kind).reshape(len(starts) - 1, -1)
                    level, scale = augmented(vectors)
                    nodes = [np.frombuffer(a, np.int64) for a in row["level_nodes"]]
                    layers = [Layer(level[a], a, np.frombuffer(b, np.int32).reshape(len(a), -1)) for a, b in zip(nodes, row["level_links"], strict=True)]
                    continue
                qids = np.array(row["qids"], dtype=np.int64)
                q = np.array(row["qvs"], dtype=np.float64).reshape(len(qids), -1)
                at = np.hstack([q / scale, np.zeros((len(q), 1))]).astype(np.float32)
                node = search(layers, at)
                line, col = np.nonzero(node >= 0)
                own = node[line, col]
                exact = np.einsum("id,id->i", q[line], vectors[own].astype(np.float64))
                copies = starts[own + 1] - starts[own]
                line, exact = np.repeat(line, copies), np.repeat(exact, copies)
                found = ids[np.arange(len(line)) - np.repeat(np.cumsum(copies) - copies, copies) + np.repeat(starts[own], copies)]
                other = found != qids[line]
                line, exact, found = line[other], exact[other], found[other]
                order = np.lexsort((found, -exact, line))
                line, exact, found = line[order], exact[order], found[order]
                place = np.arange(len(line)) - np.searchsorted(line, np.arange(len(qids)))[line]
                best = place < k
                query = np.full(best.sum(), row["block"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(line[best]), pa.array(qids[line[best]]), pa.array(found[best]), pa.array(exact[best])], ["block", "line", "query_id", "found", "score"])

    return run


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id_col, score) of the k nearest rows of every row whose id is divisible by `every`."""
    ship(vectors.sparkSession)
    valid = materialise(_valid(vectors, id_col, vector_col), "vectors")
    kind = np.float64 if valid.schema["v"].dataType.elementType.simpleString() == "double" else np.float32
    shards = materialise(_shards(valid, shard_rows), "shards")
    index = materialise(build_index(valid, shards, k), "index")
    tasks = 2 * (shards.agg(F.sum("shards")).first()[0] or 1)
    asked = valid.where(F.pmod("id", F.lit(every)) == 0).dropDuplicates()
    n_blocks = max(1, -(-asked.count() // query_block))
    blocks = asked.groupBy("size", F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(n_blocks)).alias("block")).agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("q"))
    blocks = blocks.select("size", "block", F.col("q.id").alias("qids"), F.flatten("q.v").alias("qvs"))
    sent = blocks.join(shards, "size").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("s"))
    sent = sent.select(F.expr(_SHARD + "s").alias("shard"), (F.col("size") * F.lit(n_blocks).cast("long") + F.col("block")).alias("block"), "qids", "qvs")
    both = index.unionByName(sent, allowMissingColumns=True)
    both = both.repartition(tasks, "shard").sortWithinPartitions("shard", F.col("block").asc_nulls_first())
    found = both.mapInArrow(_search_rows(k, kind), "block long, line long, query_id long, found long, score double")
    order = Window.partitionBy("block", "line", "query_id").orderBy(F.desc("score"), "found")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = materialise(ranked.select("query_id", "rank", F.col("found").alias(id_col), "score"), "nearest")
    for done in (valid, shards, index):
        release(done)
    return out
