"""Byte-level BPE encoding and decoding (operator 2): overlapping chunk encoding.

Every text is cut into chunks that overlap; a short one is a single chunk. Chunks are pre-tokenised apart. A pre-token
depends only on what follows its start, so once two neighbouring chunks share one boundary inside their overlap they
agree from there on: the first shared boundary is where they are stitched. The last two boundaries of a chunk are not
used, since what the chunk cuts off may have changed them. Where an overlap holds no shared boundary (one pre-token longer
than the overlap) the next chunks are joined to the piece, twice as many each time, and it is pre-tokenised again: the
boundaries of a chunk that has not been stitched yet are never trusted. The pieces between the cuts are encoded
apart and their ids concatenated.

Texts of up to `spread_chars` characters are chunked, stitched and encoded where they lie, without a shuffle. The chunks of
longer ones are dealt over the cluster, and so are their pieces; only cuts, a few numbers for each chunk, meet again
in between. One of these with a chunk that cannot be stitched is encoded where it lies.

Defined results: null or empty text gives an empty id list; a text of any length is read whole; each input row gives one
row, so repeated rows and repeated ids are kept; a null id stays null; other input columns are not carried; an empty
table gives an empty table. There are no ties.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm._common import enter, keeps, materialise, plain_text, ship

CHUNK_CHARS, OVERLAP_CHARS, SPREAD_CHARS = 4096, 256, 1 << 20

_encoders: dict[str, object] = {}
keeps("byte_bpe", _encoders.clear)


def load_ranks(ranks_path: str) -> dict[bytes, int]:
    """The vocabulary file: one base64 token and its rank on each line."""
    with open(ranks_path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def encoder(ranks_path: str, pattern: str):
    """One tiktoken encoder for each worker process."""
    import tiktoken

    key = f"{ranks_path}\n{pattern}"
    if key not in _encoders:
        _encoders[key] = tiktoken.Encoding("stemma", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
    return _encoders[key]


def _id_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def chunk_starts(find, chunk: str, cut_off: bool) -> np.ndarray:
    """Where pre-tokens of a chunk start; without the last two if the text goes on after it, which may change them."""
    starts = np.fromiter((m.start() for m in find(chunk)), dtype=np.int64)
    return starts[:-2] if cut_off else starts


def stitch(find, text: str, chunk_chars: int, overlap: int) -> list[int]:
    """Where a text is cut into pieces: boundaries of pre-tokens, the text's two ends among them."""

    def starts(at: int, to: int) -> np.ndarray:
        return at + chunk_starts(find, text[at:to], to < len(text))

    cuts, n, at, joined = [0], -(-len(text) // chunk_chars), 1, 1
    known = starts(0, chunk_chars + overlap)  # of the piece so far; what of it lies in the next overlap is true
    while at < n:
        begin = at * chunk_chars
        own = starts(begin, begin + chunk_chars + overlap)
        both = np.intersect1d(known[known >= begin], own[own < begin + overlap])
        if len(both):
            cuts.append(int(both[0]))
            known, at, joined = own, at + 1, 1
        else:
            at, joined = min(n, at + joined), 2 * joined
            known = starts(cuts[-1], at * chunk_chars + overlap)
    return [*cuts, len(text)]


def _encode_rows(ranks_path: str, pattern: str, text: str, ids: str, chunk_chars: int, overlap: int):
    """Replaces the text column, which comes last, by the token ids. A longer text is stitched from chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        enter("byte_bpe")
        enc, find = encoder(ranks_path, pattern), regex.compile(pattern).finditer

        def whole(t: str) -> np.ndarray:
            if len(t) <= chunk_chars:
                return np.asarray(enc.encode_to_numpy(t, disallowed_special=()))
            cuts = stitch(find, t, chunk_chars, overlap)
            return np.concatenate([enc.encode_to_numpy(t[a:b], disallowed_special=()) for a, b in zip(cuts, cuts[1:], strict=False)])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = _id_lists(list(map(whole, part.column(text).to_pylist())))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != text), lists], [*(c for c in part.schema.names if c != text), ids])

    return run


def _slices(kept: list[str], ends):
    """The text column t -> its slices, numbered, with the columns kept of each. ends gives a row's (start, end) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                text = row.column("t")[0].as_py()
                pairs = ends(row, len(text))
                for at in range(0, len(pairs), 256):
                    some = pairs[at : at + 256]
                    same = pa.array(np.zeros(len(some), np.int64))
                    no = pa.array(range(at, at + len(some)), pa.int32())
                    yield pa.RecordBatch.from_arrays([*(row.column(c).take(same) for c in kept), no, pa.array([text[a:b] for a, b in some], pa.string())], [*kept, "no", "t"])

    return run


def _boundaries(pattern: str, chunk_chars: int, overlap: int):
    """Replaces a chunk by the pre-token starts inside its first `overlap` characters, and inside the overlap with
    the next chunk, both counted from the start of the later chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).finditer
        for batch in batches:
            starts = [chunk_starts(find, t, len(t) == chunk_chars + overlap) for t in batch.column("t").to_pylist()]
            head = _id_lists([s[s < overlap] for s in starts])
            tail = _id_lists([s[s >= chunk_chars] - chunk_chars for s in starts])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("no"), head, tail], ["row", "no", "head", "tail"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """Token ids of every whole text: (id_col, ids array<int>). The overlap must not exceed a chunk."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    here = _encode_rows(ranks_path, pattern, "t", "ids", chunk_chars, overlap_chars)
    rows = docs.select(F.col(id_col).alias("k"), plain_text(text_col).alias("t"))
    fits = F.length("t") <= max(spread_chars, chunk_chars)
    short = rows.where(fits).mapInArrow(here, f"k {kind}, ids array<int>")
    # Written down, as the numbers of its rows must stay.
    long = materialise(rows.where(~fits).withColumn("row", F.monotonically_increasing_id()), "long")

    def chunk_ends(_, n: int) -> list[tuple[int, int]]:
        return [(at, min(n, at + chunk_chars + overlap_chars)) for at in range(0, n, chunk_chars)]

    def piece_ends(row: pa.RecordBatch, n: int) -> list[tuple[int, int]]:
        cuts = [0, *row.column("cuts")[0].as_py(), n]
        return list(zip(cuts, cuts[1:], strict=False))

    chunks = long.select("row", "t").mapInArrow(_slices(["row"], chunk_ends), "row long, no int, t string").repartition("row", "no")
    marked = chunks.mapInArrow(_boundaries(pattern, chunk_chars, overlap_chars), "row long, no int, head array<int>, tail array<int>")
    # The cuts of a text, by chunk: null where one cannot be stitched to the next.
    met = marked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("no", "head", "tail"))).alias("c"))
    first = f"transform(sequence(1, size(c) - 1), i -> c[i].no * {chunk_chars} + array_min(array_intersect(c[i - 1].tail, c[i].head)))"
    cut = long.join(met.select("row", F.expr(first).alias("cuts")), "row").withColumn("whole", F.forall("cuts", lambda x: x.isNotNull()))
    alone = cut.where("not whole").select("k", "t").mapInArrow(here, f"k {kind}, ids array<int>")
    pieces = cut.where("whole").select("row", "k", "cuts", "t").mapInArrow(_slices(["row", "k"], piece_ends), f"row long, k {kind}, no int, t string").repartition("row", "no")
    encoded = pieces.mapInArrow(here, f"row long, k {kind}, no int, ids array<int>")
    spread = encoded.groupBy("row", "k").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts")).select("k", F.flatten("parts.ids").alias("ids"))
    return short.unionByName(alone).unionByName(spread).select(F.col("k").alias(id_col), "ids")


def decode(tokens: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """Adds the raw bytes that the ids stand for, concatenated. A null list gives null; an unknown id fails."""
    ship(tokens.sparkSession)
    kept = [f for f in tokens.schema if keep_ids or f.name != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        size = max(ranks.values()) + 1
        length = np.full(size, -1, dtype=np.int64)
        for token, rank in ranks.items():
            length[rank] = len(token)
        begin = np.concatenate([[0], np.cumsum(np.maximum(length, 0))[:-1]])
        pool = np.zeros(int(np.maximum(length, 0).sum()), dtype=np.uint8)
        for token, rank in ranks.items():
            pool[begin[rank] : begin[rank] + len(token)] = np.frombuffer(token, np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for ids in part.column(ids_col):
                    if not ids.is_valid:
                        out.append(None)
                        continue
                    own = ids.values.to_numpy(zero_copy_only=False)
                    n = length[own]
                    if (n < 0).any():
                        raise ValueError("an id is not in the vocabulary")
                    ends = np.cumsum(n)
                    take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[own] - (ends - n), n)
                    out.append(pool[take].tobytes())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(out, pa.binary())], [*(f.name for f in kept), out_col])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return tokens.mapInArrow(run, f"{kinds}, `{out_col}` binary")
