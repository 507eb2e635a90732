"""Groups of rows in Arrow batches, many groups at once: numpy goes through the first rows of all groups, then the second ones, and so on.

All that runs in a worker is made inside functions, so that it is sent by value and workers need not import this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

#: Rows that are worked on at once, if their last group ends there; a longer group is worked on whole.
ROWS = 1 << 18


def in_groups(rows: DataFrame, keys: list[str], schema, work: Callable, together: bool = False) -> DataFrame:
    """work(table, starts) on tables of whole groups, of which starts has the first rows. together: each key's rows already lie one
    after the other in one partition. A row may hold arrays, all of one length, in columns other than keys: it stands for as
    many rows. Spark weighs its batch anew for every row it sends, so that few long rows are much quicker than many short ones."""
    least = ROWS

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def unpacked(batch):
            lists = [c for c in batch.columns if pa.types.is_list(c.type)]
            if not lists:
                return batch
            at = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(lists[0].offsets.to_numpy())))
            return pa.RecordBatch.from_arrays([c.flatten() if pa.types.is_list(c.type) else c.take(at) for c in batch.columns], batch.schema.names)

        def first_rows(table):
            new = np.zeros(len(table), dtype=bool)
            new[0] = True
            for k in keys:
                codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            return np.flatnonzero(new)

        held, n, wanted = [], 0, least
        for batch in map(unpacked, batches):
            if batch.num_rows == 0:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < wanted:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            starts = first_rows(table)
            cut = int(starts[-1])
            if cut:
                yield from work(table.slice(0, cut).combine_chunks(), starts[:-1]).to_batches()
            held, n = table.slice(cut).to_batches(), n - cut
            wanted = max(least, 2 * n)  # a long group is not looked at again for every batch
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from work(table, first_rows(table)).to_batches()

    if not together:
        rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, schema)


def running_rows() -> Callable:
    """The function (starts, y, reach of each group) -> (new, mean): whether a value, sorted in its group, begins a row, and the mean of its row
    as far as it. A value joins the last row while it lies within reach of its mean. Sums are compensated, as Python's are."""

    def rows(starts, y, reach):
        import numpy as np

        sizes = np.diff(np.append(starts, len(y)))
        order = np.argsort(-sizes, kind="stable")
        first, left, far = starts[order], -sizes[order], reach[order]
        total, lost, n, mean = (np.zeros(len(starts)) for _ in range(4))
        new, means = np.zeros(len(y), dtype=bool), np.empty(len(y))
        for i in range(int(sizes.max(initial=0))):
            m = int(np.searchsorted(left, -i))  # the groups with more than i values
            at = first[:m] + i
            v = y[at]
            fresh = (np.abs(v - mean[:m]) > far[:m]) if i else np.ones(m, dtype=bool)
            s = np.where(fresh, 0.0, total[:m])
            t = s + v
            lost[:m] = np.where(fresh, 0.0, lost[:m] + np.where(np.abs(s) >= np.abs(v), (s - t) + v, (v - t) + s))
            total[:m], n[:m] = t, np.where(fresh, 1.0, n[:m] + 1)
            mean[:m] = (t + np.where(np.isfinite(lost[:m]), lost[:m], 0.0)) / n[:m]
            new[at], means[at] = fresh, mean[:m]
        return new, means

    return rows


def spreading() -> Callable:
    """The function (starts, sizes) -> starts[0], starts[0] + 1, ..., for each of the sizes."""

    def spread(starts, sizes):
        import numpy as np

        ends = np.cumsum(sizes)
        return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)

    return spread
