"""Groups of consecutive rows in a stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


#: Bytes of runs that are taken together, beyond a run of more.
BYTES = 32 << 20


def consecutive(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run that is alike in the first `keys` columns (integers, not null), of a stream sorted by them; no more than one run and one batch are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(keys)]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1 if batch.num_rows > 1 else np.zeros(0, int)
        if held and any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        ends = [0, *cut.tolist(), batch.num_rows]
        for a, b in zip(ends[:-2], ends[1:-1], strict=True):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(ends[-2], ends[-1] - ends[-2]))
    if held:
        yield pa.Table.from_batches(held)


def several(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs, as many as make up `rows` rows or BYTES, in one table, with the number of each row's run in it."""
    rest: list[pa.RecordBatch] = []
    for batch in (b for b in batches if b.num_rows):
        rest.append(batch)
        if sum(b.num_rows for b in rest) < rows and sum(b.nbytes for b in rest) < BYTES:
            continue
        whole = pa.Table.from_batches(rest).combine_chunks()
        number = _numbered(whole, keys)
        last = int(np.searchsorted(number, number[-1]))
        if last:
            yield whole.slice(0, last), number[:last]
            rest = whole.slice(last).to_batches()
    if rest:
        whole = pa.Table.from_batches(rest).combine_chunks()
        yield whole, _numbered(whole, keys)


def _numbered(rows: pa.Table, keys: int) -> np.ndarray:
    """The number of each row's run, from 0."""
    cols = [np.asarray(rows.column(i)) for i in range(keys)]
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.concatenate([[0], np.cumsum(new)])
