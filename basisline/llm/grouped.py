"""Groups of sorted Arrow rows, streamed: no group is split and only the open group is held back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def runs(batches: Iterator[pa.RecordBatch], n_keys: int, least_rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by their first columns, in tables of whole groups, with the groups' bounds."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def bounds(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in range(n_keys):
            col = t.column(c).combine_chunks()
            if t.num_rows > 1:
                new[1:] |= ~np.asarray(pc.equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False), bool)
        return np.append(np.flatnonzero(new), t.num_rows)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= least_rows:
            t = pa.Table.from_batches(held)
            b = bounds(t)
            if len(b) > 2:
                yield t.slice(0, b[-2]), b[:-1]
                held = t.slice(b[-2]).to_batches()
                rows = sum(x.num_rows for x in held)
    if rows:
        t = pa.Table.from_batches(held)
        yield t, bounds(t)
