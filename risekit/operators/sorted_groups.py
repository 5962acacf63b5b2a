"""Groups out of the sorted batches of a partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.Table]:
    """Tables of many groups each, none of which goes on in the next one; a group is rows with equal values, not null, of the first columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        end = [batch.column(k)[-1] for k in range(keys)]
        other = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            other |= pc.not_equal(batch.column(k), end[k]).to_numpy(zero_copy_only=False)
        own = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0  # the last group may go on in the next batch
        if held and (own or any(held[0].column(k)[0] != end[k] for k in range(keys))):
            yield pa.Table.from_batches([*held, batch.slice(0, own)])
            held = []
        elif own:
            yield pa.Table.from_batches([batch.slice(0, own)])
        held.append(batch.slice(own))
    if held:
        yield pa.Table.from_batches(held)
