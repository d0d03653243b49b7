"""Sorted groups inside an Arrow stream."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Tasks get this module by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from sorted rows whose ``starts`` marks each group's first row.

    A group is never split. Holds one group and one batch at most.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("starts").to_numpy(zero_copy_only=False))
        if not len(starts):
            held.append(batch)
            continue
        held.append(batch.slice(0, starts[-1]))
        whole = pa.Table.from_batches(held)
        if whole.num_rows:
            yield whole
        held = [batch.slice(starts[-1])]
    if held:
        yield pa.Table.from_batches(held)
