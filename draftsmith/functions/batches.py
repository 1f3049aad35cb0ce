"""Bounded runs of rows inside a Python worker.

Spark hands a worker up to 10,000 rows or 64 MB at once
(``spark.sql.execution.arrow.maxRecordsPerBatch``, ``maxBytesPerBatch``).  What is
made of a row can be many times its size, so it is made and sent on by runs of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np


def runs(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """``(first row, number of rows)`` of consecutive runs, which hold all rows once,
    each of ``most`` in size at most; a larger row is a run of its own."""
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        n = max(1, int(np.searchsorted(ends, before + most, side="right")) - first)
        yield first, n
        first += n
