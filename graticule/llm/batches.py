"""Arrow batches in small pieces, so a worker never holds all texts of a batch as Python objects."""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

ROWS = 512


def pieces(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
