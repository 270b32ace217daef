"""Arrow batches cut by the bytes of what they hold, for tasks in Python."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Bytes of a batch that a task turns into Python objects at a time.
SLICE_BYTES = 4 << 20


def sliced(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch in halves until they hold about ``limit`` bytes, or one row. Free memory is given back at the end, as Python
    workers live on."""
    try:
        for batch in batches:
            waiting = [batch]
            while waiting:
                part = waiting.pop()
                if part.num_rows > 1 and part.nbytes > limit:
                    middle = part.num_rows // 2
                    waiting += [part.slice(middle), part.slice(0, middle)]
                elif part.num_rows:
                    yield part
    finally:
        pa.default_memory_pool().release_unused()
