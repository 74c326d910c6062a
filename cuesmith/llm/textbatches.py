"""Small helpers for Arrow functions over texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_bytes(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose UTF-8 bytes sum to limit at most; a longer text is a range of its own."""
    ends = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + limit, "right")) - 1)
        yield a, b
        a = b
