"""Arrow columns made by Python functions, with few Python objects at a time."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

#: Characters of texts whose results are Python objects at the same time; one longer text is a slice of its own.
SLICE_CHARS = 1_000_000


def mapped(texts: pa.Array, make: Callable[[str], object], kind: pa.DataType, most: int = SLICE_CHARS) -> pa.Array:
    """``make`` of each text. A batch may hold 10,000 texts, so neither they nor their results become Python objects all at once."""
    done, rows, chars = [], [], 0
    for scalar in texts:
        text = scalar.as_py() or ""
        rows.append(make(text))
        chars += len(text)
        if chars >= most:
            done.append(pa.array(rows, kind))
            rows, chars = [], 0
    return pa.concat_arrays([*done, pa.array(rows, kind)])
