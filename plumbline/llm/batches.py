"""Texts of Arrow batches, a few at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS = 256


def texts_of(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column; only ``ROWS`` of them are copied at once."""
    binary = column.cast(pa.binary())
    for at in range(0, len(binary), ROWS):
        yield from binary.slice(at, ROWS).to_pylist()
