"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

SLICE_BYTES = 1 << 20


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it (column names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str):
    """The column called exactly `name`, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of about `limit` bytes, so that work on a batch takes bounded memory."""
    pa.set_memory_pool(pa.system_memory_pool())  # gives freed blocks back, which a worker's next task may need
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield texts.slice(begin, i - begin)
            begin, held = i, 0
        held += int(size)
    if begin < len(texts):
        yield texts.slice(begin)


def utf8(texts: pa.Array) -> list[bytes]:
    """The texts' bytes; a null is an empty text."""
    return pc.fill_null(texts, "").cast(pa.binary()).to_pylist()
