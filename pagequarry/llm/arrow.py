"""Arrow and naming helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text one numpy step works on; a longer single text is one step of its own.
STEP_BYTES = 4 << 20

#: Bytes of the batches that Spark hands to a Python worker, a single longer row aside.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches of the session by bytes as well as by rows: ten thousand long texts in one batch
    would stand in the memory of the JVM and of the worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the offsets of the texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def slices(batches: Iterator[pa.RecordBatch], columns: list[str], limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``limit`` bytes in the text ``columns``, or of one row, so that what
    is made of a part does not depend on how many long texts a batch has."""
    for batch in batches:
        offsets = np.zeros(batch.num_rows + 1, np.int64)
        for name in columns:
            sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
            offsets[1:] += np.cumsum(sizes)
        for first, last in steps(offsets, limit):
            yield batch.slice(first, last - first)
        # The worker lives on for other stages; what Arrow keeps for itself goes back.
        pa.default_memory_pool().release_unused()
