"""Batches of texts for Python workers: their size, and memory given back as tasks end."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES``
    bytes, the same for every operator: the memory of a worker follows the batch, and the
    default of 10,000 rows is made for short ones. One longer text is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Returns freed memory to the machine. Workers live on for the next stage, and what Arrow's
    pool and the C library keep of one task's peak would else lie idle beside the next operator's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives memory back as its task ends."""

    @functools.wraps(run)
    def ended(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return ended
