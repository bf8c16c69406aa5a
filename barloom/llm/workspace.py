"""Memory of Python workers.

Workers live on between tasks and serve one operator after another.  What an operator
keeps there for its next task (caches) is dropped when another operator starts, and
freed memory goes back to the system when a task ends.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import SparkSession

_KEPT: dict[str, Callable[[], None]] = {}


def keep(owner: str, forget: Callable[[], None]) -> None:
    """Say how to drop what ``owner`` keeps in this process."""
    _KEPT[owner] = forget


def claim(owner: str) -> None:
    for other in [k for k in _KEPT if k != owner]:
        _KEPT.pop(other)()


def settle() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(owner: str, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``step`` over the batches of a task, between :func:`claim` and :func:`settle`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        try:
            yield from step(batches)
        finally:
            settle()

    return run


def private(name: str, columns: Iterable[str]) -> str:
    """``name``, or a longer one that none of ``columns`` has in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ship_file(spark: SparkSession, path: str) -> Callable[[], str]:
    """Send a file of the driver to the workers; what is returned gives its path there."""
    name = os.path.basename(path)
    sent = spark.sparkContext.__dict__.setdefault("_barloom_files", {})
    if sent.setdefault(name, path) != path:
        raise ValueError(f"another file named {name} was sent before")
    spark.sparkContext.addFile(path)
    return lambda: SparkFiles.get(name)
