"""Texts through Python in groups of bounded size, beside the columns that are carried along."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts are taken together up to so many bytes.
GROUP_BYTES = 2 << 20
#: Rows of a batch that are made Python objects at a time.
ROWS = 256

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it


def release() -> None:
    """Gives free memory back to the system: Arrow and the allocator keep what a batch took, and a worker that waits for its next task holds it all the while."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def text_groups(column: pa.Array, most: int = GROUP_BYTES) -> Iterator[list[bytes]]:
    """The texts of an Arrow column as UTF-8, null as empty, in groups of bounded size (one text at least)."""
    group, size = [], 0
    for at in range(0, len(column), ROWS):  # else all texts of a batch are held twice
        for value in column.slice(at, ROWS).cast(pa.binary()).to_pylist():
            value = value or b""
            if group and size + len(value) > most:
                yield group
                group, size = [], 0
            group.append(value)
            size += len(value)
    if group:
        yield group


def map_texts(docs: DataFrame, text_col: str, carry: list[str], added: str, start: Callable[[], Callable[[list[bytes]], list[pa.Array]]], most: int = GROUP_BYTES) -> DataFrame:
    """The columns ``carry`` of ``docs`` and the columns ``added`` (a schema), one row for each row.

    ``start`` is called in each partition and gives a function from a group of texts (``most`` bytes) to the added columns.
    Rows keep their partition and order; nothing is shuffled. Texts that are carried go to Python once; memory is released after each batch.
    """
    columns = list(dict.fromkeys((text_col, *carry)))
    places = [columns.index(c) for c in carry]
    schema = T.StructType([*(docs.schema[c] for c in carry), *T.StructType.fromDDL(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            at = 0
            for group in text_groups(batch.column(0), most):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(group)) for k in places), *make(group)], schema.names)
                at += len(group)
            batch = group = None
            release()

    return docs.select(*columns).mapInArrow(run, schema)
