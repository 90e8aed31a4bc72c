"""Running Python over Arrow batches of (id, text)."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ship

SLICE = 256


def give_back() -> None:
    """Return what the worker has freed to the system: it waits for its next task in memory that others need."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def texts(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[list]]:
    """The named columns as lists, a few hundred rows at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            part = batch.slice(k, SLICE)
            yield [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]
    give_back()


def map_texts(docs: DataFrame, id_col: str, text_col: str, schema: str, fields: pa.Schema,
              make: Callable[[], Callable[[list, list], dict]], carry: str | None = None) -> DataFrame:
    """Map slices of (ids, texts) to columns of schema. make() runs once a task, on the executor. The column `carry`, a struct of a row, is
    handed through as it is, after the others; then the text is that column's field text_col."""
    ship(docs.sparkSession)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(carry).alias("row") if carry else F.col(text_col).alias("text"))

    def run(batches):
        work = make()
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                row = part.column(1)
                out = work(part.column(0).to_pylist(), (pc.struct_field(row, text_col) if carry else row).to_pylist())
                made = [pa.array(out[f.name], f.type) for f in fields]
                yield pa.RecordBatch.from_arrays(made + ([row] if carry else []), names=[*fields.names, *([carry] if carry else [])])
        give_back()

    if carry:
        return chosen.mapInArrow(run, T.StructType.fromDDL(schema).add(T.StructField(carry, docs.schema[carry].dataType)))
    return chosen.mapInArrow(run, schema)
