"""Arrow batches in and out of tasks, cut so that a batch stays small in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of text that are worked on at a time; a longer single text is one slice.
SLICE_BYTES = 4 << 20

Columns = Callable[[pa.RecordBatch], list]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``limit`` bytes of one column."""
    values = batch.column(column)
    if pa.types.is_list(values.type):
        sizes = pc.multiply(pc.list_value_length(values), 4)
    else:
        sizes = pc.binary_length(values)
    sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def strings(column: pa.Array) -> list[str]:
    """Texts of a column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def rows_to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def own_columns(df: DataFrame, replaced: set[str]) -> tuple[list[str], Column]:
    """The caller's columns but those with names in ``replaced``, and all of them as one column.

    Packed into one, they meet no other name on their way.
    """
    kept = [c for c in df.columns if c.lower() not in replaced]
    return kept, F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("none"))


def append_columns(
    df: DataFrame, source: str, ddl: str, make: Callable[[], Columns], drop: tuple[str, ...] = ()
) -> DataFrame:
    """Add columns that are computed from slices of batches in Python.

    ``make`` is called once per task and returns a function from a slice to
    the new columns.  Other columns pass through, except those in ``drop`` and
    those named like a new one.
    """
    added = T.StructType.fromDDL(ddl)
    gone = {f.name.lower() for f in added} | {d.lower() for d in drop}
    kept = [f for f in df.schema if f.name.lower() not in gone]
    schema = T.StructType([*kept, *added])
    names = [f.name for f in kept]
    types = arrow_schema(ddl)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = make()
        for batch in batches:
            for part in slices(batch, source):
                new = columns(part)
                arrays = [part.column(n) for n in names] + [
                    a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(new, types)
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *types.names])
            # A worker outlives its task; what a large batch took goes back to the system.
            batch = part = new = arrays = None
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(work, schema)
