"""Row-wise access to Arrow batches, so that a task holds one batch and one text at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Output rows per batch; the input batch bounds the texts held.
OUT_ROWS = 2048


def give_back() -> None:
    """Return free memory of this Python worker to the machine; workers live on and serve the tasks of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def boxed(df: DataFrame) -> Column:
    """All columns of ``df`` in one struct ``row``, where no name of theirs meets a name of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, longer where ``columns`` have it already in upper or lower case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., Iterator[tuple]]], finish: bool = False) -> DataFrame:
    """``mapInArrow`` from rows to rows.

    ``make`` runs once per task and returns a function from the values of one
    input row to an iterable of output tuples. With ``finish`` that function is
    called once more without arguments at the end of the task.
    """
    fields = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        target, row, out = to_arrow_schema(fields), make(), []

        def emit(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

        for batch in batches:
            columns = batch.columns
            for i in range(batch.num_rows):
                for made in row(*[c[i].as_py() for c in columns]):
                    out.append(made)
                    if len(out) >= OUT_ROWS:
                        yield emit(out)
                        out = []
            if out:
                yield emit(out)
                out = []
        if finish:
            for made in row():
                out.append(made)
                if len(out) >= OUT_ROWS:
                    yield emit(out)
                    out = []
            if out:
                yield emit(out)

    return df.mapInArrow(run, fields)
