"""Small helpers for Arrow-batched tasks."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


#: Bytes of text of a slice where each byte is held as several numbers of 64 bits for a moment: a Python worker keeps what it once had.
SMALL = 1 << 18


def slices(batch: pa.RecordBatch, column: str = "text", budget: int = 1 << 20):
    """Cut a batch into runs of rows of about `budget` bytes of text (one row at least), to bound a task's memory."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > budget:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's values; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def plainly_named(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with columns renamed that mapInArrow can't look up (dots and backticks in names), and what names a result's again."""
    plain = {c: f"_plain_{i}" for i, c in enumerate(df.columns) if "." in c or "`" in c}
    back = {v: c for c, v in plain.items()}
    return df.toDF(*[plain.get(c, c) for c in df.columns]), lambda out: out.toDF(*[back.get(c, c) for c in out.columns])
