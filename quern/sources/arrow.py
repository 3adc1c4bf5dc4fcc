"""Arrow IPC files of a result, and checksums of their columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_ipc(df: DataFrame, most: int, batch: int = 100) -> bytes:
    """A stream of up to ``most`` rows: a bounded extract for another process, not a way to move tables."""
    table = df.limit(most).toArrow()
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table, max_chunksize=batch)
    return out.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def checksums(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column's sum and nulls."""
    return df.agg(*(F.sum(c).alias(f"sum_{c}") for c in columns), *(F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns))
