"""What the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A-Z to a-z; UTF-8 bytes above 127 stay.
LOWER = bytes(range(256)).lower()
#: The most rows of a slice of an Arrow batch that is worked on at once.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a binary column; null is empty."""
    return [x or b"" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts of about so many bytes; a row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, batch.num_rows * most // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
