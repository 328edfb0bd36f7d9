"""Adding columns computed from Arrow batches, with the other columns passed through."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows looked at together, of batches of about so many bytes from Spark (its own limit is 64 MB, kept twice in the JVM).
ROWS, BATCH_BYTES = 256, 4 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of BATCH_BYTES at most unless it has a lower limit: what a task holds of texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(-?\d+)\s*([kmgt]?)i?b?", spark.conf.get(name).lower())
    if now is None or not 0 < int(now[1]) << 10 * " kmgt".index(now[2] or " ") <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")
    return spark


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in small ones; one empty batch at least for each that comes."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), ROWS):
            yield batch.slice(at, ROWS)


def add_columns(df: DataFrame, added: str, compute: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], keep: list[str] | None = None) -> DataFrame:
    """df's columns named in keep (all, if None) and those of the DDL string `added`, which replace columns of the same
    name. compute() is called once a task and gives the function from a batch to the added columns."""
    bounded(df.sparkSession)
    new = T.StructType.fromDDL(added)
    names = {f.name.lower() for f in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in names and (keep is None or f.name in keep)]
    schema = T.StructType(kept + new.fields)
    order, titles = [f.name for f in kept], [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = compute()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in order] + of(batch), titles)

    return df.mapInArrow(run, schema)
