"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from paddock.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, so a
    lost executor re-reads a file instead of recomputing what came before."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema(df: DataFrame, keep: str, rest: str) -> T.StructType:
    """The schema of column ``keep`` of ``df`` followed by the columns of the DDL string ``rest``."""
    return T.StructType([df.schema[keep], *T.StructType.fromDDL(rest).fields])


def byte_values(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at 8 MB, so that long texts don't add up in an executor or a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def slices(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts and lists come to about ``limit`` bytes, one row at least."""
    size = np.full(batch.num_rows, 16, np.int64)
    for c in batch.columns:
        if pa.types.is_binary(c.type) or pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            size += np.asarray(pc.fill_null(pc.binary_length(c), 0))
        elif pa.types.is_list(c.type):
            size += 4 * np.asarray(pc.fill_null(pc.list_value_length(c), 0))
    part = (np.cumsum(size) - size) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def per_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], out: T.StructType,
              limit: int = 4 << 20) -> DataFrame:
    """Map Arrow batches of about ``limit`` bytes; ``make`` runs once per task and returns
    a function from a batch to the columns of ``out``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(out)
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for whole in batches:
            for part in slices(whole, limit):
                columns = fn(part)
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
                     for c, f in zip(columns, target, strict=True)], schema=target)

    return df.mapInArrow(run, out)
