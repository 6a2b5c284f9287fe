"""What the operators share: Arrow batches and small column helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starlode.storage import ship, written  # noqa: F401  the operators take written from here

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Text bytes that a kernel handles at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows and bytes per Arrow batch, so that batches of long texts stay small in JVM and Python memory.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches (unless the user did) and makes the package importable on executors."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship(spark)


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What tasks of one worker share, such as a loaded tokenizer; what was held under other names is let go."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def release() -> None:
    """Lets go of what tasks of other operators held in this worker."""
    _held.clear()


def held_out(modulus: int, rest: int) -> Column:
    """Whether crc32 of doc_id as text leaves this remainder; a null doc_id counts as the text ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == rest


HASH_RANGE = 1 << 30


def least_hashed(rows: DataFrame, salt: str, counted: DataFrame, sample: int) -> DataFrame:
    """rows with a hash of doc_id as ``key``, without those that cannot be among the ``sample`` least: what tasks send on
    stays bounded by about twice the sample, however many tasks there are. ``counted`` has about the rows to choose from."""
    n = counted.count()
    bound = HASH_RANGE if n <= 2 * sample else int(HASH_RANGE * (2 * sample / n))
    return rows.withColumn("key", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(salt)), F.lit(HASH_RANGE))).where(F.col("key") < bound)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets (from 0) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of each slice have about ``size`` bytes at most."""
    for batch in batches:
        _, at = text_buffer(batch.column(batch.schema.get_field_index(column)))
        start, n = 0, batch.num_rows
        while start < n:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + size, side="right")) - 1)
            yield batch.slice(start, min(stop, n) - start)
            start = stop


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """mapInArrow over bounded slices."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches, column):
            out = fn(part)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def batch_of(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
