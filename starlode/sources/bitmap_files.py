"""Files of run-length bitmaps: a fixed head, then 31-bit codes as 32-bit little-endian words; and writers of binary files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlode.operators import wah
from starlode.storage import ship

#: Fixed values of the format: whether there are fills of ones, magic, numbers of codes and of words they stand for.
HEAD, MAGIC = struct.Struct("<B3xIQQ"), 0x44F8A1EF
#: Fills of ones are worth their extra case beyond this longest run.
LONG_RUN = 8


def packed(ones: bool, codes: list[int], words: int) -> bytes:
    """A file of codes that stand for so many words."""
    return HEAD.pack(ones, MAGIC, len(codes), words) + np.array(codes, "<u4").tobytes()


def unpacked(name: str, data: bytes) -> np.ndarray:
    """The codes of a file; ValueError if it is damaged."""
    if len(data) < HEAD.size or HEAD.unpack_from(data)[1] != MAGIC:
        raise ValueError(f"{name} is no file of run-length words")
    _, _, n, words = HEAD.unpack_from(data)
    codes = np.frombuffer(data, "<u4", offset=HEAD.size, count=min(n, (len(data) - HEAD.size) // 4)).astype(np.int64)
    length = int(np.where(codes >= wah.FILL, codes & wah.LENGTH, 1).sum())
    if len(codes) != n or length != words:
        raise ValueError(f"{name}: {len(codes)} of {n} codes for {length} of {words} words")
    return codes


def has_one_fills(runs: DataFrame) -> DataFrame:
    """(bitmap, one_fills): whether a bitmap's codes should have fills of ones."""
    return wah.longest_ones(runs).select("bitmap", (F.col("longest") > LONG_RUN).alias("one_fills"))


def contents(runs: DataFrame, n_rows: int) -> DataFrame:
    """(bitmap, content): the file of each bitmap of a run table. A file is one task's work, as the format has no blocks."""
    total = -(-n_rows // wah.BITS)
    kinds = has_one_fills(runs)
    chosen = [wah.encoded(runs.join(kinds.where(F.col("one_fills") == kind), "bitmap", "left_semi"), kind).withColumn("one_fills", F.lit(kind)) for kind in (True, False)]
    codes = chosen[0].unionAll(chosen[1])
    whole = codes.groupBy("bitmap", "one_fills").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "codes"))), lambda c: c["codes"])).alias("codes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [packed(ones, values, total) for ones, values in zip(batch.column("one_fills").to_pylist(), batch.column("codes").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("bitmap"), pa.array(files, pa.binary())], names=["bitmap", "content"])

    ship(runs.sparkSession)
    return whole.mapInArrow(run, f"bitmap {dict(runs.dtypes)['bitmap']}, content binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Codes (bitmap, chunk, codes) of files, one chunk each; bitmap is the file's path. ValueError if a file is damaged."""
    found = spark.read.format("binaryFile").load(path).select(F.col("path").alias("bitmap"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("bitmap").to_pylist(), batch.column("content").to_pylist(), strict=True):
                codes = unpacked(name, data)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([0]), pa.array([codes.tolist()], pa.list_(pa.int64()))], names=["bitmap", "chunk", "codes"])

    ship(spark)
    return found.mapInArrow(run, "bitmap string, chunk long, codes array<long>")


def save(files: DataFrame, folder: str, name: str, content: str, append: bool = False) -> DataFrame:
    """(name, bytes): writes the content of each row to a file of that name in a folder that all executors reach; with
    append, behind what is there. A row's file is replaced as a whole when a task runs again, but appended again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            names, data = batch.column(name).to_pylist(), batch.column(content).to_pylist()
            for file, value in zip(names, data, strict=True):
                with (system.open_append_stream if append else system.open_output_stream)(f"{root}/{file}") as out:
                    out.write(value)
            yield pa.RecordBatch.from_arrays([pa.array(map(str, names)), pa.array(map(len, data), pa.int64())], names=["name", "bytes"])

    ship(files.sparkSession)
    return files.select(name, content).mapInArrow(run, "name string, bytes long")


def column_files(rows: DataFrame, widths: dict[str, int], order: str) -> DataFrame:
    """(name, content): the values of whole-number columns in the order of another column, with their width in front.

    A file is one task's work, as the format has no blocks; columns are independent tasks.
    """
    kinds = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(w).alias("width"), F.col(c).cast("long").alias("value")) for c, w in widths.items()])
    each = rows.select(F.col(order).alias("_at"), F.explode(kinds).alias("v")).select("_at", "v.*").groupBy("name", "width")
    values = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "value"))), lambda v: v["value"]).alias("column"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [int(w).to_bytes(4, "little") + np.array(v, np.int64).astype(f"<u{w}").tobytes() for w, v in zip(batch.column("width").to_pylist(), batch.column("column").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(made, pa.binary())], names=["name", "content"])

    ship(rows.sparkSession)
    return values.mapInArrow(run, "name string, content binary")


def read_many(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """(pos, c0, c1, ...) of a headless file of 32-bit columns, one after the other."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [f"c{i}" for i in range(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if len(data) % (4 * columns):
                    raise ValueError(f"{name}: {len(data)} bytes are not {columns} columns")
                values = np.frombuffer(data, "<u4").reshape(columns, -1).astype(np.int64)
                for a in range(0, values.shape[1], 1 << 16):
                    part = values[:, a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + part.shape[1])), *map(pa.array, part)], names=["pos", *names])

    ship(spark)
    return files.mapInArrow(run, "pos long, " + ", ".join(f"{n} long" for n in names))
